"""Operators on natural-language texts; nothing outside this subpackage imports it."""
