"""Ledgerloom: a PySpark-native engine for accounts-payable deliveries.

Every operator takes DataFrames and returns a DataFrame; storage operators keep
their files in the folder shared by all executors (see :mod:`ledgerloom.session`).
"""
