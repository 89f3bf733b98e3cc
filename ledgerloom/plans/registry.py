"""Modules of the core that define QUERIES and SQL."""

from __future__ import annotations


def modules() -> list:
    from . import inventory, ledger, payables, pipelines

    return [payables, inventory, ledger, pipelines]
