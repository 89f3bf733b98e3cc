"""References to records that do not exist: orphans along a foreign-key graph.

Direct orphans are found per edge. Then a fixpoint: the children of orphaned rows are
indirectly orphaned; each round semi-joins the child tables with the keys orphaned in the
round before, until a round finds nothing (cycles end because a row is reported once).

Defined results: a null reference is no reference; keys are compared after the edge's
canonical form. Reasons, first that holds: ``missing`` (the key never occurs in the
parent), ``late`` (it first exists after the child's time), ``deleted`` (it existed and is
gone). A row is reported once per edge it is a direct orphan of, and once as inherited
if it is no direct orphan of that edge's child table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .as_of import latest_before


@dataclass
class Node:
    """A table: rows(record_key, own_key, ...); own_key is what children refer to (null: nothing does)."""

    name: str
    rows: DataFrame
    record_key: Column
    own_key: Column | None = None


@dataclass
class Edge:
    """child.ref at child.at -> parent. ``spans``: parent(key, first_at, gone_at), one row per
    key; or ``changes``: parent(key, t, value struct whose first field orders and whose field
    ``gone`` tells removal)."""

    child: str
    parent: str
    ref: Column
    at: Column
    spans: DataFrame | None = None
    changes: DataFrame | None = None


def existence_spans(rows: DataFrame, key: Column, received: str, deleted: str) -> DataFrame:
    """key, first_at, gone_at: from the earliest delivery until the first deletion."""
    return rows.select(key.alias("key"), F.col(received).alias("r"), F.col(deleted).alias("d")).where("key is not null").groupBy("key").agg(F.min("r").alias("first_at"), F.min("d").alias("gone_at"))


def _by_span(child: DataFrame, spans: DataFrame) -> DataFrame:
    j = child.join(spans, "key", "left")
    reason = (
        F.when(F.col("first_at").isNull(), "missing")
        .when(F.col("first_at") > F.col("t"), "late")
        .when(F.col("gone_at") <= F.col("t"), "deleted")
    )
    return j.withColumn("reason", reason).where("reason is not null").select("record_key", "key", "t", "reason")


def _by_changes(child: DataFrame, changes: DataFrame) -> DataFrame:
    state = latest_before(child, changes)
    lost = state.where(F.col("value").isNull() | F.col("value.gone")).select("record_key", "key", "t")
    lost = written(lost, "orphans")
    # when a key first existed is needed for the keys of orphans only
    log = changes.join(lost.select("key").distinct(), "key", "left_semi")
    alive = latest_before(log.where(~F.col("value.gone")).select("key", "t"), log).where(~F.col("value.gone"))
    first = alive.groupBy("key").agg(F.min("t").alias("first_at"))
    known = log.groupBy("key").agg(F.lit(True).alias("occurs"))
    j = lost.join(known, "key", "left").join(first, "key", "left")
    reason = F.when(F.col("occurs").isNull(), "missing").when(F.col("first_at") > F.col("t"), "late").otherwise("deleted")
    return j.select("record_key", "key", "t", reason.alias("reason"))


def orphans(nodes: list[Node], edges: list[Edge], max_rounds: int | None = None) -> DataFrame:
    """child_table, record_key, kind (direct, inherited), reason (of inherited: the parent table),
    at: the time of the reference, round. Ends when a round finds nothing: a row is found once.
    Orphans left beyond max_rounds are an error."""
    by = {n.name: n for n in nodes}

    def refs(e: Edge) -> DataFrame:
        n = by[e.child]
        return n.rows.select(n.record_key.alias("record_key"), e.ref.alias("key"), e.at.alias("t")).where("key is not null")

    found = None
    for e in edges:
        one = _by_span(refs(e), e.spans) if e.spans is not None else _by_changes(refs(e), e.changes)
        one = one.select(F.lit(e.child).alias("child_table"), "record_key", F.lit("direct").alias("kind"), "reason", F.col("t").alias("at"), F.lit(0).alias("round"))
        found = one if found is None else found.unionByName(one)
    rounds = [written(found, "orphans-direct")]
    tables = {e.child for e in edges}
    for k in count(1):
        step, seen = None, reduce(DataFrame.unionByName, rounds)
        for e in edges:
            parent = by[e.parent]
            if e.parent not in tables or parent.own_key is None:
                continue
            bad = rounds[-1].where(F.col("child_table") == e.parent).select("record_key")
            keys = parent.rows.select(parent.record_key.alias("record_key"), parent.own_key.alias("key")).join(bad, "record_key", "left_semi").select("key").distinct()
            hit = refs(e).join(keys, "key", "left_semi")
            hit = hit.join(seen.where(F.col("child_table") == e.child).select("record_key"), "record_key", "left_anti")
            hit = hit.select(F.lit(e.child).alias("child_table"), "record_key", F.lit("inherited").alias("kind"), F.lit(e.parent).alias("reason"), F.col("t").alias("at"), F.lit(k).alias("round"))
            step = hit if step is None else step.unionByName(hit)
        if step is None:
            break
        step = written(step.dropDuplicates(["child_table", "record_key"]), "orphans-inherited")
        tables = {r[0] for r in step.select("child_table").distinct().collect()}  # at most one per table
        if not tables:
            break
        if max_rounds is not None and k > max_rounds:
            raise RuntimeError(f"orphans are left after {max_rounds} rounds")
        rounds.append(step)
        if not any(e.parent in tables and by[e.parent].own_key is not None for e in edges):
            break
    return reduce(DataFrame.unionByName, rounds)


def orphan_report(found: DataFrame) -> DataFrame:
    """Counted by table, month of the reference, kind and reason."""
    return found.groupBy("child_table", F.date_format("at", "yyyy-MM").alias("month"), "kind", "reason").agg(F.count("*").alias("n"))
