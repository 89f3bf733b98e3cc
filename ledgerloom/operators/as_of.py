"""Attributes as known at an event's time.

Two operators, both without a pair of every event with every change of its key:

* :func:`latest_before`: per event the greatest log value at or before its time.
* :func:`as_known_join`: per event the fact that was valid for its date *and* known at
  its time, from materialised periodic snapshots plus the change logs between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .cells import after_last, day_cells, span_cells

#: Above this many snapshot and log rows the event join shuffles instead of broadcasting.
BROADCAST_ROWS = 200_000


def latest_before(events: DataFrame, log: DataFrame, span: str = "day") -> DataFrame:
    """events(key, t, ...), log(key, t, value) -> events with ``value``: the maximum of the
    log values of the key with log.t <= event.t, null if there is none.

    Time is cut into spans. Inside a (key, span) a running maximum is enough; what came
    before enters as one carried value per (key, span), chained over the few span
    summaries of a key. So no task holds all rows of a key, however hot it is.
    Null keys or times match nothing; ties in time count as known.
    """
    extra = [c for c in events.columns if c not in ("key", "t")]
    ev = events.select("key", "t", F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in extra]).alias("_row"))
    lg = log.select("key", "t", F.lit(0).alias("_side"), "value").where(F.col("key").isNotNull() & F.col("t").isNotNull())
    both = ev.unionByName(lg, allowMissingColumns=True).withColumn("_span", F.date_trunc(span, F.col("t")))
    w = Window.partitionBy("key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.where(F.col("key").isNotNull()).groupBy("key", "_span").agg(F.max("value").alias("_m")).select("key", "_span", F.max("_m").over(w).alias("_carry"))
    inner = Window.partitionBy("key", "_span").orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_run", F.max("value").over(inner)).where("_side = 1").join(carry, ["key", "_span"], "left")
    usable = F.col("key").isNotNull() & F.col("t").isNotNull()
    return out.select("key", "t", *[F.col("_row")[c].alias(c) for c in extra], F.when(usable, F.greatest("_run", "_carry")).alias("value"))


@dataclass(frozen=True)
class Facts:
    """Columns of a table of facts: who they are about, the dates they hold for (half open,
    null end: open), which revision they are and when they became known."""

    entity: str
    valid_from: str
    valid_to: str
    sequence: str
    row_id: str
    known_at: str


def standing_intervals(facts: DataFrame, f: Facts) -> DataFrame:
    """Each fact with the time [known, beaten) in which it is the one that stands for its
    (entity, valid_from): the known row of highest sequence, then smallest id."""
    better = Window.partitionBy("entity", "vf").orderBy(F.desc("sequence"), F.asc("row_id")).rowsBetween(Window.unboundedPreceding, -1)
    out = facts.select(
        F.col(f.entity).alias("entity"), F.col(f.valid_from).cast("date").alias("vf"), F.col(f.valid_to).cast("date").alias("vt"),
        F.col(f.sequence).alias("sequence"), F.col(f.row_id).alias("row_id"), F.col(f.known_at).alias("known"), F.col("stands_for_nothing") if "stands_for_nothing" in facts.columns else F.lit(False).alias("stands_for_nothing"),
    ).where(F.col("known").isNotNull() & F.col("vf").isNotNull() & F.col("entity").isNotNull())
    out = out.withColumn("beaten", F.min("known").over(better))
    return out.where(F.col("beaten").isNull() | (F.col("beaten") > F.col("known")))


def snapshots_and_changes(facts: DataFrame, f: Facts, until: Column, last_date: Column) -> DataFrame:
    """(period, unit, start, entity, kind, ...): what is known about each calendar cell of dates in each
    month of knowledge. A snapshot row per cell is the winner of the facts that stand all the month;
    change rows are the facts that began or ceased to stand within it and that are not beaten by the
    snapshot anyway. until, last_date: the latest event time and date."""
    s = standing_intervals(facts, f).where(~F.col("stands_for_nothing"))
    month = lambda c: F.trunc(c.cast("date"), "month")
    end = F.least(F.coalesce(F.col("vt"), after_last(last_date)), after_last(last_date))
    s = s.withColumn("rank", F.struct("sequence", (-F.datediff("vf", F.lit("1970-01-01").cast("date"))).alias("early"), (-F.col("row_id")).alias("tie")))
    s = s.withColumn("cells", span_cells(F.col("vf"), end)).where(F.size("cells") > 0).drop("vf", "vt", "sequence", "stands_for_nothing")
    last = month(F.least(F.coalesce(F.col("beaten"), until), until))
    s = s.where(month(F.col("known")) <= last).withColumn("period", F.explode(F.sequence(month(F.col("known")), last, F.expr("interval 1 month"))))
    opens, closes = F.col("period").cast("timestamp_ntz"), F.add_months("period", 1).cast("timestamp_ntz")
    s = s.where(F.col("beaten").isNull() | (F.col("beaten") > opens))
    whole = (F.col("known") <= opens) & (F.col("beaten").isNull() | (F.col("beaten") >= closes))
    s = s.withColumn("whole", whole).withColumn("cell", F.explode("cells")).select("entity", "period", "cell.unit", "cell.start", "rank", "row_id", "known", "beaten", "whole")
    by = ["entity", "period", "unit", "start"]
    snap = s.where("whole").groupBy(*by).agg(F.max("rank").alias("top"), F.max_by("row_id", "rank").alias("row_id"))
    change = s.where("not whole").join(snap.select(*by, "top"), by, "left").where(F.col("top").isNull() | (F.col("rank") > F.col("top")))
    none = F.lit(None).cast("timestamp_ntz")
    return snap.select(*by, F.lit("snapshot").alias("kind"), F.col("top").alias("rank"), "row_id", none.alias("known"), none.alias("beaten")).unionByName(
        change.select(*by, F.lit("change").alias("kind"), "rank", "row_id", "known", "beaten")
    )


def as_known_join(events: DataFrame, facts: DataFrame, f: Facts, *, event_id: str, entity: str, at: str, date: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """events(event_id unique) -> (event_id, row_id) of the fact that applied to its date and
    was known at its time. ``facts`` may hold a boolean ``stands_for_nothing``: such a row
    (a withdrawal) takes its slot but never applies. Of several applicable facts the
    highest sequence wins, then the earliest valid_from. Events without entity, time or
    date, or without an applicable fact, give no row.

    An event meets, in each of the three calendar cells of its date, one snapshot row of its month
    and the changes of that month for that cell: no row of any other date or month.
    """
    e = events.select(F.col(event_id).alias("_id"), F.col(entity).alias("entity"), F.col(at).alias("_at"), F.col(date).cast("date").alias("_d"))
    e = e.where(F.col("entity").isNotNull() & F.col("_at").isNotNull() & F.col("_d").isNotNull())
    lim = events.agg(F.max(at).alias("until"), F.max(F.col(date).cast("date")).alias("last")).first()
    if lim["until"] is None or lim["last"] is None:
        return e.select(F.col("_id").alias(event_id)).join(facts.select(f.row_id), F.lit(False)).select(event_id, f.row_id)
    known = snapshots_and_changes(facts, f, F.lit(lim["until"]).cast("timestamp_ntz"), F.lit(lim["last"]))
    known = written(known, "as-known")
    if known.count() <= broadcast_rows:  # the size is measured on what was written, not assumed
        known = F.broadcast(known)
    e = e.withColumn("period", F.trunc(F.col("_at").cast("date"), "month")).withColumn("cell", F.explode(day_cells(F.col("_d"))))
    hit = e.select("_id", "_at", "entity", "period", "cell.unit", "cell.start").join(known, ["entity", "period", "unit", "start"]).where(
        (F.col("known").isNull() | (F.col("known") <= F.col("_at"))) & (F.col("beaten").isNull() | (F.col("_at") < F.col("beaten")))
    )
    return hit.groupBy("_id").agg(F.max_by("row_id", "rank").alias(f.row_id)).withColumnRenamed("_id", event_id)
