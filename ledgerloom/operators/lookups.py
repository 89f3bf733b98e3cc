"""Joins the inventory names: exact, exact-else-canonical, specific-else-generic, interval,
semi. All equi joins; Catalyst and AQE choose broadcast or shuffle by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import after_last, day_cells, span_cells


def exact_else_canonical(left: DataFrame, ref: Column, right: DataFrame, key: str, canon, payload: list[str]) -> DataFrame:
    """Looks a reference up as spelled, else by its canonical form; of several parents with one
    canonical form the one with the largest spelling wins. Adds matched_key, how, payload."""
    left = left.withColumn("_ref", ref).withColumn("_can", canon(ref))
    exact = right.groupBy(F.col(key).alias("_ref")).agg(F.min(F.struct(key, *payload)).alias("_x"))
    by_form = right.groupBy(canon(F.col(key)).alias("_can")).agg(F.max(F.struct(key, *payload)).alias("_c"))
    j = left.join(exact, "_ref", "left").join(by_form, "_can", "left").withColumn("_m", F.coalesce("_x", "_c"))
    how = F.when(F.col("_x").isNotNull(), "exact").when(F.col("_c").isNotNull(), "canonical").otherwise("none")
    return j.select("*", F.col("_m")[key].alias("matched_key"), how.alias("how"), *[F.col("_m")[p].alias(f"matched_{p}") for p in payload]).drop("_ref", "_can", "_x", "_c", "_m")


def specific_else_generic(left: DataFrame, special: str, general: str, table: DataFrame, values: list[str]) -> DataFrame:
    """Looks (special, general) up, else (null or empty, general)."""
    t = table.select(F.coalesce(F.col(special), F.lit("")).alias("_s"), F.col(general).alias("_g"), F.struct(*values).alias("_v")).groupBy("_s", "_g").agg(F.min("_v").alias("_v"))
    spec = t.where("_s <> ''").withColumnRenamed("_v", "_a")
    gen = t.where("_s = ''").select("_g", F.col("_v").alias("_n"))
    j = left.withColumn("_s", F.col(special)).withColumn("_g", F.col(general)).join(spec, ["_s", "_g"], "left").join(gen, "_g", "left")
    v = F.coalesce("_a", "_n")
    return j.select("*", *[v[c].alias(c) for c in values if c not in left.columns]).drop("_s", "_g", "_a", "_n")


def interval_lookup(events: DataFrame, event_id: str, entity: str, date: str, spans: DataFrame, lo: str, hi: str, rank: Column, value: str) -> DataFrame:
    """event -> the ``value`` of the span of its entity with lo <= date < hi of the highest rank.

    The spans are cut into calendar cells and each (entity, cell) keeps its winner only, so the join is
    on equality and an event meets at most three rows."""
    e = events.select(F.col(event_id).alias("_id"), F.col(entity).alias("_e"), F.col(date).cast("date").alias("_d"))
    last = F.lit(events.agg(F.max(F.col(date).cast("date"))).first()[0]).cast("date")
    s = spans.select(F.col(entity).alias("_e"), F.col(lo).cast("date").alias("_lo"), F.col(hi).cast("date").alias("_hi"), rank.alias("_rank"), F.col(value).alias(value))
    end = F.least(F.coalesce(F.col("_hi"), after_last(last)), after_last(last))
    s = s.where("_lo is not null").withColumn("_c", F.explode(span_cells(F.col("_lo"), end)))
    best = s.groupBy("_e", F.col("_c.unit").alias("_u"), F.col("_c.start").alias("_s")).agg(F.max("_rank").alias("_rank"), F.max_by(value, "_rank").alias(value))
    e = e.withColumn("_c", F.explode(day_cells(F.col("_d")))).select("_id", "_e", F.col("_c.unit").alias("_u"), F.col("_c.start").alias("_s"))
    return e.join(best, ["_e", "_u", "_s"]).groupBy("_id").agg(F.max_by(value, "_rank").alias(value)).withColumnRenamed("_id", event_id)


def embedded_else_separate(parents: DataFrame, array: str, separate: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The lines of each parent: those in its array if it has any, else the separate rows of its key, in
    the order of the columns. key, the line's columns, place (from 1), embedded. A separate row whose
    parent does not exist, or has lines of its own, is left out. Null keys match nothing."""
    own = parents.where(F.size(array) > 0).select(*key, F.explode(array).alias("_l"))
    names = [f.name for f in parents.schema[array].dataType.elementType.fields]
    own = own.select(*key, *[F.col("_l")[n].alias(n) for n in names], F.lit(True).alias("embedded"))
    without = parents.where(F.coalesce(F.size(array), F.lit(0)) <= 0).select(*key)
    rest = separate.select(*key, *names).join(without, key, "left_semi").withColumn("embedded", F.lit(False))
    w = Window.partitionBy(*key).orderBy(*[F.asc_nulls_first(c) for c in order])
    return own.unionByName(rest).withColumn("place", F.row_number().over(w).cast("bigint"))
