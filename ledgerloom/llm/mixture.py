"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, gets a virtual finish time: the tokens of
its source up to and with it, divided by the source's weight. Taking documents by
finish time serves each source in proportion to its weight; a source is run through
again (a new round behind the last) at most ``max_repeats`` times in all. The sorted
sequence is cut at the total budget.

Both running sums are two-level: inside a source by hash ranges, whose sums are chained; over the whole
mixture by a range sort, whose ranges' sums the driver adds up (one number per range of about
``bucket_rows`` uses). No task holds a source or the whole order.

Defined results: source names are compared without case and surrounding white space;
documents without a source, of a source without target, or without tokens stay out; a
target that is null or not positive, or a repeat count below one, excludes its source;
targets of one name add up (largest repeat count). Targets of sources without
documents are shared out among the others in proportion. Without a budget the total
is the largest at which no source runs out, so every source meets its share to within
one document; with a larger budget short sources fall behind and are reported so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from ..operators.ordered import ranged
from ..session import written

#: uses of documents per range aimed at
BUCKET_ROWS = 200_000


@dataclass
class MixPlan:
    """What the driver knows: one row per listed source, nothing per document."""

    rows: list[dict]
    budget: int
    limit: float


def targets(mix: DataFrame) -> DataFrame:
    t = mix.select(F.lower(trim_ws(F.col("source"))).alias("source"), "target_share", "max_repeats")
    return t.where("source is not null and source <> ''").groupBy("source").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def sized_documents(tokens: DataFrame, mix: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, h: the documents that can be used, with a shuffle hash.
    tokens(doc_id, source, n_tokens) already carries the raw source name."""
    d = tokens.withColumn("source", F.lower(trim_ws(F.col("source")))).where("n_tokens > 0")
    usable = targets(mix).where("target_share > 0 and max_repeats >= 1").select("source")
    # mix lists sources, a handful of rows; Spark broadcasts it if it is as small as that
    return d.join(usable, "source", "left_semi").select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h"))


def make_plan(sized: DataFrame, mix: DataFrame, budget: int | None = None) -> MixPlan:
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("longest"), F.count("*").alias("docs"))
    rows = [r.asDict() for r in targets(mix).join(have, "source", "left").orderBy("source").collect()]
    live = [r for r in rows if r["have"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) >= 1]
    total = sum(r["target_share"] for r in live)
    for r in live:
        r["weight"] = r["target_share"] / total
        r["cap"] = r["have"] * r["max_repeats"]
    if not live:
        return MixPlan(rows, 0, 0.0)
    v = min(r["cap"] / r["weight"] for r in live)
    if budget is None:
        budget = int(v)
    else:  # virtual time at which the budget is served, sources dropping out as they run dry
        left, served, v, w = sorted(live, key=lambda r: r["cap"] / r["weight"]), 0.0, 0.0, 1.0
        for r in left:
            at = r["cap"] / r["weight"]
            if served + (at - v) * w >= budget:
                break
            served, v, w = served + (at - v) * w, at, w - r["weight"]
        v = v + (budget - served) / w if w > 1e-12 else v
    # documents that finish up to here can be inside the budget
    limit = v + max(r["longest"] / r["weight"] for r in live)
    return MixPlan(rows, budget, limit)


def mixture(sized: DataFrame, plan: MixPlan, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, repeat (from 1), n_tokens, start: the token position in the mixture."""
    spark = sized.sparkSession
    live = [r for r in plan.rows if "weight" in r]
    info = spark.createDataFrame([(r["source"], float(r["weight"]), int(r["have"]), int(r["max_repeats"])) for r in live], "source string, weight double, have bigint, max_repeats int")
    n = max(1, sum(r["docs"] for r in live))
    k = max(16, -(-n // bucket_rows))
    # level one: order inside a source by hash; bucket = the hash range it falls in
    d = sized.withColumn("b", F.shiftrightunsigned(F.col("h"), 33) * F.lit(k).cast("bigint") / F.lit(float(2**31)))
    d = d.withColumn("b", F.floor("b").cast("int")).withColumn("u", F.shiftrightunsigned(F.col("h"), 1))
    d = d.join(F.broadcast(info), "source")  # one row per listed source
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offs = d.groupBy("source", "b").agg(F.sum("n_tokens").alias("t")).select("source", "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("source", "b").orderBy("u", "h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("cum", F.sum("n_tokens").over(inside)).join(offs, ["source", "b"]).withColumn("cum", F.col("cum") + F.col("off"))
    d = d.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    d = d.withColumn("finish", (F.col("cum") + (F.col("repeat") - 1) * F.col("have")) / F.col("weight")).where(F.col("finish") <= plan.limit)
    # level two: one global range sort by finish time, cut at the budget
    d = written(d.select("doc_id", "source", "repeat", "n_tokens", "finish"), "mix-order")
    order = ["finish", "source", "doc_id", "repeat"]
    d, offs = ranged(d, order, d.count(), F.col("n_tokens"), bucket_rows)
    run = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("cum", F.sum("n_tokens").over(run)).join(F.broadcast(offs), "_r").withColumn("stop", F.col("cum") + F.col("_o"))  # one row per range
    return d.where(F.col("stop") <= plan.budget).select("doc_id", "source", "repeat", "n_tokens", (F.col("stop") - F.col("n_tokens")).alias("start"))


def shares(mixed: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per listed source: target, reached share, tokens, documents, largest number of uses."""
    spark = mixed.sparkSession
    base = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], int(r["have"] or 0)) for r in plan.rows], "source string, target_share double, max_repeats int, source_tokens bigint")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeat").alias("uses"))
    total = F.sum("tokens").over(Window.partitionBy())
    out = base.join(got, "source", "left").na.fill(0, ["tokens", "documents", "uses"])
    return out.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("reached_share"), "tokens", "documents", "uses", "max_repeats", "source_tokens")
