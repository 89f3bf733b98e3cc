"""Operators that need the order of a key's rows, without a task that holds a key.

Rows are cut into blocks of an integer order column; inside (key, block) an ordinary
window is enough, and between blocks only one summary row per block is chained. The
order column should be unique per key (ties fall back to ``tie``), so a block holds at
most ``block`` rows of a key; for a column with wide gaps pass ``block_width`` as the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def block_width(df: DataFrame, order: str, block: int = BLOCK) -> int:
    """Width of order ranges that hold about ``block`` rows of the table each, for a sparse column: with
    the default width every row of it would be a block of its own."""
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    return block if not n or lo is None else max(block, (hi - lo + 1) * block // n)


def _block(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(order) / block).cast("long"))


def previous_row(df: DataFrame, key: list[str], order: str, value: Column, name: str, tie: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``name``: struct(v) of the previous row of the key by (order, tie), null for the first."""
    by = [order, *(tie or [])]
    d = _block(df.withColumn("_v", F.struct(value.alias("v"))), order, block)
    d = d.withColumn("_p", F.lag("_v").over(Window.partitionBy(*key, "_b").orderBy(*by)))
    ends = d.groupBy(*key, "_b").agg(F.max_by("_v", F.struct(*by)).alias("_e"))
    ends = ends.withColumn("_c", F.lag("_e").over(Window.partitionBy(*key).orderBy("_b"))).drop("_e")
    on = [d[k].eqNullSafe(ends[k]) for k in (*key, "_b")]
    j = d.join(ends, on, "left").drop(*[ends[k] for k in (*key, "_b")])
    return j.withColumn(name, F.coalesce("_p", "_c")).drop("_v", "_b", "_p", "_c")


def running(df: DataFrame, key: list[str], order: str, value: Column, name: str, how: str = "sum", inclusive: bool = True, tie: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Running sum or max of ``value`` per key, up to the row or (not inclusive) before it."""
    agg = {"sum": F.sum, "max": F.max}[how]
    by = [order, *(tie or [])]
    d = _block(df.withColumn("_v", value), order, block)
    end = Window.currentRow if inclusive else -1
    d = d.withColumn("_i", agg("_v").over(Window.partitionBy(*key, "_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, end)))
    sums = d.groupBy(*key, "_b").agg(agg("_v").alias("_s"))
    sums = sums.withColumn("_c", agg("_s").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    on = [d[k].eqNullSafe(sums[k]) for k in (*key, "_b")]
    j = d.join(sums, on, "left").drop(*[sums[k] for k in (*key, "_b")])
    out = F.coalesce(F.col("_i") + F.col("_c"), "_i", "_c") if how == "sum" else F.greatest("_i", "_c")
    return j.withColumn(name, out).drop("_v", "_b", "_i", "_c")


#: rows of a range of a global order
RANGE_ROWS = 1_000_000


def ranged(df: DataFrame, order: list[str], rows: int, size: Column | None = None, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows, range partitioned by the columns into about rows / range_rows ranges and written with
    their range ``_r``; and per range (``_r``, ``_o``) the sum of ``size`` (default: the number of rows)
    in the ranges before. The driver adds up one number per range."""
    from ..session import written

    spark = df.sparkSession
    k = max(1, -(-rows // range_rows))
    out = written(df.repartitionByRange(k, *order).withColumn("_r", F.spark_partition_id()), "ranges")
    sums = sorted((r["_r"], int(r["s"] or 0)) for r in out.groupBy("_r").agg((F.count("*") if size is None else F.sum(size)).alias("s")).collect())
    before, at = [], 0
    for r, s in sums:
        before.append((r, at))
        at += s
    return out, spark.createDataFrame(before or [(0, 0)], "_r int, _o bigint")


def dense_number(df: DataFrame, order: list[str], name: str = "n", range_rows: int = RANGE_ROWS) -> DataFrame:
    """1, 2, 3, ... in the order of the columns (unique together), without a global window: rows are
    numbered inside ranges of about ``range_rows``, and the sizes of the ranges before are added."""
    d, offs = ranged(df, order, df.count(), range_rows=range_rows)
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy(*order)))
    return d.join(F.broadcast(offs), "_r").withColumn(name, F.col("_k") + F.col("_o")).drop("_r", "_k", "_o")  # one row per range


def page_size(asked: int | None, default: int = 100, most: int = 250) -> int:
    """The page a request gets: the default for none, at least one, at most ``most``."""
    return default if asked is None else max(1, min(asked, most))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next page behind ``after`` with ``has_more``; the bound is a predicate, so a table laid
    out in that order is read from there on. ``size`` is the page, the feature itself."""
    if after is not None:
        cond, equal = F.lit(False), F.lit(True)
        for c, v in zip(order, after):
            cond = cond | (equal & (F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        df = df.where(cond)
    page = df.orderBy(*order).limit(size + 1)
    d = page.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most size + 1 rows
    return d.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits each task to n per group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the largest by the order columns; combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    s = df.groupBy(*key).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_m"))
    return s.select(*key, *[F.col("_m._row")[c].alias(c) for c in rest])


def versions(revisions: DataFrame, key: list[str], seq: str, content: Column, gone: Column, tie: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds version (counts content changes of the key) and provenance_only (the delivery changed
    nothing). A removal is a change of content; what follows a removal is one, too."""
    state = F.struct(F.coalesce(gone, F.lit(False)).alias("gone"), F.when(~F.coalesce(gone, F.lit(False)), content).alias("content"))
    d = previous_row(revisions.withColumn("_st", state), key, seq, F.col("_st"), "_prev", tie, block)
    d = d.withColumn("provenance_only", F.coalesce(F.col("_prev.v").eqNullSafe(F.col("_st")) & F.col("_prev").isNotNull(), F.lit(False)))
    d = running(d, key, seq, F.when(F.col("provenance_only"), 0).otherwise(1), "version", tie=tie, block=block)
    return d.drop("_st", "_prev")


def stale_overwrites(revisions: DataFrame, key: list[str], arrival: str, change_seq: str, block: int = BLOCK) -> DataFrame:
    """Rows whose change_seq is below the highest that arrived before for the key."""
    d = running(revisions, key, arrival, F.col(change_seq), "_top", "max", inclusive=False, block=block)
    return d.where(F.col(change_seq) < F.col("_top")).drop("_top")
