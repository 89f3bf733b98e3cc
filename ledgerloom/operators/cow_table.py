"""A stream of inserts, updates and deletes: bucketed copy-on-write table.

The base is the log of distinct changes, hashed by key into buckets and sorted by
(key, seq) in each file. ``apply`` routes incoming changes to their buckets,
merges only the buckets that got any, writes replacement files and commits a new
manifest. Keeping every distinct change, not just the last, makes the result
independent of delivery order: a change that arrives late falls into its place. ``compact``
folds the changes up to a horizon into one row per key, so a bucket costs its live keys and
the changes since; changes at or below the horizon are refused from then on.

Defined results: changes apply in the order of ``seq``; of several rows with one
(key, seq) the first delivered counts (smallest ``delivered`` columns). I and U set
the whole content, D removes it. ``current`` gives each existing key with the seq of the change that
produced its present content. Rows with a null key or seq cannot be applied and are
left out of the table (``unusable`` returns them). Any op other than D sets. A batch given again
with its number is skipped; without a number it changes nothing.

Hot keys: rows are moved and grouped by (bucket, span of seq) or (key, span of seq). The span's
width follows from the log's range and size, so sparse numbers do not make a span a row; a seq
number occurs once, so a span holds few rows of any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Versioned
from .ordered import block_width

BLOCK = 100_000


class CowTable(Versioned):
    def __init__(self, spark: SparkSession, path: str, *, key: Column, seq: str, op: str, content: list[str], delivered: list[str], buckets: int, block: int = BLOCK):
        super().__init__(spark, path)
        self.key, self.seq, self.op, self.content, self.delivered = key, seq, op, content, delivered
        self.buckets, self.block = buckets, block

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def _routed(self, changes: DataFrame, horizon: int | None) -> DataFrame:
        out = changes.select(
            self.key.alias("key"),
            F.col(self.seq).alias("seq"),
            F.struct((F.col(self.op) == "D").alias("gone"), *[F.when(F.col(self.op) != "D", F.col(c)).alias(c) for c in self.content]).alias("state"),
            F.struct(*[F.col(c).alias(f"d{i}") for i, c in enumerate(self.delivered)]).alias("first"),
        ).where("key is not null and seq is not null")
        return self._bucketed(out if horizon is None else out.where(F.col("seq") > horizon))

    def _base(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        dirs = [f"{self.path}/data/{a}/bucket={b}" for b, a in manifest.get("buckets", {}).items() if only is None or int(b) in only]
        return self.spark.read.parquet(*dirs) if dirs else None

    def unusable(self, changes: DataFrame) -> DataFrame:
        return changes.where(self.key.isNull() | F.col(self.seq).isNull())

    def too_late(self, changes: DataFrame) -> DataFrame:
        """Changes at or below the horizon of the last compaction."""
        horizon = self.manifest()[1].get("horizon")
        return changes.where(F.lit(False) if horizon is None else F.col(self.seq) <= horizon)

    def _write(self, rows: DataFrame, attempt: str) -> tuple[list[str], dict]:
        rows.sortWithinPartitions("bucket", "key", "seq").write.partitionBy("bucket").parquet(f"{self.path}/data/{attempt}")
        wrote = [n[7:] for n in self.files.names(f"data/{attempt}") if n.startswith("bucket=")]
        return wrote, rows.select("key", "seq", "state").schema.jsonValue()

    def apply(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """batch: (stream, number); a number of the stream already applied is skipped."""
        def build(manifest: dict) -> tuple[dict, dict]:
            new, routed, base = self.attempt(), self._routed(changes, manifest.get("horizon")), None
            if manifest.get("buckets"):
                # at most one value per bucket
                base = self._base(manifest, [r[0] for r in routed.select("bucket").distinct().collect()])
            if base is not None:
                routed = routed.unionByName(self._bucketed(base))
            # one shuffle, on which the merge groups and sorts; a hot key's bucket is many tasks
            placed = routed.withColumn("b", F.floor(F.col("seq") / self.block)).repartition("bucket", "b")
            merged = placed.groupBy("bucket", "b", "key", "seq").agg(F.min_by("state", "first").alias("state"), F.min("first").alias("first")).drop("b")
            wrote, schema = self._write(merged, new)
            buckets = manifest.get("buckets", {}) | {b: new for b in wrote}
            return {"buckets": buckets, "schema": schema, "horizon": manifest.get("horizon")}, {"buckets_written": sorted(map(int, wrote))}

        return self.commit(build, batch)

    def compact(self, horizon: int) -> dict:
        """Changes up to ``horizon`` become one row per existing key (its content then, and the seq that
        gave it); keys that did not exist then lose their rows. ``current`` stays as it is."""
        def build(manifest: dict) -> tuple[dict, dict]:
            base = self._base(manifest)
            if base is None:
                return {**manifest, "horizon": horizon}, {"buckets_written": []}
            old = present_state(base.where(F.col("seq") <= horizon).select("key", "seq", "state"), self.block)
            kept = base.where(F.col("seq") > horizon).select("key", "seq", "state", "first")
            # a folded row stands for what was delivered first: nothing can come before it
            rows = self._bucketed(kept.unionByName(old.withColumn("first", F.lit(None).cast(base.schema["first"].dataType))))
            new = self.attempt()
            wrote, schema = self._write(rows.withColumn("b", F.floor(F.col("seq") / self.block)).repartition("bucket", "b").drop("b"), new)
            return {"buckets": {b: new for b in wrote}, "schema": schema, "horizon": horizon}, {"buckets_written": sorted(map(int, wrote))}

        return self.commit(build)

    def log(self) -> DataFrame | None:
        """Distinct changes: key, seq, state; None before the first ``apply``."""
        number, manifest = self.manifest()
        if not number:
            return None
        base = self._base(manifest)
        return self.spark.createDataFrame([], T.StructType.fromJson(manifest["schema"])) if base is None else base.select("key", "seq", "state")

    def current(self) -> DataFrame | None:
        log = self.log()
        return None if log is None else present_state(log, self.block)

    def effects(self) -> DataFrame | None:
        """Each distinct change with its effect: applied, unchanged (content as it was) or
        void (removal of what did not exist)."""
        log = self.log()
        return None if log is None else change_effects(log, self.block)


def _blocks(log: DataFrame, block: int) -> DataFrame:
    """Rows with the previous state inside their (key, span); head marks the first of a span."""
    rows = log.withColumn("b", F.floor(F.col("seq") / block_width(log, "seq", block)).cast("long"))
    w = Window.partitionBy("key", "b").orderBy("seq")
    return rows.withColumn("prev", F.lag("state").over(w)).withColumn("head", F.row_number().over(w) == 1)


def present_state(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, seq of the change that produced the present content, state.

    Level one works inside (key, span): the last state and where its run began. Level
    two chains the few span summaries of a key: a span that is one run with the state
    the previous span ended in continues that run."""
    rows = _blocks(log, block)
    starts = F.col("head") | ~F.col("prev").eqNullSafe(F.col("state"))
    parts = rows.groupBy("key", "b").agg(
        F.max_by("state", "seq").alias("state"),
        F.max(F.when(starts, F.col("seq"))).alias("run"),
        F.min("seq").alias("lo"),
    )
    w = Window.partitionBy("key").orderBy("b")
    goes_on = F.coalesce((F.col("run") == F.col("lo")) & F.lag("state").over(w).eqNullSafe(F.col("state")), F.lit(False))
    out = (
        parts.withColumn("goes_on", goes_on)
        .groupBy("key")
        .agg(F.max_by("state", "b").alias("state"), F.max(F.when(~F.col("goes_on"), F.col("run"))).alias("seq"))
    )
    return out.where(~F.col("state.gone")).select("key", "seq", "state")


def change_effects(log: DataFrame, block: int = BLOCK) -> DataFrame:
    rows = _blocks(log, block)
    w = Window.partitionBy("key").orderBy("b")
    ends = rows.groupBy("key", "b").agg(F.max_by("state", "seq").alias("state")).withColumn("carry", F.lag("state").over(w)).select("key", "b", "carry")
    rows = rows.join(ends, ["key", "b"])
    before = F.when(F.col("head"), F.col("carry")).otherwise(F.col("prev"))
    effect = (
        F.when(F.col("state.gone") & (before.isNull() | before["gone"]), "void")
        .when(~F.col("state.gone") & before.eqNullSafe(F.col("state")), "unchanged")
        .otherwise("applied")
    )
    return rows.select("key", "seq", "state", effect.alias("effect"))
