"""Messages delivered more than once: a partitioned store that keeps one row per message.

Layout below the store's folder (``a`` is one attempt to write, see session.Versioned)::

    rows/attempt=a/kept=1/part=p<period>/*.parquet   winners that arrived in the period
    rows/attempt=a/kept=0/part=p<period>/*.parquet   rows that lost in that commit
    index/attempt=a/bucket=<b>/*.parquet             (hash of an identifier, part of a row kept for it)
    _manifests/<commit>.json                    the valid attempt of each part, those of each bucket

``ingest`` reads only the index buckets its identifiers fall in, looks them up, reads only the
historical partitions that hold one, combines both, recomputes one winner per identifier and
replaces just those partitions. The index grows by the winners among the arriving rows, so a batch
writes and reads in proportion to itself; entries of rows that lost later only cost a look. Readers
follow the manifest, which is published by one rename: they see all of a commit or nothing.

Defined results: a message is the trimmed, non-null identifier, compared exactly; an
identifier of white space only is the empty identifier, one message of its own. The
winner is the row with the smallest ``order`` columns, nulls last, then the smallest
row id. Rows without an identifier are kept and never surplus. A row id stands for one row: of
rows that repeat one, in a batch or in the store, one is kept. A batch given again with its number is
skipped. Extra columns pass through; names starting with ``_msg_`` and the names ``attempt``,
``kept``, ``part`` and ``bucket`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_ws
from ..session import Versioned, written

DELTAS = 16


def winner_order(order: list[str], row_id: str) -> Column:
    """A comparable struct: nulls last in each order column, ties by the row id."""
    parts: list[Column] = []
    for i, c in enumerate(order):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*parts, F.col(row_id).alias("id"))


def winner_ids(rows: DataFrame, key: str, order: list[str], row_id: str) -> DataFrame:
    """Ids of one row per key. A minimum over structs combines before the shuffle, so a
    key with any share of the rows sends one row per task and no task holds its group."""
    return rows.groupBy(key).agg(F.min(winner_order(order, row_id)).alias("_msg_w")).select(F.col("_msg_w.id").alias(row_id))


class MessageStore(Versioned):
    def __init__(self, spark: SparkSession, path: str, *, key: str, row_id: str, order: list[str], period: Column, buckets: int = 64, deltas: int = DELTAS):
        """period: maps a row to its partition, by values of the row alone; it should have few values
        (months, days). buckets: of the identifier index; about a million identifiers each are good.
        deltas: index files of a bucket that are merged into one."""
        super().__init__(spark, path)
        self.key, self.row_id, self.order, self.period, self.buckets, self.deltas = key, row_id, order, period, buckets, deltas

    # -- reading -------------------------------------------------------------
    def _rows(self, kept: int, places: list[tuple[str, str]]) -> DataFrame | None:
        """places: (attempt, part)."""
        dirs = [f"{self.path}/rows/{a}/kept={kept}/part={p}" for a, p in sorted(places)]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*dirs).drop("attempt", "kept") if dirs else None

    def _kept(self, manifest: dict, parts: list[str] | None = None) -> DataFrame | None:
        return self._rows(1, [(a, p) for p, a in manifest.get("parts", {}).items() if parts is None or p in parts])

    def _lost(self, manifest: dict, parts: list[str] | None = None) -> DataFrame | None:
        return self._rows(0, [(a, p) for a, held in manifest.get("surplus", {}).items() for p in held if parts is None or p in parts])

    def _index(self, manifest: dict, buckets: list[int]) -> DataFrame | None:
        dirs = [f"{self.path}/index/{a}/bucket={b}" for b in sorted(buckets) for a in manifest.get("index", {}).get(str(b), [])]
        return self.spark.read.option("basePath", f"{self.path}/index").schema("h bigint, part string, attempt string, bucket int").parquet(*dirs).drop("attempt") if dirs else None

    def messages(self) -> DataFrame | None:
        """The kept rows, one per message, with all columns; None before the first batch."""
        return self._public(self._kept)

    def surplus(self) -> DataFrame | None:
        """Rows that are not kept, of all commits; None before the first batch."""
        return self._public(self._lost)

    def _public(self, read) -> DataFrame | None:
        _, m = self.manifest()
        df = read(m)
        if df is None:
            return self.spark.createDataFrame([], T.StructType.fromJson(m["schema"])) if "schema" in m else None
        return df.drop("part", "_msg_key", "_msg_new")

    # -- writing -------------------------------------------------------------
    def ingest(self, incoming: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """batch: (stream, number); a number of the stream already applied is skipped."""
        rows = incoming.withColumn("_msg_key", trim_ws(F.col(self.key))).withColumn("part", F.concat(F.lit("p"), F.coalesce(self.period, F.lit(""))))
        return self.commit(lambda m: self._build(incoming, rows, m), batch)

    def _hashed(self, rows: DataFrame, *more: str) -> DataFrame:
        h = rows.where("_msg_key is not null").select(F.xxhash64("_msg_key").alias("h"), *more)
        return h.withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int"))

    def _unrepeated(self, rows: DataFrame, history: DataFrame | None, lost: DataFrame | None) -> DataFrame:
        """The arriving rows whose id is neither stored nor given twice. A stored copy has the same
        period, so it lies in the parts that are read anyway. Ids only are compared; the rows move
        only where some are repeated."""
        ids = rows.select(self.row_id)
        again = ids.groupBy(self.row_id).agg(F.count("*").alias("n")).where("n > 1").select(self.row_id, F.lit(False).alias("stored"))
        for held in (history, lost):
            if held is not None:
                again = again.unionByName(ids.join(held.select(self.row_id), self.row_id, "left_semi").select(self.row_id, F.lit(True).alias("stored")))
        again = again.groupBy(self.row_id).agg(F.max("stored").alias("stored"))
        if again.isEmpty():
            return rows
        again = written(again, "repeated-ids")
        once = rows.join(again.where("not stored"), self.row_id, "left_semi").dropDuplicates([self.row_id])
        return rows.join(again, self.row_id, "left_anti").unionByName(once)

    def _build(self, incoming: DataFrame, rows: DataFrame, manifest: dict) -> tuple[dict, dict]:
        new = self.attempt()
        bucket = F.pmod(F.xxhash64("_msg_key"), F.lit(self.buckets)).cast("int")
        # one row per part and bucket at most: bounded by their numbers, not by the rows
        met = rows.select("part", F.when(F.col("_msg_key").isNotNull(), bucket).alias("b")).distinct().collect()
        own, looked = sorted({r[0] for r in met}), sorted({r[1] for r in met if r[1] is not None})
        affected = set(own)
        index = self._index(manifest, looked)
        if index is not None:
            arriving = self._hashed(rows).distinct()
            affected |= {r[0] for r in index.join(arriving, ["h", "bucket"], "left_semi").select("part").distinct().collect()}
        history = self._kept(manifest, sorted(affected))
        rows = self._unrepeated(rows, history, self._lost(manifest, own))
        both = rows.withColumn("_msg_new", F.lit(True))
        if history is not None:
            both = history.withColumn("_msg_new", F.lit(False)).unionByName(both)

        # decided on narrow columns and joined by the unique row id, never by the message key
        narrow = both.where("_msg_key is not null").select("_msg_key", self.row_id, *self.order)
        winners = winner_ids(narrow, "_msg_key", self.order, self.row_id).withColumn("_msg_won", F.lit(True))
        tagged = both.join(winners, self.row_id, "left")
        tagged = tagged.withColumn("kept", F.when(F.col("_msg_key").isNull() | F.col("_msg_won"), 1).otherwise(0)).drop("_msg_won")
        # AQE sizes the files of each partition, splitting large and joining small ones
        tagged.hint("rebalance", "kept", "part").write.partitionBy("kept", "part").parquet(f"{self.path}/rows/{new}")
        at = {k: [n[5:] for n in self.files.names(f"rows/{new}/kept={k}") if n.startswith("part=")] for k in (0, 1)}

        index = {b: list(a) for b, a in manifest.get("index", {}).items()}
        fresh = self._rows(1, [(new, p) for p in at[1]])
        if fresh is not None:
            entries = self._hashed(fresh.where("_msg_new"), "part").distinct()
            full = [int(b) for b, a in index.items() if len(a) >= self.deltas]
            old = self._index(manifest, full)
            if old is not None:
                entries = entries.unionByName(old.select("h", "part", "bucket")).distinct()
            entries.repartition("bucket").sortWithinPartitions("bucket", "h").write.partitionBy("bucket").parquet(f"{self.path}/index/{new}")
            for n in self.files.names(f"index/{new}"):
                if n.startswith("bucket="):
                    index[n[7:]] = [new] if int(n[7:]) in full else [*index.get(n[7:], []), new]

        parts = {p: a for p, a in manifest.get("parts", {}).items() if p not in affected} | {p: new for p in at[1]}
        surplus = manifest.get("surplus", {}) | ({new: at[0]} if at[0] else {})
        content = {"parts": parts, "index": index, "surplus": surplus, "schema": incoming.schema.jsonValue()}
        return content, {"read_partitions": sorted(affected), "written_partitions": sorted(at[1]), "read_buckets": looked}


def arrival_waves(df: DataFrame, at: str, waves: int = 2) -> list[DataFrame]:
    """Split by arrival time into ``waves`` spans of equal length; rows without a time come first.
    Replays a delivered log as history plus increments; every row is in exactly one wave."""
    if waves < 2:
        return [df]
    lo, hi = df.select(F.unix_micros(F.min(at).cast("timestamp")), F.unix_micros(F.max(at).cast("timestamp"))).first()
    if lo is None or hi == lo:
        return [df]
    t = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = [lo + (hi - lo) * i // waves for i in range(1, waves)]
    out = [df.where(t.isNull() | (t < cuts[0]))]
    for a, b in zip(cuts, [*cuts[1:], None]):
        out.append(df.where((t >= a) if b is None else (t >= a) & (t < b)))
    return out
