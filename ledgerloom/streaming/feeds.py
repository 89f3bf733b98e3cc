"""Incremental loads: file streams into the stores, watermarks, windows.

A micro-batch may run twice after a failure. Its number goes into the same manifest as its rows
(session.Versioned), so the second run finds it there and is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Versioned, shared_dir


def stream_into(source: DataFrame, apply, checkpoint: str, query: str = "feed") -> None:
    """Drains a streaming source: ``apply(df, batch=(query, number))`` per micro-batch, all that is
    available now. ``query`` names the stream in the store, which skips numbers it has."""
    def each(df: DataFrame, number: int) -> None:
        apply(df, batch=(query, number))

    q = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/query").queryName(query).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def file_stream(spark: SparkSession, path: str, like: DataFrame, per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


class DrainedLog(Versioned):
    """Rows drained from growing tables, and per dataset the mark up to which they are: one manifest
    publishes both, so a crash between the two is not possible."""

    def mark(self, dataset: str) -> int:
        return self.manifest()[1].get("marks", {}).get(dataset, 0)

    def drain(self, df: DataFrame, dataset: str, seq: str) -> int:
        """Appends the rows above the mark and moves it to the maximum of the whole collection. Returns
        the mark."""
        top = df.agg(F.max(seq)).first()[0]

        def build(manifest: dict) -> tuple[dict, dict]:
            marks, held, mark = manifest.get("marks", {}), manifest.get("held", {}), manifest.get("marks", {}).get(dataset, 0)
            if top is None or top <= mark:
                return {"marks": marks, "held": held}, {"mark": mark}
            new = self.attempt()
            df.where((F.col(seq) > mark) & (F.col(seq) <= top)).write.parquet(f"{self.path}/rows/{new}")
            return {"marks": marks | {dataset: top}, "held": held | {dataset: [*held.get(dataset, []), new]}}, {"mark": top}

        return self.commit(build)["mark"]

    def rows(self, dataset: str, schema) -> DataFrame:
        dirs = [f"{self.path}/rows/{a}" for a in self.manifest()[1].get("held", {}).get(dataset, [])]
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)


def windowed_counts(events: DataFrame, time: str, by: str, length: str, late: str) -> DataFrame:
    """Tumbling event-time counts; works on a stream (rows later than ``late`` are dropped by the
    watermark) and on a table (nothing is late)."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def deduplicated(messages: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """First copy of each identifier within the watermark; state older than it is dropped."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def collect_stream(df: DataFrame, schema: str, mode: str = "append") -> DataFrame:
    """A stream run to its end into a table in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, "stream")
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-check").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(path)
