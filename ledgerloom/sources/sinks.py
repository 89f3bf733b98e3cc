"""Sinks: paged outbox, receipts with a marker, content-addressed raw store, positional export."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import dense_number
from ..session import SharedFiles


#: pages of one folder of an outbox
FOLDER = 1_000


def write_outbox(df: DataFrame, path: str, order: list[str], fmt: str = "json", page: int = 500) -> int:
    """Pages of ``page`` rows in key order, one file each, ``FOLDER`` of them a folder, then _DONE. fmt:
    csv, json, xml, parquet. Returns the number of pages. The marker comes last, so a reader that waits
    for it never sees half an outbox; a second write to the same path fails."""
    files = SharedFiles(df.sparkSession, path)
    numbered = dense_number(df, order, "_n").withColumn("page", F.floor((F.col("_n") - 1) / page).cast("int")).drop("_n")
    numbered = numbered.withColumn("folder", F.floor(F.col("page") / FOLDER).cast("int"))
    # a task writes whole folders page by page: rows are in page order and each file holds ``page`` rows
    w = numbered.repartition("folder").sortWithinPartitions("folder", "page", *order).write.partitionBy("folder").option("maxRecordsPerFile", page)
    if fmt == "xml":
        w.format("xml").option("rowTag", "record").save(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    n = numbered.agg(F.max("page")).first()[0]
    pages = 0 if n is None else n + 1
    files.commit_json("_DONE", {"pages": pages, "format": fmt})
    return pages


def write_receipt(records: DataFrame, path: str, key: str = "record_id") -> dict:
    """records.csv and rejects.csv, then receipt.json with the counts, then _DONE."""
    files = SharedFiles(records.sparkSession, path)
    out = records.select(key, "line", "outcome", "code")
    out.write.option("header", True).csv(f"{path}/records.csv")
    out.where("outcome = 'rejected'").write.option("header", True).csv(f"{path}/rejects.csv")
    counts = {r["outcome"] or "pending": r["count"] for r in out.groupBy("outcome").count().collect()}  # a closed set of outcomes
    files.commit_json("receipt.json", {"seen": sum(counts.values()), **counts})
    files.commit_json("_DONE", {})
    return counts


RAW = "sha256 string, content binary, prefix string"


def store_raw(files_df: DataFrame, path: str) -> DataFrame:
    """Adds (sha256, content) rows the store does not have yet; returns the whole store. files_df: content."""
    spark = files_df.sparkSession
    fresh = files_df.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    if SharedFiles(spark, path).names(""):
        fresh = fresh.join(spark.read.schema(RAW).parquet(path).select("sha256"), "sha256", "left_anti")
    fresh.withColumn("prefix", F.left("sha256", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(path)
    return spark.read.schema(RAW).parquet(path)


def sorted_union(rows: list[DataFrame]) -> DataFrame:
    """Rows of several shapes under the sorted union of their columns; what a shape lacks is null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return out.select(*sorted(out.columns))


def swiss_amount(v):
    """1'234.50 of a decimal column."""
    return F.translate(F.format_number(v, 2), ",", "'")


def export_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Text lines of the positional export with their sort key (supplier and invoice, then line
    number): docs(client, currency, supplier_number, invoice_number, gross, vat), lines(supplier_number, invoice_number, line_no,
    amount). Fields with a semicolon, quote or line end are quoted."""
    def q(c):
        return F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))

    e = F.lit("")
    zero = F.lit(None).cast("decimal(28,2)")
    head = docs.select(
        "supplier_number", "invoice_number", e.alias("line_no"), F.col("gross").cast("decimal(28,2)").alias("gross"), zero.alias("amount"),
        F.concat_ws(";", F.lit("KOPF"), q(F.col("invoice_number")), q(F.col("supplier_number")), F.lit("RE"), F.lit("010126"), F.lit("010126"), e, q(F.col("currency")), swiss_amount(F.col("gross")), swiss_amount(F.col("vat")), F.lit("V0"), F.lit("30"), e, e, e, e).alias("value"),
    )
    pos = lines.select(
        "supplier_number", "invoice_number", "line_no", zero.alias("gross"), F.col("amount").cast("decimal(28,2)").alias("amount"),
        F.concat_ws(";", F.lit("POS"), q(F.col("invoice_number")), F.col("line_no"), F.lit("4000"), e, F.lit("1.000"), F.lit("STK"), swiss_amount(F.col("amount")), swiss_amount(F.col("amount")), e, e).alias("value"),
    )
    return head.unionByName(pos)


def export_files(lines: DataFrame, path: str, header: str, rows_per_file: int = 40_000) -> None:
    """Writes export lines as files: header record, documents with their lines in key order, and the
    trailer with the counts and sums of what the file holds. A document is in one file."""
    files = max(1, -(-lines.count() // rows_per_file))
    body = lines.repartition(files, "supplier_number", "invoice_number").sortWithinPartitions("supplier_number", "invoice_number", "line_no").select("value", "gross", "amount")

    def framed(batches):
        heads = rows = 0
        gross = amounts = Decimal("0.00")
        for b in batches:
            if not heads and not rows:
                yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
            value, g, a = b.column(0), b.column(1), b.column(2)
            heads, rows = heads + len(g) - g.null_count, rows + len(a) - a.null_count
            gross, amounts = gross + (pc.sum(g).as_py() or 0), amounts + (pc.sum(a).as_py() or 0)
            yield pa.RecordBatch.from_arrays([value.cast(pa.string())], names=["value"])
        if heads or rows:
            swiss = lambda v: f"{v:,.2f}".replace(",", "'")
            yield pa.RecordBatch.from_arrays([pa.array([f"NACHLAUF;{heads};{rows};{swiss(gross)};{swiss(amounts)}"])], names=["value"])

    body.mapInArrow(framed, "value string").write.text(path)
