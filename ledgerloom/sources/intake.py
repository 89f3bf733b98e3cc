"""Batch intake: from the manifest to one outcome per record, nothing written before all is checked.

1. A batch is a folder with ``manifest.json`` and the files it declares. The manifest's own rules
   come first (``manifest_fault``), then each file's presence, SHA-256 and record count.
2. The files that pass are parsed; their records are framed and validated (operators.record_split).
3. Every record gets an outcome: a fault of its batch or file, its own first finding, the abort of
   its batch, or, if it is clean, ``accepted`` or ``skipped_unchanged`` against the content that its
   key had before it, in the order of batch, file and record. A fault of one file aborts a batch as a
   rejected record does.

Defined results: files are taken in the order of batch and path. A file with a fault gives its
records that code and applies none; a file that is missing or cannot be decoded has one row with
ordinal 0. An undeclared file is not read (``foreign_files`` names it). A batch given twice is the
caller's to refuse (its manifest's hash tells). A record that cannot be framed has no natural key. Columns of a manifest that are not known are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNIT_SEPARATOR, trim_ws
from ..operators.ordered import dense_number, previous_row
from ..operators.record_split import HEADERS, framed, rejects, unquoted
from ..session import written
from .files import ENCODINGS, csv_scan, decode

FILE = "path string, dataset string, encoding string, delimiter string, decimal_separator string, thousands_separator string, date_format string, sha256 string, record_count bigint"
MANIFEST = f"manifest_version string, batch_id string, run_id string, mode string, full_load boolean, on_error string, files array<struct<{', '.join(c.replace(' ', ':') for c in FILE.split(', '))}>>"
#: natural key of a dataset
KEYS = {"supplier": ["supplier_number"], "purchase_order_line": ["po_number", "line_no"], "fx_rate": ["base", "quote", "valid_from", "rate_type"]}
#: records of a file are numbered below this
FILE_RECORDS = 1 << 32


def read_deliveries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifests(batch, manifest), files(batch, path, content)) of the folders below root, without those
    and the files that are hidden or unfinished (.x, _x, *.tmp, *.part)."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.split("path", "/")
    d = d.select(F.element_at(at, -2).alias("batch"), F.element_at(at, -1).alias("path"), "content")
    d = d.where(~F.col("batch").rlike(r"^[._]|\.(tmp|part)$") & ~F.col("path").rlike(r"^[._]|\.(tmp|part)$"))
    manifests = d.where("path = 'manifest.json'").select("batch", F.decode("content", "UTF-8").alias("manifest"))
    return manifests, d.where("path <> 'manifest.json'")


def manifest_fault(m: Column) -> Column:
    """The first rule a manifest breaks, null if none."""
    safe = lambda c: c.rlike("^[A-Za-z0-9._-]{1,128}$")
    any_file = lambda f: F.exists(m["files"], f)
    no = lambda c: F.coalesce(~c, F.lit(True))
    path = lambda f: F.coalesce(trim_ws(f["path"]), F.lit(""))
    return (
        F.when(m.isNull(), "manifest").when(no(m["manifest_version"] == "1"), "manifest_version").when(no(safe(m["batch_id"])), "batch_id")
        .when(m["run_id"].isNotNull() & (m["run_id"] != "") & ~safe(m["run_id"]), "run_id")
        .when(no(m["mode"].isin("upsert", "replace_dataset")), "mode").when((m["mode"] == "replace_dataset") & no(m["full_load"]), "full_load")
        .when(no(m["on_error"].isin("continue", "abort_batch")), "on_error").when(F.coalesce(F.size(m["files"]), F.lit(0)) <= 0, "files")
        .when(any_file(lambda f: (path(f) == "") | path(f).rlike(r"[/\\]|^\.{1,2}$|^manifest\.json$")), "path")
        .when(F.size(F.array_distinct(F.transform(m["files"], path))) < F.size(m["files"]), "duplicate")
        .when(any_file(lambda f: no(f["record_count"] >= 0)), "record_count").when(any_file(lambda f: no(f["sha256"].rlike("^[0-9a-f]{64}$"))), "sha256")
        .when(any_file(lambda f: (f["dataset"] != "") & ~f["dataset"].isin(*HEADERS)), "dataset").when(any_file(lambda f: ~F.coalesce(f["encoding"], F.lit("UTF-8")).isin(*ENCODINGS)), "encoding")
    )


def staged(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """One row per declared file: batch, on_error, the entry's columns, fault, content (null with a fault);
    a batch whose manifest is broken is one row with path null."""
    m = manifests.select("batch", F.from_json("manifest", MANIFEST).alias("m")).withColumn("bad", manifest_fault(F.col("m")))
    broken = m.where("bad is not null").select("batch", F.lit("continue").alias("on_error"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in FILE.split(", ")], F.lit("E_MANIFEST_INVALID").alias("fault"), F.lit(None).cast("binary").alias("content"))
    f = m.where("bad is null").select("batch", F.col("m.on_error").alias("on_error"), F.explode("m.files").alias("f")).select("batch", "on_error", "f.*")
    j = f.join(files.select("batch", "path", "content"), ["batch", "path"], "left")
    fault = F.when(F.col("content").isNull(), "E_FILE_MISSING").when(F.sha2("content", 256) != F.col("sha256"), "E_CHECKSUM_MISMATCH")
    j = j.withColumn("fault", fault).withColumn("content", F.when(F.col("fault").isNull(), F.col("content")))
    return j.select(*broken.columns).unionByName(broken)


def foreign_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a batch folder that its manifest does not declare."""
    declared = manifests.select("batch", F.explode(F.from_json("manifest", MANIFEST)["files"]["path"]).alias("path"))
    return files.select("batch", "path").join(declared, ["batch", "path"], "left_anti")


def missing_manifests(listing: DataFrame, before: DataFrame) -> DataFrame:
    """listing(batch, has_manifest), before(batch, scans) -> batch, scans, status: a folder without a
    manifest waits for one scan (it may be in transfer) and is rejected by the second."""
    n = F.coalesce("scans", F.lit(0)) + 1
    return listing.where("not has_manifest").join(before, "batch", "left").select("batch", n.alias("scans"), F.when(n >= 2, "rejected").otherwise("waiting").alias("status"))


_RAW = "n bigint, header_line string, line bigint, ordinal bigint, raw_text string, fault string"


def _split(batches):
    """(file number, header, line, ordinal, raw text, fault) per record; a file is one task's work."""
    for b in batches:
        rows: list[tuple] = []
        for n, content, encoding, delimiter in zip(*(b.column(i).to_pylist() for i in range(4))):
            text, broken = decode(content, encoding or "UTF-8")
            if broken is not None:
                rows.append((n, None, broken, 0, None, "E_ENCODING"))
                continue
            found = [(line, text[lo:hi]) for line, fields, lo, hi in csv_scan(text, delimiter or ",") if fields != [""]]
            if not found:
                rows.append((n, None, 1, 0, None, "E_MALFORMED_DOCUMENT"))
                continue
            rows += [(n, found[0][1], line, k, raw, None) for k, (line, raw) in enumerate(found[1:], 1)] or [(n, found[0][1], 1, 0, None, None)]
        for lo in range(0, len(rows), 10_000):
            cols = list(zip(*rows[lo : lo + 10_000]))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in _RAW.split(", ")])


def intake(manifests: DataFrame, files: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """batch, path, line, ordinal, dataset, natural_key, outcome (accepted, skipped_unchanged, rejected),
    code, field. live(dataset, natural_key, content): what the keys hold before, content as
    ``content_of`` gives it."""
    entries = dense_number(staged(manifests, files), ["batch", "path"], "n")  # written once: all that follows reads it
    raw = entries.where("fault is null").select("n", "content", "encoding", "delimiter").mapInArrow(_split, _RAW)
    raw = written(raw, "intake-records")
    counted = raw.groupBy("n").agg(F.count(F.when(F.col("ordinal") > 0, 1)).alias("parsed"), F.max("fault").alias("unread"))
    e = entries.drop("content").join(counted, "n", "left")
    fault = F.coalesce("fault", "unread", F.when(F.col("parsed") != F.col("record_count"), "E_COUNT_MISMATCH"))
    e = e.withColumn("fault", fault).drop("unread", "parsed", "sha256", "record_count", "encoding")

    rid = (F.col("n") * FILE_RECORDS + F.col("ordinal")).alias("record_id")
    r = raw.where("ordinal > 0").join(e.select("n", "batch", "path", "dataset"), "n")
    records = r.select(rid, F.col("batch").alias("batch_id"), F.col("path").alias("file"), "line", "dataset", "raw_text")
    heads = raw.groupBy("n").agg(F.max("header_line").alias("header_line"))
    receipts = e.join(heads, "n").select(F.col("n").alias("receipt_id"), F.col("batch").alias("batch_id"), "path", "delimiter", "decimal_separator", "thousands_separator", "date_format", "header_line")
    frames = written(framed(records, receipts), "intake-frames")
    found = rejects(frames).select("record_id", "code", "field", F.col("reason").isin("quoting", "column_count").alias("unframed"))

    keyed = frames.select("record_id", "dataset", natural_key(F.col("dataset"), F.col("cells")).alias("natural_key"), content_of(F.col("cells")).alias("content"))
    d = r.select(rid, "n", "line", "ordinal").join(keyed, "record_id", "left").join(found, "record_id", "left")
    d = d.join(e.select("n", "batch", "path", "on_error", "fault"), "n").withColumn("natural_key", F.when(~F.coalesce("unframed", F.lit(False)), F.col("natural_key")))
    d = d.withColumn("code", F.coalesce("fault", "code")).withColumn("field", F.when(F.col("fault").isNull(), F.col("field")))
    d = written(d, "intake-judged")
    rejected = d.select("batch", "on_error", "code").unionByName(e.select("batch", "on_error", F.col("fault").alias("code")))
    aborted = rejected.where("on_error = 'abort_batch' and code is not null").select("batch").distinct().withColumn("aborted", F.lit("E_BATCH_ABORTED"))
    d = d.join(aborted, "batch", "left").withColumn("code", F.coalesce("code", "aborted"))
    clean = d.where("code is null").select("record_id", "dataset", "natural_key", "content")
    p = previous_row(clean, ["dataset", "natural_key"], "record_id", F.col("content"), "p", block=1000 * FILE_RECORDS)
    if live is not None:
        p = p.join(live.select("dataset", "natural_key", F.col("content").alias("held")), ["dataset", "natural_key"], "left")
    old = F.coalesce("p.v", "held") if live is not None else F.col("p.v")
    same = p.select("record_id", F.coalesce(old == F.col("content"), F.lit(False)).alias("same"))
    out = d.join(same, "record_id", "left")
    outcome = F.when(F.col("code").isNotNull(), "rejected").when(F.col("same"), "skipped_unchanged").otherwise("accepted")
    cols = ["batch", "path", "line", "ordinal", "dataset", "natural_key", "outcome", "code", "field"]
    done = out.select(*[outcome.alias("outcome") if c == "outcome" else F.col(c) for c in cols])
    none = e.where("fault is not null").join(r.select("n").distinct(), "n", "left_anti")
    empty = none.select("batch", "path", F.lit(1).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("ordinal"), "dataset", F.lit(None).cast("string").alias("natural_key"), F.lit("rejected").alias("outcome"), F.col("fault").alias("code"), F.lit(None).cast("string").alias("field"))
    return done.unionByName(empty)


def _value(cells: Column, name: str) -> Column:
    return trim_ws(unquoted(F.get(F.filter(cells, lambda c: c["name"] == name), F.lit(0))["raw"]))


def natural_key(dataset: Column, cells: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, parts in KEYS.items():
        out = F.when(dataset == name, F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(_value(cells, p), F.lit("")) for p in parts])).otherwise(out)
    return out


def content_of(cells: Column) -> Column:
    """SHA-256 of the trimmed values with their columns' names, by name."""
    return F.sha2(F.array_join(F.array_sort(F.transform(cells, lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.lit("="), trim_ws(unquoted(c["raw"]))))), UNIT_SEPARATOR), 256)


def file_receipts(outcomes: DataFrame) -> DataFrame:
    """Per file: seen and each outcome counted, and its status."""
    n = lambda o: F.count(F.when((F.col("outcome") == o) & (F.col("ordinal") > 0), 1)).alias(o)
    g = outcomes.groupBy("batch", "path").agg(F.count(F.when(F.col("ordinal") > 0, 1)).alias("seen"), n("accepted"), n("skipped_unchanged"), n("rejected"), F.count(F.when(F.col("ordinal") == 0, 1)).alias("void"))
    return g.withColumn("status", F.when((F.col("void") > 0) | ((F.col("rejected") > 0) & (F.col("rejected") == F.col("seen"))), "rejected").when(F.col("rejected") > 0, "partial").otherwise("accepted")).drop("void")


def changed_keys(outcomes: DataFrame) -> DataFrame:
    """Keys whose content an accepted record changed; a line changes its order as well."""
    k = outcomes.where("outcome = 'accepted'").select("dataset", "natural_key").distinct()
    orders = k.where("dataset = 'purchase_order_line'").select(F.lit("purchase_order").alias("dataset"), F.substring_index("natural_key", UNIT_SEPARATOR, 1).alias("natural_key"))
    return k.unionByName(orders).distinct()
