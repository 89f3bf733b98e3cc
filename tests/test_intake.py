"""Batch intake from folders: manifest rules, file checks, outcomes, aborts, receipts."""

import hashlib
import json

from pyspark.sql import functions as F

from ledgerloom.sources import intake as I

HEAD = "supplier_number,name,country,currency,iban,vat_number,payment_terms_days,blocked,change_seq\n"


def row(n, name="A", currency="CHF", seq=1):
    return f'{n},"{name}",CH,{currency},,,30,false,{seq}\n'


def deliver(root, batch, files, count=None, sha=None, **more):
    folder = root / batch
    folder.mkdir()
    entries = []
    for name, text in files.items():
        raw = text.encode()
        (folder / name).write_bytes(raw)
        entries.append({"path": name, "dataset": "supplier", "encoding": "UTF-8", "sha256": sha or hashlib.sha256(raw).hexdigest(), "record_count": text.count("\n") - 1 if count is None else count})
    m = {"manifest_version": "1", "batch_id": batch, "mode": "upsert", "on_error": "continue", "files": entries} | more
    (folder / "manifest.json").write_text(json.dumps(m))


def outcomes(spark, root, live=None):
    return I.intake(*I.read_deliveries(spark, str(root)), live=live)


def test_outcomes_from_manifest_to_record(spark, tmp_path):
    deliver(tmp_path, "b1", {"a.csv": HEAD + row("1") + row("2", "multi\nline") + row("", "x") + row("3", currency="XXX"), "b.csv": HEAD + row("1") + row("1", "B")}, count=None)
    # the record with a line end in it makes one line more than records
    m = json.loads((tmp_path / "b1" / "manifest.json").read_text())
    m["files"][0]["record_count"] = 4
    (tmp_path / "b1" / "manifest.json").write_text(json.dumps(m))
    (tmp_path / "b1" / "stray.csv").write_text("x")
    (tmp_path / "b1" / "late.csv.part").write_text("x")
    deliver(tmp_path, "b2", {"a.csv": HEAD + row("1", "B") + row("9", currency="?")}, on_error="abort_batch")
    deliver(tmp_path, "b3", {"a.csv": HEAD + row("7")}, count=5)
    deliver(tmp_path, "b4", {"a.csv": HEAD + row("7")}, sha="0" * 64)
    deliver(tmp_path, "b5", {"a.csv": HEAD}, mode="replace_dataset")
    deliver(tmp_path, "b6", {"a.csv": HEAD + row("1", "B")})
    deliver(tmp_path, "b7", {"gone.csv": HEAD + row("1")})
    (tmp_path / "b7" / "gone.csv").unlink()
    done = outcomes(spark, tmp_path).cache()
    got = {(r.batch, r.path, r.ordinal): (r.outcome, r.code, r.field, r.line) for r in done.collect()}
    assert got == {
        ("b1", "a.csv", 1): ("accepted", None, None, 2), ("b1", "a.csv", 2): ("accepted", None, None, 3), ("b1", "a.csv", 3): ("rejected", "E_KEY_MISSING", "supplier_number", 5),
        ("b1", "a.csv", 4): ("rejected", "E_CURRENCY_UNKNOWN", "currency", 6), ("b1", "b.csv", 1): ("skipped_unchanged", None, None, 2), ("b1", "b.csv", 2): ("accepted", None, None, 3),
        ("b2", "a.csv", 1): ("rejected", "E_BATCH_ABORTED", None, 2), ("b2", "a.csv", 2): ("rejected", "E_CURRENCY_UNKNOWN", "currency", 3), ("b3", "a.csv", 1): ("rejected", "E_COUNT_MISMATCH", None, 2),
        ("b4", "a.csv", 0): ("rejected", "E_CHECKSUM_MISMATCH", None, 1), ("b5", None, 0): ("rejected", "E_MANIFEST_INVALID", None, 1), ("b6", "a.csv", 1): ("skipped_unchanged", None, None, 2), ("b7", "gone.csv", 0): ("rejected", "E_FILE_MISSING", None, 1),
    }
    status = {(r.batch, r.path): (r.seen, r.accepted, r.skipped_unchanged, r.rejected, r.status) for r in I.file_receipts(done).collect()}
    assert status["b1", "a.csv"] == (4, 2, 0, 2, "partial") and status["b1", "b.csv"] == (2, 1, 1, 0, "accepted") and status["b4", "a.csv"] == (0, 0, 0, 0, "rejected") and status["b2", "a.csv"][4] == "rejected"
    assert {r.natural_key for r in I.changed_keys(done).collect()} == {"1", "2"}
    assert [(r.batch, r.path) for r in I.foreign_files(*I.read_deliveries(spark, str(tmp_path))).collect()] == [("b1", "stray.csv")]
    manifests, files = I.read_deliveries(spark, str(tmp_path))
    frame = done.where("batch = 'b1' and path = 'b.csv' and ordinal = 2")
    assert frame.count() == 1
    none = I.intake(manifests.where("false"), files)
    assert none.count() == 0
    done.unpersist()


def test_live_content_decides_what_is_unchanged(spark, tmp_path):
    deliver(tmp_path, "b1", {"a.csv": HEAD + row("1") + row("2")})
    from ledgerloom.operators.record_split import framed

    recs = spark.createDataFrame([(1, "b", "f", 2, "supplier", row("1").strip())], "record_id long, batch_id string, file string, line long, dataset string, raw_text string")
    rcp = spark.createDataFrame([(1, "b", "f", ",", ".", None, None, HEAD.strip())], "receipt_id long, batch_id string, path string, delimiter string, decimal_separator string, thousands_separator string, date_format string, header_line string")
    live = framed(recs, rcp).select("dataset", F.lit("1").alias("natural_key"), I.content_of(F.col("cells")).alias("content"))
    assert {r.natural_key: r.outcome for r in outcomes(spark, tmp_path, live).collect()} == {"1": "skipped_unchanged", "2": "accepted"}


def test_a_faulty_file_aborts_its_batch(spark, tmp_path):
    deliver(tmp_path, "b1", {"a.csv": HEAD + row("1"), "b.csv": HEAD + row("2")}, on_error="abort_batch")
    (tmp_path / "b1" / "b.csv").unlink()
    assert {(r.path, r.outcome, r.code) for r in outcomes(spark, tmp_path).collect()} == {("a.csv", "rejected", "E_BATCH_ABORTED"), ("b.csv", "rejected", "E_FILE_MISSING")}


def test_manifest_rules_in_order(spark):
    good = {"manifest_version": "1", "batch_id": "b-1", "mode": "upsert", "on_error": "continue", "files": [{"path": "a.csv", "dataset": "supplier", "sha256": "a" * 64, "record_count": 0}]}
    entry = lambda **kw: {"files": [good["files"][0] | kw]}
    cases = [
        ({}, None), ({"manifest_version": "2", "batch_id": ""}, "manifest_version"), ({"batch_id": "a/b"}, "batch_id"), ({"run_id": "x y"}, "run_id"), ({"mode": "other"}, "mode"), ({"mode": "replace_dataset"}, "full_load"),
        ({"mode": "replace_dataset", "full_load": True}, None), ({"on_error": None}, "on_error"), ({"files": []}, "files"), (entry(path=" "), "path"), (entry(path="../x"), "path"), (entry(path="manifest.json"), "path"),
        ({"files": good["files"] * 2}, "duplicate"), (entry(record_count=None), "record_count"), (entry(record_count=-1), "record_count"), (entry(sha256="A" * 64), "sha256"), (entry(dataset="unknown"), "dataset"), (entry(encoding="EBCDIC"), "encoding"),
    ]
    df = spark.createDataFrame([(i, json.dumps(good | c)) for i, (c, _) in enumerate(cases)] + [(99, "no json")], "i int, t string")
    got = {r.i: r.f for r in df.select("i", I.manifest_fault(F.from_json("t", I.MANIFEST)).alias("f")).collect()}
    assert got == {i: f for i, (_, f) in enumerate(cases)} | {99: "manifest_version"}


def test_a_missing_manifest_waits_for_one_scan(spark):
    listing = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "batch string, has_manifest boolean")
    first = I.missing_manifests(listing, spark.createDataFrame([], "batch string, scans int"))
    assert {(r.batch, r.scans, r.status) for r in first.collect()} == {("b", 1, "waiting"), ("c", 1, "waiting")}
    again = I.missing_manifests(listing.where("batch <> 'c'"), first.select("batch", "scans"))
    assert {(r.batch, r.scans, r.status) for r in again.collect()} == {("b", 2, "rejected")}
