"""Delivered files to records, with a row for everything that cannot be read.

Every reader returns file, line (first physical line), ordinal (from 1), fields
map<string,string>, code (null for a good record). Text formats that end a record with
a line end are split by Spark across tasks (NDJSON); formats with state across lines
(CSV with quoted line ends, JSON arrays, XML, the positional export) are one file per
task in Arrow batches, so a file is bounded by a task's memory and files are many.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import running

RECORDS = "file string, line bigint, ordinal bigint, fields map<string,string>, code string"
_ARROW = pa.schema([("file", pa.string()), ("line", pa.int64()), ("ordinal", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("code", pa.string())])
#: Names of the declared encodings and their codecs.
ENCODINGS = {"UTF-8": "utf-8", "UTF-8-BOM": "utf-8-sig", "ISO-8859-1": "latin-1", "windows-1252": "cp1252"}

Record = tuple[int, int, dict[str, str | None] | None, str | None]


def decode(raw: bytes, encoding: str) -> tuple[str, int | None]:
    """(text, line of the first byte the encoding does not have); never replaces silently."""
    codec = ENCODINGS.get(encoding or "UTF-8")
    if codec is None:
        return "", 1
    try:
        return raw.decode(codec), None
    except UnicodeDecodeError as e:
        return raw[: e.start].decode(codec, "ignore"), raw.count(b"\n", 0, e.start) + 1


def csv_fields(text: str, delimiter: str, quote: str = '"') -> Iterator[tuple[int, list[str] | None]]:
    """(first line, fields) per record; None for a record whose quoting is broken."""
    for first, fields, _, _ in csv_scan(text, delimiter, quote):
        yield first, fields


def csv_scan(text: str, delimiter: str, quote: str = '"') -> Iterator[tuple[int, list[str] | None, int, int]]:
    """(first line, fields or None, start, end) per record, without its line end. Line ends inside
    quotes are data. After a broken quote the rest of its line is skipped."""
    i, n, line, twice = 0, len(text), 1, quote * 2
    while i < n:
        first, fields, bad, begin = line, [], False, i
        while True:
            if i < n and text[i] == quote:
                j = i + 1
                while True:
                    j = text.find(quote, j)
                    if j < 0 or text[j : j + 2] != twice:
                        break
                    j += 2
                after = text[j + 1 : j + 2] if j >= 0 else ""
                if j < 0 or after not in (delimiter, "\n", "\r", ""):
                    bad = True
                    j = text.find("\n", i)
                    j = n if j < 0 else j
                    i = j
                else:
                    fields.append(text[i + 1 : j].replace(twice, quote))
                    line += text.count("\n", i, j)
                    i = j + 1
            else:
                stops = [k for k in (text.find(delimiter, i), text.find("\n", i)) if k >= 0]
                j = min(stops, default=n)
                fields.append(text[i:j].rstrip("\r") if j == n or text[j] == "\n" else text[i:j])
                i = j
            if not bad and i < n and text[i] == delimiter:
                i += 1
                continue
            stop = i
            if text[i : i + 2] == "\r\n":
                i += 1
            i += 1
            line += 1
            break
        yield first, None if bad else fields, begin, stop


def csv_records(text: str, delimiter: str = ",", quote: str = '"', trim: str = "both", null_token: str | None = None) -> Iterator[Record]:
    """trim: both, left, right or none; a trimmed value equal to null_token is null. A dialect that is none
    (delimiter and quote of one character each, and different) is one finding for the file."""
    if len(delimiter) != 1 or len(quote) != 1 or delimiter == quote or trim not in _TRIM:
        yield 1, 0, None, "E_FIELD_INVALID"
        return
    rows = csv_fields(text, delimiter, quote)
    head = next(rows, None)
    if head is None or head[1] is None:
        yield 1, 0, None, "E_MALFORMED_DOCUMENT"
        return
    names = [h.strip() for h in head[1]]
    if len(set(names)) < len(names) or "" in names:
        yield 1, 0, None, "E_FIELD_INVALID"
        return
    k, strip = 0, _TRIM[trim]
    for line, values in rows:
        if values == [""]:
            continue  # a blank line is no record, in a file of one column either
        k += 1
        if values is None:
            yield line, k, None, "E_MALFORMED_DOCUMENT"
        elif len(values) != len(names):
            yield line, k, None, "E_FIELD_INVALID"
        else:
            yield line, k, {a: None if (v := strip(b)) == null_token else v for a, b in zip(names, values)}, None


_TRIM: dict[str, Callable[[str], str]] = {"both": str.strip, "left": str.lstrip, "right": str.rstrip, "none": str}


def _flat(value, prefix: str = "") -> dict[str, str | None]:
    """Nested JSON or XML values as path -> text; numbers keep the digits they were written with."""
    if isinstance(value, dict):
        out: dict[str, str | None] = {}
        for k, v in value.items():
            out |= _flat(v, f"{prefix}.{k}" if prefix else k)
        return out
    if isinstance(value, list):
        out = {}
        for i, v in enumerate(value):
            out |= _flat(v, f"{prefix}[{i}]")
        return out
    if isinstance(value, bool):
        return {prefix: "true" if value else "false"}
    return {prefix: None if value is None else str(value)}


def json_records(text: str) -> Iterator[Record]:
    """An array, or an object with ``records``; any break spoils the file."""
    try:
        doc = json.loads(text, parse_float=str, parse_int=str)
    except ValueError as e:
        yield getattr(e, "lineno", 1), 0, None, "E_MALFORMED_DOCUMENT"
        return
    items = doc.get("records") if isinstance(doc, dict) else doc
    if not isinstance(items, list):
        yield 1, 0, None, "E_MALFORMED_DOCUMENT"
        return
    for k, r in enumerate(items, 1):
        yield 1, k, _flat(r) if isinstance(r, dict) else None, None if isinstance(r, dict) else "E_MALFORMED_DOCUMENT"


def ndjson_records(text: str) -> Iterator[Record]:
    """One value a line; a bad line is a reject and does not stop the file. A line that is an object with
    ``records`` gives each of them, all with its line number."""
    k = 0
    for line, raw in enumerate(text.split("\n"), 1):
        if raw.strip():
            for fields, code in json_line(raw):
                k += 1
                yield line, k, fields, code


def json_line(raw: str) -> list[tuple[dict[str, str | None] | None, str | None]]:
    try:
        doc = json.loads(raw, parse_float=str, parse_int=str)
    except ValueError:
        return [(None, "E_MALFORMED_DOCUMENT")]
    items = doc["records"] if isinstance(doc, dict) and isinstance(doc.get("records"), list) else [doc]
    return [(_flat(x), None) if isinstance(x, dict) else (None, "E_MALFORMED_DOCUMENT") for x in items]


def xml_records(text: str, row: str | None = None) -> Iterator[Record]:
    """Children of any root, one record each; or, with ``row``, every element of that name at any depth.
    A break voids the file: what came before it may hang on the wrong parent. Names lose their
    namespace; an element with ``nil`` is null."""
    depth, inside, found = 0, 0, []
    parser = ElementTree.XMLPullParser(["start", "end"])
    try:
        for lo in range(0, len(text), 1 << 16):
            parser.feed(text[lo : lo + (1 << 16)])
            for kind, el in parser.read_events():
                mine = depth - (kind == "end") == 1 if row is None else _local(el.tag) == row
                depth += 1 if kind == "start" else -1
                if mine and kind == "start":
                    inside += 1
                elif mine:
                    inside -= 1
                    found.append(_flat(_element(el)))
                if kind == "end" and not inside:
                    el.clear()
        parser.close()
    except ElementTree.ParseError as e:
        yield e.position[0], len(found) + 1, None, "E_MALFORMED_DOCUMENT"
        return
    for k, fields in enumerate(found, 1):
        yield 0, k, fields, None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _element(el):
    if any(_local(a) == "nil" and v in ("true", "1") for a, v in el.attrib.items()):
        return None
    if not len(el):
        return (el.text or "").strip()
    out: dict = {}
    for c in el:
        v, name = _element(c), _local(c.tag)
        out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), v] if name in out else v
    return out


#: Record names of the positional export and their fields.
EXPORT = {
    "VORLAUF": "type version client created currency sender receiver test".split(),
    "KOPF": "type invoice_number supplier_number document_type document_date receipt_date po_number currency gross_amount vat_amount vat_code payment_terms_days discount_raw discount_days cost_center text".split(),
    "POS": "type invoice_number line_no gl_account cost_center quantity uom unit_price line_amount tax_code text".split(),
    "NACHLAUF": "type count_headers count_lines sum_gross sum_lines".split(),
}


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def export_records(text: str) -> Iterator[Record]:
    """Header, documents, their lines, trailer. A line belongs to the header before it and takes its
    number as ``parent``; an empty currency is the file's, an empty tax code the header's; an
    empty cost center stays empty. Broken quoting, a byte order mark or a control character voids the
    file."""
    fault = "E_ENCODING_BOM_PRESENT" if text.startswith("\ufeff") else "E_ENCODING" if (bad := _CONTROL.search(text)) else None
    if fault:
        yield 1 if text.startswith("\ufeff") else text.count("\n", 0, bad.start()) + 1, 0, None, fault
        return
    torn = next((line for line, values in csv_fields(text, ";") if values is None), None)
    if torn is not None:
        yield torn, 0, None, "E_MALFORMED_DOCUMENT"
        return
    k, parent, currency, vat_code, closed = 0, None, None, None, False
    for line, values in csv_fields(text, ";"):
        if values == [""]:
            continue
        k += 1
        kind = values[0] if values else None
        names = EXPORT.get(kind) if values else None
        if values is None or names is None or len(values) != len(names) or closed or (k == 1) != (kind == "VORLAUF"):
            yield line, k, None, "E_MALFORMED_DOCUMENT"
            continue
        row: dict[str, str | None] = dict(zip(names, (v.strip() for v in values)))
        code = None
        if kind == "VORLAUF":
            currency = row["currency"]
        elif kind == "KOPF":
            parent, vat_code = k, row["vat_code"]
            row["currency"] = row["currency"] or currency
            row["vat_amount"] = row["vat_amount"] or "0.00"
        elif kind == "POS":
            row["tax_code"] = row["tax_code"] or vat_code
            row["parent"] = str(parent) if parent else None
            code = None if parent else "orphan_line"
        else:
            closed = True
        yield line, k, row, code


READERS: dict[str, Callable] = {"csv": csv_records, "json": json_records, "ndjson": ndjson_records, "xml": xml_records, "export": export_records}
#: Media types of a delivery and their readers.
MEDIA_TYPES = {"text/csv": "csv", "application/json": "json", "application/x-ndjson": "ndjson", "application/xml": "xml"}


def detect(head: str) -> str:
    """Format from the first characters of a file."""
    h = head.lstrip("\ufeff \t\r\n")
    if h.startswith("VORLAUF;"):
        return "export"
    if h.startswith("<"):
        return "xml"
    if h.startswith("["):
        return "json"
    return "ndjson" if h.startswith("{") and "\n{" in h else "json" if h.startswith("{") else "csv"


def read_files(spark: SparkSession, path: str, kind: str, *, encoding: str = "UTF-8", glob: str | None = None, **dialect) -> DataFrame:
    """Records of all files below the path; hidden and unfinished files (.x, _x, *.tmp, *.part) are
    skipped. kind: a reader, a media type, or ``detect`` (each file by its first characters). dialect:
    arguments of the reader. A byte outside the encoding ends its file with E_ENCODING at its line."""
    kind = MEDIA_TYPES.get(kind, kind)
    if kind != "detect" and kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    files = files.where(~F.col("path").rlike(r"(/[._][^/]*|\.tmp|\.part)$"))

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text, broken = decode(raw, encoding)
                if kind == "detect":
                    rows = list(READERS[detect(text[:10_000])](text))
                else:
                    rows = list(READERS[kind](text, **dialect))
                if broken is not None:
                    # the record that holds the byte is cut off: it is the one to reject
                    cut = rows.pop() if rows and not text.endswith("\n") else (broken, len(rows) + 1)
                    rows.append((*cut[:2], None, "E_ENCODING"))
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    cols = [[name] * len(part), *zip(*part)]
                    cols[3] = [None if f is None else list(f.items()) for f in cols[3]]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)

    return files.mapInArrow(run, RECORDS)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files that are split across tasks: lines are numbered inside
    each block of a file, and the lines of the blocks before are added (one row per block)."""
    d = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("id")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    return d.join(sizes, ["file", "block"]).select("file", (F.col("k") + F.col("o")).alias("line"), "value")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One value a line, split across tasks; a bad line is a row with a code and does not stop the
    file; a line ``{"records": [...]}`` gives each of them. Numbers keep their digits."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")

    def run(batches):
        for b in batches:
            found = [(f, n, i, fields, code) for f, n, v in zip(*(b.column(i).to_pylist() for i in range(3))) for i, (fields, code) in enumerate(json_line(v))]
            cols = list(zip(*found)) if found else [[]] * 5
            cols[3] = [None if f is None else list(f.items()) for f in cols[3]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)

    # until here ``ordinal`` is the place inside the line; an order of both is unique in a file
    r = lines.mapInArrow(run, RECORDS)
    per_line = r.groupBy("file", "line").agg(F.count("*").alias("n"))
    before = running(per_line, ["file"], "line", F.col("n"), "o", inclusive=False).select("file", "line", F.coalesce("o", F.lit(0)).alias("o"))
    return r.join(before, ["file", "line"]).select("file", "line", (F.col("ordinal") + F.col("o") + 1).alias("ordinal"), "fields", "code")


def typed(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Good records as columns: name -> Spark type; what does not convert is null."""
    good = records.where(F.col("code").isNull())
    return good.select(*[(F.nullif(F.col("fields")[n], F.lit("")) if t == "string" else F.col("fields")[n].try_cast(t)).alias(n) for n, t in columns.items()])


def export_documents(records: DataFrame) -> DataFrame:
    """Documents of the positional export: file, header fields, and their number of lines and sum of
    line amounts, joined by (file, parent)."""
    r = records.where(F.col("code").isNull())
    head = r.where(F.col("fields")["type"] == "KOPF").select("file", F.col("ordinal").cast("string").alias("parent"), *[F.col("fields")[n].alias(n) for n in ("invoice_number", "supplier_number", "gross_amount", "vat_amount", "currency")])
    pos = r.where(F.col("fields")["type"] == "POS").select("file", F.col("fields")["parent"].alias("parent"), F.translate(F.col("fields")["line_amount"], "'’", "").try_cast("decimal(28,2)").alias("a"))
    sums = pos.groupBy("file", "parent").agg(F.count("*").alias("n_lines"), F.sum("a").cast("decimal(28,2)").alias("line_sum"))
    return head.join(sums, ["file", "parent"], "left").drop("parent")


def export_totals(records: DataFrame) -> DataFrame:
    """Per file of the positional export: declared and computed counts of documents and lines and sums of
    their amounts, without regard to currency, and whether the trailer is there, nothing was rejected and
    all four agree (``verified``)."""
    amount = lambda n: F.translate(F.col("fields")[n], "'’", "").try_cast("decimal(28,2)")
    of = lambda kind, c: F.when(F.col("fields")["type"] == kind, c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    g = records.groupBy("file").agg(
        F.max(of("NACHLAUF", F.col("fields")["count_headers"].try_cast("bigint"))).alias("declared_documents"), F.max(of("NACHLAUF", F.col("fields")["count_lines"].try_cast("bigint"))).alias("declared_lines"),
        F.max(of("NACHLAUF", amount("sum_gross"))).cast("decimal(38,2)").alias("declared_gross"), F.max(of("NACHLAUF", amount("sum_lines"))).cast("decimal(38,2)").alias("declared_line_sum"),
        F.count(of("KOPF", F.lit(1))).alias("documents"), F.count(of("POS", F.lit(1))).alias("lines"), total(of("KOPF", amount("gross_amount"))).alias("gross"), total(of("POS", amount("line_amount"))).alias("line_sum"),
        F.count("code").alias("rejects"),
    )
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    ok = (F.col("rejects") == 0) & same("declared_documents", "documents") & same("declared_lines", "lines") & same("declared_gross", "gross") & same("declared_line_sum", "line_sum")
    return g.withColumn("verified", ok)
