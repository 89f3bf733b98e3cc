"""Queries over sources, sinks, streams, folds and validations: each writes and reads back whole
tables, so the SQL of the table is their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import CURRENCY_SCALE, canonical_number, host_number
from ..functions.text import trim_ws
from ..operators import folds, validate as V
from ..operators.cow_table import CowTable
from ..operators.message_store import MessageStore
from ..operators.record_split import UNITS, bad_quoting, dialects, framed
from ..session import shared_dir, table
from ..sources import files as S
from ..sources import intake as I
from ..sources import sinks
from ..streaming import feeds
from .payables import _CODE as CODE_OF_RULE, _CUR, _DIALECT, _P3 as P3, _sql_number, FEEDS, SQL as PAYABLES, sql_trim

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- sources -------------------------------------------------------------------------------
_COLS = {"po_number": "string", "supplier_number": "string", "status": "string", "change_seq": "bigint"}
_ORDERS = f"SELECT {sql_trim('po_number')} AS po_number, nullif({sql_trim('supplier_number')}, '') AS supplier_number, status, change_seq FROM purchase_orders"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "purchase_orders")
    return o.select(trim_ws(F.col("po_number")).alias("po_number"), trim_ws(F.col("supplier_number")).alias("supplier_number"), "status", "change_seq")


@query(_ORDERS)
def source_csv(spark, sf):  # SRC-01, SRC-03, SRC-04, SRC-13
    path = shared_dir(spark, "csv")
    _orders(spark, sf).write.option("header", True).option("quoteAll", True).option("emptyValue", "").option("nullValue", "").option("sep", ";").csv(path)
    return S.typed(S.read_files(spark, path, "csv", delimiter=";", glob="*.csv"), _COLS)


@query(_ORDERS)
def source_ndjson(spark, sf):  # SRC-05: lines split across tasks, with line and ordinal
    path = shared_dir(spark, "ndjson")
    _orders(spark, sf).write.json(path)
    return S.typed(S.read_ndjson(spark, path), _COLS)


@query(_ORDERS)
def source_json(spark, sf):  # SRC-06: arrays of at most 5,000 records a file
    path = shared_dir(spark, "json")
    o = _orders(spark, sf).withColumn("f", F.pmod(F.xxhash64("change_seq"), F.ceil(F.lit(_orders(spark, sf).count() / 5000 + 0.001)).cast("bigint")))
    docs = o.groupBy("f").agg(F.to_json(F.collect_list(F.struct(*_COLS))).alias("value")).select("value")
    docs.write.option("maxRecordsPerFile", 1).text(path)
    return S.typed(S.read_files(spark, path, "json", glob="*.txt"), _COLS)


@query(_ORDERS)
def source_xml(spark, sf):  # SRC-07
    path = shared_dir(spark, "xml")
    _orders(spark, sf).write.format("xml").option("rootTag", "records").option("rowTag", "record").save(path)
    return S.typed(S.read_files(spark, path, "xml", glob="*.xml"), _COLS)


def _export(spark, sf) -> DataFrame:
    """The proposals written as files of the positional export and read again."""
    path = shared_dir(spark, "export")
    p = table(spark, sf, "proposals").where("amount_minor is not null").select("proposal_id", "supplier_number", (F.col("amount_minor").cast("decimal(20,2)") / 100).cast("decimal(24,2)").alias("gross")).distinct()
    p = p.withColumn("invoice_number", F.concat_ws("-", "supplier_number", "proposal_id"))
    docs = p.select("supplier_number", "invoice_number", "gross", F.lit("CHF").alias("currency"), F.lit(0).cast("decimal(24,2)").alias("vat"))
    text = sinks.export_lines(docs, p.select("supplier_number", "invoice_number", F.lit("00010").alias("line_no"), F.col("gross").alias("amount")))
    sinks.export_files(text, path, "VORLAUF;2.1;0100;0101260000;CHF;A;B;P")
    return S.read_files(spark, path, "export", encoding="windows-1252", glob="*.txt")


@query("""SELECT supplier_number || '-' || proposal_id AS invoice_number, supplier_number, CAST(1 AS BIGINT) AS n_lines, CAST(amount_minor AS DECIMAL(18,2)) / 100 AS line_sum
FROM (SELECT DISTINCT proposal_id, supplier_number, amount_minor FROM proposals WHERE amount_minor IS NOT NULL)""".replace("CAST(amount_minor AS DECIMAL(18,2)) / 100", "CAST(CAST(amount_minor AS DECIMAL(24,2)) / 100 AS DECIMAL(28,2))"))
def source_export(spark, sf):  # SRC-08..12, SNK-08, WIN-06
    return S.export_documents(_export(spark, sf)).select("invoice_number", "supplier_number", "n_lines", "line_sum")


@query("""SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS declared_documents, CAST(count(*) AS BIGINT) AS lines, CAST(sum(v) AS DECIMAL(38,2)) AS gross, CAST(sum(v) AS DECIMAL(38,2)) AS declared_gross, CAST(sum(v) AS DECIMAL(38,2)) AS declared_line_sum, true AS verified
FROM (SELECT DISTINCT proposal_id, supplier_number, CAST(CAST(amount_minor AS DECIMAL(24,2)) / 100 AS DECIMAL(28,2)) AS v FROM proposals WHERE amount_minor IS NOT NULL)""")
def export_trailers(spark, sf):  # AGG-08, SNK-08: the trailers' counts and sums against what was read, over all files
    t = S.export_totals(_export(spark, sf))
    total = lambda c: F.sum(c).cast("decimal(38,2)").alias(c)
    return t.agg(F.sum("documents").alias("documents"), F.sum("declared_documents").alias("declared_documents"), F.sum("lines").alias("lines"), total("gross"), total("declared_gross"), total("declared_line_sum"), F.bool_and("verified").alias("verified"))


@query("SELECT base, quote, valid_from, nullif(valid_to, '') AS valid_to, rate_type, CAST(rate AS DECIMAL(38,6)) AS rate, rate_factor, sequence, status FROM fx_rates")
def source_rates(spark, sf):  # SRC-18, FN-03: a rate table in XML, ISO-8859-1, decimal commas, nil ends, in no order
    path = shared_dir(spark, "rates")
    r = table(spark, sf, "fx_rates")
    cell = lambda n, c: F.concat(F.lit(f"<{n}>"), c.cast("string"), F.lit(f"</{n}>"))
    end = F.coalesce(cell("ValidTo", F.col("valid_to")), F.lit('<ValidTo xsi:nil="true"/>'))
    rate = F.concat(F.lit("\n "), F.translate("rate", ".", ","), F.lit("\n"))
    row = F.concat(F.lit("<Row>"), cell("Base", F.col("base")), cell("Quote", F.col("quote")), cell("ValidFrom", F.col("valid_from")), end, cell("RateType", F.col("rate_type")), cell("Rate", rate), cell("Factor", F.col("rate_factor")), cell("Sequence", F.col("sequence")), cell("Status", F.col("status")), F.lit("<Comment>g\u00fcltig</Comment></Row>"))
    body = r.select(row.alias("value"), F.xxhash64("fx_rate_id").alias("h")).repartition(max(1, -(-r.count() // 20_000)), "h").sortWithinPartitions("h").select("value")

    def framed(batches):
        import pyarrow as pa

        line = lambda t: pa.RecordBatch.from_arrays([pa.array([t])], names=["value"])
        yield line('<?xml version="1.0"?><t:Rates xmlns:t="urn:rates" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><t:Table>')
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], names=["value"])
        yield line("</t:Table></t:Rates>")

    body.mapInArrow(framed, "value string").write.option("encoding", "ISO-8859-1").text(path)
    f = lambda n: F.col("fields")[n]
    back = S.read_files(spark, path, "xml", encoding="ISO-8859-1", glob="*.txt", row="Row").where("code is null")
    return back.select(f("Base").alias("base"), f("Quote").alias("quote"), f("ValidFrom").alias("valid_from"), f("ValidTo").alias("valid_to"), f("RateType").alias("rate_type"), host_number(f("Rate")).alias("rate"), f("Factor").try_cast("bigint").alias("rate_factor"), f("Sequence").try_cast("int").alias("sequence"), f("Status").alias("status"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({_ORDERS}) WHERE change_seq % 4 = {i}" for i, k in enumerate(("csv", "json", "ndjson", "xml"))))
def source_detected(spark, sf):  # SRC-14, SRC-15: files of four formats in one folder, each read by what it is
    path = shared_dir(spark, "mixed")
    o = _orders(spark, sf)
    part = lambda i: o.where(F.col("change_seq") % 4 == i)
    part(0).write.mode("append").option("header", True).option("quoteAll", True).option("emptyValue", "").option("nullValue", "").csv(f"{path}/a")
    array = part(1).groupBy((F.xxhash64("change_seq") % 50).alias("f"), F.floor(F.col("change_seq") / 5000).alias("g")).agg(F.concat(F.lit("[ "), F.array_join(F.collect_list(F.to_json(F.struct(*_COLS))), ","), F.lit("]")).alias("value"))
    array.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/b")  # at most 5,000 records a file
    part(2).write.json(f"{path}/c")
    part(3).write.format("xml").option("rootTag", "records").option("rowTag", "record").save(f"{path}/d")
    records = S.read_files(spark, path, "detect")
    kind = F.element_at(F.split("file", "/"), -2)
    names = F.create_map(*[F.lit(x) for pair in zip("abcd", ("csv", "json", "ndjson", "xml")) for x in pair])
    good = records.where("code is null").select(names[kind].alias("kind"), *[(F.nullif(F.col("fields")[n], F.lit("")) if t == "string" else F.col("fields")[n].try_cast(t)).alias(n) for n, t in _COLS.items()])
    return good


# -- intake of batches ---------------------------------------------------------------------------
def _deliveries(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The raw records put back into files, a manifest per batch. By their numbers of records, some files
    have a wrong checksum or count, and some batches are to be aborted by one reject. A record with
    broken quoting ends with its line in a file, so a line end inside one is written as a blank."""
    r = table(spark, sf, "records").where("raw_text is not null and raw_text <> ''")
    torn = framed(r, table(spark, sf, "file_receipts")).select("record_id", F.exists("cells", lambda c: bad_quoting(c["raw"])).alias("torn"))
    text = F.when(F.col("torn"), F.translate("raw_text", "\n", " ")).otherwise(F.col("raw_text"))
    r = r.join(torn, "record_id").select("batch_id", F.col("file").alias("path"), "dataset", "line", "record_id", text.alias("raw_text"))
    heads = dialects(table(spark, sf, "file_receipts")).where("header_line is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "record_id", "raw_text"))), lambda x: x["raw_text"]), "\n")  # a file is bounded
    f = r.groupBy("batch_id", "path", "dataset").agg(body.alias("body"), F.count("*").alias("n")).join(heads, ["batch_id", "path"])
    f = f.withColumn("content", F.encode(F.concat("header_line", F.lit("\n"), "body", F.lit("\n")), "UTF-8"))
    sha = F.when(F.col("n") % 13 == 5, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("content", 256))
    entry = F.struct("path", "dataset", F.lit("UTF-8").alias("encoding"), "delimiter", "decimal_separator", "thousands_separator", "date_format", sha.alias("sha256"), (F.col("n") + (F.col("n") % 11 == 3).cast("int")).alias("record_count"))
    m = f.select("batch_id", entry.alias("e")).groupBy("batch_id").agg(F.sort_array(F.collect_list("e")).alias("files"))
    m = m.select(F.col("batch_id").alias("batch"), F.to_json(F.struct(F.lit("1").alias("manifest_version"), "batch_id", F.lit("upsert").alias("mode"), F.when(F.size("files") % 2 == 0, "abort_batch").otherwise("continue").alias("on_error"), "files")).alias("manifest"))
    return m, f.select(F.col("batch_id").alias("batch"), "path", "content")


CODE_OF = f"""CASE rk WHEN 1 THEN CASE WHEN regexp_matches(raw, '(?s)^"(?:[^"]|"")*"[^"]') THEN 'E_FIELD_INVALID' ELSE 'E_MALFORMED_DOCUMENT' END WHEN 2 THEN 'E_FIELD_INVALID' ELSE {CODE_OF_RULE} END"""
_K = {d: " || chr(31) || ".join(f"coalesce(max(CASE WHEN name = '{p}' THEN v END), '')" for p in parts) for d, parts in I.KEYS.items()}
_INTAKE = P3 + f""", fi AS (SELECT batch_id, file, count(*) AS n, CASE WHEN count(*) % 13 = 5 THEN 'E_CHECKSUM_MISMATCH' WHEN count(*) % 11 = 3 THEN 'E_COUNT_MISMATCH' END AS fault FROM records WHERE raw_text IS NOT NULL AND raw_text <> '' GROUP BY ALL),
ba AS (SELECT batch_id, count(*) % 2 = 0 AS abort FROM fi GROUP BY 1),
o AS (SELECT record_id, batch_id, file, line, row_number() OVER (PARTITION BY batch_id, file ORDER BY line, record_id) AS ordinal FROM records WHERE raw_text IS NOT NULL AND raw_text <> ''),
q AS (SELECT *, CASE WHEN torn THEN 1 WHEN off THEN 2 WHEN NOT ok THEN 3 END AS rk FROM k),
b AS (SELECT record_id, rk, {CODE_OF} AS code, CASE WHEN rk = 3 THEN name END AS field FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rk, pos) AS one FROM q WHERE rk IS NOT NULL) WHERE one = 1),
w AS (SELECT record_id, dataset, CASE dataset {" ".join(f"WHEN '{d}' THEN {x}" for d, x in _K.items())} END AS natural_key, string_agg(name || '=' || v, chr(31) ORDER BY name || '=' || v) AS content FROM k GROUP BY record_id, dataset),
j AS (SELECT o.*, fi.fault, ba.abort, coalesce(fi.fault, b.code) AS c1, CASE WHEN fi.fault IS NULL THEN b.field END AS f1, coalesce(b.rk < 3, false) AS unframed FROM o JOIN fi USING (batch_id, file) JOIN ba USING (batch_id) LEFT JOIN b USING (record_id)),
z AS (SELECT *, CASE WHEN c1 IS NULL AND abort AND bool_or(c1 IS NOT NULL) OVER (PARTITION BY batch_id) THEN 'E_BATCH_ABORTED' ELSE c1 END AS c2 FROM j),
cl AS (SELECT z.record_id, lag(content) OVER (PARTITION BY dataset, natural_key ORDER BY batch_id, file, ordinal) = content AS same FROM z JOIN w USING (record_id) WHERE c2 IS NULL)
SELECT z.batch_id AS batch, file AS path, ordinal, CASE WHEN fault <> 'E_CHECKSUM_MISMATCH' OR fault IS NULL THEN w.dataset END AS dataset, CASE WHEN NOT unframed THEN w.natural_key END AS natural_key,
CASE WHEN c2 IS NOT NULL THEN 'rejected' WHEN same THEN 'skipped_unchanged' ELSE 'accepted' END AS outcome, c2 AS code, f1 AS field FROM z JOIN w USING (record_id) LEFT JOIN cl USING (record_id) WHERE fault IS NULL OR fault <> 'E_CHECKSUM_MISMATCH'
UNION ALL SELECT batch_id, file, 0, (SELECT min(dataset) FROM records r WHERE r.batch_id = fi.batch_id AND r.file = fi.file), NULL, 'rejected', fault, NULL FROM fi WHERE fault = 'E_CHECKSUM_MISMATCH'"""


@query(_INTAKE)
def intake_outcomes(spark, sf):  # SRC-02, VAL-09, PRJ-01, UPD-04, UPD-07, CMP-04: manifest to outcome, one row per record
    return I.intake(*_deliveries(spark, sf)).select("batch", "path", "ordinal", "dataset", "natural_key", "outcome", "code", "field")


# -- sinks -----------------------------------------------------------------------------------
def _outbox(fmt: str):
    def q(spark, sf):
        path = shared_dir(spark, f"outbox-{fmt}")
        d = table(spark, sf, "proposals").select("proposal_id").distinct()
        sinks.write_outbox(d, path, ["proposal_id"], fmt)
        if fmt == "xml":
            back = spark.read.format("xml").option("rowTag", "record").schema("proposal_id string, page int").load(path)
        elif fmt == "csv":
            back = spark.read.option("header", True).schema("proposal_id string, page int").csv(path)
        else:
            back = spark.read.format(fmt).schema("proposal_id string, page int").load(path)
        return back.groupBy(F.col("page").cast("int").alias("page")).agg(F.count("*").alias("n"), F.min("proposal_id").alias("first"))

    return q


for _f in ("csv", "json", "xml", "parquet"):  # SNK-04, SNK-05
    QUERIES[f"sink_outbox_{_f}"] = _outbox(_f)
    SQL[f"sink_outbox_{_f}"] = """SELECT CAST((n-1)//500 AS INTEGER) AS page, count(*) AS n, min(proposal_id) AS first FROM (
    SELECT proposal_id, row_number() OVER (ORDER BY proposal_id) AS n FROM (SELECT DISTINCT proposal_id FROM proposals)) GROUP BY 1"""


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def sink_raw_store(spark, sf):  # SNK-06; written twice, stored once
    path = shared_dir(spark, "raw")
    raw = table(spark, sf, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    sinks.store_raw(raw, path)
    return sinks.store_raw(raw, path).select("sha256")


@query("SELECT coalesce(outcome, 'pending') AS outcome, count(*) AS n FROM records GROUP BY 1")
def sink_receipt(spark, sf):  # SNK-01, SNK-02, SNK-03
    counts = sinks.write_receipt(table(spark, sf, "records"), shared_dir(spark, "receipt"))
    return spark.createDataFrame(list(counts.items()), "outcome string, n bigint")


# -- streams -------------------------------------------------------------------------------------
@query(PAYABLES["p2_suppliers"])
def stream_suppliers(spark, sf):  # UPD-01, UPD-03: the feed as a file stream, one file a batch
    f = FEEDS["suppliers"]
    t = CowTable(spark, shared_dir(spark, "stream-feed"), key=f["key"](), seq=f["seq"], op="op", content=f["content"], delivered=f["delivered"], buckets=8)
    src = feeds.file_stream(spark, f"{sf}/suppliers.parque*", table(spark, sf, "suppliers"), 4)
    t.apply(table(spark, sf, "suppliers").where("false"))  # an empty stream leaves an empty table
    feeds.stream_into(src, t.apply, shared_dir(spark, "stream-check"))
    return t.current().select(F.col("key").alias("supplier_number"), F.col("seq").alias("change_seq"), *[F.col("state")[c].alias(c) for c in f["content"]])


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, sf):  # tumbling event-time windows; the same plan runs on a stream
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.windowed_counts(e, "ts", "event_type", "1 hour", "1 day").select("event_type", F.col("start").cast("timestamp_ntz").alias("hour"), "n")


@query(f"SELECT DISTINCT {sql_trim('idempotency_key')} AS k FROM postings WHERE idempotency_key IS NOT NULL")
def stream_dedup(spark, sf):  # STR-02: identifiers seen on a stream, once each; the state is the store's index on disk
    p = table(spark, sf, "postings").select("posting_id", "idempotency_key", "received_at")
    store = MessageStore(spark, shared_dir(spark, "stream-postings"), key="idempotency_key", row_id="posting_id", order=["received_at"], period=F.date_format("received_at", "yyyy-MM"), buckets=8)
    store.ingest(p.where("false"))  # an empty stream leaves an empty store
    feeds.stream_into(feeds.file_stream(spark, f"{sf}/postings.parque*", p, 4), store.ingest, shared_dir(spark, "stream-check"), "postings")
    return store.messages().where("idempotency_key is not null").select(trim_ws(F.col("idempotency_key")).alias("k"))


@query("SELECT po_row_id, change_seq FROM purchase_orders")
def incremental_drain(spark, sf):  # STR-01, AGG-09, LIM-01: two drains, nothing lost at the bound
    o = table(spark, sf, "purchase_orders").select("po_row_id", "change_seq")
    log = feeds.DrainedLog(spark, shared_dir(spark, "drain"))
    half = o.agg(F.expr("percentile_approx(change_seq, 0.5)")).first()[0]
    for part in (o.where(F.col("change_seq") <= half), o, o):
        log.drain(part, "orders", "change_seq")
    return log.rows("orders", o.schema)


# -- ordered folds -----------------------------------------------------------------------------------
@query()
def token_bucket(spark, sf):  # WIN-08: checked against brute force in the tests
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return folds.bucket_levels(e, "user_id", ["event_id"], ["event_id", "user_id"], "ms", 3, 3_600_000)


@query()
def optimistic_puts(spark, sf):  # UPD-02
    s = table(spark, sf, "suppliers").select(trim_ws(F.col("supplier_number")).alias("k"), "change_id", F.col("payment_terms_days").cast("string").alias("v"), F.when(F.col("op") == "I", 0).cast("bigint").alias("w"))
    return folds.versioned_puts(s, "k", ["change_id"], "w", "v", ["change_id", "k"])


# -- validation -----------------------------------------------------------------------------------------
@query("""SELECT 'cost_centers' AS dataset, CAST(cc_row_id AS BIGINT) AS row_id, 'E_FIELD_INVALID' AS code, 'valid_to' AS field FROM cost_centers WHERE valid_to IS NOT NULL AND valid_from >= valid_to
UNION ALL SELECT 'purchase_orders', po_row_id, 'E_FIELD_REQUIRED', 'supplier_number' FROM purchase_orders WHERE supplier_number IS NULL OR supplier_number = ''
UNION ALL SELECT 'purchase_orders', po_row_id, 'E_ENUM_UNKNOWN', 'status' FROM purchase_orders WHERE status NOT IN ('OPEN', 'CLOSED')
UNION ALL SELECT 'fx_rates', fx_rate_id, 'E_FIELD_INVALID', 'valid_to' FROM fx_rates WHERE valid_to IS NOT NULL AND valid_from >= valid_to
UNION ALL SELECT 'fx_rates', fx_rate_id, 'E_MONEY_SCALE', 'rate' FROM fx_rates WHERE regexp_matches(rate, '[.,][0-9]{6,}')
UNION ALL SELECT 'suppliers', change_id, 'E_CURRENCY_UNKNOWN', 'currency' FROM suppliers WHERE currency NOT IN ('CHF','EUR','USD','GBP','SEK','DKK','NOK','HUF','IDR','JPY')""")
def validation_findings(spark, sf):  # six conditions only; rule_findings has the rule sets
    c = F.col
    sets = [
        ("cost_centers", "cc_row_id", [V.half_open("valid_to", c("valid_from"), c("valid_to"))]),
        ("purchase_orders", "po_row_id", [V.required("supplier_number", c("supplier_number")), V.one_of("status", c("status"), ["OPEN", "CLOSED"])]),
        ("fx_rates", "fx_rate_id", [V.half_open("valid_to", c("valid_from"), c("valid_to")), V.max_scale("rate", c("rate"), 5)]),
        ("suppliers", "change_id", [V.currency("currency", c("currency"))]),
    ]
    out = None
    for name, key, rules in sets:
        d = V.findings(table(spark, sf, name), rules).select(F.lit(name).alias("dataset"), c(key).alias("row_id"), F.explode("findings").alias("f")).select("dataset", "row_id", "f.code", "f.field")
        out = d if out is None else out.unionByName(d)
    return out


def _sql_rules(dataset: str, key: str, source: str, text: list[str], syntax: list[tuple], rules: list[tuple]) -> str:
    def found(x):
        each = ", ".join(f"CASE WHEN {bad} THEN struct_pack(code := '{code}', field := '{field}') END" for code, field, bad in x)
        return f"list_filter([{each}], lambda f: f IS NOT NULL)"

    trimmed = ", ".join(f"coalesce({sql_trim(c)}, '') AS {c}" for c in text)
    return f"""SELECT '{dataset}' AS dataset, row_id, f.code AS code, f.field AS field FROM (SELECT row_id, unnest({'CASE WHEN len(s) > 0 THEN s ELSE m END' if syntax else 'm'}) AS f
FROM (SELECT row_id, {found(syntax) + " AS s, " if syntax else ""}{found(rules)} AS m FROM (SELECT CAST({key} AS BIGINT) AS row_id, * REPLACE ({trimmed}) FROM {source})))"""


def _sql_no_date(c: str) -> tuple:
    return ("E_DATE_FORMAT", c, f"{c} <> '' AND NOT (regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({c} AS DATE) IS NOT NULL)")


def _sql_closed(c: str, values: str, code: str = "E_ENUM_UNKNOWN") -> list[tuple]:
    return [("E_FIELD_REQUIRED", c, f"{c} = ''"), (code, c, f"{c} <> '' AND {c} NOT IN {values}")]


_RANGE = ("E_FIELD_INVALID", "valid_to", "valid_from <> '' AND valid_to <> '' AND valid_from >= valid_to")
_RULES = " UNION ALL ".join([
    _sql_rules("suppliers", "change_id", "suppliers", ["supplier_number", "name", "currency", "country"], [], [
        ("E_KEY_MISSING", "supplier_number", "supplier_number = ''"), ("E_FIELD_REQUIRED", "name", "name = ''"), *_sql_closed("currency", _CUR, "E_CURRENCY_UNKNOWN"),
        ("E_COUNTRY_FORMAT", "country", "country <> '' AND NOT regexp_full_match(country, '[A-Z]{2}')"), ("E_FIELD_INVALID", "payment_terms_days", "payment_terms_days < 0")]),
    _sql_rules("cost_centers", "cc_row_id", "cost_centers", ["code", "name", "company_code", "valid_from", "valid_to"], [_sql_no_date("valid_from"), _sql_no_date("valid_to")], [
        ("E_KEY_MISSING", "code", "code = ''"), ("E_FIELD_REQUIRED", "name", "name = ''"), *_sql_closed("company_code", "('CH10', 'CH20')"), ("E_FIELD_REQUIRED", "valid_from", "valid_from = ''"), _RANGE]),
    _sql_rules("purchase_orders", "po_row_id", "purchase_orders", ["po_number", "supplier_number", "company_code", "currency", "status", "order_date"], [_sql_no_date("order_date")], [
        ("E_KEY_MISSING", "po_number", "po_number = ''"), ("E_FIELD_REQUIRED", "supplier_number", "supplier_number = ''"), *_sql_closed("company_code", "('CH10', 'CH20')"),
        *_sql_closed("currency", _CUR, "E_CURRENCY_UNKNOWN"), *_sql_closed("status", "('OPEN', 'CLOSED', 'CANCELLED')"), ("E_FIELD_REQUIRED", "order_date", "order_date = ''")]),
    _sql_rules("purchase_order_lines", "line_id", f"(SELECT p.*, coalesce(x.decimal_separator, '.') AS dec, x.thousands_separator AS tho FROM purchase_order_lines p LEFT JOIN {_DIALECT} f USING (batch_id, path))", ["po_number", "line_no", "uom", "currency", "unit_price"], [
        ("E_DECIMAL_FORMAT", "unit_price", f"unit_price <> '' AND ({_sql_number('unit_price')}) IS NULL"),
        ("E_FIELD_INVALID", "unit_price", "currency <> '' AND regexp_matches(unit_price, '^[A-Z]{3} +.') AND unit_price[1:3] <> currency")], [
        ("E_KEY_MISSING", "po_number", "po_number = ''"), ("E_KEY_MISSING", "line_no", "line_no = ''"), *_sql_closed("uom", "('EA','PCE','CTN','KG','G','L','M','STK','STD','PAU','M2','H','TON','PAL')", "E_UOM_UNKNOWN"),
        *_sql_closed("currency", _CUR, "E_CURRENCY_UNKNOWN"), ("E_MONEY_SCALE", "unit_price", "regexp_matches(unit_price, '[.,][0-9]{7,}')")]),
    _sql_rules("fx_rates", "fx_rate_id", "(SELECT *, '.' AS dec, chr(39) AS tho FROM fx_rates)", ["base", "quote", "valid_from", "valid_to", "rate_type", "rate", "status"], [
        _sql_no_date("valid_from"), _sql_no_date("valid_to"), ("E_DECIMAL_FORMAT", "rate", f"rate <> '' AND ({_sql_number('rate')}) IS NULL")], [
        *[("E_KEY_MISSING", c, f"{c} = ''") for c in ("base", "quote", "valid_from", "rate_type")], *[("E_CURRENCY_UNKNOWN", c, f"{c} <> '' AND {c} NOT IN {_CUR}") for c in ("base", "quote")],
        ("E_ENUM_UNKNOWN", "rate_type", "rate_type NOT IN ('', 'DAILY', 'MONTHLY_AVG')"), _RANGE, *_sql_closed("status", "('ACTIVE', 'DELETED')"),
        ("E_FIELD_INVALID", "rate_factor", "coalesce(rate_factor, 0) <= 0"), ("E_FIELD_INVALID", "rate", "rate = '' OR NOT regexp_matches(rate, '[1-9]') OR regexp_matches(rate, '^([A-Z]{3} +)?[-(]|[0-9]-$')"), ("E_FIELD_INVALID", "sequence", "sequence < 0")]),
    _sql_rules("postings", "posting_id", "postings", ["proposal_id", "erp_status", "erp_document_number"], [], [
        ("E_KEY_MISSING", "proposal_id", "proposal_id = ''"), ("E_FIELD_REQUIRED", "erp_document_number", "erp_status = 'posted' AND erp_document_number = ''"), *_sql_closed("erp_status", "('posted', 'rejected', 'failed', 'skipped')")]),
])


@query(_RULES)
def rule_findings(spark, sf):  # VAL-01..05, VAL-07, VAL-08, PRJ-02; texts are trimmed, null is empty
    text = lambda c: F.coalesce(trim_ws(F.col(c)), F.lit(""))
    key = lambda c: V.required(c, text(c), True)
    need = lambda c: V.required(c, text(c))
    date = lambda c: V.calendar_date(c, text(c))
    company, money = V.closed("company_code", text("company_code"), ["CH10", "CH20"]), V.closed("currency", text("currency"), CURRENCY_SCALE, "E_CURRENCY_UNKNOWN")
    span = ("E_FIELD_INVALID", "valid_to", (text("valid_from") != "") & (text("valid_to") != "") & (text("valid_from") >= text("valid_to")))
    unread = lambda c, canonical: ("E_DECIMAL_FORMAT", c, (text(c) != "") & (canonical == ""))
    price, rate = canonical_number(text("unit_price"), F.col("decimal_separator"), F.col("thousands_separator")), canonical_number(text("rate"), F.lit("."), F.lit("'"))
    other = (text("currency") != "") & text("unit_price").rlike("^[A-Z]{3} +.") & (F.left(text("unit_price"), F.lit(3)) != text("currency"))
    lines = table(spark, sf, "purchase_order_lines").join(dialects(table(spark, sf, "file_receipts")).select("batch_id", "path", "decimal_separator", "thousands_separator"), ["batch_id", "path"], "left")
    sets = [
        ("suppliers", None, "change_id", [], [
            key("supplier_number"), need("name"), *money, ("E_COUNTRY_FORMAT", "country", ~text("country").rlike("^(?:[A-Z]{2})?$")), ("E_FIELD_INVALID", "payment_terms_days", F.col("payment_terms_days") < 0)]),
        ("cost_centers", None, "cc_row_id", [date("valid_from"), date("valid_to")], [key("code"), need("name"), *company, need("valid_from"), span]),
        ("purchase_orders", None, "po_row_id", [date("order_date")], [
            key("po_number"), need("supplier_number"), *company, *money, *V.closed("status", text("status"), ["OPEN", "CLOSED", "CANCELLED"]), need("order_date")]),
        ("purchase_order_lines", lines, "line_id", [unread("unit_price", price), ("E_FIELD_INVALID", "unit_price", other)], [
            key("po_number"), key("line_no"), *V.closed("uom", text("uom"), UNITS, "E_UOM_UNKNOWN"), *money, V.max_scale("unit_price", text("unit_price"), 6)]),
        ("fx_rates", None, "fx_rate_id", [date("valid_from"), date("valid_to"), unread("rate", rate)], [
            *map(key, ("base", "quote", "valid_from", "rate_type")), *[V.closed(c, text(c), CURRENCY_SCALE, "E_CURRENCY_UNKNOWN")[1] for c in ("base", "quote")],
            V.closed("rate_type", text("rate_type"), ["DAILY", "MONTHLY_AVG"])[1], span, *V.closed("status", text("status"), ["ACTIVE", "DELETED"]),
            ("E_FIELD_INVALID", "rate_factor", F.coalesce("rate_factor", F.lit(0)) <= 0), V.positive("rate", rate), ("E_FIELD_INVALID", "sequence", F.col("sequence") < 0)]),
        ("postings", None, "posting_id", [], [
            key("proposal_id"), ("E_FIELD_REQUIRED", "erp_document_number", (text("erp_status") == "posted") & (text("erp_document_number") == "")), *V.closed("erp_status", text("erp_status"), ["posted", "rejected", "failed", "skipped"])]),
    ]
    out = None
    for name, rows, row_id, syntax, rules in sets:
        d = V.record_findings(table(spark, sf, name) if rows is None else rows, syntax, rules)
        d = d.select(F.lit(name).alias("dataset"), F.col(row_id).alias("row_id"), F.explode("findings").alias("f")).select("dataset", "row_id", "f.code", "f.field")
        out = d if out is None else out.unionByName(d)
    return out
