"""Queries p1 to p5 and p7 over the delivery tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, canonical_order_number, trim_ws
from ..operators.as_of import Facts, as_known_join
from ..operators.cow_table import CowTable
from ..operators.message_store import MessageStore, arrival_waves
from ..operators.record_split import HEADERS, RULES, framed, rejects, typed_rows
from ..operators.references import Edge, Node, existence_spans, orphan_report, orphans
from ..operators.units import base_quantities
from ..session import shared_dir, table

#: DuckDB expression for the white space of TESTDATA.md
_WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def sql_trim(c: str) -> str:
    return f"trim({c}, {_WS})"


# -- 1: messages delivered more than once --------------------------------------
def posting_store(spark: SparkSession, sf: str) -> MessageStore:
    store = MessageStore(
        spark, shared_dir(spark, "postings"), key="idempotency_key", row_id="posting_id", order=["received_at"],
        period=F.date_format("received_at", "yyyy-MM"), buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4),
    )
    for wave in arrival_waves(table(spark, sf, "postings"), "received_at"):
        store.ingest(wave)
    return store


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return posting_store(spark, sf).surplus().select("posting_id")


def p1_messages(spark: SparkSession, sf: str) -> DataFrame:
    return posting_store(spark, sf).messages().select("posting_id", "batch_id", "idempotency_key", "erp_document_number", "received_at")


_P1 = f"""SELECT *, {sql_trim('idempotency_key')} AS k, row_number() OVER (
  PARTITION BY {sql_trim('idempotency_key')} ORDER BY received_at NULLS LAST, posting_id) AS rn FROM postings"""
SQL = {
    "p1_found": f"SELECT posting_id FROM ({_P1}) WHERE k IS NOT NULL AND rn > 1",
    "p1_messages": f"SELECT posting_id, batch_id, idempotency_key, erp_document_number, received_at FROM ({_P1}) WHERE k IS NULL OR rn = 1",
}


# -- 2: change feeds -------------------------------------------------------------
FEEDS = {
    "suppliers": dict(key=lambda: trim_ws(F.col("supplier_number")), seq="change_seq", content=["name", "country", "currency", "iban", "vat_number", "payment_terms_days", "blocked"], delivered=["received_at", "change_id"]),
    "proposals": dict(key=lambda: F.col("proposal_id"), seq="seq", content=["status", "attempts", "superseded_by"], delivered=["received_at", "revision_id"]),
}


def feed_table(spark: SparkSession, sf: str, name: str) -> CowTable:
    f = FEEDS[name]
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = CowTable(spark, shared_dir(spark, f"feed-{name}"), key=f["key"](), seq=f["seq"], op="op", content=f["content"], delivered=f["delivered"], buckets=buckets)
    for wave in arrival_waves(table(spark, sf, name), "received_at"):
        t.apply(wave)
    return t


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in FEEDS:
        now = feed_table(spark, sf, name).current().select(F.lit(name).alias("dataset"), F.col("key").alias("record_key"), F.col("seq").alias("change_seq"))
        out = now if out is None else out.unionByName(now)
    return out


def p2_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """The current supplier master with typed columns."""
    return feed_table(spark, sf, "suppliers").current().select(F.col("key").alias("supplier_number"), F.col("seq").alias("change_seq"), *[F.col("state")[c].alias(c) for c in FEEDS["suppliers"]["content"]])


def p2_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Changes by effect; ``unchanged`` is what a receipt counts in skipped_unchanged."""
    out = None
    for name in FEEDS:
        n = feed_table(spark, sf, name).effects().groupBy("effect").agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "effect", "n")
        out = n if out is None else out.unionByName(n)
    return out


def _p2_log(name: str) -> str:
    f = FEEDS[name]
    key = sql_trim("supplier_number") if name == "suppliers" else "proposal_id"
    first = f["delivered"]
    content = ", ".join(f"CASE WHEN op <> 'D' THEN {c} END AS {c}" for c in f["content"])
    same = " AND ".join(["gone = p_gone"] + [f"{c} IS NOT DISTINCT FROM p_{c}" for c in f["content"]])
    lags = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ["gone", *f["content"]])
    return f"""(WITH d AS (SELECT {key} AS k, {f['seq']} AS s, op = 'D' AS gone, {content},
      row_number() OVER (PARTITION BY {key}, {f['seq']} ORDER BY {first[0]}, {first[1]}) AS rn
    FROM {name} WHERE {key} IS NOT NULL AND {f['seq']} IS NOT NULL),
    l AS (SELECT *, {lags}, row_number() OVER w = 1 AS head FROM d WHERE rn = 1 WINDOW w AS (PARTITION BY k ORDER BY s)),
    m AS (SELECT *, NOT head AND {same} AS same FROM l)
    SELECT * FROM m)"""


def _p2_present(name: str, cols: str) -> str:
    return f"""SELECT {cols} FROM (SELECT *, max(CASE WHEN NOT same THEN s END) OVER (PARTITION BY k) AS run,
      row_number() OVER (PARTITION BY k ORDER BY s DESC) AS last FROM {_p2_log(name)}) WHERE last = 1 AND NOT gone"""


SQL["p2_found"] = " UNION ALL ".join(_p2_present(n, f"'{n}' AS dataset, k AS record_key, run AS change_seq") for n in FEEDS)
SQL["p2_suppliers"] = _p2_present("suppliers", "k AS supplier_number, run AS change_seq, " + ", ".join(FEEDS["suppliers"]["content"]))
SQL["p2_effects"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS dataset, CASE WHEN gone AND (head OR p_gone) THEN 'void' WHEN NOT gone AND same THEN 'unchanged' ELSE 'applied' END AS effect,
    CAST(count(*) AS BIGINT) AS n FROM {_p2_log(n)} GROUP BY ALL""" for n in FEEDS
)


# -- 3: rows that fail to parse ----------------------------------------------------
def _frames(spark: SparkSession, sf: str, judged: bool = False) -> DataFrame:
    records = table(spark, sf, "records")
    return framed(records if judged else records.where("outcome is null"), table(spark, sf, "file_receipts"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(_frames(spark, sf)).select("record_id", "reason")


def p3_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """All rejected rows, also of judged files, with line, outcome, code and field."""
    return rejects(_frames(spark, sf, True), ranges=True).select("record_id", "line", "outcome", "reason", "code", "field")


def _p3_typed(dataset: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        frames = _frames(spark, sf, True)
        return typed_rows(frames, rejects(frames, ranges=True), dataset)

    return q


# -- 4: units ----------------------------------------------------------------------
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_quantities(spark, sf).where("not plain").select("line_id", "base_uom", "base_milli")


def p4_quantities(spark: SparkSession, sf: str) -> DataFrame:
    return base_quantities(table(spark, sf, "purchase_order_lines"), table(spark, sf, "file_receipts"), table(spark, sf, "uom_conversions"))


# -- 5: references ---------------------------------------------------------------
def payables_orphans(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders, props = (table(spark, sf, t) for t in ("purchase_order_lines", "purchase_orders", "proposals"))
    suppliers, centers = table(spark, sf, "suppliers"), table(spark, sf, "cost_centers")
    props = props.groupBy("proposal_id").agg(F.min(F.struct("matched_cost_center", "created_at")).alias("x")).select("proposal_id", "x.*")
    order_key = canonical_order_number(F.col("po_number"))
    nodes = [
        Node("purchase_order_lines", lines, F.col("line_id").cast("string")),
        Node("purchase_orders", orders, F.col("po_row_id").cast("string"), order_key),
        Node("proposals", props, F.col("proposal_id")),
    ]
    changes = suppliers.select(trim_ws(F.col("supplier_number")).alias("key"), F.col("changed_at").alias("t"), F.struct(F.col("change_seq").alias("seq"), (F.col("op") == "D").alias("gone")).alias("value"))
    nodes += [Node("suppliers", suppliers, F.col("change_id").cast("string")), Node("cost_centers", centers, F.col("cc_row_id").cast("string"))]
    edges = [
        Edge("purchase_order_lines", "purchase_orders", order_key, F.col("received_at"), spans=existence_spans(orders, order_key, "received_at", "deleted_at")),
        Edge("purchase_orders", "suppliers", trim_ws(F.col("supplier_number")), F.col("received_at"), changes=changes),
        Edge("proposals", "cost_centers", trim_ws(F.col("matched_cost_center")), F.col("created_at"), spans=existence_spans(centers, trim_ws(F.col("code")), "received_at", "deleted_at")),
    ]
    return orphans(nodes, edges)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return payables_orphans(spark, sf).where("kind = 'direct'").select("child_table", "record_key", "reason")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(payables_orphans(spark, sf))


def _sql_order(c: str) -> str:
    head = sql_trim(f"split_part(regexp_replace({sql_trim(c)}, '^PO-', ''), '/', 1)")
    return f"(CASE WHEN regexp_full_match({head}, '[0-9]+') THEN regexp_replace({head}, '^0+([0-9])', '\\1') ELSE {head} END)"


_P5 = f"""WITH o AS (SELECT {_sql_order('po_number')} AS k, min(received_at) AS f, min(deleted_at) AS g FROM purchase_orders GROUP BY 1),
c AS (SELECT {sql_trim('code')} AS k, min(received_at) AS f, min(deleted_at) AS g FROM cost_centers GROUP BY 1),
pr AS (SELECT proposal_id, min(matched_cost_center) AS cc, min(created_at) AS t FROM proposals GROUP BY 1),
s AS (SELECT {sql_trim('supplier_number')} AS k, change_seq, op, changed_at FROM suppliers),
sa AS (SELECT a.k, min(a.changed_at) AS f FROM s a WHERE a.op <> 'D' AND NOT EXISTS (
  SELECT 1 FROM s b WHERE b.k = a.k AND b.op = 'D' AND b.changed_at <= a.changed_at AND b.change_seq > a.change_seq) GROUP BY 1),
po AS (SELECT po_row_id, k AS okey, {sql_trim('supplier_number')} AS sk, received_at AS t FROM (SELECT *, {_sql_order('po_number')} AS k FROM purchase_orders) WHERE supplier_number IS NOT NULL),
ps AS (SELECT po_row_id, okey, po.sk, t, arg_max(s.op, s.change_seq) AS st FROM po LEFT JOIN s ON s.k = po.sk AND s.changed_at <= po.t GROUP BY ALL),
ln AS (SELECT CAST(line_id AS VARCHAR) AS id, {_sql_order('po_number')} AS k, received_at AS t FROM purchase_order_lines WHERE po_number IS NOT NULL),
direct AS (
SELECT 'purchase_order_lines' AS child_table, id AS record_key,
  CASE WHEN o.f IS NULL THEN 'missing' WHEN o.f > ln.t THEN 'late' WHEN o.g <= ln.t THEN 'deleted' END AS reason, ln.t, CAST(NULL AS VARCHAR) AS okey
FROM ln LEFT JOIN o USING (k)
UNION ALL
SELECT 'purchase_orders', CAST(po_row_id AS VARCHAR), CASE WHEN st IS NOT NULL AND st <> 'D' THEN NULL
  WHEN sk NOT IN (SELECT k FROM s WHERE k IS NOT NULL) THEN 'missing' WHEN sa.f > t THEN 'late' ELSE 'deleted' END, t, okey FROM ps LEFT JOIN sa ON sa.k = ps.sk
UNION ALL
SELECT 'proposals', proposal_id, CASE WHEN c.f IS NULL THEN 'missing' WHEN c.f > pr.t THEN 'late' WHEN c.g <= pr.t THEN 'deleted' END, pr.t, NULL
FROM pr LEFT JOIN c ON c.k = {sql_trim('cc')} WHERE cc IS NOT NULL),
d AS (SELECT * FROM direct WHERE reason IS NOT NULL),
inh AS (SELECT 'purchase_order_lines' AS child_table, id AS record_key, t FROM ln
  WHERE k IN (SELECT okey FROM d WHERE child_table = 'purchase_orders' AND okey IS NOT NULL)
  AND id NOT IN (SELECT record_key FROM d WHERE child_table = 'purchase_order_lines'))
"""
SQL["p5_found"] = _P5 + "SELECT child_table, record_key, reason FROM d"
SQL["p5_report"] = _P5 + """SELECT child_table, strftime(t, '%Y-%m') AS month, kind, reason, CAST(count(*) AS BIGINT) AS n FROM (
SELECT child_table, t, 'direct' AS kind, reason FROM d UNION ALL SELECT child_table, t, 'inherited', 'purchase_orders' FROM inh) GROUP BY ALL"""


# -- 7: attributes as known at event time -------------------------------------------
FX = Facts("base", "valid_from", "valid_to", "sequence", "fx_rate_id", "published_at")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    props = table(spark, sf, "proposals").where(F.col("source_currency") != "CHF")
    events = props.groupBy("proposal_id").agg(F.min(F.struct("source_currency", "created_at", "document_date")).alias("x")).select("proposal_id", "x.*")
    rates = table(spark, sf, "fx_rates").where((F.col("quote") == "CHF") & (F.col("rate_type") == "DAILY")).withColumn("stands_for_nothing", F.col("status") == "DELETED")
    return as_known_join(events, rates, FX, event_id="proposal_id", entity="source_currency", at="created_at", date="document_date")


SQL["p7_found"] = """WITH e AS (SELECT DISTINCT proposal_id, source_currency, created_at, CAST(document_date AS DATE) AS d FROM proposals WHERE source_currency <> 'CHF'),
c AS (SELECT e.*, r.fx_rate_id, r.sequence, r.valid_from, r.valid_to, r.status, row_number() OVER (PARTITION BY proposal_id, valid_from ORDER BY sequence DESC, fx_rate_id) AS rn
  FROM e JOIN fx_rates r ON r.base = e.source_currency AND r.quote = 'CHF' AND r.rate_type = 'DAILY' AND r.published_at <= e.created_at),
w AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY sequence DESC, valid_from) AS best FROM c
  WHERE rn = 1 AND status <> 'DELETED' AND CAST(valid_from AS DATE) <= d AND (valid_to IS NULL OR d < CAST(valid_to AS DATE)))
SELECT proposal_id, fx_rate_id FROM w WHERE best = 1"""

QUERIES = {
    "p1_found": p1_found, "p1_messages": p1_messages, "p2_found": p2_found, "p2_suppliers": p2_suppliers, "p2_effects": p2_effects,
    "p3_found": p3_found, "p3_rejects": p3_rejects, **{f"p3_typed_{d}": _p3_typed(d) for d in HEADERS}, "p4_found": p4_found, "p4_quantities": p4_quantities,
    "p5_found": p5_found, "p5_report": p5_report, "p7_found": p7_found,
}


# -- SQL of 3 and 4 ---------------------------------------------------------------------
def _sql_number(v: str, dec: str = "dec", tho: str = "tho") -> str:
    """Canonical number text: ' groups, . separates; null if no accepted shape."""
    t = f"regexp_replace({v}, '^[A-Z]{{3}} +(.)', '\\1')"
    t = f"CASE WHEN {tho} IS NOT NULL AND {tho} <> '' AND {tho} <> {dec} THEN replace({t}, {tho}, chr(39)) ELSE {t} END"
    t = f"replace({t}, '’', chr(39))"
    t = f"CASE WHEN {dec} = ',' THEN replace(replace({t}, '.', '!'), ',', '.') ELSE {t} END"
    i = "(?:[0-9]{1,3}(?:''[0-9]{3})+|[0-9]+)"
    shape = rf"-?{i}(?:\.[0-9]+|\.-)?|{i}(?:\.[0-9]+)?-|\({i}(?:\.[0-9]+|\.-)?\)"
    return f"CASE WHEN {dec} IN ('.', ',') AND regexp_full_match({t}, '{shape}') THEN {t} END"


_DIALECT = """(SELECT batch_id, path, min_by(struct_pack(delimiter, decimal_separator, thousands_separator, date_format, header_line), receipt_id) AS x FROM file_receipts GROUP BY ALL)"""
_CUR = "('CHF','EUR','USD','GBP','SEK','DKK','NOK','HUF','IDR','JPY')"
_DATE = """((regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v AS DATE) IS NOT NULL) OR (dotted AND regexp_full_match(v, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}') AND try_strptime(v, '%d.%m.%Y') IS NOT NULL))"""
_P3 = f"""WITH r AS (SELECT record_id, line, outcome, dataset, raw_text, coalesce(x.delimiter, ',') AS d, coalesce(x.decimal_separator, '.') AS dec, x.thousands_separator AS tho,
  coalesce(x.date_format = 'DD.MM.YYYY', false) AS dotted, x.header_line AS h FROM records LEFT JOIN {_DIALECT} f ON f.batch_id = records.batch_id AND f.path = records.file),
t AS (SELECT *, string_split(h, d) AS names, regexp_extract_all(coalesce(raw_text, '') || d, CASE d WHEN ';' THEN '("(?:[^"]|"")*"|[^;]*);' WHEN ',' THEN '("(?:[^"]|"")*"|[^,]*),' ELSE '("(?:[^"]|"")*"|[^|]*)[|]' END, 1) AS cells FROM r),
c AS (SELECT record_id, line, outcome, dataset, dec, tho, dotted, len(cells) <> len(names) AS off, unnest(cells) AS raw, unnest(range(len(cells))) AS pos, unnest(list_transform(range(1, len(cells) + 1), lambda i: names[i])) AS name FROM t),
v AS (SELECT *, starts_with(raw, '"') AND NOT regexp_full_match(raw, '(?s)"(?:[^"]|"")*"') AS torn,
  {sql_trim("CASE WHEN starts_with(raw, '\"') THEN replace(raw[2:-2], '\"\"', '\"') ELSE raw END")} AS v FROM c),
k AS (SELECT *, CASE
  WHEN (dataset, name) IN (('supplier','supplier_number'),('supplier','name'),('purchase_order_line','po_number'),('purchase_order_line','line_no')) THEN v <> ''
  WHEN (dataset, name) IN (('supplier','currency'),('purchase_order_line','currency'),('fx_rate','base'),('fx_rate','quote')) THEN v IN {_CUR}
  WHEN (dataset, name) = ('supplier','country') THEN regexp_full_match(v, '([A-Z]{{2}})?')
  WHEN (dataset, name) IN (('supplier','payment_terms_days'),('supplier','change_seq'),('purchase_order_line','change_seq'),('fx_rate','rate_factor'),('fx_rate','sequence')) THEN regexp_full_match(v, '[0-9]+')
  WHEN (dataset, name) = ('supplier','blocked') THEN lower(v) IN ('','true','false','1','0')
  WHEN (dataset, name) = ('purchase_order_line','uom') THEN v IN ('EA','PCE','CTN','KG','G','L','M','STK','STD','PAU','M2','H','TON','PAL')
  WHEN (dataset, name) = ('fx_rate','rate_type') THEN v IN ('DAILY','MONTHLY_AVG') WHEN (dataset, name) = ('fx_rate','status') THEN v IN ('ACTIVE','DELETED')
  WHEN (dataset, name) = ('fx_rate','valid_from') THEN {_DATE} WHEN (dataset, name) = ('fx_rate','valid_to') THEN v = '' OR {_DATE}
  WHEN (dataset, name) IN (('purchase_order_line','quantity'),('purchase_order_line','unit_price'),('fx_rate','rate')) THEN ({_sql_number('v')}) IS NOT NULL ELSE true END AS ok FROM v)
"""
SQL["p3_found"] = _P3 + "SELECT record_id, CASE WHEN bool_or(torn) THEN 'quoting' WHEN bool_or(off) THEN 'column_count' ELSE 'value' END AS reason FROM k WHERE outcome IS NULL GROUP BY record_id HAVING bool_or(torn) OR bool_or(off) OR bool_or(NOT ok)"
_KINDS = {kind: "(" + ", ".join(f"('{d}', '{n}')" for d, n, k, _ in RULES if k == kind) + ")" for kind in ("digits", "number", "flag")}
_CODE = "CASE " + " ".join(f"WHEN (dataset, name) = ('{d}', '{n}') THEN '{code}'" for d, n, _, code in RULES) + " END"
_DIGITS = f"regexp_replace(regexp_replace({_sql_number('v')}, '[''()-]', '', 'g'), '(\\.[0-9]*?)0+$', '\\1')"
_P3_BAD = f""", g AS (SELECT *, CASE WHEN (dataset, name) IN {_KINDS['digits']} THEN try_cast(v AS BIGINT) IS NULL
  WHEN (dataset, name) IN {_KINDS['number']} THEN length(ltrim(split_part({_DIGITS}, '.', 1), '0')) > 26 OR length(split_part({_DIGITS}, '.', 2)) > 12 ELSE false END AS wide FROM k),
n AS (SELECT *, CASE WHEN torn THEN 1 WHEN off THEN 2 WHEN NOT ok THEN 3 WHEN wide THEN 4 END AS rk FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rk, pos) AS one FROM n WHERE rk IS NOT NULL)
"""
SQL["p3_rejects"] = _P3 + _P3_BAD + f"""SELECT record_id, line, 'rejected' AS outcome, CASE rk WHEN 1 THEN 'quoting' WHEN 2 THEN 'column_count' WHEN 3 THEN 'value' ELSE 'range' END AS reason,
  CASE rk WHEN 1 THEN CASE WHEN regexp_matches(raw, '(?s)^"(?:[^"]|"")*"[^"]') THEN 'E_FIELD_INVALID' ELSE 'E_MALFORMED_DOCUMENT' END WHEN 2 THEN 'E_FIELD_INVALID' ELSE {_CODE} END AS code,
  CASE WHEN rk >= 3 THEN name END AS field FROM b WHERE one = 1"""


def _p3_typed_sql(dataset: str) -> str:
    kinds = {n: k for d, n, k, _ in RULES if d == dataset}
    number = f"(CASE WHEN starts_with(num, '-') OR starts_with(num, '(') OR (ends_with(num, '-') AND NOT ends_with(num, '.-')) THEN -1 ELSE 1 END) * CAST({_DIGITS} AS DECIMAL(38,12))"
    forms = {"digits": "CAST(v AS BIGINT)", "number": f"CAST({number} AS DECIMAL(38,12))", "flag": "lower(v) IN ('true', '1')"}
    day = "coalesce(try_strptime(v, '%Y-%m-%d'), CASE WHEN dotted THEN try_strptime(v, '%d.%m.%Y') END)::DATE"
    cols = ", ".join(f"max(CASE WHEN name = '{n}' THEN {forms.get(kinds.get(n), day if kinds.get(n) in ('date', 'date_or_empty') else 'v')} END) AS {n}" for n in HEADERS[dataset])
    return _P3 + _P3_BAD + f"SELECT record_id, line, {cols} FROM (SELECT *, {_sql_number('v')} AS num FROM k WHERE dataset = '{dataset}' AND record_id NOT IN (SELECT record_id FROM b)) GROUP BY record_id, line"


SQL |= {f"p3_typed_{d}": _p3_typed_sql(d) for d in HEADERS}

#: the unit words of the sending systems, for the SQL only; the operator segments them
_WORDS = {
    "EA": "ea|each", "PCE": "pce|pc|pcs|piece|pieces|pièce|pièces", "CTN": "ctn|carton|cartons|karton|kartons|ktn", "KG": "kg|kgs|kilo|kilogramm|kilogram|kilograms", "G": "g|gr|gramm|gram|grams",
    "L": "l|ltr|liter|litre|litres", "M": "m|mtr|meter|metre|metres", "STK": "stk|stück|stueck", "STD": "std|stunde|stunden", "PAU": "pau|pausch|pauschal|pauschale|lump sum", "M2": "m2|m²|qm|sqm|quadratmeter",
    "H": "h|hrs|hour|hours|heures", "TON": "ton|t|to|tonne|tonnen|tonnes", "PAL": "pal|palette",
}
_UNIT = "CASE " + " ".join(f"WHEN regexp_full_match(w, '({p})\\.?') THEN '{c}'" for c, p in _WORDS.items()) + " END"
_SHAPE = "(?s)^((?:[A-Z]{3} +)?[^\\p{L}]*?)\\s*([\\p{L}].*)$"
SQL["p4_found"] = f"""WITH l AS (SELECT line_id, {sql_trim('material')} AS material, uom, quantity, {sql_trim('quantity')} AS q, coalesce(x.decimal_separator, '.') AS dec, x.thousands_separator AS tho,
  {sql_trim('description')} AS ds FROM purchase_order_lines p LEFT JOIN {_DIALECT} f USING (batch_id, path)),
s AS (SELECT *, CASE WHEN regexp_matches(q, '{_SHAPE}') THEN {sql_trim(f"regexp_extract(q, '{_SHAPE}', 1)")} ELSE q END AS num,
  lower(coalesce(nullif({sql_trim('uom')}, ''), CASE WHEN regexp_matches(q, '{_SHAPE}') THEN {sql_trim(f"regexp_extract(q, '{_SHAPE}', 2)")} END, nullif({sql_trim("regexp_extract(ds, '^\\[([^\\]]+)\\]', 1)")}, ''),
    nullif({sql_trim("regexp_extract(ds, '(?:Einheit: |unit: |ME=|qty in |Menge in |quantité en )([^)]+)', 1)")}, ''))) AS w FROM l),
n AS (SELECT *, {_UNIT} AS unit, {_sql_number('num')} AS c FROM s),
m AS (SELECT *, (CASE WHEN starts_with(c, '-') OR starts_with(c, '(') OR (ends_with(c, '-') AND NOT ends_with(c, '.-')) THEN -1 ELSE 1 END) * CAST(regexp_replace(c, '[''()-]', '', 'g') AS DECIMAL(38,12)) AS v FROM n WHERE unit IS NOT NULL AND c IS NOT NULL),
b AS (SELECT m.*, coalesce(a.base_uom, g.base_uom) AS base_uom, coalesce(a.numerator, g.numerator) AS nu, coalesce(a.denominator, g.denominator) AS de FROM m
  LEFT JOIN uom_conversions a ON a.material = m.material AND a.alt_uom = m.unit LEFT JOIN uom_conversions g ON g.material IS NULL AND g.alt_uom = m.unit),
e AS (SELECT *, CAST(v * 1000000 AS HUGEINT) * nu AS top, CAST(de AS HUGEINT) * 1000 AS bottom FROM b WHERE base_uom IS NOT NULL)
SELECT line_id, base_uom, CAST(top // bottom AS BIGINT) AS base_milli FROM e WHERE top % bottom = 0
  AND NOT coalesce(uom IN ('EA','KG','L','M','STD','PAU','M2') AND regexp_full_match(quantity, '[0-9]+(\\.[0-9]+)?') AND dec = '.', false)"""
SQL["p4_quantities"] = SQL["p4_found"].rpartition("\nSELECT line_id")[0] + """
SELECT line_id, unit, base_uom, CAST(top // bottom AS BIGINT) AS base_milli,
  coalesce(uom IN ('EA','KG','L','M','STD','PAU','M2') AND regexp_full_match(quantity, '[0-9]+(\\.[0-9]+)?') AND dec = '.', false) AS plain FROM e WHERE top % bottom = 0"""
