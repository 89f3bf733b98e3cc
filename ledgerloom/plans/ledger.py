"""Further queries of the inventory: sequences, budgets, chains, assertions, projections, with their SQL.

The comment behind each names the inventory ids it does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import numbers as N
from ..functions import text as X
from ..operators import folds
from ..operators import lookups as L
from ..operators import ordered as O
from ..operators.cells import day_cells, span_cells
from ..operators.record_split import RULES, dialects
from ..session import table
from .payables import _DIALECT, _sql_number, _sql_order, sql_trim

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- sequences over several datasets -------------------------------------------------------------
_MASTERS = [("cost_centers", "code", "cc_row_id", "blocked"), ("purchase_orders", "po_number", "po_row_id", "status = 'CLOSED'"), ("suppliers", "supplier_number", "change_id", "blocked")]


def _masters(spark, sf) -> DataFrame:
    return _union(table(spark, sf, t).select(F.lit(rank).alias("dataset_rank"), F.lit(t).alias("dataset"), F.col(k).alias("key"), F.col(i).alias("row_id"), F.coalesce(F.expr(late), F.lit(False)).alias("moved")) for rank, (t, k, i, late) in enumerate(_MASTERS))


_SQL_MASTERS = " UNION ALL ".join(f"SELECT {r} AS dataset_rank, '{t}' AS dataset, {k} AS key, {i} AS row_id, coalesce({late}, false) AS moved FROM {t}" for r, (t, k, i, late) in enumerate(_MASTERS))
_SEQUENCE = f"SELECT dataset, row_id, CAST(row_number() OVER (ORDER BY moved, dataset_rank, key NULLS FIRST, row_id) AS BIGINT) AS change_seq FROM ({_SQL_MASTERS})"


@query(_SEQUENCE)
def global_sequence(spark, sf):  # GEN-01: one dense sequence over three datasets, a chosen subset moved to its end
    return O.dense_number(_masters(spark, sf), ["moved", "dataset_rank", "key", "row_id"], "change_seq").select("dataset", "row_id", "change_seq")


@query(f"""WITH b AS (SELECT max(change_seq) AS top FROM purchase_orders), d AS (SELECT dataset, row_id, row_number() OVER (ORDER BY dataset <> 'suppliers', dataset_rank, key NULLS FIRST, row_id) AS n FROM ({_SQL_MASTERS}) WHERE moved)
SELECT dataset, row_id, CAST(top + n AS BIGINT) AS change_seq FROM d, b""")
def delta_sequence(spark, sf):  # GEN-02: changed rows numbered above the base's maximum, the boundary dataset first
    top = table(spark, sf, "purchase_orders").agg(F.max("change_seq")).first()[0] or 0
    d = _masters(spark, sf).where("moved").withColumn("behind", F.col("dataset") != "suppliers")
    return O.dense_number(d, ["behind", "dataset_rank", "key", "row_id"]).select("dataset", "row_id", (F.col("n") + top).alias("change_seq"))


_DEFECTS = ["missing_po", "closed_po", "foreign_po", "blocked_supplier", "totals", "cost_center", "deleted_currency", "rate_gap", "pallet", "inexact", "no_rates", "over_billing"]


@query("""WITH n AS (SELECT proposal_id, row_number() OVER (ORDER BY proposal_id) - 1 AS n FROM (SELECT DISTINCT proposal_id FROM proposals)),
d AS (SELECT *, ((n + 1) * 140) // 1000 AS k FROM n WHERE ((n + 1) * 140) // 1000 > (n * 140) // 1000)
SELECT proposal_id, [""" + ", ".join(f"'{d}'" for d in _DEFECTS) + """][CAST((k - 1) % 12 AS INTEGER) + 1] AS defect FROM d""")
def defect_plan(spark, sf):  # GEN-09: 140 of 1000 at even strides, twelve classes in turn
    d = O.dense_number(table(spark, sf, "proposals").select("proposal_id").distinct(), ["proposal_id"])
    k = F.expr("(n * 140) div 1000")
    d = d.withColumn("k", k).where(F.col("k") > F.expr("((n - 1) * 140) div 1000"))
    return d.select("proposal_id", F.get(F.array(*map(F.lit, _DEFECTS)), ((F.col("k") - 1) % 12).cast("int")).alias("defect"))


@query(f"""SELECT po_row_id, CASE po_row_id % 4 WHEN 0 THEN k WHEN 1 THEN 'PO-' || k WHEN 2 THEN lpad(k, greatest(12, CAST(length(k) AS INTEGER)), '0') ELSE k || '/00010' END AS spelling FROM (SELECT po_row_id, {_sql_order('po_number')} AS k FROM purchase_orders)""")
def order_spellings(spark, sf):  # GEN-10: a spelling by index
    o = table(spark, sf, "purchase_orders").select("po_row_id", X.canonical_order_number(F.col("po_number")).alias("k"))
    i = F.col("po_row_id") % 4
    wide = F.when(F.length("k") >= 12, F.col("k")).otherwise(F.lpad("k", 12, "0"))
    return o.select("po_row_id", F.when(i == 0, F.col("k")).when(i == 1, F.concat(F.lit("PO-"), "k")).when(i == 2, wide).otherwise(F.concat("k", F.lit("/00010"))).alias("spelling"))


def _sql_fnv(text: str) -> str:
    """FNV-1a, 64 bits, of an ASCII text."""
    parts = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS HUGEINT))"
    return f"list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), {parts}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


_FNV_EVENT = _sql_fnv("event_type || ':' || CAST(event_id AS VARCHAR)")


@query(f"SELECT event_id, CAST({_FNV_EVENT} % 23 AS BIGINT) AS bucket, CAST({_FNV_EVENT} % 37 AS BIGINT) AS second FROM events")
def fault_buckets(spark, sf):  # STR-05: two moduli of one content hash
    t = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", H.fnv1a64_mod(23)(t).alias("bucket"), H.fnv1a64_mod(37)(t).alias("second"))


@query(f"SELECT proposal_id, ['plain', 'grouped', 'trailing', 'prefixed'][CAST({_sql_fnv('proposal_id')} % 2147483648 % 4 AS INTEGER) + 1] AS variant FROM (SELECT DISTINCT proposal_id FROM proposals)")
def stable_variants(spark, sf):  # GEN-06: the variant follows from the content, by 31 bits of the hash
    p = table(spark, sf, "proposals").select("proposal_id").distinct()
    return p.select("proposal_id", F.get(F.array(*map(F.lit, ["plain", "grouped", "trailing", "prefixed"])), (H.fnv1a64_mod(2**31)("proposal_id") % 4).cast("int")).alias("variant"))


@query("SELECT posting_id FROM (SELECT posting_id FROM postings ORDER BY sha256(CAST(posting_id AS VARCHAR)), posting_id LIMIT 40) ORDER BY posting_id")
def picked_postings(spark, sf):  # GEN-07: the operator is a pick of k distinct rows, ascending
    p = table(spark, sf, "postings").select("posting_id", F.sha2(F.col("posting_id").cast("string"), 256).alias("h"))
    return p.orderBy("h", "posting_id").limit(40).select("posting_id").orderBy("posting_id")


@query("SELECT posting_id, array_to_string(list_sort(string_split(idempotency_key, ':')), '|') AS signature FROM postings WHERE idempotency_key IS NOT NULL")
def request_signatures(spark, sf):  # GEN-11: the references of a request, sorted
    p = table(spark, sf, "postings").where("idempotency_key is not null")
    return p.select("posting_id", F.array_join(F.array_sort(F.split("idempotency_key", ":")), "|").alias("signature"))


@query("""SELECT company_code, 'orders_' || lower(company_code) || '.csv' AS path, CAST(count(*) AS BIGINT) AS n FROM purchase_orders WHERE company_code IN ('CH10', 'CH20') GROUP BY ALL""")
def company_split(spark, sf):  # GEN-05: one file per company code, by two filters over one scan
    o = table(spark, sf, "purchase_orders")
    one = lambda c: o.where(F.col("company_code") == c).groupBy("company_code").agg(F.lit(f"orders_{c.lower()}.csv").alias("path"), F.count("*").alias("n"))
    return one("CH10").unionByName(one("CH20"))


_LINES = f"""(SELECT line_id, {_sql_order('po_number')} AS k, {sql_trim('line_no')} AS line_no, coalesce(x.decimal_separator, '.') AS dec, x.thousands_separator AS tho, {sql_trim('quantity')} AS quantity, {sql_trim('unit_price')} AS unit_price
 FROM purchase_order_lines p LEFT JOIN {_DIALECT} f USING (batch_id, path))"""


def _sql_value(c: str) -> str:
    n = f"({_sql_number(c)})"
    return f"(CASE WHEN {n} IS NULL THEN NULL ELSE (CASE WHEN starts_with({n}, '-') OR starts_with({n}, '(') OR (ends_with({n}, '-') AND NOT ends_with({n}, '.-')) THEN -1 ELSE 1 END) * try_cast(regexp_replace({n}, '[''()-]', '', 'g') AS DECIMAL(18,6)) END)"


def _amounts(spark, sf) -> DataFrame:
    """line_id, k, line_no, q, p: order lines with quantity and price as numbers, null where they are none."""
    d = dialects(table(spark, sf, "file_receipts")).select("batch_id", "path", "decimal_separator", "thousands_separator")
    l = table(spark, sf, "purchase_order_lines").join(d, ["batch_id", "path"], "left")
    num = lambda c: N.parse_number(X.trim_ws(F.col(c)), F.col("decimal_separator"), F.col("thousands_separator")).try_cast("decimal(18,6)")
    return l.select("line_id", X.canonical_order_number(F.col("po_number")).alias("k"), X.trim_ws(F.col("line_no")).alias("line_no"), num("quantity").alias("q"), num("unit_price").alias("p"))


_NET = "CAST(sum(CAST((CASE WHEN (q < 0) <> (p < 0) THEN -1 ELSE 1 END) * (abs(CAST(q * 1000000 AS HUGEINT) * CAST(p * 1000000 AS HUGEINT)) + 5000000000) // 10000000000 AS DECIMAL(30,0))) AS DECIMAL(38,0))"


@query(f"""SELECT k AS order_key, CAST(count(*) AS BIGINT) AS lines, {_NET} AS net_cents FROM (SELECT k, {_sql_value('quantity')} AS q, {_sql_value('unit_price')} AS p FROM {_LINES}) WHERE k IS NOT NULL AND q IS NOT NULL AND p IS NOT NULL GROUP BY 1""")
def order_totals(spark, sf):  # AGG-05: each line's net to cents, half away from zero, then summed by canonical order number
    a = _amounts(spark, sf).where("k is not null and q is not null and p is not null")
    return a.groupBy(F.col("k").alias("order_key")).agg(F.count("*").alias("lines"), F.sum(_cents()).cast("decimal(38,0)").alias("net_cents"))


def _cents():
    """Cents of q * p: both have six decimals, so the product has twelve; half away from zero."""
    micro = (F.col("q") * 1000000).cast("decimal(18,0)") * (F.col("p") * 1000000).cast("decimal(18,0)")
    a = F.abs(micro).cast("decimal(37,0)")
    down = ((a + F.lit(5000000000)) - (a + F.lit(5000000000)) % F.lit(10000000000)) / F.lit(10000000000)
    return F.when(micro < 0, -down).otherwise(down).cast("decimal(28,0)")


@query(f"""WITH a AS (SELECT line_id, k, line_no, {_sql_value('quantity')} AS q, {_sql_value('unit_price')} AS p FROM {_LINES}), f AS (SELECT k, min({{'n': line_no, 'i': line_id}}).i AS first FROM a WHERE k IS NOT NULL AND line_no IS NOT NULL GROUP BY 1),
m AS (SELECT a.k, q + CASE WHEN line_id = first THEN 1 ELSE 0 END AS q, p FROM a JOIN f USING (k)) SELECT k AS order_key, {_NET} AS amended_cents FROM m WHERE q IS NOT NULL AND p IS NOT NULL GROUP BY 1""")
def amended_totals(spark, sf):  # GEN-04: one unit more on the first line of each order, totals anew
    a = _amounts(spark, sf).where("k is not null")
    first = a.where("line_no is not null").groupBy("k").agg(F.min(F.struct("line_no", "line_id")).alias("f")).select("k", F.col("f.line_id").alias("first"))
    m = a.join(first, "k").withColumn("q", (F.col("q") + F.when(F.col("line_id") == F.col("first"), 1).otherwise(0)).cast("decimal(18,6)")).where("q is not null and p is not null")
    return m.groupBy(F.col("k").alias("order_key")).agg(F.sum(_cents()).cast("decimal(38,0)").alias("amended_cents"))


# -- joins and chains ----------------------------------------------------------------------------
@query(f"""WITH l AS (SELECT line_id, {_sql_order('po_number')} AS k, {sql_trim('line_no')} AS n, material, received_at FROM purchase_order_lines),
f AS (SELECT k, n, min({{'t': received_at, 'i': line_id, 'm': material}}) AS x FROM l WHERE k IS NOT NULL AND n IS NOT NULL GROUP BY ALL)
SELECT line_id, f.x.i AS first_line_id, f.x.m AS first_material FROM l LEFT JOIN f USING (k, n)""")
def line_of_order_line(spark, sf):  # JN-03: (order, line number) of each delivered line to the line first delivered under it
    l = table(spark, sf, "purchase_order_lines").select("line_id", X.canonical_order_number(F.col("po_number")).alias("k"), X.trim_ws(F.col("line_no")).alias("n"), "material", "received_at")
    f = l.where("k is not null and n is not null").groupBy("k", "n").agg(F.min(F.struct("received_at", "line_id", "material")).alias("x"))
    return l.join(f, ["k", "n"], "left").select("line_id", F.col("x.line_id").alias("first_line_id"), F.col("x.material").alias("first_material"))


@query(f"""WITH o AS (SELECT {_sql_order('po_number')} AS k, min(po_row_id) AS po_row_id FROM purchase_orders WHERE po_number IS NOT NULL GROUP BY 1),
l AS (SELECT {_sql_order('po_number')} AS k, count(*) AS n FROM purchase_order_lines WHERE po_number IS NOT NULL GROUP BY 1), h AS (SELECT DISTINCT matched_po AS r, {_sql_order('matched_po')} AS k FROM proposals WHERE matched_po IS NOT NULL)
SELECT h.r AS reference, o.po_row_id, CAST(coalesce(l.n, 0) AS BIGINT) AS lines, CASE WHEN l.n IS NOT NULL THEN 'separate' WHEN o.k IS NOT NULL THEN 'none' ELSE 'unknown' END AS source FROM h LEFT JOIN o USING (k) LEFT JOIN l USING (k)""")
def proposal_lines(spark, sf):  # JN-11: parents by canonical number, lines counted apart, unknown parents kept
    canon = lambda c: X.canonical_order_number(F.col(c))
    o = table(spark, sf, "purchase_orders").where("po_number is not null").groupBy(canon("po_number").alias("k")).agg(F.min("po_row_id").alias("po_row_id"))
    l = table(spark, sf, "purchase_order_lines").where("po_number is not null").groupBy(canon("po_number").alias("k")).agg(F.count("*").alias("n"))
    h = table(spark, sf, "proposals").where("matched_po is not null").select(F.col("matched_po").alias("reference"), canon("matched_po").alias("k")).distinct()
    j = h.join(o, "k", "left").join(l, "k", "left")
    source = F.when(F.col("n").isNotNull(), "separate").when(F.col("po_row_id").isNotNull(), "none").otherwise("unknown")
    return j.select("reference", "po_row_id", F.coalesce("n", F.lit(0)).alias("lines"), source.alias("source"))


@query("""WITH p AS (SELECT invoice_key, count(DISTINCT proposal_id) AS proposals, count(*) AS revisions, count(DISTINCT source_batch_id) AS sources, count(*) FILTER (WHERE status = 'needs_investigation') AS exceptions FROM proposals WHERE invoice_key IS NOT NULL GROUP BY 1),
m AS (SELECT DISTINCT proposal_id, invoice_key FROM proposals WHERE invoice_key IS NOT NULL), d AS (SELECT invoice_key, count(*) AS postings, count(DISTINCT erp_document_number) AS documents FROM postings JOIN m USING (proposal_id) GROUP BY 1)
SELECT invoice_key, CAST(proposals AS BIGINT) AS proposals, CAST(revisions AS BIGINT) AS revisions, CAST(sources AS BIGINT) AS sources, CAST(exceptions AS BIGINT) AS exceptions, CAST(coalesce(postings, 0) AS BIGINT) AS postings, CAST(coalesce(documents, 0) AS BIGINT) AS documents FROM p LEFT JOIN d USING (invoice_key)""")
def audit_chain(spark, sf):  # JN-12, CMP-02: an invoice with its revisions, sources, proposals, exceptions, postings and documents
    p = table(spark, sf, "proposals").where("invoice_key is not null")
    g = p.groupBy("invoice_key").agg(F.countDistinct("proposal_id").alias("proposals"), F.count("*").alias("revisions"), F.countDistinct("source_batch_id").alias("sources"), F.count(F.when(F.col("status") == "needs_investigation", 1)).alias("exceptions"))
    d = table(spark, sf, "postings").join(p.select("proposal_id", "invoice_key").distinct(), "proposal_id").groupBy("invoice_key").agg(F.count("*").alias("postings"), F.countDistinct("erp_document_number").alias("documents"))
    return g.join(d, "invoice_key", "left").na.fill(0, ["postings", "documents"])


@query("""WITH m AS (SELECT DISTINCT proposal_id, invoice_key FROM proposals) SELECT posting_id, coalesce(supplier_number || chr(31) || supplier_invoice_number, m.invoice_key) AS subject, m.invoice_key IS NULL AS broken FROM postings LEFT JOIN m USING (proposal_id)""")
def posting_subjects(spark, sf):  # JN-14, JN-15: the invoice of a posting, its own or by its proposal; rows whose chain is broken
    m = table(spark, sf, "proposals").select("proposal_id", "invoice_key").distinct()
    own = F.concat("supplier_number", F.lit(X.UNIT_SEPARATOR), "supplier_invoice_number")
    return table(spark, sf, "postings").join(m, "proposal_id", "left").select("posting_id", F.coalesce(own, "invoice_key").alias("subject"), F.col("invoice_key").isNull().alias("broken"))


@query(f"""SELECT DISTINCT k AS order_key FROM (SELECT {_sql_order('po_number')} AS k FROM purchase_order_lines WHERE received_at >= TIMESTAMP '2026-06-01' UNION ALL SELECT {_sql_order('po_number')} FROM purchase_orders WHERE received_at >= TIMESTAMP '2026-06-01') WHERE k IS NOT NULL""")
def orders_to_match_again(spark, sf):  # UPD-05: a change of an order or of any of its lines
    new = lambda t: table(spark, sf, t).where(F.col("received_at") >= F.lit("2026-06-01").cast("timestamp_ntz")).select(X.canonical_order_number(F.col("po_number")).alias("order_key"))
    return new("purchase_order_lines").union(new("purchase_orders")).where("order_key is not null").distinct()


# -- requests: filters, budgets, costs --------------------------------------------------------------
_CLASS = "CASE WHEN http_status IS NULL THEN 'none' WHEN http_status IN (401, 403, 409, 429, 503) THEN 'refused' WHEN http_status < 300 THEN 'done' WHEN http_status < 500 THEN 'client' ELSE 'server' END"


@query(f"SELECT batch_id, {_CLASS} AS class, http_status IS NOT NULL AND http_status NOT IN (401, 403, 409, 429, 503) AS reached, CAST(count(*) AS BIGINT) AS n FROM postings GROUP BY ALL")
def requests_by_class(spark, sf):  # FLT-04, FLT-05, CMP-16: by status class and whether the handler was reached
    s = F.col("http_status")
    kind = F.when(s.isNull(), "none").when(s.isin(401, 403, 409, 429, 503), "refused").when(s < 300, "done").when(s < 500, "client").otherwise("server")
    reached = F.coalesce(~s.isin(401, 403, 409, 429, 503), F.lit(False))
    return table(spark, sf, "postings").groupBy("batch_id", kind.alias("class"), reached.alias("reached")).agg(F.count("*").alias("n"))


_RETRY = f"""WITH a AS (SELECT posting_id, batch_id, {sql_trim('idempotency_key')} AS k, received_at, http_status FROM postings WHERE idempotency_key IS NOT NULL),
f AS (SELECT batch_id, k, min({{'t': received_at, 'i': posting_id}}) FILTER (WHERE http_status < 300) AS done, min({{'t': received_at, 'i': posting_id}}) FILTER (WHERE http_status BETWEEN 400 AND 499 AND http_status NOT IN (401, 408, 409, 425, 429)) AS final FROM a GROUP BY ALL)
"""


@query(_RETRY + """SELECT a.posting_id, CASE WHEN {'t': received_at, 'i': posting_id} > done THEN 'after_success' ELSE 'after_refusal' END AS kind FROM a JOIN f USING (batch_id, k) WHERE {'t': received_at, 'i': posting_id} > done OR {'t': received_at, 'i': posting_id} > final""")
def retries_within_batch(spark, sf):  # WIN-09, CMP-12, FLT-05: inside one invocation, attempts after the first success or after a refusal that no retry mends
    p = table(spark, sf, "postings").where("idempotency_key is not null").select("posting_id", "batch_id", X.trim_ws(F.col("idempotency_key")).alias("k"), F.struct("received_at", "posting_id").alias("at"), "http_status")
    s = F.col("http_status")
    g = p.groupBy("batch_id", "k").agg(F.min(F.when(s < 300, F.col("at"))).alias("done"), F.min(F.when(s.between(400, 499) & ~s.isin(401, 408, 409, 425, 429), F.col("at"))).alias("final"))
    after = lambda c: F.coalesce(F.col("at") > F.col(c), F.lit(False))
    return p.join(g, ["batch_id", "k"]).where(after("done") | after("final")).select("posting_id", F.when(after("done"), "after_success").otherwise("after_refusal").alias("kind"))


_BUDGET = {"posted": 400, "rejected": 50, "failed": 20}


@query("SELECT batch_id, erp_status, CAST(n AS BIGINT) AS n, b AS budget, n > b AS exceeded, CAST(n * 1000 // sum(n) OVER (PARTITION BY batch_id) AS BIGINT) AS share_milli FROM (SELECT batch_id, erp_status, count(*) AS n FROM postings GROUP BY ALL) JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _BUDGET.items()) + ") t(erp_status, b) USING (erp_status)")
def request_budgets(spark, sf):  # CMP-08, AGG-17: requests of a route against its budget, and its share of all that have one
    b = spark.createDataFrame(list(_BUDGET.items()), "erp_status string, budget int")
    g = table(spark, sf, "postings").groupBy("batch_id", "erp_status").agg(F.count("*").alias("n")).join(b, "erp_status")
    t = g.groupBy("batch_id").agg(F.sum("n").alias("t"))
    return g.join(t, "batch_id").select("batch_id", "erp_status", "n", "budget", (F.col("n") > F.col("budget")).alias("exceeded"), F.expr("n * 1000 div t").alias("share_milli"))


_COST = {"view": (40, 0.5), "click": (20, 0.0), "purchase": (60, 8.0), "signup": (30, 0.1)}


@query("SELECT event_type, CAST(sum(base + per * CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DECIMAL(28,1)) AS vms FROM events JOIN (VALUES " + ", ".join(f"('{k}', CAST({b} AS DECIMAL(8,1)), CAST({p} AS DECIMAL(8,1)))" for k, (b, p) in _COST.items()) + ") c(event_type, base, per) USING (event_type) GROUP BY 1")
def request_costs(spark, sf):  # STR-06: a base and a cost per record, from a small table
    c = spark.createDataFrame([(k, float(b), float(p)) for k, (b, p) in _COST.items()], "event_type string, base double, per double").select("event_type", F.col("base").cast("decimal(8,1)").alias("base"), F.col("per").cast("decimal(8,1)").alias("per"))
    n = F.get_json_object("props", "$.k").try_cast("decimal(18,0)")
    return table(spark, sf, "events").join(c, "event_type").groupBy("event_type").agg(F.sum(F.col("base") + F.col("per") * n).cast("decimal(28,1)").alias("vms"))


@query()
def request_governor(spark, sf):  # STR-04, WIN-08: quota, then quarantine, then bucket; brute force in the tests
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return folds.governed(e, "user_id", ["event_id"], ["event_id", "user_id"], "ms", quota=60, strikes=5, capacity=3, per_ms=3_600_000)


@query()
def chunk_ingest(spark, sf):  # SRC-16: rising ordinals per source system; brute force in the tests
    f = table(spark, sf, "file_receipts").select("receipt_id", "source_system", "batch_sequence", "batch_id", F.coalesce("sha256", F.lit("")).alias("sha256"))
    return folds.chunk_outcomes(f, "source_system", ["receipt_id"], ["receipt_id", "source_system"], "batch_sequence", "batch_id", "sha256")


# -- aggregates and assertions ------------------------------------------------------------------------
_CODES = sorted({c for *_, c in RULES} | {"E_MALFORMED_DOCUMENT"})


@query("SELECT code, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES " + ", ".join(f"('{c}')" for c in _CODES) + ") c(code) LEFT JOIN (SELECT code, count(*) AS n FROM records GROUP BY 1) USING (code)")
def code_counts(spark, sf):  # AGG-03: the closed set of codes, zero filled
    codes = spark.createDataFrame([(c,) for c in _CODES], "code string")
    return codes.join(table(spark, sf, "records").groupBy("code").agg(F.count("*").alias("n")), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH p AS (SELECT invoice_key, bool_or(matched_po IS NOT NULL) AS matched, bool_or(status = 'pending') AS pending, bool_or(status = 'needs_investigation') AS exception FROM proposals WHERE invoice_key IS NOT NULL GROUP BY 1),
q AS (SELECT DISTINCT invoice_key FROM proposals JOIN postings USING (proposal_id) WHERE erp_status = 'posted' AND invoice_key IS NOT NULL)
SELECT stage, CAST(n AS BIGINT) AS n FROM (SELECT 'ingested' AS stage, count(*) AS n FROM p UNION ALL SELECT 'matched', count(*) FROM p WHERE matched UNION ALL SELECT 'pending', count(*) FROM p WHERE pending UNION ALL SELECT 'posted', count(*) FROM q UNION ALL SELECT 'exception', count(*) FROM p WHERE exception)""")
def invoice_funnel(spark, sf):  # AGG-04: all stages
    p = table(spark, sf, "proposals").where("invoice_key is not null")
    q = table(spark, sf, "postings").where("erp_status = 'posted'").select("proposal_id").distinct().withColumn("posted", F.lit(True))
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)))
    g = p.join(q, "proposal_id", "left").groupBy("invoice_key").agg(yes(F.col("matched_po").isNotNull()).alias("matched"), yes(F.col("status") == "pending").alias("pending"), yes(F.col("posted")).alias("posted"), yes(F.col("status") == "needs_investigation").alias("exception"))
    stages = F.array(F.lit("ingested"), *[F.when(F.col(c), c) for c in ("matched", "pending", "posted", "exception")])
    one = g.select(F.explode(F.array_compact(stages)).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s,) for s in ("ingested", "matched", "pending", "posted", "exception")], "stage string")
    return names.join(one, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH d AS (SELECT batch_id, file, record_id, code, row_number() OVER (PARTITION BY batch_id, file ORDER BY line, record_id) AS n, count(*) OVER (PARTITION BY batch_id, file) AS total FROM records WHERE code IS NOT NULL)
SELECT batch_id, file, record_id, code, total = 0 AS accepted FROM d WHERE n <= 3 UNION ALL SELECT DISTINCT batch_id, file, CAST(NULL AS BIGINT), 'E_TRUNCATED', false FROM d WHERE total > 3""")
def capped_diagnostics(spark, sf):  # AGG-19: the first three of a file (the cap is the feature) and a row that says there are more; accepted looks at all
    r = table(spark, sf, "records").where("code is not null").select("batch_id", "file", "record_id", "code", "line")
    top = O.top_per_group(r, ["batch_id", "file"], ["line", "record_id"], 3).select("batch_id", "file", "record_id", "code", F.lit(False).alias("accepted"))
    more = r.groupBy("batch_id", "file").agg(F.count("*").alias("n")).where("n > 3").select("batch_id", "file", F.lit(None).cast("bigint").alias("record_id"), F.lit("E_TRUNCATED").alias("code"), F.lit(False).alias("accepted"))
    return top.unionByName(more)


@query("""WITH p AS (SELECT idempotency_key, unnest(string_split(idempotency_key, ':')) AS ref, posting_id FROM postings WHERE idempotency_key IS NOT NULL) SELECT ref, CAST(count(*) AS BIGINT) AS attempts FROM p WHERE starts_with(ref, 'prp_') GROUP BY 1""")
def attempts_of_references(spark, sf):  # AGG-11: the references in a request, exploded and counted
    p = table(spark, sf, "postings").where("idempotency_key is not null").select(F.explode(F.split("idempotency_key", ":")).alias("ref"))
    return p.where(F.col("ref").startswith("prp_")).groupBy("ref").agg(F.count("*").alias("attempts"))


@query("""SELECT batch_id, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE declared IS DISTINCT FROM parsed) AS BIGINT) AS unequal,
count(*) FILTER (WHERE status = 'pending' OR declared IS DISTINCT FROM parsed) = 0 AS complete FROM (SELECT batch_id, path, max_by(status, receipt_id) AS status, max_by(coalesce(try_cast(declared_records AS BIGINT), -1), receipt_id) AS declared, max_by(coalesce(parsed_records, -1), receipt_id) AS parsed FROM file_receipts GROUP BY ALL) GROUP BY 1""")
def batch_completeness(spark, sf):  # CMP-15, CMP-01, RUL-12: whether every file of a batch has its receipt and counts
    last = lambda c: F.max_by(c, "receipt_id")
    f = table(spark, sf, "file_receipts").groupBy("batch_id", "path").agg(last("status").alias("status"), last(F.coalesce(F.col("declared_records").try_cast("bigint"), F.lit(-1))).alias("declared"), last(F.coalesce("parsed_records", F.lit(-1))).alias("parsed"))
    bad, diff = F.col("status") == "pending", F.col("declared") != F.col("parsed")
    return f.groupBy("batch_id").agg(F.count("*").alias("files"), F.count(F.when(bad, 1)).alias("pending"), F.count(F.when(diff, 1)).alias("unequal"), (F.count(F.when(bad | diff, 1)) == 0).alias("complete"))


@query("""SELECT batch_id, file, bool_and(outcome IS NOT NULL) AS judged, bool_and(coalesce(code NOT IN ('E_MALFORMED_DOCUMENT', 'E_ENCODING'), true)) AS no_fatal, bool_and(code IS NULL) AND bool_and(outcome IS NOT NULL) AS accepted FROM records GROUP BY ALL""")
def file_acceptance(spark, sf):  # RUL-13: accepted without a fatal finding, a reject, or an open record
    code = F.col("code")
    none, judged = F.bool_and(code.isNull()), F.bool_and(F.col("outcome").isNotNull())
    return table(spark, sf, "records").groupBy("batch_id", "file").agg(judged.alias("judged"), F.bool_and(F.coalesce(~code.isin("E_MALFORMED_DOCUMENT", "E_ENCODING"), F.lit(True))).alias("no_fatal"), (none & judged).alias("accepted"))


@query("""SELECT record_id, CASE WHEN bool_or(coalesce(r.outcome = 'rejected', false)) OVER (PARTITION BY r.batch_id) THEN 'rejected' ELSE r.outcome END AS outcome FROM records r WHERE outcome IS NOT NULL""")
def aborted_batches(spark, sf):  # UPD-07: one reject rejects the batch; the flag is joined back, one row a batch
    r = table(spark, sf, "records").where("outcome is not null").select("record_id", "batch_id", "outcome")
    bad = r.groupBy("batch_id").agg(F.max(F.col("outcome") == "rejected").alias("bad"))
    return r.join(bad, "batch_id").select("record_id", F.when(F.col("bad"), "rejected").otherwise(F.col("outcome")).alias("outcome"))


@query("""WITH a AS (SELECT DISTINCT batch_id, file AS path FROM records WHERE outcome = 'rejected'), b AS (SELECT DISTINCT batch_id, path FROM file_receipts WHERE rejected > 0), f AS (SELECT DISTINCT batch_id, path FROM file_receipts WHERE status <> 'pending')
SELECT f.batch_id, f.path, a.path IS NOT NULL AS in_records, b.path IS NOT NULL AS in_receipts FROM f LEFT JOIN a USING (batch_id, path) LEFT JOIN b USING (batch_id, path)""")
def reject_containment(spark, sf):  # SET-06: rejects in the records and in the receipts, both directions, pending files aside
    flag = lambda d, name: d.select("batch_id", "path").distinct().withColumn(name, F.lit(True))
    a = flag(table(spark, sf, "records").where("outcome = 'rejected'").withColumnRenamed("file", "path"), "in_records")
    b = flag(table(spark, sf, "file_receipts").where("rejected > 0"), "in_receipts")
    f = table(spark, sf, "file_receipts").where("status <> 'pending'").select("batch_id", "path").distinct()
    return f.join(a, ["batch_id", "path"], "left").join(b, ["batch_id", "path"], "left").na.fill(False, ["in_records", "in_receipts"])


@query("""SELECT b.batch_id, coalesce(r.n, 0) + coalesce(l.n, 0) > 0 AS active FROM (SELECT DISTINCT batch_id FROM file_receipts) b LEFT JOIN (SELECT batch_id, count(*) AS n FROM records GROUP BY 1) r USING (batch_id) LEFT JOIN (SELECT batch_id, count(*) AS n FROM purchase_order_lines GROUP BY 1) l USING (batch_id)""")
def vacuity(spark, sf):  # CMP-18: whether a batch brought anything at all
    seen = table(spark, sf, "records").select("batch_id").union(table(spark, sf, "purchase_order_lines").select("batch_id")).distinct().withColumn("active", F.lit(True))
    return table(spark, sf, "file_receipts").select("batch_id").distinct().join(seen, "batch_id", "left").select("batch_id", F.coalesce("active", F.lit(False)).alias("active"))


_REPORT = {"receipt_id": "bigint", "batch_id": "string", "declared_records": "bigint", "seen": "bigint", "closed_at": "timestamp", "status": "string", "replay": "boolean"}


@query("SELECT * FROM (VALUES ('closed_at', 'missing'), ('declared_records', 'type')) t(field, finding) WHERE field = 'closed_at' OR (SELECT typeof(max(declared_records)) FROM file_receipts) <> 'BIGINT'")
def report_schema(spark, sf):  # CMP-13: required columns and their types against a report
    have = {f.name: f.dataType.simpleString() for f in table(spark, sf, "file_receipts").schema}
    rows = [(c, "missing" if c not in have else "type") for c, t in _REPORT.items() if have.get(c) != t]
    return spark.createDataFrame(rows, "field string, finding string")


@query("""SELECT dataset, check_name, CAST(n AS BIGINT) AS n FROM (
SELECT 'suppliers' AS dataset, 'unique_change_id' AS check_name, count(*) - count(DISTINCT change_id) AS n FROM suppliers UNION ALL SELECT 'purchase_orders', 'unique_po_row_id', count(*) - count(DISTINCT po_row_id) FROM purchase_orders
UNION ALL SELECT 'fx_rates', 'positive_factor', count(*) FILTER (WHERE NOT rate_factor > 0) FROM fx_rates UNION ALL SELECT 'proposals', 'stable_content', count(*) FROM (SELECT proposal_id FROM proposals GROUP BY 1 HAVING count(DISTINCT proposal_content_hash) > 1)
UNION ALL SELECT 'proposals', 'foreign_has_source_amount', count(*) FILTER (WHERE source_currency <> 'CHF' AND source_amount_minor IS NULL) FROM proposals)""")
def consistency(spark, sf):  # VAL-11, CMP-10: assertions over whole datasets, counted
    t = lambda n: table(spark, sf, n)
    row = lambda d, dataset, name: d.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("check_name"), F.col("n").cast("bigint").alias("n"))
    dup = lambda n, c: t(n).groupBy(c).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    # hashes of a proposal: their minimum and maximum tell whether they differ
    drift = t("proposals").groupBy("proposal_id").agg(F.min("proposal_content_hash").alias("a"), F.max("proposal_content_hash").alias("b")).where("a <> b").agg(F.count("*").alias("n"))
    return _union([
        row(dup("suppliers", "change_id"), "suppliers", "unique_change_id"), row(dup("purchase_orders", "po_row_id"), "purchase_orders", "unique_po_row_id"),
        row(t("fx_rates").agg(F.count(F.when(~(F.col("rate_factor") > 0), 1)).alias("n")), "fx_rates", "positive_factor"), row(drift, "proposals", "stable_content"),
        row(t("proposals").agg(F.count(F.when((F.col("source_currency") != "CHF") & F.col("source_amount_minor").isNull(), 1)).alias("n")), "proposals", "foreign_has_source_amount"),
    ])


@query(f"""SELECT line_id, 'lines[' || CAST(n - 1 AS VARCHAR) || '].' || f AS field, code FROM (SELECT line_id, row_number() OVER (PARTITION BY k ORDER BY line_id) AS n, u, c FROM (SELECT line_id, {_sql_order('po_number')} AS k, {sql_trim('uom')} AS u, {sql_trim('currency')} AS c FROM purchase_order_lines)),
LATERAL (VALUES ('uom', CASE WHEN u IS NULL OR u = '' THEN 'E_FIELD_REQUIRED' WHEN u NOT IN ('EA','PCE','CTN','KG','G','L','M','STK','STD','PAU','M2','H','TON','PAL') THEN 'E_UOM_UNKNOWN' END), ('currency', CASE WHEN c IS NULL OR c = '' THEN 'E_FIELD_REQUIRED' WHEN c NOT IN ('CHF','EUR','USD','GBP','SEK','DKK','NOK','HUF','IDR','JPY') THEN 'E_CURRENCY_UNKNOWN' END)) t(f, code) WHERE code IS NOT NULL""")
def indexed_findings(spark, sf):  # VAL-06: findings with the line's index in its order; the index is a running count, no order is collected
    from ..operators.record_split import UNITS

    l = table(spark, sf, "purchase_order_lines").select("line_id", X.canonical_order_number(F.col("po_number")).alias("k"), X.trim_ws(F.col("uom")).alias("u"), X.trim_ws(F.col("currency")).alias("c"))
    l = O.running(l, ["k"], "line_id", F.lit(1).cast("bigint"), "n")
    one = lambda name, c, known, code: F.struct(F.lit(name).alias("f"), F.when(c.isNull() | (c == ""), "E_FIELD_REQUIRED").when(~c.isin(*known), code).alias("code"))
    found = F.array(one("uom", F.col("u"), UNITS, "E_UOM_UNKNOWN"), one("currency", F.col("c"), list(N.CURRENCY_SCALE), "E_CURRENCY_UNKNOWN"))
    d = l.select("line_id", "n", F.explode(found).alias("x")).where("x.code is not null")
    return d.select("line_id", F.concat(F.lit("lines["), (F.col("n") - 1).cast("string"), F.lit("]."), "x.f").alias("field"), F.col("x.code").alias("code"))


@query(f"""SELECT posting_id, CASE WHEN {sql_trim('coalesce(proposal_id, chr(32))')} = '' THEN 'proposal_id' WHEN supplier_number IS NULL OR NOT regexp_full_match(supplier_number, '[0-9]{{7,10}}') THEN 'supplier_number' WHEN {sql_trim('coalesce(supplier_invoice_number, chr(32))')} = '' THEN 'supplier_invoice_number'
WHEN {sql_trim('coalesce(idempotency_key, chr(32))')} = '' THEN 'idempotency_key' WHEN attempts IS NULL OR attempts < 1 THEN 'attempts' END AS first_fault FROM postings""")
def posting_shapes(spark, sf):  # VAL-10, FN-22: the first rule an item breaks
    blank = lambda c: F.coalesce(X.trim_ws(F.col(c)), F.lit("")) == ""
    s = F.col("supplier_number")
    first = F.when(blank("proposal_id"), "proposal_id").when(s.isNull() | ~s.rlike("^[0-9]{7,10}$"), "supplier_number").when(blank("supplier_invoice_number"), "supplier_invoice_number")
    first = first.when(blank("idempotency_key"), "idempotency_key").when(F.col("attempts").isNull() | (F.col("attempts") < 1), "attempts")
    return table(spark, sf, "postings").select("posting_id", first.alias("first_fault"))


# -- projections and values ---------------------------------------------------------------------------
@query("SELECT po_row_id, CASE company_code WHEN 'CH10' THEN '0100' WHEN 'CH20' THEN '0200' END AS client, CASE CASE WHEN po_row_id % 3 = 0 THEN company_code ELSE CASE company_code WHEN 'CH10' THEN '0100' WHEN 'CH20' THEN '0200' END END WHEN '0100' THEN 'CH10' WHEN '0200' THEN 'CH20' WHEN 'CH10' THEN 'CH10' WHEN 'CH20' THEN 'CH20' END AS company FROM purchase_orders")
def company_codes(spark, sf):  # PRJ-04: a sender's client number to the company code; canonical codes pass, others are null
    o = table(spark, sf, "purchase_orders")
    client = F.when(F.col("company_code") == "CH10", "0100").when(F.col("company_code") == "CH20", "0200")
    written = F.when(F.col("po_row_id") % 3 == 0, F.col("company_code")).otherwise(client)
    return o.select("po_row_id", client.alias("client"), X.company_code(written).alias("company"))


@query("SELECT event_id, '{\"type\":\"' || event_type || '\"}' AS payload FROM events")
def stripped_payloads(spark, sf):  # PRJ-05: a column and a member that must not leave
    e = table(spark, sf, "events").withColumn("payload", F.to_json(F.create_map(F.lit("type"), F.col("event_type"), F.lit("if_version"), F.lit("3"))))
    return e.drop("props", "value").select("event_id", F.to_json(F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: k != "if_version")).alias("payload"))


_HASHED = ["amount_minor", "document_date", "invoice_key", "invoice_version", "matched_cost_center", "matched_po", "source_amount_minor", "source_currency", "supplier_number"]


@query("SELECT DISTINCT proposal_id, sha256(" + " || chr(31) || ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in _HASHED) + ") AS content FROM proposals")
def content_hashes(spark, sf):  # PRJ-06, HSH-02: the whole content subset, in alphabetical order
    return table(spark, sf, "proposals").select("proposal_id", H.content_hash(*map(F.col, _HASHED)).alias("content")).distinct()


@query("""WITH h AS (SELECT status, sha256(coalesce('=' || proposal_id, '-') || chr(31) || coalesce('=' || CAST(seq AS VARCHAR), '-')) AS h FROM proposals)
SELECT status, sha256(CAST(count(*) AS VARCHAR) || """ + " || ".join(f"':' || CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + ") AS digest FROM h GROUP BY 1")
def unordered_digest(spark, sf):  # AGG-16, HSH-03: a digest no order enters, at any size
    p = table(spark, sf, "proposals").select("status", H.content_hash(F.col("proposal_id"), F.col("seq")).alias("h"))
    return H.set_digest(p, "status", "h")


@query("""SELECT file_no, d, CASE file_no % 5 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d.%m.%Y') WHEN 2 THEN strftime(d, '%Y%m%d') WHEN 3 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%d%m%y') END AS written FROM (SELECT fx_rate_id AS file_no, CAST(valid_from AS DATE) AS d FROM fx_rates)""")
def declared_dates(spark, sf):  # FN-04, FN-05, FN-23: five declared patterns, written and read
    r = table(spark, sf, "fx_rates").select(F.col("fx_rate_id").alias("file_no"), F.to_date("valid_from").alias("d"), F.get(F.array(*map(F.lit, N.DATE_PATTERNS)), (F.col("fx_rate_id") % 5).cast("int")).alias("pattern"))
    written = F.coalesce(*[F.when(F.col("pattern") == p, F.date_format("d", p)) for p in N.DATE_PATTERNS])
    w = r.select("file_no", "pattern", written.alias("written"))
    return w.select("file_no", N.declared_date(F.col("written"), F.col("pattern")).alias("d"), "written")


@query("SELECT receipt_id, strftime(received_at, '%d%m%y%H%M') AS stamp, date_trunc('minute', received_at) AS at FROM file_receipts")
def short_stamps(spark, sf):  # FN-05: DDMMYYhhmm
    f = table(spark, sf, "file_receipts").select("receipt_id", F.date_format("received_at", "ddMMyyHHmm").alias("stamp"))
    return f.select("receipt_id", "stamp", N.short_stamp(F.col("stamp")).alias("at"))


@query("SELECT revision_id, CASE WHEN revision_id % 2 = 0 THEN CAST(document_date AS DATE) ELSE CAST(created_at + INTERVAL 1 HOUR * (CASE WHEN (created_at >= TIMESTAMP '2025-03-30 01:00:00' AND created_at < TIMESTAMP '2025-10-26 01:00:00') OR (created_at >= TIMESTAMP '2026-03-29 01:00:00' AND created_at < TIMESTAMP '2026-10-25 01:00:00') THEN 2 ELSE 1 END) AS DATE) END AS posting_date FROM proposals")
def posting_days(spark, sf):  # FN-17: a plain date as it is, an instant by the calendar of Zurich
    p = table(spark, sf, "proposals")
    text = F.when(F.col("revision_id") % 2 == 0, F.col("document_date")).otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return p.select("revision_id", N.posting_day(text).alias("posting_date"))


@query(f"""SELECT fx_rate_id, CAST(CASE WHEN v = round(v, 4) THEN v END AS DECIMAL(38,12)) AS four, CAST(CASE WHEN base = 'JPY' THEN CASE WHEN v = floor(v) THEN v END WHEN v * 100 = floor(v * 100) THEN v * 100 END AS BIGINT) AS minor FROM (SELECT fx_rate_id, base, CAST(rate AS DECIMAL(38,12)) AS v FROM fx_rates WHERE regexp_full_match(rate, '[0-9]+(\\.[0-9]{{1,12}})?'))""")
def exact_scales(spark, sf):  # FN-07, FN-09: rescaled exactly or not at all; minor units of the currency
    r = table(spark, sf, "fx_rates").where(F.col("rate").rlike("^[0-9]+(\\.[0-9]{1,12})?$")).withColumn("v", F.col("rate").cast("decimal(38,12)"))
    return r.select("fx_rate_id", N.exact_rescale(F.col("v"), 4).alias("four"), N.minor_units(F.col("v").cast("decimal(28,12)"), F.col("base")).alias("minor"))


@query("SELECT record_id, CASE WHEN line IS NOT NULL THEN file || '#L' || CAST(line AS VARCHAR) || coalesce('/' || field, '') ELSE file || '#/' || CAST(record_ordinal - 1 AS VARCHAR) || coalesce('/' || field, '') END AS locator FROM records")
def row_locators(spark, sf):  # FN-20: where a record stands, by line or by pointer
    field = F.coalesce(F.concat(F.lit("/"), "field"), F.lit(""))
    by_line, pointer = F.concat("file", F.lit("#L"), F.col("line").cast("string"), field), F.concat("file", F.lit("#/"), (F.col("record_ordinal") - 1).cast("string"), field)
    return table(spark, sf, "records").select("record_id", F.when(F.col("line").isNotNull(), by_line).otherwise(pointer).alias("locator"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN NULL ELSE 'k' || json_extract_string(props, '$.k') END AS key, CASE event_id % 4 WHEN 1 THEN 'E_KEY_NOT_STRING' WHEN 3 THEN 'E_KEY_MISSING' END AS code, event_id % 2 = 0 AS flag FROM events""")
def typed_members(spark, sf):  # FN-21: readers that know the JSON type: a number is no key
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    key = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit('"key":'), k, F.lit(","))).when(F.col("event_id") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit('"key":"k'), k, F.lit('",')))
    doc = F.concat(F.lit("{"), key, F.lit('"flag":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    r = e.select("event_id", H.json_members(doc, F.lit("key"), F.lit("flag")).alias("m"))
    return r.select("event_id", F.col("m.key").alias("key"), F.col("m.code").alias("code"), F.col("m.flag").alias("flag"))


@query("""WITH d AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 5 = 0)
SELECT event_id, 'a.k' AS path, k AS old_value, CAST(CAST(k AS BIGINT) + 1 AS VARCHAR) AS new_value FROM d UNION ALL SELECT event_id, 'a.l[1]', 'x', NULL FROM d UNION ALL SELECT event_id, 'b', NULL, event_type FROM d""")
def nested_diff(spark, sf):  # FN-24, CMP-03: nested values flattened to paths, compared as a set; a fifth of the events carry a change
    e = table(spark, sf, "events").where("event_id % 5 = 0")
    k = F.get_json_object("props", "$.k")
    old = F.concat(F.lit('{"a":{"k":'), k, F.lit(',"l":["w","x"]}}'))
    new = F.concat(F.lit('{"a":{"k":'), (k.cast("bigint") + 1).cast("string"), F.lit(',"l":["w"]},"b":"'), "event_type", F.lit('"}'))
    tall = lambda c, name: e.select("event_id", F.explode(H.flat_json(c)).alias("path", name))
    j = tall(old, "old_value").join(tall(new, "new_value"), ["event_id", "path"], "full")
    return j.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


@query("""WITH c AS (SELECT proposal_id, row_number() OVER (ORDER BY proposal_id) AS n FROM (SELECT DISTINCT proposal_id FROM proposals)), t AS (SELECT n // 500 AS page, base64(encode('{"after":"' || proposal_id || '"}')) AS body FROM c WHERE n % 500 = 0)
SELECT CAST(page AS BIGINT) AS page, body || '.' || left(sha256('cursor-key' || body), 32) AS cursor, true AS valid, false AS forged FROM t""")
def signed_cursors(spark, sf):  # LIM-02, LIM-03, LIM-04: a tamper-evident cursor behind each page of 500
    d = O.dense_number(table(spark, sf, "proposals").select("proposal_id").distinct(), ["proposal_id"]).where("n % 500 = 0")
    cursor = X.signed_cursor(F.concat(F.lit('{"after":"'), "proposal_id", F.lit('"}')), "cursor-key")
    c = d.select(F.expr("n div 500").alias("page"), cursor.alias("cursor"))
    return c.select("page", "cursor", X.cursor_valid(F.col("cursor"), "cursor-key").alias("valid"), X.cursor_valid(F.concat(F.lit("x"), "cursor"), "cursor-key").alias("forged"))


@query("""SELECT run_id, coalesce(max(batch_sequence) FILTER (WHERE NOT replay), 0) AS after, coalesce(lag(max(batch_sequence) FILTER (WHERE NOT replay)) OVER (PARTITION BY source_system ORDER BY min(receipt_id)), 0) AS before,
coalesce(max(batch_sequence) FILTER (WHERE NOT replay), 0) > coalesce(lag(max(batch_sequence) FILTER (WHERE NOT replay)) OVER (PARTITION BY source_system ORDER BY min(receipt_id)), 0) AS advanced FROM file_receipts GROUP BY run_id, source_system""")
def watermark_moves(spark, sf):  # CMP-07, AGG-15: a run's mark against the mark of the run before
    f = table(spark, sf, "file_receipts").groupBy("run_id", "source_system").agg(F.max(F.when(~F.col("replay"), F.col("batch_sequence"))).alias("m"), F.min("receipt_id").alias("i"))
    d = O.previous_row(f, ["source_system"], "i", F.col("m"), "p")
    z = lambda c: F.coalesce(c, F.lit(0))
    return d.select("run_id", z(F.col("m")).alias("after"), z(F.col("p.v")).alias("before"), (z(F.col("m")) > z(F.col("p.v"))).alias("advanced"))


# -- documents and their parts ---------------------------------------------------------------------
_PARENT = "k, batch_id, path"


@query(f"""WITH l AS (SELECT line_id, {_sql_order('po_number')} AS k, batch_id, path, {sql_trim('line_no')} AS n FROM purchase_order_lines WHERE po_number IS NOT NULL)
SELECT line_id, CAST(row_number() OVER (PARTITION BY {_PARENT} ORDER BY n NULLS FIRST, line_id) AS BIGINT) AS place, length(k) % 2 = 0 AS embedded FROM l""")
def document_lines(spark, sf):  # JN-07: a document's own lines where it has some, else the separate ones by key; here an order inside a file is the document
    l = table(spark, sf, "purchase_order_lines").where("po_number is not null").select("line_id", X.canonical_order_number(F.col("po_number")).alias("k"), "batch_id", "path", X.trim_ws(F.col("line_no")).alias("n"))
    own = F.length("k") % 2 == 0
    packed = l.groupBy("k", "batch_id", "path").agg(F.collect_list(F.when(own, F.struct("n", "line_id"))).alias("lines"))  # bounded by its file
    return L.embedded_else_separate(packed, "lines", l, ["k", "batch_id", "path"], ["n", "line_id"]).select("line_id", "place", "embedded")


_WARNINGS = [("W_NO_ORDER", "matched_po IS NULL"), ("W_RETRIED", "attempts > 1"), ("W_SUPERSEDED", "superseded_by IS NOT NULL")]


@query(f"""WITH c AS (SELECT proposal_id, max_by(struct_pack(invoice_key, status), seq * 100000000 + revision_id) AS x, list_distinct(flatten(list([{", ".join(f"CASE WHEN {w} THEN '{c}' END" for c, w in _WARNINGS)}]))) AS w FROM proposals WHERE proposal_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1)
SELECT proposal_id, split_part(x.invoice_key, chr(31), 1) AS supplier_number, split_part(x.invoice_key, chr(31), 2) AS invoice_number, x.status AS status, array_to_string(list_sort(list_filter(w, lambda v: v IS NOT NULL)), ',') AS warnings FROM c""")
def outbox_details(spark, sf):  # PRJ-03, AGG-18, FN-13: a proposal's last revision, its key split, its warnings sorted, distinct and joined
    p = table(spark, sf, "proposals").where("proposal_id is not null and seq is not null")
    seen = [F.max(F.when(F.expr(w), F.lit(c))).alias(c) for c, w in _WARNINGS]
    g = p.groupBy("proposal_id").agg(F.max_by(F.struct("invoice_key", "status"), F.struct("seq", "revision_id")).alias("x"), *seen)
    return g.select("proposal_id", X.key_part(F.col("x.invoice_key"), 0).alias("supplier_number"), X.key_part(F.col("x.invoice_key"), 1).alias("invoice_number"), F.col("x.status").alias("status"), F.array_join(F.array(*[c for c, _ in _WARNINGS]), ",").alias("warnings"))


@query("""SELECT change_id, coalesce(CASE WHEN trim(coalesce(name, '')) = '' THEN 'E_FIELD_REQUIRED' END, CASE WHEN currency IS NULL THEN 'E_CURRENCY_UNKNOWN' END, CASE WHEN payment_terms_days > 60 THEN 'W_LONG_TERMS' END, CASE WHEN starts_with(name, ' ') OR ends_with(name, ' ') OR starts_with(supplier_number, ' ') OR ends_with(supplier_number, ' ') THEN 'W_BLANKS' END) AS first_finding FROM suppliers""")
def first_findings(spark, sf):  # SNK-03: the first finding of a record, errors before warnings
    s = table(spark, sf, "suppliers")
    blanks = lambda c: F.col(c).startswith(" ") | F.col(c).endswith(" ")
    errors = [F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "E_FIELD_REQUIRED"), F.when(F.col("currency").isNull(), "E_CURRENCY_UNKNOWN")]
    warnings = [F.when(F.col("payment_terms_days") > 60, "W_LONG_TERMS"), F.when(blanks("name") | blanks("supplier_number"), "W_BLANKS")]
    return s.select("change_id", F.coalesce(*errors, *warnings).alias("first_finding"))


@query("""SELECT blocked, 'cost_centers' AS dataset, CAST(NULL AS VARCHAR) AS iban, code AS key, name FROM cost_centers UNION ALL SELECT blocked, 'suppliers', iban, supplier_number, name FROM suppliers""")
def negotiated_rows(spark, sf):  # SNK-05: rows of several datasets under the sorted union of their columns
    from ..sources.sinks import sorted_union

    a = table(spark, sf, "cost_centers").select(F.lit("cost_centers").alias("dataset"), F.col("code").alias("key"), "name", "blocked")
    b = table(spark, sf, "suppliers").select(F.lit("suppliers").alias("dataset"), F.col("supplier_number").alias("key"), "name", "blocked", "iban")
    return sorted_union([a, b])


@query("""WITH p AS (SELECT invoice_key, proposal_id, min_by(proposal_content_hash, revision_id) AS h, min(received_at) AS t, min(revision_id) AS r FROM proposals WHERE invoice_key IS NOT NULL GROUP BY ALL),
f AS (SELECT invoice_key, min_by(struct_pack(proposal_id, h), r) AS a, max_by(struct_pack(proposal_id, h), r) AS z FROM p GROUP BY 1) SELECT invoice_key, a.proposal_id AS first_proposal, z.proposal_id AS last_proposal, a.h <> z.h AS amended FROM f""")
def amended_deliveries(spark, sf):  # GEN-03: first and last delivery of an invoice, amended where the hash differs
    p = table(spark, sf, "proposals").where("invoice_key is not null")
    one = F.struct("revision_id", "proposal_id", F.col("proposal_content_hash").alias("h"))
    g = p.groupBy("invoice_key", "proposal_id").agg(F.min(one).alias("x")).groupBy("invoice_key").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    return g.select("invoice_key", F.col("a.proposal_id").alias("first_proposal"), F.col("z.proposal_id").alias("last_proposal"), (F.col("a.h") != F.col("z.h")).alias("amended"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY batch_id, path ORDER BY receipt_id) AS n, concat_ws('|', run_id, dataset, format, regexp_replace(coalesce(header_line, '-'), '[0-9]+', '#', 'g'), coalesce(CAST(declared_records AS VARCHAR), '-'), coalesce(sha256, '-')) AS t FROM file_receipts)
SELECT b.receipt_id, a.t = b.t AS same FROM f a JOIN f b USING (batch_id, path) WHERE a.n = 1 AND b.n > 1""")
def replay_comparison(spark, sf):  # CMP-11: artifacts of two runs, compared without their volatile fields
    z = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    t = F.concat_ws("|", "run_id", "dataset", "format", F.regexp_replace(z("header_line"), "[0-9]+", "#"), z("declared_records"), z("sha256"))
    f = table(spark, sf, "file_receipts").select("batch_id", "path", "receipt_id", t.alias("t"))
    first = f.groupBy("batch_id", "path").agg(F.min(F.struct("receipt_id", "t")).alias("x"))
    return f.join(first, ["batch_id", "path"]).where("receipt_id <> x.receipt_id").select("receipt_id", (F.col("t") == F.col("x.t")).alias("same"))


@query("""WITH s AS (SELECT source_system, sum(coalesce(accepted, 0)) AS e, sum(coalesce(seen, 0)) AS p FROM file_receipts GROUP BY 1) SELECT source_system, CAST(e AS BIGINT) AS earned, CAST(p AS BIGINT) AS possible,
CASE WHEN p = 0 THEN 'none' WHEN e * 100 >= p * 95 THEN 'high' WHEN e * 100 >= p * 80 THEN 'middle' ELSE 'low' END AS band FROM s""")
def score_bands(spark, sf):  # CMP-17: sums by group and the band they fall in
    z = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    g = table(spark, sf, "file_receipts").groupBy("source_system").agg(z("accepted").alias("earned"), z("seen").alias("possible"))
    e, p = F.col("earned") * 100, F.col("possible")
    return g.select("source_system", "earned", "possible", F.when(p == 0, "none").when(e >= p * 95, "high").when(e >= p * 80, "middle").otherwise("low").alias("band"))


_FROM, _TO = "2025-06-01", "2025-09-01"


@query(f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '{_FROM}', DATE '{_TO}' - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d), b AS (SELECT DISTINCT base FROM fx_rates WHERE quote = 'CHF' AND rate_type = 'DAILY'),
r AS (SELECT base, valid_from, valid_to, status, row_number() OVER (PARTITION BY base, valid_from ORDER BY sequence DESC, fx_rate_id) AS n FROM fx_rates WHERE quote = 'CHF' AND rate_type = 'DAILY')
SELECT base, CAST(count(*) FILTER (WHERE NOT covered) AS BIGINT) AS open_days FROM (SELECT b.base, d.d, EXISTS (SELECT 1 FROM r WHERE r.base = b.base AND n = 1 AND status <> 'DELETED' AND CAST(valid_from AS DATE) <= d.d AND (valid_to IS NULL OR d.d < CAST(valid_to AS DATE))) AS covered FROM b, d) GROUP BY 1""")
def uncovered_days(spark, sf):  # WIN-11: days of a window no standing rate covers; spans are clipped to the window and cut into calendar cells
    r = table(spark, sf, "fx_rates").where("quote = 'CHF' and rate_type = 'DAILY'").withColumn("t", -F.col("fx_rate_id"))
    last = O.latest(r.select("base", "valid_from", "valid_to", "status", "sequence", "t"), ["base", "valid_from"], ["sequence", "t"]).where("status <> 'DELETED'")
    lo, hi = F.greatest(F.to_date("valid_from"), F.lit(_FROM).cast("date")), F.least(F.coalesce(F.to_date("valid_to"), F.lit(_TO).cast("date")), F.lit(_TO).cast("date"))
    cells = last.select("base", F.explode(span_cells(lo, hi)).alias("c")).distinct()
    days = r.select("base").distinct().withColumn("d", F.explode(F.sequence(F.lit(_FROM).cast("date"), F.date_sub(F.lit(_TO).cast("date"), 1))))
    met = days.select("base", "d", F.explode(day_cells(F.col("d"))).alias("c")).join(cells, ["base", "c"]).select("base", "d").distinct().withColumn("hit", F.lit(1))
    return days.join(met, ["base", "d"], "left").groupBy("base").agg(F.count(F.when(F.col("hit").isNull(), 1)).alias("open_days"))


@query(f"""WITH c AS (SELECT line_id, d, t, {_sql_value('q').replace('DECIMAL(18,6)', 'DECIMAL(28,3)')} AS v FROM (SELECT line_id, quantity AS q, dec, tho, CASE WHEN dec = ',' THEN ',' ELSE '.' END AS d, chr(39) AS t FROM {_LINES}))
SELECT line_id, replace(replace(replace(format('{{:,.3f}}', CAST(v AS DOUBLE)), ',', '~'), '.', d), '~', t) AS written, v AS value FROM c WHERE v IS NOT NULL AND abs(v) < 100000000""")
def dialect_cells(spark, sf):  # FN-23: numbers written by the dialect of their file, and read from it again
    d = dialects(table(spark, sf, "file_receipts")).select("batch_id", "path", "decimal_separator", "thousands_separator")
    l = table(spark, sf, "purchase_order_lines").join(d, ["batch_id", "path"], "left")
    v = N.parse_number(X.trim_ws(F.col("quantity")), F.col("decimal_separator"), F.col("thousands_separator")).try_cast("decimal(28,3)")
    dec = F.when(F.col("decimal_separator") == ",", ",").otherwise(".")
    w = l.select("line_id", dec.alias("dec"), v.alias("v")).where(F.col("v").isNotNull() & (F.abs("v") < 100000000))
    w = w.select("line_id", "dec", N.written_number(F.col("v"), 3, F.col("dec"), F.lit("'")).alias("written"))
    return w.select("line_id", "written", N.parse_number(F.col("written"), F.col("dec"), F.lit("'")).try_cast("decimal(28,3)").alias("value"))


@query(f"""WITH o AS (SELECT {_sql_order('po_number')} AS k, max_by(struct_pack(i := po_row_id, g := deleted_at), change_seq * 1000000000 + po_row_id) AS x FROM purchase_orders WHERE po_number IS NOT NULL AND change_seq IS NOT NULL GROUP BY 1)
SELECT k AS order_key, x.i AS po_row_id FROM o WHERE x.g IS NULL ORDER BY k LIMIT 100""")
def first_live_orders(spark, sf):  # SRC-23, SRC-22: the heads of the live orders in key order, stopping early (the limit is the feature)
    o = table(spark, sf, "purchase_orders").where("po_number is not null and change_seq is not null").select(X.canonical_order_number(F.col("po_number")).alias("order_key"), "po_row_id", "deleted_at", "change_seq")
    return O.latest(o, ["order_key"], ["change_seq", "po_row_id"]).where("deleted_at is null").orderBy("order_key").limit(O.page_size(None)).select("order_key", "po_row_id")


@query(f"SELECT {_sql_order('po_number')} AS order_key FROM purchase_order_lines WHERE po_number IS NOT NULL EXCEPT SELECT {_sql_order('po_number')} FROM purchase_orders WHERE po_number IS NOT NULL")
def foreign_orders(spark, sf):  # SET-04: what is listed and not owned
    keys = lambda t: table(spark, sf, t).where("po_number is not null").select(X.canonical_order_number(F.col("po_number")).alias("order_key"))
    return keys("purchase_order_lines").subtract(keys("purchase_orders"))
