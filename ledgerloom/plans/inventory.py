"""Queries for the data-processing operators of the inventory, with their SQL.

Each pair is registered under a readable name; the comment behind names the inventory ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import numbers as N
from ..functions import text as X
from ..operators import lookups as L
from ..operators import ordered as O
from ..operators import reconcile as R
from ..session import table
from .payables import _sql_order, sql_trim

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _n(c="*"):
    return F.count(c).alias("n")


# -- revisions ---------------------------------------------------------------------------------
_SUP_STATE = ["name", "country", "currency", "iban", "vat_number", "payment_terms_days", "blocked"]
_K = sql_trim("supplier_number")
_SAME = " AND ".join(f"(CASE WHEN op<>'D' THEN {c} END) IS NOT DISTINCT FROM lag(CASE WHEN op<>'D' THEN {c} END) OVER w" for c in _SUP_STATE)


@query(f"""SELECT change_id, k AS supplier_key, po AS provenance_only, CAST(sum(CASE WHEN po THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY change_id) AS BIGINT) AS version
FROM (SELECT change_id, {_K} AS k, row_number() OVER w > 1 AND (op='D') = lag(op='D') OVER w AND {_SAME} AS po FROM suppliers WINDOW w AS (PARTITION BY {_K} ORDER BY change_id))""")
def revision_versions(spark, sf):  # UPD-01, UPD-03, WIN-01, WIN-02
    s = table(spark, sf, "suppliers").withColumn("supplier_key", X.trim_ws(F.col("supplier_number")))
    v = O.versions(s, ["supplier_key"], "change_id", F.struct(*_SUP_STATE), F.col("op") == "D")
    return v.select("change_id", "supplier_key", "provenance_only", F.col("version").cast("bigint").alias("version"))


@query(f"""SELECT change_id, k AS supplier_key, change_seq FROM (SELECT change_id, {_K} AS k, change_seq,
max(change_seq) OVER (PARTITION BY {_K} ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM suppliers) WHERE change_seq < top""")
def stale_overwrites(spark, sf):  # WIN-03
    s = table(spark, sf, "suppliers").withColumn("supplier_key", X.trim_ws(F.col("supplier_number")))
    return O.stale_overwrites(s, ["supplier_key"], "change_id", "change_seq").select("change_id", "supplier_key", "change_seq")


@query(f"""SELECT change_id, payment_terms_days, lag(payment_terms_days) OVER (PARTITION BY {_K} ORDER BY change_id) AS previous FROM suppliers""")
def previous_terms(spark, sf):  # WIN-05
    s = table(spark, sf, "suppliers").withColumn("k", X.trim_ws(F.col("supplier_number")))
    return O.previous_row(s, ["k"], "change_id", F.col("payment_terms_days"), "p").select("change_id", "payment_terms_days", F.col("p.v").alias("previous"))


@query(f"""SELECT k AS order_key, po_row_id, status FROM (SELECT {_sql_order('po_number')} AS k, po_row_id, status, deleted_at,
row_number() OVER (PARTITION BY {_sql_order('po_number')} ORDER BY change_seq DESC, po_row_id DESC) AS rn FROM purchase_orders) WHERE rn=1 AND deleted_at IS NULL AND k IS NOT NULL""")
def live_orders(spark, sf):  # WIN-04, SRC-21, SRC-23, UPD-03
    o = table(spark, sf, "purchase_orders").select(X.canonical_order_number(F.col("po_number")).alias("order_key"), "po_row_id", "status", "deleted_at", "change_seq")
    live = O.latest(o.where("order_key is not null"), ["order_key"], ["change_seq", "po_row_id"])
    return live.where("deleted_at is null").select("order_key", "po_row_id", "status")


@query("""SELECT 'purchase_orders' AS dataset, count(DISTINCT po_number) AS n FROM purchase_orders UNION ALL
SELECT 'cost_centers', count(DISTINCT code) FROM cost_centers UNION ALL SELECT 'proposals', count(DISTINCT proposal_id) FROM proposals""")
def dataset_counts(spark, sf):  # AGG-01, CMP-10
    out = None
    for name, key in (("purchase_orders", "po_number"), ("cost_centers", "code"), ("proposals", "proposal_id")):
        one = table(spark, sf, name).where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("x")).select(F.lit(name).alias("dataset")).groupBy("dataset").agg(_n())
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT revision_id, seq, status FROM proposals WHERE proposal_id = 'prp_000000001'""")
def record_history(spark, sf):  # one key of record_histories: point get, a pushed-down filter
    return table(spark, sf, "proposals").where(F.col("proposal_id") == "prp_000000001").select("revision_id", "seq", "status")


@query("""SELECT proposal_id, revision_id, seq, status, CAST(row_number() OVER (PARTITION BY proposal_id ORDER BY seq NULLS FIRST, revision_id) AS BIGINT) AS revision FROM proposals""")
def record_histories(spark, sf):  # SRC-22: every proposal
    p = table(spark, sf, "proposals").select("proposal_id", "revision_id", "seq", "status")
    return O.running(p, ["proposal_id"], "seq", F.lit(1).cast("bigint"), "revision", tie=["revision_id"])


# -- paging, limits, numbering -----------------------------------------------------------------
@query("""SELECT change_seq, po_row_id, (SELECT count(*) > 250 FROM purchase_orders WHERE change_seq > 500100) AS has_more FROM purchase_orders WHERE change_seq > 500100 ORDER BY change_seq, po_row_id LIMIT 250""")
def keyset_page(spark, sf):  # LIM-01, FLT-03, SRC-19, STR-01: 250 rows is the page size
    o = table(spark, sf, "purchase_orders").where(F.col("change_seq") > 500100).select("change_seq", "po_row_id")
    return O.keyset_page(o, ["change_seq", "po_row_id"], (500100, 9223372036854775807), 250)


@query("SELECT proposal_id, n, CAST((n-1)//500 AS BIGINT) AS page FROM (SELECT proposal_id, CAST(row_number() OVER (ORDER BY proposal_id) AS BIGINT) AS n FROM (SELECT DISTINCT proposal_id FROM proposals))")
def outbox_pages(spark, sf):  # LIM-03, SNK-04, SRT-01
    d = O.dense_number(table(spark, sf, "proposals").select("proposal_id").distinct(), ["proposal_id"])
    return d.select("proposal_id", "n", F.floor((F.col("n") - 1) / 500).cast("bigint").alias("page"))


@query("""SELECT posting_id, 'AP-' || y || '-' || lpad(CAST(row_number() OVER (PARTITION BY y ORDER BY received_at, posting_id) AS VARCHAR), 7, '0') AS number
FROM (SELECT posting_id, received_at, CAST(year(received_at) AS VARCHAR) AS y FROM postings WHERE erp_status='posted')""")
def document_numbers(spark, sf):  # STR-03, RUL-05
    p = table(spark, sf, "postings").where("erp_status = 'posted'").select("posting_id", "received_at", F.year("received_at").cast("string").alias("y"))
    d = O.dense_number(p, ["y", "received_at", "posting_id"])
    first = d.groupBy("y").agg((F.min("n") - 1).alias("o"))  # one row per year
    d = d.join(first, "y")
    return d.select("posting_id", F.concat(F.lit("AP-"), "y", F.lit("-"), F.lpad((F.col("n") - F.col("o")).cast("string"), 7, "0")).alias("number"))


@query("SELECT posting_id, n FROM (SELECT posting_id, CAST(row_number() OVER (ORDER BY received_at, posting_id) AS BIGINT) AS n FROM postings) WHERE n % 40 = 0")
def every_nth(spark, sf):  # WIN-10, GEN-08: sampling is the operator
    return O.dense_number(table(spark, sf, "postings").select("posting_id", "received_at"), ["received_at", "posting_id"]).where("n % 40 = 0").select("posting_id", "n")


@query("""SELECT code, record_id, CAST(rk AS INTEGER) AS "rank" FROM (SELECT code, record_id, row_number() OVER (PARTITION BY code ORDER BY natural_key NULLS FIRST, record_id) AS rk FROM records WHERE code IS NOT NULL) WHERE rk <= 5""")
def top_per_code(spark, sf):  # LIM-06, AGG-19: the first 5 per code is the operator
    r = table(spark, sf, "records").where("code is not null").select("code", "record_id", "natural_key")
    return O.top_per_group(r, ["code"], [F.asc_nulls_first("natural_key"), F.asc("record_id")], 5).select("code", "record_id", "rank")


@query("SELECT supplier_number, change_seq FROM suppliers ORDER BY change_seq, change_id LIMIT 50 OFFSET 100")
def offset_window(spark, sf):  # LIM-05
    return table(spark, sf, "suppliers").orderBy("change_seq", "change_id").offset(100).limit(50).select("supplier_number", "change_seq")


@query("""SELECT batch_id, file, CAST(count(*) FILTER (WHERE record_ordinal <> rn) AS BIGINT) AS out_of_place, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, file ORDER BY line, record_id) AS rn FROM records) GROUP BY batch_id, file""")
def record_ordinals(spark, sf):  # WIN-07, SRC-16 (gap check): files are bounded by their size
    w = Window.partitionBy("batch_id", "file").orderBy("line", "record_id")
    r = table(spark, sf, "records").select("batch_id", "file", "record_ordinal", F.row_number().over(w).alias("rn"))
    return r.groupBy("batch_id", "file").agg(F.count(F.when(F.col("record_ordinal") != F.col("rn"), 1)).alias("out_of_place"), _n())


# -- joins -------------------------------------------------------------------------------------
@query(f"""WITH s AS (SELECT DISTINCT {_K} AS k FROM suppliers)
SELECT po_row_id, s.k IS NOT NULL AS known FROM purchase_orders p LEFT JOIN s ON s.k = {sql_trim('p.supplier_number')}""")
def order_supplier(spark, sf):  # JN-01, JN-10
    s = table(spark, sf, "suppliers").select(X.trim_ws(F.col("supplier_number")).alias("k")).distinct().withColumn("known", F.lit(True))
    o = table(spark, sf, "purchase_orders").withColumn("k", X.trim_ws(F.col("supplier_number")))
    return o.join(s, "k", "left").select("po_row_id", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"""WITH e AS (SELECT po_number AS r, min(po_number) AS k FROM purchase_orders GROUP BY 1), c AS (SELECT {_sql_order('po_number')} AS r, max(po_number) AS k FROM purchase_orders GROUP BY 1)
SELECT line_id, coalesce(e.k, c.k) AS matched_key, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN c.k IS NOT NULL THEN 'canonical' ELSE 'none' END AS how
FROM purchase_order_lines l LEFT JOIN e ON e.r = l.po_number LEFT JOIN c ON c.r = {_sql_order('l.po_number')}""")
def line_order_lookup(spark, sf):  # JN-02, FN-11, FN-12
    lines, orders = table(spark, sf, "purchase_order_lines").select("line_id", "po_number"), table(spark, sf, "purchase_orders").select("po_number")
    return L.exact_else_canonical(lines, F.col("po_number"), orders, "po_number", X.canonical_order_number, []).select("line_id", "matched_key", "how")


@query(f"""WITH o AS (SELECT {_sql_order('po_number')} AS k, max(cost_center) AS cc FROM purchase_orders GROUP BY 1)
SELECT line_id, coalesce(nullif({sql_trim('l.cost_center')}, ''), o.cc) AS cost_center FROM purchase_order_lines l LEFT JOIN o ON o.k = {_sql_order('l.po_number')}""")
def cost_center_fallback(spark, sf):  # JN-04
    o = table(spark, sf, "purchase_orders").groupBy(X.canonical_order_number(F.col("po_number")).alias("k")).agg(F.max("cost_center").alias("cc"))
    l = table(spark, sf, "purchase_order_lines").withColumn("k", X.canonical_order_number(F.col("po_number")))
    return l.join(o, "k", "left").select("line_id", F.coalesce(X.blank_to_null(F.col("cost_center")), "cc").alias("cost_center"))


@query("""WITH e AS (SELECT DISTINCT proposal_id, source_currency, CAST(document_date AS DATE) AS d FROM proposals)
SELECT proposal_id, fx_rate_id FROM (SELECT proposal_id, fx_rate_id, row_number() OVER (PARTITION BY proposal_id ORDER BY sequence DESC, fx_rate_id) AS rn
FROM e JOIN fx_rates r ON r.base = e.source_currency AND quote='CHF' AND rate_type='DAILY' AND status<>'DELETED' AND CAST(valid_from AS DATE) <= d AND (valid_to IS NULL OR d < CAST(valid_to AS DATE))) WHERE rn=1""")
def rate_by_date(spark, sf):  # JN-05
    e = table(spark, sf, "proposals").groupBy("proposal_id").agg(F.min(F.struct(F.col("source_currency").alias("base"), "document_date")).alias("x")).select("proposal_id", "x.*")
    r = table(spark, sf, "fx_rates").where("quote = 'CHF' and rate_type = 'DAILY' and status <> 'DELETED'")
    return L.interval_lookup(e, "proposal_id", "base", "document_date", r, "valid_from", "valid_to", F.struct("sequence", -F.col("fx_rate_id")), "fx_rate_id")


@query("""SELECT line_id, coalesce(s.base_uom, g.base_uom) AS base_uom, coalesce(s.numerator, g.numerator) AS numerator FROM purchase_order_lines l
LEFT JOIN uom_conversions s ON s.material = l.material AND s.alt_uom = l.uom LEFT JOIN uom_conversions g ON g.material IS NULL AND g.alt_uom = l.uom""")
def unit_conversion_rule(spark, sf):  # JN-06
    l = table(spark, sf, "purchase_order_lines").select("line_id", "material", F.col("uom").alias("alt_uom"))
    return L.specific_else_generic(l, "material", "alt_uom", table(spark, sf, "uom_conversions"), ["base_uom", "numerator"]).select("line_id", "base_uom", "numerator")


@query("""SELECT invoice_key, proposal_id FROM (SELECT invoice_key, proposal_id, row_number() OVER (PARTITION BY invoice_key ORDER BY created_at DESC, proposal_id DESC) AS rn FROM proposals WHERE superseded_by IS NULL) WHERE rn=1 AND invoice_key IS NOT NULL""")
def current_proposal(spark, sf):  # JN-08
    p = table(spark, sf, "proposals").where("superseded_by is null and invoice_key is not null").select("invoice_key", "created_at", "proposal_id")
    return O.latest(p, ["invoice_key"], ["created_at", "proposal_id"]).select("invoice_key", "proposal_id")


@query("""SELECT proposal_id, source_batch_id, source_file_or_chunk, source_line_or_ordinal FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY received_at, revision_id) AS rn FROM proposals) WHERE rn=1""")
def first_delivery(spark, sf):  # JN-09, GEN-03
    p = table(spark, sf, "proposals")
    s = p.groupBy("proposal_id").agg(F.min(F.struct("received_at", "revision_id", "source_batch_id", "source_file_or_chunk", "source_line_or_ordinal")).alias("x"))
    return s.select("proposal_id", "x.source_batch_id", "x.source_file_or_chunk", "x.source_line_or_ordinal")


@query(f"""SELECT line_id FROM purchase_order_lines WHERE {_sql_order('po_number')} IN (SELECT {_sql_order('po_number')} FROM purchase_orders WHERE status='OPEN')""")
def lines_of_open_orders(spark, sf):  # JN-11
    ids = table(spark, sf, "purchase_orders").where("status = 'OPEN'").select(X.canonical_order_number(F.col("po_number")).alias("k"))
    return table(spark, sf, "purchase_order_lines").withColumn("k", X.canonical_order_number(F.col("po_number"))).join(ids, "k", "left_semi").select("line_id")


@query("""WITH p AS (SELECT DISTINCT proposal_id, invoice_key FROM proposals), d AS (SELECT DISTINCT proposal_id, erp_document_number FROM postings WHERE erp_document_number IS NOT NULL)
SELECT 'proposal' AS kind, proposal_id AS id, invoice_key FROM p UNION SELECT 'document', erp_document_number, invoice_key FROM d JOIN p USING (proposal_id) UNION SELECT 'invoice', invoice_key, invoice_key FROM p""")
def audit_ids(spark, sf):  # JN-12: any id of the chain to its invoice
    p = table(spark, sf, "proposals").select("proposal_id", "invoice_key").distinct()
    d = table(spark, sf, "postings").where("erp_document_number is not null").select("proposal_id", "erp_document_number").distinct()
    one = p.select(F.lit("proposal").alias("kind"), F.col("proposal_id").alias("id"), "invoice_key")
    two = d.join(p, "proposal_id").select(F.lit("document").alias("kind"), F.col("erp_document_number").alias("id"), "invoice_key")
    return one.unionByName(two).unionByName(p.select(F.lit("invoice").alias("kind"), F.col("invoice_key").alias("id"), "invoice_key")).distinct()


# -- aggregates --------------------------------------------------------------------------------
_STATUS = ["pending", "acknowledged", "rejected", "superseded", "needs_investigation", "expired"]


@query("SELECT s.status, CAST(coalesce(n,0) AS BIGINT) AS n FROM (VALUES " + ",".join(f"('{s}')" for s in _STATUS) + ") s(status) LEFT JOIN (SELECT status, count(*) AS n FROM proposals GROUP BY 1) USING (status)")
def status_counts(spark, sf):  # AGG-02 (zero filled), FLT-01
    dim = spark.createDataFrame([(s,) for s in _STATUS], "status string")
    return dim.join(table(spark, sf, "proposals").groupBy("status").agg(_n()), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT proposal_id, invoice_key FROM proposals), q AS (SELECT DISTINCT proposal_id FROM postings WHERE erp_status='posted')
SELECT count(DISTINCT invoice_key) AS invoices, count(DISTINCT proposal_id) AS proposals, count(DISTINCT q.proposal_id) AS posted FROM p LEFT JOIN q USING (proposal_id)""")
def funnel(spark, sf):  # AGG-04: three stages; invoice_funnel has all
    p = table(spark, sf, "proposals").select("proposal_id", "invoice_key").distinct()
    q = table(spark, sf, "postings").where("erp_status = 'posted'").select("proposal_id").distinct().withColumn("hit", F.col("proposal_id"))
    return p.join(q, "proposal_id", "left").agg(F.countDistinct("invoice_key").alias("invoices"), F.countDistinct("proposal_id").alias("proposals"), F.countDistinct("hit").alias("posted"))


@query("SELECT l_orderkey, CAST(sum(CAST(round(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2)), 2) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS net FROM lineitem GROUP BY 1")
def order_net(spark, sf):  # rounds each line, then sums; order_totals does it on order lines
    v = F.round(F.col("l_quantity").cast("decimal(12,2)") * F.col("l_extendedprice").cast("decimal(12,2)"), 2).cast("decimal(18,2)")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(v).cast("decimal(28,2)").alias("net"))


@query("""SELECT run_id, batch_id, path, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(count(*) AS BIGINT) AS files
FROM file_receipts GROUP BY ROLLUP (run_id, batch_id, path)""")
def receipt_rollup(spark, sf):  # AGG-06
    return table(spark, sf, "file_receipts").rollup("run_id", "batch_id", "path").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count("*").alias("files"))


_PARTS = ["accepted", "accepted_with_warning", "rejected", "skipped_unchanged", "quarantined", "replayed"]


@query("SELECT receipt_id, CAST(seen - (" + "+".join(_PARTS) + ") AS BIGINT) AS difference FROM file_receipts WHERE seen <> " + "+".join(_PARTS))
def receipt_closure(spark, sf):  # AGG-07, CMP-01, CMP-04
    return R.closure_violations(table(spark, sf, "file_receipts"), "seen", _PARTS).select("receipt_id", "difference")


@query("""WITH d AS (SELECT batch_id, path, max(declared_records) AS declared FROM file_receipts GROUP BY ALL), r AS (SELECT batch_id, file AS path, count(*) AS counted FROM records GROUP BY ALL)
SELECT batch_id, path, declared, CAST(coalesce(counted,0) AS BIGINT) AS counted FROM d FULL JOIN r USING (batch_id, path)""")
def control_totals(spark, sf):  # AGG-08: counts; export_trailers has the sums
    return R.control_totals(table(spark, sf, "file_receipts"), table(spark, sf, "records").withColumnRenamed("file", "path"), ["batch_id", "path"], "declared_records")


@query("SELECT 'suppliers' AS dataset, max(change_seq) AS watermark FROM suppliers UNION ALL SELECT 'purchase_orders', max(change_seq) FROM purchase_orders UNION ALL SELECT 'purchase_order_lines', max(change_seq) FROM purchase_order_lines")
def watermarks(spark, sf):  # AGG-09, STR-01, CMP-07
    out = None
    for t in ("suppliers", "purchase_orders", "purchase_order_lines"):
        one = table(spark, sf, t).agg(F.max("change_seq").alias("watermark")).select(F.lit(t).alias("dataset"), "watermark")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT fx_rate_id FROM (SELECT fx_rate_id, status, row_number() OVER (PARTITION BY base, quote, valid_from, rate_type ORDER BY sequence DESC, fx_rate_id) AS rn FROM fx_rates) WHERE rn=1 AND status<>'DELETED'""")
def rate_supersession(spark, sf):  # AGG-10
    r = table(spark, sf, "fx_rates").withColumn("t", -F.col("fx_rate_id"))
    return O.latest(r, ["base", "quote", "valid_from", "rate_type"], ["sequence", "t"]).where("status <> 'DELETED'").select("fx_rate_id")


@query("""SELECT part, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(idempotency_key, ':')) AS part FROM postings WHERE idempotency_key IS NOT NULL) GROUP BY 1""")
def attempts_per_reference(spark, sf):  # parts of a key; attempts_of_references counts references
    return table(spark, sf, "postings").where("idempotency_key is not null").select(F.explode(F.split("idempotency_key", ":")).alias("part")).groupBy("part").agg(_n())


@query("""WITH a AS (SELECT proposal_id AS ref, count(*) AS attempts FROM postings GROUP BY 1), d AS (SELECT proposal_id AS ref, count(DISTINCT erp_document_number) AS documents FROM postings WHERE erp_document_number IS NOT NULL GROUP BY 1),
p AS (SELECT DISTINCT proposal_id AS ref FROM proposals) SELECT coalesce(p.ref, a.ref) AS ref, CAST(coalesce(attempts,0) AS BIGINT) AS attempts, CAST(coalesce(documents,0) AS BIGINT) AS documents, coalesce(documents,0) > 1 AS duplicate
FROM p FULL JOIN a ON a.ref=p.ref LEFT JOIN d ON d.ref=a.ref WHERE coalesce(p.ref,a.ref) IS NOT NULL""")
def duplicate_groups(spark, sf):  # AGG-12, AGG-13, JN-13
    p = table(spark, sf, "proposals").select(F.col("proposal_id").alias("ref")).distinct()
    q = table(spark, sf, "postings").where("proposal_id is not null").groupBy(F.col("proposal_id").alias("ref")).agg(F.count("*").alias("attempts"), F.countDistinct("erp_document_number").alias("documents"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.join(q, "ref", "full").select("ref", z("attempts"), z("documents"), (F.coalesce("documents", F.lit(0)) > 1).alias("duplicate"))


@query("""WITH p AS (SELECT DISTINCT idempotency_key AS a, proposal_id AS b FROM postings WHERE idempotency_key IS NOT NULL AND proposal_id IS NOT NULL)
SELECT 'idempotency_key' AS side, a AS value, CAST(count(*) AS BIGINT) AS partners FROM p GROUP BY a HAVING count(*)>1 UNION ALL SELECT 'proposal_id', b, CAST(count(*) AS BIGINT) FROM p GROUP BY b HAVING count(*)>1""")
def key_bijection(spark, sf):  # AGG-14
    return R.bijection_violations(table(spark, sf, "postings"), "idempotency_key", "proposal_id")


@query("""SELECT run_id, max_by(batch_id, batch_sequence * 1000000 + receipt_id) AS last_batch, bool_or(replay) AS any_replay, list_sort(list(DISTINCT status))::VARCHAR AS statuses FROM file_receipts GROUP BY run_id""")
def run_report(spark, sf):  # AGG-15, AGG-18, FLT-07
    g = table(spark, sf, "file_receipts").groupBy("run_id").agg(F.max_by("batch_id", F.struct("batch_sequence", "receipt_id")).alias("last_batch"), F.bool_or("replay").alias("any_replay"), F.array_sort(F.collect_set("status")).alias("s"))
    return g.select("run_id", "last_batch", "any_replay", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("statuses"))


@query("""WITH h AS (SELECT status, sha256(coalesce('=' || proposal_id, '-') || chr(31) || coalesce('=' || CAST(seq AS VARCHAR), '-') || chr(31) || coalesce('=' || CAST(attempts AS VARCHAR), '-')) AS h FROM proposals),
a AS (SELECT status, left(h,4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1,2), b AS (SELECT status, left(p,2) AS p, sha256(string_agg(h, '' ORDER BY p, h)) AS h FROM a GROUP BY status, left(p,2))
SELECT status, sha256(string_agg(h, '' ORDER BY p, h)) AS digest FROM b GROUP BY status""")
def state_digest(spark, sf):  # AGG-16, HSH-02, HSH-03
    p = table(spark, sf, "proposals").select("status", H.content_hash(F.col("proposal_id"), F.col("seq"), F.col("attempts")).alias("h"))
    return H.state_digest(p, "status", "h")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*)*1000 // count(DISTINCT user_id) AS BIGINT) AS per_user_milli FROM events GROUP BY 1""")
def request_ratio(spark, sf):  # AGG-17
    g = table(spark, sf, "events").groupBy("event_type").agg(_n(), F.countDistinct("user_id").alias("u"))
    return g.select("event_type", "n", F.expr("n * 1000 div u").alias("per_user_milli"))


# -- windows and runs --------------------------------------------------------------------------
@query("""SELECT event_id, CAST(max(CASE WHEN event_type='purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS last_purchase FROM events""")
def carry_forward(spark, sf):  # WIN-06, SRC-10
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("p"))
    return O.running(e, ["user_id"], "event_id", F.col("p"), "last_purchase", "max").select("event_id", "last_purchase")


@query("""WITH f AS (SELECT idempotency_key AS k, min(posting_id) AS first FROM postings WHERE http_status BETWEEN 400 AND 499 AND idempotency_key IS NOT NULL GROUP BY 1)
SELECT p.posting_id FROM postings p JOIN f ON f.k = p.idempotency_key WHERE p.posting_id > f.first""")
def wasted_retries(spark, sf):  # FLT-05: by status alone; retries_within_batch looks inside a batch
    p = table(spark, sf, "postings").where("idempotency_key is not null")
    f = p.where(F.col("http_status").between(400, 499)).groupBy("idempotency_key").agg(F.min("posting_id").alias("first"))
    return p.join(f, "idempotency_key").where("posting_id > first").select("posting_id")


@query("""SELECT base, fx_rate_id, CASE WHEN valid_to IS NULL THEN 'open' WHEN nxt IS NULL THEN 'last' WHEN nxt > valid_to THEN 'gap' WHEN nxt < valid_to THEN 'overlap' ELSE 'tiled' END AS fit FROM (
SELECT base, fx_rate_id, valid_to, lead(valid_from) OVER (PARTITION BY base ORDER BY valid_from, sequence, fx_rate_id) AS nxt FROM fx_rates WHERE quote='CHF' AND rate_type='DAILY')""")
def validity_tiling(spark, sf):  # WIN-11, FN-19: a fixed table
    w = Window.partitionBy("base").orderBy("valid_from", "sequence", "fx_rate_id")
    r = table(spark, sf, "fx_rates").where("quote = 'CHF' and rate_type = 'DAILY'").withColumn("nxt", F.lead("valid_from").over(w))
    fit = F.when(F.col("valid_to").isNull(), "open").when(F.col("nxt").isNull(), "last").when(F.col("nxt") > F.col("valid_to"), "gap").when(F.col("nxt") < F.col("valid_to"), "overlap").otherwise("tiled")
    return r.select("base", "fx_rate_id", fit.alias("fit"))


# -- sets and comparison -----------------------------------------------------------------------
@query("""(SELECT DISTINCT proposal_id, 'unposted' AS side FROM proposals WHERE proposal_id NOT IN (SELECT proposal_id FROM postings WHERE proposal_id IS NOT NULL)) UNION ALL
(SELECT DISTINCT proposal_id, 'unproposed' FROM postings WHERE proposal_id IS NOT NULL AND proposal_id NOT IN (SELECT proposal_id FROM proposals))""")
def posting_set_difference(spark, sf):  # SET-01, SET-02, SET-03, CMP-09
    a = table(spark, sf, "proposals").select("proposal_id")
    b = table(spark, sf, "postings").where("proposal_id is not null").select("proposal_id")
    return R.symmetric_difference(a, b, ("unposted", "unproposed"))


@query("SELECT DISTINCT batch_id, path FROM (SELECT batch_id, path FROM purchase_order_lines UNION SELECT batch_id, file FROM records) EXCEPT SELECT batch_id, path FROM file_receipts")
def foreign_files(spark, sf):  # SET-04
    a = table(spark, sf, "purchase_order_lines").select("batch_id", "path").union(table(spark, sf, "records").select("batch_id", "file"))
    return a.subtract(table(spark, sf, "file_receipts").select("batch_id", "path"))


@query("SELECT DISTINCT currency FROM suppliers WHERE currency IS NOT NULL UNION SELECT currency FROM purchase_orders WHERE currency IS NOT NULL UNION SELECT source_currency FROM proposals WHERE source_currency IS NOT NULL")
def known_currencies(spark, sf):  # SET-05
    a = table(spark, sf, "suppliers").select("currency").union(table(spark, sf, "purchase_orders").select("currency")).union(table(spark, sf, "proposals").select("source_currency"))
    return a.where("currency is not null").distinct()


_PO_F = ["supplier_number", "company_code", "currency", "status", "order_date", "cost_center"]


@query(f"""WITH r AS (SELECT *, {_sql_order('po_number')} AS k, row_number() OVER (PARTITION BY {_sql_order('po_number')} ORDER BY change_seq, po_row_id) AS a, row_number() OVER (PARTITION BY {_sql_order('po_number')} ORDER BY change_seq DESC, po_row_id DESC) AS b FROM purchase_orders)
""" + " UNION ALL ".join(f"SELECT o.k AS order_key, '{c}' AS field, CAST(o.{c} AS VARCHAR) AS old_value, CAST(n.{c} AS VARCHAR) AS new_value FROM r o JOIN r n ON o.k=n.k AND o.a=1 AND n.b=1 WHERE o.{c} IS DISTINCT FROM n.{c}" for c in _PO_F))
def order_field_diff(spark, sf):  # CMP-03, FN-24
    o = table(spark, sf, "purchase_orders").withColumn("order_key", X.canonical_order_number(F.col("po_number"))).where("order_key is not null")
    new = O.latest(o, ["order_key"], ["change_seq", "po_row_id"])
    old = O.latest(o.withColumn("a", -F.col("change_seq")).withColumn("b", -F.col("po_row_id")), ["order_key"], ["a", "b"])
    return R.field_diff(old, new, ["order_key"], _PO_F)


@query("""WITH a AS (SELECT batch_id, path, max(parsed_records) AS x FROM file_receipts GROUP BY ALL), b AS (SELECT batch_id, path, count(*) AS y FROM purchase_order_lines GROUP BY ALL)
SELECT batch_id, path, x AS counter, CAST(y AS BIGINT) AS server, abs(x-y) <= 2 AS agrees FROM a JOIN b USING (batch_id, path) WHERE x IS NOT NULL""")
def counter_crosscheck(spark, sf):  # CMP-05
    a = table(spark, sf, "file_receipts").groupBy("batch_id", "path").agg(F.max("parsed_records").alias("counter")).where("counter is not null")
    b = table(spark, sf, "purchase_order_lines").groupBy("batch_id", "path").agg(F.count("*").alias("server"))
    return a.join(b, ["batch_id", "path"]).select("batch_id", "path", "counter", "server", (F.abs(F.col("counter") - F.col("server")) <= 2).alias("agrees"))


@query("""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{10}'))) AS supplier_number FROM documents)
SELECT DISTINCT doc_id, supplier_number FROM c WHERE supplier_number IN (SELECT supplier_number FROM suppliers)""")
def needle_scan(spark, sf):  # runs of ten digits only; needle_scan_all finds every number
    return R.needle_hits(table(spark, sf, "documents"), "doc_id", F.col("text"), "[0-9]{10}", table(spark, sf, "suppliers"), "supplier_number")


@query(f"""WITH n AS (SELECT DISTINCT {sql_trim('supplier_number')} AS n FROM suppliers) SELECT DISTINCT doc_id, n AS supplier_number FROM documents JOIN n ON n <> '' AND contains(text, n)""")
def needle_scan_all(spark, sf):  # CMP-06, FLT-02
    return R.occurrences(table(spark, sf, "documents"), "doc_id", F.col("text"), table(spark, sf, "suppliers"), "supplier_number")


@query("""WITH s AS (SELECT dataset, coalesce(accepted,0) AS e, coalesce(seen,0) AS p FROM file_receipts)
SELECT dataset, CAST(CASE WHEN dataset='supplier' THEN least(sum(e), 500) ELSE sum(e) END AS BIGINT) AS earned, CAST(CASE WHEN dataset='supplier' THEN least(sum(p), 500) ELSE sum(p) END AS BIGINT) AS possible FROM s GROUP BY 1""")
def capped_rollup(spark, sf):  # the cap alone; score_bands has the bands
    s = table(spark, sf, "file_receipts").select("dataset", F.coalesce("accepted", F.lit(0)).alias("e"), F.coalesce("seen", F.lit(0)).alias("p"))
    return R.capped_rollup(s, "dataset", "e", "p", {"supplier": 500})


@query("""SELECT CAST(count(DISTINCT n) AS BIGINT) AS templates FROM (SELECT regexp_replace(text, '[0-9]+', '#', 'g') AS n FROM documents WHERE text IS NOT NULL)""")
def normalised_texts(spark, sf):  # the mask alone; replay_comparison compares artifacts
    return table(spark, sf, "documents").where("text is not null").select(F.regexp_replace("text", "[0-9]+", "#").alias("n")).distinct().agg(F.count("*").alias("templates"))


# -- deliveries --------------------------------------------------------------------------------
@query("""WITH f AS (SELECT *, first_value(sha256) OVER (PARTITION BY batch_id, path ORDER BY received_at, receipt_id) AS h0, row_number() OVER (PARTITION BY batch_id, path ORDER BY received_at, receipt_id) AS rn FROM file_receipts)
SELECT receipt_id, CASE WHEN rn=1 THEN 'first' WHEN sha256 IS NOT DISTINCT FROM h0 THEN 'replay' ELSE 'conflict' END AS outcome FROM f""")
def delivery_replays(spark, sf):  # UPD-06
    f = table(spark, sf, "file_receipts").select("batch_id", "path", "receipt_id", "received_at", "sha256")
    first = f.groupBy("batch_id", "path").agg(F.min(F.struct("received_at", "receipt_id", "sha256")).alias("x"))
    j = f.join(first, ["batch_id", "path"])
    return j.select("receipt_id", F.when(F.col("receipt_id") == F.col("x.receipt_id"), "first").when(F.col("sha256").eqNullSafe(F.col("x.sha256")), "replay").otherwise("conflict").alias("outcome"))


@query(f"""WITH k AS (SELECT *, {sql_trim('idempotency_key')} AS k FROM postings WHERE idempotency_key IS NOT NULL), f AS (SELECT *, row_number() OVER w AS rn, first_value(proposal_id) OVER w AS p0, first_value(erp_document_number) OVER w AS d0 FROM k WINDOW w AS (PARTITION BY k ORDER BY received_at, posting_id))
SELECT posting_id, CASE WHEN rn=1 THEN 'executed' WHEN proposal_id IS NOT DISTINCT FROM p0 THEN 'replayed' ELSE 'conflict' END AS outcome FROM f""")
def idempotency_outcomes(spark, sf):  # STR-02, CMP-14
    p = table(spark, sf, "postings").where("idempotency_key is not null").select(X.trim_ws(F.col("idempotency_key")).alias("k"), "posting_id", "received_at", "proposal_id")
    first = p.groupBy("k").agg(F.min(F.struct("received_at", "posting_id", "proposal_id")).alias("x"))
    j = p.join(first, "k")
    return j.select("posting_id", F.when(F.col("posting_id") == F.col("x.posting_id"), "executed").when(F.col("proposal_id").eqNullSafe(F.col("x.proposal_id")), "replayed").otherwise("conflict").alias("outcome"))


@query("""SELECT batch_id, file, CAST(count(*) FILTER (WHERE outcome='accepted') AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE outcome='rejected') AS BIGINT) AS rejected,
CASE WHEN count(outcome)=0 THEN 'pending' WHEN count(*) FILTER (WHERE outcome='rejected')>0 THEN 'partial' ELSE 'accepted' END AS status FROM records GROUP BY ALL""")
def file_status(spark, sf):  # RUL-12, FLT-06
    r = table(spark, sf, "records")
    g = r.groupBy("batch_id", "file").agg(F.count(F.when(F.col("outcome") == "accepted", 1)).alias("accepted"), F.count(F.when(F.col("outcome") == "rejected", 1)).alias("rejected"), F.count("outcome").alias("judged"))
    return g.select("batch_id", "file", "accepted", "rejected", F.when(F.col("judged") == 0, "pending").when(F.col("rejected") > 0, "partial").otherwise("accepted").alias("status"))


@query("""SELECT record_id, coalesce(code, 'ok') AS first_finding FROM records WHERE outcome IS NOT NULL""")
def receipt_records(spark, sf):  # FLT-06: judged records; first_findings orders errors and warnings
    return table(spark, sf, "records").where("outcome is not null").select("record_id", F.coalesce("code", F.lit("ok")).alias("first_finding"))


@query("""SELECT p.proposal_id, split_part(p.invoice_key, chr(31), 1) AS supplier_number, split_part(p.invoice_key, chr(31), 2) AS invoice_number, q.n AS postings FROM (SELECT DISTINCT proposal_id, invoice_key FROM proposals) p LEFT JOIN (SELECT proposal_id, count(*) AS n FROM postings GROUP BY 1) q USING (proposal_id)""")
def outbox_rows(spark, sf):  # FN-13; outbox_details has the whole row
    p = table(spark, sf, "proposals").select("proposal_id", "invoice_key").distinct()
    q = table(spark, sf, "postings").groupBy("proposal_id").agg(F.count("*").alias("postings"))
    return p.join(q, "proposal_id", "left").select("proposal_id", X.key_part(F.col("invoice_key"), 0).alias("supplier_number"), X.key_part(F.col("invoice_key"), 1).alias("invoice_number"), "postings")


# -- functions ---------------------------------------------------------------------------------
@query("""SELECT revision_id, CASE WHEN fx_rate_factor > 0 THEN CAST((CASE WHEN (source_amount_minor<0) <> (r<0) THEN -1 ELSE 1 END) * ((abs(CAST(source_amount_minor AS HUGEINT)*r) + (CAST(fx_rate_factor AS HUGEINT)*1000000)//2) // (CAST(fx_rate_factor AS HUGEINT)*1000000)) AS DECIMAL(22,0)) / 100 END::DECIMAL(22,2) AS amount
FROM (SELECT *, CAST(CAST(fx_rate_used AS DECIMAL(18,6))*1000000 AS HUGEINT) AS r FROM proposals WHERE fx_rate_used IS NOT NULL)""")
def converted_amounts(spark, sf):  # FN-06, FN-08
    p = table(spark, sf, "proposals").where("fx_rate_used is not null")
    amount = (F.col("source_amount_minor").cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    return p.select("revision_id", N.multiply_rate(amount, F.col("fx_rate_used").cast("decimal(18,6)"), F.col("fx_rate_factor")).alias("amount"))


@query(f"""SELECT line_id, {_sql_order('po_number')} AS order_key, CASE WHEN contains({sql_trim('po_number')}, '/') THEN regexp_extract({sql_trim('po_number')}, '/(.*)$', 1) END AS suffix FROM purchase_order_lines""")
def order_references(spark, sf):  # FN-11, FN-12, FN-14
    l = table(spark, sf, "purchase_order_lines")
    return l.select("line_id", X.canonical_order_number(F.col("po_number")).alias("order_key"), X.line_suffix(F.col("po_number")).alias("suffix"))


@query("SELECT change_id, CASE WHEN length(iban) <= 8 THEN iban ELSE left(iban,4) || repeat('*', length(iban)-8) || right(iban,4) END AS masked FROM suppliers")
def masked_ibans(spark, sf):  # FN-16
    return table(spark, sf, "suppliers").select("change_id", X.mask_middle(F.col("iban")).alias("masked"))


@query("""SELECT posting_id, CAST(received_at + INTERVAL 1 HOUR * (CASE WHEN received_at >= s AND received_at < e THEN 2 ELSE 1 END) AS DATE) AS posting_date, CAST(year(received_at) AS INTEGER) AS fiscal_year FROM (SELECT posting_id, received_at,
CASE year(received_at) WHEN 2025 THEN TIMESTAMP '2025-03-30 01:00:00' ELSE TIMESTAMP '2026-03-29 01:00:00' END AS s, CASE year(received_at) WHEN 2025 THEN TIMESTAMP '2025-10-26 01:00:00' ELSE TIMESTAMP '2026-10-25 01:00:00' END AS e FROM postings)""")
def posting_dates(spark, sf):  # FN-17, FN-18, FN-19
    p = table(spark, sf, "postings")
    return p.select("posting_id", N.zurich_date(F.col("received_at").cast("timestamp")).alias("posting_date"), F.year("received_at").alias("fiscal_year"))


@query("""SELECT record_id, CAST(try_cast(CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN v END AS BIGINT) AS BIGINT) AS change_seq FROM (SELECT record_id, list_last(string_split(replace(replace(raw_text, '|', ';'), ',', ';'), ';')) AS v FROM records)""")
def trailing_integers(spark, sf):  # FN-02, FN-22
    v = F.element_at(F.split(F.translate("raw_text", "|,", ";;"), ";"), -1)
    return table(spark, sf, "records").select("record_id", N.parse_integer(v).alias("change_seq"))


@query("""SELECT fx_rate_id, CAST(valid_from AS DATE) AS d, strftime(CAST(valid_from AS DATE), '%d%m%y') AS short FROM fx_rates""")
def short_dates(spark, sf):  # FN-05
    r = table(spark, sf, "fx_rates").withColumn("short", F.date_format(F.to_date("valid_from"), "ddMMyy"))
    return r.select("fx_rate_id", N.short_date(F.col("short")).alias("d"), "short")


@query("""SELECT fx_rate_id, CAST(replace(replace(replace(rate, '.', '#'), ',', '.'), '#', ',') AS VARCHAR) AS literal, CAST(rate AS DECIMAL(38,6)) AS value FROM fx_rates""")
def host_rates(spark, sf):  # FN-03
    r = table(spark, sf, "fx_rates").withColumn("literal", F.translate("rate", ".", ","))
    return r.select("fx_rate_id", "literal", N.host_number(F.col("literal")).alias("value"))


@query("""SELECT DISTINCT proposal_id, 'twn_' || left(sha256('twin' || 'invoice' || chr(31) || invoice_key), 16) AS twin FROM proposals""")
def twin_ids(spark, sf):  # HSH-04
    p = table(spark, sf, "proposals").select("proposal_id", "invoice_key").distinct()
    return p.select("proposal_id", H.twin_id("twin", F.lit("invoice"), F.col("invoice_key")).alias("twin"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def canonical_payloads(spark, sf):  # HSH-01
    return table(spark, sf, "events").select("event_id", H.canonical_json_udf(F.col("props")).alias("canonical"))


@query()
def fault_picks(spark, sf):  # STR-05: FNV-1a has no SQL form here
    return table(spark, sf, "events").select("event_id", H.fnv1a64_mod(23)(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))).alias("bucket"))


@query("""SELECT doc_id, nfc_normalize(text) = text AS composed FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x{0000}-\\x{024F}\\x{0300}-\\x{036F}\\x{2000}-\\x{206F}\\x{20AC}\\x{2122}]')""")
def composed_texts(spark, sf):  # the part of composed_texts_all on which full NFC agrees, against nfc_normalize
    d = table(spark, sf, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike("[^\\x{0000}-\\x{024F}\\x{0300}-\\x{036F}\\x{2000}-\\x{206F}\\x{20AC}\\x{2122}]"))
    return d.select("doc_id", (H.compose_marks_udf(F.col("text")) == F.col("text")).alias("composed"))


@query("""WITH p AS (SELECT chr(CAST(b AS INTEGER)) || m AS p FROM range(65, 123) r(b), (SELECT unnest([chr(768), chr(769), chr(770), chr(771), chr(776), chr(778), chr(807)]) AS m) WHERE length(nfc_normalize(chr(CAST(b AS INTEGER)) || m)) = 1)
SELECT doc_id, NOT regexp_matches(text, (SELECT string_agg(p, '|') FROM p)) AS composed FROM documents WHERE text IS NOT NULL""")
def composed_texts_all(spark, sf):  # FN-15: every text, of any script
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", (H.compose_marks_udf(F.col("text")) == F.col("text")).alias("composed"))


@query("""SELECT change_id, CASE WHEN contains(lower(coalesce(name,'')), 'kabel') OR contains(lower(coalesce(iban,'')), 'kabel') THEN true ELSE false END AS hit FROM suppliers""")
def name_search(spark, sf):  # FLT-02
    return table(spark, sf, "suppliers").select("change_id", X.contains_any_case("Kabel", F.col("name"), F.col("iban")).alias("hit"))
