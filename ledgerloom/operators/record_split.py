"""Rows that fail to parse: raw CSV record texts to typed rows and rejects.

Tokens come from one possessive regular expression (JVM, no stack growth on long
fields). The cells are exploded to (row, column, value), joined with a rule table,
validated, errors aggregated per row, and the clean rows anti-joined.

Defined results: reasons in this order: ``quoting``, ``column_count``, ``value``; with ``ranges`` also
``range``: the value is well formed, but its column's type cannot hold it (digits beyond bigint, a number
beyond decimal(38,12)), so no typed row is rounded or emptied in silence. A field is quoted
if its first character is the quote; it must close right before the delimiter or the
end. A null text is one empty field. A text whose file has no receipt takes the
dataset's default header and a comma. An unknown dataset has no rules, only framing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import CURRENCY_SCALE, canonical_number, number_value, real_date
from ..functions.text import trim_ws

#: Canonical column order of the datasets.
HEADERS = {
    "supplier": "supplier_number name country currency iban vat_number payment_terms_days blocked change_seq".split(),
    "purchase_order_line": "po_number line_no material description quantity uom unit_price currency gl_account cost_center change_seq".split(),
    "fx_rate": "base quote valid_from rate_type valid_to rate rate_factor sequence status".split(),
}
#: Units of measure.
UNITS = "EA PCE CTN KG G L M STK STD PAU M2 H TON PAL".split()

#: dataset, column, check, code of the finding
RULES = [
    ("supplier", "supplier_number", "key", "E_KEY_MISSING"),
    ("supplier", "name", "filled", "E_FIELD_REQUIRED"),
    ("supplier", "country", "country", "E_COUNTRY_FORMAT"),
    ("supplier", "currency", "currency", "E_CURRENCY_UNKNOWN"),
    ("supplier", "payment_terms_days", "digits", "E_NUMBER_FORMAT"),
    ("supplier", "blocked", "flag", "E_FIELD_INVALID"),
    ("supplier", "change_seq", "digits", "E_NUMBER_FORMAT"),
    ("purchase_order_line", "po_number", "key", "E_KEY_MISSING"),
    ("purchase_order_line", "line_no", "key", "E_KEY_MISSING"),
    ("purchase_order_line", "quantity", "number", "E_DECIMAL_FORMAT"),
    ("purchase_order_line", "uom", "unit", "E_UOM_UNKNOWN"),
    ("purchase_order_line", "unit_price", "number", "E_DECIMAL_FORMAT"),
    ("purchase_order_line", "currency", "currency", "E_CURRENCY_UNKNOWN"),
    ("purchase_order_line", "change_seq", "digits", "E_NUMBER_FORMAT"),
    ("fx_rate", "base", "currency", "E_CURRENCY_UNKNOWN"),
    ("fx_rate", "quote", "currency", "E_CURRENCY_UNKNOWN"),
    ("fx_rate", "valid_from", "date", "E_DATE_FORMAT"),
    ("fx_rate", "valid_to", "date_or_empty", "E_DATE_FORMAT"),
    ("fx_rate", "rate_type", "rate_type", "E_FIELD_INVALID"),
    ("fx_rate", "rate", "number", "E_DECIMAL_FORMAT"),
    ("fx_rate", "rate_factor", "digits", "E_NUMBER_FORMAT"),
    ("fx_rate", "sequence", "digits", "E_NUMBER_FORMAT"),
    ("fx_rate", "status", "status", "E_FIELD_INVALID"),
]


def rule_table(spark: SparkSession) -> DataFrame:
    """About two rows per column of the datasets: small enough to broadcast at any data size."""
    return spark.createDataFrame(RULES, "dataset string, name string, check string, code string")


def dialects(receipts: DataFrame) -> DataFrame:
    """One dialect per (batch_id, path); a receipt sent again repeats it."""
    cols = ["delimiter", "decimal_separator", "thousands_separator", "date_format", "header_line"]
    return receipts.groupBy("batch_id", "path").agg(F.min(F.struct("receipt_id", *cols)).alias("x")).select("batch_id", "path", *[f"x.{c}" for c in cols])


def _literal(text: Column) -> Column:
    """A regular expression for the text as it stands."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def fields(text: Column, delimiter: Column) -> Column:
    """Fields of a record as written. The delimiter may be several characters long. A field that opens
    a quote and does not close right before a delimiter ends at the next delimiter."""
    at = F.concat(F.lit("["), F.when(delimiter.isin("\\", "^", "]", "["), F.concat(F.lit("\\"), delimiter)).otherwise(delimiter), F.lit("]"))
    other = F.concat(F.lit("[^"), F.substring(at, 2, 9))
    quoted = _literal(delimiter)
    long = F.length(delimiter) > 1
    at, other = F.when(long, quoted).otherwise(at), F.when(long, F.concat(F.lit("(?:(?!"), quoted, F.lit(")[\\s\\S])"))).otherwise(other)
    pattern = F.concat(F.lit('("(?:[^"]++|"")*+"|'), other, F.lit("*+)"), at)
    return F.regexp_extract_all(F.concat(F.coalesce(text, F.lit("")), delimiter), pattern, F.lit(1))


def bad_quoting(raw: Column) -> Column:
    return raw.startswith('"') & ~raw.rlike('(?s)^"(?:[^"]++|"")*+"$')


def unquoted(raw: Column) -> Column:
    inner = F.replace(F.substring(raw, 2, 2**31 - 1), F.lit('""'), F.lit('"'))
    return F.when(raw.startswith('"'), F.left(inner, F.length(inner) - 1)).otherwise(raw)


def framed(records: DataFrame, receipts: DataFrame) -> DataFrame:
    """record_id, line, dataset, the dialect, cells array<struct<pos,name,raw>>, n_cells, n_header."""
    r = records.select("record_id", "batch_id", F.col("file").alias("path"), "line", "dataset", "raw_text")
    # the header is split once per file, before the join: per record it would be split per field
    d = dialects(receipts).withColumn("delimiter", F.coalesce(F.when(F.col("delimiter") != "", F.col("delimiter")), F.lit(",")))
    names = F.split("header_line", _literal(F.col("delimiter")))
    d = d.withColumn("header", F.transform(names, lambda h: trim_ws(h))).drop("header_line")
    j = r.join(d, ["batch_id", "path"], "left")
    delim = F.coalesce("delimiter", F.lit(","))
    default = F.lit(None).cast("array<string>")
    for name, cols in HEADERS.items():
        default = F.when(F.col("dataset") == name, F.array(*map(F.lit, cols))).otherwise(default)
    j = j.select("record_id", "line", "dataset", "decimal_separator", "thousands_separator", (F.col("date_format") == "DD.MM.YYYY").alias("dotted"), F.coalesce("header", default).alias("header"), fields(F.col("raw_text"), delim).alias("raws"))
    cells = F.transform("raws", lambda x, i: F.struct(i.alias("pos"), F.get("header", i).alias("name"), x.alias("raw")))
    return j.select("record_id", "line", "dataset", "decimal_separator", "thousands_separator", F.coalesce("dotted", F.lit(False)).alias("dotted"), cells.alias("cells"), F.size("raws").alias("n_cells"), F.size("header").alias("n_header"))


def valid(check: Column, v: Column, dec: Column, tho: Column, dotted: Column) -> Column:
    """The rules' evaluation on a trimmed value."""
    return (
        F.when(check.isin("key", "filled"), v != "")
        .when(check == "country", v.rlike("^(?:[A-Z]{2})?$"))
        .when(check == "currency", v.isin(*CURRENCY_SCALE))
        .when(check == "digits", v.rlike("^[0-9]+$"))
        .when(check == "flag", F.lower(v).isin("", "true", "false", "1", "0"))
        .when(check == "unit", v.isin(*UNITS))
        .when(check == "rate_type", v.isin("DAILY", "MONTHLY_AVG"))
        .when(check == "status", v.isin("ACTIVE", "DELETED"))
        .when(check == "number", canonical_number(v, dec, tho) != "")
        .when(check == "date", real_date(v, dotted).isNotNull())
        .when(check == "date_or_empty", (v == "") | real_date(v, dotted).isNotNull())
        .otherwise(True)
    )


def fits(check: Column, v: Column, dec: Column, tho: Column) -> Column:
    """Whether the column's type holds a valid value without loss."""
    return F.when(check == "digits", v.try_cast("bigint").isNotNull()).when(check == "number", number_value(canonical_number(v, dec, tho)).isNotNull()).otherwise(True)


def rejects(frames: DataFrame, ranges: bool = False) -> DataFrame:
    """record_id, line, outcome, reason, code, field (of the first finding, null for framing)."""
    rules = F.broadcast(rule_table(frames.sparkSession))
    cells = frames.select("record_id", "line", "dataset", "decimal_separator", "thousands_separator", "dotted", (F.col("n_cells") != F.coalesce("n_header", F.lit(-1))).alias("miscounted"), F.explode("cells").alias("c"))
    cells = cells.select("*", "c.pos", "c.name", "c.raw").drop("c").withColumn("v", trim_ws(unquoted(F.col("raw"))))
    j = cells.join(rules, ["dataset", "name"], "left")
    dialect = F.col("decimal_separator"), F.col("thousands_separator")
    ok = valid(F.col("check"), F.col("v"), *dialect, F.col("dotted"))
    # closed, but followed by something: the field is wrong; never closed: the record is
    torn = F.when(F.col("raw").rlike('^"(?:[^"]++|"")*+"(?!")'), "E_FIELD_INVALID").otherwise("E_MALFORMED_DOCUMENT")
    rank = F.when(bad_quoting(F.col("raw")), 1).when(F.col("miscounted"), 2).when(F.col("check").isNotNull() & ~F.coalesce(ok, F.lit(False)), 3)
    if ranges:
        rank = rank.when(~F.coalesce(fits(F.col("check"), F.col("v"), *dialect), F.lit(True)), 4)
    bad = j.withColumn("rank", rank).where("rank is not null")
    first = bad.groupBy("record_id").agg(F.min(F.struct("rank", "pos", "line", "name", F.when(F.col("rank") == 1, torn).otherwise(F.col("code")).alias("code"))).alias("x"))
    r = F.col("x.rank")
    return first.select(
        "record_id", F.col("x.line").alias("line"), F.lit("rejected").alias("outcome"),
        F.when(r == 1, "quoting").when(r == 2, "column_count").when(r == 3, "value").otherwise("range").alias("reason"),
        F.when(r == 2, "E_FIELD_INVALID").otherwise(F.col("x.code")).alias("code"),
        F.when(r >= 3, F.col("x.name")).alias("field"),
    )


def _named(name: str):
    return lambda c: c["name"] == name


def typed_rows(frames: DataFrame, bad: DataFrame, dataset: str) -> DataFrame:
    """Clean rows of a dataset: the frames anti-joined with the rejects (with ``ranges``, else a value its
    type cannot hold is null), columns typed by the rules."""
    clean = frames.where(F.col("dataset") == dataset).join(bad.select("record_id"), "record_id", "left_anti")
    kinds = {n: k for d, n, k, _ in RULES if d == dataset}
    out = [F.col("record_id"), F.col("line")]
    for n in HEADERS[dataset]:
        # the first cell of the name: a header that repeats one is no error here
        cell = F.get(F.filter("cells", _named(n)), F.lit(0))
        v = trim_ws(unquoted(cell["raw"]))
        k = kinds.get(n)
        if k == "number":
            v = number_value(canonical_number(v, F.col("decimal_separator"), F.col("thousands_separator")))
        elif k == "digits":
            v = v.try_cast("bigint")
        elif k == "flag":
            v = F.lower(v).isin("true", "1")
        elif k in ("date", "date_or_empty"):
            v = real_date(v, F.col("dotted"))
        out.append(v.alias(n))
    return clean.select(*out)
