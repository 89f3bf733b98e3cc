"""Declarative checks on typed rows: an array of findings per row, one pass, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import CURRENCY_SCALE

Rule = tuple[str, str, Column]


def findings(df: DataFrame, rules: list[Rule], name: str = "findings") -> DataFrame:
    """rules: (code, field, condition that breaks it). A null condition breaks nothing. The order of
    the rules is the order of the findings."""
    each = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for code, field, bad in rules]
    return df.withColumn(name, F.array_compact(F.array(*each)))


def record_findings(df: DataFrame, syntax: list[Rule], rules: list[Rule], name: str = "findings") -> DataFrame:
    """The syntactic findings; only where there are none, those of the rules: a value that cannot be
    read is not reported twice."""
    both = findings(findings(df, syntax, "_syntax"), rules, "_rules")
    return both.withColumn(name, F.when(F.size("_syntax") > 0, F.col("_syntax")).otherwise(F.col("_rules"))).drop("_syntax", "_rules")


def element_findings(df: DataFrame, array: str, rules, name: str = "findings") -> DataFrame:
    """Rules on the elements of an array; the field is ``array[i].field``. rules(element) -> list of Rule."""
    def one(e, i):
        path = lambda f: F.concat(F.lit(f"{array}["), i.cast("string"), F.lit(f"].{f}"))
        return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), path(field).alias("field"))) for code, field, bad in rules(e)]))

    return df.withColumn(name, F.flatten(F.transform(array, one)))


def required(field: str, c: Column, key: bool = False) -> Rule:
    return ("E_KEY_MISSING" if key else "E_FIELD_REQUIRED", field, c.isNull() | (c == ""))


def one_of(field: str, c: Column, values, code: str = "E_ENUM_UNKNOWN") -> Rule:
    return (code, field, c.isNotNull() & ~c.isin(*values))


def currency(field: str, c: Column) -> Rule:
    return one_of(field, c, CURRENCY_SCALE, "E_CURRENCY_UNKNOWN")


def closed(field: str, c: Column, values, code: str = "E_ENUM_UNKNOWN") -> list[Rule]:
    """A mandatory value of a closed set: null or empty is required, any other unknown."""
    return [required(field, c), (code, field, (c != "") & ~c.isin(*values))]


def calendar_date(field: str, text: Column) -> Rule:
    """YYYY-MM-DD and a real day; null and empty are for other rules."""
    real = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull()
    return ("E_DATE_FORMAT", field, (text != "") & ~real)


def positive(field: str, canonical: Column) -> Rule:
    """A number in canonical form, of any length; null or empty counts as zero."""
    c = F.coalesce(canonical, F.lit(""))
    return ("E_FIELD_INVALID", field, c.rlike("^[-(]|[0-9]-$") | ~c.rlike("[1-9]"))


def half_open(field: str, lo: Column, hi: Column) -> Rule:
    """An empty range is invalid."""
    return ("E_FIELD_INVALID", field, hi.isNotNull() & (lo >= hi))


def max_scale(field: str, text: Column, digits: int) -> Rule:
    return ("E_MONEY_SCALE", field, text.rlike(rf"[.,][0-9]{{{digits + 1},}}"))
