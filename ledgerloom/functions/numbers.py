"""Numbers, dates and money as columns; exact, JVM-side, never DOUBLE.

Accepted number shapes (Swiss feeds): plain, grouped in threes by ' or ’ or the declared
separator, ``12.-`` for a whole amount, one minus before or behind, accounting
parentheses, and a currency prefix of three capitals and blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = "(?:[0-9]{1,3}(?:'[0-9]{3})+|[0-9]+)"
#: canonical form: ' groups, . separates
NUMBER_SHAPE = rf"^(-?{_INT}(?:\.[0-9]+|\.-)?|{_INT}(?:\.[0-9]+)?-|\({_INT}(?:\.[0-9]+|\.-)?\))$"
#: digits after the point that exact arithmetic keeps
SCALE = 12
#: Minor-unit digits of the known currencies.
CURRENCY_SCALE = {"CHF": 2, "EUR": 2, "USD": 2, "GBP": 2, "SEK": 2, "DKK": 2, "NOK": 2, "HUF": 2, "IDR": 2, "JPY": 0}


def canonical_number(text: Column, decimal_sep: Column, thousands_sep: Column) -> Column:
    """The text with ' for every accepted group mark and . for the decimal separator, the
    currency prefix gone; empty if it is none of the accepted shapes. A null or empty
    decimal separator is a point, any other than point or comma makes every number invalid."""
    dec = F.coalesce(F.when(decimal_sep != "", decimal_sep), F.lit("."))
    tho = F.coalesce(F.when((thousands_sep != "") & (thousands_sep != dec), thousands_sep), F.lit("'"))
    # every step refers to the one before once, so the generated code stays small
    t = F.replace(F.regexp_replace(text, "^[A-Z]{3} +(?=.)", ""), tho, F.lit("'"))
    comma = dec == ","
    t = F.call_function("translate", t, F.when(comma, "’,.").otherwise("’"), F.when(comma, "'.!").otherwise("'"))
    return F.regexp_extract(F.when(dec.isin(".", ","), t).otherwise(""), NUMBER_SHAPE, 1)


def number_value(canonical: Column) -> Column:
    """DECIMAL(38,12) of a canonical number; null if it does not fit exactly."""
    t = F.replace(F.replace(canonical, F.lit("'"), F.lit("")), F.lit(".-"), F.lit(""))
    t = F.regexp_replace(t, r"^\((.*)\)$|^([0-9].*)-$", "-$1$2")
    t = F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_extract(t, rf"^-?[0-9]+\.?[0-9]{{0,{SCALE}}}$", 0).try_cast(f"decimal(38,{SCALE})")


def parse_number(text: Column, decimal_sep: Column, thousands_sep: Column) -> Column:
    return number_value(canonical_number(text, decimal_sep, thousands_sep))


def parse_integer(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))


def host_number(text: Column) -> Column:
    """Host notation 1.234,567890: points group, a comma separates."""
    t = F.when(text.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})*(,[0-9]+)?$"), F.translate(text, ",.", "."))
    return t.try_cast("decimal(38,6)")


def real_date(text: Column, dotted: Column) -> Column:
    """DATE of YYYY-MM-DD, or of DD.MM.YYYY where ``dotted`` is true; null if not a real date."""
    iso = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    dot = F.when(dotted & text.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.try_to_date(text, "dd.MM.yyyy"))
    # years under 1 are no calendar years
    return F.when(~text.startswith("0000") & ~text.endswith(".0000"), F.coalesce(iso, dot))


def short_date(text: Column, pivot: int = 70) -> Column:
    """DDMMYY; years from the pivot on belong to the twentieth century."""
    yy = F.right(text, F.lit(2)).try_cast("int")
    year = F.lpad((F.when(yy >= pivot, 1900).otherwise(2000) + yy).cast("string"), 4, "0")
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(year, F.substring(text, 3, 2), F.substring(text, 1, 2)), "yyyyMMdd"))


def in_half_open(d: Column, lo: Column, hi: Column) -> Column:
    """lo <= d < hi; a null hi is open."""
    return (d >= lo) & (hi.isNull() | (d < hi))


def zurich_date(instant: Column) -> Column:
    return F.from_utc_timestamp(instant, "Europe/Zurich").cast("date")


def multiply_rate(amount: Column, rate: Column, factor: Column) -> Column:
    """amount(…,2) * rate(…,6) / factor to two decimals, half away from zero, rounded once.

    In integers, because a decimal division followed by round rounds twice
    (0.04 * 12.499999 / 100 is 0.00). Null for a factor that is not positive."""
    a = (amount.cast("decimal(18,2)") * 100).cast("decimal(18,0)")
    r = (rate.cast("decimal(18,6)") * 1000000).cast("decimal(18,0)")
    num = F.abs(a * r).cast("decimal(38,0)")
    den = (factor.cast("decimal(12,0)") * F.lit(1000000)).cast("decimal(38,0)")
    rem = num % den
    cents = ((num - rem) / den).cast("decimal(38,0)") + F.when(rem * 2 >= den, 1).otherwise(0)
    signed = F.when((a < 0) != (r < 0), -cents).otherwise(cents)
    return F.when(factor > 0, (signed.cast("decimal(20,0)") / 100).cast("decimal(22,2)"))


def exact_rescale(v: Column, scale: Column | int) -> Column:
    """v at the given scale, null if digits would be lost."""
    s = scale if isinstance(scale, Column) else F.lit(scale)
    out = F.coalesce(*[F.when(s == k, v.cast(f"decimal(38,{k})").cast("decimal(38,12)")) for k in range(0, 7)])
    return F.when(out == v, out)


def minor_units(v: Column, currency: Column) -> Column:
    """The amount in minor units of its currency; null for an unknown currency or a rest."""
    out = None
    for code, k in CURRENCY_SCALE.items():
        x = F.when(currency == code, v * (10**k))
        out = x if out is None else F.coalesce(out, x)
    return F.when(out == F.floor(out), out.try_cast("bigint"))


def written_number(v: Column, scale: int, decimal_sep: Column, thousands_sep: Column) -> Column:
    """The number with ``scale`` decimals, grouped in threes, in a file's separators."""
    return F.call_function("translate", F.format_number(v, scale), F.lit(",."), F.concat(thousands_sep, decimal_sep))


#: The date patterns a file may declare.
DATE_PATTERNS = ["yyyy-MM-dd", "dd.MM.yyyy", "yyyyMMdd", "dd/MM/yyyy", "ddMMyy"]


def declared_date(text: Column, pattern: Column) -> Column:
    """DATE by the declared pattern, digit for digit; null if it is none, or no real date."""
    out = F.lit(None).cast("date")
    for p in DATE_PATTERNS:
        shape = "^" + "".join("[0-9]" if c.isalpha() else "\\" + c if c in ".-/" else c for c in p) + "$"
        read = short_date(text) if p == "ddMMyy" else F.try_to_date(text, p)
        out = F.when((pattern == p) & text.rlike(shape), read).otherwise(out)
    return out


def short_stamp(text: Column) -> Column:
    """DDMMYYhhmm, years as in short_date."""
    day = short_date(F.left(text, F.lit(6)))
    at = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.substring(text, 7, 2), F.lit(":"), F.substring(text, 9, 2), F.lit(":00"))
    return F.when(text.rlike("^[0-9]{10}$"), at.try_cast("timestamp_ntz"))


def posting_day(text: Column) -> Column:
    """The date itself if the text is a plain date, the date in Zurich if it is an instant."""
    return F.when(text.contains("T"), zurich_date(text.try_cast("timestamp"))).otherwise(text.try_cast("date"))
