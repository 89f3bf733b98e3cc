"""Text and key functions on columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "".join(
    map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
#: Separator of composite natural keys.
UNIT_SEPARATOR = "\x1f"


def trim_ws(c: Column) -> Column:
    """Without white space at either end (Spark's ``trim`` strips blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    t = trim_ws(c)
    return F.when(t != "", t)


def key_join(*parts: Column) -> Column:
    """Composite key; a null part counts as empty, so the arity stays."""
    return F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(trim_ws(p), F.lit("")) for p in parts])


def key_part(key: Column, i: int) -> Column:
    return F.element_at(F.split(key, UNIT_SEPARATOR), i + 1)


def key_from_alias(key: Column) -> Column:
    """``|`` is the typeable alias of the separator."""
    return F.translate(key, "|", UNIT_SEPARATOR)


def canonical_order_number(c: Column) -> Column:
    """Order number for comparison: trimmed, without a leading ``PO-`` and without
    ``/`` and what follows; digits only compare as a number, anything else exactly.
    Null stays null, empty stays empty."""
    t = F.regexp_replace(trim_ws(c), "^PO-", "")
    head = trim_ws(F.substring_index(t, "/", 1))
    stripped = F.regexp_replace(head, "^0+(?=[0-9])", "")
    return F.when(head.rlike("^[0-9]+$"), stripped).otherwise(head)


def line_suffix(c: Column) -> Column:
    """What follows the first ``/`` of an order reference, as written."""
    t = trim_ws(c)
    return F.when(t.contains("/"), F.regexp_extract(t, "(?s)/(.*)$", 1))


def mask_middle(c: Column) -> Column:
    """First four and last four characters kept; eight or fewer are left alone."""
    n = F.length(c)
    return F.when(n <= 8, c).otherwise(F.concat(F.left(c, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(c, F.lit(4))))


def contains_any_case(q: str, *cols: Column) -> Column:
    """Case-insensitive substring in any of the columns; an empty query matches all."""
    out = F.lit(q == "")
    for c in cols:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return out


def company_code(client: Column) -> Column:
    """Company code of a sender's client number; a company code stays, anything else is null."""
    return F.when(client == "0100", "CH10").when(client == "0200", "CH20").when(client.isin("CH10", "CH20"), client)


def signed_cursor(body: Column, secret: str) -> Column:
    """Base64 of the body, a point, and the first 32 digits of a keyed SHA-256."""
    b = F.base64(F.encode(body, "UTF-8"))
    return F.concat(b, F.lit("."), F.left(F.sha2(F.concat(F.lit(secret), b), 256), F.lit(32)))


def cursor_valid(cursor: Column, secret: str) -> Column:
    """Whether the signature fits; false for anything that is no cursor, null for null."""
    b = F.substring_index(cursor, ".", 1)
    return F.concat(b, F.lit("."), F.left(F.sha2(F.concat(F.lit(secret), b), 256), F.lit(32))) == cursor
