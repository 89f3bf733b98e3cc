"""Quantities recorded in different units: unit texts to codes by segmentation.

A unit text is segmented by dynamic programming into prefix, root, ending and exponent,
each found by walking a trie. The score of a segmentation is the sum of the log weights
of its parts plus the log prior of its dimension in the field it stands in; the best
one names dimension, factor and exponent, and thereby the unit code. ``m`` alone is a
metre and not a prefix without a root, ``h`` an hour and not hecto, ``qm`` a square
metre, because those are the only or the heaviest full segmentations.

Defined results: case, a closing point and white space do not matter; a text with no
full segmentation, or one that means a unit without a code (ml, mm), has no unit. Numbers are exact
whatever their digits: those beyond 12 after the point or 26 before it are reckoned as fractions.
"""

from __future__ import annotations

import math
import unicodedata
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.numbers import SCALE, canonical_number, number_value
from ..functions.text import blank_to_null, trim_ws
from .record_split import dialects

#: root words: dimension, base unit, weight (how sure the word is), takes SI prefixes
ROOTS = [
    (("g", "gr", "gramm", "gram", "gramme", "grammo", "grammi"), "mass", "gram", 0.9, True),
    (("kilo", "kilos"), "mass", "kilogram", 0.6, False),
    (("t", "to", "ton", "tonne", "tonnen", "tonnellata", "tonnellate"), "mass", "tonne", 0.8, False),
    (("m", "mtr", "meter", "metre", "mètre", "metro", "metri"), "length", "metre", 0.9, True),
    (("l", "lt", "ltr", "liter", "litre", "litro", "litri"), "volume", "litre", 0.9, True),
    (("h", "hr", "hour", "heure", "ora", "ore"), "time", "hour", 0.9, False),
    (("std", "stde", "stdn", "stunde"), "time", "stunde", 0.9, False),
    (("ea", "each"), "count", "each", 0.9, False),
    (("stk", "stck", "stück", "stueck", "stuck", "st"), "count", "stück", 0.9, False),
    (("pc", "pce", "piece", "pièce", "pezzo", "pezzi", "pz"), "count", "piece", 0.9, False),
    (("ctn", "ktn", "karton", "carton", "cartone", "cartoni", "kart"), "packing", "carton", 0.9, False),
    (("pal", "palette", "pallet", "paletten", "paletta"), "packing", "pallet", 0.9, False),
    (("pau", "pausch", "pauschal", "pauschale", "lump sum", "lumpsum", "forfait", "a corpo"), "lump", "lump", 0.9, False),
    (("mq",), "area", "square metre", 0.5, False),
]
#: SI prefixes (power of ten) and the words that make a root square
PREFIXES = {"kilo": 3, "k": 3, "hecto": 2, "deka": 1, "dezi": -1, "deci": -1, "d": -1, "zenti": -2, "centi": -2, "c": -2, "milli": -3, "m": -3, "mikro": -6, "micro": -6, "µ": -6, "mega": 6}
SQUARES = ("quadrat", "square ", "square", "sq", "sq ", "q", "qu")
ENDINGS = {"s": 0.5, "n": 0.5, "en": 0.3, "e": 0.2, ".": 0.9}
EXPONENTS = {"2": 2, "^2": 2, "**2": 2, "3": 3, "^3": 3, " carré": 2, " carrés": 2, " quadrato": 2, " quadrati": 2, " quadri": 2}

#: share of the dimensions in the quantity field of purchase lines
QUANTITY_PRIORS = {"count": 0.42, "mass": 0.22, "volume": 0.09, "packing": 0.1, "length": 0.06, "area": 0.05, "time": 0.05, "lump": 0.01}

#: (base unit, power of ten, exponent) to code
CODES = {
    ("gram", 0, 1): "G", ("gram", 3, 1): "KG", ("gram", 6, 1): "TON", ("kilogram", 0, 1): "KG", ("tonne", 0, 1): "TON",
    ("metre", 0, 1): "M", ("metre", 0, 2): "M2", ("square metre", 0, 1): "M2", ("litre", 0, 1): "L",
    ("hour", 0, 1): "H", ("stunde", 0, 1): "STD", ("each", 0, 1): "EA", ("stück", 0, 1): "STK", ("piece", 0, 1): "PCE",
    ("carton", 0, 1): "CTN", ("pallet", 0, 1): "PAL", ("lump", 0, 1): "PAU",
}


class Trie:
    def __init__(self, items: dict[str, object]):
        self.root: dict = {}
        for word, value in items.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node.setdefault("", []).append(value)

    def matches(self, text: str, i: int):
        """(end, value) of all words that start at i."""
        node = self.root
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                return
            for v in node.get("", ()):
                yield j + 1, v


class UnitSegmenter:
    """prefix? root ending* exponent?  States: 0 start, 1 after a prefix, 2 after a square word,
    3 after the root, 4 after the exponent."""

    def __init__(self, priors: dict[str, float] | None = None):
        self.priors = priors or QUANTITY_PRIORS
        self.roots = Trie({w: (dim, base, math.log(p), si) for words, dim, base, p, si in ROOTS for w in words})
        self.prefixes = Trie({w: (k, math.log(0.5 if len(w) > 1 else 0.2)) for w, k in PREFIXES.items()})
        self.squares = Trie({w: math.log(0.5) for w in SQUARES})
        self.endings = Trie({w: math.log(p) for w, p in ENDINGS.items()})
        self.exponents = Trie({w: (e, math.log(0.5)) for w, e in EXPONENTS.items()})

    def segment(self, text: str) -> tuple[str, str, int, int] | None:
        """(dimension, base unit, power of ten, exponent) of the best segmentation."""
        t = " ".join(unicodedata.normalize("NFKC", text).casefold().replace("m²", "m2").split())
        if not t:
            return None
        # best[i]: {(state, power, exponent, dimension, base, may take a prefix): score}
        best: list[dict] = [{} for _ in range(len(t) + 1)]
        best[0][(0, 0, 1, None, None)] = 0.0

        def put(j: int, key: tuple, score: float) -> None:
            if score > best[j].get(key, -math.inf):
                best[j][key] = score

        for i in range(len(t)):
            for (state, power, exp, dim, base), score in list(best[i].items()):
                if state == 0:
                    for j, w in self.squares.matches(t, i):
                        put(j, (2, 0, 2, None, None), score + w)
                if state in (0, 2):
                    for j, (k, w) in self.prefixes.matches(t, i):
                        put(j, (1, k, exp, None, None), score + w)
                if state in (0, 1, 2):
                    for j, (d, b, w, si) in self.roots.matches(t, i):
                        if (state == 0 or si or state == 2) and not (state == 1 and not si):
                            put(j, (3, power, exp, d, b), score + w)
                if state == 3:
                    for j, w in self.endings.matches(t, i):
                        put(j, (3, power, exp, dim, base), score + w)
                    for j, (e, w) in self.exponents.matches(t, i):
                        if exp == 1:
                            put(j, (4, power, e, dim, base), score + w)
        whole = [(s + math.log(self._prior(d, e)), b, p, e, d) for (st, p, e, d, b), s in best[len(t)].items() if st >= 3]
        if not whole:
            return None
        _, b, p, e, d = max(whole, key=lambda x: (x[0], str(x)))
        return ("area" if d == "length" and e == 2 else "volume" if d == "length" and e == 3 else d), b, p, e

    def _prior(self, dim: str, exp: int) -> float:
        d = "area" if dim == "length" and exp == 2 else dim
        return self.priors.get(d, 0.001)

    def code(self, text: str | None) -> str | None:
        if text is None:
            return None
        found = self.segment(text)
        return CODES.get(found[1:]) if found else None


#: a longer text is segmented each time, so the memory of a worker does not follow its texts
REMEMBERED = 64


@lru_cache(maxsize=1)
def _segmenter() -> UnitSegmenter:
    return UnitSegmenter()


@lru_cache(maxsize=100_000)
def _code(text: str) -> str | None:
    return _segmenter().code(text)


@pandas_udf(T.StringType())
def unit_code(text: pd.Series) -> pd.Series:
    """Unit code of a text of any length; each distinct short text is segmented once per worker."""
    return text.map(lambda x: None if not isinstance(x, str) else _code(x) if len(x) <= REMEMBERED else _segmenter().code(x))


#: how a description states the unit of the quantity
STATED = r"(?i)(?:[(,;/] *(?:einheit|unit|unité|unità|me|uom|u\.m\.)\s*[:=]|(?:qty|quantity|menge|quantité|quantità) (?:in|en|expressed in) )\s*([^)\],;]+)"


def stated_unit(description: Column) -> Column:
    """The unit a description states for the quantity: ``[kg] ...`` or a phrase; sizes and packings
    ("12 kg Gebinde", "Karton à 6") are not statements."""
    d = trim_ws(description)
    bracket = blank_to_null(F.regexp_extract(d, r"^\[([^\]]+)\]", 1))
    return F.coalesce(bracket, blank_to_null(F.regexp_extract(d, STATED, 1)))


def split_quantity(quantity: Column) -> tuple[Column, Column]:
    """(number text, unit text) of a quantity; a currency prefix stays with the number."""
    q = trim_ws(quantity)
    shape = r"(?s)^((?:[A-Z]{3} +)?[^\p{L}]*?)\s*([\p{L}].*)$"
    has = q.rlike(shape)
    number = F.when(has, trim_ws(F.regexp_extract(q, shape, 1))).otherwise(q)
    return number, F.when(has, blank_to_null(F.regexp_extract(q, shape, 2)))


@pandas_udf(T.LongType())
def exact_milli(canonical: pd.Series, numerator: pd.Series, denominator: pd.Series) -> pd.Series:
    """Thousandths of canonical number * numerator / denominator; null if that is no bigint."""
    def one(c, n, d):
        if c is None or n is None or d is None:
            return None
        t = c.replace("'", "").replace(".-", "")
        sign = -1 if t[0] in "-(" or t[-1] == "-" else 1
        v = sign * Fraction(t.strip("-()")) * int(n) * 1000 / int(d)
        return int(v) if v.denominator == 1 and -(2**63) <= v < 2**63 else None

    return pd.Series([one(*x) for x in zip(canonical, numerator, denominator)], dtype="Int64")


def base_quantities(lines: DataFrame, receipts: DataFrame, conversions: DataFrame, max_broadcast: int = 50_000) -> DataFrame:
    """line_id, unit, base_uom, base_milli, plain for every line with a known unit, a conversion and an
    exact base quantity at three decimals. A conversion row of the material goes before
    the generic one (null or empty material)."""
    number, in_quantity = split_quantity(F.col("quantity"))
    x = lines.select("line_id", "batch_id", "path", trim_ws(F.col("material")).alias("material"), F.col("uom").alias("raw_uom"), F.col("quantity").alias("raw_quantity"), number.alias("number"),
                     F.coalesce(blank_to_null(F.col("uom")), in_quantity, stated_unit(F.col("description"))).alias("unit_text"))
    x = x.where("unit_text is not null and number is not null").join(dialects(receipts), ["batch_id", "path"], "left")
    plain = (
        F.col("raw_uom").isin("EA", "KG", "L", "M", "STD", "PAU", "M2") & F.col("raw_quantity").rlike(r"^[0-9]+(?:\.[0-9]+)?$")
        & F.coalesce(F.col("decimal_separator") == ".", F.lit(True))
    )
    canonical = canonical_number(F.col("number"), F.col("decimal_separator"), F.col("thousands_separator"))
    x = x.select("line_id", "material", unit_code(F.col("unit_text")).alias("unit"), canonical.alias("canonical"), F.coalesce(plain, F.lit(False)).alias("plain")).where("unit is not null and canonical <> ''")
    conv = conversions.select(F.coalesce(trim_ws(F.col("material")), F.lit("")).alias("cm"), trim_ws(F.col("alt_uom")).alias("unit"), "numerator", "denominator", "base_uom")
    conv = conv.where((F.col("denominator") > 0)).groupBy("cm", "unit").agg(F.min(F.struct("numerator", "denominator", "base_uom")).alias("c"))
    generic, special = conv.where("cm = ''").select("unit", F.col("c").alias("g")), conv.where("cm <> ''").select(F.col("cm").alias("material"), "unit", F.col("c").alias("s"))
    if conversions.count() <= max_broadcast:  # measured, from the file footers
        generic, special = F.broadcast(generic), F.broadcast(special)
    x = x.join(special, ["material", "unit"], "left").join(generic, "unit", "left").withColumn("c", F.coalesce("s", "g")).where("c is not null")
    x = x.withColumn("value", number_value(F.col("canonical")))
    scaled = F.try_multiply(F.col("value").cast(f"decimal(38,{SCALE})"), F.lit(10**SCALE).cast("decimal(13,0)")).try_cast("decimal(38,0)")
    top = F.try_multiply(scaled, (F.col("c.numerator").cast("decimal(19,0)") * 1000).cast("decimal(23,0)")).try_cast("decimal(38,0)")
    den = F.try_multiply(F.col("c.denominator").cast("decimal(19,0)"), F.lit(10**SCALE).cast("decimal(13,0)")).try_cast("decimal(38,0)")
    x = x.withColumn("top", top).withColumn("den", den)
    # numbers that decimals cannot hold are rare: only they reach the fractions, the others as nulls
    wide = F.when(F.col("top").isNull() | F.col("den").isNull(), F.col("canonical"))
    x = x.withColumn("exact", exact_milli(wide, F.col("c.numerator"), F.col("c.denominator")))
    milli = F.when((F.col("top") % F.col("den")) == 0, (F.col("top") / F.col("den")).try_cast("bigint"))
    return x.select("line_id", "unit", F.col("c.base_uom").alias("base_uom"), F.coalesce(milli, "exact").alias("base_milli"), "plain").where("base_milli is not null")
