"""Comparison and reconciliation: set differences, closure, control totals, field diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws


def symmetric_difference(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("missing", "extra")) -> DataFrame:
    """Rows in one set only: side says which (first: in left only). Null equals null."""
    tag = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select("*", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    both = tag.groupBy(*left.columns).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return both.where("_l <> _r").select(*left.columns, F.when(F.col("_l") == 1, names[0]).otherwise(names[1]).alias("side"))


def closure_violations(df: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Rows where the parts do not add up to the total; rows with a null part are pending."""
    s = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.withColumn("difference", F.col(total) - s).where("difference <> 0")


def control_totals(declared: DataFrame, rows: DataFrame, key: list[str], declared_count: str) -> DataFrame:
    """Declared against counted rows per key, both directions."""
    counted = rows.groupBy(*key).agg(F.count("*").alias("counted"))
    d = declared.groupBy(*key).agg(F.max(declared_count).alias("declared"))
    return d.join(counted, key, "full").select(*key, "declared", F.coalesce("counted", F.lit(0)).alias("counted"))


def field_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value of every field that differs; keys on one side only differ
    in every field that is not null."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(*key, F.explode(pairs).alias("p")).select(*key, "p.field", f"p.{name}")

    j = tall(old, "old_value").join(tall(new, "new_value"), [*key, "field"], "full")
    return j.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def bijection_violations(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Values of either side that pair with more than one of the other: side, value, partners."""
    p = pairs.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    one = p.groupBy(F.col(a).alias("value")).agg(F.count("*").alias("partners")).select(F.lit(a).alias("side"), "value", "partners")
    two = p.groupBy(F.col(b).alias("value")).agg(F.count("*").alias("partners")).select(F.lit(b).alias("side"), "value", "partners")
    return one.unionByName(two).where("partners > 1")


def needle_hits(texts: DataFrame, id_col: str, text: Column, shape: str, needles: DataFrame, needle: str) -> DataFrame:
    """(id, needle) for each needle that is a match of ``shape`` in a text. Candidates are cut out of the
    text by the needles' shape and joined by equality, so needles and texts may both be large."""
    cand = texts.select(F.col(id_col), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(shape), F.lit(0)))).alias(needle))
    return cand.join(needles.select(needle).distinct(), needle, "left_semi").select(id_col, needle)


def occurrences(texts: DataFrame, id_col: str, text: Column, needles: DataFrame, needle: str) -> DataFrame:
    """(id, needle) once for each trimmed, not empty needle that occurs anywhere in a text. The longest runs of
    characters that needles hold are cut into substrings of each length that occurs, joined by equality.
    The driver gets the needles' lengths and characters only."""
    n = needles.select(trim_ws(F.col(needle)).alias(needle)).where(f"{needle} <> ''").distinct()
    chars = n.select(F.length(needle).alias("k"), F.explode(F.split(needle, "")).alias("c")).where("c <> ''")
    lengths, alphabet = chars.agg(F.sort_array(F.collect_set("k")), F.sort_array(F.collect_set("c"))).first()
    if not lengths:
        return texts.select(id_col).join(n, F.lit(False))
    shape = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in alphabet) + f"]{{{lengths[0]},}}"
    runs = texts.select(F.col(id_col), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(shape), F.lit(0)))).alias("run"))

    def parts(k: int) -> Column:
        last = F.length("run") - (k - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(F.col("run"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    cand = runs.select(id_col, F.explode(F.array_distinct(F.concat(*map(parts, lengths)))).alias(needle))
    return cand.join(n, needle, "left_semi").select(id_col, needle).distinct()


def capped_rollup(scores: DataFrame, group: str, earned: str, possible: str, cap: dict[str, int]) -> DataFrame:
    """Earned and possible points by group, both cut at the group's budget (null budget: no cut)."""
    budget = F.lit(None).cast("bigint")
    for g, v in cap.items():
        budget = F.when(F.col(group) == g, F.lit(v)).otherwise(budget)
    s = scores.groupBy(group).agg(F.sum(earned).cast("bigint").alias("e"), F.sum(possible).cast("bigint").alias("p"))
    return s.select(group, F.least("e", budget).alias("earned"), F.least("p", budget).alias("possible"))
