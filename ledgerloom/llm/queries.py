"""Queries of the text operators (p6, p8, p9, p10) with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table, written
from . import encodings as enc
from . import mixture as mix
from . import quality
from . import tokenizer as tok

SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")



# -- 6: wrong character sets --------------------------------------------------------
def _damage(spark: SparkSession, sf: str) -> DataFrame:
    names = spread(table(spark, sf, "suppliers"), "change_id").select(F.lit("suppliers").alias("source_table"), F.col("change_id").alias("row_id"), F.col("name").alias("text"))
    docs = _documents(spark, sf).select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("row_id"), "text")
    return enc.find_damage(names.unionByName(docs))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _damage(spark, sf).select("source_table", "row_id")


def p6_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The affected rows with the text restored as far as possible."""
    return _damage(spark, sf).select("source_table", "row_id", "pair", "restorable", "restored")


# -- 8: encoding the corpus -------------------------------------------------------
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tok.encode(_documents(spark, sf))


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Decoding gives each text back."""
    return tok.encode(_documents(spark, sf), what="check").select("doc_id", "same")


SQL["p8_roundtrip"] = "SELECT doc_id, true AS same FROM documents"


# -- 9: mixing sources ----------------------------------------------------------------
def _mix(spark: SparkSession, sf: str, tenths: int | None = None) -> tuple[DataFrame, mix.MixPlan]:
    """tenths: the budget in tenths of all tokens of the listed sources; with ten, short sources run dry."""
    docs, goals = _documents(spark, sf), table(spark, sf, "mix_targets")
    counted = tok.encode(docs.where("source is not null"), what="count", keep=["source"])
    sized = written(mix.sized_documents(counted, goals), "mix-sized")
    plan = mix.make_plan(sized, goals, None if tenths is None else (sized.agg(F.sum("n_tokens")).first()[0] or 0) * tenths // 10)
    return mix.mixture(sized, plan), plan


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix.shares(*_mix(spark, sf))


def p9_corpus_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf, 10)[0]


def p9_corpus_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix.shares(*_mix(spark, sf, 10))


def p9_tenth_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A budget below what the sources have: every source with documents meets its share."""
    return mix.shares(*_mix(spark, sf, 1))


# -- 10: text quality ---------------------------------------------------------------
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "doc_labels")
    model = quality.fit_sample(docs, labels)
    unlabelled = _documents(spark, sf).join(labels.select("doc_id"), "doc_id", "left_anti")
    return quality.shapes(unlabelled, model).where("not natural").select("doc_id")


def p10_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the four shapes of every document."""
    model = quality.fit_sample(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))
    return quality.shapes(_documents(spark, sf), model)


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(table(spark, sf, "documents"))


_COMMON = ", ".join("'" + w + "'" for w in sorted(quality.COMMON))
SQL["p10_statistics"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split_regex(t, '[ \\t\\r\\n]+'), lambda w: w <> '') AS w,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l,
  length(regexp_replace(t, '[ \\t\\r\\n]', '', 'g')) AS solid, length(regexp_replace(t, '[\\p{{L}}\\p{{N}} \\t\\r\\n]', '', 'g')) AS symbols FROM d),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n, len(l) AS nl, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS total FROM s)
SELECT doc_id, n AS n_words, CASE WHEN n > 0 THEN CAST(total AS DOUBLE) / CAST(n AS DOUBLE) END AS mean_word_length,
  CASE WHEN solid > 0 THEN CAST(symbols AS DOUBLE) / CAST(solid AS DOUBLE) END AS symbol_ratio,
  CASE WHEN nl > 0 THEN CAST(len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?', ':', ';', ','))) AS DOUBLE) / CAST(nl AS DOUBLE) END AS punctuated_lines,
  CASE WHEN n > 0 THEN CAST(len(list_filter(w, lambda x: trim(lower(x), '.,;:!?()"' || chr(39)) IN ({_COMMON}))) AS DOUBLE) / CAST(n AS DOUBLE) END AS common_words FROM n"""

QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_corpus_mixture": p9_corpus_mixture, "p9_corpus_shares": p9_corpus_shares, "p9_tenth_shares": p9_tenth_shares, "p10_found": p10_found, "p10_shapes": p10_shapes, "p10_statistics": p10_statistics}
