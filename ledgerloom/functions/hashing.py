"""Hashes: canonical JSON, content hash, ids, digests, FNV-1a, NFC of the seven marks."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import UNIT_SEPARATOR

#: Combining grave, acute, circumflex, tilde, diaeresis, ring, cedilla.
MARKS = "\u0300\u0301\u0302\u0303\u0308\u030a\u0327"


def compose_marks(text: str) -> str:
    """Composes an ASCII letter followed by one of the marks; other sequences stay as they are."""
    out: list[str] = []
    for ch in text:
        if ch in MARKS and out and out[-1].isascii() and out[-1].isalpha():
            one = unicodedata.normalize("NFC", out[-1] + ch)
            if len(one) == 1:
                out[-1] = one
                continue
        out.append(ch)
    return "".join(out)


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is repeated")
    return out


def parse_json(text: str) -> object:
    """JSON with each key of an object once; a repeated key is an error."""
    return json.loads(text, object_pairs_hook=_once)


def canonical_json(value: object) -> str:
    """Sorted keys, no white space, composed and trimmed strings; floats are refused."""
    def norm(v):
        if isinstance(v, float):
            raise ValueError("floats have no canonical form")
        if isinstance(v, str):
            return compose_marks(v).strip()
        if isinstance(v, dict):
            return _once([(compose_marks(k).strip(), norm(x)) for k, x in v.items()])
        if isinstance(v, (list, tuple)):
            return [norm(x) for x in v]
        return v

    text = json.dumps(norm(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


@pandas_udf(T.StringType())
def canonical_json_udf(payload: pd.Series) -> pd.Series:
    """Canonical form of a JSON text; null for text that is no JSON, holds a float or repeats a key."""
    def one(x):
        try:
            return None if x is None else canonical_json(parse_json(x))
        except ValueError:
            return None

    return payload.map(one)


@pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else compose_marks(x))


def compose_marks_udf(text: Column) -> Column:
    """Composed text. Texts without one of the marks reach Python as nulls and stay as they are."""
    return F.coalesce(_compose(F.when(text.rlike(f"[{MARKS}]"), text)), text)


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64_all(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings: one byte position of all of them at a time, longest first."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lens, kind="stable")
    starts = (np.cumsum(lens) - lens)[order]
    sizes, raw = lens[order], np.frombuffer(b"".join(texts), np.uint8)
    h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    live = len(texts) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(texts) else 0), side="right")
    for i, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ raw[starts[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a64_mod(m: int):
    """pandas UDF: FNV-1a of the UTF-8 text modulo m."""
    @pandas_udf(T.LongType())
    def f(text: pd.Series) -> pd.Series:
        got = (fnv1a64_all([x.encode() if isinstance(x, str) else b"" for x in text]) % np.uint64(m)).astype(np.int64)
        return pd.Series(got, dtype="Int64").mask(text.isna().to_numpy())

    return f


@pandas_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("flag", T.BooleanType()), T.StructField("code", T.StringType())]))
def json_members(doc: pd.Series, key: pd.Series, flag: pd.Series) -> pd.DataFrame:
    """A key and a boolean of a JSON object, by their JSON types: a key that is a number is
    E_KEY_NOT_STRING, one that is missing, null or blank E_KEY_MISSING, a flag of another type than
    boolean E_FIELD_INVALID; no object is E_MALFORMED_DOCUMENT."""
    def one(text, k, b):
        try:
            d = parse_json(text or "")
        except ValueError:
            d = None
        if not isinstance(d, dict):
            return None, None, "E_MALFORMED_DOCUMENT"
        v, f = d.get(k), d.get(b)
        if v is None or (isinstance(v, str) and not v.strip()):
            code = "E_KEY_MISSING"
        elif not isinstance(v, str):
            code = "E_KEY_NOT_STRING"
        else:
            code = None if f is None or isinstance(f, bool) else "E_FIELD_INVALID"
        return v.strip() if isinstance(v, str) and v.strip() else None, f if isinstance(f, bool) else None, code

    return pd.DataFrame([one(*x) for x in zip(doc, key, flag)], columns=["key", "flag", "code"])


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flat_json(doc: pd.Series) -> pd.Series:
    """path -> text of every value of a JSON document; numbers keep their digits; null for no JSON."""
    def walk(v, at: str, out: dict) -> dict:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{at}.{k}" if at else k, out)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{at}[{i}]", out)
        else:
            out[at] = None if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)
        return out

    def one(text):
        try:
            return None if text is None else walk(json.loads(text, parse_float=str, parse_int=str), "", {})
        except ValueError:
            return None

    return doc.map(one)


def content_hash(*cols: Column) -> Column:
    """SHA-256 of the columns; null and empty differ, and so do shifted values."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]), 256)


def twin_id(domain: str, dataset: Column, key: Column) -> Column:
    return F.concat(F.lit("twn_"), F.left(F.sha2(F.concat(F.lit(domain), dataset, F.lit(UNIT_SEPARATOR), key), 256), F.lit(16)))


def state_digest(hashes: DataFrame, group: str, h: str) -> DataFrame:
    """One digest per group, independent of layout: the sorted hashes of each of 65,536 prefixes are
    hashed, then those of each of 256 prefixes, then all; no task holds more than one prefix. For
    groups beyond some 10^9 rows, where a prefix gets long, there is :func:`set_digest`."""
    d = hashes.select(group, F.left(h, F.lit(4)).alias("p"), F.lit("").alias("old"), F.col(h).alias("h"))
    for shorter in (2, 0, None):
        listed = F.transform(F.sort_array(F.collect_list(F.struct("old", "h"))), lambda x: x["h"])
        d = d.groupBy(group, "p").agg(F.sha2(F.array_join(listed, ""), 256).alias("h"))
        if shorter is not None:
            d = d.select(group, F.left("p", F.lit(shorter)).alias("p"), F.col("p").alias("old"), "h")
    return d.select(group, F.col("h").alias("digest"))


def set_digest(hashes: DataFrame, group: str, h: str) -> DataFrame:
    """One digest per group that no order enters: the eight 32-bit words of the SHA-256 texts are added
    up, and sums and count are hashed. It combines before the shuffle and holds nine numbers a group."""
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)") for i in range(8)]
    g = hashes.groupBy(group).agg(*[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)], F.count("*").alias("n"))
    return g.select(group, F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)]), 256).alias("digest"))
