"""Folds against brute force, and edge cases of the value functions of the ledger queries."""

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as X
from ledgerloom.operators import folds


def test_governor_matches_brute_force(spark):
    rnd = random.Random(8)
    reqs, t = [], 0
    for i in range(400):
        t += rnd.choice([0, 0, 5, 30, 120])
        reqs.append((i, rnd.choice(["a", "b", "c", None]), t))
    want, state = {}, {}
    for i, k, t in reqs:
        s = state.setdefault(k, {"used": 0, "struck": 0, "level": 3, "since": t})
        if s["used"] >= 40:
            want[i] = "quota"
        elif s["struck"] >= 3:
            want[i] = "quarantine"
        else:
            while s["level"] < 3 and s["since"] + 40 <= t:
                s["level"], s["since"] = s["level"] + 1, s["since"] + 40
            if s["level"] == 3:
                s["since"] = t
            if s["level"]:
                s["level"], s["used"], want[i] = s["level"] - 1, s["used"] + 1, "admitted"
            else:
                s["struck"], want[i] = s["struck"] + 1, "refused"
    df = spark.createDataFrame(reqs, "id int, svc string, ms long")
    got = {r.id: r.admission for r in folds.governed(df, "svc", ["id"], ["id"], "ms", quota=40, strikes=3, capacity=3, per_ms=40).collect()}
    assert got == want
    assert set(want.values()) == {"quota", "quarantine", "refused", "admitted"}
    assert folds.governed(df.where("false"), "svc", ["id"], ["id"], "ms", quota=1, strikes=1, capacity=1, per_ms=1).count() == 0


def test_chunks_rise_by_one_replay_and_forget(spark):
    rows = [(1, "s", 1, "k1", "h1"), (2, "s", 3, "k3", "h3"), (3, "s", 2, "k2", "h2"), (4, "s", 1, "k1", "h1"), (5, "s", 2, "k2", "other"), (6, "s", 2, "k9", "h9"), (7, "s", 3, "k3", "h3"), (8, "t", 2, "k", "h"), (9, "s", None, "kn", "h"), (10, None, 1, "k", "h"), (11, "s", 1, "k1", "h1")]
    df = spark.createDataFrame(rows, "id int, s string, n int, k string, h string")
    out = lambda **kw: {r.id: r.outcome for r in folds.chunk_outcomes(df, "s", ["id"], ["id"], "n", "k", "h", **kw).collect()}
    want = {1: "applied", 2: "gap", 3: "applied", 4: "replayed", 5: "conflict", 6: "stale", 7: "applied", 8: "gap", 9: "gap", 10: "applied", 11: "replayed"}
    assert out() == want
    assert out(remembered=2) == want | {11: "stale"}  # k1 was forgotten


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_dates_cursors_and_codes(spark):
    d = lambda t, p: N.declared_date(F.lit(t), F.lit(p))
    assert one(spark, d("2026-02-28", "yyyy-MM-dd"), d("28.02.2026", "dd.MM.yyyy"), d("20260228", "yyyyMMdd"), d("28/02/2026", "dd/MM/yyyy"), d("280226", "ddMMyy"), d("010170", "ddMMyy")) == [date(2026, 2, 28)] * 5 + [date(1970, 1, 1)]
    assert one(spark, d("2026-02-30", "yyyy-MM-dd"), d("28.2.2026", "dd.MM.yyyy"), d("28.02.2026", "yyyy-MM-dd"), d("28x02x2026", "dd.MM.yyyy"), d(None, "yyyyMMdd"), d("x", "unknown")) == [None] * 6
    s = lambda t: N.short_stamp(F.lit(t))
    assert one(spark, s("2802261359"), s("2802262460"), s("3002261200"), s("28022613"), s(None)) == [datetime(2026, 2, 28, 13, 59), None, None, None, None]
    p = lambda t: N.posting_day(F.lit(t))
    assert one(spark, p("2026-03-28"), p("2026-03-28T23:00:00Z"), p("no date"), p(None)) == [date(2026, 3, 28), date(2026, 3, 29), None, None]
    c = X.signed_cursor(F.lit('{"after":"x"}'), "key")
    ok = lambda x, k="key": X.cursor_valid(x, k)
    assert one(spark, ok(c), ok(c, "other"), ok(F.concat(c, F.lit("0"))), ok(F.lit("")), ok(F.lit(None).cast("string"))) == [True, False, False, False, None]
    assert one(spark, *[X.company_code(F.lit(x)) for x in ("0100", "0200", "CH10", "100", None)]) == ["CH10", "CH20", "CH10", None, None]


def test_json_members_and_paths(spark):
    docs = ['{"k":" a ","b":true}', '{"k":7}', '{"k":"  "}', '{"b":false}', '{"k":"a","b":"true"}', "[1]", "x", None, '{"k":"a","k":"b"}', '{"k":"a","b":null}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    got = [tuple(r.m) for r in df.select("i", H.json_members("d", F.lit("k"), F.lit("b")).alias("m")).orderBy("i").collect()]
    bad = (None, None, "E_MALFORMED_DOCUMENT")
    assert got == [("a", True, None), (None, None, "E_KEY_NOT_STRING"), (None, None, "E_KEY_MISSING"), (None, False, "E_KEY_MISSING"), ("a", None, "E_FIELD_INVALID"), bad, bad, bad, bad, ("a", None, None)]
    flat = spark.createDataFrame([('{"a":{"b":[1,{"c":1.50}]},"d":null,"e":true}',), ("7",), ("x",), (None,)], "d string")
    assert [r[0] for r in flat.select(H.flat_json("d")).collect()] == [{"a.b[0]": "1", "a.b[1].c": "1.50", "d": None, "e": "true"}, {"": "7"}, None, None]
