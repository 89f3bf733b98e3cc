"""Brute-force and edge-case tests of the delivery operators (p1, p2, p5, p7)."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import trim_ws
from ledgerloom.operators.as_of import Facts, as_known_join, latest_before
from ledgerloom.operators.cells import day_cells, span_cells
from ledgerloom.operators.cow_table import CowTable, _blocks, change_effects, present_state
from ledgerloom.operators.message_store import MessageStore, arrival_waves
from ledgerloom.operators.references import Edge, Node, existence_spans, orphans
from ledgerloom.session import SharedFiles, shared_dir

T0 = datetime(2025, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


# -- messages -----------------------------------------------------------------
MSG = "id long, key string, t timestamp_ntz, period string, extra string"


def store(spark):
    return MessageStore(spark, shared_dir(spark, "t-msg"), key="key", row_id="id", order=["t"], period=F.col("period"), buckets=4)


def test_messages_match_brute_force_over_batches(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, "a", "b", " a ", "A", "", f"k{rnd.randrange(9)}", "hot", "hot"]), rnd.choice([None, at(rnd.randrange(40))]), f"2025-{rnd.randrange(1, 4):02d}", None) for i in range(300)]
    s = store(spark)
    for lo in range(0, 300, 100):
        s.ingest(spark.createDataFrame(rows[lo : lo + 100], MSG))
    best = {}
    for r in rows:
        if r[1] is not None:
            k = r[1].strip()
            best[k] = min(best.get(k, (True, datetime.max, 10**9)), (r[2] is None, r[2] or datetime.max, r[0]))
    keep = {b[2] for b in best.values()} | {r[0] for r in rows if r[1] is None}
    assert sorted(r.id for r in s.messages().collect()) == sorted(keep)
    assert sorted(r.id for r in s.surplus().collect()) == sorted({r[0] for r in rows} - keep)


def test_earlier_copy_displaces_a_kept_one_and_touches_only_its_partition(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([(1, "x", at(5), "p1", "e"), (2, "y", at(5), "p2", "e"), (3, "z", at(5), "p3", "e")], MSG))
    info = s.ingest(spark.createDataFrame([(4, "x", at(1), "p1", "f")], MSG))
    assert info["read_partitions"] == ["pp1"] and info["written_partitions"] == ["pp1"]
    assert {r.id for r in s.messages().collect()} == {2, 3, 4}
    assert [r.id for r in s.surplus().collect()] == [1]
    info = s.ingest(spark.createDataFrame([(5, "y", at(9), "p9", "f")], MSG))
    assert info["read_partitions"] == ["pp2", "pp9"]
    assert {r.id for r in s.messages().collect()} == {2, 3, 4}


def test_empty_batches_and_waves(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([], MSG))
    assert s.surplus().count() == 0
    s.ingest(spark.createDataFrame([(1, None, None, None, None)], MSG))
    assert s.messages().count() == 1
    df = spark.createDataFrame([(i, "k", at(i), "p", None) for i in range(10)] + [(99, "k", None, "p", None)], MSG)
    waves = arrival_waves(df, "t", 3)
    assert sum(w.count() for w in waves) == 11 and len(waves) == 3


def crash(monkeypatch, write):
    """Runs ``write`` with a failure after all its files are written, before the manifest."""
    with monkeypatch.context() as m:
        m.setattr(SharedFiles, "commit_json", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write()


def kept_and_lost(s):
    return sorted(r.id for r in s.messages().collect()), sorted(r.id for r in s.surplus().collect())


def test_messages_given_again_are_stored_once(spark, monkeypatch):
    s = store(spark)
    one = spark.createDataFrame([(1, "a", at(1), "p", "e"), (2, "b", at(2), "p", "e"), (3, "a", at(3), "q", "e"), (4, None, at(3), "q", "e"), (4, None, at(3), "q", "e")], MSG)
    crash(monkeypatch, lambda: s.ingest(one, ("feed", 0)))
    assert s.messages() is None
    assert not s.ingest(one, ("feed", 0))["skipped"]
    assert s.ingest(one, ("feed", 0))["skipped"]
    want = ([1, 2, 4], [3])
    assert kept_and_lost(s) == want
    s.ingest(one)  # without a number the row ids tell
    assert kept_and_lost(s) == want
    two = spark.createDataFrame([(5, "b", at(1), "q", "e"), (3, "a", at(3), "q", "e")], MSG)
    crash(monkeypatch, lambda: s.ingest(two, ("feed", 1)))
    assert kept_and_lost(s) == want
    s.ingest(two, ("feed", 1))
    assert kept_and_lost(s) == ([1, 4, 5], [2, 3])
    assert s.vacuum(["rows", "index"], 0) > 0 and kept_and_lost(s) == ([1, 4, 5], [2, 3])


def test_a_writer_that_loses_the_race_builds_again(spark, monkeypatch):
    path = shared_dir(spark, "t-race")
    a, b = (MessageStore(spark, path, key="key", row_id="id", order=["t"], period=F.col("period"), buckets=4) for _ in range(2))
    real, seen = SharedFiles.commit_json, []

    def late(self, rel, value):
        if not seen:
            seen.append(rel)
            b.ingest(spark.createDataFrame([(2, "a", at(1), "p", "e")], MSG))
        real(self, rel, value)

    monkeypatch.setattr(SharedFiles, "commit_json", late)
    assert a.ingest(spark.createDataFrame([(1, "a", at(5), "p", "e")], MSG))["commit"] == 2
    assert kept_and_lost(a) == ([2], [1])


def test_a_late_batch_reads_its_index_buckets_only(spark):
    s = MessageStore(spark, shared_dir(spark, "t-msg"), key="key", row_id="id", order=["t"], period=F.col("period"), buckets=16, deltas=2)
    for lo in range(0, 400, 100):  # more commits than an index bucket may have files
        s.ingest(spark.createDataFrame([(i, f"k{i}", at(i), f"p{i % 5}", "e") for i in range(lo, lo + 100)], MSG))
    info = s.ingest(spark.createDataFrame([(1000, "k7", at(999), "p9", "e")], MSG))
    assert len(info["read_buckets"]) == 1 and info["read_partitions"] == ["pp2", "pp9"]
    assert max(map(len, s.manifest()[1]["index"].values())) <= 3
    assert s.messages().count() == 400 and [r.id for r in s.surplus().collect()] == [1000]


# -- change feeds ----------------------------------------------------------------
CHG = "id long, op string, key string, seq long, name string, n int, rec timestamp_ntz"


def brute_state(rows):
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        if r[2] is not None and r[3] is not None:
            seen.setdefault((r[2].strip(), r[3]), r)
    for (k, seq), r in sorted(seen.items(), key=lambda x: x[0]):
        new = None if r[1] == "D" else (r[4], r[5])
        if new is None:
            out.pop(k, None)
        elif k not in out or out[k][1] != new:
            out[k] = (seq, new)
    return {k: v[0] for k, v in out.items()}


def changes(n, seed):
    rnd = random.Random(seed)
    seqs = rnd.sample(range(1, 3 * n), n)
    rows = [(i, rnd.choice("IUUUD"), rnd.choice(["a", "hot", "hot", " b ", None]), s if rnd.random() > 0.02 else None, rnd.choice([None, "x", "y"]), rnd.choice([None, 1]), at(i)) for i, s in enumerate(seqs)]
    copies = [(n + i, *r[1:6], at(n + i)) for i, r in enumerate(rnd.sample(rows, n // 5))]
    return rows + copies


def cow(spark, block=7):
    return CowTable(spark, shared_dir(spark, "t-cow"), key=trim_ws(F.col("key")), seq="seq", op="op", content=["name", "n"], delivered=["rec", "id"], buckets=4, block=block)


def test_changes_in_any_order_and_batching_give_the_brute_force_state(spark):
    rows = changes(120, 5)
    want = brute_state(rows)
    for parts in (1, 3):
        t = cow(spark)
        for i in range(parts):
            t.apply(spark.createDataFrame(rows[i::parts], CHG))
        got = {r.key: r.seq for r in t.current().collect()}
        assert got == want


def test_only_touched_buckets_are_replaced(spark):
    t = cow(spark)
    t.apply(spark.createDataFrame([(i, "I", f"k{i}", i + 1, "x", 1, at(i)) for i in range(40)], CHG))
    info = t.apply(spark.createDataFrame([(99, "U", "k3", 99, "y", 1, at(99))], CHG))
    assert len(info["buckets_written"]) == 1
    assert t.current().count() == 40


def test_a_crash_or_a_replay_changes_nothing(spark, monkeypatch):
    rows = changes(60, 9)
    one, two = (spark.createDataFrame(rows[i::2], CHG) for i in range(2))
    t = cow(spark)
    crash(monkeypatch, lambda: t.apply(one, ("feed", 0)))
    assert t.current() is None
    t.apply(one, ("feed", 0))
    crash(monkeypatch, lambda: t.apply(two, ("feed", 1)))
    t.apply(two, ("feed", 1))
    assert t.apply(two, ("feed", 1))["skipped"]
    t.apply(one)
    assert {r.key: r.seq for r in t.current().collect()} == brute_state(rows)


def test_compaction_keeps_the_state_and_refuses_what_is_older(spark):
    rows = [r for r in changes(120, 11) if r[3] is not None]
    old, new = [r for r in rows if r[3] <= 180], [r for r in rows if r[3] > 180]
    t = cow(spark)
    t.apply(spark.createDataFrame(old, CHG))
    before = t.log().count()
    t.compact(180)
    assert t.log().count() < before and {r.key: r.seq for r in t.current().collect()} == brute_state(old)
    t.apply(spark.createDataFrame(new, CHG))
    assert {r.key: r.seq for r in t.current().collect()} == brute_state(rows)
    late = spark.createDataFrame([(9999, "U", "a", 180, "late", 1, at(1))], CHG)
    assert t.too_late(late).count() == 1 and t.apply(late)["buckets_written"] == []
    assert {r.key: r.seq for r in t.current().collect()} == brute_state(rows)


def test_sparse_numbers_do_not_make_a_span_a_row(spark):
    log = spark.createDataFrame([("hot", i * 10**9, (False, str(i // 50))) for i in range(1000)], "key string, seq long, state struct<gone:boolean,name:string>")
    assert _blocks(log, 100).select("b").distinct().count() <= 11
    assert [(r.seq, r.state.name) for r in present_state(log, 100).collect()] == [(950 * 10**9, "19")]


def test_empty_feed_and_effects(spark):
    t = cow(spark)
    assert t.current() is None
    t.apply(spark.createDataFrame([], CHG))
    assert t.current().count() == 0 and t.effects().count() == 0
    t.apply(spark.createDataFrame([(0, "D", "a", 1, None, None, at(0)), (1, "I", "a", 2, "x", 1, at(1)), (2, "U", "a", 9, "x", 1, at(2)), (3, "D", "a", 20, "old", 1, at(3)), (4, "U", "a", 30, "x", 1, at(4))], CHG))
    assert {(r.seq, r.effect) for r in t.effects().collect()} == {(1, "void"), (2, "applied"), (9, "unchanged"), (20, "applied"), (30, "applied")}
    assert [(r.key, r.seq) for r in t.current().collect()] == [("a", 30)]
    empty = t.log().where("false")
    assert present_state(empty).count() == 0 and change_effects(empty).count() == 0


# -- as of -----------------------------------------------------------------------
def test_latest_before_matches_brute_force(spark):
    rnd = random.Random(1)
    log = [(rnd.choice(["a", "hot", "hot", None]), at(rnd.randrange(200)), (i, i % 3 == 0)) for i in range(150)]
    ev = [(i, rnd.choice(["a", "hot", "none", None]), at(rnd.randrange(-5, 210)) if rnd.random() > 0.05 else None) for i in range(120)]
    L = spark.createDataFrame(log, "key string, t timestamp_ntz, value struct<seq:int,gone:boolean>")
    E = spark.createDataFrame(ev, "id int, key string, t timestamp_ntz")
    got = {r.id: r.value and tuple(r.value) for r in latest_before(E, L).collect()}
    want = {i: max((v for lk, lt, v in log if k is not None and t is not None and lk == k and lt <= t), default=None) for i, k, t in ev}
    assert got == want and len(got) == len(ev)


FACT = Facts("base", "vf", "vt", "sequence", "rid", "pub")


def test_as_known_join_matches_brute_force(spark):
    rnd = random.Random(2)
    day = lambda d: date(2025, 1, 1) + timedelta(days=d)
    facts = []
    for i in range(160):
        a = rnd.randrange(0, 120)
        facts.append((i, rnd.choice(["EUR", "USD", None]), day(a), None if rnd.random() < 0.1 else day(a + rnd.randrange(0, 30)), rnd.randrange(0, 4), None if rnd.random() < 0.03 else T0 + timedelta(days=rnd.randrange(-10, 130), hours=rnd.randrange(24)), rnd.random() < 0.1))
    events = [(f"e{i}", rnd.choice(["EUR", "USD", "XXX", None]), day(rnd.randrange(-5, 140)), T0 + timedelta(days=rnd.randrange(0, 140), hours=rnd.randrange(24))) for i in range(200)]
    Fd = spark.createDataFrame(facts, "rid long, base string, vf date, vt date, sequence int, pub timestamp_ntz, stands_for_nothing boolean")
    Ed = spark.createDataFrame(events, "eid string, base string, d date, t timestamp_ntz")
    want = {}
    for eid, base, d, t in events:
        slot = {}
        for rid, b, vf, vt, sq, pub, off in facts:
            if base is not None and b == base and pub is not None and pub <= t:
                slot[vf] = max(slot.get(vf, (-1, 0)), (sq, -rid))
        ok = [(sq, -vf.toordinal(), rid) for rid, b, vf, vt, sq, pub, off in facts if slot.get(vf) == (sq, -rid) and b == base and not off and vf <= d and (vt is None or d < vt)]
        if ok:
            want[eid] = max(ok)[2]
    for limit in (10**6, 0):  # broadcast and shuffle
        got = {r.eid: r.rid for r in as_known_join(Ed, Fd, FACT, event_id="eid", entity="base", at="t", date="d", broadcast_rows=limit).collect()}
        assert got == want
    assert as_known_join(Ed.where("false"), Fd, FACT, event_id="eid", entity="base", at="t", date="d").count() == 0
    assert as_known_join(Ed, Fd.where("false"), FACT, event_id="eid", entity="base", at="t", date="d").count() == 0


def test_calendar_cells_cover_each_day_once(spark):
    rnd = random.Random(4)
    spans = [(i, date(2024, 11, 5) + timedelta(days=a), date(2024, 11, 5) + timedelta(days=a + n)) for i, (a, n) in enumerate([(0, 0), (0, 1), (26, 31), (57, 365), (57, 366), (3, 900)] + [(rnd.randrange(900), rnd.randrange(700)) for _ in range(40)])]
    days = [date(2024, 11, 1) + timedelta(days=i) for i in range(1500)]
    S = spark.createDataFrame(spans, "id int, lo date, hi date").select("id", F.explode(span_cells(F.col("lo"), F.col("hi"))).alias("c"))
    D = spark.createDataFrame([(d,) for d in days], "d date").select("d", F.explode(day_cells(F.col("d"))).alias("c"))
    got = sorted((r.id, r.d) for r in S.join(D, "c").collect())
    assert got == [(i, d) for i, lo, hi in spans for d in days if lo <= d < hi]
    assert S.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * 30 + 2 * 11 + 3


# -- references ------------------------------------------------------------------
def test_orphans_direct_inherited_and_cycles(spark):
    a = spark.createDataFrame([("a1", "A", None, at(5)), ("a2", "B", "Z", at(5)), ("a3", "C", "B", at(5))], "rid string, own string, up string, t timestamp_ntz")
    b = spark.createDataFrame([("b1", "B", at(5)), ("b2", "C", at(5)), ("b3", "A", at(5)), ("b4", "Q", at(5)), ("b5", None, at(5))], "rid string, ref string, t timestamp_ntz")
    span = existence_spans(a.withColumn("del", F.lit(None).cast("timestamp_ntz")), F.col("own"), "t", "del")
    nodes = [Node("a", a, F.col("rid"), F.col("own")), Node("b", b, F.col("rid"))]
    edges = [Edge("a", "a", F.col("up"), F.col("t"), spans=span), Edge("b", "a", F.col("ref"), F.col("t"), spans=span)]
    got = {(r.child_table, r.record_key, r.kind, r.reason, r["round"]) for r in orphans(nodes, edges).collect()}
    assert got == {("a", "a2", "direct", "missing", 0), ("b", "b4", "direct", "missing", 0), ("a", "a3", "inherited", "a", 1), ("b", "b1", "inherited", "a", 1), ("b", "b2", "inherited", "a", 2)}
    none = orphans([Node("a", a.where("false"), F.col("rid"), F.col("own")), Node("b", b.where("false"), F.col("rid"))], edges)
    assert none.count() == 0


def test_orphans_are_not_cut_by_the_number_of_rounds(spark):
    rows = [(f"r{i}", f"K{i}", "gone" if i == 0 else f"K{i - 1}", at(5)) for i in range(5)]
    a = spark.createDataFrame(rows, "rid string, own string, up string, t timestamp_ntz")
    span = existence_spans(a.withColumn("del", F.lit(None).cast("timestamp_ntz")), F.col("own"), "t", "del")
    nodes, edges = [Node("a", a, F.col("rid"), F.col("own"))], [Edge("a", "a", F.col("up"), F.col("t"), spans=span)]
    for bound in (None, 4):
        assert {(r.record_key, r["round"]) for r in orphans(nodes, edges, bound).collect()} == {(f"r{i}", i) for i in range(5)}
    with pytest.raises(RuntimeError):
        orphans(nodes, edges, 2)


def test_orphan_reasons_over_time(spark):
    orders = spark.createDataFrame([("o1", "S", at(5)), ("o2", "S", at(15)), ("o3", "S", at(25)), ("o4", "none", at(5)), ("o5", "S", None)], "rid string, sup string, t timestamp_ntz")
    log = spark.createDataFrame([("S", at(10), (1, False)), ("S", at(20), (2, True)), ("S", at(22), (0, False))], "key string, t timestamp_ntz, value struct<seq:int,gone:boolean>")
    nodes = [Node("o", orders, F.col("rid")), Node("s", log, F.col("key"))]
    got = {(r.record_key, r.reason) for r in orphans(nodes, [Edge("o", "s", F.col("sup"), F.col("t"), changes=log)]).collect()}
    assert got == {("o1", "late"), ("o3", "deleted"), ("o4", "missing"), ("o5", "deleted")}
