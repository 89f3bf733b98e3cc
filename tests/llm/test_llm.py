"""Tests of the text operators: exact round trips, brute force, held-out accuracy."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import encodings as enc
from ledgerloom.llm import mixture as mix
from ledgerloom.llm import quality as q
from ledgerloom.llm import tokenizer as tok

RANKS = f"{tok.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_files = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def bpe():
    with open(RANKS, "rb") as f:
        return tok.BytePairEncoder(f.read())


def nasty(n, seed=0):
    rnd = random.Random(seed)
    alpha = list("ab'sdtmrevl  \n\t 12½.,!é’日👍\x00\xa0Ⅳ") + ["'s", "'re", "'ll", " 's", "''s", "<|endoftext|>", "\r\n"]
    return ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


# -- tokenizer --------------------------------------------------------------------
@needs_files
def test_ids_equal_the_library(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    pat = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    lib = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = nasty(3000) + ["", None, "a" * 3000, "'" * 99, " " * 99, "x  y", "x \n y\n"]
    ids, bounds, where = bpe.encode_batch(texts, offsets=True)
    for i, t in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]].tolist()
        assert own == lib.encode_ordinary(t or "")
        assert bpe.decode(own) == (t or "")
        raw = (t or "").encode()
        for k, p in zip(own, where[bounds[i] : bounds[i + 1]]):
            assert raw[p : p + len(bpe.tokens[k])] == bpe.tokens[k]


def test_blocks_and_windows_do_not_change_boundaries():
    import numpy as np

    joined = "\x00".join(nasty(400, 3)) + "\x00"
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sym = tok.symbols(cps, cps == 0)
    want = tok.piece_starts(sym, block=10**6)
    for block, window in ((3, 64), (7, 7), (256, 1000)):
        assert (tok.piece_starts(sym, block, window) == want).all()


@needs_files
def test_encode_operator_nulls_clashes_long_and_empty(spark, bpe):
    long = "ab'll 12" * 60_000
    df = spark.createDataFrame([(1, "it's"), (2, None), (3, ""), (4, long), (1, "it's")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = tok.encode(df).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows) == sorted([(1, 2), (2, 0), (3, 0), (1, 2), (4, len(bpe.encode_batch([long])[0]))])
    assert tok.encode(df.where("false")).count() == 0
    assert all(r.same for r in tok.encode(df, what="check").collect())
    got = {r.doc_id: (list(r.ids), list(r.offsets)) for r in tok.encode(df.where("doc_id = 1"), what="offsets").collect()}
    assert got[1][1] == [0, 2]
    with pytest.raises(ValueError):
        tok.encode(df, keep=["ids"])


# -- mixture ------------------------------------------------------------------------
def sized(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")


def test_mixture_meets_targets_and_caps(spark):
    rnd = random.Random(1)
    docs = [(i, rnd.choice([" Mail", "mail", "MAIL ", "web", "memo", None, "other"]), rnd.choice([0, 5, 20, 60])) for i in range(3000)]
    docs += [(5000 + i, "tiny", 30) for i in range(12)]
    goals = spark.createDataFrame([("mail", 0.5, 1), ("Web ", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 2), ("memo", 0.0, 4)], "source string, target_share double, max_repeats int")
    s = mix.sized_documents(sized(spark, docs), goals).cache()
    for budget in (None, 6000, 10**7):
        plan = mix.make_plan(s, goals, budget)
        for k in (7, 50_000):
            rows = mix.mixture(s, plan, k).collect()
            assert len({(r.doc_id, r.repeat) for r in rows}) == len(rows)
            at = 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at
                at += r.n_tokens
            assert at <= plan.budget
            if k == 7:
                first = {(r.doc_id, r.repeat, r.start) for r in rows}
            else:
                assert first == {(r.doc_id, r.repeat, r.start) for r in rows}
        share = {r.source: r for r in mix.shares(mix.mixture(s, plan), plan).collect()}
        assert share["none"].tokens == 0 and share["memo"].tokens == 0 and share["tiny"].uses <= 3
        if budget is None:
            for name, want in (("mail", 5 / 9), ("web", 3 / 9), ("tiny", 1 / 9)):
                assert abs(share[name].reached_share - want) < 0.03
        if budget == 10**7:  # everything runs dry
            assert share["tiny"].tokens == 12 * 30 * 3
    s.unpersist()


def test_mixture_equals_weighted_fair_queueing_by_hand(spark):
    rnd = random.Random(12)
    docs = [(i, rnd.choice(["a", "b", "c"]), rnd.choice([1, 5, 20])) for i in range(200)] + [(900 + i, "d", 7) for i in range(3)]
    goals = [("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.2, 3), ("d", 0.05, 4)]
    s = mix.sized_documents(sized(spark, docs), spark.createDataFrame(goals, "source string, target_share double, max_repeats int")).cache()
    h = {r.doc_id: r.h & (2**64 - 1) for r in s.collect()}
    weight, repeats = {g[0]: g[1] for g in goals}, {g[0]: g[2] for g in goals}
    queue = []
    for name in weight:
        own = sorted((h[i] >> 1, h[i], i, n) for i, src, n in docs if src == name)
        have, at = sum(n for *_, n in own), 0
        for k in range(repeats[name]):
            for _, _, i, n in own:
                at += n
                queue.append((at / weight[name], name, i, k + 1, n))
        assert at == have * repeats[name]
    queue.sort()
    for budget in (50, 700, None, 10**6):
        plan = mix.make_plan(s, spark.createDataFrame(goals, "source string, target_share double, max_repeats int"), budget)
        want, at = set(), 0
        for _, name, i, k, n in queue:
            if at + n > plan.budget:
                break
            want.add((i, k, at))
            at += n
        for rows in (13, 10**6):
            assert {(r.doc_id, r.repeat, r.start) for r in mix.mixture(s, plan, rows).collect()} == want
    s.unpersist()


@needs_files
def test_corpus_budget_is_not_set_by_the_first_source_to_run_out(spark, tmp_path):
    from ledgerloom.llm import queries

    docs = [(i, "mail", "a few words of mail " * 5) for i in range(60)] + [(100 + i, "web", "other words here " * 5) for i in range(60)] + [(200, "tiny", "ten small words")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    goals = [("mail", 0.5, 2), ("web", 0.45, 2), ("tiny", 0.05, 2)]
    spark.createDataFrame(goals, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r.source: r for r in queries.p9_corpus_shares(spark, str(tmp_path)).collect()}
    have, used = sum(r.source_tokens for r in got.values()), sum(r.tokens for r in got.values())
    longest = max(r.tokens // max(1, r.documents) for r in got.values())
    assert have - longest <= used <= have
    assert got["tiny"].uses == 2 and got["tiny"].tokens == 2 * got["tiny"].source_tokens and got["tiny"].reached_share < 0.01
    assert queries.p9_corpus_mixture(spark, str(tmp_path)).count() == sum(r.documents for r in got.values())


def test_mixture_of_nothing(spark):
    goals = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    s = mix.sized_documents(sized(spark, []), goals)
    plan = mix.make_plan(s, goals)
    assert mix.mixture(s, plan).count() == 0
    assert mix.shares(mix.mixture(s, plan), plan).first().reached_share == 0.0


# -- encodings ------------------------------------------------------------------------
SENTENCES = ["Die Prüfung für März ist fällig", "La pièce a été reçue à temps", "Grüsse aus Zürich", "über die Änderung", "Nüssli Söhne AG", "São João", "Évêque près de la forêt", "can’t be right", "plain words only", "Größe geändert, später möglich"]


def damaged(t, written, read):
    return t.encode(written, "ignore").decode(read, "replace")


def test_damage_is_found_and_restored(spark):
    rows = [("t", i, SENTENCES[i % len(SENTENCES)]) for i in range(600)]
    bad = []
    for j, (w, r) in enumerate([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp850", "latin-1")]):
        for k, s in enumerate(SENTENCES[:2] + SENTENCES[9:]):
            bad.append(("t", 1000 + 10 * j + k, damaged(s, w, r), s))
    twice = damaged(damaged(SENTENCES[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    bad.append(("t", 2000, twice, SENTENCES[0]))
    lost = ("t", 3000, damaged(SENTENCES[0].encode("cp1252").decode("latin-1"), "latin-1", "utf-8"))
    legit = [("t", 4000, None), ("t", 4001, ""), ("t", 4002, "請求書 👍 m² ±1 → Ω"), ("t", 4003, "x" * 100_000 + " für")]
    df = spark.createDataFrame(rows + [b[:3] for b in bad] + [lost] + legit, "source_table string, row_id long, text string").withColumn("pair", F.lit(1))
    got = {r.row_id: r for r in enc.find_damage(df).collect()}
    assert set(got) == {b[1] for b in bad} | {3000}
    assert all(got[b[1]].restored == b[3] for b in bad)
    assert not got[3000].restorable and got[3000].restored == lost[2]
    assert enc.find_damage(df.where("false")).count() == 0


def test_partial_damage_and_shortcut_agree():
    c = enc.Counter()
    for s in SENTENCES * 30:
        enc.count_text(s, [], True, c, "t")
    m = enc.Emissions({k[1:]: v for k, v in c.items()})
    text = "Die Prüfung für März. " + damaged("Die Prüfung für März ist fällig", "utf-8", "cp1252") + " über die Änderung"
    path = enc.spans(text, m)
    assert enc.restored(text, path) == "Die Prüfung für März. Die Prüfung für März ist fällig über die Änderung"
    assert enc.spans("Die Prüfung für März", m) == []


# -- quality -------------------------------------------------------------------------
def prose(rnd):
    a = ["the clerk", "der Einkäufer", "la banque", "our team", "die Prüfung"]
    b = ["has not found the invoice in the folder", "und hat die Rechnung nicht im System gefunden", "a vu que le total est trop grand pour la commande"]
    return ". ".join(f"{rnd.choice(a).capitalize()} {rnd.choice(b)}" for _ in range(rnd.randint(2, 8))) + "."


def make(rnd, shape):
    if shape == "prose":
        return prose(rnd)
    if shape == "list":
        return "\n".join(f"- {rnd.choice(['open items', 'Gutschrift', 'tax codes'])} {rnd.randint(1, 40)}" for _ in range(rnd.randint(4, 20)))
    if shape == "table":
        return "\n".join(f"45{rnd.randint(10**6, 10**7)}\t00{rnd.randint(10, 99)}\tBolt\t{rnd.randint(1, 999)}\tEA" for _ in range(rnd.randint(4, 20)))
    return "\n".join("".join(rnd.choice("a1#%&/()=?{}[]x9 ") for _ in range(60)) for _ in range(rnd.randint(2, 8)))


def test_shapes_on_held_out_documents(spark):
    rnd = random.Random(4)
    rows = [(i, make(rnd, s), s) for i, s in enumerate(q.SHAPES * 60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, " \n\t"), (903, "word " * 40_000), (904, prose(rnd) + "\n\n- a 1\n- b 2")], "doc_id long, text string").withColumn("list", F.lit("clash"))
    labels = spark.createDataFrame([(i, s) for i, _, s in rows if i // 4 % 2], "doc_id long, shape string")
    model = q.fit_sample(docs, labels.union(labels))
    got = {r.doc_id: r for r in q.shapes(docs, model).collect()}
    held = [(i, s) for i, _, s in rows if not i // 4 % 2]
    right = sum(got[i].natural == (s == "prose") for i, s in held)
    assert right / len(held) >= 0.97
    assert all(got[i].natural is None and got[i].prose is None for i in (900, 901, 902))
    assert got[904].natural and got[903].doc_id == 903
    assert q.shapes(docs.where("false"), model).count() == 0


def test_line_statistics_do_not_depend_on_the_chunk(monkeypatch):
    rnd = random.Random(6)
    lines = [x for _ in range(60) for x in q.pieces(make(rnd, rnd.choice(q.SHAPES)))] + ["  [x] Ünit  a  b", "１２３ 未払金 👍 ɑ", "a,b , c|d", "é", " - x", "\U00030000 \U000f0000"]
    whole = q.observe(lines)
    monkeypatch.setattr(q, "CHUNK", 50)
    assert (q.observe(lines) == whole).all() and whole.shape == (len(lines), q.FEATURES) and whole.max() < q.BINS
    words = ["the", "ab", "ba", "a", "b", "the"]
    assert len({int(h) for h in q._word_hashes(*_spans(words))}) == 5
    assert [int(x) for x in q.observe(["x", "x", "y"], __import__("numpy").array([True, True, False]))[:, -1]] == [0, 0, 0]


def _spans(words):
    import numpy as np

    ends = np.cumsum([len(w) for w in words])
    return np.array([ord(c) for w in words for c in w], np.uint64), ends - [len(w) for w in words], ends


def test_batch_labels_equal_single_ones_and_empty_fit():
    rnd = random.Random(5)
    texts = [make(rnd, rnd.choice(q.SHAPES)) for _ in range(80)]
    model = q.fit([(t, "prose" if i % 2 else "junk") for i, t in enumerate(texts)])
    obs = [q.observe(q.pieces(t)) for t in texts] + [q.observe([])]
    assert all((a == b).all() for a, b in zip(model.label_many(obs), [model.label(o) for o in obs]))
    assert q.fit([]).shares("some words") is not None


def test_statistics_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the cat.\n\n and dog!"), (4, "###")], "doc_id long, text string").withColumn("n_words", F.lit(-1))
    got = {r.doc_id: r for r in q.statistics(df).collect()}
    assert got[1].n_words == 0 and got[1].mean_word_length is None and got[2].symbol_ratio is None
    assert got[3].n_words == 4 and got[3].punctuated_lines == 1.0 and got[3].common_words == 0.5
    assert got[4].symbol_ratio == 1.0


WORDS = "Müller Über Straße für Prüfung Änderung Größe Wälchli Köln été déjà hôtel élève façade naïve garçon niño señor año corazón città perché più però".split()


def garbled(word, pair):
    written_in, read_in = pair
    if read_in == "twice":
        return garbled(garbled(word, ("utf-8", "cp1252")) or "", ("utf-8", "cp1252"))
    try:
        got = word.encode(written_in).decode(read_in)
    except UnicodeError:
        return None
    return got if got != word else None


@pytest.mark.parametrize("pair", [p for p in enc.PAIRS if p[1] != "utf-8"], ids="-".join)
def test_damage_of_each_pair_is_found_and_restored(pair):
    c = enc.Counter()
    for w in WORDS * 300:
        enc.count_text(f"der {w} und", None, False, c, "t")
    damaged = [(w, g) for w in WORDS if (g := garbled(w, pair))]
    for _, g in damaged:
        enc.count_text(f"der {g} und", None, False, c, "t")
    first = enc.Emissions({k[1:]: v for k, v in c.items()})
    texts = [f"der {w} und" for w in WORDS * 300] + [f"der {g} und" for _, g in damaged]
    c = enc.Counter()
    for t in texts:
        enc.count_text(t, enc.spans(t, first), True, c, "t")
    m = enc.Emissions({k[1:]: v for k, v in c.items()})
    paths = [(f"der {w} und", f"der {g} und", enc.spans(f"der {g} und", m)) for w, g in damaged]
    found = [enc.restored(t, path) == want for want, t, path in paths if any(u[2] for u in path)]
    assert not any(u[2] for w in WORDS for u in enc.spans(f"der {w} und", m))
    assert len(found) >= 0.9 * len(damaged), (pair, len(found), len(damaged))
    assert sum(found) >= 0.7 * len(found), (pair, sum(found), len(found))
