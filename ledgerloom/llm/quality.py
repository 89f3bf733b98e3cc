"""Text quality: per-document statistics, and prose told from lists, tables and junk.

Statistics are column expressions. The shape comes from a hidden Markov model over the
lines of a document with the states prose, list, table and junk: each line is seen as a
tuple of binned line statistics, the states emit them independently, and the label
shares, weighted by characters, are aggregated per document.

The model is fitted on labelled documents (a bounded, documented number), first with every
line labelled as its document, then again on the labels the model itself gives (a
labelled list may open with a sentence, prose may hold a small table). Everything else
covers all documents and whole texts.

Defined results: a null, empty or blank text has no lines and no shape. A line longer than
``WRAP`` characters is seen as several pieces cut at blanks, so one long line is as much
evidence as the same text wrapped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPES = ("prose", "list", "table", "junk")
WRAP = 120
#: labelled documents the model is fitted on, chosen by a hash of the id, and the first lines of each
#: that it is fitted on: the driver gets at most their product of observed lines
FIT_DOCUMENTS, FIT_LINES = 2_000, 2_000
#: Common function words of German, English, French and Italian.
COMMON = frozenset("""
der die das den dem des ein eine einen und oder aber nicht ist sind war wurde hat für mit auf von zu im in am an bei dass weil wie es sich nach aus als bis noch nur auch wenn
the a an and or but not is are was were has have had of to on at by for with from that this it as we they there which be been will if
le la les un une du et ou mais pas est sont été dans sur pour par avec que qui il elle nous vous ce cette au aux se en plus
il lo gli i una uno e ed o ma non è sono stato di del della dei che con per da al alla si più come
""".split())

_MARK = re.compile(r"^(\s*)(?:([-*•–·+>▪◦])\s+|\(?(\d{1,3}|[A-Za-z])[.)]\s+|(\[[ xX]?\])\s*)")
#: flags of a codepoint
ALPHA, UPPER, LOWER, DIGIT, SPACE, WORD, ALNUM, TORN, DECIMAL = (1 << i for i in range(9))
#: codepoints beyond the table count as Chinese letters below the private planes, else as symbols
TABLE, LETTER_BEYOND, SYMBOL_BEYOND = 0x20000, 0x4E00, 0xE000
_flags: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Flags and lower case of each codepoint, built once per process."""
    global _flags
    if _flags is None:
        flags, small = np.zeros(TABLE, np.uint16), np.arange(TABLE, dtype=np.uint64)
        plain = frozenset("_'’.,:;!?/()–-")
        for i in range(TABLE):
            c = chr(i)
            letter = c.isalpha()
            f = ALPHA if letter else SPACE if c.isspace() else 0
            if c.isalnum():
                f |= ALNUM | (DECIMAL if c.isdecimal() else WORD) | (DIGIT if c.isdigit() else 0)
            elif not f and c not in plain:
                f |= TORN
            if letter:
                low = c.lower()
                f |= UPPER if c.isupper() else LOWER if c.islower() else 0
                if low != c and len(low) == 1:
                    small[i] = ord(low)
            flags[i] = f
        _flags = flags, small
    return _flags


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of them."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        rows = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (_BASE, inverse)]
        _powers = rows[0], rows[1]
    return _powers


def _word_hashes(small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word [start, end): differences of one running sum, moved to the origin."""
    up, down = _power(len(small) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((small + np.uint64(1)) * up[: len(small)], dtype=np.uint64)])
    h = (total[ends] - total[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # so that every character reaches the upper bits
    return h ^ (h >> np.uint64(32))


def _common() -> np.ndarray:
    words = sorted(COMMON)
    cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(_word_hashes(cps, ends - [len(w) for w in words], ends))


_COMMON_HASHES = _common()


def pieces(text: str) -> list[str]:
    """Lines without blank ones; long lines cut at blanks (or hard, where there are none)."""
    out = []
    for line in text.splitlines():
        if not line.strip():
            continue
        while len(line) > WRAP + WRAP // 3:
            cut = line.rfind(" ", WRAP // 2, WRAP)
            cut = cut if cut > 0 else WRAP
            out.append(line[:cut])
            line = line[cut:]
        if line.strip():
            out.append(line)
    return out


#: characters whose lines are observed at once
CHUNK = 1 << 20


def _bin(x: np.ndarray, *edges: float) -> np.ndarray:
    """Number of the first edge that x does not exceed."""
    return np.searchsorted(np.array(edges), x, side="left")


def observe(lines: list[str], heads: np.ndarray | None = None) -> np.ndarray:
    """The binned statistics of lines, one row each; the last tells whether a line repeats the one
    before. heads: which lines open a document (default: the first)."""
    out, lo, size = [], 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= CHUNK:
            out.append(_observe(lines[lo : i + 1]))
            lo, size = i + 1, 0
    if lo < len(lines):
        out.append(_observe(lines[lo:]))
    if not out:
        return np.zeros((0, FEATURES), np.uint8)
    bare = [x.strip() for x in lines]
    again = np.fromiter((i > 0 and bare[i] == bare[i - 1] for i in range(len(bare))), bool, len(bare))
    again[0] = False
    if heads is not None:
        again &= ~heads
    return np.column_stack([np.concatenate(out), again]).astype(np.uint8)


FEATURES = 16


def _observe(lines: list[str]) -> np.ndarray:
    """Statistics of not blank lines: all characters of all lines go through the same array passes."""
    flags, small = _tables()
    joined = "\n".join(lines) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    beyond = cps >= TABLE
    if beyond.any():
        cps = np.where(beyond, np.where(cps < 0x40000, LETTER_BEYOND, SYMBOL_BEYOND), cps).astype(np.uint32)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    stop = np.cumsum(n + 1) - 1
    start = stop - n
    f = flags[cps]
    count = lambda x: np.add.reduceat(x, start, dtype=np.int32)
    has = lambda bit: (f & bit) != 0
    alpha, space, word, blank = has(ALPHA), has(SPACE), has(WORD), cps == 32
    letters, digits = count(alpha), count(has(DIGIT) & ~alpha)
    symbols = n - letters - digits - (count(space) - 1)  # the line end is no blank of the line

    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(x[1:] != x[:-1]) + 1
        edge = np.concatenate([[0], edge]) if x[0] else edge
        return edge[::2], edge[1::2]  # the last character is a line end, in no run

    w0, w1 = runs(word)
    line_of = np.searchsorted(stop, w0)
    k = np.bincount(line_of, minlength=len(lines))
    hashes = _word_hashes(small[cps], w0, w1)
    at = np.minimum(np.searchsorted(_COMMON_HASHES, hashes), len(_COMMON_HASHES) - 1)
    common = np.bincount(line_of[_COMMON_HASHES[at] == hashes], minlength=len(lines))
    keys = np.sort((line_of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(lines))

    t0, t1 = runs(~space)
    token_line = np.searchsorted(stop, t0)
    first_token = np.searchsorted(token_line, np.arange(len(lines)))
    m = np.bincount(token_line, minlength=len(lines))
    longest = np.maximum.reduceat(t1 - t0, first_token)
    head, tail = t0[first_token], t1[np.concatenate([first_token[1:], [len(t0)]]) - 1] - 1

    pad = np.concatenate([cps, [10, 10]])
    a, b, c = pad[:-2], pad[1:-1], pad[2:]
    b0, b1 = runs(blank)
    wide = (b1 - b0 >= 2) & (b0 > 0) & ~space[np.maximum(b0 - 1, 0)] & ~space[np.minimum(b1, len(space) - 1)]
    gaps = np.bincount(np.searchsorted(stop, b0[wide]), minlength=len(lines))
    columns = np.maximum.reduce([count(a == 9), count(a == 124), count(a == 59), count((a == 34) & (b == 44) & (c == 34)), np.where(m > 2, gaps, 0)])
    breaks = count((a == 32) & (c == 32) & np.isin(b, [ord(x) for x in "/·|•>»"]))
    pf = np.concatenate([f, np.full(2, SPACE, f.dtype)])
    inner, third = pf[1:-1], pf[2:]
    torn = word & ((((inner & TORN) != 0) & ((third & ALNUM) != 0)) | (((inner & DECIMAL) != 0) & ((third & WORD) != 0)))
    marks = np.fromiter((0 if not (x := _MARK.match(line)) else 1 if x.group(2) else 2 for line in lines), np.int64, len(lines))

    tf, tc, hf = f[tail], cps[tail], f[head]
    end = np.select([np.isin(tc, [ord(x) for x in ".!?…"]), np.isin(tc, [ord(x) for x in ",;:"]), (tf & ALPHA) != 0, (tf & DIGIT) != 0], [0, 1, 2, 3], 4)
    opens = np.select([(hf & LOWER) != 0, (hf & UPPER) != 0, (hf & DIGIT) != 0], [0, 1, 2], 3)
    k1, m1 = np.maximum(1, k), np.maximum(1, m)
    return np.column_stack([
        _bin(n, 8, 20, 45, 80),
        _bin(digits / n, 0, 0.04, 0.12, 0.25, 0.45),
        _bin(symbols / n, 0.0, 0.025, 0.05, 0.09, 0.16, 0.3),
        np.where(k < 2, 0, 1 + _bin(common / k1, 0, 0.12, 0.24, 0.36, 0.5)),
        marks,
        _bin(columns, 0, 1, 2, 4),
        end,
        _bin(letters / k1, 2.2, 4, 5.5, 7, 9, 13),
        _bin(count(torn) / m1, 0, 0.05, 0.15, 0.4),
        np.where(k < 6, 0, 1 + _bin(distinct / k1, 0.35, 0.6, 0.8, 0.95)),
        _bin(breaks / m1, 0, 0.08, 0.2, 0.35),
        _bin(longest, 12, 20, 30, 60),
        _bin(count(a == 44) / m1, 0, 0.08, 0.2, 0.4),
        opens,
        np.where(letters == 0, 0, _bin(count(has(UPPER)) / np.maximum(1, letters), 0, 0.06, 0.2, 0.5, 0.95)),
    ])


#: states per shape: a shape has several ways to look (a dump, a menu and a word salad are all junk)
WAYS = {"prose": 4, "list": 4, "table": 4, "junk": 10}
#: the shape of each state
OF = np.array([i for i, s in enumerate(SHAPES) for _ in range(WAYS[s])])
BINS = 8
#: documents, and characters, labelled together
GROUP, GROUP_CHARS = 512, 1 << 21


def _sizes(lines: list[str]) -> np.ndarray:
    return np.fromiter(map(len, lines), np.int64, len(lines))


class LineModel:
    """Transitions and independent categorical emissions of the states."""

    #: weight of a line's evidence: the statistics depend on each other
    TEMPER = 0.5

    def __init__(self, emit: np.ndarray, move: np.ndarray, first: np.ndarray, bound: float = 0.5):
        self.emit, self.move, self.first, self.bound = emit, move, first, bound

    def scores(self, obs: np.ndarray) -> np.ndarray:
        """log probability of each line (row) in each state (column)."""
        out = np.zeros((len(obs), len(OF)))
        for j in range(obs.shape[1]):
            out += self.emit[:, j].T[obs[:, j]]
        return self.TEMPER * out

    def label(self, obs: np.ndarray, extra: np.ndarray | float = 0.0) -> np.ndarray:
        """Viterbi path of states; extra: additional scores per state and line (used when fitting)."""
        if not len(obs):
            return np.zeros(0, int)
        scores = self.scores(obs) + extra
        at, back = self.first + scores[0], []
        for row in scores[1:]:
            way = at[:, None] + self.move
            best = way.argmax(axis=0)
            at = way[best, range(len(at))] + row
            back.append(best)
        s = int(at.argmax())
        path = [s]
        for row in reversed(back):
            s = int(row[s])
            path.append(s)
        return np.array(path[::-1])

    def label_many(self, docs: list[np.ndarray], extra: np.ndarray | None = None) -> list[np.ndarray]:
        """Viterbi paths of many documents, a line of all of them at a time: the same as ``label``.
        extra: a row of additional scores per document."""
        sizes = np.array([len(d) for d in docs], np.int64)
        paths = np.zeros(int(sizes.sum()), np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if len(paths):
            order = np.argsort(-sizes, kind="stable")
            scores = self.scores(np.concatenate(docs))
            if extra is not None:
                scores += np.repeat(extra, sizes, axis=0)
            begin = bounds[:-1][order]
            live = len(docs) - np.searchsorted(sizes[order][::-1], np.arange(int(sizes.max())), side="right")
            at = self.first + scores[begin[: live[0]]]
            back = []
            for t in range(1, len(live)):
                way = at[: live[t], :, None] + self.move
                best = way.argmax(axis=1)
                at[: live[t]] = np.take_along_axis(way, best[:, None, :], axis=1)[:, 0] + scores[begin[: live[t]] + t]
                back.append(best.astype(np.uint8))
            state = at.argmax(axis=1)
            for t in range(len(live) - 1, -1, -1):
                paths[begin[: live[t]] + t] = state[: live[t]]
                if t:
                    state[: live[t]] = back[t - 1][np.arange(live[t]), state[: live[t]]]
        return [paths[a:b] for a, b in zip(bounds, bounds[1:])]

    def shares(self, text: str | None) -> list[float] | None:
        return self.shares_many([text])[0]

    def shares_many(self, texts: list[str | None]) -> list[list[float] | None]:
        """Share of the characters in lines of each shape; null for a text without lines."""
        observed = observe_texts(texts)
        out: list[list[float] | None] = []
        for (obs, size), path in zip(observed, self.label_many([o for o, _ in observed])):
            got = np.bincount(OF[path], weights=size, minlength=4) if len(obs) else None
            out.append(None if got is None else (got / got.sum()).tolist())
        return out


def observe_texts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the observed lines and their lengths."""
    own = [pieces(t) if t else [] for t in texts]
    flat = [line for lines in own for line in lines]
    sizes, bounds = _sizes(flat), np.cumsum([0, *map(len, own)])
    heads = np.zeros(len(flat) + 1, bool)
    heads[bounds] = True
    obs = observe(flat, heads[:-1])
    return [(obs[a:b], sizes[a:b]) for a, b in zip(bounds, bounds[1:])]


def _groups(texts: list[str | None]) -> list[tuple[int, int]]:
    """Spans of texts of at most GROUP documents and about GROUP_CHARS characters; a longer text is one."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and (i - lo >= GROUP or size + n > GROUP_CHARS):
            out.append((lo, i))
            lo, size = i, 0
        size += n
    return [*out, (lo, len(texts))] if lo < len(texts) else out


def _estimate(docs: list[tuple[np.ndarray, np.ndarray]]) -> LineModel:
    k = len(OF)
    emit, move, first = np.full((k, FEATURES, BINS), 0.5), np.full((k, k), 0.2), np.full(k, 0.5)
    for obs, path in docs:
        first[path[0]] += 1
        np.add.at(emit, (path[:, None], np.arange(FEATURES)[None, :], obs), 1)
        np.add.at(move, (path[:-1], path[1:]), 1)
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return LineModel(norm(emit), norm(move), norm(first))


def _ways(docs: list[np.ndarray], k: int) -> np.ndarray:
    """Group documents by their mean line statistics: k means from farthest-first seeds."""
    x = np.array([np.eye(BINS)[o].mean(axis=0).ravel() for o in docs])
    dist = lambda c: ((x - c) ** 2).sum(axis=1)
    seeds = [x[dist(x.mean(axis=0)).argmin()]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.min([dist(c) for c in seeds], axis=0).argmax()])
    centers = np.array(seeds)
    for _ in range(12):
        own = np.array([dist(c) for c in centers]).argmin(axis=0)
        centers = np.array([x[own == j].mean(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
    return own


def fit(labelled: list[tuple[str, str]], rounds: int = 4) -> LineModel:
    """labelled: (text, shape)."""
    return fit_observed([(o, n, s) for (o, n), (_, s) in zip(observe_texts([t for t, _ in labelled]), labelled)], rounds)


def fit_observed(labelled: list[tuple[np.ndarray, np.ndarray, str]], rounds: int = 4) -> LineModel:
    """labelled: (observed lines, their lengths, shape). Viterbi training that starts from the documents'
    own shapes, each shape's documents grouped into its ways."""
    seen = [(o, SHAPES.index(s), n) for o, n, s in labelled if len(o) and s in SHAPES]
    if not seen:
        return _estimate([])
    start: list[tuple[np.ndarray, np.ndarray]] = []
    for s, name in enumerate(SHAPES):
        own = [o for o, shape, _ in seen if shape == s]
        if own:
            start += [(o, np.full(len(o), int(np.flatnonzero(OF == s)[w]))) for o, w in zip(own, _ways(own, WAYS[name]))]
    model = _estimate(start)
    # a line is of its document's shape, or prose, or in prose a small list or table
    allowed = np.full((len(seen), len(OF)), -1e3)
    for row, (_, s, _) in zip(allowed, seen):
        if s:
            row[OF == 0] = -1.5
        else:
            row[(OF == 1) | (OF == 2)] = -3.0
        row[OF == s] = 0.0
    docs = [o for o, _, _ in seen]
    for _ in range(rounds):
        paths = model.label_many(docs, allowed)
        for i, (o, s, n) in enumerate(seen):
            if 2 * n[(OF[paths[i]] > 0) == (s > 0)].sum() < n.sum():
                paths[i] = model.label(o, np.where(OF == s, 0.0, -1e3))  # most of it is what its label says
        model = _estimate(list(zip(docs, paths)))
    scored = [(n[OF[p] > 0].sum() / n.sum(), s > 0) for p, (_, s, n) in zip(model.label_many(docs), seen)]
    model.bound = max((x / 40 for x in range(10, 31)), key=lambda b: (sum((x > b) == y for x, y in scored), -abs(b - 0.5)))
    return model


# -- operators -----------------------------------------------------------------------
def fit_sample(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS, lines: int = FIT_LINES) -> LineModel:
    """Fit on at most ``limit`` labelled documents, those of the smallest hash of the id, and the first
    ``lines`` lines of each. Lines are observed by the executors: the driver gets the statistics, 20
    bytes a line, and no text."""
    picked = labels.select("doc_id", "shape").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            rows = [(o[:lines].tobytes(), n[:lines].astype(np.int32).tobytes()) for lo, hi in _groups(texts) for o, n in observe_texts(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), b.column(1)], names=["o", "n", "shape"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "shape").mapInArrow(run, "o binary, n binary, shape string").collect()
    rows.sort(key=lambda r: (bytes(r["o"]), bytes(r["n"]), r["shape"] or ""))  # the same model from any order of the rows
    return fit_observed([(np.frombuffer(r["o"], np.uint8).reshape(-1, FEATURES), np.frombuffer(r["n"], np.int32), r["shape"]) for r in rows])


def shapes(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, share of each shape, natural (whether it is prose); all null for a text without lines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: states x statistics x bins
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [r for lo, hi in _groups(texts) for r in m.shares_many(texts[lo:hi])]
            cols = [pa.array([None if r is None else r[i] for r in rows], pa.float64()) for i in range(4)]
            natural = pa.array([None if r is None else 1 - r[0] <= m.bound for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, natural], names=[id_col, *SHAPES, "natural"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, prose double, list double, `table` double, junk double, natural boolean")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words per document, in the
    JVM. Words are runs without white space; common words are compared in lower case without
    punctuation around. Ratios over nothing are null; null counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(t, "[ \\t\\r\\n]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(t, "\\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    d = docs.select(F.col(id_col), words.alias("w"), lines.alias("l"), F.length(F.regexp_replace(t, "[ \\t\\r\\n]", "")).alias("solid"),
                    F.length(F.regexp_replace(t, "[\\p{L}\\p{N} \\t\\r\\n]", "")).alias("symbols"))
    bare = F.transform("w", lambda w: F.btrim(F.lower(w), F.lit(".,;:!?()\"'")))
    known = F.array(*[F.lit(w) for w in sorted(COMMON)])
    total = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    n, nl = F.size("w").cast("bigint"), F.size("l")
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double"))
    return d.select(
        id_col, n.alias("n_words"), ratio(total, n).alias("mean_word_length"), ratio(F.col("symbols"), F.col("solid")).alias("symbol_ratio"),
        ratio(F.size(F.filter("l", lambda x: F.right(x, F.lit(1)).isin(".", "!", "?", ":", ";", ","))), nl).alias("punctuated_lines"),
        ratio(F.size(F.filter(bare, lambda w: F.array_contains(known, w))), n).alias("common_words"),
    )
