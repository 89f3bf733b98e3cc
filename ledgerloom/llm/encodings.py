"""Garbled text from a wrong character encoding: find it and restore the original.

A hidden Markov model labels the characters outside ASCII: one clean state, and one state
per pair (written in, read in). A state emits units: in the clean state a character, in a
pair's state the characters that one original character turns into, with the probability
of that original between its neighbours. Each labelled span gets the inverse of its
state's damage. ASCII is the same in all pairs and therefore emitted alike by all states.

Emissions are counts of (character, what stands left, what stands right) over the whole
corpus, per table, with two coarser levels behind; a second round recounts on the labelled
result of the first (Viterbi training), so damage does not pass for a way of writing. Damage that
is repeated often enough counts for itself all the same; so what clean text hardly writes (a
control, a symbol or a letter of another script inside a word) is emitted less than its count says.
How often a text begins in a state is estimated from the labelled result as well.

Defined results: null, empty and pure ASCII texts are clean. A replacement character is
damage without a restored text (its span stays as it is). Characters no code page holds
(Chinese, emoji) are clean unless they come out of a unit.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (written in, read in); read twice: the same reading error happened two times
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "twice"),
    ("utf-8", "cp866"), ("utf-8", "koi8_r"), ("utf-8", "iso8859_2"), ("utf-8", "iso8859_15"), ("utf-8", "gbk"), ("utf-8", "shift_jis"),
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp866"), ("cp1252", "iso8859_7"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252"), ("cp850", "mac_roman"), ("mac_roman", "cp850"), ("cp1252", "utf-8"),
]
LOST = "\ufffd"
OUTSIDE = re.compile(r"[^\x00-\x7f]+")
#: codecs of several bytes a character
WIDE = ("gbk", "shift_jis")
#: a longer run of characters is not remembered, so a task's memory does not follow its texts
REMEMBERED = 12
#: paths of texts up to this length are remembered: names recur
SHORT = 80

#: that a text begins in a damaged state, before any is seen; later a multiple of the state's share of the
#: texts, within bounds: short damage speaks softly, and a pair nobody else shows is no explanation
BEGINS, WEIGHT, LEAST, MOST = 0.002, 3.0, 0.0005, 0.03
#: that damage begins further on, against at the beginning; that damage goes on
LATER, GOES_ON = 0.04, 0.93
FLOOR = 1e-9
#: taken from the counts of a character as it stands, so that a text (and its copy) does not
#: speak for itself
DISCOUNT = 2


def _reads(codec: str) -> dict[int, str]:
    """byte -> character; bytes a code page leaves open read as the control of that number."""
    return {b: (bytes([b]).decode(codec, "ignore") or chr(b)) for b in range(0x80, 0x100)}


_BYTES = {codec: {ch: b for b, ch in _reads(codec).items()} for pair in PAIRS for codec in pair if codec not in ("utf-8", "twice", *WIDE)}
# a sender's cp1252 is often read as ISO 8859-1: then the controls stand for their bytes
_BYTES["cp1252"] |= {chr(b): b for b in range(0x80, 0xA0)}
#: characters that count: all a code page holds
REPERTOIRE = frozenset(ch for t in _BYTES.values() for ch in t)


def _utf8_unit(text: str, i: int, table: dict[str, int]) -> tuple[int, str] | None:
    """(length, original) of the UTF-8 sequence that the characters from i on stand for."""
    lead = table.get(text[i])
    if lead is None or not 0xC2 <= lead <= 0xF4:
        return None
    n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    raw = [table.get(ch) for ch in text[i : i + n]]
    if len(raw) < n or None in raw or not all(0x80 <= b < 0xC0 for b in raw[1:]):
        return None
    try:
        return n, bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _twice_unit(text: str, i: int) -> tuple[int, str] | None:
    table, got, j = _BYTES["cp1252"], "", i
    for _ in range(4):
        unit = _utf8_unit(text, j, table) if j < len(text) else None
        if unit is None:
            return None
        j, got = j + unit[0], got + unit[1]
        whole = _utf8_unit(got, 0, table)
        if whole and whole[0] == len(got):
            return j - i, whole[1]
    return None


def _wide_unit(text: str, i: int, codec: str) -> tuple[int, str] | None:
    """The fewest characters from i on whose bytes are UTF-8 of characters that some code page holds."""
    for n in (1, 2, 3):
        if i + n > len(text):
            return None
        try:
            got = text[i : i + n].encode(codec).decode("utf-8")
        except UnicodeEncodeError:
            return None
        except UnicodeDecodeError:
            continue
        return (n, got) if all(ch < "\x80" or ch in REPERTOIRE for ch in got) else None
    return None


def _by_character() -> tuple[dict[str, list[tuple[int, str]]], dict[str, list[int]]]:
    """Per character the single-byte pairs that give it, with the original, and the pairs in whose code
    page it is the first byte of a UTF-8 sequence."""
    single: dict[str, list[tuple[int, str]]] = {}
    leads: dict[str, list[int]] = {}
    for k, (written_in, read_in) in enumerate(PAIRS, 1):
        if read_in == "utf-8" or read_in in WIDE:
            continue
        if written_in == "utf-8":
            for ch, b in _BYTES["cp1252" if read_in == "twice" else read_in].items():
                if 0xC2 <= b <= 0xF4:
                    leads.setdefault(ch, []).append(k)
            continue
        back = {b: ch for ch, b in _BYTES[written_in].items() if not 0x80 <= ord(ch) < 0xA0}
        for ch, b in _BYTES[read_in].items():
            if b in back and back[b] != ch:
                single.setdefault(ch, []).append((k, back[b]))
    return single, leads


_SINGLE, _LEADS = _by_character()
_WIDE_STATES = [(PAIRS.index(("utf-8", c)) + 1, c) for c in WIDE]
N = len(PAIRS) + 1


def units(run: str, i: int) -> list[tuple[int, int, str]]:
    """(state, length, original) of all units that can start at i; state 0 is clean."""
    ch = run[i]
    if ch == LOST:
        return [(0, 1, ch), (N - 1, 1, ch)]
    out = [(0, 1, ch)]
    out += [(k, 1, orig) for k, orig in _SINGLE.get(ch, ())]
    for k in _LEADS.get(ch, ()):
        read_in = PAIRS[k - 1][1]
        u = _twice_unit(run, i) if read_in == "twice" else _utf8_unit(run, i, _BYTES[read_in])
        if u:
            out.append((k, *u))
    if ch >= "\u2e80":
        for k, codec in _WIDE_STATES:
            u = _wide_unit(run, i, codec)
            if u:
                out.append((k, *u))
    return out


def context(ch: str) -> str:
    """What a neighbour counts as: ASCII letters as themselves, the rest by kind."""
    if ch < "\x80":
        return ch if ch.isalpha() else "0" if ch.isdigit() else " " if ch.isspace() else "."
    return "é" if ch.isalpha() else "§"


def coarse(c: str) -> str:
    return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c


#: marks that stand inside words
JOINING = frozenset("’‘ʼ·–‑‐­\u200b\u200c\u200d")


@lru_cache(maxsize=4096)
def _kind(ch: str) -> str:
    """control, symbol, joining, lower or upper Latin, other letter, or other."""
    if "\x80" <= ch < "\xa0":
        return "control"
    if ch.isalpha():
        if not unicodedata.name(ch, "").startswith("LATIN"):
            return "foreign"
        return "upper" if ch.isupper() else "lower"
    return "other" if ch in JOINING or unicodedata.category(ch)[0] in "MZ" else "symbol"


def oddness(left: str, ch: str, right: str) -> float:
    """log factor by which clean text writes a character less between two contexts than it is counted."""
    kind = _kind(ch)
    if kind == "control":
        return -7.0
    inside = left.isalpha() and right.isalpha()
    if kind == "symbol":
        return -4.0 if inside else 0.0
    if kind == "foreign":
        return -4.0 if (left.isascii() and left.isalpha()) or (right.isascii() and right.isalpha()) else 0.0
    if kind == "upper" and "a" <= left <= "z" and "a" <= right <= "z":
        return -3.0
    return 0.0


_BOTTOM = math.log(FLOOR)


class Emissions:
    """log probability of a character between two contexts, from counts and two coarser levels."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        texts = counts.get(("", "texts", ""), 0)
        seen = {k: counts.get(("", f"state {k}", ""), 0) for k in range(1, N)}
        begins = [min(MOST, max(LEAST, WEIGHT * seen[k] / texts)) if texts else BEGINS for k in range(1, N)]
        self.first = [math.log(1 - sum(begins)), *map(math.log, begins)]
        self.fall = [math.log(1 - LATER * sum(begins)), *[math.log(LATER * b) for b in begins]]
        counts = {k: n for k, n in counts.items() if k[0]}
        self.fine, self.rough, self.alone = dict(counts), Counter(), Counter()
        for (left, ch, right), n in counts.items():
            self.rough[coarse(left), ch, coarse(right)] += n
            self.alone[ch] += n
        self.total = max(1, sum(self.alone.values()))
        self.log = lru_cache(maxsize=200_000)(self._log)
        self._remember = lru_cache(maxsize=100_000)(self._run)
        self.short = lru_cache(maxsize=50_000)(lambda text: spans(text, self))

    def _log(self, left: str, ch: str, right: str, off: int = 0) -> float:
        if ch == LOST:
            return math.log(FLOOR)
        p = 0.8 * max(0, self.fine.get((left, ch, right), 0) - off) + 0.15 / 50 * self.rough.get((coarse(left), ch, coarse(right)), 0) + 0.05 / 3000 * self.alone.get(ch, 0)
        if ch not in REPERTOIRE:  # of two bytes in UTF-8: letters of small scripts, which all bytes can make
            return _BOTTOM if "\x80" <= ch < "\u0800" else math.log(1e-6)
        return math.log(p / self.total + FLOOR)

    def run(self, left: str, run: str, right: str) -> tuple[list[list[tuple[int, int, float, str]]], bool]:
        return (self._remember if len(run) <= REMEMBERED else self._run)(left, run, right)

    def _run(self, left: str, run: str, right: str) -> tuple[list[list[tuple[int, int, float, str]]], bool]:
        """Per position of a run the units that start there, with their emissions; and whether no
        choice of units beats the clean one even with free transitions."""
        ends = [left, *map(context, run), right]
        out = []
        for i in range(len(run)):
            row = []
            for k, n, orig in units(run, i):
                if k == N - 1:
                    p = math.log(0.5)
                elif k:
                    p = self.log(ends[i], orig[0], context(orig[1]) if len(orig) > 1 else ends[i + n + 1])
                else:
                    p = max(self.log(ends[i], ch := orig, ends[i + 2], DISCOUNT) + oddness(ends[i], ch, ends[i + 2]), _BOTTOM)
                row.append((k, n, p, orig))
            out.append(row)
        best = [0.0] + [-math.inf] * len(run)
        for i, row in enumerate(out):
            for _, n, p, _ in row:
                best[i + n] = max(best[i + n], best[i] + p)
        return out, sum(row[0][2] for row in out) >= best[-1]


_STAY, _LEAVE, _CROSS = math.log(GOES_ON), math.log(1 - GOES_ON - 0.01), math.log(0.01 / (N - 1))


def spans(text: str, model: Emissions) -> list[tuple[int, int, int, str]]:
    """The units of the best path: (start, end, state, original); an empty list if all is clean."""
    # transitions favour the clean state, so where it wins every run it wins the text
    runs = []
    last = len(text)
    for m in OUTSIDE.finditer(text):
        a, b = m.span()
        runs.append((a, b, model.run(context(text[a - 1]) if a else " ", m.group(), context(text[b]) if b < last else " ")))
    if all(r[2][1] for r in runs):
        return []
    first, fall = model.first, model.fall
    stay = [fall[0], *[_STAY] * (N - 1)]
    alpha: dict[int, float] | None = None
    trail: list[tuple] = []  # (start, end, state, original, index of the unit before)
    ends: dict[int, int] = {}  # state -> index in trail of its last unit
    for a, b, (table, _) in runs:
        at: list[dict[int, tuple[float, int]]] = [{} for _ in range(b - a + 1)]
        if alpha is not None:
            at[0] = {k: (s, ends[k]) for k, s in alpha.items()}
        for i, row in enumerate(table):
            here = at[i]
            if i and not here:
                continue
            top = max(here.items(), key=lambda x: x[1][0]) if here else None
            for k, n, p, orig in row:
                if top is None:
                    s, before = first[k], -1
                else:
                    best_k, (best_s, best_i) = top
                    s, before = best_s + (fall[k] if best_k == 0 else _LEAVE if k == 0 else _CROSS), best_i
                    clean = here.get(0)
                    if k and clean and clean[0] + fall[k] > s:
                        s, before = clean[0] + fall[k], clean[1]
                    own = here.get(k)
                    if own and own[0] + stay[k] > s:
                        s, before = own[0] + stay[k], own[1]
                s += p
                old = at[i + n].get(k)
                if old is None or s > old[0]:
                    trail.append((a + i, a + i + n, k, orig, before))
                    at[i + n][k] = (s, len(trail) - 1)
        alpha = {k: s for k, (s, _) in at[-1].items()}
        ends = {k: i for k, (_, i) in at[-1].items()}
    if not alpha:
        return []
    i, out = ends[max(alpha, key=alpha.get)], []
    while i >= 0:
        start, end, k, orig, before = trail[i]
        out.append((start, end, k, orig))
        i = before
    return out[::-1]


def restored(text: str, path: list[tuple[int, int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k, orig in path:
        if k:
            out += [text[at:a], orig]
            at = b
    return "".join([*out, text[at:]])


def count_text(text: str, path: list[tuple[int, int, int, str]] | None, labelled: bool, into: Counter, tag: str) -> None:
    """Add the characters of a text, as labelled, with their contexts; without labels, what reads as
    UTF-8 under some pair is left out of the count."""
    if labelled:
        into[tag, "", "texts", ""] += 1
        for k in {p[2] for p in path if p[2]}:
            into[tag, "", f"state {k}", ""] += 1
    if path:
        text = restored(text, path)
    last = len(text)
    for m in OUTSIDE.finditer(text):
        a, b = m.span()
        run, skip = m.group(), 0
        ends = [context(text[a - 1]) if a else " ", *map(context, run), context(text[b]) if b < last else " "]
        for i, ch in enumerate(run):
            if not labelled and i >= skip and (ch in _LEADS or ch >= "\u2e80"):
                got = [n for state, n, orig in units(run, i) if state and (n > 1 or state in _DENSE)]
                skip = i + max(got) if got else skip
            if ch in REPERTOIRE and (labelled or i >= skip):
                into[tag, ends[i], ch, ends[i + 2]] += 1


_DENSE = frozenset(k for k, _ in _WIDE_STATES)


# -- the operator --------------------------------------------------------------------
def _models(counts: DataFrame) -> dict[str, dict[tuple[str, str, str], int]]:
    """Collected counts: at most contexts * characters * contexts per table (57 * 57 * ~560), and in
    practice the few thousand combinations a language uses, whatever the number of texts."""
    out: dict[str, dict] = {}
    for r in counts.groupBy("tag", "l", "c", "r").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["tag"], {})[r["l"], r["c"], r["r"]] = r["n"]
    return out


_cache: dict[str, dict[str, Emissions]] = {}


def _emissions(shared) -> dict[str, Emissions]:
    if shared.value[0] not in _cache:
        _cache.clear()
        _cache[shared.value[0]] = {t: Emissions(c) for t, c in shared.value[1].items()}
    return _cache[shared.value[0]]


_EMPTY = Emissions({})


def _path(models: dict[str, Emissions] | None, tag: str, text: str) -> list[tuple[int, int, int, str]] | None:
    if models is None:
        return None
    model = models.get(tag, _EMPTY)
    return model.short(text) if len(text) <= SHORT else spans(text, model)


def find_damage(texts: DataFrame, rounds: int = 2) -> DataFrame:
    """texts(source_table, row_id, text) -> the damaged rows: source_table, row_id, pair (of the first
    damaged span), n_spans, restorable, damaged, restored."""
    spark = texts.sparkSession
    some = texts.select("source_table", F.col("row_id").cast("bigint").alias("row_id"), "text").where(F.col("text").rlike("[^\\x00-\\x7f]"))
    shared = None
    for _ in range(rounds):
        def tally(batches, shared=shared):
            models = _emissions(shared) if shared else None
            into: Counter = Counter()  # characters in contexts: bounded by the code pages
            for b in batches:
                for tag, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    count_text(text, _path(models, tag, text), models is not None, into, tag)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in into], pa.string()) for i in range(4)] + [pa.array(list(into.values()), pa.int64())], names=["tag", "l", "c", "r", "n"])

        counted = _models(some.mapInArrow(tally, "tag string, l string, c string, r string, n bigint"))
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, counted))

    def label(batches, shared=shared):
        models = _emissions(shared)
        for b in batches:
            rows = []
            for tag, row_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                path = _path(models, tag, text)
                bad = [p for p in path if p[2]]
                if bad:
                    first = PAIRS[bad[0][2] - 1]
                    rows.append((tag, row_id, f"{first[0]} as {first[1]}", len(bad), all(p[3] != LOST for p in bad), text, restored(text, path)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["source_table", "row_id", "pair", "n_spans", "restorable", "damaged", "restored"])

    return some.mapInArrow(label, "source_table string, row_id bigint, pair string, n_spans bigint, restorable boolean, damaged string, restored string")
