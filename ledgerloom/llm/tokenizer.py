"""Encoding a corpus with a public byte-level BPE tokenizer.

Pre-tokenisation works on arrays of codepoints, without regular expressions: each
codepoint becomes a symbol (its class plus what follows it), each symbol is a function
on nine states, and an associative scan over blocks composes these functions, so every
block is located independently of the ones before it. The slices found feed a cached
pair merging; byte offsets are kept for decoding.

Defined results: a null text and an empty text have no ids (an empty list). Strings that
look like special tokens are ordinary text. Decoding the ids gives the text back.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: default folder of the vocabulary files; a parameter everywhere
TOKENIZERS = "/opt/tokenizers"

# -- symbols and states ------------------------------------------------------------
LETTER, NUMBER, OTHER, APOS1, APOS2, BLANK_LAST, SPACE_LAST, SPACE, BREAK = range(9)
BOS, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, OWES_1, OWES_2, ENDED = range(9)
_RUN = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]: whether a piece starts at the symbol.

    APOS1/APOS2: an apostrophe that a contraction of one or two letters follows; it is one if
    it starts a piece. A white-space run gives its last character to itself or, if that is
    a blank, to the piece that follows."""
    nxt, starts = np.zeros((9, 9), np.uint8), np.ones((9, 9), bool)
    for s in range(9):
        for sym, run in _RUN.items():
            nxt[sym, s] = run
            starts[sym, s] = s not in (run, AFTER_BLANK)
        for sym, owes in ((APOS1, OWES_1), (APOS2, OWES_2)):
            inside = s in (IN_OTHER, AFTER_BLANK)
            nxt[sym, s], starts[sym, s] = (IN_OTHER, False) if inside else (owes, True)
        nxt[BLANK_LAST, s] = AFTER_BLANK
        nxt[SPACE_LAST, s] = ENDED
        nxt[SPACE, s], starts[SPACE, s] = IN_SPACE, s != IN_SPACE
        nxt[BREAK, s] = BOS
    nxt[LETTER, OWES_1], starts[LETTER, OWES_1] = ENDED, False
    nxt[LETTER, OWES_2], starts[LETTER, OWES_2] = OWES_1, False
    return nxt, starts


NEXT, STARTS = _tables()
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every codepoint, built once per process."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        t[_WHITE] = SPACE
        _classes = t
    return _classes


def symbols(cps: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts; breaks marks the separator after each text."""
    cls = codepoint_classes()[cps]
    cls[breaks] = BREAK
    nxt = np.empty_like(cls)
    nxt[:-1], nxt[-1] = cls[1:], BREAK
    space = cls == SPACE
    last = space & (nxt != SPACE) & (nxt != BREAK)
    sym = cls.copy()
    sym[last] = SPACE_LAST
    sym[last & (cps == 0x20)] = BLANK_LAST
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        padded = np.concatenate([cps, np.zeros(2, cps.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        sym[at[np.isin(a, [ord(c) for c in "stmd"])]] = APOS1
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[at[two]] = APOS2
    return sym


def piece_starts(sym: np.ndarray, block: int = 256, window: int = 1 << 20) -> np.ndarray:
    """Where pieces start. Per window: compose the symbols' functions inside all blocks at once,
    chain the block functions to get each block's entry state, then run the blocks at once."""
    out = np.empty(len(sym), bool)
    state = BOS
    window = -(-window // block) * block  # only the last window may end inside a block
    for lo in range(0, len(sym), window):
        part = sym[lo : lo + window]
        n = len(part)
        rows = -(-n // block)
        grid = np.full(rows * block, BREAK, np.uint8)
        grid[:n] = part
        grid = np.ascontiguousarray(grid.reshape(rows, block).T)
        f = np.tile(np.arange(9, dtype=np.uint8), (rows, 1))
        for col in grid:
            f = NEXT[col[:, None], f]
        entry = np.empty(rows, np.uint8)
        s = state
        for r, g in enumerate(f.tolist()):
            entry[r] = s
            s = g[s]
        flags = np.empty((block, rows), bool)
        at = entry
        for j, col in enumerate(grid):
            flags[j] = STARTS[col, at]
            at = NEXT[col, at]
        out[lo : lo + n] = flags.T.reshape(-1)[:n]
        state = s
    return out


# -- pair merging ------------------------------------------------------------------
class BytePairEncoder:
    """Encodes pieces by their byte ranks, each distinct piece once (bounded cache)."""

    CACHE, CACHED_LENGTH = 1 << 19, 64

    def __init__(self, vocabulary: bytes):
        """vocabulary: the content of a rank file, one base64 token and its rank per line."""
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join the adjacent pair of lowest rank until none is left: a heap of pairs over a linked
        list, n log n, so one piece of a million characters is no problem."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != e or end[i] != j:
                continue
            alive[j] = False
            end[i], nxt[i] = e, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : e])) is not None:
                heapq.heappush(heap, (r, prev[i], e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return tuple(out)

    def encode_batch(self, texts: list[str | None], offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids, first id of each text and the end, byte offset of each id in its text)."""
        joined = "\x00".join(t or "" for t in texts) + "\x00"
        raw = joined.encode("utf-8")
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lens + 1) - 1
        breaks = np.zeros(len(cps), bool)
        breaks[ends] = True
        widths = 1 + (cps >= 0x80).astype(np.uint8) + (cps >= 0x800) + (cps >= 0x10000)
        at = np.cumsum(widths, dtype=np.int64) - widths
        first = np.flatnonzero(piece_starts(symbols(cps, breaks)))
        starts = at[first].tolist()
        is_break = breaks[first].tolist()
        starts.append(len(raw))
        cache, merge, short = self.cache, self.merge, self.CACHED_LENGTH
        ids: list[int] = []
        bounds, where, base = [0], [], 0
        for k, stop in enumerate(is_break):
            a, b = starts[k], starts[k + 1]
            if stop:
                bounds.append(len(ids))
                base = b
                continue
            piece = raw[a:b]
            got = cache.get(piece)
            if got is None:
                got = merge(piece)
                if b - a <= short:
                    if len(cache) >= self.CACHE:
                        cache.clear()
                    cache[piece] = got
            ids += got
            if offsets:
                p = a - base
                for i in got:
                    where.append(p)
                    p += len(self.tokens[i])
        return np.array(ids, np.int32), np.array(bounds, np.int64), np.array(where, np.int64) if offsets else None

    def decode(self, ids) -> str:
        return b"".join(self.tokens[int(i)] for i in ids).decode("utf-8")


# -- the operator -------------------------------------------------------------------
def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The rank file, read by the driver and broadcast: under 1 MB, whatever the data."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_encoders: dict[int, BytePairEncoder] = {}


def _encoder(shared) -> BytePairEncoder:
    key = shared.value.__hash__()
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(shared.value)
    return _encoders[key]


def _parts(texts: list[str | None], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Spans of texts of about ``chars`` characters; a longer text is a span of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, what: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """what = ids: (id, ids); offsets: (id, ids, offsets); count: (id, n_tokens); check:
    (id, n_tokens, same), whether decoding gives the text back (null counts as empty).
    keep: further columns to pass through; a name that clashes with a result is an error."""
    spark = docs.sparkSession
    shared = vocabulary(spark, name, folder)
    keep = keep or []
    fixed = {"ids": "ids array<int>", "offsets": "ids array<int>, offsets array<bigint>", "count": "n_tokens bigint", "check": "n_tokens bigint, same boolean"}[what]
    names = [id_col, *keep, *[c.split()[0] for c in fixed.split(", ")]]
    if len(set(names)) < len(names):
        raise ValueError(f"clashing column names: {names}")
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep)], fixed])

    def run(batches):
        enc = _encoder(shared)
        for batch in batches:
            all_texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in _parts(all_texts):
                texts, kept = all_texts[lo:hi], [batch.column(c).slice(lo, hi - lo) for c in range(batch.num_columns - 1)]
                ids, bounds, where = enc.encode_batch(texts, offsets=what == "offsets")
                count = pa.array(np.diff(bounds), pa.int64())
                if what in ("ids", "offsets"):
                    cols = [*kept, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                    if what == "offsets":
                        cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(where, pa.int64())))
                elif what == "count":
                    cols = [*kept, count]
                else:
                    same = [enc.decode(ids[a:b]) == (t or "") for t, a, b in zip(texts, bounds, bounds[1:])]
                    cols = [*kept, count, pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*[F.col(c) for c in (id_col, *keep)], F.col(text_col).alias("_text")).mapInArrow(run, schema)
