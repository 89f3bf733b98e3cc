"""Ordered folds per key, for rules where each row depends on the state the row before left.

These are not associative, so one task must see a key's rows in order. It sees them one
Arrow batch after the other and keeps only the state, never the group: the rows are
partitioned by key, sorted, and streamed through mapInArrow.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Callable, start, out: str, out_type: pa.DataType, keep: list[str]) -> DataFrame:
    """Adds ``out``: step(state, *inputs) -> (state, value) over the key's rows in order. A null key
    is a key. State lives across batches of a partition."""
    cols = list(dict.fromkeys([key, *keep, *inputs]))
    d = df.select(*dict.fromkeys([*cols, *order])).repartition(key).sortWithinPartitions(key, *order).select(*cols)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keep] + [f"`{out}` {_spark(out_type)}"])
    names = [c for c in cols if c in keep]

    def run(batches):
        state, current, begun = start, None, False
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            values = []
            for k, *args in zip(*(b.column(at[c]).to_pylist() for c in (key, *inputs))):
                if not begun or k != current:
                    state, current, begun = start, k, True
                state, v = step(state, *args)
                values.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in names), pa.array(values, out_type)], names=[*names, out])

    return d.mapInArrow(run, ddl)


def _spark(t: pa.DataType) -> str:
    return {"int64": "bigint", "string": "string", "bool": "boolean", "double": "double"}[str(t)]


def bucket_levels(requests: DataFrame, key: str, order: list[str], keep: list[str], time: str, capacity: int, per_ms: int) -> DataFrame:
    """Token-bucket replay: admitted or not per request; one token comes back every ``per_ms``. ``time``
    in milliseconds. Remainders of time are carried, so refills are exact."""
    def step(state, t):
        level, since = (capacity, t) if state is None else state
        back = (t - since) // per_ms
        level, since = min(capacity, level + back), since + back * per_ms
        if level >= capacity:
            since = t
        return ((level - 1, since), "admitted") if level > 0 else ((level, since), "refused")

    return ordered_fold(requests, key, order, [time], step, None, "admission", pa.string(), keep)


def versioned_puts(puts: DataFrame, key: str, order: list[str], if_version: str, content: str, keep: list[str]) -> DataFrame:
    """Optimistic writes: a put applies if its ``if_version`` is null or the current version (0: must
    not exist yet); equal content is unchanged. Outcome: applied, unchanged, conflict."""
    def step(state, want, new):
        version, old = state
        if want is not None and want != version:
            return state, "conflict"
        if version and new == old:
            return state, "unchanged"
        return (version + 1, new), "applied"

    return ordered_fold(puts, key, order, [if_version, content], step, (0, None), "outcome", pa.string(), keep)


def governed(requests: DataFrame, key: str, order: list[str], keep: list[str], time: str, *, quota: int, strikes: int, capacity: int, per_ms: int) -> DataFrame:
    """Admission per request, first that holds: ``quota`` (so many were admitted), ``quarantine`` (so
    many were refused by the bucket), ``refused`` (no token left), ``admitted``."""
    def step(state, t):
        used, struck, level, since = (0, 0, capacity, t) if state is None else state
        if used >= quota:
            return (used, struck, level, since), "quota"
        if struck >= strikes:
            return (used, struck, level, since), "quarantine"
        back = (t - since) // per_ms
        level, since = min(capacity, level + back), since + back * per_ms
        if level >= capacity:
            since = t
        return ((used + 1, struck, level - 1, since), "admitted") if level > 0 else ((used, struck + 1, level, since), "refused")

    return ordered_fold(requests, key, order, [time], step, None, "admission", pa.string(), keep)


def chunk_outcomes(chunks: DataFrame, stream: str, order: list[str], keep: list[str], ordinal: str, key: str, digest: str, remembered: int = 4_096) -> DataFrame:
    """Chunks of a stream with strictly rising ordinals: ``applied`` (the next one), ``replayed`` (a key
    that was applied, with its digest), ``conflict`` (with another), ``gap`` (too high an ordinal),
    ``stale`` (a new key at an ordinal that is past). The latest ``remembered`` keys are known, older
    ones are forgotten first in, first out, so the state is bounded."""
    def step(state, n, k, h):
        at, seen = (0, {}) if state is None else state
        if k in seen:
            return (at, seen), "replayed" if seen[k] == h else "conflict"
        if n is None or n > at + 1:
            return (at, seen), "gap"
        if n <= at:
            return (at, seen), "stale"
        if len(seen) >= remembered:
            seen.pop(next(iter(seen)))
        seen[k] = h
        return (n, seen), "applied"

    return ordered_fold(chunks, stream, order, [ordinal, key, digest], step, None, "outcome", pa.string(), keep)
