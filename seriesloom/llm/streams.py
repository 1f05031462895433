"""Passes over the sorted rows of a key that hold one row at a time, for keys of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def folded(rows: DataFrame, key: list[str], order: str | Column, value: str, out: str, begin: Callable, step: Callable, end: Callable | None) -> DataFrame:
    """Fold every key's ``value`` in ``order``: state = begin(), then state = step(state, value).

    With ``end``: one row per key, its columns and ``out``, which end(state) gives. Without: ``rows`` with ``out``, the
    state before each row, in place of ``value``. The rows of a key meet in one task, which reads them as a stream.
    """
    name, kind = out.split()
    dealt = rows.repartition(*key).sortWithinPartitions(*key, order)
    kept = key if end else [c for c in rows.columns if c != value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, made = None, None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
            done, states = [], []
            for k, v in zip(keys, batch.column(value).to_pylist()):
                if k != now:
                    if end and now is not None:
                        done.append((*now, end(state)))
                    now, state = k, begin()
                states.append(state)
                state = step(state, v)
            if end:
                made = pa.schema([*(batch.schema.field(k) for k in key), pa.field(name, pa.string())])
                yield pa.RecordBatch.from_pylist([dict(zip(made.names, d)) for d in done], made)
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(states, pa.int32())], [*kept, name])
        if end and now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(made.names, (*now, end(state))))], made)

    kinds = dict(rows.dtypes)
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"{name} {kind}"]))


def sha256_of(rows: DataFrame, key: list[str], order: str, text: str, separator: str, out: str) -> DataFrame:
    """One row per key: the lowercase SHA-256 of its non-null texts in order, joined by ``separator``."""
    def begin():
        return hashlib.sha256(), [True]

    def step(state, value):
        digest, first = state
        if value is not None:
            digest.update((value if first[0] else separator + value).encode())
            first[0] = False
        return state

    return folded(rows, key, order, text, f"{out} string", begin, step, lambda state: state[0].hexdigest())
