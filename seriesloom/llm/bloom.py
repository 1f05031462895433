"""Bloom filters built by Spark tasks and tested in numpy.

Every key sets four bits of one 64-bit word. A filter never exceeds ``MAX_WORDS`` words (32 MB), however many
keys there are: beyond that it only lets more keys through, and all users treat what it lets through exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.llm.common import FETCHED, ROW, fresh, numbered
from seriesloom.llm.memory import tidy

MAX_WORDS = 1 << 22
BITS_PER_KEY = 16
SEGMENT, SEGMENTS = 512, 256       # a filter under construction is sent in rows of 512 words or more, at most 256 rows
LOT = 256                          # a segment's results of so many neighbouring tasks are merged first, then those of all lots


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def places(keys: np.ndarray, words: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit mask of every key; ``words`` is a power of two."""
    h = mixed(keys, salt)
    mask = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(32)) & np.uint64(words - 1)).astype(np.int64), mask


def holds(filter_: np.ndarray, keys: np.ndarray, salt: int = 0) -> np.ndarray:
    at, mask = places(keys, len(filter_), salt)
    return (filter_[at] & mask) == mask


def words_for(n: int, bits_per_key: float = BITS_PER_KEY) -> int:
    return min(MAX_WORDS, 1 << max(4, math.ceil(math.log2(max(1, n * bits_per_key / 64)))))


def _longs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).drop_null().to_numpy().view(np.uint64)


def build(keys: DataFrame, words: int, repeated: bool = False, salt: int = 0,
          extract: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = _longs) -> np.ndarray:
    """The filter over the one long column of ``keys``; with ``repeated``, over keys that may occur twice.

    ``extract`` may read other columns: it gives arrays of 64-bit keys for a batch.

    Each task fills a filter of its own and sends the segments in which it set a bit. Two filters join by OR;
    a bit that both have set may stand for a repeated key, so it enters the second filter. A repeated key thus
    always passes; null keys are skipped. The driver receives the finished filter, at most 32 MB.
    """
    segment = max(SEGMENT, words // SEGMENTS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            for some in extract(batch):
                found, counts = np.unique(some, return_counts=True)
                at, mask = places(found, words, salt)
                if repeated:
                    again = (counts > 1) | ((once[at] & mask) == mask)
                    np.bitwise_or.at(twice, at[again], mask[again])
                np.bitwise_or.at(once, at, mask)
        lot = TaskContext.get().partitionId() // LOT
        at = [i for i in range(0, words, segment) if once[i:i + segment].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([lot] * len(at), pa.int32()),
             *[pa.array([bits[i:i + segment].tobytes() for i in at], pa.binary()) for bits in (once, twice)]], ["segment", "lot", "once", "twice"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = None, None
        for a, b in zip(group["once"], group["twice"]):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "lot": [0], "once": [once.tobytes()], "twice": [twice.tobytes()]})

    shape = "segment int, lot int, once binary, twice binary"
    parts = keys.mapInArrow(tidy(fill), shape).groupBy("segment", "lot").applyInPandas(merge, shape).groupBy("segment").applyInPandas(merge, shape)
    out = np.zeros(words, np.uint64)
    for r in parts.select("segment", F.col("twice" if repeated else "once").alias("bits")).coalesce(FETCHED).toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint64)
        out[r["segment"]:r["segment"] + len(part)] = part
    return out


def passes(spark: SparkSession, filter_: np.ndarray, key: Column, salt: int = 0) -> Column:
    """Boolean column: may ``key`` (a long) be in the filter? Null keys are not."""
    shared = spark.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, h.fillna(0).to_numpy().astype(np.int64).view(np.uint64), salt) & h.notna().to_numpy())

    return test(key)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, a table scan, less the rows whose number is in the one column of ``dropped``.

    Rows that a Bloom filter of ``dropped`` rejects, which is nearly all that stay, pass straight through; only the
    others are shuffled for an exact anti-join. ``dropped`` should be pinned: it is read twice. All columns stay as
    they are, whatever their names.
    """
    row, maybe = fresh(docs, ROW), fresh(docs, "_maybe")
    filter_ = build(dropped, words_for(dropped.count()))
    marked = numbered(docs, row)
    marked = marked.withColumn(maybe, passes(docs.sparkSession, filter_, F.col(row)))
    rest = marked.where(F.col(maybe)).join(dropped.toDF(row), row, "left_anti")
    return marked.where(~F.col(maybe)).select(docs.columns).unionByName(rest.select(docs.columns))
