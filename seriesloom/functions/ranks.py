"""Exact rank correlations of many column pairs, each over the rows where both columns are known.

The rows are pinned and dealt into blocks. A block asks, per column, for the ranks of its distinct values: it sends each value with
its counts, tasks that hold one range of one column add the counts up over all blocks, and the answers come back in the order of the
question. The products of ranks are then added up inside the block. A row is moved once and a value at most once per column, however
many columns are on the other side: a pair has its own rows, but all that matters of the other column is where it is known, and
columns that are known on the same rows share their counts. Answers are differences of ranks, which are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.lineage import pin

BLOCK_BYTES = 128 << 20      # ranks that a block holds
EVERY = 32                   # one value in so many places the borders of ranges
POINTS = 2048                # borders known per column, and so ranges at most


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each list begins and ends."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(whole.value_lengths().to_numpy())])


def _matrix(rows: pa.RecordBatch | pa.Table, p: int) -> np.ndarray:
    """Columns as rows of a matrix, NaN where null."""
    return np.stack([rows.column(f"_c{i}").to_numpy(zero_copy_only=False) for i in range(p)]).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and matrix (column, row) of every block of a task; the rows of a block follow each other."""
    at, held = None, []
    for batch in batches:
        ids = batch.column("_block").to_numpy()
        if not len(ids):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
        m = _matrix(batch, p)
        for a, b in zip(cuts, cuts[1:]):
            if held and ids[a] != at:
                yield at, np.concatenate(held, 1)
                held = []
            at = int(ids[a])
            held.append(m[:, a:b])
    if held:
        yield at, np.concatenate(held, 1)


def _add_lists(table: pa.Table) -> pa.Table:
    """Sums of the counts, and the points spread evenly over all that came in."""
    counts, ends = _flat(table.column("n"))
    points = np.sort(_flat(table.column("v"))[0])
    if len(points) > POINTS:
        points = points[np.linspace(0, len(points) - 1, POINTS).astype(int)]
    n = counts.reshape(table.num_rows, -1).sum(0)
    return pa.table({"c": table.column("c").slice(0, 1), "n": _lists(n, [len(n)]), "v": _lists(points, [len(points)])})


_ADDED = "c int, n array<long>, v array<double>"
_ASKED = "block long, c int, part int, u array<double>, n array<int>"
_TOLD = "block long, c int, part int, r array<long>"
_SUMS = "pair long, xy double, xx double, yy double"


def rank_products(df: DataFrame, left: list[Column], right: list[Column], range_rows: int) -> tuple[DataFrame | None, np.ndarray]:
    """Sums ``_xy``, ``_xx``, ``_yy`` of centred ranks per ``_pair`` (number on the left times columns on the right, plus number
    on the right), and the number of rows of each pair. Ties share their mean rank. ``range_rows`` sets what one task ranks."""
    n_l, n_r = len(left), len(right)
    p = n_l + n_r
    bits = int(np.log2(np.clip(BLOCK_BYTES // (16 * n_l * n_r), 1024, 65536)))
    row = F.shiftright(F.monotonically_increasing_id(), bits).alias("_block")
    held = pin(df.select(row, *[c.alias(f"_c{i}") for i, c in enumerate([*left, *right])]))

    def survey(batches):
        both, points = np.zeros((p, p), np.int64), [[] for _ in range(p)]
        for _, m in _blocks(batches, p):
            known = ~np.isnan(m)
            k = known.astype(float)
            both += (k @ k.T).astype(np.int64)
            for c in range(p):
                points[c].append(np.sort(m[c, known[c]])[EVERY // 2::EVERY])
        if both.any():
            v = [np.concatenate(x) for x in points]
            yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), _lists(both.ravel(), [p] * p),
                                              _lists(np.concatenate(v), [len(x) for x in v])], ["c", "n", "v"])

    # One row a column: its counts with every other column, and borders of ranges.
    met = held.mapInArrow(survey, _ADDED).groupBy("c").applyInArrow(_add_lists, _ADDED).collect()
    if not met:
        return None, np.zeros((n_l, n_r), np.int64)
    both, points = np.zeros((p, p), np.int64), {}
    for x in met:
        both[x["c"]], points[x["c"]] = x["n"], np.array(x["v"])
    n = both[:n_l, n_l:]

    # Columns known on the same rows are one class; the first of them stands for all.
    alone = np.diag(both)
    same = (both == alone[:, None]) & (both == alone[None, :])

    def classes(side):
        first = [side[int(same[c, side].argmax())] for c in side]
        stand = sorted(set(first))
        return stand, [stand.index(f) for f in first]

    (stand_l, place_l), (stand_r, place_r) = classes(list(range(n_l))), classes(list(range(n_l, p)))
    others, place = [stand_r] * n_l + [stand_l] * n_r, place_l + place_r
    edges = []
    for c in range(p):
        parts = min(POINTS, -(-int(alone[c]) * len(others[c]) // range_rows))
        at = np.linspace(0, len(points[c]), max(parts, 1) + 1)[1:-1].astype(int)
        edges.append(np.unique(points[c][at]) if len(points[c]) else points[c])

    def counts(m):
        """Per column: its distinct values in order, their counts per class on the other side, the ends of the ranges."""
        known = ~np.isnan(m)
        for c in range(p):
            rows = known[c]
            u, inv = np.unique(m[c, rows], return_inverse=True)
            cells = np.stack([np.bincount(inv[known[o, rows]], minlength=len(u)) for o in others[c]])
            yield c, u, cells, [0, *np.searchsorted(u, edges[c], "left"), len(u)]

    def total(batches):
        sums = [np.zeros((len(edges[c]) + 1, len(others[c])), np.int64) for c in range(p)]
        seen = False
        for _, m in _blocks(batches, p):
            seen = True
            for c, _, cells, ends in counts(m):
                for part, (a, b) in enumerate(zip(ends, ends[1:])):
                    sums[c][part] += cells[:, a:b].sum(1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), _lists(np.concatenate([s.ravel() for s in sums]), [s.size for s in sums]),
                                              _lists(np.zeros(0), [0] * p)], ["c", "n", "v"])

    # Rows in earlier ranges, per column, range and class.
    ahead = [np.zeros((1, len(o)), np.int64) for o in others]
    if any(len(e) for e in edges):
        for x in held.mapInArrow(total, _ADDED).groupBy("c").applyInArrow(_add_lists, _ADDED).collect():
            of = np.array(x["n"]).reshape(-1, len(others[x["c"]]))
            ahead[x["c"]] = np.cumsum(of, 0) - of

    def ask(batches):
        for block, m in _blocks(batches, p):
            cs, parts, us, ns = [], [], [], []
            for c, u, cells, ends in counts(m):
                for part, (a, b) in enumerate(zip(ends, ends[1:])):
                    if b > a:
                        cs.append(c)
                        parts.append(part)
                        us.append(u[a:b])
                        ns.append(cells[:, a:b].ravel().astype(np.int32))
            if cs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(cs), pa.int64()), pa.array(cs, pa.int32()), pa.array(parts, pa.int32()),
                     _lists(np.concatenate(us), [len(u) for u in us]), _lists(np.concatenate(ns), [len(x) for x in ns])],
                    ["block", "c", "part", "u", "n"])

    def rank(table):
        k = len(others[table.column("c")[0].as_py()])
        u, ends = _flat(table.column("u"))
        asked, _ = _flat(table.column("n"))
        values, at = np.unique(u, return_inverse=True)
        cells = np.zeros((k, len(values)), np.int64)
        for a, b in zip(ends, ends[1:]):
            cells[:, at[a:b]] += asked[a * k:b * k].reshape(k, b - a)      # the values of a block are distinct
        twice = 2 * np.cumsum(cells, 1) - cells
        told = np.empty(len(asked), np.int64)
        for a, b in zip(ends, ends[1:]):
            told[a * k:b * k] = np.diff(twice[:, at[a:b]], axis=1, prepend=0).ravel()
        return pa.table({"block": table.column("block"), "c": table.column("c"), "part": table.column("part"), "r": _lists(told, np.diff(ends) * k)})

    def add_up(rows, told):
        m = _matrix(rows, p)
        known = ~np.isnan(m)
        cs, parts = (told.column(x).to_numpy() for x in ("c", "part"))
        r, ends = _flat(told.column("r"))
        answers = [[] for _ in range(p)]
        for i in np.lexsort((parts, cs)):
            c = cs[i]
            answers[c].append(np.cumsum(r[ends[i]:ends[i + 1]].reshape(len(others[c]), -1), 1) + 2 * ahead[c][parts[i]][:, None])
        twice = []                                                         # per column and class: twice the rank of each row
        for c in range(p):
            full = np.zeros((len(others[c]), m.shape[1]))
            if answers[c]:
                full[:, known[c]] = np.concatenate(answers[c], 1)[:, np.unique(m[c, known[c]], return_inverse=True)[1]]
            twice.append(full)
        pairs, sums = [], []
        for f in range(n_l):
            for t in range(n_r):
                use = known[f] & known[n_l + t]
                if use.any():
                    x, y = (twice[f][place[n_l + t], use] - n[f, t]) / 2, (twice[n_l + t][place[f], use] - n[f, t]) / 2
                    pairs.append(f * n_r + t)
                    sums.append((x @ y, x @ x, y @ y))
        xy, xx, yy = np.array(sums, float).reshape(-1, 3).T
        return pa.table({"pair": pa.array(pairs, pa.int64()), "xy": xy, "xx": xx, "yy": yy})

    answered = held.mapInArrow(ask, _ASKED).groupBy("c", "part").applyInArrow(rank, _TOLD)
    sums = held.groupBy("_block").cogroup(answered.groupBy("block")).applyInArrow(add_up, _SUMS)
    return sums.groupBy(F.col("pair").alias("_pair")).agg(*[F.sum(c).alias(f"_{c}") for c in ("xy", "xx", "yy")]), n
