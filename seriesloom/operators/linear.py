"""Linear learners from shared normal equations.

One scan adds up, for every label at once, the products that least squares needs; ridge and elastic net are solved from
them on the driver, where only one matrix per label arrives. Huber regression reweights: one more scan a round, again for
all labels together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions.expr import finite
from seriesloom.functions.quantile import GROUP_ROWS, column_medians, quantiles
from seriesloom.lineage import pin
from seriesloom.operators.features import unpivot

# Strengths of the learners, on standardised features.
RIDGE, ELASTIC, MIX = 10.0, 0.05, 0.5
HUBER, HUBER_RIDGE = 1.35, 1e-4
HUBER_ROUNDS = 12
PACK_BYTES, CODEC = 16 << 20, "zstd"    # of a packed matrix, and what it is compressed by


@dataclass
class Model:
    """Coefficients on median-centred features, where a missing feature is 0."""
    intercept: float
    weights: np.ndarray


@dataclass
class Sums:
    """Weighted products of (1, features, label) of a label's rows, their number, and Huber's sums."""
    n: float
    gram: np.ndarray
    inner: float = 0.0          # squared residuals of the rows within reach
    outer: float = 0.0          # rows beyond it


def medians(train: DataFrame, features: Sequence[str], bound: int | None = None, cells: Packed | None = None) -> np.ndarray:
    """Exact medians; a feature without any value gets 0. Many rows are scanned a few times and should be a fixed result.

    ``cells`` are the rows of ``train`` where the caller has packed them.
    """
    if bound is not None and bound > GROUP_ROWS:
        got = column_medians(train, features) if cells is None else column_medians(cells.rows, features, read=cells.layout().columns)
        return np.array([got.get((0.0, f), 0.0) for f in features])
    long = unpivot(train.select(*[finite(f).alias(f) for f in features]), features)
    got = {r["feature"]: r["median"] for r in quantiles(long, ["feature"], "value", {"median": 0.5}, bound).collect()}     # one row a feature
    return np.array([got.get(f) or 0.0 for f in features])


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])


def _finite(m: np.ndarray) -> np.ndarray:
    """Infinities become NaN, which is a hole. Spark would test each of some hundred columns in one method too long to be compiled."""
    m[np.isinf(m)] = np.nan
    return m


def _held(df: DataFrame, features: Sequence[str], labels: Mapping[str, Column], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """``keep``, features as they are and labels as doubles; readers make the features ``_finite``."""
    xs, ys = [f"_x{i}" for i in range(len(features))], [f"_y{i}" for i in range(len(labels))]
    return df.select(*keep, *[F.col(f).alias(x) for f, x in zip(features, xs)], *[c.cast("double").alias(y) for c, y in zip(labels.values(), ys)]), xs, ys


def packed(held: DataFrame, features: int = 0) -> DataFrame:
    """Rows of numeric columns as matrices, pinned: what rounds read again and again is turned into doubles once.

    A matrix is kept by columns and compressed, ``PACK_BYTES`` at most before that; null is NaN, and so are infinities in the
    first ``features`` columns.
    """
    names = held.columns
    rows = max(1, PACK_BYTES // (8 * len(names)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = _matrix(part, names)
                _finite(m[:, :features])
                cells = pa.compress(np.ascontiguousarray(m.T).tobytes(), CODEC, asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([cells], pa.binary())], ["n", "cells"])

    return pin(held.mapInArrow(pack, "n int, cells binary"))


def _columns(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, cells in zip(batch.column("n").to_pylist(), batch.column("cells")):
            yield np.frombuffer(pa.decompress(cells.as_buffer(), 8 * n * width, CODEC)).reshape(width, n)


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The matrices of ``packed`` rows of ``width`` columns, one after the other."""
    for m in _columns(batches, width):
        yield np.ascontiguousarray(m.T)


@dataclass
class Packed:
    """Features and labels of rows as packed matrices, which medians, sums and rounds read."""
    rows: DataFrame | None
    features: int
    labels: list[str]

    def layout(self) -> Packed:
        """How the matrices are read, without the rows: what tasks need."""
        return Packed(None, self.features, self.labels)

    def matrices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return unpacked(batches, self.features + len(self.labels))

    def columns(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[None, np.ndarray]]:
        for m in _columns(batches, self.features + len(self.labels)):
            yield None, m

    def grouped(self, of: Mapping[str, float]) -> Callable:
        """``columns`` of rows whose group is told by the only label that they have."""
        features, labels = self.features, list(self.labels)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for m in _columns(batches, features + len(labels)):
                group = np.full(m.shape[1], np.nan)
                for i, name in enumerate(labels):
                    group[~np.isnan(m[features + i])] = of[name]
                yield group, m
        return read


def pack(train: DataFrame, features: Sequence[str], labels: Mapping[str, Column]) -> Packed:
    return Packed(packed(_held(train, features, labels)[0], len(features)), len(features), list(labels))


def _rows(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _filled(raw: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """1 and the centred features, 0 where one is missing."""
    return np.column_stack([np.ones(len(raw)), np.nan_to_num(raw - centre)])


def added(parts: DataFrame, key: str) -> dict[int, np.ndarray]:
    """The sum of the vectors ``part`` per ``key``. Tasks hand on whole vectors, not a row per entry."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for x in table.column("part"))
        return pa.table({key: table.column(key).slice(0, 1), "part": pa.array([total], pa.list_(pa.float64()))})

    got = parts.groupBy(key).applyInArrow(add, parts.schema).toArrow()
    return {k: v.values.to_numpy() for k, v in zip(got.column(key).to_pylist(), got.column("part"))}


def sums(train: DataFrame, features: Sequence[str], centre: np.ndarray | Mapping[str, np.ndarray], labels: Mapping[str, Column],
         near: Mapping[str, tuple[Model, float]] | None = None, cells: Packed | None = None,
         base: Mapping[str, Sums] | None = None) -> dict[str, Sums]:
    """Products per label over the rows where it is known. With ``near`` (model, scale), rows weigh as Huber's loss has them;
    ``base`` are then the same rows' unweighted sums.

    ``centre`` fills the holes: one vector, or one per label. ``cells`` are the features and labels of ``train`` where the caller
    has packed them.
    """
    if bool(near) != bool(base):
        raise ValueError("weighted sums are made from unweighted ones")
    held, xs, ys = _held(train, features, labels)
    size = len(features) + 2
    upper = np.triu_indices(size)
    fits = [near[name] for name in labels] if near else None
    centres = [centre[name] if isinstance(centre, Mapping) else centre for name in labels]
    every = [*xs, *ys]
    spots = [len(xs) + i for i in range(len(ys))] if cells is None else [len(xs) + cells.labels.index(name) for name in labels]
    ready = None if cells is None else cells.layout()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ys), len(upper[0]) + 3))
        seen = False
        for m in ready.matrices(batches) if ready else (_matrix(b, every) for b in batches if b.num_rows):
            seen = True
            raw = m[:, :len(xs)] if ready else _finite(m[:, :len(xs)])
            z, whole = None, None
            for i in range(len(ys)):
                y = m[:, spots[i]]
                known = ~np.isnan(y)
                if not known.any():
                    continue
                if z is None or centres[i] is not centres[i - 1]:
                    z, whole = None, None
                few = 2 * known.sum() < len(y)
                if few:
                    x, target = _filled(raw[known], centres[i]), y[known]
                else:                                                    # labels known on nearly all rows share the products of those
                    z = _filled(raw, centres[i]) if z is None else z
                    x, target = z, np.where(known, y, 0.0)
                weight = known[known] if few else known
                weight = weight.astype(float)
                if fits:
                    model, scale = fits[i]
                    off = np.abs(target - x @ np.concatenate([[model.intercept], model.weights])) * weight
                    far = off > HUBER * scale
                    weight[far] = HUBER * scale / np.maximum(off[far], 1e-300)
                    total[i, -2:] += (off[~far] ** 2).sum(), far.sum()
                    # Rows within reach weigh 1, as in ``base``: only what the others lose is added up.
                    lost = x[far] * np.sqrt(1 - weight[far])[:, None]
                    square = -(lost.T @ lost)
                elif few:
                    square = x.T @ x
                else:
                    whole = z.T @ z if whole is None else whole
                    square = whole - z[~known].T @ z[~known]
                across = x.T @ (target * weight)
                full = np.zeros((size, size))
                full[:-1, :-1], full[:-1, -1], full[-1, -1] = square, across, (target * target * weight).sum()
                total[i, :-3] += full[upper]
                total[i, -3] += known.sum()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ys)), pa.int32()), _rows(total)], ["label", "part"])

    parts = (held if cells is None else cells.rows).mapInArrow(add_up, "label int, part array<double>")
    got = added(parts, "label")                                                                              # one matrix a label
    out = {name: got.get(i, np.zeros(len(upper[0]) + 3)).copy() for i, name in enumerate(labels)}
    if base:
        for name in labels:
            kept = base[name].gram.copy()
            kept[:, -1], kept[-1] = 0.0, 0.0
            out[name][:-3] += kept[upper]
    made = {}
    for name, flat in out.items():
        m = np.zeros((size, size))
        m[upper] = flat[:-3]
        made[name] = Sums(float(flat[-3]), m + np.triu(m, 1).T, float(flat[-2]), float(flat[-1]))
    return made


def _standard(s: Sums, use: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Weight, correlation-like matrix and right side (per unit of weight), scales and means of the used features, label mean."""
    total = s.gram[0, 0]
    if s.n < 2 or total <= 0:
        raise ValueError(f"{int(s.n)} training rows")
    at = use + 1
    mean, y_mean = s.gram[0, at] / total, s.gram[0, -1] / total
    cov = s.gram[np.ix_(at, at)] / total - np.outer(mean, mean)
    right = s.gram[at, -1] / total - mean * y_mean
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    flat = scale < 1e-9
    scale[flat] = 1.0
    right = np.where(flat, 0.0, right / scale)
    cov = cov / np.outer(scale, scale)
    cov[flat], cov[:, flat] = 0.0, 0.0
    return total, cov, right, scale, mean, y_mean


def _model(s: Sums, use: np.ndarray, w: np.ndarray, scale: np.ndarray, mean: np.ndarray, y_mean: float) -> Model:
    weights = np.zeros(len(s.gram) - 2)
    weights[use] = w / scale
    if not np.isfinite(weights).all():
        raise ValueError("no finite solution")
    return Model(float(y_mean - mean @ weights[use]), weights)


def ridge(s: Sums, use: np.ndarray, strength: float = RIDGE) -> Model:
    """Least squares with squared weights of standardised features added ``strength`` times."""
    total, cov, right, scale, mean, y_mean = _standard(s, use)
    return _model(s, use, np.linalg.solve(cov + (strength / total + 1e-10) * np.eye(len(use)), right), scale, mean, y_mean)


def elastic_net(s: Sums, use: np.ndarray, strength: float = ELASTIC, mix: float = MIX, rounds: int = 2000, tolerance: float = 1e-9) -> Model:
    """Coordinate descent on the shared matrix: half the mean squared error plus both penalties."""
    _, cov, right, scale, mean, y_mean = _standard(s, use)
    w, fitted = np.zeros(len(use)), np.zeros(len(use))                      # fitted = cov @ w
    for _ in range(rounds):
        most = 0.0
        for j in range(len(use)):
            pull = right[j] - fitted[j] + cov[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - strength * mix, 0.0) / (cov[j, j] + strength * (1 - mix)) if cov[j, j] > 0 else 0.0
            if new != w[j]:
                fitted += cov[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j])), new
        if most < tolerance:
            break
    return _model(s, use, w, scale, mean, y_mean)


def huber(train: DataFrame, features: Sequence[str], centre: np.ndarray, labels: Mapping[str, Column], first: Mapping[str, Sums],
          rounds: int = HUBER_ROUNDS, cells: Packed | None = None) -> dict[str, Model | str]:
    """Robust fits of all labels by reweighting, with the scale fitted beside them; a label that fails gives its message.

    ``first`` are the sums of the same rows without weights, ``cells`` the rows where the caller has packed them.
    """
    use, out, near = np.arange(len(features)), {}, {}
    for name in labels:
        try:
            model = ridge(first[name], use, HUBER_RIDGE)
            v = np.concatenate([[-model.intercept], -model.weights, [1.0]])
            near[name] = (model, float(np.sqrt(max(v @ first[name].gram @ v / first[name].n, 1e-12))))
        except (ValueError, np.linalg.LinAlgError) as failure:
            out[name] = str(failure)
    left = {name: c for name, c in labels.items() if name in near}
    if cells is None and left and rounds:
        cells = pack(train, features, left)
    for _ in range(rounds if left else 0):
        for name, s in sums(train, features, centre, left, near, cells, first).items():
            scale = float(np.sqrt(max(s.inner / max(s.n - s.outer * HUBER ** 2, 1.0), 1e-12)))
            near[name] = (ridge(s, use, HUBER_RIDGE), scale)
    return out | {name: model for name, (model, _) in near.items()}


def predict(rows: DataFrame, features: Sequence[str], centre: np.ndarray | Sequence[np.ndarray], models: Sequence[Model], keep: Sequence[str], name: str = "p") -> DataFrame:
    """``keep`` columns and an array of every model's prediction, by one matrix product per ``centre`` (one, or one per model)."""
    held, xs, _ = _held(rows, features, {}, keep)
    weights, intercept = np.column_stack([m.weights for m in models]), np.array([m.intercept for m in models])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _finite(_matrix(batch, xs))
            if isinstance(centre, np.ndarray):
                p = np.nan_to_num(raw - centre) @ weights + intercept
            else:
                p = np.column_stack([np.nan_to_num(raw - c) @ m.weights + m.intercept for c, m in zip(centre, models)])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(models), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], [*keep, name])

    kinds = dict(held.dtypes)
    return held.mapInArrow(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` array<double>"]))


def vectors(rows: DataFrame, features: Sequence[str], centre: np.ndarray, keep: Sequence[str], name: str = "_raw") -> DataFrame:
    """``keep`` and one vector of the features, medians in the holes: what trees read."""
    held, xs, _ = _held(rows, features, {}, keep)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _finite(_matrix(batch, xs))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _rows(np.where(np.isnan(m), centre, m))], [*keep, name])

    kinds = dict(held.dtypes)
    filled = held.mapInArrow(fill, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` array<double>"]))
    return filled.select(*keep, array_to_vector(name).alias(name))


Solver = Callable[[Sums, np.ndarray], Model]
SOLVERS: dict[str, Solver] = {"ridge": ridge, "elastic_net": elastic_net}
