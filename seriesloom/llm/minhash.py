"""Near-duplicate documents: DartMinHash signatures, banded candidates, exact check, connected components.

Each weighted element owns the region [0, weight) x [0, infinity) of (weight, rank). Hashed darts fall on it with
density one: dyadic cells of the region get a Poisson number of darts that depends on element and cell alone. A dart hits
one of the signature's coordinates, which keeps the dart of least rank. Two documents share a coordinate's dart with a
probability of their weighted Jaccard similarity. Cells are visited by rising rank until every coordinate is hit, so the
cost per document is its size plus about k log k darts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from seriesloom.lineage import pin
from seriesloom.llm import bloom
from seriesloom.llm.bloom import mixed
from seriesloom.llm.common import ROW, attach, components, numbered
from seriesloom.llm.memory import tidy
from seriesloom.llm.words import hashed_words, shingles, slices

BANDS, PER_BAND = 24, 5           # a pair at similarity 0.8 shares no band with probability 0.00007
K = BANDS * PER_BAND
SIMILAR = (4, 5)                  # Jaccard similarity 4/5 or more is a link
PLAUSIBLE = 0.6                   # share of equal coordinates, 5.5 standard errors below 0.8, that is worth an exact check
FIRST_RANK = -6                   # the first cells reach to rank 2^-6, each later one doubles it
CHUNK = 2048                      # members of a bucket that one task compares with as many others,
CHUNK_BYTES = 1 << 23             # and bytes of their shingle sets
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _poisson(area: float) -> np.ndarray:
    """P(darts <= n) for n = 0, 1, ... up to all but 1e-15."""
    term, total, out, n = math.exp(-area), 0.0, [], 0
    while not out or (1 - total > 1e-15 and n < 40 + 4 * area):
        total += term
        out.append(total)
        n += 1
        term *= area / n
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def dart_minhash(offsets: np.ndarray, elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """(sets, k) fingerprints (uint32) of weighted sets; set i has elements offsets[i]:offsets[i + 1].

    ``weights`` are positive (default 1); elements are unique within a set, or repeated with equal weight. A set without
    elements has all-ones fingerprints.
    """
    n = len(offsets) - 1
    best = np.full(n * k, _NONE)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    level, low, high = 0, 0.0, 2.0 ** FIRST_RANK
    while len(elements):
        cell_low, cell_high, cell = 0.0, 1.0, 0
        while True:
            inside = weights > cell_low
            if not inside.any():
                break
            who, own, w = (elements, owner, weights) if inside.all() else (elements[inside], owner[inside], weights[inside])
            h = mixed(who, 1000 * (level + 1) + cell)
            u, table = _unit(h), _poisson((cell_high - cell_low) * (high - low))
            hit = np.flatnonzero(u >= table[0])
            darts = np.searchsorted(table, u[hit], side="right")
            at = np.repeat(hit, darts)
            number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
            d = mixed(h[at] + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 3)
            keep = cell_low + _unit(mixed(d, 4)) * (cell_high - cell_low) < w[at]
            d, at = d[keep], at[keep]
            rank = (low + _unit(mixed(d, 5)) * (high - low)).astype(np.float32).view(np.uint32).astype(np.uint64)
            place = own[at] * k + (mixed(d, 6) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, place, (rank << np.uint64(32)) | (d >> np.uint64(32)))
            cell_low, cell_high, cell = cell_high, 2 * cell_high, cell + 1
        open_ = (best.reshape(n, k) == _NONE).any(axis=1)
        still = open_[owner]
        elements, owner, weights = elements[still], owner[still], weights[still]
        level, low, high = level + 1, high, 2 * high
    return best.reshape(n, k).astype(np.uint32)


def weighted_shingles(offsets: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unique shingles per text with their number of occurrences as weight."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((found, owner))
    o, f = owner[order], found[order]
    new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)
    return np.searchsorted(o[new], np.arange(len(offsets))), f[new], np.diff(np.append(new, len(f))).astype(float)


def signatures(docs: DataFrame, counted: bool = False) -> DataFrame:
    """(_row, doc_id, node, bands, sig) per row: MD5 of the text, band keys, one byte per coordinate; null without words.

    By default every shingle of a text weighs 1; with ``counted`` it weighs its number of occurrences.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, sigs = [None] * batch.num_rows, [None] * batch.num_rows
            for i, texts in slices(batch.column("text")):
                for numbers, offsets, hashes in hashed_words(texts):
                    offsets, found = shingles(offsets, hashes)
                    prints = dart_minhash(*weighted_shingles(offsets, found)) if counted else dart_minhash(offsets, found)
                    keys = np.zeros((len(prints), BANDS), np.uint64)
                    for j in range(PER_BAND):
                        keys = mixed(keys + prints[:, j::PER_BAND].astype(np.uint64), j)
                    keys = mixed(keys + np.arange(BANDS, dtype=np.uint64), 9).view(np.int64)
                    small = prints.astype(np.uint8)
                    for t in np.flatnonzero(np.diff(offsets)):
                        bands[i + numbers[t]], sigs[i + numbers[t]] = keys[t], small[t].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("doc_id"), batch.column("node"), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                [ROW, "doc_id", "node", "bands", "sig"])

    node = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return numbered(docs.select("doc_id", "text")).withColumn("node", node).mapInArrow(
        tidy(sign), f"{ROW} long, doc_id long, node binary, bands array<long>, sig binary")


def shingle_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(_row, found): the sorted unique shingles (uint32) of the rows numbered in ``rows``, from a second scan of the texts.

    A Bloom filter of the wanted numbers goes to the scan, so other texts are neither shingled nor shuffled; it is
    tested in the worker that shingles, to keep a task at one Python process.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bloom.build(rows, bloom.words_for(rows.count())))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.holds(wanted.value, batch.column(ROW).to_numpy().view(np.uint64))))
            for i, texts in slices(batch.column("text")):
                for numbers, offsets, hashes in hashed_words(texts):
                    offsets, found = shingles(offsets, hashes)
                    found = (found >> np.uint64(32)).astype(np.uint32)
                    sets = [np.unique(found[offsets[t]:offsets[t + 1]]).tobytes() for t in range(len(numbers))]
                    yield pa.RecordBatch.from_arrays([batch.column(ROW).take(pa.array(i + numbers)), pa.array(sets, pa.binary())], [ROW, "found"])

    return numbered(docs.select("text")).select(ROW, "text").mapInArrow(tidy(gather), f"{ROW} long, found binary")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * SIMILAR[1] < max(len(a), len(b)) * SIMILAR[0]:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * SIMILAR[1] >= (len(both) - common) * SIMILAR[0]


@F.pandas_udf(BooleanType())
def _linked(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_alike(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) for a, b in zip(left, right)], dtype=bool)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pinned ``pairs`` (a, b) whose shingle sets are similar. ``b`` is the side that may recur in very many pairs."""
    rows = pin(pairs.select(F.col("a").alias(ROW)).union(pairs.select("b")).distinct())
    sets = shingle_sets(docs, rows)
    left = pairs.join(sets.select(F.col(ROW).alias("a"), F.col("found").alias("left")), "a")
    both = left.join(sets.select(F.col(ROW).alias("b"), F.col("found").alias("right")), "b")
    return pin(both.where(_linked("left", "right")).select("a", "b"))


def _cross_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between different components among two chunks of a bucket; enough of them to join what belongs together.

    Signatures tell which pairs are plausible. Such a pair is checked exactly unless an earlier link has joined its
    components, and only in the first band that both texts share.
    """
    band = group["band"].iloc[0]
    label = group["label"].to_numpy()
    names, comp = np.unique(label, return_inverse=True)
    sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), K)
    keys = np.stack(group["bands"].to_numpy())
    found = [np.frombuffer(x, np.uint32) for x in group["found"]]
    rows, side = group[ROW].to_numpy(), group["side"].to_numpy()
    parent = list(range(len(names)))
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    right = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        others = right if len(right) else np.arange(x + 1, len(group))
        others = others[comp[others] != comp[x]]
        if not len(others):
            continue
        same = (sig[others] == sig[x]).sum(axis=1)
        for at in np.argsort(-same, kind="stable"):
            if same[at] < PLAUSIBLE * K:
                break
            y = others[at]
            if root(comp[x]) == root(comp[y]) or keys[x][np.argmax(keys[x] == keys[y])] != band:
                continue
            if _alike(found[x], found[y]):
                parent[root(comp[x])] = root(comp[y])
                out.append((rows[x], rows[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def near_duplicates(docs: DataFrame, counted: bool = False) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, class_id (smallest doc_id of its class), class_row (the
    row that has it).

    Two texts are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or more; classes are
    the connected components. A text of under five words is one shingle; texts without words (and nulls) are linked with
    equal texts only. Equal texts share a class; a class of null doc_ids only has a null class_id. ``docs`` is a table
    scan with doc_id (long, may repeat) and text; other columns are not read. An empty table gives an empty result.

    Links are searched in two rounds, none of which lists the pairs of a bucket. First every text is checked against the
    one member of its buckets that has most company there, often the original of a group of copies. Then tasks compare the
    members of different components in buckets that still hold several, and give out only links that join components.
    """
    signed = pin(signatures(docs, counted))
    total = signed.count()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    texts = pin(signed.groupBy("node").agg(first, F.count("*").alias("n"))
                .select("node", "n", F.col(f"first.{ROW}").alias("rep"), F.col("first.doc_id").alias("first_id")))
    firsts = signed.where("bands IS NOT NULL").join(texts.select(F.col("rep").alias(ROW)), ROW, "left_semi")
    firsts = pin(firsts.select(ROW, "bands", "sig"))
    buckets = pin(firsts.select(F.explode("bands").alias("band"), ROW))
    sizes = pin(buckets.groupBy("band").agg(F.max(ROW).alias("last"), F.min(ROW).alias("first"), F.count("*").alias("n")).where("n > 1"))
    member = pin(buckets.join(sizes.select("band", "n"), "band"))
    company = pin(member.groupBy(ROW).agg(F.sum("n").alias("company")))
    hubs = pin(member.join(company, ROW).groupBy("band").agg(F.max(F.struct("company", ROW)).alias("hub")))
    stars = member.join(hubs, "band").groupBy(F.col(ROW).alias("a")).agg(F.max("hub").alias("hub"))
    stars = pin(stars.select("a", F.col(f"hub.{ROW}").alias("b")).where("a <> b"))
    edges = verified(docs, stars)
    labels = components(edges)

    member = member.join(labels.withColumnRenamed("node", ROW), ROW, "left").withColumn("label", F.coalesce("label", ROW))
    member = pin(member.select("band", "n", ROW, "label"))
    impure = pin(member.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band"))
    two = sizes.where("n = 2").join(impure, "band").select(F.col("last").alias("a"), F.col("first").alias("b")).distinct()
    two = pin(two.join(stars, ["a", "b"], "left_anti").join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))

    member = pin(member.where("n > 2").join(impure, "band"))
    sets = pin(shingle_sets(docs, pin(member.select(ROW).distinct())))
    loads = pin(member.join(sets.select(ROW, F.length("found").alias("bytes")), ROW).groupBy("band")
                .agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks")))
    spread = member.join(loads, "band").withColumn("own", F.pmod(F.xxhash64(ROW), "chunks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                           (F.col("own") > F.col("other")).cast("int").alias("side"), ROW, "label")
    spread = spread.join(sets, ROW).join(firsts, ROW)
    links = pin(spread.groupBy("band", "i", "j").applyInPandas(_cross_links, "a long, b long"))
    more = edges.unionByName(links)
    if not two.isEmpty():
        more = more.unionByName(verified(docs, two))
    labels = components(more)

    classes = pin(texts.join(labels, texts["rep"] == labels["node"], "left")
                  .select(texts["node"], "n", "rep", "first_id", F.coalesce("label", "rep").alias("label")))
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "rep")).alias("first")
    ids = pin(classes.groupBy("label").agg(first, F.count("*").alias("texts"))
              .select("label", "texts", F.col("first.first_id").alias("class_id"), F.col("first.rep").alias("class_row")))
    classes = pin(attach(classes, ids, "label", "texts", total).select("node", "n", "class_id", "class_row"))
    return attach(signed.select(ROW, "doc_id", "node"), classes, "node", "n", total).select(ROW, "doc_id", "class_id", "class_row")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class of near-duplicates, all columns kept."""
    dropped = pin(near_duplicates(docs).where(F.col(ROW) != F.col("class_row")).select(ROW))
    return bloom.without(docs, dropped)
