"""Mixing sources to target weights by hash thresholds, without sorting.

Every document has a 60-bit hash of its id and text. Copy k of a source's documents goes to those whose hash lies below
the source's k-th threshold; thresholds fall with k, so the copies are nested. A threshold comes from sums of words by
(source, hash bucket): whole buckets below the budget are in, and only the boundary bucket is refined, ten bits at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.lineage import pin
from seriesloom.llm.common import fresh

WEIGHTS = (5, 2, 1)               # of the sources in order, repeating
TOTAL = 1.5                       # times all words of the input
MOST = 2                          # times a source's words, and so copies of a document
BITS, DIGIT = 60, 10
SMALL = 100_000                   # so many sources are broadcast; more are joined by shuffle


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - BITS)


def _with_sources(rows: DataFrame, sources: DataFrame, many: bool, how: str = "inner") -> DataFrame:
    """Null-safe join on source; source columns that are not needed should be dropped before."""
    other = sources.withColumnRenamed("source", "_of")
    return rows.join(other if many else F.broadcast(other), rows["source"].eqNullSafe(other["_of"]), how).drop("_of")


def _weighted(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` by rank in code point order, null last; the ranks come from a range partitioning, not from one task."""
    ordered = pin(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    before, firsts = 0, {}
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):      # one row per partition
        firsts[r["part"]], before = before, before + r["count"]
    first = F.lit(0).cast("long")
    if firsts:
        first = F.create_map(*[F.lit(x).cast("long") for pair in firsts.items() for x in pair])[part]
    rank = first + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.array(*map(F.lit, WEIGHTS))[(rank % len(WEIGHTS)).cast("int")]
    return pin(ordered.withColumn("weight", weight).drop("_id"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, weight) with ``target``: TOTAL of all words shared by weight, at most MOST times a source's size.

    What a source cannot take is shared again by weight until no target exceeds its limit. That raises one common level
    per unit of weight; each round is one aggregate that returns one row.
    """
    limit = F.col("source_size") * MOST
    level = 0.0
    while True:
        over = F.lit(level) * F.col("weight") > limit
        total, fixed, free = sources.agg(F.sum("source_size"), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            break
        level, old = (TOTAL * total - (fixed or 0)) / free, level
        if level <= old:
            break
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit.cast("double")))


def thresholds(rows: DataFrame, budgets: DataFrame, many: bool) -> DataFrame:
    """(source, k, threshold) for ``budgets`` (source, k, budget): words of rows below the threshold come nearest to the budget.

    ``rows`` is pinned (source, size, h). Rows of equal hash, that is equal id and text, stay together.
    """
    open_ = budgets.withColumn("prefix", F.lit(0).cast("long"))
    done = None
    for bits in range(BITS - DIGIT, -1, -DIGIT):
        inside = _with_sources(rows, open_, many).where(F.shiftright("h", bits + DIGIT) == F.col("prefix"))
        sums = inside.groupBy("source", "k", "budget", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        order = Window.partitionBy("source", "k").orderBy("bucket")
        upto = sums.withColumn("upto", F.sum("words").over(order))
        edge = upto.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
        rest = F.col("budget") - (F.col("upto") - F.col("words"))
        edge = pin(edge.select("source", "k", rest.alias("budget"), F.col("bucket").alias("prefix"), "words", "n"))
        ended = edge if bits == 0 else edge.where("n = 1")
        above = (F.col("budget") * 2 >= F.col("words")).cast("long")
        ended = ended.select("source", "k", F.shiftleft(F.col("prefix") + above, bits).alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        open_ = edge.where("n > 1").select("source", "k", "budget", "prefix")
        if open_.isEmpty():
            break
    return done


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, sources, many): pinned (doc_id, source, size, h); per source its size, target and thresholds t1, t2, ...

    ``docs`` needs doc_id, source and text; other columns are not read. A null text has no words; null is a source of its
    own. A source without words has target 0 and no copies. Rows with equal id and text are taken together.
    """
    rows = pin(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h")))
    sources = pin(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    many = sources.count() > SMALL
    sources = pin(targets(_weighted(sources)))
    budget = F.least(F.greatest(F.col("target") - (F.col("k") - 1) * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double"))
    budgets = pin(sources.select("source", "source_size", "target", F.explode(F.sequence(F.lit(1), F.lit(MOST))).alias("k")).withColumn("budget", budget))
    whole = budgets.where("budget >= source_size OR budget = 0").select(
        "source", "k", F.when(F.col("budget") > 0, F.lit(1 << BITS)).otherwise(F.lit(0)).cast("long").alias("threshold"))
    partial = budgets.where("budget < source_size AND budget > 0").select("source", "k", "budget")
    found = thresholds(rows, partial, many).unionByName(whole)
    by_k = [F.max(F.when(F.col("k") == k, F.col("threshold"))).alias(f"t{k}") for k in range(1, MOST + 1)]
    found = found.groupBy(F.col("source").alias("_of")).agg(*by_k)
    sources = pin(sources.join(found, sources["source"].eqNullSafe(found["_of"]), "left").drop("_of").na.fill(0, [f"t{k}" for k in range(1, MOST + 1)]))
    return rows, sources, many


def _copies(h: Column) -> Column:
    return sum(((h < F.col(f"t{k}")).cast("int") for k in range(1, MOST + 1)), F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row; see ``plan`` for nulls and ties. Empty gives empty."""
    rows, sources, many = plan(docs)
    out = _with_sources(rows, sources, many).withColumn("copies", _copies(F.col("h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns kept."""
    _, sources, many = plan(docs)
    h, of, n = fresh(docs, "_h"), fresh(docs, "_of"), fresh(docs, "_n")
    ts = [(f"t{k}", fresh(docs, f"_t{k}")) for k in range(1, MOST + 1)]
    other = sources.select(F.col("source").alias(of), *[F.col(a).alias(b) for a, b in ts])
    marked = docs.withColumn(h, hash_of(F.col("doc_id"), F.col("text")))
    marked = marked.join(other if many else F.broadcast(other), marked["source"].eqNullSafe(other[of]))
    copies = sum(((F.col(h) < F.col(b)).cast("int") for _, b in ts), F.lit(0))
    return marked.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies))).select(docs.columns)
