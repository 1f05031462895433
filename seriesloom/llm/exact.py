"""Exact deduplication: a two-pass Bloom filter finds hashes that may repeat, only those rows are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesloom.lineage import pin
from seriesloom.llm import bloom
from seriesloom.llm.common import ROW, attach, numbered

SPACE = " \t\n\x0b\x0c\r"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, n_chars, sha, h) of every row: SHA-256 of the text without white space, code points of the text."""
    text = F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(F.translate(text, SPACE, "").cast("binary"), 256))
    return (numbered(docs.select("doc_id", "text"))
            .select(ROW, "doc_id", F.length(text).cast("long").alias("n_chars"), sha.alias("sha"))
            .withColumn("h", F.xxhash64("sha")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, keep_id, group_size, kept, sha.

    ``docs`` is a table scan with ``doc_id`` (long) and ``text``; other columns, whatever their names, are not read.
    Texts are equal when identical without ASCII white space; null is the empty text, so all empty texts form one
    group. The row with the most code points stays, then the smallest doc_id (null last), then the first row, so of
    fully identical rows exactly one is kept. An empty table gives an empty result.
    """
    rows = pin(fingerprints(docs))
    total = rows.count()
    filter_ = bloom.build(rows.select("h"), bloom.words_for(total), repeated=True)
    marked = rows.withColumn("maybe", bloom.passes(docs.sparkSession, filter_, F.col("h")))
    alone = marked.where("not maybe").select(
        ROW, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = pin(marked.where("maybe").drop("maybe", "h"))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", ROW))
    groups = pin(maybe.groupBy("sha").agg(F.count("*").alias("group_size"), best.alias("best"))
                 .select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col(f"best.{ROW}").alias("keep_row")))
    together = attach(maybe, groups, "sha", "group_size", total).select(
        ROW, "doc_id", "keep_id", "group_size", (F.col(ROW) == F.col("keep_row")).alias("kept"), "sha")
    return alone.unionByName(together)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns kept."""
    dropped = pin(exact_groups(docs).where("not kept").select(ROW))
    return bloom.without(docs, dropped)
