"""URL filters by a Bloom filter cascade: exact membership for every key that the corpus can ask about, without joins.

The key universe is everything that the urls at hand can be looked up by. Level one encodes the listed keys; level two
encodes the universe's false positives of level one; level three the listed keys that level two wrongly passes; and so
on until nobody is wrong. The first level that rejects a key then tells whether it is listed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.lineage import pin
from seriesloom.llm import bloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1_000_000             # more rules would make filters of more than 32 MB a level


@dataclass
class Cascade:
    levels: list                  # odd ones (first, third, ...) hold listed keys, even ones the wrongly passed others

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Is each key (of the universe) listed?"""
        listed = np.full(len(keys), len(self.levels) % 2 == 1)
        open_ = np.ones(len(keys), bool)
        for i, level in enumerate(self.levels):
            fails = open_ & ~bloom.holds(level, keys, salt=i)
            listed[fails] = i % 2 == 1
            open_ &= ~fails
        return listed


def cascade(universe: DataFrame) -> Cascade:
    """From pinned (key long, listed boolean), one row per key. The levels shrink by about the false-positive rate each."""
    spark, levels = universe.sparkSession, []
    mine, others = universe.where("listed").select("key"), universe.where("not listed").select("key")
    while True:
        n = mine.count()
        if not n:
            return Cascade(levels)
        level = len(levels)
        filter_ = bloom.build(mine, bloom.words_for(n, 16 if level == 0 else 12), salt=level)
        levels.append(filter_)
        mine, others = pin(others.where(bloom.passes(spark, filter_, F.col("key"), salt=level))), mine


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def lookups(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The rules that could fit: for each (labels, path length) in use, the host's last labels and the path's first signs."""
    labels = F.split(host, r"\.")
    tried = []
    for n, length in shapes:
        tail = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))
        fits = (F.size(labels) >= n) & (F.length(path) >= length)
        tried.append(F.when(fits, F.concat(tail, F.substring(path, 1, length) if length else F.lit(""))))
    return F.filter(F.array(*tried), lambda x: x.isNotNull()) if tried else F.array().cast("array<string>")


def _tagged(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Pinned (key, listed) for the universe of (name) in ``asked`` and ``listed``, each name once."""
    both = asked.select("name", F.lit(0).alias("x")).unionByName(listed.select("name", F.lit(1).alias("x")))
    return pin(both.groupBy(F.xxhash64("name").alias("key")).agg((F.max("x") == 1).alias("listed")))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url); other columns are not read.

    ``rules`` (host, path, verdict) with verdict block or allow; repeated rules with both verdicts block. A rule fits its
    host and all subdomains when the path starts with the rule's; of several the longest rule wins (then the longer host,
    then the first by code point). Without a rule the verdict is block for hosts in ``listed``
    (host), else allow. A url that is null or has no :// has an empty host and path, hence no rule. ``rules`` are at most
    MAX_RULES. Besides the filters, at most 32 MB a level, only the (labels, path length) shapes reach the driver.
    """
    spark = pages.sparkSession
    rules = rules.groupBy("host", "path").agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("allowed"))
    rules = pin(rules.select(F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "allowed"))
    if rules.count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    shapes = sorted((r["labels"], r["length"]) for r in rules.select("labels", "length").distinct().collect())
    urls = pages.select("page_id", "url").withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    urls = urls.withColumn("path", F.coalesce(path_of(F.col("url")), F.lit(""))).withColumn("tried", lookups(F.col("host"), F.col("path"), shapes))
    asked = urls.select(F.explode("tried").alias("name")).distinct()
    rules = rules.withColumnRenamed("rule", "name")
    blocks, allows = (cascade(_tagged(asked, rules.where(F.col("allowed") == x))) for x in (0, 1))
    hosts = cascade(_tagged(urls.select(F.col("host").alias("name")).distinct(), listed.select(F.col("host").alias("name"))))
    shared = spark.sparkContext.broadcast((blocks, allows, hosts))

    @F.pandas_udf("array<int>")
    def verdicts(keys: pd.Series) -> pd.Series:
        flat = np.concatenate([np.asarray(k, np.int64) for k in keys]) if len(keys) else np.zeros(0, np.int64)
        block, allow = (c(flat.view(np.uint64)) for c in shared.value[:2])
        found = np.where(block, 0, np.where(allow, 1, -1)).astype(np.int32)
        return pd.Series(np.split(found, np.cumsum([len(k) for k in keys])[:-1]) if len(keys) else [])

    @F.pandas_udf("boolean")
    def is_listed(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value[2](keys.to_numpy().astype(np.int64).view(np.uint64)))

    judged = urls.withColumn("said", verdicts(F.transform("tried", lambda x: F.xxhash64(x))))
    hits = F.filter(F.transform("tried", lambda rule, i: F.struct(-F.length(rule).alias("longest"), F.instr(rule, "/").alias("host"), rule.alias("rule"),
                                                                  F.get(F.col("said"), i).alias("said"))), lambda x: x["said"] >= 0)
    best = F.get(F.array_sort(hits), F.lit(0))
    judged = judged.withColumn("best", best).withColumn("bad", is_listed(F.xxhash64("host")))
    blocked = F.coalesce(F.col("best.said") == 0, F.col("bad"))
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"))
