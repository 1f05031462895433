"""Language identification: multinomial naive Bayes over hashed character n-grams.

The training counts are one aggregation over all labelled rows. The log-probability matrix (buckets x languages) is
broadcast; it has at most ``MAX_CELLS`` cells. A batch of texts is a sparse count matrix times that matrix: gather and sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.llm.common import fresh
from seriesloom.llm.memory import give_back, tidy

BUCKETS = 1 << 15                 # hashed n-grams, all orders together
MAX_CELLS = 1 << 22               # buckets are halved until buckets x languages fit
ALPHA = 0.5                       # added to every count
EVIDENCE = 60                     # a score speaks for so many n-grams at most, else all long texts score 1
BLOCK = 1 << 18                   # code points handled at a time
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(texts: list) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of about BLOCK code points: (number of the text, piece of it). Long texts are cut at white space if there is any, else as if a word ended."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            if end < len(text):
                space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                end = space + 1 if space >= at else end
            part = text[at:end].lower()
            owners.append(i)
            parts.append(part)
            size, at = size + len(part), end
            if size >= BLOCK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def _scramble(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int32)


def grams(texts: list, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of texts, start of each one's n-grams, buckets of shape (3, n)) by block.

    The n-grams are the letters of lower-cased words, letter pairs, and triples around a letter; a word's ends count
    as one boundary sign, n-grams never cross words.
    """
    letters = _letters()
    for owners, parts in _pieces(texts):
        codes = np.frombuffer(("\0" + "\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), sizes)
        letter = letters[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        c = np.where(letter, codes, np.uint32(32))[keep]
        at = np.flatnonzero(letter[keep])
        if not len(at):
            continue
        of = np.append(0, owner)[keep][at]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        me, before, after = c[at], c[at - 1], c[at + 1]
        one = me * np.uint32(0x85EBCA6B)
        two = me * np.uint32(0xC2B2AE35) + after * np.uint32(0x27D4EB2F) + np.uint32(1)
        three = before * np.uint32(0x165667B1) + me * np.uint32(0x9E3779B1) + after * np.uint32(0x85EBCA77) + np.uint32(2)
        yield np.asarray(owners)[of[first]], first, np.stack([_scramble(h, buckets) for h in (one, two, three)])


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray             # log share of each language's documents
    weights: np.ndarray           # (buckets, languages) log probabilities, float32

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """A learned language and a score from 0 to 1 per text; ``und`` and 0 without letters or without a trained language.

        The score is the winner's posterior when the text's mean evidence per n-gram is that of EVIDENCE n-grams at most.
        """
        total = np.zeros((len(texts), max(1, len(self.langs))))
        seen = np.zeros(len(texts))
        for of, first, hashed in grams(texts, len(self.weights)):
            for h in hashed:
                np.add.at(total, of, np.add.reduceat(self.weights[h], first, axis=0))
            np.add.at(seen, of, len(hashed) * np.diff(np.append(first, hashed.shape[1])))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = np.argmax(total + self.prior, axis=1)
        eased = total * np.minimum(1, EVIDENCE / np.maximum(seen, 1))[:, None] + self.prior
        odds = np.exp(eased - eased.max(axis=1, keepdims=True))
        score = (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(texts)), best]
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, seen)], np.where(seen > 0, score, 0.0)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents by the CRC of doc_id as text; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(labelled: DataFrame) -> Model:
    """Learn from every row of ``labelled`` (text, lang) whose lang is not null.

    Texts that are null or have no letters add to the prior only. Ties in prediction go to the language that sorts
    first. The driver gets (language, bucket) counts: at most MAX_CELLS rows; over MAX_CELLS / 256 languages is an error.
    """
    labelled = labelled.where("lang IS NOT NULL").select("lang", "text")
    docs = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_CELLS // 256 + 1).collect()}
    if len(docs) > MAX_CELLS // 256:
        raise ValueError(f"more than {MAX_CELLS // 256} languages")
    langs, buckets = sorted(docs), BUCKETS
    while buckets * len(langs) > MAX_CELLS:
        buckets //= 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {lang: i for i, lang in enumerate(langs)}
        total = np.zeros(len(langs) * buckets, np.int64)
        for batch in batches:
            of_row = batch["lang"].map(number).to_numpy()
            for of, first, hashed in grams(batch["text"].tolist(), buckets):
                base = np.repeat(of_row[of] * buckets, np.diff(np.append(first, hashed.shape[1])))
                for h in hashed:
                    total += np.bincount(base + h, minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    counts = np.zeros((len(langs), buckets))
    if langs:
        cells = labelled.mapInPandas(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts.reshape(-1)[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=float)
    share = (counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * buckets)
    prior = np.log(np.array([docs[x] for x in langs], float) / max(1, sum(docs.values())))
    return Model(langs, prior, np.ascontiguousarray(np.log(share).T.astype(np.float32)))


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct column (lang, score) of a text column, by the broadcast model."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})
        give_back()

    return predict(text)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``, learned from its rows that are not held out.

    Needs doc_id, text and lang; other columns are not read. Predictions read the text alone. An empty table, or one
    without any lang, gives ``und`` with score 0 for every row.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(docs.sparkSession, model, F.col("text")).alias("_p"))
            .select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")))


def in_known_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without texts of no letters and those whose score is below ``least``: no learned language fits them."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    p = fresh(docs, "_p")
    marked = docs.withColumn(p, predicted(docs.sparkSession, model, F.col("text")))
    return marked.where((F.col(f"{p}.lang") != UNKNOWN) & (F.col(f"{p}.score") >= least)).select(docs.columns)
