"""Order-preserving packing of tokenised documents into sequences of at most 2048 tokens.

Each task packs the documents of its input partition in their order, so nothing is shuffled. A dynamic program over the
ends of documents and sentences chooses the cuts with the least padding plus penalties for documents that a cut divides;
the best predecessor within reach comes from a monotone queue.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seriesloom.llm.memory import tidy

LENGTH = 2048
END = 1                           # id that closes a document
SENTENCE, INSIDE = 4, 12          # padding tokens that a cut after a sentence, or inside one, is worth avoiding
STRETCH = 32                      # a stretch without sentence ends may be cut at such steps
CHUNK = 1 << 18                   # tokens planned together; the last open sequence goes on in the next chunk
CACHED = 1 << 20                  # words whose ids a worker remembers by default
SLICE = 1 << 20                   # code points of a text split at a time


def _sentence_ends(tokenizer) -> np.ndarray:
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 2, bool)
    for token, i in vocab.items():
        ends[i] = token.endswith("</w>") and token[:-4].rstrip("\"')").endswith((".", "!", "?"))
    return ends


def _byte_signs() -> dict[int, str]:
    """Latin-1 letters as the signs that stand for their UTF-8 bytes in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in range(128, 256)}


_AS_BYTES = _byte_signs()


def _stretches(flat: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` from start[i] to start[i + 1] for every i of ``at``, joined, and their offsets."""
    first, count = start[at], start[at + 1] - start[at]
    offsets = np.append(0, np.cumsum(count))
    return flat[np.repeat(first - offsets[:-1], count) + np.arange(offsets[-1])], offsets


class Encoder:
    """Token ids of whole texts, word by word with a cache: this tokenizer's tokens never span a space or a line feed."""

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer
        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.ends = _sentence_ends(self.tokenizer)
        self.tails = {t: array("I", self.tokenizer.encode(t, add_special_tokens=False).ids) for t in ("", ",", ".")}
        self.known, self.asked = {}, np.zeros(0, np.int64)      # a word's number, how often a number was asked for
        self.ids, self.start = array("I"), array("q", [0])

    def forget(self) -> None:
        """All words but the half of ``cached`` that were asked for most often, and at least twice."""
        kept = np.argsort(-self.asked, kind="stable")[:self.cached // 2]
        kept = np.sort(kept[self.asked[kept] > 1])
        words = list(self.known)
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.ids, np.uint32)
        ids, offsets = _stretches(flat, start, kept)
        self.known = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.asked = self.asked[kept] // 2
        self.ids, self.start = array("I", ids.tobytes()), array("q", offsets.astype(np.int64).tobytes())

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids with a closing END per text; null is empty."""
        parts: list[list[np.ndarray]] = []
        words: list[str] = []
        bounds: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal words, bounds, size
            if words:
                ids, offsets = self._ids(words)
                at = 0
                for owner, n in bounds:
                    parts[owner].append(ids[offsets[at]:offsets[at + n]])
                    at += n
            words, bounds, size = [], [], 0

        for i, text in enumerate(texts):
            parts.append([])
            at, text = 0, text if isinstance(text, str) else ""
            while at < len(text):
                end = len(text)
                if end - at > SLICE:
                    space = min((x for x in (text.find(" ", at + SLICE), text.find("\n", at + SLICE)) if x >= 0), default=end)
                    end = space
                found = text[at:end].replace("\n", " ").split(" ")
                words += found
                bounds.append((i, len(found)))
                size, at = size + end - at, end
                if size >= SLICE:
                    flush()
        flush()
        end = np.array([END], np.uint32)
        return [np.concatenate([*p, end]) for p in parts]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.cached:
            self.forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [words[i] for i in missing]
            self._learn(list(dict.fromkeys(unknown)))
            at[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        asked = np.bincount(at, minlength=len(self.known))
        asked[:len(self.asked)] += self.asked
        self.asked = asked
        return _stretches(np.frombuffer(self.ids, np.uint32), np.frombuffer(self.start, np.int64), at)

    def _learn(self, words: list[str]) -> None:
        """A word of Latin-1 letters is one piece of the model, in lower case; a comma or full stop behind it is a token of its own.

        All other words take the tokenizer's whole way.
        """
        tokenize, known = self.tokenizer.model.tokenize, self.known
        other = []
        for word in words:
            stem = word[:-1] if word[-1:] in (",", ".") else word
            if not (stem.isalpha() and (stem.isascii() or max(stem) <= "\xff")):
                other.append(word)
                continue
            tail, stem = word[len(stem):], stem.lower()
            at = known.get(stem)
            if at is None:
                piece = stem if stem.isascii() else stem.translate(_AS_BYTES)
                ids = array("I", [t.id for t in tokenize(piece)])
                if tail or word != stem:
                    self._add(stem, ids)
            else:
                ids = self.ids[self.start[at]:self.start[at + 1]]
            if word not in known:
                self._add(word, ids + self.tails[tail])
        for i in range(0, len(other), 4096):
            some = other[i:i + 4096]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self._add(word, found.ids)

    def _add(self, word: str, ids) -> None:
        self.known[word] = len(self.known)
        self.ids.extend(ids)
        self.start.append(len(self.ids))


@cache
def _encoder(path: str, cached: int) -> Encoder:
    return Encoder(path, cached)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions after which a cut is allowed, with the penalty of each; gaps over STRETCH are filled in its steps."""
    allowed = ends[ids]
    allowed[doc_ends - 1] = True
    at = np.flatnonzero(allowed) + 1
    gap = np.diff(np.append(0, at))
    extra = [np.arange(at[i] - gap[i] + STRETCH, at[i], STRETCH) for i in np.flatnonzero(gap > STRETCH)]
    every = np.sort(np.concatenate([at, *extra]).astype(np.int64))
    penalty = np.full(len(ids) + 1, INSIDE, np.int64)
    penalty[at] = SENTENCE
    penalty[doc_ends] = 0
    return every.tolist(), penalty[every].tolist()


def best_cuts(at: list[int], penalty: list[int], last: bool) -> list[int]:
    """The cuts of a least-cost division into windows of at most LENGTH; a window costs its padding and its end's penalty.

    The final window may be any start of a later sequence, so it costs nothing: the result ends within LENGTH of the
    end. With ``last``, what remains is cut at powers of two, which need no padding.
    """
    if not at:
        return []
    cost, back = [0], [-1]                       # over 0 and the candidates
    spots = [0, *at]
    queue = deque([0])                           # indexes with rising cost + position
    value = [0]
    for j in range(1, len(spots)):
        here = spots[j]
        while here - spots[queue[0]] > LENGTH:
            queue.popleft()
        i = queue[0]
        total = value[i] + LENGTH - here + penalty[j - 1]
        cost.append(total)
        back.append(i)
        total += here
        value.append(total)
        while queue and value[queue[-1]] >= total:
            queue.pop()
        queue.append(j)
    j, best = len(spots) - 1, None
    for i in range(len(spots) - 1, -1, -1):
        if spots[-1] - spots[i] >= LENGTH:
            break
        if best is None or cost[i] < cost[best]:
            best = i
    cuts, j = [], best
    while j > 0:
        cuts.append(spots[j])
        j = back[j]
    cuts.reverse()
    if last:
        here, rest = (cuts[-1] if cuts else 0), spots[-1] - (cuts[-1] if cuts else 0)
        for power in range(LENGTH.bit_length() - 1, -1, -1):
            if rest >> power & 1:
                here += 1 << power
                cuts.append(here)
    return cuts


def pack(docs: DataFrame, tokenizer_path: str, cached: int = CACHED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are not read. A document is its ids and END, so null and empty texts
    are one token; every row is packed, also repeated ones. Every id lies in exactly one piece; sequences are gapless
    and hold 2048 tokens, or less with padding, or a power of two. An empty table gives an empty result. Every Python
    worker remembers the ids of about ``cached`` words (200 bytes each); fewer cost time, not results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, cached)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[object, int, int, np.ndarray]] = []       # doc_id, ids before, ids of the document, ids
        size = 0

        def plan(last: bool) -> pa.RecordBatch:
            nonlocal held, size, sequence
            ids = np.concatenate([h[3] for h in held])
            doc_end = np.cumsum([len(h[3]) for h in held])
            cuts = np.array(best_cuts(*candidates(ids, doc_end, encoder.ends), last), np.int64)
            to = int(cuts[-1]) if len(cuts) else 0
            points = np.unique(np.concatenate(([0], cuts, doc_end[doc_end < to])))
            begin, end = points[:-1], points[1:]
            doc = np.searchsorted(doc_end, begin, side="right")
            doc_begin = np.append(0, doc_end)[doc]
            window = np.searchsorted(cuts, begin, side="right")
            window_begin = np.append(0, cuts)[window]
            before = np.array([h[1] for h in held], np.int64)[doc]
            columns = [pa.array([held[d][0] for d in doc], pa.int64()), pa.array(begin - doc_begin + before, pa.int64()),
                       pa.array(end - begin, pa.int64()),
                       pa.array([zlib.crc32(ids[b:e].astype("<u4").tobytes()) for b, e in zip(begin, end)], pa.int64()),
                       pa.array(np.array([h[2] for h in held], np.int64)[doc], pa.int64()),
                       pa.array(sequence + window, pa.int64()), pa.array(begin - window_begin, pa.int64())]
            sequence += len(cuts)
            d = int(np.searchsorted(doc_end, to, side="right"))
            if d < len(held):
                cut = to - int(np.append(0, doc_end)[d])
                doc_id, ahead, n, own = held[d]
                held = [(doc_id, ahead + cut, n, own[cut:]), *held[d + 1:]]
            else:
                held = []
            size = sum(len(h[3]) for h in held)
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    held.append((doc_id, 0, len(ids), ids))
                    size += len(ids)
                    if size >= CHUNK:
                        yield plan(False)
        if held:
            yield plan(True)

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
