"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the model can reach across, distinct stretches are laid end to end in flat numpy arrays of
symbols, and every round merges, in all of them at once, the best-ranked pair that each still has, leftmost first. Merged
symbols are compacted; a stretch leaves when none of its pairs is a piece.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.memory import tidy

SPACE = "▁"                  # what the model writes for a space
CACHED = 1 << 18                  # words whose ids a worker remembers by default
SLICE = 1 << 20                   # code points of a text cut into words at a time
LONGEST = 256                     # longer words are encoded each time they occur
ROWS = 256                        # texts of one output batch
NEVER = np.iinfo(np.int64).max

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6      # fixed values: kinds of pieces in a model file
BPE = 2                                                                     # fixed value: the model type


class Pieces:
    """The vocabulary of a model file as arrays: pairs with rank and result, characters, surfaces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        kinds = np.array([p.type for p in model.pieces])
        if (trained.model_type != BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces or np.isin(kinds, (USER_DEFINED, UNUSED)).any()):
            raise ValueError("only byte-pair models with byte fallback, plain normalisation and ordinary pieces are supported")
        self.prefix = rules.add_dummy_prefix
        self.size = len(kinds)
        names = [p.piece for p in model.pieces]
        normal = {names[i]: int(i) for i in np.flatnonzero(kinds == NORMAL)}
        self.bytes = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.bytes[int(names[i][3:5], 16)] = i
        self._rank(normal, [p.score for p in model.pieces])
        self._characters(normal)
        self._pairs(normal)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.words = not any(self.cut.search(name) for name in normal)     # no piece reaches into the next word
        unknown = trained.unk_surface or " ⁇ "
        surface = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else (unknown if k == UNKNOWN else n.replace(SPACE, " ")).encode()
                   for n, k in zip(names, kinds)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.append(0, np.cumsum([len(s) for s in surface]))
        self.is_byte, self.is_control = kinds == BYTE, kinds == CONTROL
        self.spaced = np.array([k == NORMAL and n.startswith(SPACE) for n, k in zip(names, kinds)])

    def _rank(self, normal: dict[str, int], scores: list[float]) -> None:
        """Better scores rank lower. ``alone`` marks pieces that a better-ranked, longer one may follow: such a merge can
        change what is best at once, so only one of a stretch is made in a round."""
        _, place = np.unique(-np.array(scores), return_inverse=True)
        self.rank = place.astype(np.int64)
        self.alone = np.zeros(self.size, bool)
        for name, i in normal.items():
            for n in range(1, len(name)):
                for part in (name[:n], name[n:]):
                    k = normal.get(part)
                    if k is not None and self.rank[i] <= self.rank[k]:
                        self.alone[k] = True

    def _characters(self, normal: dict[str, int]) -> None:
        """Symbols of single characters: their piece, or a number past all pieces if only longer pieces hold them."""
        found = sorted({c for name in normal for c in name})
        self.symbol_of = {c: normal.get(c, self.size + k) for k, c in enumerate(found)}
        self.char = np.array([ord(c) for c in found], np.int64)
        self.char_symbol = np.array([self.symbol_of[c] for c in found], np.int64)
        self.other = self.size + len(found)                                # a character in no piece
        self.bigrams = np.unique(np.array([ord(a) << 21 | ord(b) for name in normal for a, b in zip(name, name[1:])], np.int64))

    def _pairs(self, normal: dict[str, int]) -> None:
        self.base = self.other + 1
        keys, made = [], []
        for name, i in normal.items():
            for n in range(1, len(name)):
                a, b = name[:n], name[n:]
                left = self.symbol_of.get(a) if n == 1 else normal.get(a)
                right = self.symbol_of.get(b) if len(b) == 1 else normal.get(b)
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    made.append(i)
        order = np.argsort(keys)
        self.pair, self.pair_made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; NEVER where they make no piece."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        made = np.where(self.pair[at] == key, self.pair_made[at], -1)
        return np.where(made >= 0, self.rank[made], NEVER), made

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all words end to end, and where each word's begin."""
        n_chars = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        at = np.minimum(np.searchsorted(self.char, code), len(self.char) - 1)
        symbol = np.where(self.char[at] == code, self.char_symbol[at], self.other)
        opens = np.zeros(len(code), bool)                                   # first of a stretch that no piece reaches into
        both = code[:-1] << 21 | code[1:]
        spot = np.minimum(np.searchsorted(self.bigrams, both), len(self.bigrams) - 1)
        opens[1:] = self.bigrams[spot] != both
        first = np.append(0, np.cumsum(n_chars))[:-1]
        opens[first[n_chars > 0]] = True
        opens[0] = True
        self._rounds(symbol, opens)
        return self._ids(symbol, code, n_chars)

    def _rounds(self, symbol: np.ndarray, opens: np.ndarray) -> None:
        """Merge in place: a merged symbol stands at its first character, -1 at the others."""
        place, open_ = np.arange(len(symbol)), opens
        sym = symbol.copy()
        follows = np.append(~open_[1:], False)
        rank, made = np.full(len(sym), NEVER), np.full(len(sym), -1)
        i = np.flatnonzero(follows)
        rank[i], made[i] = self.look_up(sym[i], sym[i + 1])
        while True:
            starts = np.flatnonzero(open_)
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(sym)))
            live = least < NEVER
            if not live.all():                                              # stretches without a pair are done
                stay = np.repeat(live, length)
                done = ~stay
                symbol[place[done]] = sym[done]
                sym, place, open_, rank, made = sym[stay], place[stay], open_[stay], rank[stay], made[stay]
                if not len(sym):
                    return
                least, length = least[live], length[live]
                starts = np.flatnonzero(open_)
            hit = rank == np.repeat(least, length)
            run = hit & ~np.append(False, hit[:-1])                         # of overlapping hits every second one goes
            index = np.arange(len(sym))
            begun = np.maximum.accumulate(np.where(run, index, -1))
            hit &= (index - begun) % 2 == 0
            single = np.repeat(np.logical_or.reduceat(hit & self.alone[made], starts), length)
            if single.any():
                earliest = np.repeat(np.minimum.reduceat(np.where(hit, index, len(sym)), starts), length)
                hit &= ~single | (index == earliest)
            left = np.flatnonzero(hit)
            sym[left] = made[left]
            gone = np.zeros(len(sym), bool)
            gone[left + 1] = True
            symbol[place[left + 1]] = -1
            stay = ~gone
            new = np.cumsum(stay) - 1                                       # index after compaction
            sym, place, open_, rank, made = sym[stay], place[stay], open_[stay], rank[stay], made[stay]
            changed = new[left]
            changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            follows = np.append(~open_[1:], False)
            rank[changed], made[changed] = NEVER, -1
            changed = changed[follows[changed]]
            rank[changed], made[changed] = self.look_up(sym[changed], sym[changed + 1])

    def _ids(self, symbol: np.ndarray, code: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the bytes of their character."""
        spelled = symbol >= self.size
        width = np.where(symbol < 0, 0, 1)
        width[spelled] = 1 + (code[spelled] > 0x7F) + (code[spelled] > 0x7FF) + (code[spelled] > 0xFFFF)
        ends = np.cumsum(width)
        out = np.repeat(symbol, width).astype(np.int32)
        if spelled.any():
            raw = np.frombuffer("".join(map(chr, code[spelled])).encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(spelled, width)] = self.bytes[raw]
        bounds = np.append(0, np.cumsum(n_chars))
        return out, np.append(0, ends)[bounds]

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: control pieces vanish, bytes that are no UTF-8 become U+FFFD, the added first space goes."""
        if not len(ids):
            return ""
        start, n = self.surface_at[ids], self.surface_at[ids + 1] - self.surface_at[ids]
        ends = np.cumsum(n)
        raw = self.surface[np.repeat(start - ends + n, n) + np.arange(ends[-1])].tobytes()
        control = self.is_control[ids]
        shown = ids[~control][:1]
        strip = int(self.prefix and len(shown) > 0 and self.spaced[shown[0]])
        if not control.any():                                              # else bytes on both sides of one might join up
            try:
                return raw[strip:].decode()
            except UnicodeDecodeError:
                pass
        parts, edge = [], np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        bounds = np.concatenate(([0], edge, [len(ids)]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = raw[ends[a] - n[a]:ends[b - 1]]
            parts.append(_by_character(part) if self.is_byte[ids[a]] else part.decode())
        return "".join(parts)[strip:]


def _by_character(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder:
    """Ids of whole texts; words met before are looked up."""

    def __init__(self, path: str, cached: int = CACHED):
        self.pieces, self.cached = Pieces(path), cached
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.start = {}, array("i"), array("q", [0])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids per text; null is empty. Words of several texts are looked up and merged together."""
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
            text = SPACE + text if text and self.pieces.prefix else text or ""
            text, at = text.replace(" ", SPACE), 0
            while at < len(text):
                cut = self.pieces.cut.search(text, at + SLICE) if self.pieces.words and len(text) - at > SLICE else None
                end = cut.start() if cut else len(text)
                found = self.pieces.word.findall(text, at, end) if self.pieces.words else [text]
                words += found
                bounds.append((i, len(found)))
                size, at = size + end - at, end
                if size >= SLICE:
                    flush()
        flush()
        return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.int32), *p]) for p in parts]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word's begin."""
        if len(self.known) > self.cached or len(self.ids) > 8 * self.cached:
            self.forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        new = list(dict.fromkeys(words[i] for i in missing.tolist()))
        kept = [w for w in new if len(w) <= LONGEST]
        once = [w for w in new if len(w) > LONGEST]
        if kept:
            ids, offsets = self.pieces.merge(kept)
            n = len(self.known)
            self.known.update(zip(kept, range(n, n + len(kept))))
            self.start.frombytes((offsets[1:] + len(self.ids)).tobytes())
            self.ids.frombytes(ids.tobytes())
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.ids, np.int32)
        if once:
            ids, offsets = self.pieces.merge(once)
            start, flat = np.append(start, offsets[1:] + len(flat)), np.append(flat, ids)
        if new:
            places = dict(zip(once, range(len(self.known), len(self.known) + len(once))))
            at[missing] = [self.known.get(words[i], -1) if len(words[i]) <= LONGEST else places[words[i]] for i in missing.tolist()]
        first, n = start[at], start[at + 1] - start[at]
        ends = np.append(0, np.cumsum(n))
        return flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends


@cache
def _encoder(path: str, cached: int) -> Encoder:
    return Encoder(path, cached)


def encode(docs: DataFrame, model_path: str, cached: int = CACHED) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), decoded (the text that the ids spell).

    ``docs`` needs doc_id and text; other columns, whatever their names, are not read, and nothing is shuffled. Ids equal
    those of the sentencepiece library without begin and end marks or sampling. Null and empty texts have no ids and decode
    to the empty text; repeated rows are all encoded; an empty table gives an empty result. Texts of any length are cut
    into words a slice at a time; a word of n characters that no cut divides takes at most n rounds over what is left of
    it. Each Python worker remembers the ids of about ``cached`` words; fewer cost time, not results. Models with other
    normalisation, user-defined pieces or without byte fallback raise a ValueError. The file must be on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path, cached)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = encoder.encode(part.column("text").to_pylist())
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32())
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                decoded = pa.array([encoder.pieces.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat), decoded],
                                                 ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded string")
