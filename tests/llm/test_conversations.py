"""Conversation repair, prefix trie and SentencePiece against plain Python and the library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from seriesloom.functions import lanes
from seriesloom.llm import pieces, repair, trie
from seriesloom.llm.queries import model_path

SCHEMA = "conv_id long, turn int, role string, text string, _id int, depth int, step int, rows int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_rows(seed, n_convs, longest):
    r = random.Random(seed)
    rows = []
    for c in range(n_convs):
        conv = None if c == 7 else r.choice([c, c, 100 * (c % 4) + c % 5])
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, r.choice([turn, turn, turn + 3, None]), role, r.choice(["a.", "b", " \t", None, "Why? ", "c!\n", "", "é…", "x" * 5000]), 1, 2, 3, 4))
    return rows


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        if fate:
            out[conv] += [(turn, "user" if fate == 4 else role, text, k) for k in range(2 if fate == 3 else 1)]
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])) for c, v in out.items()}


def plain_repair(rows):
    """The least (cost, audit, lines) by a backward program over rows and states."""
    counts, kinds, seen = dict(blank=0, duplicate=0, truncated=0, illegal=0), [], set()
    for i, (_, role, text, _) in enumerate(rows):
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        if kind:
            counts[kind] += 1
        if bare:
            seen.add((role, text))
        kinds.append(kind)
        if i and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
            counts["illegal"] += 1
    given, allowed = dict(zip("_sua", "uuau")), ("_s", "_u", "su", "au", "ua")
    best = {"_": (0, "", ()), "a": (0, "", ()), "u": (5, "I", ("assistant:",)), "s": (10, "II", ("user:", "assistant:"))}
    names = {"u": "user", "a": "assistant"}

    def ahead(cost, letter, line, rest):
        return cost + rest[0], letter + rest[1], (*line, *rest[2])

    for (_, role, text, _), kind in zip(reversed(rows), reversed(kinds)):
        new = {}
        for q in "_sua":
            options = [ahead(2, "D", (), best[q])]
            if kind in ("", "truncated"):
                late = 5 * (kind == "truncated")
                options.append(ahead(1 + late, "R", (f"{names[given[q]]}:{text}",), best[given[q]]))
                if q + role[:1] in allowed:
                    options.append(ahead(late, "K", (f"{role}:{text}",), best[role[:1]]))
            new[q] = min(options)
        for _ in range(3):
            new = {q: min(v, ahead(5, "I", (names[given[q]] + ":",), new[given[q]])) for q, v in new.items()}
        best = new
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, lines = best["_"]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), cost, audit, sha("\n".join(lines)))


@pytest.mark.parametrize("chunk, lane", [(1024, 1_000_000), (5, 1_000_000), (3, 8)])
def test_repair_equals_plain_program(spark, monkeypatch, chunk, lane):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(lanes, "LANE_ROWS", lane)
    rows = random_rows(1, 120, 24) + [(5000, 0, "user", "kept", 0, 0, 0, 0)] * 40 + [(5001, t, "ua"[t % 2] + "x", f"t{t}.", 0, 0, 0, 0) for t in range(60)]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {c: plain_repair(v) for c, v in plain_damage(rows).items()}
    assert got == want


def test_repair_of_the_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(frame).collect()}
    assert got == {c: plain_repair(v) for c, v in plain_damage([tuple(r) for r in frame.collect()]).items()}


def test_tables_are_few_and_end_in_block_borders():
    known = repair.Tables()
    assert len(known.vectors) < 200
    text = "".join(random.Random(2).choice("012345678") for _ in range(37))
    block, at = known.blocks([text, "", text[:4]])
    cost = repair.END
    for symbol in reversed(text):
        cost = repair._before(cost, int(symbol))
    front, _ = known.backward(block, at, np.zeros(3))
    assert known.vectors[front[0]] == tuple(c - min(cost) for c in cost) and front[1] == 0


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        turns[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        built[c] = tuple((turns.get(c - c % 100, []) if h else [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    least = {p: min((c for c in v if c is not None), default=None) for p, v in members.items()}
    return sorted(((least[p], len(p), least[p[:-1]] if p else None, len(v), children[p], leaves[p], saved[p],
                    sha(",".join(str(c) for c in sorted(x for x in ends[p] if x is not None)))) for p, v in members.items()), key=str)


@pytest.mark.parametrize("lane, ends", [(1_000_000, 1 << 16), (9, 2)])
def test_trie_equals_plain_tries(spark, monkeypatch, lane, ends):
    monkeypatch.setattr(lanes, "LANE_ROWS", lane)
    monkeypatch.setattr(trie, "ENDS", ends)
    rows = random_rows(3, 150, 14) + [(c, t, "user", f"same {t}", 0, 0, 0, 0) for c in range(900, 960) for t in range(c % 3 + 3)]
    got = sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == plain_trie(rows)


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0 and trie.prefix_trie(none).count() == 0


def texts():
    r = random.Random(4)
    letters = "abcdeistnrhouäéçß ▁\n日本😀1290.,!<>_-"
    made = ["".join(r.choice(letters[:r.choice([3, 6, 12, len(letters)])]) for _ in range(r.randrange(60))) for _ in range(400)]
    return [None, "", " ", "  a  b ", "\n\n\t", "a" * 400, "▁▁ x▁y", "<s></s><unk><0x0A>", "\x00\x01", "ab" * 300, "the" * 1000, " " * 100 + "x" + " " * 37, *made,
            " ".join(made) * 3, "".join(r.choice("abcdefgh") for _ in range(30000))]


@pytest.mark.parametrize("size", [None, 50])
def test_pieces_equal_the_library(spark, monkeypatch, size):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    if size:
        monkeypatch.setattr(pieces, "SLICE", size)
    encoder, many = pieces.Encoder(model_path(), cached=size or pieces.CACHED), texts()
    for at in range(0, len(many), 30):
        for text, ids in zip(many[at:at + 30], encoder.encode(many[at:at + 30])):
            assert ids.tolist() == library.encode(text or "") and encoder.pieces.decode(ids) == library.decode(ids.tolist())


def test_decoding_any_ids():
    import sentencepiece
    library, own, r = sentencepiece.SentencePieceProcessor(model_file=model_path()), pieces.Pieces(model_path()), random.Random(6)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randrange(10))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_encoded_rows(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    many = texts()
    frame = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(many)], "doc_id long, text string, ids int")
    rows = {r["doc_id"] or 0: r for r in pieces.encode(frame.union(frame), model_path()).collect()}
    assert len(rows) == len(many)
    for i, t in enumerate(many):
        assert rows[i]["ids"] == library.encode(t or "") and rows[i]["decoded"] == library.decode(rows[i]["ids"])
    assert pieces.encode(frame.limit(0), model_path()).count() == 0
