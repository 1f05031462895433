"""Operators of the llm subpackage against brute force on small and awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriesloom.llm import audio, bwt, exact, language, licenses, minhash, mixing, packing, secrets, substrings, urls
from seriesloom.llm.queries import tokenizer_path

BODY = " ".join(f"w{i * 7919 % 1013}" for i in range(240))
LONG = " ".join(f"x{i * 31 % 9973}" for i in range(30000))
DOCS = [(1, BODY, "en", "a"), (2, BODY, "en", "a"), (3, BODY.replace("w0 ", "other ", 1), "en", None), (4, None, None, "b"), (5, "", "en", "b"),
        (6, "password = hunter22 AKIA" + "Z" * 16 + " deadbeefdeadbeefdeadbeef.", "en", "b"), (7, LONG, "de", "c"), (8, LONG + " tail", "de", "c"),
        (None, "no id here, three", "en", None), (9, "  \t\n ", None, "a"), (9, "same id", "en", "a"), (9, "same id", "en", "a"),
        (10, "Released under the MIT License. " + BODY[:600], "en", "d"), (11, "Ünïcödé über 😀 straße " * 8, "de", "d")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents")
    frame = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in DOCS], "doc_id long, text string, lang string, source string, _row int, _maybe int, h int, n int")
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(path)
    return spark.read.parquet(path)


def test_empty_tables(spark, empty):
    for frame in (secrets.scan(empty), minhash.near_duplicates(empty), mixing.mix(empty), substrings.remove_repeats(empty), language.identify(empty),
                  packing.pack(empty, tokenizer_path()), licenses.scan(empty), exact.exact_groups(empty), exact.deduplicate(empty),
                  minhash.deduplicate(empty), mixing.mixed_documents(empty), language.in_known_language(empty)):
        assert frame.count() == 0


def test_exact_groups(docs):
    rows = exact.exact_groups(docs).collect()
    squeezed = Counter(re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in DOCS)
    assert len(rows) == len(DOCS) and sum(r["kept"] for r in rows) == len(squeezed)
    assert sorted(r["group_size"] for r in rows) == sorted(squeezed[re.sub(r"[\x20\x09-\x0D]", "", t or "")] for _, t, *_ in DOCS)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(squeezed)


def test_near_duplicates(docs):
    ids = defaultdict(set)
    for r in minhash.near_duplicates(docs).collect():
        ids[r["class_id"]].add(r["doc_id"])
    assert {1, 2, 3} in ids.values() and {7, 8} in ids.values() and minhash.near_duplicates(docs).count() == len(DOCS)
    assert minhash.deduplicate(docs).columns == docs.columns


def test_dart_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    b[:200] = a[:200]
    weights = np.concatenate((np.full(300, 2.5), np.full(200, 1.25), np.full(100, 2.5)))
    sig = minhash.dart_minhash(np.array([0, 300, 600]), np.concatenate((a, b)), weights, k=2000)
    truth = 200 * 1.25 / (300 * 2.5 + 100 * 2.5)
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.04


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    size = defaultdict(int)
    for _, text, _, source in DOCS:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] + 1e-9
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    wanted = Counter()
    for r in rows:
        wanted[r["doc_id"]] += r["copies"]
    assert copies == +wanted


def test_repeated_substrings(docs):
    seen, want = set(), []
    order = sorted(range(len(DOCS)), key=lambda i: (DOCS[i][0] is None, DOCS[i][0] or 0))
    for i in order:
        data = (DOCS[i][1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(data[s:s + 100])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        want.append((str(DOCS[i][0]), len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)


def test_interleave_merge_equals_one_transform():
    texts = [b"banana", b"ananas", b"", b"bandana", b"nab", b"banana"]
    merged, _, common = bwt.merge([bwt.transform(texts[:2]), bwt.transform(texts[2:5]), bwt.transform(texts[5:])], 20)
    assert (merged == bwt.transform(texts)).all() and common.max() == 6


@pytest.mark.parametrize("width, depth", [(1, 3), (2, 2), (3, 2), (5, 1)])
def test_repeats_from_merged_block_transforms(width, depth):
    rng = np.random.default_rng(width)
    for _ in range(50):
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        raw, seen, want = b"".join(texts) + bytes(width - 1), set(), []
        codes = np.array([zlib.crc32(raw[i:i + width]) for i in range(len(raw) - width + 1)], np.int64)
        for text in texts:
            for i in range(len(text)):
                window = text[i:i + width * depth]
                whole = len(window) == width * depth
                want.append(whole and window in seen)
                seen.update([window] if whole else [])
        assert bwt.repeated(codes, np.array([len(t) for t in texts]), width, depth).tolist() == want


def test_repeats_between_many_tasks_and_lots(spark, tmp_path, monkeypatch):
    """One passage in every third text, overlapping repeats, ids out of order: many lots merged with what came before."""
    monkeypatch.setattr(substrings, "MERGED", 8)
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    passage, rows = words(60), []
    for i in rng.permutation(90).tolist():
        rows.append((i, words(20) + (passage[i % 7:] if i % 3 == 0 else "") + words(10) + ("ab" * 150 if i % 20 == 0 else "")))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "d"))
    seen, want = set(), {}
    for i, text in sorted(rows):
        data, gone = text.encode(), np.zeros(len(text.encode()), bool)
        for at in range(len(data) - 99):
            gone[at:at + 100] |= data[at:at + 100] in seen
            seen.add(data[at:at + 100])
        want[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == want


def test_secrets(docs):
    rows = {r["doc_id"]: r for r in secrets.scan(docs).collect() if r["doc_id"] != 9}
    assert rows[6]["spans"] == "assign:0:19,access:20:40,hex:41:65"
    assert (rows[6]["n_assign"], rows[6]["n_access"], rows[6]["n_hex"]) == (1, 1, 1)
    assert rows[4]["spans"] == "" and rows[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_linked_secrets(spark, tmp_path):
    key = "aB3" * 12
    texts = [(1, f"AKIA{'Q' * 16} then {key} at https://store.test/x"), (2, f"only {key} here"), (3, "https://store.test/x alone"),
             (4, f"AKIA{'Q' * 16} " + "z " * 400 + key)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert [s.split(":")[0] for s in rows[1].split(",")] == ["access", "key", "endpoint"]
    assert rows[2] == rows[3] == "" and rows[4].startswith("access:0:20") and "key" not in rows[4]


def test_language(docs, sf, spark):
    rows = language.identify(docs).collect()
    assert len(rows) == len(DOCS) and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (4, 5))
    real = spark.read.parquet(f"{sf}/documents.parquet")
    judged = language.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    assert judged.where("lang = lang_pred").count() >= 0.97 * judged.count()


def test_packing(docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path()).collect()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in DOCS}
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in DOCS)
    for r in rows:
        if r["doc_id"] != 9:
            piece = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_words_are_encoded_as_by_the_tokenizer():
    """Letters of Latin-1 take the model's short way; a mark behind a capital may compose only after lowering."""
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["Él, cióN. STRASSE Straße. ÿ ª µ Æ×. J\u030c H\u0331. \u0130x, don't DON'T. <|STARTOFTEXT|> a., ,. x2. \u03a3\u03a3", "\n\tWord word, Word. WORD,"]
    got = packing.Encoder(tokenizer_path()).encode([*texts, None])
    assert [g.tolist() for g in got] == [*(whole.encode(t, add_special_tokens=False).ids + [1] for t in texts), [1]]


def test_a_full_cache_of_words_keeps_the_frequent_ones(monkeypatch):
    encoder = packing.Encoder(tokenizer_path(), cached=64)
    rare = [" ".join(f"{a}{b}{c}zq" for a in "bcdfg" for b in "aeiou" for c in s) for s in "hjklmn"]
    for text in rare:
        encoder.encode([f"the river the river {text} the"])
    taught, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (taught.extend(words), learn(words))[1])
    encoder.encode(["the river " + " ".join(f"{a}xq" for a in "bcdfg")])
    assert "bxq" in taught and "the" not in taught and "river" not in taught and len(encoder.known) < 64


def test_cuts_have_least_cost():
    rng = np.random.default_rng(1)
    at = np.unique(rng.integers(1, 9000, 400)).tolist()
    at = sorted(set(at) | set(range(500, at[-1], 500)))
    penalty = rng.integers(0, 13, len(at)).tolist()
    spots, cost = [0, *at], [0]
    for j in range(1, len(spots)):
        cost.append(penalty[j - 1] + min(cost[i] + 2048 - spots[j] + spots[i] for i in range(j) if spots[j] - spots[i] <= 2048))
    want = min(cost[i] for i in range(len(spots)) if spots[-1] - spots[i] < 2048)
    cuts = packing.best_cuts(at, penalty, False)
    assert cost[spots.index(cuts[-1])] == want and max(np.diff([0, *cuts])) <= 2048


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.NET/x"), (2, "https://b.example.net/en/1?q"), (3, "https://example.com/de/"), (4, "http://x.org/fr/#t"), (5, None),
                                   (6, "no scheme"), (7, "http://casino.example.org/en/1"), (8, "http://net"), (9, "http://net/"), (9, "http://net/")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")],
                                  "host string, path string, verdict string")
    listed = spark.createDataFrame([("casino.example.org",)], "host string")
    got = sorted((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules, listed).collect())
    assert got == [(1, "a.net", "net/", "block"), (2, "b.example.net", "example.net/en/", "allow"), (3, "example.com", "example.com/de/", "block"),
                   (4, "x.org", "org/fr/", "allow"), (5, "", None, "allow"), (6, "", None, "allow"), (7, "casino.example.org", None, "block"),
                   (8, "net", None, "allow"), (9, "net", "net/", "block"), (9, "net", "net/", "block")]
    assert urls.judge(pages.limit(0), rules, listed).count() == 0


def test_licenses(docs):
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert rows[10]["license"] == "MIT" and rows[10]["coverage"] == 1.0 and rows[10]["start_word"] == 0 and rows[1]["license"] is None


def test_patience_is_a_common_subsequence():
    a, b = licenses.words("one two three x four five six"), licenses.words("zero one three two four y five six")
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) >= 5
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_audio_alignment_recall(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    prints = {r["id"]: np.array(r["prints"], np.uint32) for r in audio.fingerprints(table, "vec_id", "embedding", audio.melody).collect()}
    want = set()
    for q in (i for i in prints if i % 100 == 0):
        for m, other in prints.items():
            if np.bitwise_count(prints[q] ^ other).sum() / (32 * len(other)) <= 0.2:
                want.add((q, m))
    got = {(r["query_id"], r["match_id"]) for r in audio.search(table, "vec_id", "embedding", audio.melody).collect()}
    assert len(want & got) >= 0.9 * len(want) and want
    frame = spark.createDataFrame([(0, None), (100, []), (1, [1.0])], "vec_id long, embedding array<float>")
    assert audio.search(frame, "vec_id", "embedding", audio.melody).count() == 0


def test_chance_is_no_match(spark):
    """Recordings with the bits of unrelated tunes: nothing but the recordings themselves and planted parts is found."""
    rng = np.random.default_rng(21)
    common = rng.random(32) < 0.25                                       # biased bits: two recordings differ in about 0.38
    def prints(n):
        runs = np.repeat(rng.random((n // 6 + 1, 32)) < np.where(common, 0.9, 0.5), 6, axis=0)[:n]
        return (runs.astype(np.uint64) << np.arange(32, dtype=np.uint64)).sum(axis=1)
    base = [prints(117) for _ in range(300)]
    rows = [(i, b.astype(np.int64).tolist()) for i, b in enumerate(base)] + [(1000 + i, noisy(rng, base[100 * i], 0.15)[30:].tolist()) for i in range(3)]
    frame = spark.createDataFrame(rows, "id long, prints array<long>")
    got = {(r["query_id"], r["match_id"]) for r in audio.align(frame, frame.where("id % 100 = 0 AND id < 1000")).collect()}
    assert got == {(q, q) for q in (0, 100, 200)} | {(0, 1000), (100, 1001), (200, 1002)}


def test_shifted_recording_aligns():
    tune = audio.melody(list(np.random.default_rng(3).normal(size=80)))
    whole, late = (audio.fingerprint(audio.chroma(t)) for t in (tune, tune[audio.HOP * 24:]))
    assert np.bitwise_count(whole[24:24 + len(late)] ^ late).mean() < 1


def test_stages_keep_columns(spark, sf, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0 and docs.count() > 0


def noisy(rng, prints, share):
    """``prints`` with every bit turned with a probability of ``share``."""
    turned = (rng.random((len(prints), 32)) < share).astype(np.uint64) << np.arange(32, dtype=np.uint64)
    return (prints ^ turned.sum(axis=1)).astype(np.int64)


def test_audio_alignment_equals_all_shifts(spark):
    """Noisy copies, parts and short recordings: the pairs of brute force over all shifts, self-matches left out, at the operator's own threshold."""
    rng = np.random.default_rng(11)
    base = [rng.integers(0, 2**32, n).astype(np.uint64) for n in (117, 117, 60, 21, 14, 5)]
    rows = [(100 * i, b.astype(np.int64).tolist()) for i, b in enumerate(base, 1)]
    for i, b in enumerate(base, 1):
        for k, share in enumerate((0.0, 0.1, 0.2, 0.24, 0.3), 1):
            rows += [(100 * i + k, noisy(rng, b, share).tolist()), (100 * i + 10 + k, noisy(rng, b[len(b) // 3:], share).tolist())]
    prints = spark.createDataFrame(rows + [(7, [])], "id long, prints array<long>").repartition(5)
    got = {(r["query_id"], r["match_id"]): r for r in audio.align(prints, prints.where("id % 100 = 0")).collect()}
    want = {}
    for q, a in rows:
        for m, b in rows:
            if q % 100 == 0:
                for s in range(1 - len(a), len(b)):
                    x, y = np.array(a[max(0, -s):], np.uint32), np.array(b[max(0, s):], np.uint32)
                    n = min(len(x), len(y))
                    wrong = int(np.bitwise_count(x[:n] ^ y[:n]).sum())
                    limit = float(audio.most_errors(np.array(n), np.array(n == min(len(a), len(b)))))
                    if n >= min(audio.LEAST_OVERLAP, len(a), len(b)) and wrong <= limit * 32 * n:
                        equal = x[:n] == y[:n]
                        want.setdefault((q, m), []).append((2 * wrong - 32 * n, s, n, int((equal[:-8] & equal[8:]).sum()), wrong / (32 * n)))
    assert len(want) > 25 and set(got) == set(want)
    for pair, shifts in want.items():
        _, s, n, equal, error = min(shifts)
        assert tuple(got[pair])[2:5] == (s, equal, n) and abs(got[pair]["bit_error"] - error) < 1e-9


def test_licenses_equal_unfiltered_alignment():
    scanner, rng = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST), np.random.default_rng(4)
    fill = "the of work license released any terms software version 2 3 0 copy prose river stone".split()
    for name, template in scanner.templates.items():
        for lost in (0, len(template) // 5, len(template) // 5 + 1):
            words = [w for i, w in enumerate(template) if i not in set(rng.choice(len(template), lost, replace=False).tolist())]
            text = [*rng.choice(fill, 15).tolist(), *words, *rng.choice(fill, 15).tolist()]
            want = {}
            for other in scanner.templates:
                reach = len(scanner.templates[other]) * 3 // 2 + 4
                found = [scanner.aligned(other, text[s:s + reach]) for s in range(max(1, len(text) - reach + 1))]
                if any(found):
                    want[other] = max(map(len, found)) / len(scanner.templates[other])
            assert {f[0]: f[1] for f in scanner.find(" ".join(text))} == want
            assert lost or want[name] == 1.0


@pytest.mark.parametrize("text, want", [
    ("Licensed under the MIT License.", ["MIT"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
    ("Licensed under CC BY-NC 9.0.", []), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]), ("Licensed under the Foo License, Version 2.0.", []),
    ("Licensed under the BSD 3-Clause License.", ["BSD-3-Clause"]), ("Licensed under the ISC License.", ["ISC"]),
    ("Licensed under the Mozilla Public License, Version 2.0.", ["MPL-2.0"]), (licenses.TEMPLATES["BSD-3-Clause-text"], ["BSD-3-Clause-text"])])
def test_sibling_licenses(text, want):
    assert [f[0] for f in licenses.Scanner(licenses.TEMPLATES, licenses.LEAST).find("Some words before. " + text + " Some words after.")] == want


@pytest.mark.parametrize("files", [1, 3])
def test_numbers_do_not_depend_on_splits(spark, tmp_path, files):
    from seriesloom.llm.common import numbered
    path = str(tmp_path / "d")
    frame = spark.range(4000).selectExpr("id doc_id", "repeat(sha2(string(id), 256), 4) text", "1 _path", "2 _place")
    frame.repartition(files).write.option("parquet.block.size", 20000).option("parquet.page.size", 4000).parquet(path)
    seen, parts, before = [], [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "30k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = numbered(spark.read.parquet(path).select("doc_id", "text", "_path", "_place"), "row")
            parts.append(rows.rdd.getNumPartitions())
            seen.append({r["doc_id"]: r["row"] for r in rows.select("doc_id", "row").collect()})
            assert rows.columns == ["doc_id", "text", "_path", "_place", "row"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts[0] < parts[1] and seen[0] == seen[1] and len(set(seen[0].values())) == 4000


def test_linked_endpoints(spark, tmp_path):
    access, secret = "AKIA" + "Q" * 16, "token=hunter22"
    texts = [(1, f"https://store.test/x?id={access}&{secret}"), (2, f"{access} {secret} postgres://u@h/d"), (3, f"{access} {secret} at db.test:5432."),
             (4, f"{access} {secret} at 10.0.0.7:6379"), (5, f"{access} {secret} at T10:30:00"), (6, "db.test:5432 alone")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.read.parquet(str(tmp_path / "d"))).collect()}
    text = dict(texts)
    found = {i: [text[i][int(a):int(b)] for k, a, b in (s.split(":") for s in rows[i].split(",") if s) if k == "endpoint"] for i in rows}
    assert found == {1: [text[1]], 2: ["postgres://u@h/d"], 3: ["db.test:5432"], 4: ["10.0.0.7:6379"], 5: [], 6: []}
