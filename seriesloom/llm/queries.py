"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.llm import audio, exact, language, licenses, minhash, mixing, packing, pieces, repair, secrets, substrings, trie, urls
from seriesloom.llm.common import few_rows_a_batch, table
from seriesloom.llm.registry import ORACLES, QUERIES, query  # noqa: F401


@query("op1_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op2_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("op5_repeated_substrings")
def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op3_audio_fingerprints")
def audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is played as a tune; those whose id is divisible by 100 are looked for among all."""
    few_rows_a_batch(spark, 256)
    return audio.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.melody)


@query("op4_mixing")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: The rules that the query judges by.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A host is listed when one of its labels has one of these parts, split at hyphens.
UNWANTED = ("adult", "ads", "bets", "casino", "pills", "spam")


@query("op7_url_filter", """
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
         u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
         m AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                              WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                              WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                              WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
    FROM m""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).distinct()
    listed = hosts.where(F.col("host").rlike(rf"(^|[.-])({'|'.join(UNWANTED)})([.-]|$)"))
    return urls.judge(pages, rules, listed)


@query("op8_packing")
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", """
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
                      row_number() OVER () AS r
               FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER w = 1 AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, r)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query("op11_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_sentencepiece")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return pieces.encode(table(spark, sf_dir, "documents"), model_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_prefix_trie", """
    WITH bits AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
                             lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc),
         t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                      {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations),
         ids AS (SELECT DISTINCT c, c - c % 100 AS base FROM t),
         k AS (SELECT c, base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
                      lambda a, b: xor(a // 256, crc[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h FROM ids, bits),
         r AS (SELECT k.c, 0 AS part, pos, said FROM k JOIN t ON t.c = k.base AND pos <= h
               UNION ALL SELECT k.c, 1, pos, said FROM k JOIN t ON t.c = k.c AND pos > h),
         s AS (SELECT k.c, coalesce(list(said ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS said FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
         p AS (SELECT c, len(said) AS n, unnest(range(len(said) + 1)) AS d, said FROM s),
         node AS (SELECT d AS depth, said[:d] AS path, min(c) AS conv_id, count(*) AS n_convs,
                         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends
                  FROM p GROUP BY d, said[:d]),
         up AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
         more AS (SELECT node.*, coalesce(n_children, 0) AS n_children,
                         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS own FROM node LEFT JOIN up USING (path)),
         below AS (SELECT path[:i] AS path, sum(own)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves
                   FROM (SELECT path, own, n_children, unnest(range(depth + 1)) AS i FROM more) GROUP BY 1)
    SELECT m.conv_id, m.depth, parent.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256
    FROM more m JOIN below USING (path) LEFT JOIN node parent ON m.depth > 0 AND parent.path = m.path[:m.depth - 1]""")
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
