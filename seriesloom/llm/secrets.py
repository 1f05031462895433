"""Secrets in texts, with DataFrame functions only: spans of three base kinds, and weak candidates linked to them.

Positions come from splitting a text at a pattern: the lengths of the pieces between matches and of the matches add up.
Weak candidates (long mixed-case random strings, and endpoints) are reported only in company: spans are dealt to windows
of SCOPE code points and joined with those of their own and the neighbouring windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.lineage import pin
from seriesloom.llm.common import ROW, numbered

#: The base patterns and the least length of what they must capture.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Weak parts: a key-like string of 32 or more with both cases and a digit, and a URL or host with a port.
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = (r"(?:(?:https?|s3|ftp|jdbc:[a-z]+)|(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30})://[^\x20\x09-\x0D\"'<>]+"
            r"|(?<![A-Za-z0-9_.-])(?:(?:[A-Za-z0-9-]{1,63}\.){0,10}[A-Za-z][A-Za-z0-9-]{0,62}|(?:[0-9]{1,3}\.){3}[0-9]{1,3}):[0-9]{2,5}(?![0-9A-Za-z:])")
KINDS = ("assign", "access", "hex", "key", "endpoint")        # order of spans with an equal start
SCOPE = 256


def spans(text: Column, pattern: str, kind: str, least: int, measured: int = 0) -> Column:
    """array<struct<start, stop, kind>> of the pattern's matches whose group ``measured`` has ``least`` code points.

    Matches are the leftmost, non-overlapping ones; short ones are dropped after matching. The stretches of a long run
    of matches are summed once, in one pass over the pieces. ``kind`` is a place in KINDS.
    """
    p = F.lit(pattern)
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(measured)) if measured else whole
    none = F.array().cast("array<struct<start:long,stop:long,kind:int>>")
    zipped = F.arrays_zip(F.transform(F.slice(between, 1, F.size(whole)), F.length).alias("b"), F.transform(whole, F.length).alias("w"),
                          F.transform(part, F.length).alias("m"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        stop = start + x["w"]
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), F.lit(KINDS.index(kind)).alias("kind")))
        return F.struct(stop.alias("at"), F.when(x["m"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, step, lambda acc: acc["out"])).otherwise(none)


def _written(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["stop"])))
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["stop"].cast("string"))))


def linked(found: DataFrame) -> DataFrame:
    """(_row, extra): weak candidates with company, from pinned (_row, base, weak) arrays of spans.

    A key counts within SCOPE code points of an access identifier or assignment; an endpoint counts within SCOPE of both
    a secret part (key, hex or assignment) and an access identifier. Distance is from start to start.
    """
    parts = found.where(F.size("weak") > 0).select(ROW, F.explode(F.concat("base", "weak")).alias("s")).select(ROW, "s.start", "s.stop", "s.kind")
    window = F.floor(F.col("start") / SCOPE)
    assign, access, hex_, key, endpoint = range(len(KINDS))
    weak = parts.where(F.col("kind") >= key).withColumn("window", F.explode(F.array(window - 1, window, window + 1)))
    anchor = parts.where(F.col("kind") <= key).select(F.col(ROW).alias("r"), window.alias("window2"), F.col("start").alias("start2"), F.col("kind").alias("kind2"))
    close = weak.join(anchor, (F.col(ROW) == F.col("r")) & (F.col("window") == F.col("window2")) & (F.abs(F.col("start") - F.col("start2")) <= SCOPE))
    seen = close.groupBy(ROW, "start", "stop", "kind").agg(
        F.max((F.col("kind2") == access).cast("int")).alias("id"),
        F.max(F.col("kind2").isin(assign, hex_, key).cast("int")).alias("secret"),
        F.max((F.col("kind2") == assign).cast("int")).alias("named"))
    kept = seen.where(((F.col("kind") == key) & (F.col("id") + F.col("named") > 0)) | ((F.col("kind") == endpoint) & (F.col("id") + F.col("secret") == 2)))
    return kept.groupBy(ROW).agg(F.collect_list(F.struct("start", "stop", "kind")).alias("extra"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``docs`` is a table scan with doc_id and text (null: empty); other columns are not read. Offsets are code points, the
    end is exclusive. A text without findings has empty spans and the hash of the empty string; repeated rows are
    reported each. Linked weak candidates are added to spans alone. A key that overlaps a base span is left out.
    """
    text = F.coalesce("text", F.lit(""))
    assign, access = spans(text, ASSIGN, "assign", LEAST_ASSIGN, 1), spans(text, ACCESS, "access", LEAST_ACCESS)
    hexes = spans(text, rf"[0-9a-f]{{{LEAST_HEX},}}", "hex", LEAST_HEX)      # maximal runs, so the same matches
    weak = F.concat(spans(text, KEY, "key", 32), spans(text, ENDPOINT, "endpoint", 8))
    found = numbered(docs.select("doc_id", "text")).select(ROW, "doc_id", assign.alias("a"), access.alias("i"), hexes.alias("h"), weak.alias("weak"))
    found = found.withColumn("base", F.concat("a", "i", "h"))
    free = F.filter("weak", lambda w: (w["kind"] != KINDS.index("key")) | ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])))
    found = pin(found.select(ROW, "doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("i", "n_access"), ("h", "n_hex"))],
                             "base", free.alias("weak")))
    some = found.join(linked(found), ROW, "left")
    everything = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:long,stop:long,kind:int>>")))
    return some.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _written(everything).alias("spans"))
