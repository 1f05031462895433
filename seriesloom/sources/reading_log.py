"""Parser of hand-written reading logs: ``date, sbp, dbp[, pulse] [key=value ...]`` per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Keyed fields that hold a number, and what they become.
NUMBERS = {"weight": "weight", "w": "weight"}
KNOWN = (*NUMBERS, "meds", "sym", "pos")
POSITIONS = ("SITTING", "STANDING", "LYING")
YES, NO = ("y", "yes", "1"), ("n", "no", "0")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number in the file, so that an error can name the line.

    Files are read in blocks like any text source. A line's number is its place inside its block plus the
    lines of the blocks before it, so no task ever holds more than one block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("raw"),
        F.monotonically_increasing_id().alias("_id"))
    ahead = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "_block").agg(F.count("*").alias("_n")).select(
        "file", "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file", "_block").orderBy("_id")
    return lines.join(starts, ["file", "_block"]).select(
        "file", (F.col("_start") + F.row_number().over(inside)).alias("line"), "raw")


def parse(lines: DataFrame, raw="raw") -> DataFrame:
    """Add parsed columns and ``error`` (null for a good line); blank and ``#`` lines are dropped."""
    text = F.trim(F.col(raw))
    d = lines.withColumn("_t", text).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    # One-element explodes: a line is split once, however many fields are read from the parts.
    parts = F.filter(F.transform(F.split("_t", r"[,\t;]+"), lambda p: F.trim(p)), lambda p: p != "")
    d = d.withColumn("_p", F.explode(F.array(parts)))
    kv = F.filter("_p", lambda p: p.contains("="))
    split_up = F.struct(F.filter("_p", lambda p: ~p.contains("=")).alias("_pos"),
                        F.transform(kv, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))).alias("_keys"),
                        F.transform(kv, lambda p: F.trim(F.regexp_replace(p, "^[^=]*=", ""))).alias("_vals"))
    d = d.withColumn("_x", F.explode(F.array(split_up))).select("*", "_x.*").drop("_x")

    def last(name: str) -> Column:
        at = F.size("_keys") - F.array_position(F.reverse("_keys"), name)
        return F.when(F.array_contains("_keys", name), F.try_element_at("_vals", (at + 1).cast("int")))

    at = lambda i: F.try_element_at("_pos", F.lit(i))
    number = lambda i: F.bround(at(i).try_cast("double")).cast("int")
    meds, pos = F.lower(last("meds")), F.upper(last("pos"))
    d = d.select("*", F.to_date(F.try_to_timestamp(at(1))).alias("date"), number(2).alias("sbp"), number(3).alias("dbp"),
                 at(4).try_cast("double").alias("pulse"),
                 F.coalesce(last("weight"), last("w")).try_cast("double").alias("weight"),
                 F.when(meds.isin(*YES), True).when(meds.isin(*NO), False).alias("took_all_meds"), pos.alias("position"),
                 F.when(last("sym").isNotNull(), F.filter(F.transform(F.split(last("sym"), r"\+"), lambda s: F.trim(s)), lambda s: s != ""))
                 .alias("symptoms"))
    strange = F.array_except("_keys", F.array(*[F.lit(k) for k in KNOWN]))
    bad = lambda name, col: last(name).isNotNull() & col.isNull()
    error = (F.when(F.size("_pos") < 3, "expected date, sbp, dbp").when(F.col("date").isNull(), "unreadable date")
             .when(F.col("sbp").isNull() | F.col("dbp").isNull(), "sbp and dbp must be numbers")
             .when((F.size("_pos") > 3) & F.col("pulse").isNull(), "pulse must be a number")
             .when(F.size(strange) > 0, F.concat(F.lit("unknown field "), strange[0]))
             .when(last("meds").isNotNull() & F.col("took_all_meds").isNull(), "meds= must be y or n")
             .when(F.col("position").isNotNull() & ~F.col("position").isin(*POSITIONS), "pos= must be a known position")
             .when(bad("weight", F.col("weight")) | bad("w", F.col("weight")), "weight= must be a number"))
    return d.withColumn("error", error).drop("_t", "_p", "_pos", "_kv", "_keys", "_vals")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").drop("error")


def bad(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select(*[c for c in ("file", "line", "raw", "error") if c in parsed.columns])
