"""Streamed rules: order of arrival does not matter, idle keys leave no state."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.lanes import lay_out
from seriesloom.operators.rules import evaluate_base
from seriesloom.streaming.rules import DAY_US, STORE, in_order, stream_alerts

COLUMNS = "series_id long, ts timestamp, seq long, sbp double, dbp double, n_meas long, age double"


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/{name}")


def drive(spark, folder, out, **how):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = (stream_alerts(stream, **how).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows"), q


@pytest.fixture(scope="module")
def readings():
    """Eight series over 60 days with equal times, nulls and a silence of 20 days in half of them."""
    r, rows, seq = random.Random(3), [], 0
    for key in range(8):
        at = pd.Timestamp("2024-03-01", tz="UTC") + pd.Timedelta(minutes=key)
        for i in range(40):
            at += pd.Timedelta(hours=r.choice([0, 5, 30, 40])) + pd.Timedelta(days=20 * (i == 25 and key % 2))
            seq += 1
            rows.append((key, at.to_pydatetime(), seq, r.choice([95.0, 120.0, 150.0, 190.0, None]), r.choice([55.0, 80.0, 125.0]), r.choice([1, 2, 3]), 70.0))
    return rows


def batch(spark, rows, idle_days):
    d = spark.createDataFrame(rows, COLUMNS)
    lanes = lay_out(d, ["series_id"], ["ts", "seq"], reach=1)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(lanes.window))
    cut = lanes.running(lanes.df.withColumn("_gap", gap), _part=("sum", (F.coalesce("_gap", F.lit(0)) > idle_days * DAY_US).cast("int")))
    again = lay_out(cut.drop("step"), ["series_id", "_part"], ["ts", "seq"], reach=1)
    days = F.when(F.col("step") == 0, 2.0).otherwise(F.floor(F.col("_gap") / DAY_US).cast("double"))
    return evaluate_base(again, again.df.withColumn("days_since_last", F.greatest(F.least(days, F.lit(30.0)), F.lit(1.0))))


def verdicts(df):
    return sorted(tuple(r) for r in df.select("seq", "step", "days_since_last", F.coalesce("tier", F.lit("")), F.coalesce("rule_id", F.lit("")),
                                              F.coalesce("gate_reason", F.lit("")), "is_emergency", "fired").collect())


@pytest.mark.parametrize("idle_days", [400, 15])
def test_shuffled_files_equal_the_batch(spark, tmp_path, readings, idle_days):
    mixed = random.Random(1).sample(readings, len(readings))
    end = max(x[1] for x in readings)
    write(spark, tmp_path / "in", "a", mixed[::2])
    write(spark, tmp_path / "in", "b", mixed[1::2])
    write(spark, tmp_path / "in", "c", [(99, end + pd.Timedelta(days=600), 10_000, 120.0, 80.0, 2, 50.0)])
    got, query = drive(spark, tmp_path / "in", tmp_path / "out", late="100 days", idle_days=idle_days)
    assert verdicts(got) == verdicts(batch(spark, readings, idle_days))
    # Only the one key that is still waiting keeps state: its row, its timer and the timer's index.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path, readings):
    ordered = sorted(readings, key=lambda x: x[1])
    write(spark, tmp_path / "in", "a", ordered[100:-1])
    write(spark, tmp_path / "in", "b", ordered[-1:])       # a watermark drops rows from the second batch after it on
    write(spark, tmp_path / "in", "c", ordered[:100])
    got, _ = drive(spark, tmp_path / "in", tmp_path / "out", late="1 hour", idle_days=400)
    limit = ordered[-1][1] - pd.Timedelta(hours=1)
    assert sorted(r["seq"] for r in got.collect()) == sorted(x[2] for x in ordered[100:] if x[1] <= limit)


def test_in_order_does_not_depend_on_the_cuts(readings):
    rows = pd.DataFrame([(int(x[1].timestamp() * 1_000_000), *x[2:]) for x in readings if x[0] == 1], columns=["us", "seq", "sbp", "dbp", "n_meas", "age"])
    rows["sbp"] = rows["sbp"].astype(float)
    whole, end = in_order(rows, None, 15 * DAY_US)
    last, parts = None, []
    for at in range(0, len(rows), 7):
        part, last = in_order(rows[at:at + 7], last, 15 * DAY_US)
        parts.append(part)
    assert whole.equals(pd.concat(parts)) and last == end
