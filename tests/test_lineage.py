"""What a pin leaves behind, and how many jobs the driver's reading takes."""

import time

from pyspark.sql import functions as F

from seriesloom.lineage import pin
from seriesloom.llm import bloom


def shuffle_files(spark) -> set:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_a_pin_drops_the_shuffles_that_led_to_it(spark):
    before = shuffle_files(spark)
    counted = spark.range(4000).groupBy((F.col("id") % 70).alias("k")).count()
    pinned = pin(counted)
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert pinned.count() == counted.count() == pin(counted).count() == 70
    assert pinned.join(counted.drop("count"), "k").groupBy().sum("count").first()[0] == 4000


def test_a_filter_is_fetched_in_few_jobs(spark):
    confs = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    keys = pin(spark.range(300).select(F.xxhash64("id").alias("h")))
    spark.sparkContext.setJobGroup("fetched", "a filter")
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        filter_ = bloom.build(keys, bloom.words_for(300))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("fetched")) < 30
    assert bloom.holds(filter_, keys.toPandas()["h"].to_numpy().view("uint64")).all()
