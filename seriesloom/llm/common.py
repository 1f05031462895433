"""What several operators share: tables, row numbers, joins against hot keys, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.lineage import pin

ROW = "_row"
#: A key with at least this share of all rows is hot. There are at most 1 / HOT_SHARE such keys, so they may be broadcast.
HOT_SHARE = 0.001
#: Rows of a file are numbered in so many bits, files in those above.
FILE_BITS = 40
#: What the driver reads part by part comes in so many parts at most: each is a job of its own.
FETCHED = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_rows_a_batch(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python: smaller Arrow batches keep the memory of a worker down."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str = ROW) -> DataFrame:
    """``docs`` with a unique long in the new column ``name``.

    In a scan of Parquet files it is the file's place by path and the row's place in the file, so a second reading and a
    retried task see the same numbers however the files are split. A checkpoint, whose partitions are fixed, is numbered
    by partition and position. Files of other formats have no row index and raise an AnalysisException: pin them first.
    """
    if not docs.inputFiles():
        return docs.withColumn(name, F.monotonically_increasing_id())
    meta, path = docs.metadataColumn("_metadata"), fresh(docs, "_path")
    index = meta["row_index"]
    paths = sorted(r[0] for r in docs.select(meta["file_path"].alias(path)).distinct().coalesce(FETCHED).toLocalIterator())
    if len(paths) < 2:
        return docs.withColumn(name, index)
    place = fresh(docs, "_place")
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"`{place}` long, `{path}` string")
    both = docs.withColumns({path: meta["file_path"], name: index}).join(F.broadcast(files), path)
    return both.withColumn(name, F.shiftleft(place, FILE_BITS) + F.col(name)).select(*docs.columns, name)


def attach(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per ``key``, ``n`` its number of rows) without a hot task.

    Keys with ``HOT_SHARE`` of all rows or more are broadcast: at most ``1 / HOT_SHARE`` of them can exist. No
    other key is large enough to burden the task that it is shuffled to. ``groups`` should be pinned.
    """
    hot = groups.where(F.col(n) >= F.lit(max(total * HOT_SHARE, 2)))
    cold = groups.where(F.col(n) < F.lit(max(total * HOT_SHARE, 2)))
    by_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return by_hot.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that it is connected with.

    Labels spread along edges and then jump to their label's label, so the rounds grow with the logarithm of a
    component's diameter. All joins are between plain shuffled frames, which adaptive execution can split.
    """
    both = pin(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = pin(labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label"))
        up = step.select(F.col("node").alias("to"), F.col("to").alias("above"))
        step = pin(step.join(up, "to", "left").select("node", F.least("to", "above").alias("to"), "label"))
        labels = step.select("node", F.col("to").alias("label"))
        if step.where("to <> label").isEmpty():
            return labels
