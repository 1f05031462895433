"""Readers with declared schemas, and the contract that required inputs exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seriesloom.operators.sessions import admissible

# Columns of the raw reading, record and demographic files.
READING = T.StructType([T.StructField("pid", T.LongType()), T.StructField("datatime", T.StringType()),
                        T.StructField("measuretime", T.ShortType()), T.StructField("sbp", T.ShortType()),
                        T.StructField("dbp", T.ShortType()), T.StructField("uf", T.FloatType())])
RECORD = T.StructType([T.StructField("pid", T.LongType()), T.StructField("keyindate", T.StringType()),
                       *[T.StructField(c, T.DoubleType()) for c in ("weightstart", "weightend", "dryweight", "temperature")]])
DEMOGRAPHIC = T.StructType([T.StructField("pid", T.LongType()), T.StructField("gender", T.StringType()),
                            T.StructField("birthday", T.IntegerType()), T.StructField("DM", T.DoubleType()),
                            T.StructField("first_dialysis", T.StringType())])


class MissingInput(FileNotFoundError):
    """A required input is not there."""


def require(spark: SparkSession, path: str, label: str) -> str:
    """The path, or an error that names the input. Works on any file system Spark can list."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(conf).globStatus(at)
    if found is None or len(found) == 0:
        raise MissingInput(f"{label} is missing: {path}")
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, label: str, columns=None) -> DataFrame:
    """Header CSV with a declared schema; columns are matched by name, so files may hold more of them."""
    header = spark.read.option("header", True).csv(require(spark, path, label)).columns
    texts = spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{label} lacks columns {missing}")
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    cast = lambda f: (F.col(f.name) if isinstance(f.dataType, T.StringType)
                      else F.col(f.name).try_cast(f.dataType.simpleString()))
    return texts.select(*[cast(f).alias(f.name) for f in wanted])


def read_readings(spark: SparkSession, path: str, ranges=((60, 260), (30, 160)), min_diff=10) -> tuple[DataFrame, DataFrame]:
    """(admissible readings, one row of counts: raw, undated, rejected).

    ``seq`` keeps the order of equal timestamps inside a file.
    """
    raw = read_csv(spark, path, READING, "readings").select(
        F.col("pid").cast("string").alias("patient_id"), F.try_to_timestamp("datatime").alias("ts"),
        F.monotonically_increasing_id().alias("seq"), "measuretime", "sbp", "dbp", "uf")
    keep = F.coalesce(admissible("sbp", "dbp", *ranges, min_diff), F.lit(False))
    dated = F.col("ts").isNotNull()
    counts = raw.agg(F.count("*").alias("raw"), F.count_if(~dated).alias("undated"), F.count_if(dated & ~keep).alias("rejected"))
    return raw.where(dated & keep), counts


def read_records(spark: SparkSession, path: str) -> DataFrame:
    r = read_csv(spark, path, RECORD, "session records")
    day = F.to_date(F.try_to_timestamp("keyindate"))
    return r.select(F.col("pid").cast("string").alias("patient_id"), day.alias("day"), F.monotonically_increasing_id().alias("seq"),
                    "weightstart", "weightend", "dryweight", "temperature").where(F.col("day").isNotNull())


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DEMOGRAPHIC, "demographics").withColumn("patient_id", F.col("pid").cast("string")).drop("pid")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """A sessions file written earlier: key as text, ``ts`` as timestamp, bad dates null."""
    d = spark.read.option("header", True).csv(require(spark, path, "sessions"))
    return d.withColumn("ts", F.try_to_timestamp("ts")).withColumn("patient_id", F.col("patient_id").cast("string"))
