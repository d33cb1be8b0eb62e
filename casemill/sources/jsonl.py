"""JSON-lines tables: strict, tolerant and optional scans, raw-line digests, appends and whole-generation writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(where)) if any(c in path for c in "*?[{") else fs.exists(where)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows; the first malformed line fails the job. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The well-formed rows; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_reporting(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows with _corrupt_record, the raw text of a malformed line, and file, where the row came from."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"), F.input_file_name().alias("file"))
    return lines.select("r.*", "file")


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict scan of a path that may be absent: then the empty table."""
    return read_strict(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def raw_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, digest, line): sha256 of each raw line with its line end, and the line itself."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get_json_object("value", f"$.{key}").alias(key), F.sha2(F.concat("value", F.lit("\n")), 256).alias("digest"), F.col("value").alias("line"))


def read_ids(spark: SparkSession, path: str, key: str = "call_id") -> DataFrame:
    """(key): ids from a file of plain lines and JSON lines, mixed; a repeated id refuses."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v != ''")
    ids = lines.select(F.when(F.col("v").startswith("{"), F.get_json_object("v", f"$.{key}")).otherwise(F.col("v")).alias(key))
    if repeated := ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").take(1):
        raise ValueError(f"repeated {key}: {repeated[0][0]}")
    return ids


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a log."""
    df.write.mode("append").json(path)


def write_generation(df: DataFrame, root: str) -> str:
    """Writes a whole generation under a fresh name and returns its path; readers of earlier ones are not disturbed, and the
    commit protocol shows the new one only when it is complete (_SUCCESS)."""
    path = f"{root.rstrip('/')}/generation-{uuid.uuid4().hex}"
    df.write.json(path)
    return path


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")
