"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "casemill") -> SparkSession:
    """A session with the settings that the operators are tested under. A cluster brings its own session."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _importable(spark: SparkSession) -> None:
    """Lets Python workers on machines that see this folder import the package; elsewhere it goes out with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; where it is unset (tests on one
    machine), a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
    folder = "file://" + tempfile.mkdtemp(prefix="casemill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended before; the folder is scratch space
            pass


atexit.register(_remove_written)


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df once, as Parquet, to the shared folder, and reads it back. A lost executor then
    costs no recomputation of what stands before, and the reader prunes columns."""
    _importable(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/casemill-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if(small: DataFrame, rows: int, bound: int) -> DataFrame:
    """A broadcast hint only where the counted rows stay within the bound; beyond it the planner shuffles."""
    return F.broadcast(small) if rows <= bound else small


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over as many partitions as the session shuffles into, one per core at least, by the hash of columns. Small rows
    that take long in Python stay spread, where adaptive execution would put them into one task for their few bytes."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def arrow_safe(step):
    """A step of mapInPandas that leaves out empty frames and hands strings over as plain objects: Arrow gets neither a
    string column without chunks nor one of several."""

    def run(batches):
        for frame in step(batches):
            if len(frame):
                text = [c for c in frame.columns if frame[c].dtype != object and str(frame[c].dtype).startswith("str")]
                yield frame.astype(dict.fromkeys(text, object)) if text else frame

    return run
