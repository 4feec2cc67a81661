"""Session factory: the settings every query of this library is written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with AQE, skew joins and Arrow switched on."""
    builder = SparkSession.builder.master(master).appName("lineweave")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without the setting (tests); it then gets a folder of its own. Elsewhere a
    machine-local folder would lose data, so the missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's own tables: one for each run, so that all of them can go at once."""
    return f"{shared_dir(spark)}/lineweave-{spark.sparkContext.applicationId}"


#: Shuffle files of a query go when it has ended; without, they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later passes neither recompute it nor depend on
    the executors that made it. The table stays until `forget` or `release`, what was shuffled for it goes at once."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more: those of rounds that later ones have replaced."""
    for df in tables:
        deleted(df.sparkSession, df.written_to)


def release(spark: SparkSession) -> None:
    """Delete all tables that this run has written. Call it once the results that were made from them are consumed."""
    deleted(spark, run_dir(spark))
