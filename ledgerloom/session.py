"""Session settings the library is tuned for. A cluster's own session works too:
nothing in the library depends on these values for its results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits oversized join partitions, so one hot supplier or one hot number
    # does not end in one task.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Else every column expression is sent along with the place in the program that made it,
    # which takes longer than planning where plans have thousands of expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "ledgerloom", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: the one the cluster names.

    Only a local session that names none (a test run) gets a local one; on a cluster each
    machine would write to its own disk, so there the folder has to be named.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    import tempfile

    path = os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df):
    """The frame, written once as Parquet into the shared folder and read again: what several later jobs read.

    Columns are stored compressed; a checkpoint of rows takes several times as much.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df, key, rows: int, each: int = 1_500_000):
    """The frame dealt by key to as many tasks as so many rows need, where the session's shuffle has fewer.

    What a task sorts or holds then stays the same however large the table is.
    """
    wanted = -(-rows // each)
    return df.repartition(wanted, key) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def use_all_cores(df, key: str):
    """Spread a frame with few input partitions by key before heavy work per row.

    A table of many files already has enough partitions and is left as it is, so nothing
    is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
