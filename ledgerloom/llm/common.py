"""Tables, the shared folder for intermediate tables, and the shape of a document table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.session import shared_dir

#: Names that operators add to whole rows for a time; a table's own columns never begin like this.
OWN = "__llm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the one in spark.checkpoint.dir."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet into the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks it was running, not the stages before.
    The folder can go when the application's results are written.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that go to Python at a time where they hold texts: with the default of Spark a batch of
#: long documents takes gigabytes, here a batch takes as many texts.
BATCH_ROWS = 256


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with small batches. The session keeps the setting, since frames are evaluated later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def raw_text(text: str = "text"):
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    """The partitions the session deals a shuffle to: what its owner has set for this size of data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id as text leaves remainder 0 by 5.
    A null id is not held out, and no label can refer to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
