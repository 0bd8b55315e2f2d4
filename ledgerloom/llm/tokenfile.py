"""Token-id files: Parquet with one row for a document, in ascending doc_id order over all parts.

Columns: part (file order), doc_id, part_start (ids of the part's documents before it), n_tokens,
ids (list). ids are dictionary-coded (a vocabulary's ids take two bytes as indexes), the numbers
delta-coded. Row groups and pages are small enough that the page index lets a reader fetch a few
documents' ids, or only the numbers, without the rest. Nothing but a count for each part is needed
to place a document in the whole sequence of ids.

Defined cases: null text is empty and has the end id alone. Null ids come first; rows of one id
follow each other in the order of their texts. An empty table gives an empty file. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.common import map_texts, partitions, shared_folder
from ledgerloom.llm.tokens import encoder

ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 1000


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)))


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text",
              remembered: int = 1_000_000) -> None:
    """Encode all texts, append end_id to each, and write them to the folder `path`. remembered: distinct words whose
    ids a Python worker keeps."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = given.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        part, start, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer_path, remembered).encode
        for batch in batches:
            ids = [np.append(x, x.dtype.type(end_id)) for x in encode(batch.column("text").to_pylist())]
            # A few documents at a time go back, so that a batch of long ones stays small.
            for i in range(0, len(ids), 200):
                some = ids[i:i + 200]
                counts = np.array([len(x) for x in some], np.int64)
                before = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), batch.column("doc_id").slice(i, len(some)),
                                                  pa.array(before), pa.array(counts), id_lists(some)],
                                                 ["part", "doc_id", "part_start", "n_tokens", "ids"])

    kind = given.schema["doc_id"].dataType.simpleString()
    coded = map_texts(ordered, run, f"part int, doc_id {kind}, part_start long, n_tokens long, ids array<int>")
    (coded.write.option("compression", "snappy").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
     .parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, without reading any ids."""
    return _placed(spark.read.parquet(path).select("part", "doc_id", "part_start", "n_tokens"))


def read_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; with bounds only of the documents from first to last, whose pages alone are read."""
    rows = spark.read.parquet(path)
    index = rows.select("part", "n_tokens")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return _placed(rows, index)


def _placed(rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    # One row for each part, so at most as many as the shuffle that wrote the file had partitions: with
    # this bound it is sent to the rows, which hold all the ids, and not the other way round.
    parts = (rows if index is None else index).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("part", "part_start", "base")


def checksums(rows: DataFrame) -> DataFrame:
    """The rows with ids replaced by ids_crc32, over the ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("ids")
            ids = batch.column(at)
            flat, ends = np.asarray(ids.flatten()).astype("<u4"), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths(), np.int64))]).astype(np.int64)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(sums, pa.int64())],
                                             [n for n in batch.schema.names if n != "ids"] + ["ids_crc32"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return map_texts(rows, run, f"{kept}, ids_crc32 long")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder for a file in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
