"""Bloom filters built by tasks and merged by segments.

A filter has 16 cells a key, up to 2**28 (32 MB as bits), so what is broadcast has a fixed bound.
Beyond it the filter lets more through than need be; those who use it then only save less work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.llm.common import OWN, map_texts, partitions

SEGMENT_BITS = 16
MOST_CELL_BITS = 28
CELLS_PER_KEY = 16
#: Keys that a task gathers before it passes their cells on.
GATHERED = 50_000


def string_digests(column: str) -> Column:
    """32 bytes for a value of any type with a text form; a null is a value of its own."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null")), 256))


def _cells(digests: list[bytes], bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4) & np.uint64((1 << bits) - 1)


def _counted(digests: list[bytes], bits: int) -> pa.RecordBatch:
    """For each segment the cells that these keys set once, and those that they set more often."""
    cells, times = np.unique(_cells(digests, bits), return_counts=True)
    segment = (cells >> np.uint64(SEGMENT_BITS)).astype(np.int64)
    offset = (cells & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u2")
    starts = np.flatnonzero(np.diff(segment, prepend=-1))
    out = [(int(segment[a]), offset[a:b][times[a:b] == 1].tobytes(), offset[a:b][times[a:b] > 1].tobytes())
           for a, b in zip(starts, [*starts[1:], len(segment)])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["segment", "once", "twice"])


def bloom_filter(found: DataFrame, rows: int, least: int) -> tuple[np.ndarray, int]:
    """Packed bits of the cells that are set `least` (1 or 2) times or more by the keys in the column
    digest (32 bytes each), and the number of cells as a power of two. rows: how many keys there are."""
    bits = min(MOST_CELL_BITS, max(SEGMENT_BITS, (rows * CELLS_PER_KEY).bit_length()))

    def count(batches):
        some = []
        for batch in batches:
            some += batch.column("digest").to_pylist()
            if len(some) >= GATHERED:
                yield _counted(some, bits)
                some = []
        if some:
            yield _counted(some, bits)

    def merge(batches):
        # Rows come sorted by segment, so one segment's cells are held at a time.
        at, cells, done = None, None, []
        for batch in batches:
            for segment, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if segment != at:
                    if at is not None:
                        done.append((at, np.packbits(cells >= least).tobytes()))
                    at, cells = segment, np.zeros(1 << SEGMENT_BITS, np.uint8)
                hit = np.frombuffer(once, "<u2")
                cells[hit] = np.minimum(cells[hit] + 1, 2)
                cells[np.frombuffer(twice, "<u2")] = 2
        if at is not None:
            done.append((at, np.packbits(cells >= least).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([b for _, b in done], pa.binary())],
                                             ["segment", "bits"])

    merged = (found.select("digest").mapInArrow(count, "segment int, once binary, twice binary")
              .repartition(partitions(found.sparkSession), "segment").sortWithinPartitions("segment")
              .mapInArrow(merge, "segment int, bits binary"))
    packed = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << SEGMENT_BITS) // 8
    for row in merged.collect():
        packed[row["segment"] * width:(row["segment"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return packed, bits


def probe(digests: list[bytes], packed: np.ndarray, bits: int) -> np.ndarray:
    """Which of the keys may be in the filter; one that is in it always is."""
    cells = _cells(digests, bits)
    return ((packed[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def flagged(rows: DataFrame, digest: str, flag: str, bloom) -> DataFrame:
    """The rows with a boolean column of probe()'s answers. bloom: what bloom_filter gives, broadcast."""
    def run(batches):
        packed, bits = bloom.value
        for batch in batches:
            hit = probe(batch.column(digest).to_pylist(), packed, bits) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], [*batch.schema.names, flag])

    return map_texts(rows, run, T.StructType([*rows.schema.fields, T.StructField(flag, T.BooleanType())]))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not in gone's column of that name. Rows that the filter rules out are not shuffled."""
    digest, maybe = OWN + "digest", OWN + "maybe"
    keys = gone.select(string_digests(id_col).alias("digest"))
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(keys, keys.count(), 1))
    marked = flagged(docs.withColumn(digest, string_digests(id_col)), digest, maybe, bloom)
    rest = marked.filter(maybe).alias("r").join(gone.select(F.col(id_col).alias(OWN + "gone")), F.col(id_col).eqNullSafe(F.col(OWN + "gone")), "left_anti")
    return marked.filter(f"NOT {maybe}").unionByName(rest).select(*docs.columns)
