"""Exact dedup by two passes over Bloom filters.

Pass 1 makes a digest of every normalised text and sets its cells in a filter that counts to
two. Pass 2 probes: a digest with a cell below two cannot occur twice, so its row passes
straight through. Only the others are shuffled, as digests, and grouped exactly.

The filter's size has a fixed bound (see bloom.py). Beyond it more rows are shuffled than need
be; the result is the same.

Defined cases: a null text is empty; empty and white texts are equal to each other. A null id
loses to any other. A row that is repeated (same id, same text) counts as often as it occurs,
and one of the repeated rows stays. An empty table gives an empty result. Columns other than
id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.llm.bloom import bloom_filter, flagged
from ledgerloom.llm.common import OWN, map_texts, raw_text, staged

WHITE = b" \t\n\x0b\x0c\r"


def digest_of(raw: bytes) -> bytes:
    return hashlib.sha256(raw.translate(None, WHITE)).digest()


def _with_digests(batches: Iterator[pa.RecordBatch], column: str, added: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([digest_of(x) for x in batch.column(column).to_pylist()], pa.binary())
        keep = [i for i, name in enumerate(batch.schema.names) if name != column]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [found],
                                         [batch.schema.names[i] for i in keep] + [added])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chars (code points of the original), digest (32 bytes of the normalised text)."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
                        raw_text(text_col).alias("raw"))
    return map_texts(given, lambda batches: _with_digests(batches, "raw", "digest"),
                     f"doc_id {given.schema['doc_id'].dataType.simpleString()}, chars int, digest binary")


def _groups(found: DataFrame) -> tuple[DataFrame, DataFrame, object]:
    """Possibly repeated rows counted by (doc_id, digest, chars), their groups, and the broadcast filter."""
    spark = found.sparkSession
    bloom = spark.sparkContext.broadcast(bloom_filter(found, found.count(), 2))
    maybe = flagged(found, "digest", "maybe", bloom).filter("maybe")
    counted = staged(maybe.groupBy("doc_id", "digest", "chars").agg(F.count(F.lit(1)).alias("copies")), "repeated")
    first = F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    groups = counted.groupBy("digest").agg(first.alias("first"), F.sum("copies").alias("group_size"))
    return counted, staged(groups.select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.shorter")).alias("keep_chars"), "group_size"),
                           "groups"), bloom


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    found = staged(digests(docs, id_col, text_col), "digests")
    counted, groups, bloom = _groups(found)
    alone = flagged(found, "digest", "maybe", bloom).filter("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    grouped = (counted.join(groups, "digest")
               .select("doc_id", "keep_id", "group_size", "digest", wins.alias("wins"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
               .select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "digest"))
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows that stay. Rows that cannot have a copy are not shuffled."""
    found = staged(digests(docs, id_col, text_col), "digests")
    _, groups, bloom = _groups(found)
    raw, digest, maybe, chars = (OWN + x for x in ("raw", "digest", "maybe", "chars"))
    rows = docs.withColumns({raw: raw_text(text_col), chars: F.length(F.coalesce(F.col(text_col), F.lit("")))})
    schema = T.StructType([f for f in rows.schema.fields if f.name != raw] + [T.StructField(digest, T.BinaryType())])
    marked = flagged(map_texts(rows, lambda batches: _with_digests(batches, raw, digest), schema), digest, maybe, bloom)
    alone = marked.filter(~F.col(maybe))
    first = (F.col(digest) == groups["digest"]) & F.col(id_col).eqNullSafe(groups["keep_id"]) & (F.col(chars) == groups["keep_chars"])
    stays = marked.filter(maybe).join(groups, first, "left_semi").dropDuplicates([digest])
    return alone.unionByName(stays).select(*docs.columns)

