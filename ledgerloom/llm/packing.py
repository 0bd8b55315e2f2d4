"""Packing by shortest pack first over the histogram of lengths.

Documents are cut into pieces of the sequence length and one rest. Only the histogram of piece
lengths, at most as many numbers as a sequence has tokens, comes to the driver. There lengths are
placed longest first, each into the pattern with the most room, as many times at once as there are
such patterns; a pattern is a list of lengths with a count. Each piece then finds its place by its
rank among the pieces of its length. Ranks come from counts by part, not from a sort.

Defined cases: null text is empty and has the end id alone. Repeated rows and null ids are packed
like others. An empty table gives no pieces. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import map_texts, staged
from ledgerloom.llm.tokenfile import id_lists
from ledgerloom.llm.tokens import encoder


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(count, ((length, times), ...)) for each packing pattern. Their number depends on the lengths, not on the counts."""
    room: dict[int, list] = {}
    open_rooms: list[int] = []

    def put(space: int, count: int, lengths: tuple) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(open_rooms, space)
        room[space].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_rooms and open_rooms[-1] >= length:
                space = open_rooms[-1]
                count, lengths = room[space].pop()
                if not room[space]:
                    del room[space]
                    open_rooms.pop()
                # Until the next shorter pattern is the shortest, or no more fit.
                below = open_rooms[-1] if open_rooms else 0
                times = max(1, min(space // length, -(-(space - below) // length)))
            else:
                space, lengths, times = size, (), size // length
                count = -(-left // times)
            if left < times:
                times = left
            used = min(count, left // times)
            if lengths and used < count:
                put(space, count - used, lengths)
            put(space - times * length, used, lengths + ((length, times),))
            left -= used * times
    return [group for space in sorted(room) for group in room[space]]


class Places:
    """Where the piece with a rank among those of its length goes."""

    def __init__(self, packed: list[tuple[int, tuple]]):
        slots: dict[int, list] = {}
        rank: dict[int, int] = {}
        sequence = 0
        for count, lengths in packed:
            offset = 0
            for length, times in lengths:
                start = rank.get(length, 0)
                slots.setdefault(length, []).append((start, sequence, times, offset))
                rank[length] = start + count * times
                offset += length * times
            sequence += count
        self.slots = {length: np.array(rows, np.int64).T for length, rows in slots.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for own in np.unique(length):
            at = np.flatnonzero(length == own)
            first, base, times, begin = self.slots[int(own)]
            slot = np.searchsorted(first, rank[at], "right") - 1
            number = rank[at] - first[slot]
            sequence[at] = base[slot] + number // times[slot]
            offset[at] = begin[slot] + number % times[slot] * own
        return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
           remembered: int = 1_000_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, its part and number among the part's pieces of its length; ids on request."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), encoder(tokenizer_path, remembered).encode
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows, some = [], []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, found in zip(ids, encode(batch.column("text").to_pylist())):
                tokens = np.concatenate([found.astype("<u4"), end])
                for start in range(0, len(tokens), size):
                    piece = tokens[start:start + size]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(tokens), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
                    if with_ids:
                        some.append(piece)
                if len(rows) >= 2000:
                    yield _batch(rows, some if with_ids else None, batch)
                    rows, some = [], []
            if rows:
                yield _batch(rows, some if with_ids else None, batch)

    kind = given.schema["doc_id"].dataType.simpleString()
    return map_texts(given, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, number long" + ", ids array<int>" * with_ids)


def _batch(rows: list[tuple], ids: list | None, like: pa.RecordBatch) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"]
    kinds = [like.schema.field("doc_id").type] + [pa.int64()] * 6
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns + ([id_lists(ids)] if ids is not None else []), names + ["ids"] * (ids is not None))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
         remembered: int = 1_000_000) -> DataFrame:
    """One row for each piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (its place in the sequence); with_ids adds the ids themselves. remembered: distinct
    words whose ids a Python worker keeps, some 400 bytes each; fewer take less memory and more time."""
    cut = staged(pieces(docs, tokenizer_path, end_id, size, with_ids, id_col, text_col, remembered), "pieces")
    counts = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(patterns(histogram, size)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number")).drop("part", "number", "base")

    def run(batches):
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)],
                                             [batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, `offset` long")
