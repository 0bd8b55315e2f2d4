"""Removal of repeated passages by fixed-block anchors.

A window of `width` words holds one whole block of `width + 1 // 2` words that begins at a multiple
of that length. So a passage that repeats an earlier one holds a word run equal to a block there:

1. All documents' blocks are the index, and every rolling run of block length probes it. A run is
   an anchor if a block somewhere has its hash and it occurs twice or more.
2. Around anchors, and only there, whole windows are hashed and each is compared with its earliest
   place. Windows that have an earlier place join to maximal exact repeats, whose words go.

Texts are dealt to cells by id. A cell sends each distinct hash once, packed with those of its
bucket, however often it occurs there, so a passage that a third of all rows hold costs a bucket
one entry a cell. A bucket answers with one bit for each hash, in the order given; a cell works out
the same order again from its texts. Anchors are compared by 32 bits and their bucket, which can only
add windows to look at; windows are compared by 64 bits and their bucket.

Defined cases: null text is empty. Rows with a null id come after all others; rows of one id follow
each other in the order of their texts. An empty table gives an empty result. Columns other than id
and text are not looked at. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import partitions, raw_text
from ledgerloom.llm.words import hashed_words, windows

LAST = np.iinfo(np.int64).max


def pack(ascending: np.ndarray) -> bytes:
    """Differences of ascending unsigned values, byte by byte of equal weight, which compress well."""
    return np.diff(ascending, prepend=ascending.dtype.type(0)).view(np.uint8).reshape(-1, ascending.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel(), dtype=kind)


class _Distinct:
    """Hashes of a cell's runs, the distinct ones in order of bucket and value, and which run has which."""

    def __init__(self, hashes: np.ndarray, buckets: int):
        # The low bits say the bucket and the high ones are compared there.
        self.values, self.first, self.which, self.times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        bucket = (self.values & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.slices = np.searchsorted(bucket[self.order], np.arange(buckets + 1, dtype=np.uint64))

    def parts(self):
        for bucket in range(len(self.slices) - 1):
            if self.slices[bucket] < self.slices[bucket + 1]:
                yield bucket, self.order[self.slices[bucket]:self.slices[bucket + 1]]

    def answers(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each distinct hash the bit that its bucket gave."""
        out = np.zeros(len(self.values), bool)
        for bucket, own in self.parts():
            out[own] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=len(own)).astype(bool)
        return out


class _Cell:
    """The texts of a cell in order, and their words' hashes."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("doc_id", "ascending"), ("raw", "ascending")])
        self.ids, self.raws, self.width, self.block = table.column("doc_id"), table.column("raw").to_pylist(), width, (width + 1) // 2
        hashes, offsets = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, found, at in hashed_words(self.raws):
            hashes.append(found)
            offsets.append(at[1:] + offsets[-1][-1])
        self.hashes, self.offsets = np.concatenate(hashes), np.concatenate(offsets)
        self.counts = np.diff(self.offsets)

    def starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of that many words inside one text, and their places in it."""
        place = np.arange(len(self.hashes)) - np.repeat(self.offsets[:-1], self.counts)
        inside = np.flatnonzero(place <= np.repeat(self.counts, self.counts) - width)
        return inside, place[inside]

    def runs(self, buckets: int) -> tuple[np.ndarray, np.ndarray, _Distinct]:
        start, place = self.starts(self.block)
        return start, place % self.block == 0, _Distinct(windows(self.hashes, self.block, 1)[start], buckets)

    def suspects(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of whole windows that hold an anchor. anchors: their first words."""
        seen = np.zeros(len(self.hashes) + 1, np.int64)
        seen[anchors + 1] = 1
        seen = np.cumsum(seen)
        start, _ = self.starts(self.width)
        return start[seen[start + self.width - self.block + 1] > seen[start]]

    def whole(self, start: np.ndarray, buckets: int) -> _Distinct:
        return _Distinct(windows(self.hashes, self.width, 2)[start], buckets)


_SENT = "bucket int, cell int, keys binary, marks binary"
_SENT_NAMES = ["bucket", "cell", "keys", "marks"]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _sent(rows: list[tuple]) -> pa.Table:
    return _table(rows, _SENT_NAMES, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def _replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))


def _answer(rows: list[tuple]) -> pa.Table:
    return _table(rows, ["cell", "bucket", "bits"], [pa.int32(), pa.int32(), pa.binary()])


def _entries(table: pa.Table):
    return [table.column(c).to_pylist() for c in ("cell", "keys", "marks")]


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_text (the kept words joined by one space).

    Every word goes that is covered by a window of `width` words whose sequence also starts earlier:
    in a document with a smaller id, or earlier in the same one.
    """
    spark = docs.sparkSession
    buckets, cells = partitions(spark), 2 * partitions(spark)
    given = docs.select(F.pmod(F.xxhash64(id_col), F.lit(cells)).cast("int").alias("cell"), F.col(id_col).cast("long").alias("doc_id"), raw_text(text_col).alias("raw"))

    def probes(key, table):
        cell = _Cell(table, width)
        _, aligned, distinct = cell.runs(buckets)
        block = np.bincount(distinct.which[aligned], minlength=len(distinct.values)) > 0
        return _sent([(b, key[0].as_py(), pack((distinct.values[own] >> np.uint64(32)).astype(np.uint32)),
                       np.packbits(np.concatenate([block[own], distinct.times[own] > 1])).tobytes()) for b, own in distinct.parts()])

    def anchors(key, table):
        who, keys, marks = _entries(table)
        keys = [unpack(k, np.uint32) for k in keys]
        size = [len(k) for k in keys]
        flags = [np.unpackbits(np.frombuffer(m, np.uint8), count=2 * n).reshape(2, n) for m, n in zip(marks, size)]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        flags = np.concatenate(flags, axis=1)
        hit = (np.bincount(which, flags[0])[which] > 0) & (np.bincount(which, 1 + flags[1])[which] > 1)
        ends = np.cumsum([0, *size])
        return _answer([(c, key[0].as_py(), np.packbits(hit[a:b]).tobytes()) for c, a, b in zip(who, ends, ends[1:])])

    def suspects(key, table, replies):
        if not table.num_rows:
            return _sent([])
        cell = _Cell(table, width)
        start, _, distinct = cell.runs(buckets)
        start = cell.suspects(start[distinct.answers(_replies(replies))[distinct.which]])
        distinct = cell.whole(start, buckets)
        ids = pc.fill_null(cell.ids, LAST).to_numpy()[np.searchsorted(cell.offsets, start[distinct.first], "right") - 1]
        own_cell = key[0].as_py()
        # Where its windows are, for the cell itself: passes through any bucket.
        chosen = np.zeros(len(cell.hashes), bool)
        chosen[start] = True
        return _sent([(own_cell % buckets, own_cell, None, np.packbits(chosen).tobytes())] + [
            (b, own_cell, pack(distinct.values[own]), ids[own].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()) for b, own in distinct.parts()])

    def earliest(key, table):
        who, keys, marks = _entries(table)
        out = [(c, -1, m) for c, k, m in zip(who, keys, marks) if k is None]
        rest = [(c, unpack(k, np.uint64), np.ascontiguousarray(np.frombuffer(m, np.uint8).reshape(8, -1).T).view("<i8").ravel())
                for c, k, m in zip(who, keys, marks) if k is not None]
        if rest:
            _, which = np.unique(np.concatenate([k for _, k, _ in rest]), return_inverse=True)
            ids = np.concatenate([i for _, _, i in rest])
            least = np.full(which.max() + 1, LAST)
            np.minimum.at(least, which, ids)
            later = ids > least[which]
            ends = np.cumsum([0] + [len(k) for _, k, _ in rest])
            out += [(c, key[0].as_py(), np.packbits(later[a:b]).tobytes()) for (c, _, _), a, b in zip(rest, ends, ends[1:])]
        return _answer(out)

    def kept(key, table, replies):
        rows = []
        if table.num_rows:
            cell = _Cell(table, width)
            replies = _replies(replies)
            start = np.flatnonzero(np.unpackbits(np.frombuffer(replies[-1], np.uint8), count=len(cell.hashes)))
            distinct = cell.whole(start, buckets)
            later = distinct.answers(replies)[distinct.which]
            own_first = np.zeros(len(start), bool)
            own_first[distinct.first] = True
            gone = start[later | ~own_first]
            cover = np.zeros(len(cell.hashes) + width + 1, np.int64)
            cover[gone] += 1
            cover[gone + width] -= 1
            keep = np.cumsum(cover)[:len(cell.hashes)] == 0
            for i, doc_id in enumerate(cell.ids.to_pylist()):
                words, stay = cell.raws[i].split(), keep[cell.offsets[i]:cell.offsets[i + 1]]
                removed = int(len(words) - stay.sum())
                rows.append((doc_id, len(words), removed, b" ".join([words[j] for j in np.flatnonzero(stay)] if removed else words)))
        return _table(rows, ["doc_id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    reply = "cell int, bucket int, bits binary"
    first = given.groupBy("cell").applyInArrow(probes, _SENT).groupBy("bucket").applyInArrow(anchors, reply)
    second = given.groupBy("cell").cogroup(first.groupBy("cell")).applyInArrow(suspects, _SENT).groupBy("bucket").applyInArrow(earliest, reply)
    done = given.groupBy("cell").cogroup(second.groupBy("cell")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept binary")
    return done.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
