"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: the words at its gaps may differ. Hashes of the
benchmark's masked runs are joined with those of every document, inside the tasks that read the
documents: a block of benchmark items with its sorted hashes is sent out at a time, and its size has
a bound, so a large benchmark takes several blocks, each against all documents. Around every hit
the item is laid beside the document at the offset that the hit gives, and words are compared place
by place. The best stretch counts each equal word and takes off for each other one, so it ends where
the texts part. A document is contaminated by an item where that stretch has enough equal words:
`least_words`, or `share` of an item shorter than that; an item of fewer than SHORT words only where
all of them stand.

No such document is missed (but for equal hashes of different words). Equal words count one and others
take off two, so the first k words of a best stretch hold fewer than k / 3 others: none of the first
three, at most one of six, two of nine. The masks are chosen by the number of equal words that an item
needs, so that one of them fits the beginning of every such stretch; a test tries all stretches.

Words are runs of letters, digits and underscores, lower-cased.

Defined cases: null texts and items without words never match. `matches` searches items of any length,
a single word too; `drop_contaminated` takes no document away for an item of fewer than `least_item`
words, since any clean text may hold a few words. Repeated rows get equal answers; items of one text
answer for each other under their own ids. Null item ids are kept as they are. Empty tables give
empty results. Columns other than the ids and texts are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import map_texts, raw_text, staged
from ledgerloom.llm.words import GOLDEN, hashed_words, mixed

#: Places that count, as masks over consecutive words, by the equal words that an item needs at least. One of them
#: fits the beginning of every stretch with that many, whichever words differ.
MASKS = {9: ("11101101", "111110001", "11110101", "111011001"), 7: ("111011", "11110001"), 5: ("11111", "111011", "111101")}
#: Bytes between words once other marks than ASCII are blanks.
_GAPS = np.array([b < 128 and not (chr(b).isalnum() or b == 95) for b in range(256)])
_MARKS = re.compile(r"[^\w\x00-\x7f]")
BLOCK_WORDS = 1_000_000
#: Items of fewer words count only where all of them stand.
SHORT = 5


def plain(raw: bytes) -> bytes:
    """A text whose words are runs of bytes outside _GAPS, lower-cased but for A-Z."""
    return raw if raw.isascii() else _MARKS.sub(" ", raw.decode().lower()).encode()


def runs_of(raws: list[bytes]):
    """hashed_words of texts: number of the first, hashes, offsets."""
    return hashed_words([plain(r) for r in raws], fold=True, gaps=_GAPS)


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place of the mask along the words."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = mixed(np.arange(1, len(mask) + 1, dtype=np.uint64) * GOLDEN + np.uint64(int(mask, 2))) | np.uint64(1)
    total = np.full(n, np.uint64(int(mask, 2) * 64 + len(mask)), np.uint64)
    for k, taken in enumerate(mask):
        if taken == "1":
            total += hashes[k:k + n] * factors[k]
    return mixed(total)


def needed(words: int, least_words: int, share: float) -> int:
    """Equal words at which an item of that many words contaminates."""
    return words if words < SHORT else min(least_words, max(1, int(np.ceil(share * words))))


def masks_for(words: int, need: int) -> tuple[str, ...]:
    """Seeds of which one fits the beginning of every stretch of an item with enough equal words."""
    if need >= words:
        return ("1" * min(words, 9),) if words else ()
    family = next((MASKS[least] for least in MASKS if need >= least), ("1" * min(need, 3),))
    return tuple(m for m in family if len(m) <= words)


@dataclass
class Block:
    """Some items: their words one after the other, and the sorted hashes of their masked runs with the word each begins at."""

    ids: list
    words: np.ndarray
    begins: np.ndarray
    need: np.ndarray
    masks: tuple[str, ...]
    hashes: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, np.ndarray]], least_words: int = 13, share: float = 0.7) -> "Block":
        begins = np.cumsum([0] + [len(w) for _, w in items])
        need = np.array([needed(len(w), least_words, share) for _, w in items], np.int64)
        hashes, places, masks = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], set()
        for (_, words), begin, least in zip(items, begins, need.tolist()):
            for mask in masks_for(len(words), least):
                masks.add(mask)
                found = masked(words, mask)
                hashes.append(found)
                places.append(begin + np.arange(len(found)))
        hashes, places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        return cls([i for i, _ in items], np.concatenate([np.empty(0, np.uint64)] + [w for _, w in items]), begins, need, tuple(sorted(masks)), hashes[order], places[order])

    def __post_init__(self):
        # A bitmap of the hashes' first bits turns most runs away before they are looked up.
        self.bits = max(12, int(len(self.hashes) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hashes >> np.uint64(64 - self.bits)] = True

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct rows of text, item, and word of the text that the item's first word is laid on, in a run of texts."""
        found = [np.empty((0, 3), np.int64)]
        for mask in self.masks:
            runs = masked(words, mask)
            at = np.flatnonzero(self.seen[runs >> np.uint64(64 - self.bits)])
            low, high = np.searchsorted(self.hashes, runs[at], "left"), np.searchsorted(self.hashes, runs[at], "right")
            text = np.searchsorted(offsets, at, "right") - 1
            good = np.flatnonzero((low < high) & (at + len(mask) <= offsets[text + 1]))
            times = (high - low)[good]
            each = np.repeat(good, times)
            places = self.places[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
            item = np.searchsorted(self.begins, places, "right") - 1
            found.append(np.stack([text[each], item, at[each] - offsets[text[each]] - (places - self.begins[item])], axis=1))
        rows = np.unique(np.concatenate(found), axis=0)
        # A short item has all its words in the seed: one place in a text says as much as all.
        last = np.append((rows[1:, :2] != rows[:-1, :2]).any(axis=1), True)[:len(rows)]
        return rows[last | (np.diff(self.begins)[rows[:, 1]] >= SHORT)]

    def overlap(self, words: np.ndarray, item: int, offset: int) -> tuple[int, int, int]:
        """Equal words of the best stretch, its first document word and its end, with the item laid on at offset."""
        own = self.words[self.begins[item]:self.begins[item + 1]]
        low, high = max(0, offset), min(len(words), offset + len(own))
        same = words[low:high] == own[low - offset:high - offset]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        rise = total - np.minimum.accumulate(total)
        end = int(np.argmax(rise))
        start = int(np.flatnonzero(total[:end + 1] == np.minimum.accumulate(total)[end])[-1])
        return int(same[start:end].sum()), low + start, low + end

    def contaminated(self, raws: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, equal words, first word, end) of the best stretch wherever it has enough equal words."""
        out = []
        for first, words, offsets in runs_of(raws):
            best = {}
            for k, item, offset in self.hits(words, offsets).tolist():
                seen = self.overlap(words[offsets[k]:offsets[k + 1]], item, offset)
                if seen[0] >= self.need[item] and seen > best.get((k, item), (0, 0, 0)):
                    best[k, item] = seen
            out += [(first + k, item, *seen) for (k, item), seen in sorted(best.items())]
        return out


def blocks(benchmark: DataFrame, item_id: str, text_col: str, most: int, least_words: int, share: float, least_item: int = 1) -> Iterator[Block]:
    """The items of at least `least_item` words by blocks of at most about `most` words (a longer item is one of its
    own). Tasks turn them into the hashes of their words, written once; the driver holds one block at a time."""
    kind = benchmark.schema[item_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            own = [np.concatenate([np.empty(0, np.uint64)] + [h for _, h, _ in runs_of([raw])]) for raw in batch.column("raw").to_pylist()]
            keep = pa.array([len(w) >= least_item for w in own], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([w.tobytes() for w in own], pa.binary())], ["item_id", "words"]).filter(keep)

    some, size = [], 0
    rows = map_texts(benchmark.select(F.col(item_id).alias("item_id"), raw_text(text_col).alias("raw")), run, f"item_id {kind}, words binary")
    for row in staged(rows, "benchmark").toLocalIterator():
        words = np.frombuffer(bytes(row["words"]), np.uint64)
        if some and size + len(words) > most:
            yield Block.of(some, least_words, share)
            some, size = [], 0
        some.append((row["item_id"], words))
        size += len(words)
    if some:
        yield Block.of(some, least_words, share)


def matches(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, share: float = 0.7, most: int = BLOCK_WORDS, id_col: str = "doc_id",
            text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, equal_words, item_words, start_word, end_word: the best stretch of each contaminated document with each item."""
    given = docs.select(F.col(id_col).alias("doc_id"), raw_text(text_col).alias("raw"))
    id_kind, item_kind = given.schema["doc_id"].dataType, benchmark.schema[item_id].dataType
    schema = f"doc_id {id_kind.simpleString()}, item_id {item_kind.simpleString()}, equal_words int, item_words int, start_word int, end_word int"
    names = ["doc_id", "item_id", "equal_words", "item_words", "start_word", "end_word"]
    found = None
    for block in blocks(benchmark, item_id, item_text, most, least_words, share):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                rows, ids, own = [], batch.column("doc_id").to_pylist(), shared.value
                for i, item, *seen in own.contaminated(batch.column("raw").to_pylist()):
                    rows.append((ids[i], own.ids[item], seen[0], int(own.begins[item + 1] - own.begins[item]), *seen[1:]))
                columns = zip(*rows) if rows else [()] * 6
                kinds = [batch.schema.field("doc_id").type, pa.string() if item_kind.simpleString() == "string" else pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        part = map_texts(given, run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, share: float = 0.7, most: int = BLOCK_WORDS, least_item: int = SHORT,
                      text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The whole rows of documents that no benchmark item of at least `least_item` words contaminates. A filter on each row: nothing is shuffled."""
    for block in blocks(benchmark, item_id, item_text, most, least_words, share, least_item):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                raws = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
                clean = np.ones(len(raws), bool)
                clean[[i for i, *_ in shared.value.contaminated(raws)]] = False
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = map_texts(docs, run, docs.schema)
    return docs
