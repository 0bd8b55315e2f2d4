"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

Words and how often they occur come from one pass over the texts. For each word its edits, that is
the word without one letter and the word with one letter replaced by a later one of the alphabet,
are hashed and looked up in Bloom filters over the vocabulary, one filter for each length, of 64-bit
blocks. The other edits need no look-up: a word that is longer by a letter, or has an earlier letter,
is the one that finds this one. Only edits that a filter knows are spelt out and shuffled, to an
exact join with the vocabulary, which removes what the filter let through by chance.

Bounds. The filters that are broadcast at a time take MOST_BYTES at most: lengths are dealt into
rounds of that size, and a length whose filter would be larger is split by the words' hashes into
several, one a round. So neither the broadcast nor the share of wrong hits grows with the vocabulary.
All edits of a word number (letters of the alphabet) x (its length) at most, and so do its near words.

Defined cases: a null text has no words, an empty one neither. Rows with a null id are read as if the
id was empty text. A row that is repeated counts as often as it occurs. Columns other than id and
text are not looked at. An empty table has no words. Very long runs of letters are words like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import map_texts, partitions, staged
from ledgerloom.llm.words import mixed

#: Bytes of filters that are broadcast at a time.
MOST_BYTES = 32 << 20
#: Bits of filter a word, and bits that a word sets in its block.
BITS_PER_WORD, SET_BITS = 24, 5
SEGMENT = 1 << 12
#: Edits hashed at a time; the arrays for that many stay within some megabytes.
EDITS_AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Different words that a task counts before it passes them on.
COUNTED = 400_000


def _runs(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-zÀ-ÿ]{{{least},}}")


def observed(doc_id, text: str, pattern: re.Pattern, least: int, every: int) -> Iterator[tuple[str, int]]:
    """Words of a text with the runs of letters that give them. From a run that the checksum with the document's id
    picks, one letter is taken out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(pattern.findall(text)).items():
        raw = run.encode().lower()  # of bytes: only A-Z change
        h = zlib.crc32(raw, start)
        word = raw.decode()
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        yield word, n


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least so many letters that occur at least so many times in all texts."""
    def count(batches):
        pattern, some = _runs(least), Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in observed(doc_id, text or "", pattern, least, every):
                    some[word] += n
            if len(some) >= COUNTED:
                yield _counts(some)
                some = Counter()
        yield _counts(some)

    found = map_texts(docs.select(F.col(id_col).cast("string"), F.col(text_col)), count, "word string, n long")
    return staged(found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times), "vocabulary")


def _counts(some: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(some.keys(), pa.string()), pa.array(some.values(), pa.int64())], ["word", "n"])


# Hashes. A word's hash is the sum of its letters' numbers times powers of an odd base, from the first letter on, so
# the hash of an edit follows from the word's own parts.

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if n > len(_POWERS[0]):
        out, p = [], 1
        for _ in range(max(n, 64)):
            out.append(p)
            p = p * _BASE & _MASK
        _POWERS[0] = np.array(out, np.uint64)
    return _POWERS[0][:n]


_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _numbers(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(1))


def hashes(letters: np.ndarray) -> np.ndarray:
    return (_numbers(letters) * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def _spread(h: np.ndarray, length: int) -> np.ndarray:
    """Evenly spread over 64 bits, another way for each length."""
    return mixed(h + np.uint64(length * _BASE & _MASK))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    """The high half picks a block, evenly for any number of them."""
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    """The bits of a word in its block, from the low half."""
    out = np.zeros(len(h), np.uint64)
    for k in range(SET_BITS):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _share(h: np.ndarray, shares: int) -> np.ndarray:
    """Which of a length's filters a word is in; independent of block and bits."""
    return (mixed(h) % np.uint64(shares)).astype(np.int64)


def rounds(lengths: dict[int, int], most_bytes: int = MOST_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """Filters by round, each (length, share, shares, blocks), from the number of words of each length."""
    out, room = [], 0
    for length, n in sorted(lengths.items()):
        shares = -(-n * BITS_PER_WORD // (8 * most_bytes))
        blocks = -(-(-(-n // shares) * BITS_PER_WORD) // 64) + 1
        for share in range(shares):
            if not out or blocks * 8 > room:
                out.append([])
                room = max(most_bytes, blocks * 8)
            out[-1].append((length, share, shares, blocks))
            room -= blocks * 8
    return out


def _gathered(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together to a megabyte or so."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Places of the words of each length."""
    size = np.array([len(w) for w in words], np.int64)
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size)}


def _built(words: DataFrame, filters: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, np.ndarray]]:
    """The filters' blocks: tasks set bits, segments of a filter are merged, and the merged ones gathered, MOST_BYTES in all."""
    def setting(batches):
        for batch in _gathered(batches):
            given, out = batch.column(0).to_pylist(), []
            for length, at in _by_length(given).items():
                h = None
                for k, (own, share, shares, blocks) in enumerate(filters):
                    if own != length:
                        continue
                    h = _spread(hashes(_letters([given[i] for i in at])), length) if h is None else h
                    some = h[_share(h, shares) == share]
                    place, bits = _block(some, blocks), _bits(some)
                    order = np.argsort(place, kind="stable")
                    place, bits = place[order], bits[order]
                    cut = np.flatnonzero(np.diff(place // SEGMENT, prepend=-1))
                    for a, b in zip(cut, [*cut[1:], len(place)]):
                        out.append((k, int(place[a]) // SEGMENT, (place[a:b] % SEGMENT).astype("<u2").tobytes(), bits[a:b].tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["filter", "segment", "place", "bits"])

    def merged(batches):
        # Sorted by filter and segment: one segment is held at a time.
        at, cells = None, None
        for batch in batches:
            for k, segment, place, bits in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (k, segment) != at:
                    if at is not None:
                        yield _segment(at, cells)
                    at, cells = (k, segment), np.zeros(SEGMENT, np.uint64)
                np.bitwise_or.at(cells, np.frombuffer(place, "<u2"), np.frombuffer(bits, np.uint64))
        if at is not None:
            yield _segment(at, cells)

    lengths = sorted({f[0] for f in filters})
    rows = (words.filter(F.length("word").isin(lengths)).select("word").mapInArrow(setting, "filter int, segment long, place binary, bits binary")
            .repartition(partitions(words.sparkSession), "filter", "segment").sortWithinPartitions("filter", "segment")
            .mapInArrow(merged, "filter int, segment long, cells binary"))
    out = [(length, share, shares, np.zeros(-(-blocks // SEGMENT) * SEGMENT, np.uint64)) for length, share, shares, blocks in filters]
    for row in rows.toLocalIterator():
        out[row["filter"]][3][row["segment"] * SEGMENT:(row["segment"] + 1) * SEGMENT] = np.frombuffer(row["cells"], np.uint64)
    return [(length, share, shares, cells[:blocks]) for (length, share, shares, cells), (_, _, _, blocks) in zip(out, filters)]


def _segment(at: tuple[int, int], cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([cells.tobytes()], pa.binary())],
                                      ["filter", "segment", "cells"])


def _known(h: np.ndarray, filters: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Which hashes one of a length's filters may hold."""
    hit = np.zeros(len(h), bool)
    for share, shares, cells in filters:
        bits = _bits(h)
        found = (cells[_block(h, len(cells))] & bits) == bits
        hit |= found & (_share(h, shares) == share) if shares > 1 else found
    return hit


def probed(words: list[str], alphabet: np.ndarray, filters: dict[int, list[tuple[int, int, np.ndarray]]]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places of words, and their edits that the filters may hold. words: of one length, none twice."""
    length = len(words[0])
    powers, later = _powers(length + 1), _numbers(alphabet)
    step = max(1, EDITS_AT_ONCE // (length * (len(alphabet) + 1)))
    for start in range(0, len(words), step):
        part = words[start:start + step]
        letters = _letters(part)
        terms = _numbers(letters) * powers[:length]
        total = terms.sum(axis=1, dtype=np.uint64)
        if length - 1 in filters and length > 1:
            before = np.cumsum(terms, axis=1, dtype=np.uint64)
            h = (before - terms) + (total[:, None] - before) * _INVERSE
            # Without either of two equal neighbours a word is the same: the second one is left in.
            own = np.ones(letters.shape, bool)
            own[:, 1:] = letters[:, 1:] != letters[:, :-1]
            row, at = np.nonzero(own)
            hit = _known(_spread(h[row, at], length - 1), filters[length - 1])
            row, at = row[hit], at[hit]
            yield start + row, [part[r][:i] + part[r][i + 1:] for r, i in zip(row, at)]
        if length in filters:
            for at in range(length):
                rest = total - terms[:, at]
                h = _spread((rest[:, None] + later * powers[at]).ravel(), length)
                later_letter = (alphabet[None, :] > letters[:, at][:, None]).ravel()
                some = np.flatnonzero(later_letter)
                some = some[_known(h[some], filters[length])]
                row, letter = some // len(alphabet), some % len(alphabet)
                yield start + row, [part[r][:at] + chr(alphabet[c]) + part[r][at + 1:] for r, c in zip(row, letter)]


def near_pairs(words: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """a, n_a, b, n_b: each two words (of columns word, n; none twice) that differ by one letter put in, left out or replaced, once."""
    spark = words.sparkSession
    lengths = {r["size"]: r["n"] for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter != ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["letter"]) for r in used), np.int64)
    found = None
    for filters in rounds(lengths, most_bytes):
        sent = spark.sparkContext.broadcast(_built(words, filters))

        def probing(batches, sent=sent):
            by_length: dict[int, list] = {}
            for length, share, shares, cells in sent.value:
                by_length.setdefault(length, []).append((share, shares, cells))
            for batch in _gathered(batches):
                given, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for length, at in _by_length(given).items():
                    for place, edits in probed([given[i] for i in at], alphabet, by_length):
                        if edits:
                            rows = at[place]
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n[rows], pa.int64()), pa.array(edits, pa.string())],
                                                             ["a", "n_a", "b"])

        sizes = sorted({f[0] for f in filters} | {f[0] + 1 for f in filters})
        some = (words.filter(F.length("word").isin(sizes)).select("word", "n").repartition(partitions(spark), "word")
                .mapInArrow(probing, "a string, n_a long, b string"))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b")).limit(0)
    return found.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the way from a word along its forms. Ways are halved each time; n grows along them, so they end."""
    ways = staged(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = staged(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        if ways.filter("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.drop("moved")


def variants(words: DataFrame, factor: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of (word, n): how many words are near it; the most frequent of them (of
    several the first by code points) if it occurs at least `factor` times as often, with its n; and the last form from there on."""
    pairs = staged(near_pairs(words, most_bytes), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    far = F.col("n_near").isNull() | (-F.col("best.less") < factor * F.col("n"))
    known = staged(words.join(best, "word", "left").select(
        "word", F.when(far, None).otherwise(F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, None).otherwise(-F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
