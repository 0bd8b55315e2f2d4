"""Lines of two invoices compared in their row, on arrays: one row a pair, no row a pair of lines.

An invoice's lines come as two arrays. ``ints`` has two numbers a line: the hash of code and text, and four times
the short hash of the code, plus 2 where the text has words, plus 1 where the line is the first of its code.
``nums`` has three: quantity, unit price and taxable value, as doubles or as whole numbers of the smallest decimal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs of lines that are held at a time, however many lines two invoices have.
AT_ONCE = 500_000


def _lists(column: pa.Array, width: int, scales: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(first line of each row and the end, values a line) of an array column; missing values are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    if scales:
        values = values.astype(float).reshape(-1, width) / 10.0 ** np.array(scales)
    return offsets // width, values.reshape(-1, width)


def numeric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``scalars.numeric_similarity``: 1 for equal, falling to 0 at a difference of 5 %; 0 where one is missing."""
    ratio = np.abs(a - b) / np.maximum(np.abs(a), np.abs(b))
    return np.where((a == 0) & (b == 0), 1.0, np.where(ratio <= 0.05, 1 - ratio / 0.05, 0.0))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``scalars.ratio_similarity``; NaN where not both are positive."""
    return np.where((a > 0) & (b > 0), np.maximum(0.0, 1 - np.abs(a - b) / np.maximum(a, b)), np.nan)


def weighted(factors: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Weighted mean of the factors that are there (not NaN), 0 without any."""
    points, weight = 0.0, 0.0
    for f, w in factors:
        points, weight = points + np.where(np.isnan(f), 0.0, f * w), weight + np.where(np.isnan(f), 0.0, w)
    return np.where(weight > 0, points / np.where(weight > 0, weight, 1.0), 0.0)


def crossed(first: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Every line of a row's one side with every line of its other side, some lines at a time: (the lines of the one
    side, where each begins, both lines of each pair). Lines whose other side has none are left out."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    count, line = np.diff(other)[row], np.arange(first[0], first[-1])
    row, line, count = row[count > 0], line[count > 0], count[count > 0]
    ends, at = np.cumsum(count), 0
    while at < len(line):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        n = count[at:to]
        begin = np.cumsum(n) - n
        theirs = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(other[row[at:to]], n)
        yield line[at:to], begin, np.repeat(line[at:to], n), theirs
        at = to


def _best(score: np.ndarray, where: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The greatest score of each segment among the given places, 0 without any."""
    out = np.zeros(len(begin))
    if len(where):
        segment = np.searchsorted(begin, where, side="right") - 1
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        out[segment[starts]] = np.maximum.reduceat(score, starts)
    return out


def score(scales: tuple[int, ...], keys: list[str]):
    """For ``mapInArrow``: the keys of each row with ``simple`` and the scores of its pair.

    Columns: the keys, plain, a_ints, a_nums, b_ints, b_nums, and a_n, a_codes, b_n, b_codes, what each side has in all.
    A pair is not simple, and has no scores, if it is not plain or has one code under two texts.
    """
    def run(batches):
        for batch in batches:
            of, rows = batch.column, batch.num_rows
            a_at, a = _lists(of("a_ints"), 2)
            b_at, b = _lists(of("b_ints"), 2)
            a_nums, b_nums = (_lists(of(c), 3, scales)[1] for c in ("a_nums", "b_nums"))
            owner = np.repeat(np.arange(rows), np.diff(a_at))
            clash, total = np.zeros(rows, bool), np.zeros((5, rows))
            with np.errstate(all="ignore"):
                for line, begin, i, j in crossed(a_at, b_at):
                    price, amount = numeric(a_nums[i, 1], b_nums[j, 1]), numeric(a_nums[i, 0], b_nums[j, 0])
                    rate = np.maximum.reduceat((price + amount) / 2, begin)
                    same = a[i, 0] == b[j, 0]
                    other = ~same & (a[i, 1] >> 2 == b[j, 1] >> 2)
                    row = owner[line - a_at[0]]
                    if other.any():
                        clash[owner[i[other] - a_at[0]]] = True
                    s = np.flatnonzero(same)
                    x, y, one = i[s], j[s], np.ones(len(s))
                    item = _best(weighted([(np.where(a[x, 1] & 2, 1.0, np.nan), 0.40), (one, 0.25), (ratio(a_nums[x, 1], b_nums[y, 1]), 0.20),
                                           (ratio(a_nums[x, 2], b_nums[y, 2]), 2 * 0.15)]), s, begin)
                    equal = _best(one * 0.3 + one * 0.3 + amount[s] * 0.2 + price[s] * 0.2, s, begin)
                    shared = (_best(one, s, begin) > 0) & (a[line, 1] & 1 > 0)
                    for k, (kept, values) in enumerate(((item > 0.80, item), (item > 0.80, None), (equal > 0.7, equal), (rate > 0.8, rate), (shared, None))):
                        total[k] += np.bincount(row[kept], None if values is None else values[kept], rows)
                n, m, codes, their = (of(c).to_numpy().astype(float) for c in ("a_n", "b_n", "a_codes", "b_codes"))
                either = codes + their - total[4]
                hsn = np.where(either != 0, total[4] / either, 0.0)
                found = [total[1].astype(np.int64), total[4].astype(np.int64), total[0] / n, total[2] / np.maximum(n, m), hsn, total[3] / np.maximum(n, m)]
            simple = of("plain").to_numpy(zero_copy_only=False).astype(bool) & ~clash
            found = [np.where(np.isnan(f), 0, f) if f.dtype == float else f for f in found]
            yield pa.RecordBatch.from_arrays(
                [*[of(k) for k in keys], pa.array(simple), *[pa.array(f) for f in found]],
                [*keys, "simple", "matching_products", "shared_codes", "product_score", "line_score", "hsn_ratio", "rate_score"])
    return run


#: Comparisons of texts that a task remembers.
REMEMBERED = 500_000
NO_ID = np.iinfo(np.int64).min


def best(scales: tuple[int, ...], compare, keys: list[str], known: dict | None = None):
    """For ``mapInArrow``: for every line id of a row's one side the best line of the other by weighted similarity, of equals the
    smallest id: the keys, item_id, other_item, similarity. Two texts are compared by ``compare`` once a task, and only
    where, by their lengths, they can decide.

    Columns: the keys, and for either side ``ints`` (id, hash of the code, 0 if it is empty), ``nums`` (price, taxable value), ``texts``.
    """
    known = {} if known is None else known

    def texts(one, other):
        found = np.empty(len(one))
        for k, pair in enumerate(zip(one, other)):
            if pair not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[pair] = compare(*pair)
            found[k] = known[pair]
        return found

    def run(batches):
        for batch in batches:
            of = batch.column
            a_at, a = _lists(of("a_ints"), 2)
            b_at, b = _lists(of("b_ints"), 2)
            a_nums, b_nums = (_lists(of(c), 2, scales)[1] for c in ("a_nums", "b_nums"))
            own = of("a_texts").values
            coded = pa.concat_arrays([own, of("b_texts").values]).dictionary_encode()
            word, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            size, a_text, b_text = np.array([len(w) for w in word], float), place[:len(own)], place[len(own):]
            owner, out = np.repeat(np.arange(batch.num_rows), np.diff(a_at)), []
            with np.errstate(all="ignore"):
                for line, begin, i, j in crossed(a_at, b_at):
                    t, u = a_text[i], b_text[j]
                    worded, equal = (size[t] > 0) & (size[u] > 0), t == u
                    code = np.where((a[i, 1] != 0) & (b[j, 1] != 0), (a[i, 1] == b[j, 1]).astype(float), np.nan)
                    rest = [(code, 0.25), (ratio(a_nums[i, 0], b_nums[j, 0]), 0.20), (ratio(a_nums[i, 1], b_nums[j, 1]), 2 * 0.15)]

                    def total(text):
                        return weighted([(np.where(worded, text, np.nan), 0.40), *rest])
                    least = total(np.where(equal, 1.0, 0.0))
                    most = total(np.where(equal, 1.0, 2.0 * np.minimum(size[t], size[u]) / (size[t] + size[u])))
                    count = np.diff(np.append(begin, len(i)))
                    open_ = most >= np.repeat(np.maximum.reduceat(least, begin), count)
                    text, asked = np.where(equal, 1.0, 0.0), np.flatnonzero(open_ & worded & ~equal)
                    pairs, back = np.unique(t[asked].astype(np.int64) * len(word) + u[asked], return_inverse=True)
                    text[asked] = texts([word[p] for p in pairs // len(word)], [word[p] for p in pairs % len(word)])[back] if len(pairs) else 0.0
                    similarity = np.where(open_, total(text), -1.0)
                    top = np.maximum.reduceat(similarity, begin)
                    ids = np.where(b[j, 0] == NO_ID, np.iinfo(np.int64).max, b[j, 0])
                    other = np.minimum.reduceat(np.where(similarity == np.repeat(top, count), ids, np.iinfo(np.int64).max), begin)
                    out.append((owner[line - a_at[0]], a[line, 0], top, other))
            if not out:
                continue
            row, item, top, other = (np.concatenate(c) for c in zip(*out))
            # A line id that stands twice in an invoice is one line.
            order = np.lexsort((other, -top, item, row))
            row, item, top, other = row[order], item[order], top[order], other[order]
            first = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
            row, item, top, other = row[first], item[first], top[first], other[first]
            yield pa.RecordBatch.from_arrays(
                [*[of(k).take(pa.array(row)) for k in keys], pa.array(item, mask=item == NO_ID),
                 pa.array(other, mask=(top <= 0) | (other == np.iinfo(np.int64).max)), pa.array(top)], [*keys, "item_id", "other_item", "similarity"])
    return run
