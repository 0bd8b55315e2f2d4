"""Quality scores by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins and some pairs of features have one over pairs of
bins. Cyclic boosting fills them: round by round every table gets the leaf values of one shallow
tree on its own feature or pair, by the gradient of the log loss. A document's score is the sum of
its entries, as a probability. Features are read from the whole text alone.

The model learns on the driver from about `most` labelled documents (chosen by a hash of the id,
never one that is held out), a fixed bound whatever the size of the tables.

Defined cases: a null text is empty. Labels that are null or that contradict each other are not
learnt from. Without labels of both kinds the score is the share of label 1 among them, or 0.5.
Repeated rows get equal scores. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import held_out, map_texts, raw_text
from ledgerloom.llm.words import hashed_words

FEATURES = ("log_bytes", "upper", "shouts", "bars", "marks", "digits", "distinct", "repeated", "word_length", "stops", "commas",
            "lines", "distinct_lines", "high_bytes", "pauses", "odd_bytes")


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_MARKS, _STOPS, _PAUSES = _bytes("#$%&*@^~<>=+_\\/{}[]"), _bytes(".?"), _bytes(";:()\"'-")


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, hashes, offsets in hashed_words(texts):
        for i in range(len(offsets) - 1):
            raw, own = texts[first + i], hashes[offsets[i]:offsets[i + 1]]
            n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            words, size = max(1, len(own)), max(1, len(raw))
            upper, lower, lines = n[65:91].sum(), n[97:123].sum(), raw.split(b"\n")
            out[first + i] = (
                np.log1p(len(raw)), upper / max(1, upper + lower), n[33] / words, n[124] / words, n[_MARKS].sum() / words,
                n[48:58].sum() / size, len(np.unique(own)) / words, np.count_nonzero(own[1:] == own[:-1]) / words,
                size / words, n[_STOPS].sum() / words, n[44] / words, np.log1p(len(lines)), len(set(lines)) / len(lines),
                n[128:].sum() / size, n[_PAUSES].sum() / words, (n[:9].sum() + n[14:32].sum() + n[127]) / size)
    return out


@dataclass
class Additive:
    """Cuts between bins, tables by feature and by pair of features, and the constant."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    constant: float = 0.0

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, rows[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        bins = self.bins(rows)
        total = np.full(len(rows), self.constant)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut through bins with these gradients and curvatures."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > least) & (hr > least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]) - g.sum()**2 / (h.sum() + 1), at + 1) if len(gain) and gain[at] >= 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> np.ndarray:
    """Leaf values over the bins of one feature, by a tree of depth two."""
    out = np.full(len(g), g.sum() / (h.sum() + 1))
    gain, at = _best_cut(g, h, least)
    if gain <= 0:
        return out
    for part in (slice(0, at), slice(at, len(g))):
        more, inner = _best_cut(g[part], h[part], least)
        cuts = (part.start, part.start + inner, part.stop) if more > 0 else (part.start, part.stop)
        for a, b in zip(cuts, cuts[1:]):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> tuple[float, np.ndarray]:
    """Gain and leaf values over the bins of two features: a cut along one, then one along the other in each part."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + 1)))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for at in range(1, gg.shape[0]):
            out, gain = np.empty(gg.shape), -gg.sum()**2 / (hh.sum() + 1)
            for part in (slice(0, at), slice(at, gg.shape[0])):
                gp, hp = gg[part].sum(0), hh[part].sum(0)
                inner = _best_cut(gp, hp, least)[1]
                for cols in (slice(0, inner), slice(inner, len(gp))) if inner else (slice(0, len(gp)),):
                    gain += gp[cols].sum()**2 / (hp[cols].sum() + 1)
                    out[part, cols] = gp[cols].sum() / (hp[cols].sum() + 1)
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pairs: int = 6, pair_rounds: int = 30) -> Additive:
    share = float(labels.mean()) if len(labels) else 0.5
    constant = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(labels) or share in (0.0, 1.0):
        return Additive([np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), constant=constant)
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(rows.shape[1])]
    model = Additive(cuts, [np.zeros(len(c) + 1) for c in cuts], constant=constant)
    at, total = model.bins(rows), np.full(len(rows), constant)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(at[:, j], labels - p, len(table)), np.bincount(at[:, j], p * (1 - p), len(table)))
            table += step
            total += step[at[:, j]]

    def by_pair(a: int, b: int) -> tuple[float, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(cuts[a]) + 1, len(cuts[b]) + 1)
        flat = at[:, a] * shape[1] + at[:, b]
        return _pair_tree(*(np.bincount(flat, w, shape[0] * shape[1]).reshape(shape) for w in (labels - p, p * (1 - p))))

    ranked = sorted(((by_pair(a, b)[0], a, b) for a in range(len(cuts)) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(cuts[a]) + 1, len(cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            step = rate * by_pair(a, b)[1]
            table += step
            total += step[at[:, a], at[:, b]]
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = 12_000, label_col: str = "quality") -> Additive:
    """The model from about `most` labelled documents that are not held out."""
    known = (labels.select("doc_id", F.col(label_col).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label"))
    count = known.count()
    # Rows whose hash falls under a bound chosen for the number wanted.
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, count))))
    given = docs.select("doc_id", raw_text().alias("raw")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            rows = features(batch.column("raw").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind, label = (given.schema[c].dataType.simpleString() for c in ("doc_id", "label"))
    found = sorted((r["doc_id"], r["label"], tuple(r["x"])) for r in map_texts(given, run, f"doc_id {kind}, label {label}, x array<double>").collect())
    return fit(np.array([x for _, _, x in found]).reshape(-1, len(FEATURES)), np.array([y for _, y, _ in found], float))


def scores(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each input row."""
    given = docs.select(F.col(id_col).alias("doc_id"), raw_text(text_col).alias("raw"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(features(batch.column("raw").to_pylist())))], ["doc_id", "score"])

    return map_texts(given, run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Additive, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The whole rows whose score is at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(shared.value.score(features(texts)) >= least, pa.bool_()))

    return map_texts(docs, run, docs.schema)
