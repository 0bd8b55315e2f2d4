"""Language by the nearest of several centroids a language.

A text is a vector of its byte n-grams (one to three bytes of lower-cased words), hashed to DIMS
places, weighted by TF-IDF and brought to length 1. Each language's sample is clustered (spherical
k-means); a text goes to the language of the centroid with the largest cosine. A cosine below
what nearly all of the centroid's own members reach marks the text as rejected: it is like no
language that was learnt.

Centroids are learnt on the driver from about `each` documents a language (chosen by a hash of the
id, never one that is held out): a bound by the number of languages, whatever the size of the table.

Defined cases: a text that is null or has no letter is `und` with score 0. Without any language to
learn from all texts are `und`. Repeated rows get equal answers. Rows without a language teach
nothing. Columns other than id, text and lang are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import held_out, map_texts

DIMS_BITS = 13
DIMS = 1 << DIMS_BITS
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 18


def has_letter(text: str) -> bool:
    # The pattern lets number signs such as a raised two through.
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Bytes that are no part of words count as one separator; A-Z count as a-z.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of a text occurs, over the whole text in pieces."""
    data = np.frombuffer(text.encode(), np.uint8)
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(data), _CHUNK):
        b = _FOLD[data[max(0, at - 2):at + _CHUNK]]
        code = np.zeros(len(b), np.uint32)
        for n in range(3):
            code = (code[:len(b) - n] * np.uint32(257) + b[n:] + np.uint32(1 + n)) if n else b + np.uint32(1)
            fresh = code[max(0, min(2, at) - n):]  # n-grams that end in the piece before were counted with it
            total += np.bincount((fresh * _KEYS[n]) >> np.uint32(32 - DIMS_BITS), minlength=DIMS)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.stack([np.log1p(counts(t)).astype(np.float32) for t in texts]) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is farther than a centroid's members for each text."""
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        found, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(known), 64):
            some = known[at:at + 64]
            near = vectors([texts[i] for i in some], self.idf) @ self.centres.T
            best = near.argmax(axis=1)
            for row, (i, c) in enumerate(zip(some, best)):
                found[i], score[i], far[i] = self.languages[c], min(1.0, max(0.0, float(near[row, c]))), near[row, c] < self.least[c]
        return found, score, far


def _clusters(rows: np.ndarray, k: int, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres of length 1 and each row's cluster; starts from rows that are far from each other."""
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centres = rows[chosen]
    for _ in range(steps):
        own = (rows @ centres.T).argmax(axis=1)
        centres = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres, (rows @ centres.T).argmax(axis=1)


def fit(samples: list[tuple[str, np.ndarray]], k: int = 3) -> Centroids:
    """From (language, counts): k centroids a language. A cosine under the lowest 0.5 % of a centroid's members, less a tenth, is far."""
    if not samples:
        return Centroids(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    raw = np.stack([np.log1p(c).astype(np.float32) for _, c in samples])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = raw * idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    names, centres, languages, least = np.array([l for l, _ in samples]), [], [], []
    for name in sorted(set(names)):
        own = rows[names == name]
        found, which = _clusters(own, k)
        for c in range(len(found)):
            cosines = (own @ found[c])[which == c]
            centres.append(found[c])
            languages.append(str(name))
            least.append(0.9 * float(np.quantile(cosines, 0.005)) if len(cosines) else 1.0)
    return Centroids(idf, np.stack(centres), languages, np.array(least))


def learn(docs: DataFrame, each: int = 300, k: int = 3) -> Centroids:
    """Centroids from about `each` documents a language that are not held out and have a letter."""
    given = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    many = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return fit([])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.create_map(*(x for lang, n in sorted(many.items()) for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, each / n))))))[F.col("lang")]

    def run(batches):
        for batch in batches:
            rows = [(i, l, counts(t)) for i, l, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], batch.schema.field("doc_id").type), pa.array([l for _, l, _ in rows], pa.string()),
                                              pa.array([c.astype("<u4").tobytes() for _, _, c in rows], pa.binary())], ["doc_id", "lang", "counts"])

    kind = given.schema["doc_id"].dataType.simpleString()
    found = sorted((r["lang"], r["doc_id"], bytes(r["counts"])) for r in map_texts(given.filter(place < bound).select("doc_id", "lang", "text"), run, f"doc_id {kind}, lang string, counts binary").collect())
    return fit([(lang, np.frombuffer(c, "<u4")) for lang, _, c in found], k)


def predictions(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine), rejected for each input row."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found, score, far = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return map_texts(given, run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
