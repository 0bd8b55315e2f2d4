"""Secrets by rules and by a character network over every other candidate.

Rules give the base findings: assignments to secret-like names, access ids and long hex runs. Every
run of at least 16 token characters with a digit is a candidate. A small convolutional network reads
a candidate and its surroundings character by character.

The network learns from all documents. Candidates that a rule confirms are labelled findings, other
candidates and ordinary words are not; a text teaches with all windows of all its candidates, and with
two of its words, which are never scored. Half of the findings have their surroundings blanked, so the
shape of the token counts. Equal windows of one token teach once, so repeated texts weigh no more.

Windows are dealt by token to shards of about 100,000 (one, for a small table). In each epoch every
shard goes on from the common weights, over all of its windows; the next common weights are the mean
of theirs, by their windows. The driver holds weights and counts, never windows.

Of every shard every fourth distinct token of either label, with all its windows and wherever it
stands, is held out before findings are repeated to weigh half as much as the others. Only these
calibrate the probabilities and set the threshold at which the wanted share of findings is recalled;
their logits are counted in steps of a thousandth, downwards.

Every candidate is scored, also one that touches what a rule has found; it is added as kind `model`
unless a rule has found exactly that span.

Defined cases: a null text is empty. Without eight windows of findings in the whole table only
rules apply. Rows without an id teach nothing; a null or repeated id changes nothing else: each row is
answered by its text. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import map_texts, raw_text, staged

KINDS = ("assign", "access", "hex", "model")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS, _HEX, _HEX_RAW = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}"), re.compile(rb"[0-9a-f]{24}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")
#: What every text with a base finding holds, where a sample is asked for.
_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_DIGIT, _WORD = re.compile(rb"[0-9]"), re.compile(r"[^\W\d_]{8,}")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(raw: bytes, text: str | None = None) -> list[Span]:
    """What the rules find, by start and kind. Code points, end exclusive."""
    folded = raw.lower()
    named, access, hexed = any(n in folded for n in NAMES), b"AKIA" in raw, _HEX_RAW.search(raw)
    if not (named or access or hexed):
        return []
    text = raw.decode() if text is None else text
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if named else []
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if access else []
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)] if hexed else []
    return sorted(found)


def candidates(raw: bytes, text: str | None = None) -> list[tuple[int, int]]:
    if not _DIGIT.search(raw):
        return []
    return [m.span() for m in _CANDIDATE.finditer(raw.decode() if text is None else text)]


SIDE, BODY = 12, 40
WIDTH = BODY + 2 * SIDE


def windows_of(text: str, start: int, end: int, blank: bool = False) -> list[np.ndarray]:
    """Codes of the candidate with its surroundings; a long one gives several windows, which overlap."""
    out = []
    for at in range(start, max(start + 1, end - BODY // 2), BODY // 2):
        to = min(end, at + BODY)
        before, after = ("", "") if blank else (text[max(0, at - SIDE):at], text[to:to + SIDE])
        line = before.rjust(SIDE) + text[at:to].ljust(BODY) + after.ljust(SIDE)
        codes = np.array([ord(c) - 31 if 32 <= ord(c) < 127 else 96 for c in line], np.int64)
        inside = np.zeros(WIDTH, np.int64)
        inside[SIDE:SIDE + to - at] = 97
        out.append(codes + inside)
    return out


class Network:
    """Embedding, one convolution with ReLU, maximum and mean over places, one logistic unit."""

    def __init__(self, seed: int = 7, embed: int = 8, filters: int = 16, span: int = 5):
        rng = np.random.default_rng(seed)
        self.span = span
        self.w = {"e": rng.normal(0, 0.3, (2 * 97, embed)), "c": rng.normal(0, 1 / np.sqrt(span * embed), (span * embed, filters)),
                  "cb": np.zeros(filters), "d": rng.normal(0, 0.2, 2 * filters), "db": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        #: Running means of gradients and of their squares, and the steps taken.
        self.first, self.second, self.step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        embedded = self.w["e"][x]
        cols = np.concatenate([embedded[:, k:WIDTH - self.span + 1 + k] for k in range(self.span)], axis=2)
        act = np.maximum(cols @ self.w["c"] + self.w["cb"], 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1)
        return cols, act, top, pooled, pooled @ self.w["d"] + self.w["db"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 256])[4] for i in range(0, len(x), 256)]).astype(float) if len(x) else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, act, top, pooled, z = self._forward(x)
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / np.float32(len(y))
        f = act.shape[2]
        dpool = dz[:, None] * self.w["d"]
        dact = np.repeat(dpool[:, None, f:] / np.float32(act.shape[1]), act.shape[1], axis=1)
        np.put_along_axis(dact, top[:, None], np.take_along_axis(dact, top[:, None], 1) + dpool[:, None, :f], 1)
        dact *= act > 0
        dcols = dact @ self.w["c"].T
        e = self.w["e"].shape[1]
        dembed = np.zeros((*x.shape, e), np.float32)
        for k in range(self.span):
            dembed[:, k:WIDTH - self.span + 1 + k] += dcols[:, :, k * e:(k + 1) * e]
        flat, at = dembed.reshape(-1, e), x.ravel()
        de = np.stack([np.bincount(at, flat[:, j], len(self.w["e"])) for j in range(e)], axis=1)
        return {"e": de, "c": (cols.transpose(0, 2, 1) @ dact).sum(0), "cb": dact.sum((0, 1)), "d": pooled.T @ dz, "db": np.array([dz.sum()])}

    def epoch(self, x: np.ndarray, y: np.ndarray, order: np.ndarray, batch: int = 64, rate: float = 0.01) -> "Network":
        """One pass over the rows of x and y in the given order, by Adam."""
        y = y.astype(np.float32)
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            self.step += 1
            for k, g in self._gradients(x[rows], y[rows]).items():
                self.first[k] = np.float32(0.9) * self.first[k] + np.float32(0.1) * g.astype(np.float32)
                self.second[k] = np.float32(0.999) * self.second[k] + np.float32(0.001) * np.square(g, dtype=np.float32, casting="same_kind")
                self.w[k] = self.w[k] - np.float32(rate / (1 - 0.9**self.step)) * self.first[k] / (np.sqrt(self.second[k] / np.float32(1 - 0.999**self.step)) + np.float32(1e-8))
        return self

    def state(self) -> bytes:
        return b"".join(part[k].tobytes() for part in (self.w, self.first, self.second) for k in self.w)

    def mean_of(self, states: list[tuple[int, int, bytes]]) -> "Network":
        """Takes on the mean of the states of shards, each given as its rows, steps and state, by their rows."""
        total = sum(n for n, _, _ in states)
        flat = sum(np.frombuffer(state, np.float32).astype(float) * (n / total) for n, _, state in states)
        at, self.step = 0, max(step for _, step, _ in states)
        for part in (self.w, self.first, self.second):
            for k, old in part.items():
                part[k], at = flat[at:at + old.size].astype(np.float32).reshape(old.shape), at + old.size
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = 0.98) -> "Network":
        """Logistic calibration on what was not learnt from (n rows with logit z and label y), by Newton steps (a ridge keeps the scale finite
        where both kinds are apart). The threshold recalls enough; where more than one does, it lies midway to the others."""
        own, all_of = float(n[y > 0].sum()), float(n.sum())
        if not 0 < own < all_of:
            return self
        soft = np.where(y > 0, (own + 1) / (own + 2), 1 / (all_of - own + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, g = n * p * (1 - p), n * (p - soft)
            hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
            move = np.linalg.solve(hess, np.array([(g * z).sum() + a - 1, g.sum() + b]))
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        self.scale, self.shift = float(a), float(b)

        def at(label, rank):
            """The probability of this rank, from the lowest, of a label's rows."""
            p = 1 / (1 + np.exp(-np.clip(a * z[y == label] + b, -30, 30)))
            order = np.argsort(p, kind="stable")
            return float(p[order][np.searchsorted(np.cumsum(n[y == label][order]), rank, side="right")])
        most, least = at(1, int((1 - recall) * own)), at(0, int(all_of - own) - 1 - int(all_of - own) // 1000)
        self.threshold = (most + least) / 2 if least < most else most
        return self


@dataclass
class Finder:
    network: Network | None

    def spans(self, raw: bytes) -> list[Span]:
        text = raw.decode()
        base = base_spans(raw, text)
        if self.network is None:
            return base
        known = {(a, b) for a, _, b in base}
        rest = [span for span in candidates(raw, text) if span not in known]
        if not rest:
            return base
        parts = [windows_of(text, a, b) for a, b in rest]
        found = self.network.probabilities(np.array([w for p in parts for w in p]))
        ends = np.cumsum([len(p) for p in parts])
        return sorted(base + [(a, 3, b) for (a, b), e, p in zip(rest, ends, parts) if found[e - len(p):e].max() >= self.network.threshold])


def examples(raw: bytes, each: int | None = None) -> list[tuple[int, int, np.ndarray]]:
    """Labelled windows of one text, with the crc32 of the token: candidates by what the rules say (all, or at most
    `each` of either label), and two of its words."""
    text = raw.decode()
    base, out, taken = base_spans(raw, text), [], ([], [])
    for a, b in candidates(raw, text):
        taken[any(s < b and a < e for s, _, e in base)].append((zlib.crc32(text[a:b].encode()), a, b))
    for label, spans in enumerate(taken):
        for mark, a, b in sorted(spans)[:each]:
            out += [(label, mark, w) for w in windows_of(text, a, b)]
            out += [(1, mark, w) for w in windows_of(text, a, b, blank=True)[:1]] if label else []
    words = [m.span() for m in _WORD.finditer(text)]
    for a, b in (words[0], words[len(words) // 2]) if len(words) > 1 else words:
        if not any(s < b and a < e for s, _, e in base):
            mark = zlib.crc32(text[a:b].encode())
            out += [(0, mark, windows_of(text, a, b)[0]), (0, mark, windows_of(text, a, b, blank=True)[0])]
    return out


def held_tokens(marks: np.ndarray) -> np.ndarray:
    """Which rows hold every fourth distinct token: all rows of one token are on one side."""
    return np.unique(marks, return_inverse=True)[1] % 4 == 3


def _shards(batches):
    """(shard, labels, windows, which are held out) of rows that come shard by shard."""
    def closed(rows):
        y, marks = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
        x, held = np.concatenate([r[3] for r in rows]), np.zeros(len(y), bool)
        for label in (0, 1):
            held[y == label] = held_tokens(marks[y == label])
        return rows[0][0], y, x, held
    rows: list = []
    for batch in batches:
        shard, y, marks = (batch.column(c).to_numpy() for c in ("shard", "label", "mark"))
        x = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if rows and rows[0][0] != shard[a]:
                yield closed(rows)
                rows = []
            if b > a:
                rows.append((int(shard[a]), y[a:b], marks[a:b], x[a:b]))
    if rows:
        yield closed(rows)


def _some(docs: DataFrame, most: int | None, most_found: int | None, id_col: str, text_col: str) -> DataFrame:
    """About `most` documents and about `most_found` of those that may hold a finding, by a hash of id and text; all where neither is given."""
    if most is None and most_found is None:
        return docs
    hinted = F.coalesce(F.col(text_col).rlike(_HINT), F.lit(False))
    counts = docs.agg(F.count("*").alias("all"), F.count_if(hinted).alias("hinted")).first()
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30))

    def bound(wanted, of):
        return F.lit((1 << 30) if wanted is None else int((1 << 30) * min(1.0, wanted / max(1, of))))
    return docs.filter((place < bound(most, counts["all"])) | ((place < bound(most_found, counts["hinted"])) & hinted))


def learn(docs: DataFrame, most: int | None = None, most_found: int | None = None, each: int | None = None, id_col: str = "doc_id",
          text_col: str = "text", epochs: int = 8, seed: int = 7, in_shard: int = 100_000) -> Finder:
    """The network from all documents, or from about `most` of them and about `most_found` of those that may hold a finding."""
    given = _some(docs.filter(F.col(id_col).isNotNull()), most, most_found, id_col, text_col).select(raw_text(text_col).alias("raw"))

    def run(batches):
        for batch in batches:
            found = {(label, mark, w.astype(np.uint8).tobytes()) for raw in batch.column("raw").to_pylist() for label, mark, w in examples(raw, each)}
            labels, marks, codes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(marks, pa.int64()), pa.array(codes, pa.binary())], ["label", "mark", "codes"])

    windows = staged(map_texts(given, run, "label int, mark long, codes binary").distinct(), "secret-windows")
    counts = windows.agg(F.count_if(F.col("label") == 1).alias("own"), F.count_if(F.col("label") == 0).alias("others")).first()
    own, others = counts["own"], counts["others"]
    if own < 8 or not others:
        return Finder(None)
    # What is learnt from has its findings repeated to weigh half as much as the others.
    repeated, parts = max(1, others // (2 * own)), -(-(own + others) // in_shard)
    # A file holds whole shards, one after the other, and is one row group.
    dealt = staged(windows.select(F.pmod(F.hash("mark"), F.lit(parts)).alias("shard"), "label", "mark", "codes")
                   .repartition(parts, "shard").sortWithinPartitions("shard", "label", "mark", "codes"), "secret-shards")
    network = Network(seed)
    for epoch in range(epochs):
        def learnt(batches, now=network, epoch=epoch):
            import copy

            for shard, y, x, held in _shards(batches):
                mine, rest = np.flatnonzero(~held & (y > 0)), np.flatnonzero(~held & (y == 0))
                order = np.random.default_rng([seed, epoch, shard]).permutation(np.concatenate([rest, *[mine] * repeated]))
                if len(order):
                    net = copy.deepcopy(now).epoch(x, y, order)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(order)], pa.int64()), pa.array([net.step], pa.int64()), pa.array([net.state()], pa.binary())],
                                                     ["shard", "n", "step", "state"])
        states = sorted((r["shard"], r["n"], r["step"], bytes(r["state"])) for r in dealt.mapInArrow(learnt, "shard int, n long, step long, state binary").collect())
        network.mean_of([s[1:] for s in states])

    def judged(batches, now=network):
        for _, y, x, held in _shards(batches):
            steps = np.floor(now.logits(x[held]) * 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(y[held], pa.int32()), pa.array(steps, pa.int64())], ["label", "step"])

    # As many rows as logits have steps, however many windows there are.
    seen = dealt.mapInArrow(judged, "label int, step long").groupBy("label", "step").count().orderBy("label", "step").toArrow()
    y, z, n = (seen.column(c).to_numpy().astype(float) for c in ("label", "step", "count"))
    return Finder(network.calibrate(z / 1000, y, n))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def findings(docs: DataFrame, finder: Finder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans for each input row."""
    given = docs.select(F.col(id_col).alias("doc_id"), raw_text(text_col).alias("raw"))
    shared = docs.sparkSession.sparkContext.broadcast(finder)

    def run(batches):
        for batch in batches:
            found = [shared.value.spans(raw) for raw in batch.column("raw").to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(4)]
            sums = [hashlib.sha256(_joined([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(sums, pa.string()), pa.array([_joined(f) for f in found], pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return map_texts(given, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
