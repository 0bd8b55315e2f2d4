"""Near-duplicates by bottom-k sketches from one hash function.

A document is its set of distinct shingles, hashed. Equal sets are one node from the start.

1. A node's sketch holds its k smallest hashes. Inverted lists of the retained values bring
   together nodes that share one. Two nodes over the threshold share at least `shared` of their
   values (but for a chance of 1e-9 a pair), so each node enters only the lists of its rarest
   values, as many as make sure that such a pair meets in one. Very frequent values are thus
   left out, unless nearly all values of a document are frequent.
2. In each list every node is compared with the list's centre, the node with the fewest values
   of its own: as many pairs as members. The overlap in the union's sketch filters them, the
   full sets decide.
3. Lists that still hold several components are opened up exactly. How many of a node's shingles
   others in such lists have shows a better centre, and members are compared with it. Then nodes
   are indexed by their rarest shingles of the full set, with positions (prefix filter), and pairs
   from different components that can reach the threshold by size, position and number of
   shared shingles are confirmed on the full sets. No list is spelled out into all its pairs.

Defined cases: a text without words, or null, is an empty set and linked with nothing. A text
with fewer words than a shingle is one shingle. Rows with a null id take part; a component is
named by its smallest id that is not null. Repeated rows get equal answers. An empty table gives
an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.bloom import bloom_filter, probe, string_digests, without
from ledgerloom.llm.common import map_texts, raw_text, staged
from ledgerloom.llm.components import components
from ledgerloom.llm.words import hashed_words, windows

MISS = 1e-9


def sure_overlap(k: int, percent: int) -> int:
    """The most retained values that two sets over the threshold share, but for a chance of MISS."""
    p, tail, shared = percent / 100, 0.0, 0
    while shared < k and (tail := tail + math.comb(k, shared) * p**shared * (1 - p) ** (k - shared)) <= MISS:
        shared += 1
    return max(1, shared)


def shingle_sets(texts: list[bytes], width: int):
    """Number of the text and its sorted distinct shingle hashes, 63 bits wide."""
    for first, hashes, offsets in hashed_words(texts, fold=True):
        for i in range(len(offsets) - 1):
            own = hashes[offsets[i]:offsets[i + 1]]
            yield first + i, np.unique(windows(own, min(width, len(own))) >> np.uint64(1)) if len(own) else own


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, node (the set's digest), size, sketch: its k smallest hashes."""
    def run(batches):
        for batch in batches:
            found = [(_node(s), len(s), s[:k].copy()) for _, s in shingle_sets(batch.column("raw").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.binary()), pa.array([n for _, n, _ in found], pa.int64()),
                 _lists([s for _, _, s in found])], ["doc_id", "node", "size", "sketch"])

    return map_texts(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, size long, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """nid, hashes of the wanted nodes. Which documents are read again is asked of a Bloom filter of their
    ids, whose size is bounded; what it lets through besides is dropped in the join."""
    named = wanted.select(string_digests("doc_id").alias("digest"))
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(named, named.count(), 1))

    def run(batches):
        packed, bits = bloom.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raws = batch.column("raw").to_pylist()
            ask = np.flatnonzero(probe(batch.column("digest").to_pylist(), packed, bits))
            found = [s for _, s in shingle_sets([raws[i] for i in ask], width)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.binary()), _lists(found)], ["node", "hashes"])

    sets = map_texts(docs.withColumn("digest", string_digests("doc_id")), run, "node binary, hashes array<long>")
    return sets.join(wanted.select("node", "nid"), "node").select("nid", "hashes")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.select(F.col("nid").alias("a"), F.col("hashes").alias("of_a")), sets.select(F.col("nid").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(f"100 * both >= {percent} * (size(of_a) + size(of_b) - both)").select("a", "b").distinct()


def _sketched(pairs: DataFrame, nodes: DataFrame, k: int, shared: int) -> DataFrame:
    """Pairs whose estimate from the union's k smallest values leaves the threshold possible."""
    left, right = nodes.select(F.col("nid").alias("a"), F.col("sketch").alias("of_a")), nodes.select(F.col("nid").alias("b"), F.col("sketch").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("union", F.slice(F.array_sort(F.array_union("of_a", "of_b")), 1, k))
    seen = F.size(F.array_intersect(F.array_intersect("of_a", "of_b"), "union"))
    return both.filter(seen >= F.least(F.lit(shared), F.ceil(F.size("union") * shared / k))).select("a", "b")


def _near_size(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _rare_lists(nodes: DataFrame, k: int, percent: int, shared: int) -> DataFrame:
    """value, nid, size, alone (retained values no other node has): each node in the lists of its rarest values."""
    entries = nodes.select("nid", "size", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    counts = entries.groupBy("value").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    # Sets of at most k shingles: the overlap they need, less what a larger partner's sketch may leave out.
    need = F.expr(f"greatest(1, least({shared}, cast((size * {percent} + 99) div 100 - greatest(0, size * 100 div {percent} - {k}) AS int)))")
    common = entries.join(counts, "value").groupBy("nid").agg(
        F.first("size").alias("size"), F.first("held").alias("held"), F.sort_array(F.collect_list(F.struct("many", "value"))).alias("values"))
    common = common.withColumn("alone", F.col("held") - F.size("values")).withColumn("taken", F.when(F.col("size") <= k, F.col("held") - need + 1).otherwise(F.col("held") - shared + 1) - F.col("alone"))
    return common.filter("taken > 0").select("nid", "size", "alone", F.explode(F.expr("slice(values, 1, taken)")).alias("v")).select(
        F.col("v.value").alias("value"), "nid", "size", "alone")


def _roots(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows with a column root; a node that is linked with nothing is its own."""
    return rows.join(comps.select(F.col("node").alias("of"), "root"), F.col("nid") == F.col("of"), "left").withColumn("root", F.coalesce("root", "nid")).drop("of")


def _open_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of lists that hold several components."""
    held = _roots(lists, comps)
    spans = held.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("value")
    return held.join(spans, "value").select("value", "nid", "size", "root")


def _over(percent: int) -> str:
    """The shared shingles that two sets need."""
    return f"(({percent} * (size + size2) + {100 + percent} - 1) div {100 + percent})"


def _index(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hash, nid, size, common (shingles that another of the nodes has), place: each node under its rarest
    common shingles, as many as its best partner may not leave out; place counts its unshared ones first."""
    shingles = staged(nodes.join(sets, "nid").select("nid", "size", F.explode("hashes").alias("hash")), "shingles")
    counts = shingles.groupBy("hash").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    ranked = shingles.join(counts, "hash").groupBy("nid").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("many", "hash"))).alias("values"))
    ranked = ranked.withColumn("common", F.size("values").cast("long")).withColumn(
        "taken", F.expr(f"cast(size - (size * {percent} + 99) div 100 + 1 - (size - common) AS int)")).filter("taken > 0")
    return ranked.select("nid", "size", "common", F.posexplode(F.expr("slice(values, 1, taken)")).alias("at", "v")).select(
        F.col("v.hash").alias("hash"), "nid", "size", "common", (F.col("at") + F.col("size") - F.col("common")).alias("place"))


def _centre_pairs(opened: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """In each open list its members against the one with the fewest shingles of its own."""
    held = opened.join(index.select("nid", "common").distinct(), "nid")
    centre = staged(held.groupBy("value").agg(F.min(F.struct((F.col("size") - F.col("common")).alias("own"), "nid", "size", "common", "root")).alias("c")).select(
        "value", F.col("c.nid").alias("a"), *(F.col(f"c.{x}").alias(f"{x}2") for x in ("size", "common", "root"))), "centres")
    return held.join(centre, "value").filter(f"root != root2 AND {_near_size('size', 'size2', percent)} AND least(common, common2) >= {_over(percent)}").select(
        "a", F.col("nid").alias("b")).distinct()


def _open_pairs(index: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs over components that can reach the threshold, by size and by places in the lists of the index."""
    rooted = staged(_roots(index, comps), "rooted")
    parts = rooted.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("members"))
    major = parts.groupBy("hash").agg(F.max(F.struct("members", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    major = staged(major.select("hash", F.col("top.root").alias("major")), "major")
    minor = rooted.join(major, "hash").filter("root != major")
    other = rooted.select("hash", *(F.col(c).alias(f"{c}2") for c in ("nid", "size", "root", "common", "place")))
    meets = F.expr(f"root != root2 AND {_near_size('size', 'size2', percent)} AND least(common, common2) >= {_over(percent)} "
                   f"AND place <= size - {_over(percent)} AND place2 <= size2 - {_over(percent)} AND (root2 = major OR nid < nid2)")
    return minor.join(other, (minor["hash"] == other["hash"]) & meets).select(F.col("nid").alias("a"), F.col("nid2").alias("b")).distinct()


def classes(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * intersection >= percent * union of their sets of distinct
    `width`-word shingles (A-Z lower-cased). component_id is the smallest doc_id reachable over links.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), raw_text(text_col).alias("raw"))
    rows = staged(sketches(given, width, k), "sketches")
    shared = sure_overlap(k, percent)
    nodes = rows.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    lists = staged(_rare_lists(nodes, k, percent, shared), "lists")
    centre = staged(lists.groupBy("value").agg(F.min(F.struct("alone", "nid", "size")).alias("c"), F.count(F.lit(1)).alias("members")).filter("members > 1").select(
        "value", F.col("c.nid").alias("a"), F.col("c.size").alias("size_a")), "centres")
    lists = lists.join(centre.select("value"), "value", "left_semi")
    stars = lists.join(centre, "value").filter(f"a != nid AND {_near_size('size', 'size_a', percent)}").select("a", F.col("nid").alias("b")).distinct()

    wanted = lists.select("nid").distinct().join(nodes, "nid").select("nid", "node", "doc_id")
    sets = staged(full_sets(given, staged(wanted, "wanted"), width), "sets")
    links = staged(_confirmed(_sketched(stars, nodes, k, shared), sets, percent), "links")
    comps = staged(components(links), "components")
    opened = staged(_open_lists(lists, comps), "opened")
    index = staged(_index(opened.select("nid", "size").distinct(), sets, percent), "index")
    for pairs in (_centre_pairs(opened, index, percent), None):
        pairs = pairs if pairs is not None else _open_pairs(index, comps, percent)
        late = staged(_confirmed(_sketched(pairs, nodes, k, shared), sets, percent), "links")
        if not late.isEmpty():
            links = links.unionByName(late)
            comps = staged(components(links), "components")

    label = staged(_roots(nodes.select("nid", "node", "doc_id"), comps).select("node", "doc_id", "root"), "labels")
    named = staged(label.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    member = staged(label.join(named, "root").select("node", "component_id"), "members")
    out = rows.filter("size > 0").join(member, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    out = out.unionByName(rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows of one document of each class, and those linked with nothing. A row without an id
    cannot be told from others of that kind and stays."""
    gone = classes(docs, width, percent, k, id_col, text_col).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    return without(docs, staged(gone, "gone"), id_col)
