"""A Merkle manifest of a table and an octopus multiproof of its rows.

Every row is a leaf: the sha256 of its fields, each as its UTF-8 byte count, ':' and its value, or
'-' if null. The leaves of a group stand in the order of their key; each 8 consecutive nodes become
the sha256 of their digests (hex text) until one is left, the group's subroot. The subroots, in the
order of their groups (null first, bytewise), are the leaves of one more tree, which gives the root.

Proofs. A leaf partition is a block of 8**4 consecutive leaves. It works out the minimal union of
the node coordinates that it cannot derive from its own leaves (missing()), fetches their digests in
one join, derives the nodes that its proofs share, and expands each row's proof inside the task. What
a block fetches is at most 7 digests a level, however many rows there are.

Positions come from a range partitioning: a row's place in its partition, plus the rows of its
group in the partitions before, of which there is one count a partition and group. Nothing is
numbered in one task, and a group that holds most rows spans as many partitions and blocks as
that takes.

Defined cases: null fields are '-', and no text is like another one with it. A null group is a group
of its own and comes first. Rows with a null key follow those with one, ordered by leaf; so do rows
with equal keys. Repeated rows are leaves of their own. An empty table has no leaf and no root, and
gives an empty result. A lone leaf is its group's subroot, a lone subroot the root. Columns that are
not fields are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import partitions, staged

ARITY = 8
#: Levels of a leaf partition: 8**4 leaves, a few hundred KB, whatever the table's size.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: array<string>, right: array<string>>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes on a level of a tree with so many leaves."""
    return -(-size // ARITY ** level)


def height(size: int) -> int:
    """The level of the one node that is left."""
    level = 0
    while width(size, level) > 1:
        level += 1
    return level


def missing(known: Iterable[int], level: int, size: int) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes which, with the known ones of a level, give all nodes above
    these: at each level the known nodes' siblings that are not known themselves."""
    known, need = set(known), []
    for at in range(level, height(size)):
        above = {i // ARITY for i in known}
        need += [(at, i) for p in sorted(above) for i in range(p * ARITY, min((p + 1) * ARITY, width(size, at))) if i not in known]
        known = above
    return need


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the values, each with its length."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of (grp, key, leaf, ...) with their index in their group (idx) and its size."""
    order = (F.col("grp"), F.col("key").asc_nulls_last(), F.col("leaf"))
    # The last number only parts rows that are equal in all of these, whose order does not matter.
    placed = staged(rows.repartitionByRange(partitions(rows.sparkSession), *order, F.rand(7)).sortWithinPartitions(*order)
                    .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    runs = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("part")) - F.col("n")
    runs = staged(runs.select("grp", "part", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("size")), "runs")
    return placed.join(runs, ["grp", "part"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def _block() -> Column:
    return F.expr(f"idx DIV {ARITY ** BLOCK_LEVELS}").alias("block")


def _levels(digests: list[str], size: int) -> list[list[str]]:
    """A block's nodes, level by level up to its only one."""
    levels = [digests]
    for _ in range(min(BLOCK_LEVELS, height(size))):
        below = levels[-1]
        levels.append([sha("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def _block_tops(numbered: DataFrame) -> DataFrame:
    """grp, size, level, idx, digest: the one node of each block."""
    def top(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        digests = table.select(["idx", "leaf"]).sort_by("idx")["leaf"].to_pylist()
        levels = _levels(digests, size)
        return pa.table({"grp": [key[0].as_py()], "size": [size], "level": pa.array([len(levels) - 1], pa.int32()),
                         "idx": [key[1].as_py()], "digest": [levels[-1][0]]})

    return (numbered.select("grp", _block(), "idx", "size", "leaf").groupBy("grp", "block")
            .applyInArrow(top, "grp string, size long, level int, idx long, digest string"))


def _nodes(tops: DataFrame) -> DataFrame:
    """All nodes from the tops of the blocks up to the tops of the trees; each level is an eighth of the one below."""
    highest = tops.agg(F.max("size")).first()[0] or 0
    parts, current = [tops], tops
    for level in range(BLOCK_LEVELS, height(highest) if highest else 0):
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        current = staged(current.filter(F.expr(f"size > {ARITY ** level}")).groupBy("grp", "size", F.expr(f"idx DIV {ARITY}").alias("up"))
                         .agg(F.sha2(F.array_join(F.transform(kids, lambda k: k["digest"]), ""), 256).alias("digest"))
                         .select("grp", "size", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "digest"), "level")
        parts.append(current)
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes


def _fetched(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """grp, block, fetched: the digests of the nodes that a block needs and cannot derive."""
    kinds = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())])

    def wanted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"grp": top["grp"], "block": top["block"], "level": level, "idx": i} for top in batch.to_pylist()
                                              for level, i in missing([top["block"]], top["level"], top["size"])], kinds)

    wants = tops.select("grp", F.col("idx").alias("block"), "level", "size").mapInArrow(wanted, "grp string, block long, level int, idx long")
    return wants.join(nodes.drop("size"), ["grp", "level", "idx"]).groupBy("grp", "block").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))


def _expanded(numbered: DataFrame, packages: DataFrame, each: Callable, schema: str) -> DataFrame:
    """What `each` makes of a block's rows. packages: grp, block, fetched and more, one row a block. each gets the block's rows as
    a table by idx, its package, and steps[level][i], the digests (left, right) that stand
    beside node i of the block on that level; above the block's own levels there is one node, 0, a level."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, package: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        size, first, given = rows["size"][0].as_py(), rows["idx"][0].as_py(), package.to_pylist()[0]
        known = {(n["level"], n["idx"]): n["digest"] for n in given["fetched"] or ()}
        steps = []
        for level, own in enumerate(_levels(rows["leaf"].to_pylist(), size)):
            if level == height(size):
                break
            if len(own) > 1 or level < BLOCK_LEVELS:
                runs = [own[i:i + ARITY] for i in range(0, len(own), ARITY)]
                steps.append([(r[:k], r[k + 1:]) for r in runs for k in range(len(r))])
        at, own = first // ARITY ** BLOCK_LEVELS, len(steps)
        for level in range(own, height(size)):
            start = at // ARITY * ARITY
            end = min(start + ARITY, width(size, level))
            steps.append([([known[level, i] for i in range(start, at)], [known[level, i] for i in range(at + 1, end)])])
            at //= ARITY
        return each(rows, given, steps)

    left = numbered.withColumn("block", _block()).groupBy("grp", "block")
    return left.cogroup(packages.groupBy("grp", "block")).applyInArrow(run, schema)


def _path(steps: list, i: int) -> list:
    """The step of leaf i of the block on each level."""
    return [on[i // ARITY ** level] if len(on) > 1 else on[0] for level, on in enumerate(steps)]


def _group_paths(subroots: DataFrame) -> DataFrame:
    """grp, subroot, above (the steps from the subroot to the root), root."""
    numbered = _numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("digest").alias("leaf")), "subroots")
    tops = staged(_block_tops(numbered), "tops")
    nodes = _nodes(tops)
    root = nodes.filter(F.expr(_is_top())).select("grp", F.col("digest").alias("root"))
    blocks = tops.select("grp", F.col("idx").alias("block")).join(_fetched(tops, nodes), ["grp", "block"], "left").join(root, "grp")

    def each(rows, given, steps):
        above = [[{"left": left, "right": right} for left, right in _path(steps, i)] for i in range(rows.num_rows)]
        return pa.table({"grp": rows["key"], "subroot": rows["leaf"],
                         "above": pa.array(above, pa.list_(pa.struct({"left": pa.list_(pa.string()), "right": pa.list_(pa.string())}))),
                         "root": pa.array([given["root"]] * rows.num_rows)})

    return _expanded(numbered, blocks, each, f"grp string, subroot string, above {PATH}, root string")


def _is_top() -> str:
    """On its level the node is alone: its tree has at most 8**level leaves."""
    return f"size <= CAST(power({ARITY}, level) AS BIGINT)"


def folded(digest: str, path: Iterable[tuple[Sequence[str], Sequence[str]]]) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for left, right in path:
        digest = sha("".join(left) + digest + "".join(right))
    return digest


def _forest(docs: DataFrame, key: str, group: str, fields: Sequence[str], claimed: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves, and for each block what it has to fetch."""
    leaf = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([claimed.get(f, F.col(f)) for f in fields]) if claimed else leaf
    # Not null, in the order of the groups: nothing for null, and '=' before the value of any other.
    group_text = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    digests = staged(docs.select(group_text.alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), other.alias("claimed")), "digests")
    numbered = _numbered(digests, "leaves")
    tops = staged(_block_tops(numbered), "tops")
    nodes = _nodes(tops)
    paths = staged(_group_paths(nodes.filter(F.expr(_is_top())).select("grp", "digest")), "group-paths")
    blocks = tops.select("grp", F.col("idx").alias("block")).join(_fetched(tops, nodes), ["grp", "block"], "left")
    return numbered, blocks.join(paths, "grp")


def verified(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
             claimed: dict[str, Column] | None = None) -> DataFrame:
    """For each row: key, leaf, subroot, root, proof_sha256 (of the proof's digests, level by level), folded_root (what
    the row as claimed and the proof lead to) and verified (that it is the root).

    claimed: values that a row is checked with in place of its own, by field.
    """
    numbered, packages = _forest(docs, key, group, fields, claimed or {})

    def each(rows, given, steps):
        root, above = given["root"], [(s["left"], s["right"]) for s in given["above"]]
        full = [[("".join(a), "".join(b)) for a, b in on] for on in steps] + [[("".join(a), "".join(b))] for a, b in above]
        rest = [""]  # the proof from a level upwards, by node; shared by all leaves below
        for on in reversed(full[1:]):
            rest = [a + b + rest[i // ARITY if len(rest) > 1 else 0] for i, (a, b) in enumerate(on)]
        proofs, ends = [], []
        for i, claim in enumerate(rows["claimed"].to_pylist()):
            a, b = full[0][i if len(full[0]) > 1 else 0] if full else ("", "")
            proofs.append(sha(a + b + rest[i // ARITY if len(rest) > 1 else 0]))
            ends.append(folded(claim, _path(full, i)))
        n = rows.num_rows
        return pa.table({key: rows["key"], "leaf": rows["leaf"], "subroot": pa.array([given["subroot"]] * n), "root": pa.array([root] * n),
                         "proof_sha256": pa.array(proofs), "folded_root": pa.array(ends), "verified": pa.array([e == root for e in ends])})

    kind = docs.schema[key].dataType.simpleString()
    return _expanded(numbered, packages, each, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                               "folded_root string, verified boolean")


def proofs(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS) -> DataFrame:
    """For each row: key, leaf, proof (the digests left and right of the row's node on each level, from leaf to root), root."""
    numbered, packages = _forest(docs, key, group, fields, {})

    def each(rows, given, steps):
        above = [(s["left"], s["right"]) for s in given["above"]]
        path = [[{"left": a, "right": b} for a, b in [*_path(steps, i), *above]] for i in range(rows.num_rows)]
        return pa.table({key: rows["key"], "leaf": rows["leaf"],
                         "proof": pa.array(path, pa.list_(pa.struct({"left": pa.list_(pa.string()), "right": pa.list_(pa.string())}))),
                         "root": pa.array([given["root"]] * rows.num_rows)})

    kind = docs.schema[key].dataType.simpleString()
    return _expanded(numbered, packages, each, f"`{key}` {kind}, leaf string, proof {PATH}, root string")
