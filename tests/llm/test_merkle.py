"""The manifest against a plain tree, on odd rows and on sizes around the limits of runs and blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, grp int, idx string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and for each leaf the digests left and right of it, level by level."""
    paths, own, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(own):
            run = level[at // 8 * 8:at // 8 * 8 + 8]
            paths[i].append((run[:at % 8], run[at % 8 + 1:]))
        level, own = [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)], [at // 8 for at in own]
    return level[0], paths


def plain(rows):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[g] = (members, *plain_tree([leaf(r) for r in members]))
    root, tops = plain_tree([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        members, subroot, paths = trees[g]
        for row, path in zip(members, paths):
            full = path + top
            told = list(row)
            if row[4] is not None:
                told[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            end = leaf(told)
            for a, b in full:
                end = sha("".join(a) + end + "".join(b))
            out.append((row[0], leaf(row), subroot, root, sha("".join("".join(a + b) for a, b in full)), end, end == root))
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(parts)


def checked(docs):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    claimed = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    return merkle.verified(docs, claimed=claimed).select(names)


def some_rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "", None]), rng.choice(langs), rng.choice([None, 5]), rng.choice([None, "", "Ab", "é b", "x" * 9])) for i in range(n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (1, [None]), (9, ["en"]), (65, [None, "en"]), (300, [None, "", "de", "en", "en", "ß"])])
def test_against_plain(spark, n, langs):
    rows = some_rows(n, langs)
    assert sorted(tuple(r) for r in checked(frame(spark, rows)).collect()) == sorted(plain(rows))


def test_more_than_a_block(spark):
    rows = some_rows(8 ** 4 + 8 ** 3 + 1, ["en"], 2) + [(10_000 + i, "s", f"g{i}", 1, "T") for i in range(70)]
    assert sorted(tuple(r) for r in checked(frame(spark, rows, 9)).collect()) == sorted(plain(rows))


def test_odd_rows(spark):
    """Null ids, repeated rows, equal ids with other texts, a very long text."""
    rows = [(None, "s", "en", 1, "B"), (None, "s", "en", 1, "a"), (None, None, None, None, None), (3, "s", "en", 1, "B"), (3, "s", "en", 1, "B"),
            (3, "s", "en", 1, "C"), (4, "s", "en", 1, "Word " * 400_000)]
    got = [tuple("" if v is None else v for v in r) for r in checked(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((tuple("" if v is None else v for v in r) for r in plain(rows)), key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(empty).count() == 0 and merkle.proofs(empty).count() == 0


def test_proofs_lead_to_the_root(spark):
    rows = some_rows(200, [None, "de", "en"])
    got = merkle.proofs(frame(spark, rows)).collect()
    roots = {r.root for r in got}
    assert len(got) == 200 and len(roots) == 1
    assert {merkle.folded(r.leaf, [(s.left, s.right) for s in r.proof]) for r in got} == roots
    assert merkle.folded(sha("other"), [(s.left, s.right) for s in got[0].proof]) not in roots


def test_missing_is_minimal():
    """Any set of leaves: with what is missing the root can be derived, without any of it it cannot."""
    rng = random.Random(3)

    def derived(known, size):
        for level in range(merkle.height(size)):
            for p in range(merkle.width(size, level + 1)):
                if all((level, i) in known for i in range(p * 8, min(p * 8 + 8, merkle.width(size, level)))):
                    known.add((level + 1, p))
        return (merkle.height(size), 0) in known

    for _ in range(40):
        size = rng.choice([1, 2, 8, 9, 64, 65, 500, 600])
        own = rng.sample(range(size), rng.randint(1, min(size, 20)))
        need = merkle.missing(own, 0, size)
        leaves = {(0, i) for i in own}
        assert len(set(need)) == len(need) and derived(leaves | set(need), size)
        for one in need:
            assert not derived((leaves | set(need)) - {one}, size)
