"""Spelling variants against all pairs of words, and the filters by themselves."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, form string"


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain(rows, least, times, every, factor):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= times}
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n}


def mutated(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1:]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    letters = "abcdeÀéÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words += ["aabbaabb", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Straße"]
    chain = [words[0] + "dd"]
    for _ in range(3):
        chain.append(mutated(rng, chain[-1], letters))
    words += [mutated(rng, rng.choice(words), letters) for _ in range(150)]
    out = [(i, " ".join(rng.choice(words).upper() if rng.random() < .2 else rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    out += [(100 + i, " ".join(w for k, w in enumerate(chain) for _ in range(2 * 11 ** k))) for i in range(1)]
    out += [(None, None), (201, ""), (202, " \n1 2"), (None, words[0] + " " + words[1]), (203, "x" * 50_000 + " " + "x" * 50_000), (203, "x" * 50_000), (7, out[7][1])]
    return out


@pytest.mark.parametrize(("least", "times", "every", "factor", "most_bytes"), [(7, 2, 31, 10, 1 << 20), (4, 1, 5, 2, 64), (6, 2, 31, 3, 200)])
def test_variants(spark, rows, least, times, every, factor, most_bytes):
    docs = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA).repartition(4)
    got = spelling.variants(spelling.vocabulary(docs, least, times, every), factor, most_bytes).collect()
    want = plain(rows, least, times, every, factor)
    assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want


def test_chain_of_forms(spark):
    """Several forms in a row: the root is the last."""
    words = spark.createDataFrame([("aaaaaaa", 1), ("aaaaaab", 20), ("aaaaabb", 400), ("aaaabbb", 9000), ("aaabbbb", 100_000), ("zzzzzzz", 1)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variants(words).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaabbbb") and got["aaabbbb"] == (None, "aaabbbb") and got["zzzzzzz"] == (None, "zzzzzzz")


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


def test_filters_hold_their_words_and_few_others(spark):
    """No word is missed, under one in a hundred strangers is let through, and no round is larger than its bound."""
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    for most in (1 << 20, 20_000):
        hits, strangers, wrong = 0, 0, 0
        others = [w for w in ("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(5_000)) if w not in set(words)]
        for filters in spelling.rounds({9: len(words)}, most):
            assert sum(f[3] * 8 for f in filters) <= most + 16
            own = [(share, shares, cells) for _, share, shares, cells in spelling._built(frame, filters)]
            hits += spelling._known(spelling._spread(spelling.hashes(spelling._letters(words)), 9), own).sum()
            wrong += spelling._known(spelling._spread(spelling.hashes(spelling._letters(others)), 9), own).sum()
        assert hits == len(words) and wrong < len(others) / 100


def test_hashes_of_edits_follow_from_the_word():
    """The look-ups of a word are those of its edits spelt out."""
    word, alphabet = "abbcdé", np.array(sorted(map(ord, "abcdeé")))
    blocks = 1 << 16
    for length in (5, 6):
        edits = {word[:i] + word[i + 1:] for i in range(6)} if length == 5 else {word[:i] + c + word[i + 1:] for i in range(6) for c in "abcdeé" if c > word[i]}
        cells = np.zeros(blocks, np.uint64)
        h = spelling._spread(spelling.hashes(spelling._letters(sorted(edits))), length)
        np.bitwise_or.at(cells, spelling._block(h, blocks), spelling._bits(h))
        found = [e for _, es in spelling.probed([word], alphabet, {length: [(0, 1, cells)]}) for e in es]
        assert sorted(found) == sorted(edits)
