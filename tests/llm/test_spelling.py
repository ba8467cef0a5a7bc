"""Spelling variants against brute force, and the automata themselves."""

import random
import re
import zlib
from collections import Counter

import pytest

from karyon.llm import spelling
from karyon.llm.spelling import Automaton, near_words, spelling_groups, typed_words, vocabulary

from . import edges


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_error(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


def random_counts(seed, letters, sizes, n):
    own = random.Random(seed)
    words = {"".join(own.choice(letters) for _ in range(own.choice(sizes))) for _ in range(n)}
    return {w: own.choice([5, 6, 7, 30, 31, 200, 1100]) for w in words}


@pytest.mark.parametrize("letters,sizes", [("ab", range(2, 9)), ("abcÀÿ×", range(4, 8)), ("aé🙂", range(6, 9))])
def test_groups(spark, monkeypatch, letters, sizes):
    monkeypatch.setattr(spelling, "SHARD_ENTRIES", 150)
    monkeypatch.setattr(spelling, "HALF_MOST", 20)
    counts = random_counts(1, letters, sizes, 300)
    got = spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == brute(counts) and got.count() == len(counts)


def test_long_chains(spark):
    counts = {"abcdefgh"[:7] + "x" * i: 5 * 6**i for i in range(7)} | {"zzzzzzz": 5}
    got = {r.word: r.root for r in spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {r[0]: r[2] for r in brute(counts)} and got["abcdefg"] == "abcdefg" + "x" * 6


def test_automaton():
    own = random.Random(3)
    words = sorted({"".join(own.choice("abc") for _ in range(own.randrange(9))) for _ in range(800)})
    made = Automaton(words)
    assert made.size == len(words)
    for i, w in enumerate(words):
        state, number = made.walk(0, 0, w)
        assert number == i and made.final[state]
    reach, stack = {0}, [0]
    while stack:
        for t in made.edges[stack.pop()].values():
            if t not in reach:
                reach.add(t)
                stack.append(t)
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    ends = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(reach) == len(ends)  # as few states as there are different remainders
    for w in own.sample(words, 60):
        for half in range(len(w) + 1):
            want = {i for i, v in enumerate(words) if v.startswith(w[:half]) and one_error(v[half:], w[half:])}
            assert made.one_error(w[:half], w[half:]) - {words.index(w)} == want - {words.index(w)}
    assert Automaton([]).size == 0 and Automaton([]).one_error("", "a") == set()


def test_typed_words_and_edges(spark):
    own = random.Random(8)
    texts = [" ".join(own.choice(["Straße", "ÀÉÎ", "colour", "color", "COLOUR", "it's", "naïveté", "x1y2abcdefg"]) for _ in range(400)) for _ in range(40)] + [None, "", "... 12"]
    rows = list(enumerate(texts)) + [(None, "NoId colour " * 9), (3, texts[3])]
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = vocabulary(typed_words(docs, 7))
    assert {r.word: r.n for r in counted.collect()} == counts and len(counts) >= 6
    assert {tuple(r) for r in spelling_groups(counted).collect()} == brute(counts)
    assert spelling_groups(vocabulary(typed_words(edges.documents(spark), 199))).count() > 0
    assert spelling_groups(vocabulary(typed_words(edges.empty(spark), 199))).count() == 0
    assert near_words(spark.createDataFrame([("abcdef", 5)], "word string, n long")).count() == 0
