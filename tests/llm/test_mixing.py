"""Mixing: targets, Sainte-Laguë seats and taken words against plain versions."""

import heapq
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from karyon.llm import mixing
from karyon.llm.mixing import apportion, mix_sources, source_targets, taken_texts

from . import edges

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share=Fraction(3, 2), most=2):
    left, free, out = share * sum(sizes), set(range(len(sizes))), {}
    while free:
        total = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / total > most * sizes[i]} if total else set()
        if not above:
            return [float(out.get(i, left * weights[i] / total)) for i in range(len(sizes))]
        for i in above:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free -= above
    return [float(out[i]) for i in range(len(sizes))]


def plain_seats(weights, seats, caps):
    """One seat after the other to the highest quotient, ties to the first."""
    got = [0] * len(weights)
    heap = [(-Fraction(w), i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(weights[i]) / (2 * got[i] + 1), i))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    own = random.Random(seed)
    sizes = [own.choice([0, 1, 10, 500, own.randrange(10**6)]) for _ in range(own.choice([1, 2, 3, 9, 40]))]
    names = sorted((f"s{own.random()}é🙂" for _ in sizes), key=lambda s: s)
    names[-1] = None
    rows = list(zip(names, sizes, strict=True))
    own.shuffle(rows)
    got = source_targets(spark.createDataFrame(rows, "source string, source_size long"), [5, 2, 1], (3, 2), 2).orderBy("rank").collect()
    assert [r.source for r in got] == names and [r["rank"] for r in got] == list(range(len(names)))
    want = plain_targets(sizes, [[5, 2, 1][i % 3] for i in range(len(sizes))])
    assert [r.target for r in got] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("seed", range(6))
def test_seats(spark, seed):
    own = random.Random(seed)
    groups = {}
    for g in range(12):
        n = own.choice([1, 2, 3, 20, 60])
        weights = [own.choice([0, 1, 1, 5, own.randrange(1, 400)]) for _ in range(n)]
        caps = [2 * w for w in weights]
        groups[g] = (weights, own.choice([0, 1, n, sum(weights), sum(caps), own.randrange(sum(caps) + 1)]), caps)
    rows = [(g, i, w, s, c) for g, (ws, s, cs) in groups.items() for i, (w, c) in enumerate(zip(ws, cs, strict=True))]
    found = apportion(spark.createDataFrame(rows, "g long, i long, w long, seats long, cap long"), ["g"], "seats", "w", "cap", "i", "got").collect()
    got = defaultdict(dict)
    for r in found:
        got[r.g][r.i] = r.got
    for g, (weights, seats, caps) in groups.items():
        assert [got[g][i] for i in range(len(weights))] == plain_seats(weights, seats, caps), groups[g]


def _mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, mix_sources(docs, **more)


def test_taken_words_of_skewed_sources(spark, monkeypatch):
    """Many shards on several levels: sums come near the targets, and the taken texts hold as many words."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_OUT_BITS", 2)
    own = random.Random(5)
    rows = [(i, " ".join(f"w{own.randrange(99)}" for _ in range(own.choice([0, 1, 5, 40, 120])))+own.choice(["", " \n"]), own.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(900)]
    rows += [(10_000, None, "a"), (10_001, " \t\n ", "c"), (10_002, "x " * 5000, "b"), (10_003, "one", "d")]
    docs, plan = _mixed(spark, rows, block_words=8)
    got = plan.collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    by = defaultdict(list)
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    names = sorted(x for x in by if x is not None) + [None]
    totals = [sum(r.size for r in by[s]) for s in names]
    for s, total, target in zip(names, totals, plain_targets(totals, [[5, 2, 1][i % 3] for i in range(len(names))]), strict=True):
        assert {(r.source_size, round(r.target, 6)) for r in by[s]} == {(total, round(target, 6))}
        assert abs(sum(r.taken for r in by[s]) - target) <= 16 + 0.02 * target, (s, target)
    again = {(r.doc_id, r.taken) for r in mix_sources(docs.repartition(7), block_words=8).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    made = Counter()
    for r in taken_texts(docs, plan).collect():
        made[r.doc_id] += len(WORD.findall(r.text))
    assert made == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_edges(spark):
    assert mix_sources(edges.empty(spark)).count() == 0
    got = mix_sources(edges.documents(spark)).collect()
    assert len(got) == len(edges.rows()) and all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(got[0].target, abs=64)
    _, none = _mixed(spark, [(1, None, None), (2, "", "a")])
    assert [(r.size, r.target, r.taken) for r in none.collect()] == [(0, 0.0, 0)] * 2
