"""Jaccard groups, benchmark hits and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from karyon.llm import decontaminate, fm_index
from karyon.llm.decontaminate import benchmark_hits, contamination, without_spans
from karyon.llm.fingerprints import Sketches, digests, encoded, fingerprint_likeness, folded, likeness, neighbour_fingerprints, sketches
from karyon.llm.jaccard_join import jaccard_groups, least_similarity, one_of_each_group, stop_depths
from karyon.llm.tables import table
from karyon.llm.text import utf8

from . import edges

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(rows):
    ids = [i for i, _ in rows]
    bags, whole = {i: shingles(t) for i, t in rows}, {i: tuple(words(t)) for i, t in rows}
    root, links, copies = {i: i for i in ids}, dict.fromkeys(ids, 0), dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        copies[a] += 1
        for b in ids[k + 1 :]:
            same = whole[a] == whole[b]
            copies[a] += same
            copies[b] += same
            near = not same and bags[a] and bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])
            links[a] += bool(near)
            links[b] += bool(near)
            if same or near:
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {(i, find(i), links[i], copies[i]) for i in ids}


def test_groups_as_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard_groups(docs, node_block=8, block=4).collect()}
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_planted_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for k in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(120)] = f"x{rng.randrange(5000)}"
            rows.append((1000 * g + k, " ".join(own)))
    got = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), node_block=8, block=8).collect()}
    assert got == brute_groups(rows)


def test_groups_of_edges(spark):
    got = {r.doc_id: r for r in jaccard_groups(edges.documents(spark).where("doc_id is not null")).collect()}
    assert set(got) == set(range(1, 8))
    assert [got[k].class_id for k in range(1, 8)] == [1, 1, 1, 4, 4, 6, 7]
    assert got[6].n_copies == 1  # rows that repeat id and text are one document
    assert jaccard_groups(edges.empty(spark)).count() == 0


def brute_contamination(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names - {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_as_brute_force(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = brute_contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    for options in ({}, {"shard_words": 2000, "block_words": 300}):
        got = contamination(benchmark_hits(docs, bench, **options)).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert any(r[5] for r in want)


def test_blocks_do_not_follow_the_files_of_the_benchmark(spark, monkeypatch):
    """A benchmark in many partitions has one block, and a shard one index however many blocks there are."""
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = sorted(map(tuple, contamination(benchmark_hits(docs, bench)).collect()), key=repr)
    assert sorted(map(tuple, contamination(benchmark_hits(docs, bench.repartition(40))).collect()), key=repr) == want
    assert len(decontaminate._phrase_files(bench.repartition(40), "item_id", "text", decontaminate.BLOCK_WORDS, 10)) == 1

    made = []
    monkeypatch.setattr(decontaminate, "FMIndex", lambda *args: made.append(1) or fm_index.FMIndex(*args))
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 30, 4000).astype(np.uint64)
    at = np.array([0, 1000, 1000, 2500, 4000])
    items = [(str(k), hashes[i : i + 14] if k % 2 else rng.integers(0, 60, 14).astype(np.uint64)) for k, i in enumerate(rng.integers(0, 3900, 40))]
    blocks = [decontaminate.phrases(items[k : k + 5], 3) for k in range(0, 40, 5)]
    shard = decontaminate.indexed(hashes, at, [b.vocabulary for b in blocks])
    for block in blocks:
        first, length, doc, item = decontaminate.occurrences(shard, block)
        alone = decontaminate.occurrences(decontaminate.indexed(hashes, at, [block.vocabulary]), block)
        assert sorted(zip(first.tolist(), length.tolist(), strict=True)) == sorted(zip(alone[0].tolist(), alone[1].tolist(), strict=True))
        assert list(zip(doc, item, strict=True)) == list(zip(alone[2], alone[3], strict=True))
        phrase = {tuple(p) for rows, _, _ in block.by_length for p in block.vocabulary[rows - 1].tolist()}
        runs = [(a, b) for a, b in zip(at, at[1:], strict=False)]
        assert sorted(first.tolist()) == [i for a, b in runs for i in range(a, b - 2) if tuple(hashes[i : i + 3].tolist()) in phrase]
    assert len(made) == 1 + len(blocks)
    assert decontaminate.indexed(hashes, at, [np.array([99], np.uint64)]) is None


def test_long_items_are_cut_with_overlap(spark):
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"w{k}" for k in range(40, 60))), (3, "w1 w2 w3")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("a", text)], "item_id string, text string")
    got = contamination(benchmark_hits(docs, bench, block_words=25)).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == [(1, 200, 1), (2, 20, 1), (3, 0, 0)]


def test_contamination_of_edges(spark):
    items = [(1, "one two three"), (2, None), (3, ""), (None, "no id at all"), (5, "kurze lange wörter und kurze lange wörter und kurze lange wörter"), (11, "One, two; three!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contamination([r[:2] for r in edges.rows()], items)  # an item without an id hits words, but is not listed
    hits = benchmark_hits(edges.documents(spark), bench, block_words=4)
    assert sorted(map(tuple, contamination(hits).collect()), key=repr) == want
    assert {r.doc_id: r.text for r in without_spans(hits).where("doc_id in (4, 7)").collect()} == {4: "", 7: edges.rows()[7][1]}
    assert contamination(benchmark_hits(edges.empty(spark), bench)).count() == 0
    assert contamination(benchmark_hits(edges.documents(spark), bench.where("false"))).where("contaminated").count() == 0


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((i, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_fingerprints(spark):
    for docs in (table(spark, SF, "documents"), edges.documents(spark), edges.documents(spark).limit(1)):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        found = neighbour_fingerprints(docs).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == brute_edits(rows)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
        text, by_text = dict(rows), {}
        for r in found:
            if r.doc_id is not None:
                by_text.setdefault(text[r.doc_id] or "", set()).add(r.fingerprint)
        assert all(len(f) == 1 for f in by_text.values())
    assert neighbour_fingerprints(edges.empty(spark)).count() == 0


def test_fingerprint_likeness(spark):
    rng = random.Random(5)
    base = [f"word{rng.randrange(900)}" for _ in range(800)]
    near = [*base[:400], "inserted", *base[400:]]
    other = [f"else{rng.randrange(900)}" for _ in range(800)]
    rows = [(9, " ".join(base)), (8, " ".join(base)), (7, " ".join(near)), (6, " ".join(other))]
    got = {r.doc_id: r for r in neighbour_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[9].near_next == 1 and got[9].fingerprint == got[8].fingerprint
    assert 0.9 < got[8].near_next < 1 and got[7].near_next < 0.05
    assert got[7].near_edited > 0.25


def exact_likeness(one, other):
    """Of the pieces' digests, as sets."""
    a, b = (set(digests(*utf8(pa.array([t])))[0].tolist()) for t in (one, other))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_exact_over_the_table(spark):
    rows = sorted((tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in neighbour_fingerprints(table(spark, SF, "documents")).collect()}
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        assert abs(got[i].near_edited - exact_likeness(text, text[: len(text) - half] + following[:half])) < 1e-9
        assert abs(got[i].near_next - exact_likeness(text, following)) < 1e-9


def test_near_copies_need_their_fingerprints_only(spark):
    base = [f"word{k * 7919 % 900}" for k in range(800)]
    rows = [(3, " ".join(base)), (2, " ".join([*base[:400], "inserted", *base[400:]])), (1, "quite another text")]
    got = {r.doc_id: r for r in neighbour_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    prints = [got[k].fingerprint for k in (3, 2, 1)]
    alone = fingerprint_likeness(prints, prints[1:] + prints[:1])
    assert abs(alone[0] - exact_likeness(rows[0][1], rows[1][1])) < 1e-9 and np.isnan(alone[1])
    assert fingerprint_likeness(prints, prints).tolist() == [1, 1, 1]


def test_sketches_fold():
    digest = np.random.default_rng(2).integers(1, 1 << 40, 500).astype(np.uint64)
    at = np.array([0, 500])
    large, small = sketches(digest, at, 1024).packed(), sketches(digest, at, 16).packed()
    assert (folded(large, 16) == small).all()
    other = sketches(digest[5:], np.array([0, 495]), 1024)
    found, whole = Sketches.unpacked(np.array([1024]), large).less(other).peel()
    assert whole[0] and found[0] == 5


def test_fingerprints_of_odd_ids(spark):
    rows = [("b", "x y z"), ("a", "x y z"), ("b", "another text"), (None, "n"), (None, "m"), (None, None)]
    found = neighbour_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(found) == len(rows)
    order = [("b", "another text"), ("b", "x y z"), ("a", "x y z"), (None, ""), (None, "m"), (None, "n")]
    want = []
    for k, (i, text) in enumerate(order):
        half = len(text) // 2
        want.append((i, len(text), hashlib.sha256((text[: len(text) - half] + order[(k + 1) % 6][1][:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(want, key=repr)


def test_groups_of_odd_ids(spark):
    """One output row for each input row: string ids, null ids, ids that repeat with other texts."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [("b", base), ("a", base + " more"), ("b", "quite another text of seven words"), (None, base), (None, base), (None, "no id"), (None, None), ("c", "quite another text of seven words"), ("c", "quite another text of seven words")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id string, text string, `class.id` string")
    got = jaccard_groups(docs).collect()
    assert len(got) == len(rows)
    want = [("b", "a", 1, "b", 3), ("a", "a", 3, "a", 1), ("b", "b", 0, "b", 2), (None, "a", 1, "b", 3), (None, "a", 1, "b", 3), (None, None, 0, None, 1), (None, None, 0, None, 1), ("c", "b", 0, "b", 2), ("c", "b", 0, "b", 2)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or "", r.text or "") for r in kept.collect()) == sorted([("a", base + " more"), ("b", "quite another text of seven words"), ("", "no id"), ("", "")])


def test_stop_depths():
    """A text is done early only if every partner it can have at the threshold would have met it."""
    for n in range(1, 60):
        every = [i / (n + m - i) for m in range(1, 120) for i in range(1, min(n, m) + 1) if i >= 0.8 * (n + m - i) - 1e-9]
        assert abs(least_similarity(n, 0.8) - min(every)) < 1e-9
    depths = stop_depths(0.8, 20, 6, 0.9999)
    assert depths[1] == 6 and depths[-1] == 4 and len(set(depths.tolist())) == 3


def test_recall_of_every_hundredth_document(spark):
    """Queries are all rows whose id is divisible by 100, against all rows of sf0.1, by brute force."""
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").collect()]
    bags, whole, places = {i: shingles(t) for i, t in docs}, {i: hash(tuple(words(t))) for i, t in docs}, {}
    for i, bag in bags.items():
        for g in bag:
            places.setdefault(g, []).append(i)
    want = {}
    for i in (i for i in bags if i % 100 == 0):
        shared = {}
        for g in bags[i]:
            for j in places[g]:
                shared[j] = shared.get(j, 0) + 1
        want[i] = sum(whole[j] != whole[i] and n >= 0.8 * (len(bags[i]) + len(bags[j]) - n) - 1e-9 for j, n in shared.items())
    got = {r.doc_id: r.n_links for r in jaccard_groups(table(spark, "/root/testdata/sf0.1", "documents")).collect() if r.doc_id % 100 == 0}
    print("links", sum(want.values()), "found", sum(min(got[i], n) for i, n in want.items()))
    assert got.keys() == want.keys() and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0


def test_comparisons_end_where_digests_are_equal():
    """Two equal digests on one side never peel; they are counted exactly after sketches as large as both sides ask for."""
    side = lambda *lists: (np.array([d for own in lists for d in own], np.uint64), np.concatenate([[0], np.cumsum([len(own) for own in lists])]))
    many = list(range(1000, 1400))
    a, b = side([5, 5], [5, 5, 6], [], many + [7, 7], [5]), side([], [6], [], many[:300] + [9], [5])
    prints = [encoded(np.diff(x[1]), sketches(*x)) for x in (a, b)]
    found, retried = likeness(*prints, a, b)
    assert found.tolist() == pytest.approx([0.0, 1 / 3, 1.0, 300 / (402 + 301 - 300), 1.0]) and retried >= 2


def test_edited_texts_are_told_by_their_fingerprints(spark):
    """Of the documents at sf0.01 nine tenths of near_edited at least come from the two stored strings alone, and are the same."""
    rows = neighbour_fingerprints(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    alone = fingerprint_likeness([r.fingerprint for r in rows], [r.edited_fingerprint for r in rows])
    told = ~np.isnan(alone)
    print("told", told.mean(), "mean characters", np.mean([len(r.fingerprint) for r in rows]))
    assert told.mean() >= 0.9 and np.allclose(alone[told], np.array([r.near_edited for r in rows])[told])


def test_recall_close_to_the_threshold(spark):
    """Over 400 pairs whose similarity is between 0.80 and 0.85, in texts of 60 to 400 words: each is found, and pairs just below are not."""
    rng = random.Random(12)
    rows, near, below = [], set(), set()
    while len(near) < 400:
        n = rng.randrange(60, 400)
        base = [f"w{rng.randrange(20_000)}" for _ in range(n)]
        own = list(base)
        for _ in range(max(1, round(n * rng.uniform(0.015, 0.03)))):
            own[rng.randrange(n)] = f"x{rng.randrange(20_000)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(own))
        alike = len(a & b) / len(a | b)
        if 0.8 <= alike <= 0.85 or (0.75 < alike < 0.8 and len(below) < 100):
            k = len(rows)
            (near if alike >= 0.8 else below).add(k)
            rows += [(k, " ".join(base)), (k + 1, " ".join(own))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(got[k][0] == got[k + 1][0] for k in near)
    print("found", found, "of", len(near))
    assert found == len(near) and all(got[k][1] == got[k + 1][1] == 0 for k in below)
