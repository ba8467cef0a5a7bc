"""Fill-in-the-middle against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from karyon.llm import fill_middle
from karyon.llm.fill_middle import cuts, fill_digests, fill_in_middle

from . import edges

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    d = sha(f"{seed}:{'' if i is None else i}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed):
    own = random.Random(seed)
    alphabet = ["\n", "\n", "a", "é", "🙂", "<", "P", ">", "<P", "S>", "\r", "\0", "line of words "]
    made = ["".join(own.choice(alphabet) for _ in range(own.choice([0, 1, 2, 9, 300, 3000]))) for _ in range(150)]
    return [*made, None, "", "\n", "\n\n", "a", "a\n", "\na", "<P>", "x<M>\ny", "one line only, long " * 3000, "é\n" * 20_000]


@pytest.mark.parametrize("chunk,piece,rate,spm", [(1 << 12, 1 << 20, 100, 50), (7, 21, 60, 10)])
def test_as_brute_force(spark, chunk, piece, rate, spm):
    rows = list(enumerate(texts(1))) + [(None, "a\nb\nc\n"), (5, "same\nid\n")]
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=rate, spm_share=spm)
    want = sorted((brute(i, t, rate=rate, spm=spm) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == want
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_digests(made).collect()}
    assert digests == {(i, sha(brute(i, t, rate=rate, spm=spm)[5]), sha(t or "")) for i, t in rows}


@pytest.mark.parametrize("chunk,piece", [(1, 1), (2, 6), (7, 21), (64, 1 << 20), (1 << 12, 1 << 12)])
def test_chunks_of_any_size(monkeypatch, chunk, piece):
    """The cuts do not depend on the decomposition."""
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    own = random.Random(chunk)
    some = [(t or "")[:400] for t in texts(2)]
    data = [t.encode() for t in some]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    draws = np.array([[own.randrange(1 << 32) for _ in some] for _ in range(2)])
    got = cuts(np.frombuffer(b"".join(data), np.uint8), bounds, draws)
    for i, t in enumerate(some):
        units = UNIT.findall(t)
        a, b = sorted(int(x) % (len(units) + 1) for x in draws[:, i])
        assert got[:, i].tolist() == [len(units), len("".join(units[:a])), len("".join(units[:b]))], t[:50]


def test_edges(spark):
    assert fill_in_middle(edges.empty(spark)).count() == 0
    got = fill_digests(fill_in_middle(edges.documents(spark))).collect()
    assert sorted(r.restored_sha256 for r in got) == sorted(sha(r[1] or "") for r in edges.rows())
