"""Token counts and byte BPE against the libraries on whole texts."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from karyon.llm.byte_bpe import ForcedBoundaryCodec, bpe_round_trip, codec
from karyon.llm import queries
from karyon.llm.tables import table
from karyon.llm.token_counts import CHUNK_BYTES, encode_huge, token_counts

from . import edges

SF = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the ", "model", "'s", "'t ", " '", "\n", "\n\n", "  ", "\t", "<|endoftext|>", "</s>", "é", "東京", " ", "　", "a" * 40, "=" * 70, "3.14", "!?", "🙂", "don't", "é", "Wörter ", "\r\n", "\x85", "ing"]


def mixed(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("chunk,overlap", [(64, 16), (300, 40), (2000, 64)])
def test_spliced_chunks_are_the_whole(seed, chunk, overlap):
    sp = SentencePieceProcessor(model_file=PIECES)
    text = mixed(seed, 250)
    assert encode_huge(sp, text.encode(), chunk, overlap, min(8, overlap // 4)) == sp.encode(text)


@pytest.mark.parametrize("text", ["=" * 5000, "ab" * 3000, " " * 4000, "é" * 3000, "東" * 2000, "aaaa " * 900])
def test_periodic_texts_widen_the_overlap(text):
    sp = SentencePieceProcessor(model_file=PIECES)
    assert encode_huge(sp, text.encode(), 512, 64, 16) == sp.encode(text)


def test_counts_of_edges(spark):
    sp = SentencePieceProcessor(model_file=PIECES)
    got = sorted((tuple(r)[:4] for r in token_counts(edges.documents(spark), PIECES).collect()), key=repr)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in edges.rows()), key=repr)
    assert got == want
    assert token_counts(edges.empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_fragments_are_the_whole(seed):
    codec, tok = ForcedBoundaryCodec(BYTES), Tokenizer.from_file(BYTES)
    text = mixed(1000 + seed, 200)
    ids = tok.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_round_trip_of_edges(spark):
    tok = Tokenizer.from_file(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in edges.rows():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = map(tuple, bpe_round_trip(edges.documents(spark), BYTES).collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe_round_trip(edges.empty(spark), BYTES).count() == 0


def test_whole_table_counts(spark):
    """The registered query over all documents is the library on whole texts, and long texts go through spliced chunks."""
    sp, docs = SentencePieceProcessor(model_file=PIECES), table(spark, SF, "documents")
    want = {r.doc_id: len(sp.encode(r.text or "")) for r in docs.collect()}
    got = queries.op1_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert all((r.n_chunks > 1) == (r.n_bytes > CHUNK_BYTES) for r in got)
    assert sum(r.n_chunks > 1 for r in got) > 10


def test_whole_table_round_trip(spark):
    tok = Tokenizer.from_file(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in table(spark, SF, "documents").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert set(map(tuple, queries.op2_bpe_round_trip(spark, SF).collect())) == want


def test_memo_ends_with_the_task(spark):
    """What a task has looked up does not stay in its worker, which goes on to other stages."""
    docs = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string").coalesce(1)
    assert bpe_round_trip(docs, BYTES).count() == 1
    held = spark.range(1).repartition(8).mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([{"n": sum(map(len, codec(BYTES).memo))}]) for _ in batches), "n bigint")
    assert {r.n for r in held.collect()} <= {0}
    codec(BYTES).look_up([b"one"])
    codec(BYTES).forget()
    assert not any(codec(BYTES).memo)
