"""Benchmark passages in documents, found by an FM-index of each shard of the documents.

A task takes its partition in shards of about `shard_words` words. A shard's words that the benchmark has, too, become
symbols, numbered within the shard; all others are one separator (a run of them is kept as one), which no phrase can contain. The
shard has one FM-index, however many blocks the benchmark has: each block's windows are renamed to the shard's symbols (those with a word
that the shard lacks go) and searched backward at once, the occurrences are
located by sampled suffix positions, and overlapping ones are merged into removal spans.

The documents are read once and never shuffled. The benchmark's windows are made in tasks, in blocks of at most `block_words` words
that are files of the shared folder (an item with more words is in several blocks, which overlap by a window less a word). The benchmark's partitions
are coalesced by its size first, so the number of blocks does not follow the number of its files. A worker loads one block at a
time for each shard, so a larger benchmark takes more time, not more memory, and the driver sees no text. spark.checkpoint.dir must be mounted on
the driver and all executors.

Nulls: a null or empty text has no words; a benchmark item without words has no window. Words hit by an item without an id are hit,
but it is not counted or listed among the items. Rows that repeat an item id are one item. Repeated rows each get their result; an empty benchmark hits nothing. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import os
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .tables import local_folder
from .text import CHUNK_BYTES, LOWER, chunks, spans, word_places
from .workers import released

WINDOW = 10
SHARD_WORDS = 1_500_000
BLOCK_WORDS = 2_000_000
#: Bytes of text for each word of a block when the benchmark is coalesced.
_WORD_BYTES = 6


@dataclass
class Phrases:
    """Windows of a block of benchmark items. vocabulary: sorted word hashes; symbol k + 1 is its k-th."""

    vocabulary: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (phrases by symbol; offsets into and values of the indices of their items)
    items: list[str | None]


def phrases(items: list[tuple[str | None, np.ndarray]], window: int = WINDOW) -> Phrases:
    """From (item id, word hashes): distinct windows of `window` words, or of all words of a shorter item."""
    names = sorted({name for name, _ in items}, key=lambda x: (x is not None, x or ""))
    number = {name: k for k, name in enumerate(names)}
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[w for _, w in items]]))
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for name, w in items:
        if len(w):
            symbols = (np.searchsorted(vocabulary, w) + 1).astype(np.int32)
            size = min(window, len(w))
            rows = np.lib.stride_tricks.sliding_window_view(symbols, size)
            found.setdefault(size, []).append((rows, np.full(len(rows), number[name])))
    by_length = []
    for _, parts in sorted(found.items()):
        rows, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), owner], axis=1), axis=0)
        by_length.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
    return Phrases(vocabulary, by_length, names)


@dataclass
class Shard:
    """The index of a shard's words that the benchmark has. vocabulary: their sorted hashes; symbol k + 1 is its k-th."""

    index: FMIndex
    vocabulary: np.ndarray
    place: np.ndarray  # the word of the shard at each place of the indexed text
    at: np.ndarray  # offsets of the shard's words by document


def _found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in a sorted array, and whether it does."""
    if not len(among):
        return np.zeros(len(values), np.int64), np.zeros(len(values), dtype=bool)
    k = np.searchsorted(among, values)
    k[k == len(among)] = 0
    return k, among[k] == values


def indexed(hashes: np.ndarray, at: np.ndarray, vocabularies: Iterable[np.ndarray]) -> Shard | None:
    """Of a shard's words with offsets by document; None if it has no word of these vocabularies."""
    distinct, which = np.unique(hashes, return_inverse=True)
    known = np.zeros(len(distinct), dtype=bool)
    for vocabulary in vocabularies:
        known |= _found(distinct, vocabulary)[1]
    if not known.any():
        return None
    symbol = np.where(known, np.cumsum(known), 0).astype(np.int32)[which]
    text = np.insert(symbol, at[:-1], 0)  # a separator before each document
    place = np.insert(np.arange(len(hashes)), at[:-1], -1)
    keep = text != 0
    keep[1:] |= text[:-1] != 0
    keep[0] = True
    text, place = np.append(text[keep], 0).astype(np.int32), np.append(place[keep], -1)
    return Shard(FMIndex(text, int(known.sum()) + 1), distinct[known], place, at)


def occurrences(shard: Shard, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words and lengths of all occurrences of a block's phrases, and pairs (document, item) that occur."""
    k, known = _found(block.vocabulary, shard.vocabulary)
    symbol = np.append(0, np.where(known, k + 1, 0)).astype(np.int32)  # of the shard, by symbol of the block
    none, at = np.zeros(0, np.int64), shard.at
    starts, lengths, docs, items = [none], [none], [none], [none]
    for phrase, owner_at, owner in block.by_length:
        here = symbol[phrase]
        possible = np.flatnonzero((here > 0).all(axis=1))
        low, high = shard.index.search(here[possible])
        count = high - low
        which = np.repeat(possible, count)
        found = np.arange(len(which)) + np.repeat(low - np.cumsum(count) + count, count)
        first = shard.place[shard.index.locate(found)]
        doc = np.searchsorted(at, first, side="right") - 1
        starts.append(first)
        lengths.append(np.full(len(first), phrase.shape[1]))
        pairs = np.unique(doc * len(phrase) + which)
        doc, which = pairs // len(phrase), pairs % len(phrase)
        each = owner_at[which + 1] - owner_at[which]
        docs.append(np.repeat(doc, each))
        items.append(owner[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(owner_at[which], each)])
    pairs = np.unique(np.concatenate(docs) * len(block.items) + np.concatenate(items))
    return np.concatenate(starts), np.concatenate(lengths), pairs // len(block.items), pairs % len(block.items)


def _phrase_files(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, window: int) -> list[str]:
    """Files of the shared folder with the phrases of the benchmark, a block each; made in tasks, the driver gets their paths."""
    folder, name = local_folder(benchmark.sparkSession), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, np.ndarray]] = []
        n = 0

        def written() -> pa.RecordBatch:
            path = f"{folder}/phrases-{name}-{uuid.uuid4().hex}"
            block = phrases(held, window)
            np.save(f"{path}.npy", block.vocabulary)
            with open(path, "wb") as f:
                pickle.dump(block, f, protocol=pickle.HIGHEST_PROTOCOL)
            return pa.RecordBatch.from_pylist([{"path": path}])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, _, raw, bounds in chunks(batch.column(1), CHUNK_BYTES):
                starts, ends, at = word_places(raw, bounds)
                hashes = spans(LOWER[raw], starts, ends)
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for begin in range(a, max(b - window + 1, a + 1), block_words):
                        held.append((ids[first + k], hashes[begin : min(b, begin + block_words + window - 1)]))
                        n += len(held[-1][1])
                        if n >= block_words:
                            yield written()
                            held, n = [], 0
        if n:
            yield written()

    rows = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return sorted(r.path for r in rows.coalesce(max(1, math.ceil(size / (block_words * _WORD_BYTES)))).mapInArrow(released(run), "path string").collect())


def _loaded(path: str) -> Phrases:
    with open(path, "rb") as f:
        return pickle.load(f)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pieces of batches, word hashes, offsets, first and end bytes within each text) for shards of about `most` words."""
    held, parts, n = [], [], 0
    for batch in batches:
        for first, end, raw, bounds in chunks(batch.column(1), CHUNK_BYTES):
            starts, ends, at = word_places(raw, bounds)
            base = np.repeat(bounds[:-1], np.diff(at))
            held.append(batch.slice(first, end - first))
            parts.append((spans(LOWER[raw], starts, ends), np.diff(at), (starts - base).astype(np.int32), (ends - base).astype(np.int32)))
            n += len(starts)
            if n >= most:
                yield held, *_joined(parts)
                held, parts, n = [], [], 0
    if held:
        yield held, *_joined(parts)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, counts, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    return hashes, at, starts, ends


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, keep_text: bool = True, prefix: str = ""
) -> DataFrame:
    """All columns of docs (the text only with keep_text), n_words, hit_words (merged runs [first, end) of words), removal (the same as bytes of the UTF-8 text), hit_items.

    These four names stand after `prefix`; columns of docs with the same names are replaced.
    """
    new = [prefix + c for c in ("n_words", "hit_words", "removal", "hit_items")]
    extra = ", ".join(f"`{c}` {kind}" for c, kind in zip(new, ("bigint", "array<array<int>>", "array<array<int>>", "array<string>"), strict=True))
    names = [c for c in docs.columns if c not in (id_col, text_col, *new)]
    plain = [f"c{k}" for k in range(len(names) + 2)]  # mapInArrow takes no names with dots
    df = docs.select(id_col, text_col, *[F.col(f"`{c}`") for c in names]).toDF(*plain)
    files = _phrase_files(benchmark, item_col, item_text_col, block_words, window)
    one = os.path.getsize(files[0]) if len(files) == 1 else 0
    kept: list[Phrases] = []  # a single block stays loaded between the shards of a task

    def blocks() -> Iterator[Phrases]:
        for path in files:
            if one and not kept:
                kept.append(_loaded(path))
            yield kept[0] if one else _loaded(path)

    def vocabularies() -> Iterator[np.ndarray]:
        return (b.vocabulary for b in blocks()) if one else (np.load(f"{path}.npy") for path in files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, hashes, at, starts, ends in _shards(batches, shard_words):
            rows = pa.Table.from_batches(held)
            edge = np.zeros(len(hashes) + 1, np.int64)
            found: list[set[str]] = [set() for _ in range(len(at) - 1)]
            shard = indexed(hashes, at, vocabularies())
            for block in blocks() if shard else ():
                begin, length, doc, item = occurrences(shard, block)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    if block.items[i] is not None:
                        found[d].add(block.items[i])
            own: list[list] = [[] for _ in found]
            cut: list[list] = [[] for _ in found]
            for a, b in _merged(edge, at):
                k = int(np.searchsorted(at, a, side="right")) - 1
                own[k].append([int(a - at[k]), int(b - at[k])])
                cut[k].append([int(starts[a]), int(ends[b - 1])])
            made = [pa.array(np.diff(at), pa.int64()), pa.array(own, pa.list_(pa.list_(pa.int32()))), pa.array(cut, pa.list_(pa.list_(pa.int32()))), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            rows = rows.select([c for c in rows.column_names if keep_text or c != plain[1]])
            yield from pa.table([*rows.columns, *made], names=[*rows.column_names, *new]).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if keep_text or f.name != plain[1]) + ", " + extra
    return df.mapInArrow(released(run), schema).toDF(id_col, *[text_col] * keep_text, *names, *new)


def _merged(edge: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Disjoint runs [first, end) of words that occurrences cover, none across documents. edge: how many begin less how many end before each word."""
    n = len(edge) - 1
    if not n or not edge.any():
        return np.zeros((0, 2), np.int64)
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.zeros(n + 1, dtype=bool)
    turn[1:n] = hit[1:] != hit[:-1]
    turn[0] = turn[n] = True
    turn[at] = True
    places = np.flatnonzero(turn)
    runs = np.stack([places[:-1], places[1:]], axis=1)
    return runs[hit[runs[:, 0]]]


def sha256_of_items(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def contamination(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report by document of what benchmark_hits found."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, run: n + run[1] - run[0])
    return hits.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), sha256_of_items(F.col("hit_items")).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def without_spans(hits: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Each text without its removal spans; native. What stands on either side of a span stays apart by the signs around it."""
    removal = f"`{prefix}removal`"
    raw = f"encode(`{text_col}`, 'UTF-8')"
    first = f"if(i = 0, 0, {removal}[i - 1][1])"
    last = f"if(i = size({removal}), length({raw}), {removal}[i][0])"
    pieces = F.expr(f"transform(sequence(0, size({removal})), i -> substring({raw}, {first} + 1, {last} - {first}))")
    joined = F.aggregate(pieces, F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    return hits.withColumn(text_col, F.when((F.size(F.col(f"{prefix}removal")) > 0) & F.col(f"`{text_col}`").isNotNull(), F.decode(joined, "UTF-8")).otherwise(F.col(f"`{text_col}`")))
