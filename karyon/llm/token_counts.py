"""Token counts of whole texts, long ones by overlapping chunks that are resynchronised.

A text of up to one chunk is encoded in one call; a longer one in chunks that overlap. Two neighbours are spliced at a place
in their overlap where both encodings have the same two tokens l, r, ending and beginning at the same byte. That place is
stable: a token sequence is the encoding of its text if and only if each pair of neighbours is the encoding of its own text,
and every pair of the spliced sequence (those of the left chunk up to l, the pair l r, those of the right chunk from r on)
stands in the encoding of a chunk. If there is no such place the overlap is doubled, up to all of the left chunk; then the left
chunk is encoded again twice as long, from its own beginning, and taken on from the last stable border, where the pair l, r must stand
again. Only a text in which all this fails up to its end is encoded in one call. So the count is always that of the whole text.

Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and repeated ids
give repeated results, an empty table an empty one, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import utf8

CHUNK_BYTES = 1 << 12
OVERLAP_BYTES = 256
#: Bytes at either edge of an overlap in which no splice is made: what a chunk's edge could have changed.
MARGIN_BYTES = 32
#: Texts are encoded in lists of about so many bytes, to bound the token lists held at once.
BATCH_BYTES = 1 << 20


@lru_cache(maxsize=2)
def processor(model: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


def _border(raw: bytes, at: int) -> int:
    """The first character border at or after `at`."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(raw))


def _pieces(sp, raw: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    """(begin, end, id) of the tokens of raw[start:end], in bytes of raw."""
    found = sp.encode(raw[start:end].decode("utf-8"), return_type="proto")
    return [(start + p.begin, start + p.end, p.id) for p in found.pieces]


def _splice(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], low: int, high: int) -> tuple[int, int] | None:
    """Indices (i, j): keep left[:i] and right[j:]. None if no stable border lies between low and high."""
    follows = {}
    for i in range(len(left) - 1, 0, -1):
        if left[i][0] < low:
            break
        if left[i][0] <= high:
            follows[left[i - 1], left[i]] = i
    for j in range(1, len(right)):
        a, b = right[j - 1], right[j]
        if b[0] > high:
            break
        if b[0] >= low and a[0] < a[1] == b[0] < b[1] and (i := follows.get((a, b))) is not None:
            return i, j
    return None


@dataclass
class Effort:
    """What the chunks of a text have taken."""

    chunks: int = 0
    widened: int = 0  # times that an overlap or a chunk was doubled


def _from_border(pieces: list[tuple[int, int, int]], before: tuple[int, int, int], first: tuple[int, int, int]) -> int | None:
    """The index of `first` where it follows `before`."""
    at = bisect_left(pieces, first[0], key=lambda p: p[0])
    while 0 < at < len(pieces) and pieces[at][0] == first[0]:
        if pieces[at] == first and pieces[at - 1] == before:
            return at
        at += 1
    return None


def encode_huge(sp, raw: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, margin: int = MARGIN_BYTES, effort: Effort | None = None) -> list[int]:
    """The ids of the whole text, spliced from chunks."""
    effort = effort or Effort()
    out = array("i")
    begin, end = 0, _border(raw, chunk)  # of the chunk that `left` comes from
    left = _pieces(sp, raw, 0, end)
    effort.chunks += 1
    before = None  # the token before left[0], at a stable border
    while end < len(raw):
        cut, wide = None, overlap
        while True:
            start = _border(raw, max(begin, end - wide))
            stop = _border(raw, start + max(chunk, 2 * wide))
            right = _pieces(sp, raw, start, stop)
            effort.chunks += 1
            cut = _splice(left, right, start + margin, end - margin)
            if cut or start <= begin:
                break
            wide *= 2
            effort.widened += 1
        if cut:
            i, j = cut
            out.extend([p[2] for p in left[:i]])
            before, left, begin, end = left[i - 1], right[j:], start, stop
            continue
        first = left[0] if left else None
        size = end - begin
        while True:  # the chunk again, twice as long each time, from the stable border on
            size *= 2
            effort.widened += 1
            effort.chunks += 1
            stop = _border(raw, min(len(raw), begin + size))
            longer = _pieces(sp, raw, begin, stop)
            at = 0 if before is None else _from_border(longer, before, first) if first else None
            if at is not None:
                left, end = longer[at:], stop
                break
            if stop >= len(raw):
                return list(sp.encode(raw.decode("utf-8")))
    out.extend([p[2] for p in left])
    return out.tolist()


def count_batch(column: pa.Array, model: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bytes, tokens, chunks, doublings) of each text of an Arrow string column."""
    sp = processor(model)
    raw, bounds = utf8(column)
    data = raw.tobytes()
    sizes = [int(b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    tokens, taken, widened = [0] * len(sizes), [int(n > 0) for n in sizes], [0] * len(sizes)
    held: list[int] = []
    waiting = 0

    def flush() -> None:
        texts = [data[bounds[i] : bounds[i + 1]].decode("utf-8") for i in held]
        for i, ids in zip(held, sp.encode(texts, num_threads=1) if texts else [], strict=True):
            tokens[i] = len(ids)
        held.clear()

    for i, n in enumerate(sizes):
        if n > chunk:
            effort = Effort()
            tokens[i] = len(encode_huge(sp, data[bounds[i] : bounds[i + 1]], chunk, overlap, min(MARGIN_BYTES, overlap // 4), effort))
            taken[i], widened[i] = effort.chunks, effort.widened
        elif n:
            held.append(i)
            waiting += n
            if waiting > BATCH_BYTES:
                flush()
                waiting = 0
    flush()
    return sizes, tokens, taken, widened


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_chunks, n_widened) of every row; one pass, no shuffle. n_chunks: calls that the text took; n_widened: doublings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens, taken, widened = count_batch(batch.column(1), model, chunk_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(taken, pa.int64()), pa.array(widened, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, n_widened bigint")
