"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's lines are its paragraphs; a line is cut further after words whose hash is divisible by `CUT`, so that an edit
changes the pieces around it and no others. Each piece has a KEY_BITS-bit digest of its bytes, numbered if it repeats. A sketch
is a table of cells (count, xor of digests, xor of their checks); a digest goes to one cell in each of four quarters, at the
place that the lowest bits of a hash give. Sizes are powers of two, so a sketch folds to half its size by adding the halves of
each quarter, and sketches of different sizes can be compared.

The fingerprint is the text's sketch of at least LOAD cells a digest, with the number of its digests, in base 64. Two fingerprints
are compared by subtracting their cells, the larger folded to the smaller, and peeling: a cell with one digest left gives that digest, which is taken out of its
other cells, until nothing remains. What is recovered are the paragraph digests in which the two texts differ. So two versions of a text of which up to about half was
replaced are told from their fingerprints. Where cells remain, as with unrelated texts, the comparison is retried with sketches GROWTH times as large, made from the texts, until
they have LOAD times GROWTH cells for all digests of both. Digests that peeling cannot tell apart even then (two equal ones on one side) are counted exactly.
With d digests recovered of texts with a and b, the texts share (a + b - d) / 2, and their likeness is this part of all their digests.

`neighbour_fingerprints` compares each document with an edited text and with the next document by descending id. The documents are
dealt by ranges of the id and the beginning of the text, and read in order; what a range needs of the next one, its first text, is one more
row of it. Texts are shuffled once, and results go straight on. Rows that repeat an id stand in the order of their texts, null ids last; ids may be of any type that has an order. A
null text is empty; two empty texts have likeness 1; a single document is its own next. Other columns are ignored. One output row for each input row.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut
from .text import LOWER, mix, spans, utf8, word_places

CUT = np.uint64(16)
BASE_CELLS = 16
#: Cells for each digest at least; peeling works up to about 0.77 digests a cell.
LOAD = 2
GROWTH = 4
KEY_BITS, CHECK_BITS = 40, 16
_HASHES = 4
_KEY, _CHECK = np.uint64((1 << KEY_BITS) - 1), np.uint64((1 << CHECK_BITS) - 1)
_SALT = np.uint64(0x51ED270B7A9C3F15)
_ROWS_BYTES = 1 << 21
#: Characters of a text by which rows of one id are dealt to ranges, and rows for each range of the sample that gives their borders.
_PREFIX, _SAMPLED = 32, 20


def digests(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests of pieces, offsets by text). Equal pieces of a text have different digests, by number."""
    rows = len(bounds) - 1
    starts, ends, at = word_places(raw, bounds)
    hashes = spans(LOWER[raw], starts, ends)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    begins = np.zeros(len(starts), dtype=bool)
    begins[1:] = ((hashes[:-1] % CUT) == 0) | (lines[starts[1:]] != lines[ends[:-1]])
    begins[at[:-1][np.diff(at) > 0]] = False  # the first piece begins with the text
    edges = np.union1d(starts[begins], bounds[:-1][np.diff(bounds) > 0]).astype(np.int64)
    piece_ends = np.append(edges[1:], len(raw)) if len(edges) else edges
    digest = spans(raw, edges, piece_ends)
    text = np.searchsorted(bounds, edges, side="right") - 1
    order = np.lexsort((digest, text))
    d, t = digest[order], text[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    number = (np.arange(len(d)) - first).astype(np.uint64)
    return mix(d + number * np.uint64(0x9E3779B97F4A7C15)) & _KEY, np.searchsorted(t, np.arange(rows + 1))


def _check(digest: np.ndarray) -> np.ndarray:
    return mix(digest ^ _SALT) & _CHECK


class Sketches:
    """Tables of cells for many texts (or differences of texts) in one run of arrays; table i has cells[i] of them."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells
        self.at = np.concatenate([[0], np.cumsum(cells)])
        self.count = np.zeros(self.at[-1], np.int64)
        self.key = np.zeros(self.at[-1], np.uint64)
        self.check = np.zeros(self.at[-1], np.uint64)

    def places(self, text: np.ndarray, digest: np.ndarray) -> np.ndarray:
        quarter = self.cells[text] // _HASHES
        out = []
        for k in range(_HASHES):
            h = mix(digest + np.uint64(k + 1))
            out.append(self.at[text] + k * quarter + (h & (quarter - 1).astype(np.uint64)).astype(np.int64))
        return np.concatenate(out)

    def add(self, text: np.ndarray, digest: np.ndarray, sign: int | np.ndarray) -> None:
        where = self.places(text, digest)
        np.add.at(self.count, where, np.tile(np.broadcast_to(np.asarray(sign, np.int64), len(digest)), _HASHES))
        np.bitwise_xor.at(self.key, where, np.tile(digest, _HASHES))
        np.bitwise_xor.at(self.check, where, np.tile(_check(digest), _HASHES))

    def less(self, other: Sketches) -> Sketches:
        """The differences of tables of equal sizes."""
        out = Sketches(self.cells)
        out.count = self.count - other.count
        out.key, out.check = self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests recovered, whether nothing remains) of each difference. Empties the cells."""
        owner = np.repeat(np.arange(len(self.cells)), self.cells)
        found = np.zeros(len(self.cells), np.int64)
        look = np.flatnonzero(np.abs(self.count) == 1)
        left_to_do = 2 * len(owner) + 8  # a wrong digest can come and go: stop then
        while left_to_do > 0:
            pure = look[(np.abs(self.count[look]) == 1) & (_check(self.key[look]) == self.check[look])]
            if not len(pure):
                break
            text, digest, sign = owner[pure], self.key[pure], self.count[pure]
            order = np.lexsort((digest, text))
            text, digest, sign = text[order], digest[order], sign[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])
            text, digest, sign = text[new], digest[new], sign[new]
            self.add(text, digest, -sign)
            found += np.bincount(text, minlength=len(found))
            left_to_do -= len(text)
            look = np.unique(self.places(text, digest))
        left = np.bincount(owner[(self.count != 0) | (self.key != 0) | (self.check != 0)], minlength=len(self.cells)) > 0
        return found, ~left

    def packed(self) -> np.ndarray:
        """A cell as 64 bits: the count modulo 256, the digests, the checks."""
        return (self.count.astype(np.uint64) & np.uint64(0xFF)) << np.uint64(KEY_BITS + CHECK_BITS) | self.key << np.uint64(CHECK_BITS) | self.check

    @classmethod
    def unpacked(cls, cells: np.ndarray, packed: np.ndarray) -> Sketches:
        out = cls(cells)
        out.count = (packed >> np.uint64(KEY_BITS + CHECK_BITS)).astype(np.uint8).view(np.int8).astype(np.int64)
        out.key, out.check = packed >> np.uint64(CHECK_BITS) & _KEY, packed & _CHECK
        return out


def cells_for(n: np.ndarray) -> np.ndarray:
    """The cells of sketches of n digests: a power of two."""
    return np.maximum(BASE_CELLS, 1 << np.ceil(np.log2(np.maximum(n * LOAD, 1))).astype(np.int64))


def sketches(digest: np.ndarray, at: np.ndarray, cells: np.ndarray | int | None = None) -> Sketches:
    """The sketch of each text, with so many cells or as many as its digests ask for."""
    n = np.diff(at)
    out = Sketches(cells_for(n) if cells is None else np.broadcast_to(np.asarray(cells, np.int64), len(n)))
    out.add(np.repeat(np.arange(len(n)), n), digest, 1)
    return out


def folded(packed: np.ndarray, cells: int) -> np.ndarray:
    """A packed sketch folded to fewer cells: the halves of each quarter are added until it has so many."""
    while len(packed) > cells:
        halves = packed.reshape(_HASHES, 2, -1)
        a, b = halves[:, 0], halves[:, 1]
        low = np.uint64((1 << KEY_BITS + CHECK_BITS) - 1)
        high = ~low
        packed = (((a & high) + (b & high)) | ((a ^ b) & low)).ravel()
    return packed


def encoded(n: np.ndarray, made: Sketches) -> list[bytes]:
    """Fingerprints as bytes: the number of digests (8 bytes), then the cells."""
    cells = made.packed().astype("<u8")
    return [int(k).to_bytes(8, "little") + cells[i:j].tobytes() for k, i, j in zip(n, made.at[:-1], made.at[1:], strict=True)]


def decoded(fingerprints: list[bytes | str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(numbers of digests, packed cells) of fingerprints, as bytes or in base 64, which may be of different sizes."""
    rows = [np.frombuffer(base64.b64decode(f) if isinstance(f, str) else f, "<u8") for f in fingerprints]
    return np.array([int(r[0]) for r in rows], np.int64), [r[1:] for r in rows]


def _gather(digest: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = at[rows + 1] - at[rows]
    return digest[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n)], n


def fingerprint_likeness(one: list[bytes | str], other: list[bytes | str]) -> np.ndarray:
    """The likeness of fingerprints, nan where their sketches are too small for it. Sketches of different sizes are folded to the smaller one."""
    (n, a), (m, b) = decoded(one), decoded(other)
    cells = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    fit = lambda rows: Sketches.unpacked(cells, np.concatenate([np.zeros(0, np.uint64), *(folded(x, c) for x, c in zip(rows, cells.tolist(), strict=True))]))
    return _shared(n, m, *fit(a).less(fit(b)).peel())


def _shared(n: np.ndarray, m: np.ndarray, differing: np.ndarray, whole: np.ndarray) -> np.ndarray:
    shared = (n + m - differing) / 2
    sane = whole & (differing <= n + m) & ((n + m - differing) % 2 == 0) & (differing >= np.abs(n - m))
    return np.where(sane, np.where(n + m == 0, 1.0, shared / np.maximum(n + m - shared, 1)), np.nan)


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    """In how many digests two lists differ, repeated ones counted as often as they are there."""
    both, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    return int(np.abs(np.bincount(which[: len(a)], minlength=len(both)) - np.bincount(which[len(a) :], minlength=len(both))).sum())


def likeness(one: list[bytes | str], other: list[bytes | str], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """(likeness of fingerprint i to the other's i for all i, how many were retried). a and b have the digests of the texts, for the retries."""
    out = fingerprint_likeness(one, other)
    n, m = np.diff(a[1]), np.diff(b[1])
    todo = np.flatnonzero(np.isnan(out))
    retried = len(todo)
    most = GROWTH * cells_for(n[todo] + m[todo])
    cells = np.minimum(GROWTH * cells_for(np.minimum(n, m)[todo]), most)
    while len(todo):
        sides = []
        for digest, at in (a, b):
            own, count = _gather(digest, at, todo)
            sides.append(sketches(own, np.concatenate([[0], np.cumsum(count)]), cells))
        found = _shared(n[todo], m[todo], *sides[0].less(sides[1]).peel())
        out[todo] = found
        for i in todo[np.isnan(found) & (cells == most)].tolist():
            differing = _exact(a[0][a[1][i] : a[1][i + 1]], b[0][b[1][i] : b[1][i + 1]])
            out[i] = _shared(n[[i]], m[[i]], np.array([differing]), np.array([True]))[0]
        again = np.isnan(found) & (cells < most)
        todo, cells, most = todo[again], np.minimum(cells[again] * GROWTH, most[again]), most[again]
    return out, retried


def _edited(data: bytes, raw: np.ndarray, bounds: np.ndarray, follower: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(edited texts, code points) of the first len(follower) texts: the last half is replaced by the start of text follower[i]."""
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    leads = np.append(leads, len(raw))
    at = np.searchsorted(leads, bounds)
    at[-1] = len(leads) - 1
    chars = np.diff(at)
    out = []
    for i, j in enumerate(follower.tolist()):
        half = int(chars[i]) // 2
        kept = leads[at[i] + int(chars[i]) - half] if half else bounds[i + 1]
        end = leads[at[j] + half] if half < chars[j] else bounds[j + 1]
        out.append(data[bounds[i] : kept] + data[bounds[j] : end])
    return out, chars


def compared(texts: list[bytes], follower: np.ndarray) -> list[pa.Array]:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, retries of the first len(follower) texts."""
    data = b"".join(texts)
    raw = np.frombuffer(data, np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    own = digests(raw, bounds)
    edited, chars = _edited(data, raw, bounds, follower)
    changed = digests(np.frombuffer(b"".join(edited), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in edited])]).astype(np.int64))
    n = len(follower)
    prints = encoded(np.diff(own[1]), sketches(*own))
    edited_prints = encoded(np.diff(changed[1]), sketches(*changed))
    digest, count = _gather(*own, follower)
    head, following = (own[0][: own[1][n]], own[1][: n + 1]), (digest, np.concatenate([[0], np.cumsum(count)]))
    near_edited, _ = likeness(prints[:n], edited_prints, head, changed)
    near_next, _ = likeness(prints[:n], [prints[j] for j in follower.tolist()], head, following)
    return [
        pa.array(chars[:n], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
        pa.array(prints[:n], pa.binary()),
        pa.array(edited_prints, pa.binary()),
        pa.array(near_edited),
        pa.array(near_next),
    ]


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's rows (id, text, follows) in order, of which the last, that follows, is the first text of the next range: the results of the others."""
    ids: list[pa.Array] = []
    texts: list[bytes] = []

    def flush() -> pa.RecordBatch:
        n = len(texts) - 1
        own = pa.concat_arrays(ids)
        batch = pa.RecordBatch.from_arrays([own.slice(0, n), *compared(texts, np.arange(1, n + 1))], names=["id", *_NAMES])
        ids[:] = [own.slice(n)]
        del texts[:-1]
        return batch

    for batch in batches:
        raw, bounds = utf8(batch.column(1))
        data, follows = raw.tobytes(), batch.column(2).to_pylist()
        held, begin = sum(map(len, texts)), 0
        for i in range(len(batch)):
            texts.append(data[bounds[i] : bounds[i + 1]])
            held += len(texts[-1])
            if follows[i] or (held > _ROWS_BYTES and len(texts) > 1):
                ids.append(batch.column(0).slice(begin, i + 1 - begin))
                begin = i + 1
                if len(texts) > 1:
                    yield flush()
                if follows[i]:
                    ids[:], texts[:] = [], []
                held = sum(map(len, texts))
        if begin < len(batch):
            ids.append(batch.column(0).slice(begin))


def _after(one: tuple, other: tuple) -> int:
    """Whether (id, beginning) stands after (1), before (-1) or at (0) another: ids descending, null last, then beginnings."""
    (a, x), (b, y) = one, other
    if a != b:
        if a is None or b is None:
            return 1 if a is None else -1
        return 1 if a < b else -1
    return (x > y) - (x < y)


def _range_of(borders: list[tuple]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """The number of borders that do not stand after a row."""

    def run(ids: pa.Array, beginnings: pa.Array) -> pa.Array:
        place = cmp_to_key(_after)
        keys = [place(b) for b in borders]
        return pa.array([bisect_right(keys, place(row)) for row in zip(ids.to_pylist(), beginnings.to_pylist(), strict=True)], pa.int32())

    return run


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ranges of (id, beginning of the text), so rows that repeat an id are split by their texts; their borders are rows of a bounded sample
    keys = rows.select("id", F.substring("text", 1, _PREFIX).alias("beginning"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = keys.orderBy(F.xxhash64("id", "beginning"), "id", "beginning").limit(_SAMPLED * ranges)
    sample = sorted({tuple(r) for r in sample.collect()}, key=cmp_to_key(_after))
    borders = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}, key=cmp_to_key(_after)) if sample else []
    dealt = rows.withColumn("range", F.arrow_udf(_range_of(borders), "int")("id", F.substring("text", 1, _PREFIX)))
    # the first row of each range, by number of the range: its id, then of the rows with this id the least text
    top = dealt.groupBy("range").agg(F.max("id").alias("top"))
    at_top = dealt.join(F.broadcast(top.withColumnRenamed("range", "r")), (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("top")))  # a row for each range
    first = cut(at_top.groupBy("range").agg(F.min("text").alias("text")))
    names = first.select("range", F.coalesce(F.lag("range").over(W.orderBy("range")), F.max("range").over(W.partitionBy())).alias("before"))  # texts do not pass here
    following = first.join(names, "range").select(F.lit(None).cast(kind).alias("id"), "text", F.col("before").alias("range"), F.lit(True).alias("follows"))
    laid = dealt.withColumn("follows", F.lit(False)).unionByName(following)
    ordered = laid.repartitionById(len(borders) + 1, "range").sortWithinPartitions("range", "follows", F.desc_nulls_last("id"), F.asc("text"))
    whole = ordered.select("id", "text", "follows").mapInArrow(_in_order, f"id {kind}, {_RESULT}")
    prints = {c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")}
    return whole.withColumns(prints).withColumnRenamed("id", id_col)
