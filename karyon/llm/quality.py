"""Document quality: random-indexing word vectors pooled by document, and a two-layer network.

Tokens are runs of word characters (case kept) and runs of other visible characters. Each has a sparse random index vector, made
from its hash; its word vector is the sum of the index vectors of all its direct neighbours over all documents, scaled to
length 1. Each token has its own sum: a map emits partial sums by token, those of rare tokens as their few places that are not zero, and tasks that own
a range of the tokens' hashes add them up in order and write the vectors, a byte a place, to files of the shared folder. These are mapped page by page, so the vocabulary
has no bound and no process holds it. A document is pooled to the means and spreads
of its vectors and the mean change from token to token. A numpy network with one hidden layer reads these; a temperature
fitted on labelled documents apart calibrates its probabilities.

The network is fitted on at most `most` documents of each class; the word vectors use all documents. Null and
empty texts pool to zeros. Without labels of both classes the score is the rate of label 1 (1 without labels,
so that nothing is rejected). Repeated rows get the same result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import label_rate, labelled, remainder
from .lookup import Lookup, in_ranges, sorted_lookup
from .text import IS_WORD, LOWER, chunks, mix, spans, utf8
from .workers import released

SIZE = 48
NONZERO = 4
HIDDEN = 32
MOST = 6000
THRESHOLD = 0.5
_CHUNK = 1 << 19
#: Token rows that a task holds before it passes their sums on.
MOST_HELD = 3 << 16
#: Places of a partial sum that are passed on one by one, if no more are not zero; fewer than SIZE / 2.
FEW_PLACES = 23
#: Steps of a vector's values; with its own share a value is at most 1.5.
STEPS = 84

_KIND = np.full(256, 2, np.uint8)
_KIND[IS_WORD[LOWER]] = 1
_KIND[[0, 9, 10, 11, 12, 13, 32]] = 0


@dataclass
class Model:
    vectors: Lookup
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    always: float | None = None


def tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, offsets by document)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    kind = _KIND[raw]
    turn = np.ones(n + 1, dtype=bool)
    turn[1:n] = kind[1:] != kind[:-1]
    turn[bounds] = True
    edges = np.flatnonzero(turn)
    starts, ends = edges[:-1], edges[1:]
    seen = kind[starts] != 0
    starts, ends = starts[seen], ends[seen]
    return spans(raw, starts, ends), np.searchsorted(starts, bounds)


def index_places(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each tokens x NONZERO: the sparse index vector of each token, from hashes of the token."""
    h = np.stack([mix(token * np.uint64(NONZERO) + np.uint64(k + 1)) for k in range(NONZERO)], axis=1)
    return (h % np.uint64(SIZE)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int64)


def neighbour_sums(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens, SIZE sums of each: the index vectors of its neighbours)."""
    some, which = np.unique(token, return_inverse=True)
    joined = np.ones(len(token), dtype=bool)
    joined[at[:-1][at[:-1] < len(token)]] = False
    right = np.flatnonzero(joined)
    a, b = which[right - 1], which[right]
    place, sign = index_places(some)
    total = np.zeros(len(some) * SIZE, np.int32)
    for k in range(NONZERO):
        for one, other in ((a, b), (b, a)):
            total += np.bincount(one * SIZE + place[other, k], sign[other, k], len(total)).astype(np.int32)
    return some, total.reshape(-1, SIZE)


#: Types of whole sums in a packed row, told apart by its length; shorter rows are (place, value) of two bytes.
_WHOLE = (np.int8, np.int16, np.int64)


def packed(token: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches (token, sums): of rows with few places that are not zero, these and their values, a byte each; of the others SIZE integers as short as they may be."""
    most = np.abs(sums).max(axis=1, initial=0)
    few = ((sums != 0).sum(axis=1) <= FEW_PLACES) & (most < 128)
    own = sums[few]
    row, place = np.nonzero(own)
    flat = np.stack([place.astype(np.uint8), own[row, place].astype(np.int8).view(np.uint8)], axis=1).tobytes()
    ends = np.concatenate([[0], 2 * np.cumsum(np.bincount(row, minlength=len(own)))]).astype(np.int32)
    made, done = [(token[few], ends, flat)], few
    for kind in _WHOLE:
        fits = ~done & (most <= np.iinfo(kind).max)
        made.append((token[fits], np.arange(fits.sum() + 1, dtype=np.int32) * (np.dtype(kind).itemsize * SIZE), sums[fits].astype(kind).tobytes()))
        done = done | fits
    for tokens_, offsets, data in made:
        if len(tokens_):
            values = pa.Array.from_buffers(pa.binary(), len(tokens_), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(tokens_.view(np.int64)), values], names=["token", "sums"])


def unpacked(values: pa.Array) -> np.ndarray:
    """The rows of sums of a column that `packed` made."""
    raw, at = utf8(values)
    out = np.zeros((len(values), SIZE), np.int64)
    size = np.diff(at)
    few = np.ones(len(values), bool)
    for kind in _WHOLE:
        n = np.dtype(kind).itemsize * SIZE
        rows = np.flatnonzero(size == n)
        if len(rows):
            out[rows] = raw[at[rows][:, None] + np.arange(n)].view(kind)
            few[rows] = False
    few = np.flatnonzero(few)
    pairs = size[few] // 2
    row = np.repeat(few, pairs)
    begin = np.repeat(at[few], pairs) + 2 * (np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs))
    out[row, raw[begin]] = raw[begin + 1].view(np.int8)
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        some, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        total, at = np.zeros((len(some), SIZE), np.int32), 0
        while held:  # each has a token once
            token, sums = held.pop(0)
            total[which[at : at + len(token)]] += sums
            at += len(token)
        return some, total

    for batch in batches:
        for _, _, raw, bounds in chunks(batch.column(0), _CHUNK):
            token, at = tokens(raw, bounds)
            if not len(token):
                continue
            held.append(neighbour_sums(token, at))
            size += len(held[-1][0])
            if size > MOST_HELD:
                token, sums = merged()
                if len(token) > MOST_HELD // 2:  # frequent tokens stay, so each task passes them on once
                    order = np.argpartition(np.abs(sums).sum(axis=1), len(token) - MOST_HELD // 2)
                    rest, stay = np.sort(order[: len(token) - MOST_HELD // 2]), np.sort(order[len(token) - MOST_HELD // 2 :])
                    yield from packed(token[rest], sums[rest])
                    token, sums = token[stay], sums[stay]
                held, size = [(token, sums)], len(token)
    if held:
        yield from packed(*merged())


def _unit(token: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """(key, value): vectors of length 1 (or 0) with a share of the token's own index vector, in steps of 1 / STEPS."""
    out = sums.astype(np.float32)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)
    place, sign = index_places(token)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(len(token)), place[:, k]), sign[:, k].astype(np.float32) * np.float32(0.5 / np.sqrt(NONZERO)))
    flat = np.clip(np.rint(out * STEPS), -127, 127).astype(np.int8).tobytes()
    offsets = np.arange(len(token) + 1, dtype=np.int32) * SIZE
    values = pa.Array.from_buffers(pa.binary(), len(token), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), values], names=["key", "value"])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (token, sums) in order of tokens: a vector for each token."""
    last, carried = None, np.zeros(SIZE, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        token, sums = batch.column(0).to_numpy(), unpacked(batch.column(1))
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        own, total = token[at], np.add.reduceat(sums, at, axis=0, dtype=np.int32)
        if last == own[0]:
            total[0] += carried
        elif last is not None:
            yield _unit(np.array([last], np.int64).view(np.uint64), carried[None, :])
        last, carried = own[-1], total[-1]
        if len(own) > 1:
            yield _unit(own[:-1].view(np.uint64), total[:-1])
    if last is not None:
        yield _unit(np.array([last], np.int64).view(np.uint64), carried[None, :])


def word_vectors(docs: DataFrame, text_col: str = "text") -> Lookup:
    """The vector of each token of all documents."""
    parts = docs.select(text_col).mapInArrow(released(_neighbours), "token bigint, sums binary")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted_lookup(in_ranges(parts, "token", ranges), SIZE, np.int8, released(_added_up))  # a map of its own would take a second worker for each task


def pooled(vectors: Lookup, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each document: means, spreads and mean changes of its vectors, and the log of its length."""
    token, at = tokens(raw, bounds)
    rows = len(bounds) - 1
    out = np.zeros((rows, 3 * SIZE + 1), np.float32)
    n = np.diff(at)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    start, count = at[some], n[some].astype(np.float32)
    ends = np.append(start[1:], len(token)) - 1
    known, which = np.unique(token, return_inverse=True)
    for d, table in enumerate(np.ascontiguousarray(np.nan_to_num(vectors.find(known.view(np.int64))).T / np.float32(STEPS))):
        own = table[which]
        mean = np.add.reduceat(own, start) / count
        change = np.zeros_like(own)
        np.abs(own[1:] - own[:-1], out=change[:-1])
        change[ends] = 0  # the last token of a document has no successor
        own *= own
        out[some, d] = mean
        out[some, SIZE + d] = np.sqrt(np.maximum(np.add.reduceat(own, start) / count - mean * mean, 0))
        out[some, 2 * SIZE + d] = np.add.reduceat(change, start) / np.maximum(count - 1, 1)
    out[some, -1] = np.log1p(n[some])
    return out


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1500, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> list[np.ndarray]:
    """Adam on the weighted log loss; seeded."""
    rng = np.random.default_rng(17)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        own, target = x[pick], y[pick]
        hidden, logit = _forward(layers, own)
        error = weight[pick] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / batch
        back = np.outer(error, layers[2]) * (1 - hidden**2)
        grads = [own.T @ back + decay * layers[0], back.sum(axis=0), hidden.T @ error + decay * layers[2], np.array([error.sum()])]
        speed = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - speed * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def best_temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least weighted log loss, by golden section over its logarithm."""
    sign = 2.0 * y - 1

    def loss(t: float) -> float:
        return float((weight * np.logaddexp(0, -sign * logit / np.exp(t))).sum())

    low, high, golden = np.log(0.2), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> Model:
    usable = remainder("id", 3) != 1
    n, ones = label_rate(labels, id_col, label_col, usable)
    vectors = word_vectors(docs, text_col)
    model = Model(vectors, np.zeros(0), np.ones(0), [], always=ones / n if n else 1.0)
    if not ones or ones == n:
        return model
    sample = labelled(docs, labels, id_col, text_col, label_col, usable, most)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, bounds in chunks(batch.column(2), _CHUNK):
                rows = pooled(shared.value, raw, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "part", "row"])

    found = sample.mapInArrow(released(run), "label int, part int, row binary").toArrow()
    if not found.num_rows:
        return model
    x = np.frombuffer(b"".join(found["row"].to_pylist()), np.float32).reshape(found.num_rows, -1).astype(np.float64)
    y, part = found["label"].to_numpy(), found["part"].to_numpy()
    order = np.lexsort((*x.T[:3], part, y))  # the rows' order depends on the partitions
    x, y, part = x[order], y[order], part[order]
    seen = part > 0
    if len(set(y[seen].tolist())) < 2 or len(set(y[~seen].tolist())) < 2:
        seen = np.ones(len(y), dtype=bool)
    if len(set(y.tolist())) < 2:
        return model
    rate = ones / n
    shares = np.bincount(y, minlength=2) / len(y)
    weight = np.where(y == 1, rate / shares[1], (1 - rate) / shares[0])
    model.centre, model.scale = x[seen].mean(axis=0), np.maximum(x[seen].std(axis=0), 1e-3)
    z = (x - model.centre) / model.scale
    model.layers = train(z[seen], y[seen], weight[seen])
    apart = ~seen if not seen.all() else seen
    model.temperature = best_temperature(_forward(model.layers, z[apart])[1], y[apart], weight[apart])
    model.always = None
    return model


def probabilities(model: Model, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if model.always is not None:
        return np.full(len(bounds) - 1, model.always)
    z = (pooled(model.vectors, raw, bounds) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(_forward(model.layers, z)[1] / model.temperature, -30, 30)))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with score and predicted (their names after `prefix`; columns of docs with these names are replaced). One pass, no shuffle; only the text is an input of the score."""
    made = [f"{prefix}score", f"{prefix}predicted"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in made]
    place = names.index(text_col)
    plain = [f"c{k}" for k in range(len(names))]  # mapInArrow takes no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.concatenate([np.zeros(0), *(probabilities(shared.value, raw, bounds) for _, _, raw, bounds in chunks(batch.column(place), _CHUNK))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[*plain, *made])

    picked = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*plain)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(released(run), schema + f", `{made[0]}` double, `{made[1]}` int").toDF(*names, *made)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, (remainder(id_col, 3) == 1).alias("held_out"), "score", "predicted")
