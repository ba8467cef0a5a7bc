"""Toxicity by two class-conditional Kneser-Ney models of byte n-grams with shared backoff counts.

The symbols are the bytes of a text with A-Z lowered; every run of bytes outside words is one space. For a class c with counts
n_c of symbols x after histories h of ORDER - 1 symbols:

    P_c(x | h) = (max(n_c(h x) - D_c, 0) + (D_c t_c(h) + STRENGTH) P(x | h)) / (n_c(h) + STRENGTH)

t_c(h) is the number of different symbols after h, and D_c = n1 / (n1 + 2 n2) from the numbers of n-grams seen once and twice.
P is shared by both classes: the interpolated Kneser-Ney model of all documents, labelled or not, whose lower orders count
the different symbols before an n-gram (continuation counts). So an expression that a class has seen little is scored
alike by both, and STRENGTH keeps the class with fewer texts from looking less likely everywhere.

The two log-likelihoods are compared word by word. A document's features are its mean ratio and that of its TOP
highest words, both less its median word, and the median itself: the classes differ in their shares of languages and
topics, which moves all words of a document and so the median, while toxic expressions stand out from it. A logistic
function fitted on labelled documents apart makes the score.

Counting is a map over the documents and one aggregation by n-gram, of which there are as many as an alphabet allows, not as
documents have words. An n-gram that no class has seen has a ratio that depends on its history only, so the table that tasks look up
(files of the shared folder, mapped page by page) holds the n-grams and histories of the labelled documents.

Counts use all labelled documents that are not held out, but for at most `most` of each class, a fifth of them, that fit the logistic function.
Null and empty texts have all features 0. Without labels of both classes the score is the rate of label 1 (0 without labels). Repeated
rows get the same result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labelled import known_labels, label_rate, picked, remainder, texts_of
from .lookup import Lookup, lookup
from .tables import cut
from .text import IS_WORD, LOWER, chunks
from .workers import released

MOST = 8000
THRESHOLD = 0.3
ORDER = 5
STRENGTH = 100.0
#: The part of a document's words whose mean stands for its most telling ones.
TOP = 0.03
#: n-grams that a task holds before it passes their counts on.
MOST_HELD = 1 << 21
#: Of these, so many are in a batch.
_ROWS = 1 << 16
#: Texts are looked up so many bytes at a time.
_SLICE = 1 << 20
_SPACE = 32
_SYMBOL = np.where(IS_WORD[LOWER], LOWER, _SPACE).astype(np.uint8)
#: Histories have keys below 0, n-grams from 0 on.
_HISTORY = -(1 << 62)


@dataclass
class Model:
    table: Lookup  # log ratios of n-grams, and of unseen symbols after a history
    weights: np.ndarray  # of the logistic function
    always: float | None = None


def symbols(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, offsets by text). Each text begins with one space, in which all histories before it end."""
    rows = len(bounds) - 1
    own = _SYMBOL[raw]
    inside = np.ones(len(own), dtype=bool)
    if len(own):
        inside[1:] = (own[1:] != _SPACE) | (own[:-1] != _SPACE)
        starts = bounds[:-1][np.diff(bounds) > 0]
        inside[starts] = own[starts] != _SPACE
    kept = np.concatenate([[0], np.cumsum(inside)])[bounds]
    out = np.insert(own[inside], kept[:-1], _SPACE)
    return out, kept + np.arange(rows + 1)


def ngrams(own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol, its bytes packed in a long; `before` has the ORDER - 1 symbols in front."""
    padded = np.concatenate([before, own]).astype(np.int64)
    out = np.zeros(len(own), np.int64)
    for k in range(ORDER):
        out = (out << 8) | padded[k : k + len(own)]
    return out


def _slices(own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, n-grams) of runs of symbols."""
    for a in range(0, len(own), _SLICE):
        before = own[max(0, a - ORDER + 1) : a]
        yield a, ngrams(own[a : a + _SLICE], np.concatenate([np.full(ORDER - 1 - len(before), _SPACE, np.uint8), before]))


def _plain_histories(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """own with ORDER - 1 more spaces before each text, so that no history reaches into the text before; what ends in these spaces belongs to no text."""
    gap = np.full(ORDER - 1, _SPACE, np.uint8)
    return np.insert(own, np.repeat(at[:-1], len(gap)), np.tile(gap, len(at) - 1)), at + np.arange(len(at)) * len(gap)


def _counts(label_of: Lookup):
    """From (key of the id, text): (gram, n0, n1, n), its counts in the texts of either class and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (n-gram and, in the last two bits, its text's class), count
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[at], np.add.reduceat(n, at)

        def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), _ROWS):  # an n-gram on a border is in both batches, a part of its count in each
                key, n = keys[a : a + _ROWS], counts[a : a + _ROWS]
                gram, kind = key >> 2, key & 3
                at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                own = [np.where(kind == 0, n, 0), np.where(kind == 1, n, 0), n]
                yield pa.RecordBatch.from_arrays([pa.array(gram[at]), *(pa.array(np.add.reduceat(c, at)) for c in own)], names=["gram", "n0", "n1", "n"])

        for batch in batches:
            label = label_of.find_one(batch.column(0).to_numpy()) if label_of.files else np.full(len(batch), np.nan)
            for first, end, raw, bounds in chunks(batch.column(1)):
                own, at = _plain_histories(*symbols(raw, bounds))
                kind = np.nan_to_num(label[first:end], nan=2).astype(np.int64)
                for a, gram in _slices(own):
                    text = np.searchsorted(at, np.arange(a, a + len(gram)), side="right") - 1
                    inside = np.arange(a, a + len(gram)) - at[text] >= ORDER - 1
                    held.append(np.unique(((gram << 2) | kind[text])[inside], return_counts=True))
                    size += len(held[-1][0])
                    if size > MOST_HELD:
                        found = merged()
                        if len(found[0]) > MOST_HELD // 2:
                            yield from rows(*found)
                            size = 0
                        else:
                            held.append(found)
                            size = len(found[0])
        if size:
            yield from rows(*merged())

    return run


def _label_lookup(known: DataFrame) -> Lookup:
    return lookup(cut(known.select(F.xxhash64(F.col("id").cast("string")).alias("key"), F.col("label").cast("double").alias("value")).groupBy("key").agg(F.max("value").alias("value"))))


def _discount(n: Column) -> Column:
    once, twice = F.count(F.when(n == 1, 1)), F.count(F.when(n == 2, 1))
    return F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5)


def shared_model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p): the interpolated Kneser-Ney probability of the last symbol of each n-gram of counts (gram, n), lower orders by continuation counts."""
    levels = {order: counts.select("gram", "n")}
    for m in range(order - 1, 0, -1):
        levels[m] = cut(levels[m + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    lower = None
    for m in range(1, order + 1):
        discount = float(levels[m].agg(_discount(F.col("n"))).first()[0])
        after = W.partitionBy(F.shiftright("gram", 8))  # at most 256 rows
        rows = levels[m].select("gram", "n", F.sum("n").over(after).alias("total"), F.count("*").over(after).alias("types"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))).join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
        lower = rows.select("gram", ((F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("types") * F.col("below")) / F.col("total")).alias("p"))
        if m < order:
            lower = cut(lower)
    return lower


def ratio_table(counts: DataFrame, strength: float = STRENGTH) -> Lookup:
    """The log ratios of the two class models: of each n-gram of a class, and of a symbol that neither has seen after a history."""
    own = counts.where("n0 + n1 > 0")
    found = own.agg(_discount(F.col("n0")).alias("d0"), _discount(F.col("n1")).alias("d1")).first()
    after = W.partitionBy("history")
    rows = own.join(shared_model(counts), "gram").withColumn("history", F.shiftright("gram", 8))
    for c in (0, 1):
        n, d = F.col(f"n{c}"), float(found[f"d{c}"])
        left, whole = d * F.sum((n > 0).cast("int")).over(after) + strength, F.sum(n).over(after) + strength
        rows = rows.withColumns({f"p{c}": (F.greatest(n - d, F.lit(0.0)) + left * F.col("p")) / whole, f"b{c}": left / whole})
    rows = cut(rows.select("gram", "history", F.log(F.col("p1") / F.col("p0")).alias("value"), F.log(F.col("b1") / F.col("b0")).alias("unseen")))
    histories = rows.groupBy("history").agg(F.first("unseen").alias("value")).select((F.col("history") + F.lit(_HISTORY)).alias("key"), "value")
    return lookup(cut(rows.select(F.col("gram").alias("key"), "value").unionByName(histories)))


def word_ratios(model: Model, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each word as toxic less that as ordinary, offsets by text). A word's space before it is a part of it."""
    own, at = _plain_histories(*symbols(raw, bounds))
    value = np.zeros(len(own), np.float32)
    for a, gram in _slices(own):
        some, inverse = np.unique(gram, return_inverse=True)
        ratio = model.table.find_one(some)
        unseen = np.flatnonzero(np.isnan(ratio))
        ratio[unseen] = np.nan_to_num(model.table.find_one((some[unseen] >> 8) + _HISTORY))
        value[a : a + len(gram)] = ratio[inverse]
    space = own == _SPACE
    begins = np.flatnonzero(space[:-1] & ~space[1:]) if len(own) else np.zeros(0, np.int64)
    ends = np.minimum(np.append(begins[1:], len(own)), at[np.searchsorted(at, begins, side="right")]) if len(begins) else begins
    sums = np.add.reduceat(np.append(value, 0).astype(np.float64), np.stack([begins, ends], axis=1).ravel())[::2] if len(begins) else np.zeros(0)
    return sums, np.searchsorted(begins, at)


def features(ratios: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(1, mean less median, mean of the highest less median, median) of each text's words."""
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    ordered = ratios[np.lexsort((ratios, text))]
    total = np.concatenate([[0.0], np.cumsum(ordered)])
    out = np.zeros((len(n), 4))
    out[:, 0] = 1
    some = np.flatnonzero(n)
    a, k = at[:-1][some], n[some]
    median = (ordered[a + (k - 1) // 2] + ordered[a + k // 2]) / 2
    top = np.maximum(1, (k * TOP).astype(np.int64))
    out[some, 1] = (total[a + k] - total[a]) / k - median
    out[some, 2] = (total[a + k] - total[a + k - top]) / top - median
    out[some, 3] = median
    return np.round(out, 9)  # so that equal texts are scored alike wherever they stand


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a slightly damped logistic regression, by Newton steps; columns are scaled first."""
    scale = np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-3)
    x = x / scale
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)])
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> Model:
    usable = remainder("id", 4) != 2
    n, ones = label_rate(labels, id_col, label_col, usable)
    if not ones or ones == n:
        return Model(Lookup([]), np.zeros(4), always=ones / n if n else 0.0)
    rate = ones / n
    known = known_labels(labels, id_col, label_col, usable)
    apart = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0
    chosen = cut(picked(known.where(apart), docs, id_col, most))
    counted = cut(known.join(F.broadcast(chosen.select("id")), "id", "left_anti"))  # chosen has at most 2 x most rows
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))).otherwise(F.lit(0))
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    counts = cut(texts.mapInArrow(released(_counts(_label_lookup(counted))), "gram bigint, n0 bigint, n1 bigint, n bigint").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n")]))
    both = counts.agg(F.sum("n0"), F.sum("n1")).first()
    if not both[0] or not both[1]:
        return Model(Lookup([]), np.zeros(4), always=rate)
    model = Model(ratio_table(counts), np.zeros(4))
    x, y = _scored(texts_of(docs, chosen, id_col, text_col), model)
    if len(set(y.tolist())) < 2:
        x, y = _scored(texts_of(docs, picked(counted, docs, id_col, most), id_col, text_col), model)
    shares = np.bincount(y, minlength=2) / max(1, len(y))
    if not shares.all():
        model.always = rate
        return model
    model.weights = _logistic(x, y, np.where(y == 1, rate / shares[1], (1 - rate) / shares[0]))
    return model


def _scored(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, in an order of their own."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, bounds in chunks(batch.column(1)):
                x = features(*word_ratios(shared.value, raw, bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(1, 4))], names=["label", "a", "b", "c"])

    found = rows.select("label", "text").mapInArrow(released(run), "label int, a double, b double, c double").toArrow()
    y = found["label"].to_numpy().astype(np.int64)
    x = np.stack([np.ones(len(y)), *(found[c].to_numpy() for c in "abc")], axis=1)
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with score and predicted (their names after `prefix`; columns of docs with these names are replaced). One pass, no shuffle; only the text is an input of the score."""
    made = [f"{prefix}score", f"{prefix}predicted"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in made]
    place = names.index(text_col)
    plain = [f"c{k}" for k in range(len(names))]  # mapInArrow takes no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, raw, bounds in chunks(batch.column(place)):
                if model.always is None:
                    scores.append(1 / (1 + np.exp(-np.clip(features(*word_ratios(model, raw, bounds)) @ model.weights, -30, 30))))
                else:
                    scores.append(np.full(len(bounds) - 1, model.always))
            value = np.round(np.concatenate(scores), 12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[*plain, *made])

    chosen = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*plain)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.mapInArrow(released(run), schema + f", `{made[0]}` double, `{made[1]}` int").toDF(*names, *made)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, (remainder(id_col, 4) == 2).alias("held_out"), "score", "predicted")
