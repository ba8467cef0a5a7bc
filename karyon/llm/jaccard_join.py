"""Near-duplicate join on word 5-grams: MinHash LSH forest, then exact verification.

1. Texts with the same words are copies; one representative of each class of copies goes on.
2. Each representative gets `trees` x `depth` MinHash values. A tree is the prefix trie of its runs of `depth` values,
   laid out as the sorted run of these signatures: texts with a common prefix stand next to each other. A task gets whole
   subtrees (texts that share the shortest prefix any text can need), sorted.
3. In a subtree, matching starts at full depth. Texts that share the prefix and agree in enough of all their MinHash values
   (`least_agreement`) are joined. Then the prefix is shortened by one value, for the texts alone that need it: a text is
   done at the depth where a partner at the least similarity that its number of shingles allows, the threshold at
   least, shares a prefix in some tree with probability `recall` (`stop_depths`); and runs whose texts are joined already are passed over.
   Only (member, root) rows leave a task, never pairs.
4. The texts of a candidate cluster meet in pairs of blocks, bounded in texts and in shingles; each pair of texts is verified
   there by its exact Jaccard similarity and counted at both ends.
5. Verified links are joined to groups.

Large subtrees and clusters are dealt over many tasks by pairs of blocks, so no task holds one whole.

Result: one row for each input row: class_id (the least id linked to it, directly or through others; its own if none), n_links
(documents with another word sequence at the threshold or more, copies counted), copy_id (the least id of its
copies), n_copies (documents with the same words, itself included).

Ids may be of any type that has an order, and null or repeated. Rows that repeat an id and the words are one document, each with its own output row;
rows of one id with different words are different documents; a row without an id is a document of its own. class_id and copy_id are null
only if no document of the class has an id. Null and empty texts, and texts without words, have no shingles and are copies of each other with
no links. A text of one to four words has one shingle. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_roots
from .tables import columns_of, cut
from .text import CHUNK_BYTES, chunks, mix, shingles, words
from .workers import released

WIDTH = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
NODE_BLOCK = 512
BLOCK = 256
#: Shingles of a block of texts to verify, unless a text alone has more.
BLOCK_SHINGLES = 1 << 18
#: Bits of a MinHash value below the shortest prefix that are compared when texts are sorted; equal bits of different values cost a comparison, no result.
_SUFFIX_BITS = 21
#: Columns of the incidence matrix multiplied at once.
_COLUMNS = 4096
#: A pair at the threshold agrees in fewer MinHash values than so many standard deviations allow once in 10^8 times.
DEVIATIONS = 5.6


def collision(similarity: float, length: int, trees: int) -> float:
    """The probability that a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def prefix_length(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that a pair of this similarity shares in some tree with at least this probability."""
    length = depth
    while length > 1 and collision(similarity, length, trees) < recall:
        length -= 1
    return length


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity of the threshold or more that a set of n shingles can have with any other: i shared of a union of u, i <= n <= u."""
    shared = [(math.ceil(threshold * u - 1e-9), u) for u in range(n, int(n / threshold + 1e-9) + 1)]
    return min([i / u for i, u in shared if i <= n], default=1.0)


def stop_depths(threshold: float, trees: int, depth: int, recall: float, most: int = 400) -> np.ndarray:
    """The depth at which a text is done, by its number of shingles (the last entry for all larger ones)."""
    return np.array([prefix_length(max(threshold, least_similarity(n, threshold)) if n else 1.0, trees, depth, recall) for n in range(most)] + [prefix_length(threshold, trees, depth, recall)])


def least_agreement(threshold: float, values: int) -> int:
    return max(1, math.floor(values * threshold - DEVIATIONS * math.sqrt(values * threshold * (1 - threshold))))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def minhashes(grams: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """rows x values least 32-bit hashes; rows without shingles have zeros."""
    out = np.zeros((len(at) - 1, values), np.uint32)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    factors, offsets = _multipliers(values)
    starts = at[some]
    high, low = (grams >> np.uint64(32)).astype(np.uint32), grams.astype(np.uint32)
    for k in range(values):
        a, b, c = np.uint32(factors[k] & np.uint64(0xFFFFFFFF)), np.uint32(factors[k] >> np.uint64(32)) | np.uint32(1), np.uint32(offsets[k] >> np.uint64(32))
        hashed = (high ^ c) * a
        hashed += low * b
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        out[some, k] = np.minimum.reduceat(hashed, starts)
    return out


def _signatures(trees: int, depth: int, root: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40  # the table is written once, so the numbers stay
        for batch in batches:
            for first, end, raw, bounds in chunks(batch.column(1), CHUNK_BYTES):
                hashes, at = words(raw, bounds)
                grams, gram_at = shingles(hashes, at, width)
                least = minhashes(grams, gram_at, trees * depth).reshape(end - first, trees, depth)
                nodes = np.zeros((end - first, trees), np.uint64)
                for k in range(root):
                    nodes = mix(nodes ^ least[:, :, k].astype(np.uint64)) + np.uint64(k)
                nodes = mix(nodes + mix(np.arange(1, trees + 1, dtype=np.uint64)))
                rest = np.zeros((end - first, trees), np.uint64)
                for k in range(root, depth):
                    rest = rest << np.uint64(_SUFFIX_BITS) | mix(least[:, :, k].astype(np.uint64)) & np.uint64((1 << _SUFFIX_BITS) - 1)
                place = mix((np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64) + np.uint64(1))
                both = []
                for keyed in (mix(hashes ^ place), mix(hashes + place)):  # 128 bits of the words and their places
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(keyed, out=total[1:])
                    both.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                ends = pa.array(np.arange(end - first + 1) * trees, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(end - first)),
                        *both,
                        pa.array(np.diff(gram_at)),
                        pa.ListArray.from_arrays(ends, pa.array(nodes.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(ends, pa.array(rest.view(np.int64).ravel())),
                        pa.array([x.tobytes() for x in mix(least.astype(np.uint64)).astype(np.uint8)], pa.binary()),
                        *[c.slice(first, end - first) for c in batch.columns],
                    ],
                    names=["row", "same_a", "same_b", "n_shingles", "nodes", "rest", "signature", *batch.schema.names],
                )
                row += end - first

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first two columns, as one batch for each pair of values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key, part = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        turn = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        edges = [0, *turn.tolist(), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and (key[a], part[a]) != last:
                yield _one(held)
                held = []
            last = key[a], part[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare with each other: the two blocks of a pair, or a block with itself."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (left, right) if len(right) else (left, left)


def forest_pairs(rest: np.ndarray, stop: np.ndarray, signature: np.ndarray, side: np.ndarray, depth: int, root: int, least: int) -> np.ndarray:
    """Pairs of rows of one subtree, sorted by `rest`, that join all texts which share a long enough prefix and agree enough.

    From full depth on the prefix is shortened value by value. At each depth, runs of equal prefixes with texts that are not done before are
    compared, unless their texts are joined already.
    """
    n = len(rest)
    root_of, out = np.arange(n), [np.zeros((0, 2), np.int64)]
    two_sides = bool(side.any())
    for d in range(depth, root - 1, -1):
        prefix = rest.view(np.uint64) >> np.uint64(_SUFFIX_BITS * (depth - d))
        edges = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1], [True]]))
        pairs = []
        for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist(), strict=True):
            own = np.arange(a, b)
            if d < depth:
                own = own[stop[a:b] <= d]  # the others are done: what they have at the threshold has met them deeper
            if len(own) < 2 or (root_of[own] == root_of[own[0]]).all():
                continue
            left, right = (own[side[own] == 0], own[side[own] == 1]) if two_sides else (own, own)
            for i in left.tolist():
                other = right[root_of[right] != root_of[i]] if two_sides else right[(right > i) & (root_of[right] != root_of[i])]
                hit = other[(signature[other] == signature[i]).sum(axis=1) >= least] if len(other) else other
                if len(hit):
                    pairs.append(np.stack([np.full(len(hit), i), hit], axis=1))
        if pairs:
            out.extend(pairs)
            root_of = local_roots(n, np.concatenate(out))
            if (root_of == 0).all():
                break
    return np.concatenate(out)


def _node_roots(least: int, depth: int, root: int, stops: np.ndarray):
    """Of rows (node, part, id, side, signature, rest, n_shingles) sorted by node, part and rest: (member, root) of each subtree's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for rows in _groups(batches):
            if len(rows) < 2:
                continue
            ids, side, rest, shingle = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 5, 6))
            signature = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
            pairs = forest_pairs(rest, stops[np.minimum(shingle, len(stops) - 1)], signature, side, depth, root, least)
            if not len(pairs):
                continue
            roots = local_roots(len(ids), pairs)
            moved = np.flatnonzero(roots != np.arange(len(ids)))
            a.append(ids[moved])
            b.append(ids[roots[moved]])
            n += len(moved)
            if n > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def linked(grams: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of left, one of right) of different rows whose shingle sets have at least this Jaccard similarity."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((row, grams))
    gram, row = grams[order], row[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    size = np.bincount(row, minlength=len(at) - 1)
    turn = np.ones(len(gram), dtype=bool)
    turn[1:] = gram[1:] != gram[:-1]
    column = np.cumsum(turn) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    both = np.zeros((len(left), len(right)), np.float32)
    ends = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + _COLUMNS, _COLUMNS))
    for a, b in zip(ends, ends[1:], strict=False):
        if b > a:
            block = np.zeros((len(size), _COLUMNS), np.float32)
            block[row[a:b], column[a:b] % _COLUMNS] = 1
            both += block[left] @ block[right].T
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero((both >= threshold * union - 1e-6) & (both > 0))
    different = left[i] != right[j]
    return left[i][different], right[j][different]


def _verified(width: int, threshold: float):
    """Of rows (cluster, part, id, side, copies, text) sorted by cluster and part: (id, root, links), a row for each linked id of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            if len(rows) < 2:
                continue
            ids, copies = rows.column(2).to_numpy(zero_copy_only=False), rows.column(4).to_numpy(zero_copy_only=False)
            left, right = _sides(rows.column(3).to_numpy(zero_copy_only=False))
            parts = [(shingles(*words(raw, bounds), width)) for _, _, raw, bounds in chunks(rows.column(5))]
            at = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]), out=at[1:])
            i, j = linked(np.concatenate([p[0] for p in parts]), at, left, right, threshold)
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(ids))
            if left is not right:
                links += np.bincount(j, copies[i], len(ids))
            some = np.flatnonzero(links)
            roots = local_roots(len(ids), np.stack([i, j], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[roots[some]]), pa.array(links[some].astype(np.int64))], names=["id", "root", "links"])

    return run


def _dealt(df: DataFrame, key: str, block: int, block_weight: int | None = None) -> DataFrame:
    """df with the groups of `key` that have at least two rows, dealt to pairs of blocks: columns part and side.

    Rows go to blocks of about `block` rows (and `block_weight` of their column weight) by a hash of their id, and each block meets itself and every
    other one. The sizes are a table of their own, so that a hot key is a skewed partition of a plain join, which adaptive execution splits.
    """
    weight = F.sum("weight") if block_weight else F.lit(0)
    sizes = cut(df.groupBy(key).agg(F.count("*").alias("members"), weight.alias("whole")).where("members > 1"))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("whole") / (block_weight or 1)), F.lit(1))
    df = df.join(sizes, key).withColumn("blocks", F.least(blocks, F.col("members")).cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    part = F.least("own", "other") * F.col("blocks").cast("long") + F.greatest("own", "other")
    return df.withColumn("part", part).withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0)).drop("members", "whole", "blocks", "own", "other")


def _grouped(docs: DataFrame, id_col: str, text_col: str, carried: list[str], width: int, threshold: float, trees: int, depth: int, recall: float, node_block: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each input row with its number, words and carried columns; each class of copies with its group (a row number), class_id and links."""
    plain = [f"c{k}" for k in range(len(carried))]  # mapInArrow takes no names with dots
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col("`" + c.replace("`", "``") + "`").alias(p) for c, p in zip(carried, plain, strict=True)])
    stops = stop_depths(threshold, trees, depth, recall)
    root = max(int(stops.min()), depth - 64 // _SUFFIX_BITS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"row bigint, same_a bigint, same_b bigint, n_shingles bigint, nodes array<bigint>, rest array<bigint>, signature binary, {schema}"
    signed = cut(docs.mapInArrow(released(_signatures(trees, depth, root, width)), schema))

    # a class of copies goes by its first row; rows without an id count one by one
    ids = F.countDistinct("id") + F.count(F.when(F.col("id").isNull(), 1))
    classes = cut(signed.groupBy("same_a", "same_b").agg(F.min("row").alias("row"), F.min("id").alias("copy_id"), ids.alias("n_copies"), F.max("n_shingles").alias("n_shingles")))
    firsts = classes.where("n_shingles > 0").select(F.col("row").alias("id"), F.col("n_copies").alias("copies"), F.col("n_shingles").alias("weight"))

    rows = signed.drop("id").withColumnRenamed("row", "id")
    members = rows.select("id", "nodes", "rest").join(firsts.select("id"), "id", "left_semi").select("id", F.explode(F.arrays_zip("nodes", "rest")).alias("n")).select("id", F.col("n.nodes").alias("node"), F.col("n.rest").alias("rest"))
    compared = _dealt(members, "node", node_block).join(rows.select("id", "signature", "n_shingles"), "id").select("node", "part", "id", "side", "signature", "rest", "n_shingles")
    compared = compared.repartition("node", "part").sortWithinPartitions("node", "part", "rest")
    candidates = compared.mapInArrow(released(_node_roots(least_agreement(threshold, trees * depth), depth, root, stops)), "a bigint, b bigint")
    clusters = components(candidates)

    placed = _dealt(clusters.select("id", F.col("component").alias("cluster")).join(firsts, "id"), "cluster", block, BLOCK_SHINGLES)
    texts = placed.join(rows.select("id", "text"), "id").select("cluster", "part", "id", "side", "copies", "text")
    texts = texts.repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    found = cut(texts.mapInArrow(released(_verified(width, threshold)), "id bigint, root bigint, links bigint"))
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))

    # the class id of a group is the least copy_id of its members
    grouped = cut(groups.join(links, "id", "left").withColumnRenamed("id", "row").join(classes.select("row", "copy_id"), "row"))
    least = cut(grouped.groupBy("component").agg(F.min("copy_id").alias("class_id")))
    grouped = grouped.join(least, "component").select("row", F.col("component").alias("group"), "class_id", "links")
    named = classes.join(grouped, "row", "left").select(
        "same_a", "same_b", F.coalesce("group", "row").alias("group"), F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "copy_id", F.col("n_copies").cast("long").alias("n_copies")
    )
    return signed, cut(named)


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, node_block: int = NODE_BLOCK, block: int = BLOCK
) -> DataFrame:
    """(id, class_id, n_links, copy_id, n_copies) of every document."""
    signed, named = _grouped(docs, id_col, text_col, [], width, threshold, trees, depth, recall, node_block, block)
    own = signed.select("id", "same_a", "same_b").join(named, ["same_a", "same_b"])
    return own.select(F.col("id").alias(id_col), "class_id", "n_links", "copy_id", "n_copies")


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, node_block: int = NODE_BLOCK, block: int = BLOCK
) -> DataFrame:
    """The rows of docs, all columns, that stand for their groups: of each group one row with its least id (any one if no row has an id)."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    signed, named = _grouped(docs, id_col, text_col, others, width, threshold, trees, depth, recall, node_block, block)
    own = signed.select("row", "id", "same_a", "same_b").join(named.select("same_a", "same_b", "group", "class_id"), ["same_a", "same_b"])
    kept = cut(own.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("group").agg(F.min("row").alias("row")))
    rows = signed.join(kept.select("row"), "row", "left_semi")
    return rows.select("id", "text", *[f"c{k}" for k in range(len(others))]).toDF(id_col, text_col, *others).select(*columns_of(docs))
