"""The order of a heatmap's rows: complete linkage of cells by Euclidean distance, and the leaves of the tree with higher means first.

Up to `CELLS_MOST` cells of a split are one tree, made by following nearest neighbours until two are each other's. More cells are first dealt to groups around pivots of a
bounded sample, too large groups by a hash; each group is a tree in a task of its own, and the groups' means are one more tree, so no task holds
more than CELLS_MOST cells' profiles. Cells of one clone are then next to each other as before; the order among distant groups is that of their means.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import computed_once
from .neighbours import SAMPLE, _distances, _pivots

CELLS_MOST = 2_000


def linkage(x: np.ndarray) -> list[tuple[int, int, float]]:
    """(one, other, height) of the merges of complete linkage in order of height; merge i makes node n + i."""
    n = len(x)
    d = np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in x]) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    node, alive, chain, found = list(range(n)), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        found.append((a, b, float(d[a, b])))
        d[a] = d[:, a] = np.maximum(d[a], d[b])  # the farthest pair of the two clusters
        d[a, a] = np.inf
        alive[b] = False
    order = sorted(range(len(found)), key=lambda i: found[i][2])  # a merge is never lower than those within it, and sorting keeps their order
    out = []
    for i in order:
        a, b, height = found[i]
        out.append((node[a], node[b], height))
        node[a] = n + len(out) - 1
    return out


def leaf_order(x: np.ndarray, weights: np.ndarray) -> list[int]:
    """Rows in order of the leaves: at each merge the side with the lower weight first; a merge weighs the mean of its sides."""
    n = len(x)
    if not n:
        return []
    weight, children = list(weights), {}
    for i, (a, b, _) in enumerate(linkage(x)):
        children[n + i] = (a, b) if (weight[a], a) <= (weight[b], b) else (b, a)
        weight.append((weight[a] + weight[b]) / 2)
    out, todo = [], [len(weight) - 1]
    while todo:
        k = todo.pop()
        if k < n:
            out.append(k)
        else:
            todo += reversed(children[k])
    return out


def row_order(rows: DataFrame, value: str = "value", split: str | None = None, cells_most: int = CELLS_MOST) -> DataFrame:
    """(cell_id, [split,] row_number) of cells with rows (cell_id, bin_idx, value); NULL counts as 0. With split, a column of each cell, numbers go on from one split to the next in its order."""
    kind = rows.schema["cell_id"].dataType.simpleString()
    by = F.col(split).cast("string") if split else F.lit("")
    profile = F.transform(F.array_sort(F.collect_list(F.struct("bin_idx", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))), lambda b: b["v"])
    cells = computed_once(rows.groupBy("cell_id").agg(F.first(by).alias("split"), profile.alias("v")))  # a genome's bins in each row
    n = cells.count()
    dealt = cells.withColumn("part", F.lit(0))
    if n > cells_most:
        sample = np.array([r.v for r in cells.orderBy(F.xxhash64("cell_id"), "cell_id").limit(SAMPLE).select("v").collect()])
        pivots = _pivots(sample, min(-(-4 * n // cells_most), cells_most // 2, len(sample)))

        def nearest_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(part=_distances(np.stack(batch["v"].to_list()), pivots).argmin(axis=1).astype("int32"))

        near = cells.mapInPandas(nearest_pivot, f"cell_id {kind}, split string, v array<double>, part int")
        near = computed_once(near)
        sizes = near.groupBy("split", "part").agg(F.ceil(F.count("*") / cells_most).cast("int").alias("n"))
        salted = near.join(sizes.withColumnsRenamed({"split": "s", "part": "p"}), near["split"].eqNullSafe(F.col("s")) & (near["part"] == F.col("p")))
        dealt = salted.select("cell_id", "split", "v", (F.col("part") * 1000 + F.pmod(F.xxhash64("cell_id"), F.col("n"))).cast("int").alias("part"))

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cell_id").reset_index(drop=True)
        x = np.stack(group["v"].to_list())
        ordered = group.iloc[leaf_order(x, -x.mean(axis=1))]
        return ordered[["cell_id", "split", "part"]].assign(within=range(len(group)), mean=[x.mean(axis=0)] + [None] * (len(group) - 1))

    placed = computed_once(dealt.groupBy("split", "part").applyInPandas(tree, f"cell_id {kind}, split string, part int, within int, mean array<double>"))
    if n > cells_most:

        def groups(parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("part").reset_index(drop=True)
            x = np.stack(parts["mean"].to_list())
            order = leaf_order(x, -x.mean(axis=1))
            return pd.DataFrame({"split": parts["split"].iloc[order], "part": parts["part"].iloc[order], "place": range(len(parts))})

        places = placed.where("mean IS NOT NULL").select("split", "part", "mean").groupBy("split").applyInPandas(groups, "split string, part int, place int")
    else:
        places = placed.select("split", "part").distinct().withColumn("place", F.lit(0))
    at = placed.groupBy("split", "part").agg(F.count("*").alias("cells")).withColumnsRenamed({"split": "s", "part": "p"})
    places = places.join(at, places["split"].eqNullSafe(at["s"]) & (places["part"] == at["p"])).select("split", "part", "place", "cells")
    first = places.select(F.col("split").alias("s"), F.col("part").alias("p"), (F.sum("cells").over(W.orderBy(F.asc_nulls_last("split"), "place")) - F.col("cells")).alias("before"))  # a row for each group
    found = placed.join(F.broadcast(first), placed["split"].eqNullSafe(F.col("s")) & (placed["part"] == F.col("p")))
    named = [F.col("split").alias(split)] if split else []
    return found.select("cell_id", *named, (F.col("before") + F.col("within") + 1).cast("int").alias("row_number"))
