"""Numbers of fragment starts in two windows before each fragment's start.

Neither is a range join. The near window has constant offsets: a RANGE frame. The far window depends on the cell's max_length, which no frame can have: Spark deals and sorts
the starts by cell and chromosome, as for the frame, and a helper goes over them in this order and keeps the starts that a later window may reach, not those of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_over(fragments: DataFrame, min_length: int = 50, window: int = 1) -> DataFrame:
    """count_over: starts in [start - min_length, start - window] of the cell and chromosome."""
    w = W.partitionBy("cell_id", "chr").orderBy("start").rangeBetween(-min_length, -window)
    return fragments.withColumn("count_over", F.count("*").over(w))


def _starts_between(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of rows (place in its group, from 1; start; low; high), sorted by group and start, the number of the group's starts in [low, high]; both rise with start, high is below it."""
    held = np.zeros(0, np.int64)
    for batch in batches:
        place, start, low, high = (a.to_numpy(zero_copy_only=False) for a in batch)
        if (high >= start).any():
            raise ValueError("max_length must be 1 at least")
        out = np.zeros(len(start), np.int64)
        begins = np.flatnonzero(place == 1)
        for a, b in pairwise([*([0] if len(start) and place[0] != 1 else []), *begins.tolist(), len(start)]):
            known = np.concatenate([held[:0] if place[a] == 1 else held, start[a:b]])
            out[a:b] = np.searchsorted(known, high[a:b], "right") - np.searchsorted(known, low[a:b], "left")
            held = known[np.searchsorted(known, low[b - 1], "left") :]
        yield pa.array(out)


def count_upstream(fragments: DataFrame) -> DataFrame:
    """count_upstream: starts in [trunc(start - 2 max_length), trunc(start - max_length)] of the cell and chromosome. max_length is one for a cell, and 1 at least."""
    low = (F.col("start") - 2 * F.col("max_length")).cast("long")
    high = (F.col("start") - F.col("max_length")).cast("long")
    counted = F.arrow_udf(_starts_between, "bigint").asNondeterministic()  # it goes by the order of rows
    placed = fragments.withColumn("__place", F.row_number().over(W.partitionBy("cell_id", "chr").orderBy("start")))
    return placed.withColumn("count_upstream", counted("__place", "start", low, high)).drop("__place")


def count_overlaps(fragments: DataFrame, min_length: int = 50, window: int = 1) -> DataFrame:
    """Both counts, their rates by window, and their sum. The windows' published widths are kept: min_length - window and max_length."""
    both = count_upstream(count_over(fragments, min_length, window))
    return both.withColumns(
        {
            "norm_over": F.col("count_over") / F.lit(float(min_length - window)),
            "norm_upstream": F.col("count_upstream") / F.col("max_length"),
            "olap_count": F.col("count_over") + F.col("count_upstream"),
        }
    )
