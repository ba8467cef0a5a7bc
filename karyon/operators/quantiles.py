"""Exact quantiles of a whole table by narrowing ranges: no task and no driver holds the values."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import computed_once

#: Values of a range that are few enough to be gathered.
FEW = 4096
#: Ranks on either side of a wanted one, as a share of its range, within which it is looked for next; and the accuracy of the sketches that say where that is.
NEAR, ACCURACY = 0.001, 10_000
ROUNDS_MOST = 100


def _parts(value: Column, points: list[float]) -> Column:
    """Even numbers for the gaps around the points, odd ones for the points."""
    part = F.lit(0)
    for p in points:
        part = part + F.when(value > p, 2).when(value == p, 1).otherwise(0)
    return part


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles of a column, as `percentile` gives them; NULL and NaN are left out. None without values.

    In each round a sketch of bounded size names values close to the wanted ranks, and the values below, at, between and above them are counted. What is certain are these
    counts: the part that holds the rank is the next range, and the values named are not in it, so ranges shrink to a thousandth or to one value. Ranges of at most
    FEW values are gathered.
    """
    values = computed_once(df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)"))
    n, low, high = values.agg(F.count("*"), F.min("value"), F.max("value")).first()
    if not n:
        return [None] * len(shares)
    value = F.col("value")
    places = [s * (n - 1) for s in shares]
    ranks = sorted({f(p) for p in places for f in (floor, ceil)})
    at = dict.fromkeys(ranks, (low, high, 0, n))  # the range of each rank: least and greatest value, values before it, values in it
    for _ in range(ROUNDS_MOST):
        wanted = [r for r in ranks if at[r][0] < at[r][1] and at[r][3] > FEW]
        if not wanted:
            break
        ask = lambda r: [min(1.0, max(0.0, (r - at[r][2] + 0.5) / at[r][3] + e)) for e in (-NEAR, 0.0, NEAR)]
        named = values.agg(*[F.percentile_approx(F.when(value.between(*at[r][:2]), value), ask(r), ACCURACY) for r in wanted]).first()
        points = [sorted(set(p)) for p in named]
        marked = values.select("value", F.explode(F.array_compact(F.array(*[F.when(value.between(*at[r][:2]), F.lit(100 * i) + _parts(value, p)) for i, (r, p) in enumerate(zip(wanted, points, strict=True))]))).alias("part"))
        counts = marked.groupBy("part").agg(F.min("value"), F.max("value"), F.count("*")).orderBy("part").collect()  # a few rows for each rank
        for i, r in enumerate(wanted):
            before = at[r][2]
            for part, lo, hi, size in counts:
                if part // 100 == i:
                    if before <= r < before + size:
                        at[r] = (lo, hi, before, size)
                        break
                    before += size
    else:
        raise RuntimeError("ranges did not settle")
    few = {r for r in at.values() if r[0] < r[1]}
    held = F.lit(False)
    for lo, hi, _, _ in few:
        held = held | value.between(lo, hi)
    gathered = sorted(r.value for r in values.where(held).collect()) if few else []  # FEW a range
    found = {rank: lo if lo == hi else [v for v in gathered if lo <= v <= hi][rank - before] for rank, (lo, hi, before, _) in at.items()}
    return [found[floor(p)] + (found[ceil(p)] - found[floor(p)]) * (p - floor(p)) for p in places]
