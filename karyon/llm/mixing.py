"""Mixing sources to target weights: integer quotas of equal blocks by Sainte-Laguë apportionment, then seeded block selection.

Targets: sources share `share` times all words by their weights; a target stops at `most` times its source's words, and what is over is shared
again by weight until none is above (`source_targets`: a few sums over the table of sources).

Blocks: a source's documents are dealt to shards by a hash, ordered in a shard by a hash, and the shard's words are cut into equal blocks of about
`BLOCK_WORDS`. Sainte-Laguë gives one block after the other to whoever has the highest quotient weight / (2 k + 1), k blocks had so far: first to the sources by
their targets, then, level by level, to groups of `FAN_OUT` shards and to shards by their blocks (`apportion`). The quotients are not gone through
one by one: with n parties, all but about 2 n of the seats are known beforehand, since no divisor can give less, and only quotients near the last one given are
sorted. Every sort is over one source's group of at most FAN_OUT parties, or over the sources.

Selection: a shard of m blocks with quota q takes each block q // m times, and q % m of them once more: those that follow each other from a seeded
place, round the end. Their documents are a random choice, since the order is by a hash, and all but the two at the ends are taken whole. Each block is taken at
most `most` times, and so is each document. What a document gives comes from its place in the shard by arithmetic, so no row is made for a block.

A null text has no words, a null source is a source of its own and the last one, a null id counts as an empty one. Rows that repeat an id and a text
are separate documents of equal place; which of them comes first makes no difference to the rows of the result but for columns that are not read. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 32
#: Words and rows of a shard, about.
SHARD_WORDS = 1 << 17
SHARD_ROWS = 1 << 9
FAN_OUT_BITS = 10
ROUNDS_MOST = 10_000


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 0 in the order. Sorted by ranges; of each range only its number of rows is gathered."""
    place = F.monotonically_increasing_id()
    parted = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place).withColumn("__range", F.shiftright("__place", 33)))
    sizes = parted.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row for each range
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return parted.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + within).drop("__place", "__range", "__before")


def source_targets(sources: DataFrame, weights: list[int], share: tuple[int, int], most: int) -> DataFrame:
    """sources (source, source_size, ...) with rank, weight and target. share: of all words, as a fraction of whole numbers."""
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = numbered(sources, [F.asc_nulls_last("source")], "rank")
    rows = cut(rows.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights)).cast("int") + 1)))
    up, down = share
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    full, left, weight = F.lit(False), up * total, None
    for _ in range(ROUNDS_MOST):  # each round finds more sources that stop, or is the last
        stopped, weight = rows.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        left = up * total - down * most * int(stopped or 0)  # of what is shared, times down
        if not weight:
            break
        above = full | (F.col("weight") * F.lit(float(left)) > F.col("source_size") * F.lit(float(most * down * weight)))
        if not rows.where(above & ~full).limit(1).count():
            break
        full = above
        rows = cut(rows.withColumn("__full", above))
        full = F.col("__full")
    else:
        raise RuntimeError("targets did not settle")
    limit = (F.col("source_size") * most).cast("double")
    shared = F.lit(float(left)) * F.col("weight") / F.lit(float(down * (weight or 1)))
    return rows.withColumn("target", F.when(full, limit).otherwise(F.least(shared, limit))).drop("__full")


def apportion(parties: DataFrame, group: list[str], seats: str, weight: str, most: str, order: str, name: str) -> DataFrame:
    """parties with `name`: the seats of their group that each gets by Sainte-Laguë, at most `most` each; ties by order.

    parties hold their group's number of seats. Seats that the final divisor gives in any case are given at once; the rest go to the highest quotients.
    """
    w = W.partitionBy(*group)
    total, n = F.sum(F.col(weight).cast("double")).over(w), F.count("*").over(w)
    rows = parties.withColumn("__fair", F.coalesce(F.try_divide(F.col(weight).cast("double") * F.col(seats), total), F.lit(0.0))).withColumn("__n", n)
    slack = F.coalesce(F.try_divide(2.0 * F.col("__n"), F.col(seats)), F.lit(0.0))
    low = F.greatest(F.lit(0).cast("long"), F.least(F.col(most), F.floor(F.col("__fair") * (1 - slack)) - 1))
    high = F.least(F.col(most), F.floor(F.col("__fair") * (1 + slack)) + 2)
    rows = rows.withColumn("__low", F.when(F.col(seats) > 0, low).otherwise(F.lit(0).cast("long"))).withColumn("__high", F.when((F.col(seats) > 0) & (F.col(weight) > 0), high).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("__open", F.col(seats) - F.sum("__low").over(w))
    some = F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1))
    asked = rows.select(*group, order, weight, "__open", F.explode(some).alias("k")).withColumn("quotient", F.col(weight).cast("double") / (2 * F.col("k") + 1))
    best = W.partitionBy(*group).orderBy(F.desc("quotient"), order, "k")
    given = asked.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= F.col("__open")).groupBy(*group, order).agg(F.count("*").alias("__more"))
    joined = rows.join(given, [*group, order], "left")
    return joined.withColumn(name, F.col("__low") + F.coalesce("__more", F.lit(0).cast("long"))).drop("__fair", "__n", "__low", "__high", "__open", "__more")


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: list[int] | None = None, share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 11, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, times, begin, end, begin2, end2) of each row.

    times: how often the whole text is taken; [begin, end) and [begin2, end2): its words that are taken once more, null if there are none. taken: all its words that are taken.
    """
    weights = weights or [5, 2, 1]
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _hash(F.lit(str(seed)), ident, F.md5(text.cast("binary"))).alias("key"))
    rows = cut(rows)  # the texts are read once
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    shards = (1 + F.greatest(F.floor(F.col("source_size") / SHARD_WORDS), F.floor(F.col("source_rows") / SHARD_ROWS))).cast("long")
    sources = cut(source_targets(sources.withColumn("shards", shards), weights, share, most))

    placed = rows.join(sources.select("source", "rank", "shards"), rows["source"].eqNullSafe(sources["source"])).select("__id", "size", "key", "rank", F.pmod(_number(F.col("key")), F.col("shards")).alias("shard"))
    placed = cut(placed)
    parts = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"))
    nodes = cut(parts.withColumn("blocks", F.ceil(F.col("words") / block_words)))
    quotas = _quotas(nodes, sources, most, block_words)

    own = placed.join(quotas, ["rank", "shard"])
    order = W.partitionBy("rank", "shard").orderBy("key", "__id", "size")
    own = own.withColumn("b", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("size"))
    own = own.withColumn("times", F.coalesce(F.expr("quota div nullif(blocks, 0)"), F.lit(0).cast("long"))).withColumn("extra", F.coalesce(F.expr("quota % nullif(blocks, 0)"), F.lit(0).cast("long")))
    start = F.coalesce(F.try_mod(_number(_hash(F.lit(str(seed)), F.col("rank").cast("string"), F.col("shard").cast("string"))), F.nullif(F.col("blocks"), F.lit(0).cast("long"))), F.lit(0).cast("long"))
    own = own.withColumn("start", start)
    edge = lambda block: F.expr(f"coalesce(({block}) * words div nullif(blocks, 0), 0L)")
    own = own.withColumns({"one": edge("start"), "one_end": edge("least(start + extra, blocks)"), "two_end": edge("greatest(start + extra - blocks, 0L)")})
    span = lambda lo, hi: (F.greatest(F.col("a"), lo) - F.col("a"), F.least(F.col("b"), hi) - F.col("a"))
    (begin, end), (begin2, end2) = span(F.col("one"), F.col("one_end")), span(F.lit(0).cast("long"), F.col("two_end"))
    made = own.select("__id", "rank", "size", "times", begin.alias("p"), end.alias("q"), begin2.alias("r"), end2.alias("s"))
    taken = F.col("times") * F.col("size") + F.greatest(F.col("q") - F.col("p"), F.lit(0)) + F.greatest(F.col("s") - F.col("r"), F.lit(0))
    one, two = F.col("q") > F.col("p"), F.col("s") > F.col("r")
    spans = [F.when(one, F.col("p")).alias("begin"), F.when(one, F.col("q")).alias("end"), F.when(two, F.col("r")).alias("begin2"), F.when(two, F.col("s")).alias("end2")]
    made = made.select("__id", "rank", "size", "times", taken.alias("taken"), *spans)
    return made.join(sources.select("source", "rank", "source_size", "target"), "rank").select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", "taken", "times", "begin", "end", "begin2", "end2")


def _quotas(nodes: DataFrame, sources: DataFrame, most: int, block_words: int) -> DataFrame:
    """(rank, shard, words, blocks, quota) of each shard."""
    seats = int((sources.agg(F.sum("target")).first()[0] or 0.0) / block_words + 0.5)
    blocks = nodes.groupBy("rank").agg(F.sum("blocks").alias("blocks"))
    owners = sources.join(blocks, "rank").select("rank", "target", (F.col("blocks") * most).alias("cap"), F.lit(seats).cast("long").alias("seats"), F.lit(0).alias("all"))
    found = cut(apportion(owners, ["all"], "seats", "target", "cap", "rank", "quota")).select("rank", F.lit(0).cast("long").alias("node"), "quota")
    last = nodes.agg(F.max("shard")).first()[0] or 0
    levels = max(1, -(-int(last).bit_length() // FAN_OUT_BITS))
    for level in reversed(range(levels)):
        shift = FAN_OUT_BITS * level
        # the shards of a source under each node of this level, and the node above that has their seats
        here = nodes.groupBy("rank", F.shiftright("shard", shift).alias("child")).agg(F.sum("blocks").alias("blocks"))
        here = here.withColumn("node", F.shiftright("child", FAN_OUT_BITS)).withColumn("cap", F.col("blocks") * most)
        here = here.join(found, ["rank", "node"]).withColumnRenamed("quota", "seats")
        given = cut(apportion(here, ["rank", "node"], "seats", "blocks", "cap", "child", "quota"))
        found = given.select("rank", F.col("child").alias("node"), "quota")
    return nodes.join(found.withColumnRenamed("node", "shard"), ["rank", "shard"])


def taken_texts(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of what the mix takes of each document: its whole text `times` times, and its extra spans of words, each with the white space after its words. Ids must not repeat."""
    words = F.regexp_extract_all(F.col("t"), F.lit(r"([\x20\x09-\x0D]*" + WORD + r"[\x20\x09-\x0D]*)"), 1)
    piece = lambda a, b: F.when(F.col(a).isNotNull(), F.concat_ws("", F.slice("w", F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))))
    both = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(plan.where("taken > 0").withColumnRenamed(id_col, "__id"), "__id")
    whole = F.array_repeat(F.col("t"), F.col("times").cast("int"))
    pieces = F.array_compact(F.concat(whole, F.array(piece("begin", "end"), piece("begin2", "end2"))))
    return both.withColumn("w", words).select(F.col("__id").alias(id_col), F.explode(pieces).alias("text"))


def mixing_sql(weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 11, block_words: int = BLOCK_WORDS) -> str:
    """The same as DuckDB SQL over `documents`: targets by their one level, seats by sorting all quotients; shards of a source as one level, so up to FAN_OUT of them."""
    up, down = share
    cycle = f"[{', '.join(map(str, weights))}]"
    number = lambda d: f"('0x' || substr({d}, 1, 8))::BIGINT"
    return rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + greatest(sum(size) // {SHARD_WORDS}, count(*) // {SHARD_ROWS}) AS shards, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, {cycle}[1 + rank % {len(weights)}] AS weight, sum(source_size) OVER () AS total FROM s),
lv AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, rank) AS pos FROM w),
rest AS (SELECT *, total * {up} - {down * most} * (sum(source_size) OVER (ORDER BY pos) - source_size) AS open, sum(weight) OVER (ORDER BY pos DESC) AS open_weight FROM lv),
stop AS (SELECT coalesce(min(pos) FILTER (weight * open <= source_size * {most * down} * open_weight), 1 << 40) AS first FROM rest),
t AS (SELECT r.*, CASE WHEN pos < stop.first THEN (source_size * {most})::DOUBLE ELSE least((SELECT open FROM rest WHERE pos = stop.first)::DOUBLE * weight / ({down} * (SELECT open_weight FROM rest WHERE pos = stop.first))::DOUBLE, (source_size * {most})::DOUBLE) END AS target FROM rest r, stop),
p AS (SELECT d.doc_id, d.size, d.key, t.rank, {number('key')} % t.shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT rank, shard, sum(size)::BIGINT AS words, ceil(sum(size) / {block_words})::BIGINT AS blocks FROM p GROUP BY 1, 2),
c AS (SELECT rank, sum(blocks)::BIGINT AS blocks FROM n GROUP BY 1),
seats AS (SELECT floor(coalesce(sum(target), 0) / {block_words} + 0.5)::BIGINT AS seats FROM t),
q AS (SELECT rank, target / (2 * k + 1) AS quotient, k FROM (SELECT rank, target, unnest(range({most} * blocks)) AS k FROM t JOIN c USING (rank) WHERE target > 0)),
a AS (SELECT rank, count(*) AS seats FROM (SELECT rank, row_number() OVER (ORDER BY quotient DESC, rank, k) AS pos FROM q) x, seats WHERE pos <= seats.seats GROUP BY rank),
q2 AS (SELECT rank, shard, blocks::DOUBLE / (2 * k + 1) AS quotient, k FROM (SELECT rank, shard, blocks, unnest(range({most} * blocks)) AS k FROM n)),
a2 AS (SELECT rank, shard, count(*) AS quota FROM (SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY quotient DESC, shard, k) AS pos FROM q2) x JOIN a USING (rank) WHERE pos <= a.seats GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(quota, 0) AS quota, {number(f"md5('{seed}:' || rank || ':' || shard)")} % greatest(blocks, 1) AS start FROM n LEFT JOIN a2 USING (rank, shard)),
e AS (SELECT rank, shard, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS times, CASE WHEN blocks > 0 THEN start * words // blocks ELSE 0 END AS one,
  CASE WHEN blocks > 0 THEN least(start + quota % blocks, blocks) * words // blocks ELSE 0 END AS one_end, CASE WHEN blocks > 0 THEN greatest(start + quota % blocks - blocks, 0) * words // blocks ELSE 0 END AS two_end FROM m),
o AS (SELECT p.*, sum(size) OVER (PARTITION BY rank, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS b FROM p)
SELECT doc_id, size, t.source_size, target, (times * size + greatest(least(b, one_end) - greatest(b - size, one), 0) + greatest(least(b, two_end) - greatest(b - size, 0), 0))::BIGINT AS taken
FROM o JOIN e USING (rank, shard) JOIN t USING (rank)"""
