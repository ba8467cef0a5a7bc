"""Micro-cases of fragment loading and overlap counts."""

import random

import pytest
from pyspark.sql import functions as F

from karyon.operators import fragments as f
from karyon.operators import overlaps as o
from karyon.sources.bedpe import SCHEMA


def bedpe(spark, rows):
    """rows: (cell, chr, start, end, name)."""
    data = [(c, k, s, s + 5, k, e - 5, e, n, 60.0, "+", "-") for c, k, s, e, n in rows]
    return spark.createDataFrame(data, f"cell_id string, {SCHEMA}")


def test_one_prefixed_row_disables_the_prefix(spark):
    rows = f.chr_prefix(f.orient(bedpe(spark, [("a", "1", 0, 100, "x"), ("a", "chr2", 0, 100, "y"), ("b", "1", 0, 100, "z")])))
    assert sorted((r.cell_id, r.chr) for r in rows.collect()) == [("a", "1"), ("a", "chr2"), ("b", "chr1")]


def test_contigs(spark):
    names = ["chr1", "chr22", "chrX", "Y", "chrM", "chr1_alt", "chrUn", "fooX"]
    rows = f.contig_filter(f.orient(bedpe(spark, [("a", n, 0, 100, n) for n in names])))
    assert sorted(r.chr for r in rows.collect()) == ["Y", "chr1", "chr22", "chrX", "fooX"]


def test_chains_collapse_to_the_first(spark):
    rows = [("a", "chr1", s, 500 + 10 * k, f"n{k}") for k, s in enumerate([10, 11, 12, 40])]
    assert sorted(r.name for r in f.load_fragments(bedpe(spark, rows)).collect()) == ["n0", "n3"]


def test_nine_bases_match_themselves(spark):
    rows = f.flag_doublets(f.orient(bedpe(spark, [("a", "chr1", 100, 109, "nine"), ("a", "chr1", 300, 320, "twenty")])))
    assert {r.name: r.doublet for r in rows.collect()} == {"nine": True, "twenty": False}


def test_positional_drops_as_many(spark):
    random.seed(3)
    rows = [("a", "chr1", random.randrange(400), 600 + random.randrange(200), f"n{k}") for k in range(300)]
    df = bedpe(spark, rows)
    assert f.load_fragments(df).count() == f.load_fragments(df, how="positional").count()
    with pytest.raises(ValueError):
        f.load_fragments(df, how="other")


def test_guard_and_empty(spark):
    df = bedpe(spark, [("a", "chr1", 1000 * k, 1000 * k + 200, f"n{k}") for k in range(99)])
    loaded = f.load_fragments(df)
    assert loaded.count() == 99
    assert f.enough_fragments(loaded).count() == 0
    assert f.load_fragments(bedpe(spark, []).limit(0)).count() == 0


def test_overlap_counts_match_brute_force(spark):
    random.seed(5)
    rows = [(c, "chr1", random.randrange(3000), 0, f"n{k}") for c in "ab" for k in range(200)]
    rows = [(c, k, s, s + 60 + random.randrange(300), n) for c, k, s, _, n in rows]
    sized = f.length_filter(f.trim(f.orient(bedpe(spark, rows))))
    got = {(r.cell_id, r.name): (r.count_over, r.count_upstream) for r in o.count_overlaps(sized).collect()}
    own = sized.collect()
    for r in own:
        low, high = int(r.start - 2 * r.max_length), int(r.start - r.max_length)
        mates = [x.start for x in own if x.cell_id == r.cell_id]
        assert got[r.cell_id, r.name] == (sum(r.start - 50 <= s <= r.start - 1 for s in mates), sum(low <= s <= high for s in mates))


def test_breadth(spark):
    rows = spark.createDataFrame([("a", "chr1", 1, 10), ("a", "chr1", 5, 7), ("a", "chr1", 11, 12), ("a", "chr2", 1, 1), ("b", "chr1", 20, 30)], "cell_id string, chr string, start long, end long")
    assert {r.cell_id: r.breadth for r in f.breadth(rows).collect()} == {"a": 13, "b": 11}


def test_results_do_not_depend_on_partitions(spark):
    random.seed(7)
    df = bedpe(spark, [("a", "chr1", random.randrange(500), 700 + random.randrange(99), f"n{k}") for k in range(200)])
    names = lambda d: sorted(r.name for r in f.load_fragments(d).collect())
    assert names(df) == names(df.repartition(7, F.rand(1)))


def test_tasks_grow_in_number_with_the_fragments(spark, monkeypatch):
    random.seed(11)
    df = bedpe(spark, [(f"c{k % 40}", "chr1", random.randrange(5000), 6000 + random.randrange(200), f"n{k}") for k in range(800)])
    usual = f.load_fragments(df)
    monkeypatch.setattr(f, "TASK_ROWS", 80, raising=False)
    many = f.load_fragments(df)
    assert many.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, usual.collect()))
    counted = o.count_overlaps(f.length_filter(many))
    assert counted.rdd.getNumPartitions() == 10


def test_doublets_and_names_match_brute_force(spark):
    random.seed(13)
    rows = [(c, random.choice(["1", "chr2", "X"]), s, s + 20 + random.randrange(40), f"n{k}") for c in "ab" for k in range(150) for s in [random.randrange(200)]]
    own = f.orient(bedpe(spark, rows)).collect()
    got = {(r.cell_id, r.name): r.doublet for r in f.flag_doublets(f.orient(bedpe(spark, rows))).collect()}
    assert len(got) == 300
    for r in own:
        assert got[r.cell_id, r.name] == any(x.cell_id == r.cell_id and x.chr == r.chr and x.end - r.start in (9, 10) for x in own)


def test_cells_are_laid_over_bins_in_many_tasks(spark, monkeypatch):
    from karyon.operators import bins as B

    bins = spark.createDataFrame([(k, "1", 500 * k + 1, 500 * k + 500) for k in range(4)], "bin_idx int, chromosome string, start long, end long")
    summary = spark.createDataFrame([("a", "chr1", 501, 7), ("b", "chr1", 1, 5), ("b", "chr9", 1, 6), ("b", "chr1", 99, 6), (None, "chr1", 1501, 8)], "cell_id string, chr string, bin_start long, bin_reads long")
    cells = spark.createDataFrame([(c,) for c in ["a", "b", "b", None, *(f"c{k}" for k in range(50))]], "cell_id string")
    monkeypatch.setattr(B, "GRID_ROWS", 20, raising=False)
    made = B.on_all_bins(summary, bins, cells)
    rows = {(r.cell_id, r.bin_idx): r.bin_reads for r in made.collect()}
    assert len(rows) == made.count() == 53 * 4
    assert {k: v for k, v in rows.items() if v is not None} == {("a", 1): 7, ("b", 0): 5, (None, 3): 8}
    assert made.groupBy(F.spark_partition_id()).count().count() > 4
