"""Segmentation, copy fit, clusters, ploidy correction: micro-cases, properties, recovery."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from karyon.functions.columns import inv_wasserstein
from karyon.operators import clusters, communities, copyfit, experiment, neighbours, ploidy, quantiles, roworder, segment, small_graphs
from karyon.operators.bins import make_bins
from karyon.operators.correct import correct_reads


def long_rows(spark, cells, value="reads"):
    data = [(c, k, None if v is None else float(v)) for c, values in cells.items() for k, v in enumerate(values)]
    return spark.createDataFrame(data, f"cell_id string, bin_idx int, {value} double")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-50, 50, allow_nan=False), min_size=1, max_size=40))
def test_without_noise_the_transform_is_exact(values):
    x = np.array(values)
    assert np.allclose(segment.haar_reconstruction(x, 0.0), x, atol=1e-8)


def test_constant_and_steps():
    assert np.allclose(segment.haar_reconstruction(np.full(50, 3.0), 1.0), 3.0)
    x = np.concatenate([np.full(40, 2.0), np.full(25, 6.0)])
    noisy = x + np.random.default_rng(1).normal(0, 0.2, 65)
    assert np.abs(segment.haar_reconstruction(noisy, 0.4) - x).max() < 0.3


def test_gaps_take_one_step(spark):
    rows = long_rows(spark, {"a": [1, None, None, 4, None]}).withColumn("haar", __import__("pyspark").sql.functions.col("reads"))
    assert [r.haar for r in segment.bridge_gaps(rows).orderBy("bin_idx").collect()] == [1.0, None, 4.0, 4.0, 4.0]


def test_cells_without_values_survive(spark):
    rows = long_rows(spark, {"empty": [None] * 5, "flat": [2.0] * 5})
    out = {(r.cell_id, r.bin_idx): r.segmented for r in segment.segment(rows).collect()}
    assert all(out["empty", k] is None and out["flat", k] == 2.0 for k in range(5))


def test_mad_offset(spark):
    assert {r.cell_id: round(r.sigma, 6) for r in segment.mad_offset(long_rows(spark, {"a": [1, 2, 4, 8], "b": [5, 5, 5]})).collect()} == {"a": round(1.4826 * np.sqrt(2), 6), "b": 0.0}


def test_modal_states(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,), (0.2,), (2.0,), (3.3,), (40.0,)], "e double").select("e", copyfit.modal_states(F.col("e")).alias("s"))
    got = {r.e: r.s for r in df.collect()}
    assert got[None] == list(range(2, 9)) and got[0.2] == [2, 3, 4] and got[2.0] == [2, 3, 4] and got[3.3] == [3, 4, 5, 6] and got[40.0] == list(range(15, 27))


@settings(max_examples=30, deadline=None)
@given(st.floats(0.5, 20), st.floats(0.1, 100))
def test_nearest_state_has_the_least_residual(rpcn, v):
    k = np.rint(v / rpcn)
    assert all(abs(v - k * rpcn) <= abs(v - j * rpcn) + 1e-9 for j in range(int(k) + 3))


def test_minimise_finds_a_parabola():
    assert abs(copyfit.minimise(lambda x: (x - 1.3) ** 2, 0, 4) - 1.3) < 1e-6


def test_copies_are_recovered(spark):
    rng = np.random.default_rng(4)
    truth = np.repeat([2, 3, 2, 1, 4, 2], 40)
    rows = long_rows(spark, {"a": 10.0 * truth + rng.normal(0, 0.3, len(truth))}, "segmented")
    cells = spark.createDataFrame([("a", 0.5, 2.3)], "cell_id string, sigma double, ploidy double")
    got = [r.copy for r in copyfit.copy_call(rows, cells).orderBy("bin_idx").collect()]
    assert got == truth.tolist()
    grid = copyfit.fit_grid(rows, cells).first()
    assert grid.state == 2 and abs(grid.rpcn - 10) < 0.3


def test_zero_noise_takes_the_least_positive(spark):
    rows = long_rows(spark, {"a": [1, 2, 3], "b": [1, 1, 1]}).withColumn("segmented", __import__("pyspark").sql.functions.lit(1.0))
    got = {r.cell_id: r.sigma for r in copyfit.bin_noise(rows).collect()}
    assert got["a"] == got["b"] > 0


def test_identical_cells_make_no_loop(spark):
    rows = spark.createDataFrame([(k, [float(k // 2), 0.0]) for k in range(6)], "cell_id int, features array<double>")
    knn = clusters.nearest(rows, 3, "cell_id", block=2)
    assert knn.count() == 18
    edges = clusters.neighbour_edges(knn, rows)
    assert edges.where("src = dst").count() == 0
    assert edges.where("weight > 1 or weight <= 0").count() == 0


def test_arrays_of_different_length_raise(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception, match="same length"):
        df.select(inv_wasserstein("x", "y")).collect()


def test_cliques_are_found_and_runs_agree(spark):
    pairs = [(a, b) for base in (0, 10, 20) for a in range(base, base + 6) for b in range(base, a)] + [(0, 10), (10, 20)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src int, dst int, weight double")
    ids = spark.createDataFrame([(k,) for base in (0, 10, 20) for k in range(base, base + 6)] + [(99,)], "cell_id int")
    found = {r.cell_id: r.label for r in communities.partition(edges, ids).collect()}
    assert found == {k: (k // 10) * 10 if k != 99 else 99 for k in found}
    again = {r.cell_id: r.label for r in communities.partition(edges.repartition(3), ids).collect()}
    assert again == found
    score = clusters.modularity(edges, spark.createDataFrame(list(found.items()), "cell_id int, label int")).first()[0]
    assert 0.55 < score < 0.7


def test_small_clusters_become_zero(spark):
    m = spark.createDataFrame([(k, 1 if k < 5 else 2) for k in range(8)], "cell_id int, label int")
    assert {r.label for r in clusters.collapse_small(m).collect()} == {0, 1}


def test_even_kernels_are_refused(spark):
    with pytest.raises(ValueError):
        clusters.gauss_smooth(long_rows(spark, {"a": [1, 2, 3]}), "reads", 4)


def test_doubling_needs_separation_and_cells(spark):
    data = [(f"c{k}", 0, 2.0 + 0.01 * k, 200_000) for k in range(12)] + [(f"d{k}", 1, 2.0 if k % 2 else 4.0, 200_000) for k in range(12)] + [("e0", 2, 3.0, 200_000)] + [("d-null", 1, None, 200_000)]
    cells = spark.createDataFrame(data, "cell_id string, group int, est_ploidy double, total_reads long")
    got = {r.cell_id: (r.wgd, r.corr_ploidy) for r in ploidy.correct_ploidy(cells).collect()}
    assert got["d0"] == (True, 6.0) and got["d1"] == (False, 3.0) and got["d-null"] == (False, 3.0) and got["e0"] == (False, None)
    assert not any(r.wgd for r in ploidy.correct_ploidy(cells, call_wgd=False).collect())


def test_bins_end_with_their_chromosome(spark):
    got = [(r.bin_idx, r.chromosome, r.start, r.end) for r in make_bins(spark, [("1", 1200), ("2", 500)], 500).orderBy("bin_idx").collect()]
    assert got == [(0, "1", 1, 500), (1, "1", 501, 1000), (2, "1", 1001, 1200), (3, "2", 1, 500)]


@pytest.mark.parametrize("how", ["median_gc", "loess"])
def test_corrections_flatten_a_trend(spark, how):
    data = [("a", k, 100.0 * (1 + 0.02 * (k % 30)), 30.0 + k % 30) for k in range(300)]
    rows = spark.createDataFrame(data, "cell_id string, bin_idx int, counts double, gc double")
    reads = np.array([r.reads for r in correct_reads(rows, how).collect()])
    raw = np.array([d[2] for d in data])
    assert reads.std() / reads.mean() < 0.5 * raw.std() / raw.mean()
    with pytest.raises(ValueError):
        correct_reads(rows, "other")


def test_end_to_end(spark):
    from karyon.plans import fixtures

    sf = "/root/testdata/sf0.001"
    x = experiment.process_batch(fixtures.bins(spark), bedpe=fixtures.bedpe(spark, sf))
    assert x.cells.count() == 10
    x = experiment.copy_calls(x)
    assert x.cell_bins.where("copy is not null").count() > 1000
    assert "bin_noise" in x.cells.columns
    with pytest.raises(ValueError):
        experiment.process_batch(fixtures.bins(spark))
    with pytest.raises(ValueError):
        experiment.process_batch(fixtures.bins(spark), bedpe=fixtures.bedpe(spark, sf), genome="x")


def test_long_path_is_one_connected_part(spark):
    """100 vertices in a row are one part, and a vertex of the same cluster without an edge to them is another."""
    rows = [(i, i + 1, 1.0) for i in range(1, 100)]
    edges = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src long, dst long, weight double")
    labels = spark.createDataFrame([(i, 7) for i in [*range(1, 101), 500]], "id long, label long")
    assert {(r.id, r.label) for r in communities._split(edges, labels).collect()} == {(i, 1) for i in range(1, 101)} | {(500, 500)}


def _blocks(rng, sizes, inside, outside):
    """A random graph of blocks: pairs of a block are linked with one probability, others with another."""
    of = [b for b, n in enumerate(sizes) for _ in range(n)]
    return [(i, j, round(float(rng.uniform(0.5, 1.5)), 3)) for i in range(len(of)) for j in range(i) if rng.random() < (inside if of[i] == of[j] else outside)], of


def _connected(pairs, label):
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    parts, seen = 0, set()
    for v in label:
        if v not in seen:
            parts, todo = parts + 1, [v]
            seen.add(v)
            for x in todo:
                for u in near.get(x, ()):
                    if u not in seen and label[u] == label[v]:
                        seen.add(u)
                        todo.append(u)
    return parts == len(set(label.values()))


def _gains(pairs, label, resolution):
    """The most that one vertex gains by moving, by definition."""
    degree, total = dict.fromkeys(label, 0.0), sum(w for *_, w in pairs)
    for a, b, w in pairs:
        degree[a] += w
        degree[b] += w
    most = 0.0
    for v in label:
        links = {}
        for a, b, w in pairs:
            if v in (a, b):
                u = b if a == v else a
                links[label[u]] = links.get(label[u], 0.0) + w
        pull = {c: links.get(c, 0.0) - resolution * degree[v] * sum(degree[u] for u in label if label[u] == c and u != v) / (2 * total) for c in {*links, label[v]}}
        most = max(most, max([*pull.values(), 0.0]) - pull[label[v]])
    return most


@pytest.mark.parametrize("seed,resolution", [(1, 1.0), (3, 2.5)])
def test_communities_are_connected_and_no_vertex_gains(spark, seed, resolution):
    """The distributed steps and the one-task steps: same properties, modularity alike, blocks found."""
    pairs, of = _blocks(np.random.default_rng(seed), [14, 12, 10, 8, 5], 0.6, 0.04)
    edges = spark.createDataFrame(pairs, "src int, dst int, weight double")
    ids = spark.createDataFrame([(k,) for k in range(len(of))], "cell_id int")
    scores = []
    for small in (0, 10**6):
        found = communities.partition(edges, ids, resolution, small=small)
        label = {r.cell_id: r.label for r in found.collect()}
        assert len(label) == len(of) and all(min(u for u in label if label[u] == c) == c for c in set(label.values()))
        assert _connected(pairs, label) and _gains(pairs, label, resolution) < 1e-6
        assert tuple(communities.faults(edges, found, resolution).first()) == (len(of), 0, 0)
        scores.append(clusters.modularity(edges, found, weight="weight").first()[0])
    assert abs(scores[0] - scores[1]) < 0.05
    if resolution == 1.0:
        main = {c: max(set(of), key=lambda b: sum(of[v] == b for v in label if label[v] == c)) for c in set(label.values())}
        assert len(set(main.values())) == 5 and sum(main[label[v]] == of[v] for v in label) >= len(of) - 2
    wrong = spark.createDataFrame([(k, k % 2) for k in range(len(of))], "cell_id int, label int")
    assert communities.faults(edges, wrong).first().gaining > 5


def test_refinement_splits_what_hangs_by_one_vertex(spark):
    """Two cliques that a bridge vertex held together fall apart once it is gone: the refined parts of their community are connected."""
    pairs = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(base, a)]
    graph = communities.summed_graph(spark.createDataFrame(pairs, "src int, dst int, weight double"))
    degrees = graph.groupBy("src").agg({"weight": "sum"}).toDF("id", "degree")
    placed = degrees.selectExpr("id", "struct(0 AS id, 0 AS born) AS label", "degree")
    refined = {r.id: r.sub for r in communities._refined(graph, placed, 30.0, 1.0, 5, communities._Births()).collect()}
    assert all((refined[a] == refined[b]) <= (a // 10 == b // 10) for a in refined for b in refined)
    start = spark.createDataFrame([(v, 0) for v in refined], "cell_id int, label int")
    for small in (0, 10**6):
        found = communities.partition_graph(graph, start, start=start, small=small)
        assert {(r.cell_id, r.label) for r in found.collect()} == {(v, v // 10 * 10) for v in refined}


def test_resolution_search(spark):
    pairs, of = _blocks(np.random.default_rng(9), [9, 9, 9], 0.7, 0.05)
    edges = spark.createDataFrame(pairs, "src int, dst int, weight double")
    ids = spark.createDataFrame([(k,) for k in range(len(of))], "cell_id int")
    r, score, found = experiment.search_resolution(edges, ids, width=0.6)
    fixed = [clusters.modularity(edges, communities.partition(edges, ids, x)).first()[0] for x in experiment.RESOLUTIONS]
    assert 1e-4 <= r <= 10 and score >= max(fixed) - 1e-9 and found.count() == len(of)


def test_resolutions_are_evaluated_together(spark, monkeypatch):
    """The first resolutions are one job, then a section is; each partition is that of its resolution alone, ids beyond 2^53 included."""
    pairs, of = _blocks(np.random.default_rng(4), [12, 10, 9], 0.7, 0.05)
    far = 2**60
    edges = spark.createDataFrame([(far + a, far + b, w) for a, b, w in pairs], "src long, dst long, weight double")
    ids = spark.createDataFrame([(far + k,) for k in range(len(of))], "cell_id long")
    graph = communities.summed_graph(edges)
    found = communities.partition_graphs(graph, ids, [0.3, 1.0, 4.0])
    scores = {r.nr: r.modularity for r in clusters.modularities(edges, found).collect()}
    for i, r in enumerate((0.3, 1.0, 4.0)):
        alone = communities.partition_graph(graph, ids, r)
        assert {(x.cell_id, x.label) for x in alone.collect()} == {(x.cell_id, x.label) for x in found.where(F.col("nr") == i).collect()}
        assert abs(clusters.modularity(edges, alone).first()[0] - scores[i]) < 1e-9
    asked, plain = [], communities.partition_graphs
    monkeypatch.setattr(communities, "partition_graphs", lambda g, v, many, *a: asked.append(len(many)) or plain(g, v, many, *a))
    experiment.search_resolution(edges, ids)
    assert asked[0] == 5 and len(asked) <= 4 and max(asked) <= 7


def test_small_graphs_with_names_are_solved_some_at_a_time(spark, monkeypatch):
    """Names as ids, and resolutions in several jobs where copies of the graph would be too large together: the same partitions."""
    pairs, of = _blocks(np.random.default_rng(6), [11, 10, 8], 0.7, 0.05)
    edges = spark.createDataFrame([(f"cell {a}", f"cell {b}", w) for a, b, w in pairs], "src string, dst string, weight double")
    ids = spark.createDataFrame([(f"cell {k}",) for k in [*range(len(of)), "alone"]], "cell_id string")
    graph = communities.summed_graph(edges)
    whole = {tuple(r) for r in communities.partition_graphs(graph, ids, [0.5, 1.0, 3.0]).collect()}
    monkeypatch.setattr(communities, "TOGETHER_EDGES", 2 * graph.count())
    assert {tuple(r) for r in communities.partition_graphs(graph, ids, [0.5, 1.0, 3.0]).collect()} == whole
    assert len(whole) == 3 * (len(of) + 1) and (1, "cell alone", "cell alone") in whole
    assert len({label for nr, _, label in whole if nr == 1}) == 4


def _edge_arrays(rng, n, blocks, near, far):
    """Both ways, as arrays, of a graph with `near` links of a vertex in its block and `far` to any."""
    a = np.repeat(np.arange(n), near + far)
    b = np.concatenate([np.concatenate([rng.integers(0, n // blocks, near) * blocks + v % blocks, rng.integers(0, n, far)]) for v in range(n)])
    keys = np.unique(np.minimum(a, b)[a != b] * n + np.maximum(a, b)[a != b])
    a, b, w = keys // n, keys % n, rng.uniform(0.5, 1.5, len(keys))
    return np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])


@pytest.mark.parametrize("blocks,far,resolution", [(12, 2, 1.0), (12, 2, 0.2), (40, 5, 3.0), (1, 4, 1.0)])
def test_many_vertices_move_at_a_time(blocks, far, resolution):
    """Of a graph that is worked on as arrays: connected communities, no vertex gains, blocks found, the same again."""
    n = 4000
    src, dst, weight = _edge_arrays(np.random.default_rng(blocks), n, blocks, 6, far)
    degree = np.bincount(src, weight, n)
    label = small_graphs.solve(src, dst, weight, degree, np.arange(n), resolution, degree.sum(), 7)
    assert (label == small_graphs.solve(src, dst, weight, degree, np.arange(n), resolution, degree.sum(), 7)).all()
    assert _connected(zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True), dict(enumerate(label.tolist())))
    mass, rate = np.bincount(label, degree), resolution / degree.sum()
    links = np.zeros((n, label.max() + 1))
    np.add.at(links, (src, label[dst]), weight)
    pull = links - rate * degree[:, None] * (mass[None, :] - np.where(np.arange(len(mass))[None, :] == label[:, None], degree[:, None], 0))
    assert (np.maximum(pull.max(axis=1), 0) - pull[np.arange(n), label]).max() < 1e-7
    inside = lambda of: weight[of[src] == of[dst]].sum() - rate * (np.bincount(of, degree) ** 2).sum()
    assert inside(label) >= inside(np.arange(n) % blocks) * 0.99
    if resolution == 1.0 and blocks > 1:
        assert sum(np.bincount(label[np.arange(n) % blocks == b]).max() for b in range(blocks)) > 0.95 * n


def test_few_vertices_are_looked_at_alone(monkeypatch):
    """Of 20,000 vertices nearly all moves are made in sweeps, whose rise is that of the modularity, and rounds come to an end."""
    n, looked, plain, rounds = 20_000, [], small_graphs._one_by_one, []
    monkeypatch.setattr(small_graphs, "_one_by_one", lambda g, label, rate, order: looked.append(len(order)) or plain(g, label, rate, order))
    cut = small_graphs._cut
    monkeypatch.setattr(small_graphs, "_cut", lambda *a: rounds.append(1) or cut(*a))
    src, dst, weight = _edge_arrays(np.random.default_rng(8), n, 25, 5, 4)
    degree = np.bincount(src, weight, n)
    small_graphs.solve(src, dst, weight, degree, np.arange(n), 1.0, degree.sum(), 3)
    assert sum(looked) < 0.2 * n * len(rounds) and len(rounds) < 60
    graph, rate, label, waiting = small_graphs._graph(src, dst, weight, degree), 1 / degree.sum(), np.arange(n) % 50, np.ones(n, bool)
    height = lambda: weight[label[src] == label[dst]].sum() - rate * (np.bincount(label, degree) ** 2).sum()
    for _ in range(3):
        before = height()
        _, rise = small_graphs._sweep(graph, label, rate, np.random.default_rng(1), waiting)
        assert abs(height() - before - rise) < 1e-6 * abs(height())


def test_a_refined_part_is_connected_and_the_same_for_the_same_seeds():
    src, dst, weight = _edge_arrays(np.random.default_rng(2), 3000, 30, 4, 1)
    graph = small_graphs._graph(src, dst, weight, np.bincount(src, weight, 3000))
    label, names, seeds = np.arange(3000) % 30, np.arange(3000), np.zeros(3000, np.int64)
    part = small_graphs._refine(graph, label, 1 / graph.degree.sum(), names, seeds)
    assert (label[part] == label).all() and (part[part] == part).all() and 30 <= len(np.unique(part)) < 1500
    assert _connected(zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True), dict(enumerate(part.tolist())))
    other = seeds + (label == 3)
    again = small_graphs._refine(graph, label, 1 / graph.degree.sum(), names, other)
    assert (again == part)[label != 3].all() and (again != part)[label == 3].any()


def _brute_nearest(x, k):
    out = set()
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        for rank, j in enumerate(sorted(range(len(x)), key=lambda j: (d[j], j))[:k]):
            out.add((i, j, rank + 1, round(float(d[j]), 9)))
    return out


@pytest.mark.parametrize("case", ["clones", "noise", "ties", "few"])
def test_nearest_is_exact_and_prunes(spark, case):
    rng = np.random.default_rng(7)
    if case == "clones":
        x = rng.normal(0, 9, (6, 20))[rng.integers(0, 6, 400)] + rng.normal(0, 0.3, (400, 20))
    elif case == "noise":
        x = rng.normal(0, 1, (150, 8))
    elif case == "ties":
        x = rng.integers(0, 2, (160, 3)).astype(float)
    else:
        x = np.array([[1.0], [2.0], [9.0]])
    k = 7 if case != "few" else 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    got = {(r.src, r.dst, r["rank"], round(r.dist, 9)) for r in clusters.nearest(df, k, block=20).collect()}
    assert got == _brute_nearest(x, k)
    own, queries, blocks = neighbours.block_pairs(df, k, block=20)
    assert own.count() == len(x) and own.groupBy("block").count().agg({"count": "max"}).first()[0] <= 60
    pairs = queries.select("a", "b").distinct().count() + blocks
    if case == "clones":
        assert blocks > 15 and pairs < 0.5 * blocks * blocks


def test_nearest_of_nothing_and_one(spark):
    df = spark.createDataFrame([("only", [1.0, 2.0])], "id string, features array<double>")
    assert [tuple(r) for r in clusters.nearest(df, 3).collect()] == [("only", "only", 1, 0.0)]
    assert clusters.nearest(df.limit(0), 3).count() == 0


def _plain_order(x):
    """Complete linkage by looking at all pairs of clusters, then leaves by means."""
    clusters_ = [([i], -row.mean(), i) for i, row in enumerate(x)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    while len(clusters_) > 1:
        _, i, j = min((d[np.ix_(clusters_[i][0], clusters_[j][0])].max(), i, j) for i in range(len(clusters_)) for j in range(i))
        a, b = sorted((clusters_[i], clusters_[j]), key=lambda c: c[1])
        clusters_ = [c for k, c in enumerate(clusters_) if k not in (i, j)] + [(a[0] + b[0], (a[1] + b[1]) / 2, 0)]
    return clusters_[0][0]


def test_row_order_is_that_of_complete_linkage(spark):
    x = np.random.default_rng(2).normal(0, 1, (70, 5))
    assert roworder.leaf_order(x, -x.mean(axis=1)) == _plain_order(x)
    heights = [h for *_, h in roworder.linkage(x)]
    assert heights == sorted(heights) and len(heights) == 69
    rows = spark.createDataFrame([(f"c{i:03d}", b, float(v), f"s{i % 2}") for i, row in enumerate(x) for b, v in enumerate(row)], "cell_id string, bin_idx int, value double, half string")
    got = [r.cell_id for r in roworder.row_order(rows).orderBy("row_number").collect()]
    assert got == [f"c{i:03d}" for i in _plain_order(x)]
    halves = roworder.row_order(rows, split="half").orderBy("row_number").collect()
    for k in (0, 1):
        own = [r.cell_id for r in halves if r.half == f"s{k}"]
        assert own == [f"c{2 * i + k:03d}" for i in _plain_order(x[k::2])]
    assert [r.row_number for r in halves] == list(range(1, 71)) and [r.half for r in halves] == ["s0"] * 35 + ["s1"] * 35


def test_row_order_of_many_cells_keeps_clones_together(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (4, 6))
    of = rng.permutation(np.repeat([0, 1, 2, 3], [60, 20, 15, 5]))
    rows = spark.createDataFrame([(int(i), b, float(centres[k, b] + rng.normal(0, 0.1))) for i, k in enumerate(of) for b in range(6)], "cell_id long, bin_idx int, value double")
    got = roworder.row_order(rows, cells_most=24).orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(1, 101)) and {r.cell_id for r in got} == set(range(100))
    clones = [of[r.cell_id] for r in got]
    assert sum(a != b for a, b in zip(clones, clones[1:], strict=False)) == 3


@pytest.mark.parametrize("case", ["spread", "ties", "wild", "one", "none"])
def test_exact_quantiles(spark, monkeypatch, case):
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = np.random.default_rng(4)
    x = {"spread": rng.normal(0, 1, 999), "ties": rng.integers(0, 3, 500).astype(float), "wild": np.concatenate([10.0 ** rng.uniform(-300, 300, 300), [-1e308, 1e308, 0.0]]), "one": np.array([4.0]), "none": np.array([])}[case]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, "v", shares)
    assert got == ([None] * 5 if case == "none" else pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12))


def _haar_by_intervals(x, sigma):
    """One interval after the other, as the transform is defined."""
    n = len(x)
    out = np.full(n, x.mean() if n else 0.0)
    waiting = [(0, n)]
    while waiting:
        a, b = waiting.pop()
        if b - a < 2:
            continue
        best = None
        for cut in range(a + 1, b):
            left, right, size = cut - a, b - cut, b - a
            c = np.sqrt(right / (size * left)) * x[a:cut].sum() - np.sqrt(left / (size * right)) * x[cut:b].sum()
            if best is None or abs(c) > abs(best[0]) + 1e-12:
                best = (c, cut)
        c, cut = best
        if abs(c) > sigma * np.sqrt(2 * np.log(n)):
            out[a:cut] += c * np.sqrt((b - cut) / ((b - a) * (cut - a)))
            out[cut:b] -= c * np.sqrt((cut - a) / ((b - a) * (b - cut)))
        waiting += [(a, cut), (cut, b)]
    return out


def test_batches_of_the_transform_are_the_transform():
    rng = np.random.default_rng(6)
    vectors = [rng.normal(np.repeat(rng.integers(0, 9, 5), 12), 0.5) for _ in range(6)] + [np.zeros(0), np.ones(1), np.array([1.0, 5.0]), rng.normal(0, 1, 90)]
    sigmas = [0.4, 0.0, 1.0, 0.5, 2.0, 0.5, 1.0, 1.0, 0.1, 0.0]
    for x, s, got in zip(vectors, sigmas, segment.haar_reconstructions(vectors, sigmas), strict=True):
        assert np.allclose(got, _haar_by_intervals(x, s), atol=1e-9)
    assert segment.haar_reconstructions([], []) == []


def test_empty_files_stay_to_the_end(spark, tmp_path):
    from karyon.plans import fixtures
    from karyon.sources import bedpe

    sf = "/root/testdata/sf0.001"
    bedpe.write_bedpe(fixtures.bedpe(spark, sf).where("cell_id IN ('cell_1', 'cell_2')"), str(tmp_path / "in"))
    (tmp_path / "in" / "cell_none.bedpe").write_text("")
    listed = bedpe.cells_of_files(spark, str(tmp_path / "in"))
    assert sorted(r.cell_id for r in listed.collect()) == ["cell_1", "cell_2", "cell_none"]
    x = experiment.copy_calls(experiment.process_batch(fixtures.bins(spark), bedpe=bedpe.read_bedpe(spark, str(tmp_path / "in")), cells=listed))
    cells = {r.cell_id: r for r in x.cells.collect()}
    assert set(cells) == {"cell_1", "cell_2", "cell_none"} and cells["cell_none"].est_ploidy is None and cells["cell_none"].total_reads is None and cells["cell_1"].est_ploidy is not None
    rows = x.cell_bins.where("cell_id = 'cell_none'").select("copy", "segmented", "reads").collect()
    assert len(rows) == 320 and all(v is None for r in rows for v in r)


@pytest.mark.parametrize("tile", [None, 20, 70])
def test_nearest_of_copies_and_tiles(spark, tile):
    """Against brute force, with many copies, ties between other vectors, and far from 0; a copy's neighbours are those of all its class."""
    rng = np.random.default_rng(8)
    few = rng.integers(0, 3, (60, 4)).astype(float)
    x = np.concatenate([few[rng.integers(0, 60, 150)], np.repeat(few[:1], 40, axis=0), rng.normal(0, 1, (60, 4))]) + 1000.0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, features array<double>")
    got = {(r.src, r.dst, r["rank"], round(r.dist, 9)) for r in neighbours.nearest(df, 7, block=20, tile=tile).collect()}
    assert got == _brute_nearest(x, 7)
    names = df.withColumn("id", F.concat(F.lit("c"), F.lpad("id", 4, "0")))
    named = {(int(r.src[1:]), int(r.dst[1:]), r["rank"], round(r.dist, 9)) for r in neighbours.nearest(names, 7, block=20, tile=tile).collect()}
    assert named == got


def test_queries_go_to_tiles_and_not_to_blocks(spark):
    x = np.random.default_rng(9).normal(0, 1, (400, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, features array<double>")
    own, intervals = neighbours._blocks(df, 5, "id", "features", 20)
    assert len(intervals.names) > 15
    found = neighbours._tiled(own, 5, "int", 200, intervals)
    assert found.count() <= 400 * 5 * 3


def test_a_graph_of_ten_thousand_vertices_is_one_task(spark, monkeypatch):
    """Neighbour graphs of some 10,000 vectors have 111,340 edges; the distributed steps, some tens of jobs a level, are for larger ones."""
    monkeypatch.setattr(communities, "_settle", lambda *a: pytest.fail("distributed"))
    edges = spark.range(56_000).selectExpr("id AS src", "(id + 1) % 8 + id - id % 8 AS dst", "1.0D AS weight")
    found = communities.partition(edges, spark.range(56_000).withColumnRenamed("id", "cell_id"))
    assert found.select("label").distinct().count() == 7_000


def test_pivot_deals_cells_before_it_groups(spark, monkeypatch):
    """Before, each task that read rows held a group for all its cells and bins. Repeats, NULLs and bins of no cell stay as they were."""
    rows = spark.createDataFrame([("a", 0, None), ("a", 0, 5.0), ("a", 2, 7.0), ("b", 1, None), ("c", None, 3.0), ("d", 9, 1.0)], "cell_id string, bin_idx int, reads double")
    monkeypatch.setattr(experiment, "PIVOT_ROWS", 1)
    wide = experiment.pivot_matrix(rows, "reads", [0, 1, 2])
    assert wide.columns == ["cell_id", "bin_0", "bin_1", "bin_2"]
    assert {tuple(r) for r in wide.collect()} == {("a", 5.0, None, 7.0), ("b", None, None, None), ("c", None, None, None), ("d", None, None, None)}
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert ", 6), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_a_segmented_table_has_one_transform(spark, capsys):
    rows = long_rows(spark, {"a": [1, 1, 9, 1, 5, 5], "b": [None, 2, 2, 8, 8, 8]})
    made = segment.segment(rows)
    made.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython [") == 1
    assert made.count() == 12


def test_many_cells_are_transformed_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    cells = [[1.0, 1, 1, 6, 6, None, 6], [], [None, None], [0.0, 3, 3, 3], [2.0] * 9]
    whole = segment._haar(pa.array(cells, pa.list_(pa.float64()))).to_pylist()
    monkeypatch.setattr(segment, "TOGETHER", 5)
    assert segment._haar(pa.array(cells, pa.list_(pa.float64()))).to_pylist() == whole
    assert [len(x) for x in whole] == [len(x) for x in cells] and whole[2] == [None, None] and whole[0][5] is None


def test_the_matrix_of_many_cells_is_many_tasks(spark, monkeypatch):
    from karyon.plans import fixtures

    monkeypatch.setattr(fixtures, "MATRIX_ROWS", 800, raising=False)
    made = fixtures.matrix(spark, "/root/testdata/sf0.001")
    n = made.count()
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) > 1 and max(sizes) < n


def test_read_cells_are_laid_over_bins_in_many_tasks(spark, monkeypatch):
    from karyon.operators import bins as B

    bins = make_bins(spark, [("1", 2000)], 500)
    own = spark.createDataFrame([(f"c{k}", k % 4, float(k + 1)) for k in range(40)], "cell_id string, bin_idx int, counts double")
    monkeypatch.setattr(B, "GRID_ROWS", 20, raising=False)
    made = experiment._read_grid(own, bins, spark.createDataFrame([("none",)], "cell_id string"))
    rows = {(r.cell_id, r.bin_idx): r.counts for r in made.collect()}
    assert rows == {(f"c{k}", b): float(k + 1) if b == k % 4 else 0.0 for k in range(40) for b in range(4)} | {("none", b): None for b in range(4)}
    assert made.groupBy(F.spark_partition_id()).count().count() > 4


def test_ploidy_of_a_cell_is_on_its_rows_without_a_join(spark, capsys):
    rows = spark.createDataFrame([("a", 0, 0.5), ("a", 1, None), ("a", 2, 0.25), ("b", 0, 1.0), ("c", 0, None), (None, 0, 0.5)], "cell_id string, bin_idx int, bin_ratio double")
    made = ploidy.with_ploidy(rows)
    made.explain()
    assert "Join" not in capsys.readouterr().out
    want = {r.cell_id: r.est_ploidy for r in ploidy.cell_ploidy(rows).collect()}
    assert made.count() == 6 and all(r.est_ploidy == want[r.cell_id] for r in made.collect())


def test_graph_of_many_copies_is_one_task(spark, monkeypatch):
    """Subclones of 45,000 cells that are copies: 900,000 edges to a few cells, where sweeps of single moves between few communities would take many jobs."""

    def refuse(*args):
        raise AssertionError("distributed sweeps")

    monkeypatch.setattr(communities, "_settle", refuse)
    ids = spark.range(45_000).withColumnRenamed("id", "cell_id")
    edges = ids.selectExpr("cell_id AS src", "explode(sequence(0, 27, 3)) AS hub").selectExpr("src", "src % 3 + hub AS dst", "1.0D AS weight").where("src <> dst")
    found = communities.partition(edges, ids)
    assert sorted(tuple(r) for r in found.groupBy("label").agg(F.count("*"), F.countDistinct(F.col("cell_id") % 3)).collect()) == [(k, 15_000, 1) for k in range(3)]
