"""Queries over cells x bins: scaling, segmentation, copy fit, clusters, ploidy correction, plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import inv_ccc, inv_manhattan, inv_wasserstein
from ..operators import clusters as c
from ..operators import communities, copyfit, experiment, plotdata, segment
from ..operators import ploidy as p
from ..sources.shared import computed_once
from . import fixtures
from .registry import query

M = f"m AS (SELECT *, CAST(round_even(reads, 0) AS BIGINT) AS counts FROM ({fixtures.MATRIX_DUCK}))"
CELLS = f"cells AS ({fixtures.CELLS_DUCK})"
BINS = f"bins AS ({fixtures.BINS_DUCK})"


def _round(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def _matrix(spark, sf_dir):
    return fixtures.matrix(spark, sf_dir)


@query(f"WITH {M} SELECT cell_id, bin_idx, round(reads * 10000 / sum(reads) OVER (PARTITION BY cell_id), 6) AS reads FROM m")
def scale_10k(spark, sf_dir):
    return segment.scale_reads(_matrix(spark, sf_dir)).select("cell_id", "bin_idx", *_round("reads"))


@query(
    f"""WITH {M}, d AS (SELECT cell_id, sqrt(2) * abs(reads - lag(reads) OVER (PARTITION BY cell_id ORDER BY bin_idx)) AS x FROM m WHERE reads IS NOT NULL),
md AS (SELECT cell_id, median(x) AS mid FROM d GROUP BY 1) SELECT cell_id, round(1.4826 * median(abs(x - mid)), 6) AS sigma FROM d JOIN md USING (cell_id) WHERE x IS NOT NULL GROUP BY 1"""
)
def mad_offset(spark, sf_dir):
    return segment.mad_offset(_matrix(spark, sf_dir)).select("cell_id", *_round("sigma"))


_BRIDGED = f"""{M}, b AS (SELECT cell_id, bin_idx, reads, cp, seg AS raw, CASE WHEN seg IS NULL THEN coalesce(lead(seg) OVER w, CASE WHEN lead(bin_idx) OVER w IS NULL THEN lag(seg) OVER w END) ELSE seg END AS seg
FROM m WINDOW w AS (PARTITION BY cell_id ORDER BY bin_idx))"""


def _bridged(spark, sf_dir):
    rows = _matrix(spark, sf_dir).withColumn("raw", F.col("seg"))
    return segment.bridge_gaps(rows, "raw", "seg")


@query(f"WITH {_BRIDGED} SELECT cell_id, bin_idx, seg FROM b")
def seg_na_bridge(spark, sf_dir):
    return _bridged(spark, sf_dir).select("cell_id", "bin_idx", "seg")


@query(
    f"""WITH {_BRIDGED},
q AS (SELECT cell_id, quantile_cont(seg, 0.05) AS q05, quantile_cont(seg, 0.95) AS q95, quantile_cont(seg, 0.9) AS q90 FROM b GROUP BY 1),
s AS (SELECT b.*, q05, q95, q90, coalesce(seg <> lag(seg) OVER w AND seg <> lead(seg) OVER w, false) AS singlet FROM b JOIN q USING (cell_id) WINDOW w AS (PARTITION BY b.cell_id ORDER BY bin_idx)),
v AS (SELECT cell_id, var_samp(seg) AS bin_var FROM s WHERE seg > q05 AND seg < q95 GROUP BY 1),
r AS (SELECT s.*, CASE WHEN coalesce(singlet AND abs(seg - reads) > bin_var AND seg > q90, false) THEN reads ELSE seg END AS raised FROM s LEFT JOIN v USING (cell_id)),
n AS (SELECT cell_id, quantile_cont(raised, 0.9) AS q9 FROM r GROUP BY 1)
SELECT r.cell_id, bin_idx, round(CASE WHEN coalesce(singlet AND raised < q9, false) THEN lead(raised) OVER (PARTITION BY r.cell_id ORDER BY bin_idx) ELSE raised END, 6) AS segmented FROM r JOIN n ON r.cell_id = n.cell_id"""
)
def seg_singlet_repair(spark, sf_dir):
    return segment.repair_singlets(_bridged(spark, sf_dir), "reads", "seg").select("cell_id", "bin_idx", *_round("segmented"))


# every interval of every level of every cell in a recursive query; then what the strong ones add
_HAAR = f"""WITH RECURSIVE {M}, x AS (SELECT cell_id, bin_idx, reads AS v, row_number() OVER w AS i, sum(reads) OVER (w ROWS UNBOUNDED PRECEDING) AS t FROM m WINDOW w AS (PARTITION BY cell_id ORDER BY bin_idx)),
d AS (SELECT cell_id, sqrt(2) * abs(v - lag(v) OVER (PARTITION BY cell_id ORDER BY i)) AS e FROM x), md AS (SELECT cell_id, median(e) AS mid FROM d GROUP BY 1),
sg AS (SELECT cell_id, 1.4826 * median(abs(e - mid)) AS sigma FROM d JOIN md USING (cell_id) WHERE e IS NOT NULL GROUP BY 1),
n AS (SELECT cell_id, max(i) AS n, max_by(t, i) AS total FROM x GROUP BY 1),
p AS MATERIALIZED (SELECT cell_id, i, t FROM x UNION ALL SELECT cell_id, 0, 0.0 FROM n),
iv AS (SELECT cell_id, 0::BIGINT AS a, n AS b, 0.0::DOUBLE AS ta, total AS tb, -1::BIGINT AS pa, -1::BIGINT AS pb FROM n
 UNION ALL SELECT cell_id, CASE WHEN side = 0 THEN a ELSE z.k END, CASE WHEN side = 0 THEN z.k ELSE b END, CASE WHEN side = 0 THEN ta ELSE z.t END, CASE WHEN side = 0 THEN z.t ELSE tb END, a, b
 FROM (SELECT iv.cell_id, a, b, any_value(ta) AS ta, any_value(tb) AS tb, max({{'h': abs(sqrt((b - i)::DOUBLE / ((b - a) * (i - a))) * (t - ta) - sqrt((i - a)::DOUBLE / ((b - a) * (b - i))) * (tb - t)), 'o': -i, 'k': i, 't': t}}) AS z FROM iv JOIN p ON p.cell_id = iv.cell_id AND i > a AND i < b GROUP BY iv.cell_id, a, b), (SELECT unnest([0, 1]) AS side)),
c AS (SELECT cell_id, pa AS a, pb AS b, a AS k, sqrt((pb - a)::DOUBLE / ((pb - pa) * (a - pa))) * (ta - l.tl) - sqrt((a - pa)::DOUBLE / ((pb - pa) * (pb - a))) * (tb - ta) AS c FROM iv JOIN (SELECT cell_id, i AS pa, t AS tl FROM p) l USING (cell_id, pa) WHERE iv.b = iv.pb AND iv.a > iv.pa),
strong AS (SELECT c.* FROM c JOIN n USING (cell_id) JOIN sg USING (cell_id) WHERE abs(c) > sigma * sqrt(2 * ln(n))),
added AS (SELECT x.cell_id, x.bin_idx, x.v, any_value(total / n) + coalesce(sum(CASE WHEN x.i <= k THEN c * sqrt((b - k)::DOUBLE / ((b - a) * (k - a))) ELSE -c * sqrt((k - a)::DOUBLE / ((b - a) * (b - k))) END), 0) AS r FROM x JOIN n USING (cell_id) LEFT JOIN strong s ON s.cell_id = x.cell_id AND x.i > a AND x.i <= b GROUP BY ALL)
SELECT cell_id, bin_idx, round(CASE WHEN v = 0 OR r < 0 THEN 0 ELSE r END, 6) AS haar FROM added"""


@query(_HAAR)
def haar_reconstruct(spark, sf_dir):
    return segment.haar_segments(_matrix(spark, sf_dir).drop("seg")).select("cell_id", "bin_idx", *_round("haar"))


@query()
def seg_unbal_haar(spark, sf_dir):
    return segment.segment(_matrix(spark, sf_dir).drop("seg")).select("cell_id", "bin_idx", *_round("segmented", "bin_depth"))


@query(f"WITH {M} SELECT cell_id, " + ", ".join(f"max(CASE WHEN bin_idx = {i} THEN reads END) AS bin_{i}" for i in range(320)) + " FROM m GROUP BY 1")
def pivot_reads(spark, sf_dir):
    return experiment.pivot_matrix(_matrix(spark, sf_dir), "reads", list(range(320)))


@query(f"WITH {M} SELECT cell_id, concat('bin_', bin_idx) AS col, reads AS value FROM m")
def unpivot_matrix(spark, sf_dir):
    return experiment.unpivot_matrix(experiment.pivot_matrix(_matrix(spark, sf_dir), "reads", list(range(320))))


@query(f"WITH {M} SELECT cell_id, sum(counts)::BIGINT AS total FROM m GROUP BY 1")
def total_counts(spark, sf_dir):
    return experiment.total_counts(_matrix(spark, sf_dir), "counts")


_QC = f"{M}, r AS (SELECT *, reads / 10 AS bin_coverage, CASE WHEN bin_idx % 5 <> 0 THEN reads * 2 END AS bin_quality, 2.0 + bin_idx % 3 AS est_ploidy FROM m)"


@query(
    f"""WITH {_QC} SELECT cell_id, CAST(sum(counts) AS BIGINT) AS total_reads, round(sqrt(sum((reads - seg) * (reads - seg)) / count(*)), 6) AS state_variance,
round(avg(est_ploidy), 6) AS est_ploidy, round(avg(bin_coverage), 6) AS coverage, round(avg(bin_quality), 6) AS est_genome_size FROM r GROUP BY 1"""
)
def cell_qc(spark, sf_dir):
    rows = _matrix(spark, sf_dir).withColumnRenamed("seg", "segmented")
    rows = rows.withColumns({"bin_coverage": F.col("reads") / 10, "bin_quality": F.when(F.col("bin_idx") % 5 != 0, F.col("reads") * 2), "est_ploidy": 2.0 + F.col("bin_idx") % 3})
    return experiment.cell_qc(rows).select("cell_id", "total_reads", *_round("state_variance", "est_ploidy", "coverage", "est_genome_size"))


_NOISE = f"{M}, own AS (SELECT cell_id, 0.9 * stddev_samp(seg - reads) AS own FROM m GROUP BY 1), noise AS (SELECT cell_id, CASE WHEN own = 0 THEN (SELECT min(own) FROM own WHERE own > 0) ELSE own END AS sigma FROM own)"


def _segmented(spark, sf_dir):
    return _matrix(spark, sf_dir).withColumnRenamed("seg", "segmented")


@query(f"WITH {_NOISE} SELECT cell_id, round(sigma, 6) AS sigma FROM noise")
def bin_noise(spark, sf_dir):
    return copyfit.bin_noise(_segmented(spark, sf_dir)).select("cell_id", *_round("sigma"))


_CLAMPED = "CASE WHEN c_acctbal / 500 < 0.5 THEN 2.0 WHEN c_acctbal / 500 > 15 THEN 15.0 ELSE c_acctbal / 500 END"


@query(f"SELECT c_custkey, unnest(range(greatest(CAST(floor({_CLAMPED}) AS BIGINT), 1), CAST(round_even({_CLAMPED} * 1.75, 0) AS BIGINT) + 1))::INT AS state FROM customer")
def modal_states(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", F.explode(copyfit.modal_states(F.col("c_acctbal") / 500)).alias("state"))


@query(f"WITH {M} SELECT cell_id, bin_idx, round_even(reads / 9.7, 0) AS state, round(-0.5 * pow(reads - round_even(reads / 9.7, 0) * 9.7, 2) / (1.3 * 1.3) - ln(1.3) - 0.9189385332046727, 6) AS fit FROM m")
def est_cn_score(spark, sf_dir):
    state, fit = copyfit.est_cn("reads", F.lit(9.7), F.lit(1.3))
    return _matrix(spark, sf_dir).select("cell_id", "bin_idx", state.alias("state"), F.round(fit, 6).alias("fit"))


_FIT = f"""{_NOISE},
g AS (SELECT m.cell_id, m.bin_idx, m.seg AS v, sigma, 2.2 AS e FROM m JOIN noise USING (cell_id) WHERE m.seg > 0.001),
st AS (SELECT cell_id, median(v) AS peak, avg(v) AS mean, min(v) AS lo, max(v) AS hi, count(*) AS n, CAST(count(*) FILTER (abs(v - mu) / sigma < 3) AS BIGINT) AS n_in FROM (SELECT *, avg(v) OVER (PARTITION BY cell_id) AS mu FROM g) GROUP BY 1),
pts AS (SELECT g.*, peak, n, n_in < 100 OR abs(v - mean) / sigma < 3 AS mid, lo + (row_number() OVER (PARTITION BY g.cell_id ORDER BY bin_idx) - 0.5) / n * (hi - lo) AS nul FROM g JOIN st USING (cell_id)),
cand AS (SELECT cell_id, state, step, peak / (state + 0.5) + (peak / (state - 0.5) - peak / (state + 0.5)) * step / 40 AS rpcn FROM st, (SELECT unnest(range(2, 5)) AS state), (SELECT unnest(range(0, 41)) AS step)),
sc AS (SELECT c.cell_id, state, step, any_value(rpcn) AS rpcn, any_value(e) AS e, sum(CASE WHEN mid THEN d1 ELSE 0 END) AS ll_mid, sum(d0) AS ll_null, sum(CASE WHEN mid THEN d0 ELSE 0 END) AS ll_null_mid, sum(CAST(mid AS INT)) AS n_mid, avg(s1) AS mean_state
  FROM (SELECT c.*, e, mid, round_even(v / rpcn, 0) AS s1, -0.5 * pow(v - round_even(v / rpcn, 0) * rpcn, 2) / (sigma * sigma) - ln(sigma) - 0.9189385332046727 AS d1, -0.5 * pow(nul - round_even(nul / rpcn, 0) * rpcn, 2) / (sigma * sigma) - ln(sigma) - 0.9189385332046727 AS d0
        FROM cand c JOIN pts USING (cell_id)) c GROUP BY 1, 2, 3),
tuned AS (SELECT *, ll_mid - ll_null_mid - 0.5 * n_mid * pow((mean_state - e) / e, 2) AS score, row_number() OVER (PARTITION BY cell_id, state ORDER BY round(ll_mid - ll_null, 6) DESC, step) AS r FROM sc)"""


@query(f"WITH {_FIT}, best AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(score, 6) DESC, state) AS k FROM tuned WHERE r = 1) SELECT cell_id, CAST(state AS INT) AS state, round(rpcn, 6) AS rpcn, round(score, 4) AS score FROM best WHERE k = 1")
def fit_means_grid(spark, sf_dir):
    rows = _segmented(spark, sf_dir)
    cells = copyfit.bin_noise(rows).withColumn("ploidy", F.lit(2.2))
    return copyfit.fit_grid(rows, cells).select("cell_id", "state", *_round("rpcn"), *_round("score", digits=4))


@query(f"WITH {M} SELECT cell_id, bin_idx, CASE WHEN seg IS NOT NULL THEN CAST(cp AS INT) END AS copy FROM m")
def copy_call(spark, sf_dir):
    rows = _segmented(spark, sf_dir).drop("copy")
    cells = copyfit.bin_noise(rows).withColumn("ploidy", F.lit(2.2))
    return copyfit.copy_call(rows, cells).select("cell_id", "bin_idx", "copy")


@query(f"WITH {M} SELECT cell_id, CASE WHEN seg IS NOT NULL THEN CAST(cp AS INT) END AS copy, count(*) AS bins FROM m GROUP BY ALL")
def fit_means_brent(spark, sf_dir):
    """Copies found without a known ploidy; the SQL has those that the matrix was made of."""
    rows = _segmented(spark, sf_dir).drop("copy")
    cells = copyfit.bin_noise(rows).withColumn("ploidy", F.lit(None).cast("double"))
    return copyfit.copy_call(rows, cells).groupBy("cell_id", "copy").agg(F.count("*").alias("bins"))


_MASK = f"""{M}, me AS (SELECT bin_idx, avg(counts) AS mean_count FROM m GROUP BY 1), bad AS (SELECT DISTINCT bin_idx + unnest([-2, 0, 2]) AS bin_idx FROM me WHERE mean_count <= 20.4),
mask AS (SELECT me.bin_idx, bad.bin_idx IS NULL AS keep FROM me LEFT JOIN bad ON me.bin_idx = bad.bin_idx)"""
#: Mean counts of these cells are about 20; so some bins are masked.
_LEAST_COUNT = 20.4


@query(f"WITH {_MASK} SELECT bin_idx, keep FROM mask")
def bin_mask_dilate(spark, sf_dir):
    return c.bin_mask(_matrix(spark, sf_dir), _LEAST_COUNT)


_STEPS = f"""{M}, k AS (SELECT cell_id, bin_idx AS place, bin_idx, cp - lag(cp) OVER (PARTITION BY cell_id ORDER BY bin_idx) AS change FROM m WHERE bin_idx >= 0),
steps AS (SELECT * FROM k WHERE place > 0), fl AS (SELECT *, CAST(abs(change) > 0.1 AS INT) AS flag FROM steps),
hit AS (SELECT place, CASE WHEN lag(place) OVER w IS NOT NULL AND lead(place) OVER w IS NOT NULL AND sum(flag) OVER (PARTITION BY cell_id ORDER BY place ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 1 THEN 1 ELSE 0 END AS hit FROM fl WINDOW w AS (PARTITION BY cell_id ORDER BY place)),
sel AS (SELECT place, avg(hit) AS share FROM hit GROUP BY 1 HAVING avg(hit) > 0.05 AND avg(hit) < 0.9),
listed AS (SELECT part, place AS frm, place + (part - 1) * 2 AS p FROM sel, (SELECT unnest(range(0, 3)) AS part)),
places AS (SELECT p AS place, CAST(row_number() OVER (ORDER BY min(part * 100000 + frm)) - 1 AS INT) AS ord FROM listed WHERE p > 0 AND p <= 319 GROUP BY 1)"""


def _steps(spark, sf_dir):
    rows = _matrix(spark, sf_dir)
    return c.changes(rows, c.bin_mask(rows, 0), "copy")


def _features(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return c.changepoint_features(steps, c.changepoint_places(c.select_changepoints(steps), steps))


@query(f"WITH {_STEPS} SELECT place, round(share, 6) AS share FROM sel")
def changepoint_select(spark, sf_dir):
    return c.select_changepoints(_steps(spark, sf_dir)).select(F.col("place"), *_round("share"))


@query(f"WITH {_STEPS} SELECT cell_id, array_to_string(list(CAST(coalesce(change, 0) AS INT) ORDER BY ord), ',') AS features FROM steps JOIN places USING (place) GROUP BY 1")
def changepoint_features(spark, sf_dir):
    return _features(spark, sf_dir).select("cell_id", F.array_join(F.transform("features", lambda x: x.cast("int")), ",").alias("features"))


_K = 10
_KNN = f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.v AS x, b.v AS y, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM e a CROSS JOIN e b),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INT) AS rank FROM d QUALIFY rank <= {_K})"""


def _vectors(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


def _knn(spark, sf_dir):
    return c.nearest(_vectors(spark, sf_dir), _K, "vec_id")


@query(f"WITH {_KNN} SELECT src, dst, rank, round(dist, 6) AS dist FROM nn")
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir).select("src", "dst", "rank", *_round("dist"))


@query(
    f"""WITH {_STEPS}, v AS (SELECT cell_id, list(CAST(coalesce(change, 0) AS DOUBLE) ORDER BY ord) AS v FROM steps JOIN places USING (place) GROUP BY 1),
d AS (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM v a CROSS JOIN v b)
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INT) AS rank, round(dist, 6) AS dist FROM d QUALIFY rank <= {_K}"""
)
def knn_cells(spark, sf_dir):
    """Nearest cells by their changepoints, where most pairs of blocks need not be compared."""
    return c.nearest(_features(spark, sf_dir), _K, "cell_id", block=64).select("src", "dst", "rank", *_round("dist"))


def _affinity(spark, sf_dir, method):
    return c.neighbour_edges(_knn(spark, sf_dir), _vectors(spark, sf_dir), method, "vec_id").select("src", "dst", *_round("weight"))


_EDGES = "FROM nn WHERE rank > 1 AND src <> dst"


@query(f"WITH {_KNN} SELECT src, dst, round(1 / (1 + list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2])))), 6) AS weight {_EDGES}")
def aff_manhattan(spark, sf_dir):
    return _affinity(spark, sf_dir, inv_manhattan)


@query(f"WITH {_KNN}, u AS (SELECT src, dst, unnest(list_transform(list_zip(x, y), lambda p: p[1] - p[2])) AS diff, generate_subscripts(x, 1) AS i {_EDGES}), cs AS (SELECT src, dst, abs(sum(diff) OVER (PARTITION BY src, dst ORDER BY i)) AS a FROM u) SELECT src, dst, round(1 / (1 + sum(a)), 6) AS weight FROM cs GROUP BY 1, 2")
def aff_wasserstein(spark, sf_dir):
    return _affinity(spark, sf_dir, inv_wasserstein)


@query(f"WITH {_KNN}, u AS (SELECT src, dst, unnest(x) AS x, unnest(y) AS y {_EDGES}) SELECT src, dst, round(1 - 2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + pow(avg(x) - avg(y), 2)), 6) AS weight FROM u GROUP BY 1, 2")
def aff_ccc(spark, sf_dir):
    return _affinity(spark, sf_dir, inv_ccc)


@query(f"WITH {_KNN} SELECT src, dst {_EDGES}")
def edges_no_self(spark, sf_dir):
    return c.neighbour_edges(_knn(spark, sf_dir), _vectors(spark, sf_dir), "inv_manhattan", "vec_id").select("src", "dst")


def _labels(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "embeddings").select("vec_id", "label")


@query(
    f"""WITH {_KNN}, ed AS (SELECT src, dst {_EDGES}), l AS (SELECT ed.*, a.label AS la, b.label AS lb FROM ed JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst),
en AS (SELECT la AS label, la = lb AS inside FROM l UNION ALL SELECT lb, la = lb FROM l), by_ AS (SELECT label, count(*) AS degree, sum(CASE WHEN inside THEN 0.5 ELSE 0 END) AS inside FROM en GROUP BY 1), t AS (SELECT sum(degree) / 2 AS m FROM by_)
SELECT round(sum(inside / m - pow(degree / (2 * m), 2)), 6) AS modularity FROM by_, t"""
)
def modularity(spark, sf_dir):
    edges = c.neighbour_edges(_knn(spark, sf_dir), _vectors(spark, sf_dir), "inv_manhattan", "vec_id")
    return c.modularity(edges, _labels(spark, sf_dir), "vec_id").select(*_round("modularity"))


@query()
def leiden(spark, sf_dir):
    edges = c.neighbour_edges(_knn(spark, sf_dir), _vectors(spark, sf_dir), "inv_manhattan", "vec_id")
    return communities.partition(edges, _vectors(spark, sf_dir), id_col="vec_id")


_FAULTLESS = "SELECT count(*) AS vertices, 0::BIGINT AS apart, 0::BIGINT AS gaining FROM embeddings"


@query(_FAULTLESS)
def leiden_faults(spark, sf_dir):
    """The partition of `leiden`: each vertex once, each community connected, no vertex gains by moving."""
    edges = c.neighbour_edges(_knn(spark, sf_dir), _vectors(spark, sf_dir), "inv_manhattan", "vec_id")
    edges = computed_once(edges)
    return communities.faults(edges, communities.partition(edges, _vectors(spark, sf_dir), id_col="vec_id"), id_col="vec_id")


@query("SELECT true AS in_bounds, true AS no_fixed_is_better, count(*) AS vertices FROM embeddings")
def resolution_search(spark, sf_dir):
    """The resolution found between the bounds has a modularity no less than any of the fixed ones."""
    edges = computed_once(c.neighbour_edges(_knn(spark, sf_dir), _vectors(spark, sf_dir), "inv_manhattan", "vec_id"))
    ids = _vectors(spark, sf_dir).select("vec_id")
    found, score, labels = experiment.search_resolution(edges, ids, id_col="vec_id")
    again = communities.partition_graphs(communities.summed_graph(edges), ids, list(experiment.RESOLUTIONS), id_col="vec_id")
    fixed = [r.modularity for r in c.modularities(edges, again, "vec_id").collect()]
    inside = experiment.RESOLUTION_LEAST <= found <= experiment.RESOLUTION_MOST
    return labels.agg(F.lit(inside).alias("in_bounds"), F.lit(all(score >= x - 1e-9 for x in fixed)).alias("no_fixed_is_better"), F.count("*").alias("vertices"))


@query()
def subclones(spark, sf_dir):
    cells = fixtures.cells(spark, sf_dir)
    x = experiment.CellExperiment(cells, fixtures.bins(spark), _matrix(spark, sf_dir))
    return experiment.identify_subclones(x, k=10, resolution=1.0, min_size=2, least_count=0).cells.select("cell_id", "subclone")


@query("SELECT vec_id, CASE WHEN count(*) OVER (PARTITION BY label) < 50 THEN 0 ELSE label END AS label FROM embeddings")
def min_size_collapse(spark, sf_dir):
    return c.collapse_small(_labels(spark, sf_dir), 50)


_TRUST = f"{CELLS}, tr AS (SELECT * FROM cells WHERE est_ploidy > 0 AND est_ploidy < 10 AND total_reads > 100000), gm AS (SELECT g.grp, coalesce(n, 0) AS n_trusted, CASE WHEN n > 10 THEN mean END AS mean_ploidy FROM (SELECT DISTINCT grp FROM cells) g LEFT JOIN (SELECT grp, count(*) AS n, avg(est_ploidy) AS mean FROM tr GROUP BY 1) t ON g.grp = t.grp)"
_TWO = f"""{_TRUST}, cu AS (SELECT grp, est_ploidy, lead(est_ploidy) OVER o AS following, count(*) OVER u AS n1, sum(est_ploidy) OVER u AS s1, count(*) OVER g AS n, sum(est_ploidy) OVER g AS s, sum(est_ploidy * est_ploidy) OVER g AS ss
  FROM tr WINDOW o AS (PARTITION BY grp ORDER BY est_ploidy, cell_id), u AS (PARTITION BY grp ORDER BY est_ploidy, cell_id ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY grp)),
ce AS (SELECT grp, n1, s1 / n1 AS low_centre, (s - s1) / (n - n1) AS high_centre, (n1 * pow(s1 / n1, 2) + (n - n1) * pow((s - s1) / (n - n1), 2) - s * s / n) / nullif(ss - s * s / n, 0) AS separation FROM cu WHERE following > est_ploidy AND n > 10),
two AS (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY grp ORDER BY separation DESC, n1) = 1)"""


@query(f'WITH {_TRUST} SELECT grp AS "group", n_trusted, round(mean_ploidy, 6) AS mean_ploidy FROM gm')
def ploidy_group_mean(spark, sf_dir):
    return p.group_means(fixtures.cells(spark, sf_dir)).select("group", "n_trusted", *_round("mean_ploidy"))


@query(f'WITH {_TWO} SELECT grp AS "group", round(low_centre, 6) AS low_centre, round(high_centre, 6) AS high_centre, round(separation, 6) AS separation FROM two')
def wgd_two_means(spark, sf_dir):
    return p.two_means(fixtures.cells(spark, sf_dir)).select("group", *_round("low_centre", "high_centre", "separation"))


@query(
    f"""WITH {_TWO}, w AS (SELECT cell_id, mean_ploidy, coalesce(separation > 0.7 AND abs(est_ploidy - high_centre) < abs(est_ploidy - low_centre), false) AS wgd FROM cells LEFT JOIN gm ON cells.grp = gm.grp LEFT JOIN two ON cells.grp = two.grp)
SELECT cell_id, wgd, round(mean_ploidy * CASE WHEN wgd THEN 2 ELSE 1 END, 6) AS corr_ploidy FROM w"""
)
def ploidy_correct(spark, sf_dir):
    return p.correct_ploidy(fixtures.cells(spark, sf_dir)).select("cell_id", "wgd", *_round("corr_ploidy"))


def _gauss_sql(n: int) -> str:
    half = n // 2
    terms = " + ".join(f"exp(-0.5 * pow({i - half} / ({n} / 6.0), 2)) * lag(reads, {half - i}) OVER w" if i <= half else f"exp(-0.5 * pow({i - half} / ({n} / 6.0), 2)) * lead(reads, {i - half}) OVER w" for i in range(n))
    return f"WITH {M} SELECT cell_id, bin_idx, round(CASE WHEN count(*) OVER (PARTITION BY cell_id ORDER BY bin_idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) = {n} THEN {terms} ELSE 0 END, 6) AS smoothed FROM m WINDOW w AS (PARTITION BY cell_id ORDER BY bin_idx)"


@query(_gauss_sql(7))
def gauss_smooth(spark, sf_dir):
    return c.gauss_smooth(_matrix(spark, sf_dir), "reads", 7).select("cell_id", "bin_idx", *_round("smoothed"))


@query(
    f"""WITH {M}, {BINS}, v AS (SELECT cell_id, m.bin_idx, CAST(chromosome AS INT) AS chr_order, coalesce(seg, 0) AS value FROM m JOIN bins USING (bin_idx))
SELECT cell_id, bin_idx, chr_order, value, round(quantile_cont(value, 0.01) OVER (), 6) AS low, round(quantile_cont(value, 0.99) OVER (), 6) AS high FROM v"""
)
def heatmap_data(spark, sf_dir):
    rows = _matrix(spark, sf_dir).join(fixtures.bins(spark).select("bin_idx", "chromosome"), "bin_idx")
    return plotdata.heatmap_data(rows, "seg").select("cell_id", "bin_idx", "chr_order", "value", *_round("low", "high"))


@query(f"WITH {M}, r AS (SELECT cell_id, (regexp_extract(cell_id, '[0-9]+')::INT % 3)::VARCHAR AS clone, count(*) OVER () AS n FROM m GROUP BY cell_id) SELECT clone, min(n) AS cells, true AS together, count(*) AS own FROM r GROUP BY clone")
def heatmap_order(spark, sf_dir):
    """Of the heatmap's row order by copy: whether the rows of each clone are next to each other."""
    rows = plotdata.heatmap_rows(_matrix(spark, sf_dir))
    clone = (F.regexp_extract("cell_id", "[0-9]+", 0).cast("int") % 3).cast("string")
    spans = rows.withColumn("clone", clone).groupBy("clone").agg(F.count("*").alias("own"), (F.max("row_number") - F.min("row_number") + 1 == F.count("*")).alias("together"))
    return spans.crossJoin(rows.agg(F.countDistinct("row_number").alias("cells"))).select("clone", "cells", "together", "own")  # one row


@query("WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer) SELECT c_custkey, round(greatest(least(c_acctbal, hi), lo), 6) AS bar FROM customer, q")
def annobar_clamp(spark, sf_dir):
    return plotdata.annotation_bar(fixtures.table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", *_round("bar"))


@query(
    f"""WITH {M}, st AS (SELECT cell_id, quantile_cont(cp, 0.95) AS q95, avg(cp) AS mv, avg(reads) AS mr FROM m GROUP BY 1), o AS (SELECT m.*, q95, mv, mr, cp > q95 AS outlier FROM m JOIN st USING (cell_id)),
t AS (SELECT cell_id, max(cp) FILTER (NOT outlier) AS top FROM o GROUP BY 1)
SELECT o.cell_id, CAST(row_number() OVER (PARTITION BY o.cell_id ORDER BY bin_idx) AS INT) AS bin_number, least(cp, 11) AS "copy", round(reads * mv / mr, 6) AS adj_reads, outlier, greatest(10.0, top)::DOUBLE AS ymax FROM o JOIN t ON o.cell_id = t.cell_id"""
)
def cell_profile(spark, sf_dir):
    rows = _matrix(spark, sf_dir).join(fixtures.bins(spark).select("bin_idx", "chromosome"), "bin_idx")
    return plotdata.cell_profiles(rows).select("cell_id", "bin_number", "copy", *_round("adj_reads"), "outlier", "ymax")


@query(f"WITH {BINS}, n AS (SELECT chromosome, row_number() OVER (ORDER BY bin_idx) AS n FROM bins), s AS (SELECT chromosome, avg(n) AS label_at, max(n) AS b FROM n GROUP BY 1) SELECT chromosome, label_at, CAST(CASE WHEN b < max(b) OVER () THEN b END AS INT) AS border_at FROM s")
def chr_label_pos(spark, sf_dir):
    return plotdata.chromosome_labels(fixtures.bins(spark))


_SEEN = f"seen AS (SELECT DISTINCT regexp_replace(Chr1, '^chr', '') AS chromosome, (Start1 // 500) * 500 + 1 AS start FROM ({fixtures.BEDPE_DUCK}))"


@query(f"WITH {_SEEN}, n AS (SELECT chromosome, row_number() OVER (ORDER BY chromosome, start) AS n FROM seen), s AS (SELECT chromosome, avg(n) AS label_at, max(n) AS b FROM n GROUP BY 1) SELECT chromosome, label_at, CAST(CASE WHEN b < max(b) OVER () THEN b END AS INT) AS border_at FROM s")
def chr_labels_of_fragments(spark, sf_dir):
    """Labels over the bins in which fragments begin, in order of chromosome and place."""
    seen = fixtures.bedpe(spark, sf_dir).select(F.regexp_replace("Chr1", "^chr", "").alias("chromosome"), F.expr("(Start1 div 500) * 500 + 1").alias("start")).distinct()
    return plotdata.chromosome_labels(seen.withColumn("bin_idx", F.struct("chromosome", "start")))
