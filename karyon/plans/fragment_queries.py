"""Queries over fragments: loading, overlaps, bins, ploidy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bins as B
from ..operators import fragments as f
from ..operators import overlaps as o
from ..operators import ploidy as p
from ..sources import alignments
from . import fixtures
from .registry import query

STEPS = {
    "raw": fixtures.BEDPE_DUCK,
    "oriented": "SELECT cell_id, Chr1 AS chr, least(Start1, Start2) AS s, greatest(End1, End2) AS e, Name AS name, right(Name || ':' || R1_direction || '/' || R2_direction, 3) AS strand FROM raw",
    "prefixed": "SELECT cell_id, CASE WHEN bool_or(substring(chr, 1, 3) = 'chr') OVER (PARTITION BY cell_id) THEN chr ELSE 'chr' || chr END AS chr, s, e, name, strand FROM oriented",
    "contigs": "SELECT * FROM prefixed WHERE regexp_matches(chr, '(chr[0-9]+|X|Y)$')",
    "doublets": "SELECT i.*, EXISTS (SELECT 1 FROM contigs j WHERE j.cell_id = i.cell_id AND j.chr = i.chr AND j.e IN (i.s + 9, i.s + 10)) AS doublet FROM contigs i",
    "trimmed": "SELECT cell_id, chr, s, e - 10 AS e, name, strand, doublet, e - 10 - s AS len FROM doublets",
    "flagged": """SELECT *, coalesce(abs(s - lag(s) OVER w) <= 1 OR abs(e - lag(e) OVER w) <= 1, false) AS dup,
        row_number() OVER (PARTITION BY cell_id, chr ORDER BY strand, s, e, name) AS r1, row_number() OVER (PARTITION BY cell_id, chr ORDER BY s, e, strand, name) AS r2
        FROM trimmed WINDOW w AS (PARTITION BY cell_id, chr, strand ORDER BY s, e, name)""",
    "loaded": "SELECT cell_id, chr, s, e, name, strand, doublet, len FROM flagged WHERE NOT dup",
    "enough": "SELECT * FROM loaded WHERE cell_id IN (SELECT cell_id FROM loaded GROUP BY 1 HAVING count(*) >= 100)",
    "limits": "SELECT cell_id, quantile_cont(len, 0.99) AS max_length FROM enough GROUP BY 1",
    "sized": "SELECT enough.*, max_length FROM enough JOIN limits USING (cell_id) WHERE len > 50 AND len < max_length",
    "over_": "SELECT *, count(*) OVER (PARTITION BY cell_id, chr ORDER BY s RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING) AS n_over FROM sized",
    "up": "SELECT a.cell_id, a.chr, a.name, count(b.s) AS n_up FROM sized a LEFT JOIN sized b ON a.cell_id = b.cell_id AND a.chr = b.chr AND b.s BETWEEN trunc(a.s - 2 * a.max_length) AND trunc(a.s - a.max_length) GROUP BY ALL",
    "counted": "SELECT over_.*, n_up, n_over / 49.0 AS norm_over, n_up / max_length AS norm_up, n_over + n_up AS olap FROM over_ JOIN up USING (cell_id, chr, name)",
    "summary": """SELECT cell_id, chr, CAST(floor(s / 500.0) * 500 + 1 AS BIGINT) AS bin_start, count(*) AS bin_reads, CAST(sum(n_up) AS BIGINT) AS count_upstream, sum(norm_up) AS norm_upstream,
        CAST(sum(n_over) AS BIGINT) AS count_over, sum(norm_over) AS norm_over, CAST(sum(len) AS BIGINT) AS bin_coverage, avg(len) AS avg_length, CAST(sum(CAST(doublet AS INT)) AS BIGINT) AS num_doublets, CAST(sum(olap) AS BIGINT) AS olap_count
        FROM counted GROUP BY ALL""",
    "bins": fixtures.BINS_DUCK,
    "grid": "SELECT cell_id, bins.* FROM (SELECT DISTINCT cell_id FROM raw) CROSS JOIN bins",
    "binned": "SELECT grid.*, s.* EXCLUDE (cell_id, chr, bin_start) FROM grid LEFT JOIN summary s ON s.cell_id = grid.cell_id AND s.chr = 'chr' || chromosome AND s.bin_start = bs",
    "quality": "SELECT * EXCLUDE (bin_coverage), bin_coverage / (be - bs) AS bin_coverage, CAST(num_doublets AS DOUBLE) / nullif(bin_reads, 0) AS prop, bin_coverage / (be - bs) / nullif(CAST(num_doublets AS DOUBLE) / nullif(bin_reads, 0), 0) AS bin_quality FROM binned",
    "focal": """SELECT *, n_between < 50 OR between_ AS depth_ok FROM (SELECT *, CAST(sum(CAST(between_ AS INT)) OVER (PARTITION BY cell_id) AS BIGINT) AS n_between FROM (SELECT *, coalesce(olap_count > quantile_cont(olap_count, 0.1) OVER (PARTITION BY cell_id)
        AND olap_count < quantile_cont(olap_count, 0.9) OVER (PARTITION BY cell_id), false) AS between_ FROM quality))""",
    "chosen": "SELECT *, depth_ok AND mappability >= 90 AND bases >= 90 AND use AS selected FROM focal",
    "ratios": "SELECT *, CASE WHEN selected THEN norm_over / nullif(norm_upstream, 0) END AS bin_ratio FROM chosen",
    "ploidies": "SELECT cell_id, count(bin_ratio) AS selected_bins, avg(bin_ratio) AS mean_ratio FROM ratios GROUP BY 1",
}


#: Steps that later ones join to themselves: computed once, not once for each use.
ONCE = {"doublets", "flagged"}


def upto(step: str, select: str) -> str:
    """SQL with all steps up to one, and what to select."""
    names = list(STEPS)
    used = names[: names.index(step) + 1]
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({STEPS[n]})" for n in used) + f"\n{select}"


_FRAGMENT = 'cell_id, chr, s AS start, e AS "end", name, strand'


def _round(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.load_fragments(fixtures.bedpe(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.length_filter(f.enough_fragments(_loaded(spark, sf_dir)))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.ploidy_bins(fixtures.bedpe(spark, sf_dir), fixtures.bins(spark), fixtures.BIN_SIZE)


@query(upto("loaded", f"SELECT {_FRAGMENT}, doublet, len AS length FROM loaded"))
def frag_load(spark, sf_dir):
    return _loaded(spark, sf_dir)


@query(upto("prefixed", f"SELECT {_FRAGMENT} FROM prefixed"))
def frag_chr_prefix(spark, sf_dir):
    return f.chr_prefix(f.orient(fixtures.bedpe(spark, sf_dir)))


@query(upto("contigs", f"SELECT {_FRAGMENT} FROM contigs"))
def frag_contig_filter(spark, sf_dir):
    return f.contig_filter(f.chr_prefix(f.orient(fixtures.bedpe(spark, sf_dir))))


@query(upto("oriented", "SELECT cell_id, strand, count(*) AS n FROM oriented GROUP BY ALL"))
def frag_strand(spark, sf_dir):
    return f.orient(fixtures.bedpe(spark, sf_dir)).groupBy("cell_id", "strand").agg(F.count("*").alias("n"))


@query(upto("doublets", f"SELECT {_FRAGMENT}, doublet FROM doublets"))
def frag_doublet(spark, sf_dir):
    return f.flag_doublets(f.contig_filter(f.chr_prefix(f.orient(fixtures.bedpe(spark, sf_dir)))))


def _trimmed(spark, sf_dir):
    return f.trim(f.flag_doublets(f.contig_filter(f.chr_prefix(f.orient(fixtures.bedpe(spark, sf_dir))))))


@query(upto("flagged", "SELECT cell_id, chr, name FROM flagged WHERE NOT dup"))
def frag_dedup_intended(spark, sf_dir):
    return f.drop_near_duplicates(_trimmed(spark, sf_dir)).select("cell_id", "chr", "name")


@query(upto("flagged", "SELECT a.cell_id, a.chr, a.name FROM flagged a JOIN flagged b ON a.cell_id = b.cell_id AND a.chr = b.chr AND a.r2 = b.r1 WHERE NOT b.dup"))
def frag_dedup_positional(spark, sf_dir):
    return f.drop_near_duplicates(_trimmed(spark, sf_dir), how="positional").select("cell_id", "chr", "name")


@query(upto("limits", "SELECT cell_id, round(max_length, 6) AS max_length FROM limits"))
def frag_len_q99(spark, sf_dir):
    return f.length_limits(f.enough_fragments(_loaded(spark, sf_dir))).select("cell_id", *_round("max_length"))


@query(upto("sized", "SELECT cell_id, name, len AS length, round(max_length, 6) AS max_length FROM sized"))
def frag_len_filter(spark, sf_dir):
    return _sized(spark, sf_dir).select("cell_id", "name", "length", *_round("max_length"))


@query(upto("loaded", "SELECT cell_id, count(*) >= 500 AS enough, count(*) AS n FROM loaded GROUP BY 1"))
def cell_min100_guard(spark, sf_dir):
    """The guard with a threshold that these cells fall on either side of."""
    loaded = _loaded(spark, sf_dir)
    kept = f.enough_fragments(loaded, 500).select("cell_id").distinct().withColumn("enough", F.lit(True))
    return loaded.groupBy("cell_id").agg(F.count("*").alias("n")).join(kept, "cell_id", "left").withColumn("enough", F.coalesce("enough", F.lit(False)))


@query(upto("over_", "SELECT cell_id, name, n_over AS count_over FROM over_"))
def overlap_over_range(spark, sf_dir):
    return o.count_over(_sized(spark, sf_dir)).select("cell_id", "name", "count_over")


@query(upto("up", "SELECT cell_id, name, n_up AS count_upstream FROM up"))
def overlap_upstream_prefix(spark, sf_dir):
    return o.count_upstream(_sized(spark, sf_dir)).select("cell_id", "name", "count_upstream")


@query(upto("counted", "SELECT cell_id, name, n_over AS count_over, n_up AS count_upstream, round(norm_over, 6) AS norm_over, round(norm_up, 6) AS norm_upstream, olap AS olap_count FROM counted"))
def overlap_counts(spark, sf_dir):
    return o.count_overlaps(_sized(spark, sf_dir)).select("cell_id", "name", "count_over", "count_upstream", *_round("norm_over", "norm_upstream"), "olap_count")


_MEASURES = "bin_reads, count_upstream, round(norm_upstream, 6) AS norm_upstream, count_over, round(norm_over, 6) AS norm_over, bin_coverage, round(avg_length, 6) AS avg_length, num_doublets, olap_count"


def _measures():
    return ["bin_reads", "count_upstream", *_round("norm_upstream"), "count_over", *_round("norm_over"), "bin_coverage", *_round("avg_length"), "num_doublets", "olap_count"]


@query(upto("summary", f"SELECT cell_id, chr, bin_start, {_MEASURES} FROM summary"))
def bin_summary(spark, sf_dir):
    return B.bin_summary(o.count_overlaps(_sized(spark, sf_dir)), fixtures.BIN_SIZE).select("cell_id", "chr", "bin_start", *_measures())


@query(upto("binned", f"SELECT cell_id, bin_idx, {_MEASURES} FROM binned"))
def bin_left_lookup(spark, sf_dir):
    summary = B.bin_summary(o.count_overlaps(_sized(spark, sf_dir)), fixtures.BIN_SIZE)
    return B.on_all_bins(summary, fixtures.bins(spark), fixtures.bedpe(spark, sf_dir)).select("cell_id", "bin_idx", *_measures())


@query(upto("quality", "SELECT cell_id, bin_idx, round(bin_coverage, 6) AS bin_coverage, round(prop, 6) AS bin_prop_doublets, round(bin_quality, 6) AS bin_quality FROM quality"))
def bin_quality(spark, sf_dir):
    return _rows(spark, sf_dir).select("cell_id", "bin_idx", *_round("bin_coverage", "bin_prop_doublets", "bin_quality"))


@query(upto("chosen", "SELECT cell_id, bin_idx, depth_ok, selected FROM chosen"))
def bin_focal_selector(spark, sf_dir):
    return _rows(spark, sf_dir).select("cell_id", "bin_idx", "depth_ok", "selected")


@query(upto("ratios", "SELECT cell_id, bin_idx, round(bin_ratio, 6) AS bin_ratio FROM ratios"))
def bin_ratio(spark, sf_dir):
    return _rows(spark, sf_dir).select("cell_id", "bin_idx", *_round("bin_ratio"))


@query(upto("ploidies", "SELECT cell_id, selected_bins, round(mean_ratio, 6) AS mean_ratio, round(1 / nullif(1 - mean_ratio, 0), 4) AS est_ploidy FROM ploidies"))
def cell_ploidy(spark, sf_dir):
    return p.cell_ploidy(_rows(spark, sf_dir)).select("cell_id", "selected_bins", *_round("mean_ratio"), F.round("est_ploidy", 4).alias("est_ploidy"))


@query(
    upto(
        "loaded",
        """SELECT cell_id, CAST(sum(greatest(0, e - greatest(s - 1, coalesce(reach, s - 1)))) AS BIGINT) AS breadth
        FROM (SELECT *, max(e) OVER (PARTITION BY cell_id, chr ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM loaded) GROUP BY 1""",
    )
)
def breadth(spark, sf_dir):
    return f.breadth(_loaded(spark, sf_dir))


_READS_SQL = "SELECT concat('cell_', l_suppkey) AS cell_id, concat('q', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', CAST(round(l_extendedprice * 100) AS BIGINT)) AS qname, CAST((l_orderkey * 13 + l_linenumber * 7 + l_partkey) % 4096 AS INT) AS flag, CAST((l_partkey * 7 + l_orderkey) % 61 AS INT) AS mapq FROM {lineitem}"


@query(f"SELECT * FROM ({_READS_SQL.format(lineitem='lineitem')}) WHERE mapq >= 30 AND (flag & 3) = 3 AND (flag & 3072) = 0")
def bam_flag_filter(spark, sf_dir):
    return alignments.flag_filter(spark.sql(_READS_SQL, lineitem=fixtures.table(spark, sf_dir, "lineitem")))


_HEADER_SQL = "SELECT CASE WHEN s_suppkey % 3 = 0 THEN concat('@SQ', chr(9), 'SN:chr', s_suppkey) WHEN s_suppkey % 3 = 1 THEN concat('@CO', chr(9), 'CB:old CB:', s_name) ELSE concat('@CO', chr(9), 'CB:cell-', s_suppkey) END AS line FROM {supplier}"


@query(f"SELECT regexp_replace(line, '.*CB:(.*)', '\\1') AS cell_id, regexp_replace(line, '.*CB:(.*)', '\\1') AS well FROM ({_HEADER_SQL.format(supplier='supplier')}) WHERE starts_with(line, '@CO')")
def header_cellids(spark, sf_dir):
    return alignments.header_cell_ids(spark.sql(_HEADER_SQL, supplier=fixtures.table(spark, sf_dir, "supplier")), "line")
