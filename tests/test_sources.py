"""Files: BEDPE, BAM, headers, streams."""

import gzip
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karyon.operators import preprocess
from karyon.plans import source_queries
from karyon.sources import alignments, bam, bedpe
from karyon.sources.bgzf import BLOCK, END, Blocks, BlockWriter, block_size
from karyon.streaming.arrivals import arriving_fragments


def bam_bytes(records, text="@HD\tVN:1.6\n@CO\tCB:cell-1\n@CO\tCB:cell-2\n"):
    body = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, pos, mapq, cigar, mate_pos, length, quality, tags in records:
        n = len(quality)
        ops = [(int(c[:-1]) << 4) | "MIDNSHP=X".index(c[-1]) for c in cigar]
        fixed = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, mapq, 0, len(ops), flag, n, 0, mate_pos, length)
        data = fixed + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes((n + 1) // 2) + bytes(quality) + tags
        body += struct.pack("<i", len(data)) + data
    half = len(body) // 2
    return gzip.compress(body[:half]) + gzip.compress(body[half:])


def test_bam(spark, tmp_path):
    q = [30] * 10
    records = [
        ("a", 99, 100, 60, ["10M"], 200, 110, q, b"CBZcell-1\0"),
        ("a", 147, 200, 60, ["2S", "8M"], 100, -110, q, b"NMi\x01\0\0\0CBZcell-1\0"),
        ("b", 99, 100, 60, ["10M"], 200, 110, [20] * 10, b"CBZcell-1\0"),
        ("b", 147, 200, 60, ["2S", "8M"], 100, -110, [20] * 10, b"CBZcell-1\0"),
        ("c", 1027, 300, 60, ["10M"], 0, 0, q, b""),
        ("d", 99, 300, 29, ["10M"], 0, 0, q, b""),
    ]
    path = tmp_path / "x.bam"
    path.write_bytes(bam_bytes(records))
    bam.register(spark)
    reads = spark.read.format("bam").option("paths", str(path)).load()
    assert reads.count() == 6
    rows = {(r.qname, r.flag): r for r in reads.collect()}
    assert rows["a", 147].cigar == "2S8M" and rows["a", 147].pos == 201 and rows["a", 147].cell_barcode == "cell-1" and rows["a", 99].base_quality == 300
    kept = alignments.flag_filter(reads)
    assert sorted(r.qname for r in kept.collect()) == ["a", "a", "b", "b"]
    pairs = alignments.template_pairs(kept.withColumnRenamed("cell_barcode", "cell_id")).collect()
    assert [(p.Name, p.Start1, p.End1, p.Start2, p.End2, p.R1_direction, p.R2_direction) for p in pairs] == [("a", 100, 110, 200, 208, "+", "-")]
    lines = spark.read.format("bam").option("paths", str(path)).option("header", "true").load()
    assert sorted(r.cell_id for r in alignments.header_cell_ids(lines).collect()) == ["cell-1", "cell-2"]
    counts = alignments.binned_counts(reads.withColumnRenamed("cell_barcode", "cell_id"), 50).collect()
    assert [(c.chromosome, c.start, c.counts) for c in counts] == [("1", 101, 2)]


def test_bedpe_round_trip(spark, tmp_path):
    line = "chr1\t10\t70\tchr1\t100\t160\tr\"1\t60\t+\t-\n"
    (tmp_path / "cell_a.bedpe").write_text(line)
    (tmp_path / "cell_b.bam.bedpe.gz").write_bytes(gzip.compress(line.encode()) + gzip.compress(line.encode()))
    (tmp_path / "cell_c.bedpe").write_text("")
    rows = bedpe.read_bedpe(spark, str(tmp_path))
    assert sorted(r.cell_id for r in rows.collect()) == ["cell_a", "cell_b", "cell_b"]
    assert rows.first().Name == 'r"1'
    bedpe.write_bedpe(rows, str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["cell_a.bedpe.gz", "cell_b.bedpe.gz"]
    assert block_size((tmp_path / "out" / "cell_a.bedpe.gz").read_bytes()) and (tmp_path / "out" / "cell_a.bedpe.gz").read_bytes().endswith(END)
    again = bedpe.read_bedpe(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_stream_of_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "cell_a.bedpe").write_text("chr1\t10\t70\tchr1\t600\t660\tr1\t60\t+\t-\nchrM\t10\t70\tchrM\t600\t660\tr2\t60\t+\t-\n")
    q = arriving_fragments(spark, str(folder), 500).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.cell_id, r.start, r.end, r.length, r.bin_start) for r in spark.table("arrived").collect()] == [("cell_a", 10, 650, 640, 1)]


HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100000\n@SQ\tLN:50000\tSN:chr2\n@CO\tCB:cell-1\n@CO\tCB:cell-2\n@CO\tCB:cell-3\n"


def full_reads(n, seed=1, longest=200):
    """Rows of a full read: pairs on two chromosomes, with names, tags and sizes of many kinds."""
    own = random.Random(seed)
    rows = []
    for k in range(n):
        size, chrom, at = own.choice([1, 2, 35, 36, longest]), own.choice(["chr1", "chr2"]), own.randrange(1, 40_000)
        cell = own.choice(["cell-1", "cell-2", "other", None])
        tags = (b"NMi" + struct.pack("<i", k)) + (b"" if cell is None else b"CBZ" + cell.encode() + b"\0") + own.choice([b"", b"XBBc\x03\0\0\0\1\2\3"])
        for flag, pos, length in ((99, at, 110), (147, at + 100, -110)):
            bases = "".join(own.choice("ACGTN") for _ in range(size))
            cigar = f"{size}M" if size < 30 else f"3S{size - 3}M"
            rows.append((f"read:{k}/{'x' * own.randrange(9)}" if flag == 99 else rows[-1][0], flag, chrom, pos, own.choice([60, 30, 29]), cigar, chrom, 2 * at + 100 - pos, length, bases, bytes(own.randrange(2, 40) for _ in bases) if own.random() < 0.9 else None, tags))
    return rows


NAMES = ["qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "template_length", "sequence", "qualities", "tags"]


def write_bam(path, rows, block=BLOCK):
    head, refs = bam.encoded_header(HEADER)
    out = BlockWriter(str(path))
    records = [head, *(bam.encoded(dict(zip(NAMES, r, strict=True)), refs) for r in rows)]
    data = b"".join(records)
    for k in range(0, len(data), block):
        out._block(data[k : k + block])
    out.close()


def load_bam(spark, path, split, **more):
    bam.register(spark)
    return spark.read.format("bam").options(paths=str(path), split_bytes=split, full="true", **more).load()


@pytest.mark.parametrize("block,parts,longest", [(5_000, 5, 200), (600, 37, 200), (3_000, 6, 9_000), (BLOCK, 4, 200)])
def test_any_split_reads_each_record_once(spark, tmp_path, block, parts, longest):
    rows = full_reads(300, block, longest)
    write_bam(tmp_path / "x.bam", rows, block)
    size = (tmp_path / "x.bam").stat().st_size
    split = load_bam(spark, tmp_path / "x.bam", -(-size // parts))
    assert split.rdd.getNumPartitions() == parts
    got = [tuple(r[n] if n not in ("qualities", "tags") or r[n] is None else bytes(r[n]) for n in NAMES) for r in split.collect()]
    assert got == rows
    whole = load_bam(spark, tmp_path / "x.bam", size)
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == len(rows)


def test_ranges_of_any_size(tmp_path):
    """Without Spark: ranges down to a few bytes, blocks that end inside lengths and names, a file without records."""
    rows = full_reads(40, 3)
    write_bam(tmp_path / "x.bam", rows, 97)
    size = (tmp_path / "x.bam").stat().st_size
    for step in (31, 150, 1000, size):
        got = [n for k in range(0, size, step) for b in bam.bam_batches(str(tmp_path / "x.bam"), k, min(k + step, size)) for n in zip(b["qname"].to_pylist(), b["flag"].to_pylist(), strict=True)]
        assert got == [r[:2] for r in rows], step
    write_bam(tmp_path / "none.bam", [], 20)
    assert not list(bam.bam_batches(str(tmp_path / "none.bam"), 0, 10**6))
    with Blocks(str(tmp_path / "x.bam")) as blocks:
        assert blocks.first_block(0) == 0 and blocks.first_block(size) == size
        starts = [at for at, _ in blocks.from_block(0)]
        assert [blocks.first_block(a - 3) for a in starts[1:]] == starts[1:]


def test_cells_are_written_and_read_back(spark, tmp_path):
    rows = full_reads(200, 7)
    df = spark.createDataFrame(rows, bam.FULL_SCHEMA.replace("path string, ", "").replace(", base_quality long, cell_barcode string", "")).withColumn("cell_id", F.concat(F.lit("c/"), (F.xxhash64("qname") % 3 + 3).cast("string")))
    bam.write_cell_bams(df, str(tmp_path / "out"), HEADER, file_rows=50)
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) > 3 and all(f.name.startswith("c%2F") and f.read_bytes().endswith(END) for f in files)
    back = spark.read.format("bam").option("paths", ",".join(map(str, files))).option("full", "true").load()
    key = lambda r: tuple(repr(bytes(r[n]) if isinstance(r[n], bytearray) else r[n]) for n in NAMES)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    cells = back.select("qname", bedpe.cell_of_path(F.col("path")).alias("file")).distinct()
    wrong = cells.join(df.select("qname", "cell_id").distinct(), "qname").where(F.regexp_replace("cell_id", "/", "%2F") != F.col("file"))
    assert wrong.count() == 0


def test_merged_and_split_preprocessing(spark, tmp_path):
    """From one BAM file of many cells to files of each; from those the same pairs again; a listed cell without reads stays in the manifest."""
    rows = full_reads(150, 11)
    write_bam(tmp_path / "all.bam", rows, 4_000)
    made = {r.cell_id: r for r in preprocess.preprocess_merged_bam(spark, str(tmp_path / "all.bam"), str(tmp_path / "out")).collect()}
    assert set(made) == {"cell-1", "cell-2", "cell-3"} and made["cell-3"].bedpe_file is None and made["cell-3"].pairs == 0
    pairs = bedpe.read_bedpe(spark, str(tmp_path / "out" / "bedpe"))
    counts = {r.cell_id: r["count"] for r in pairs.groupBy("cell_id").count().collect()}
    assert counts == {c: made[c].pairs for c in ("cell-1", "cell-2")}
    kept = [r for r in rows if r[4] >= 30 and b"CBZcell-1" in r[11]]
    names = {r[0] for r in kept if r[1] == 99} & {r[0] for r in kept if r[1] == 147}
    assert 0 < counts["cell-1"] <= len(names)
    paths = [made[c].bam_file for c in ("cell-1", "cell-2")]
    again = {r.cell_id: r.pairs for r in preprocess.preprocess_split_bams(spark, paths, str(tmp_path / "again")).collect()}
    assert again == counts
    assert sorted(map(tuple, bedpe.read_bedpe(spark, str(tmp_path / "again" / "bedpe")).collect())) == sorted(map(tuple, pairs.collect()))
    assert {x.split("\t")[0] for f in (tmp_path / "out" / "CellIDList").glob("part*") for x in f.read_text().splitlines()} == set(made)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    rows = full_reads(90, 5)
    for k in range(90):
        write_bam(tmp_path / f"{k:02}.bam", rows[2 * k : 2 * k + 2])
    files = sorted(tmp_path.iterdir())
    back = load_bam(spark, ",".join(map(str, files)), 10**6)
    assert back.rdd.getNumPartitions() == 1
    assert [r.qname for r in back.collect()] == [r[0] for r in rows]
    sizes = [f.stat().st_size for f in files]
    parts = load_bam(spark, ",".join(map(str, files)), 10**6, task_bytes=3 * max(sizes)).rdd.getNumPartitions()
    assert sum(sizes) / (3 * max(sizes)) <= parts <= 45


def test_rows_are_dealt_to_cells_by_one_shuffle(spark):
    """Only the cells that need several files are joined to, by broadcast; each cell is in one task, a large one in several, rows without a cell in none."""
    data = [(f"cell {k % 4}", f"n{k // 2}", k) for k in range(80)] + [("large", f"n{k // 2}", k) for k in range(200)] + [(None, "x", 0)]
    rows = spark.createDataFrame(data, "cell_id string, qname string, k int")
    dealt = bam.dealt_by_cell(rows, ["qname"], file_rows=60, task_rows=10)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString() + dealt._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert dealt.columns == rows.columns and dealt.rdd.getNumPartitions() == 28
    got = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.cell_id, r.qname, r.k) for r in got) == sorted(d for d in data if d[0])
    tasks = {c: {r.task for r in got if r.cell_id == c} for c in {d[0] for d in data if d[0]}}
    assert 1 < len(tasks.pop("large")) <= 4 and all(len(t) == 1 for t in tasks.values())
    assert all(len({r.task for r in got if (r.cell_id, r.qname) == pair}) == 1 for pair in {(r.cell_id, r.qname) for r in got})


def test_what_is_made_of_templates_is_not_shuffled(spark, tmp_path, monkeypatch):
    """Reads made after the dealing are written like reads made before; the query deals templates."""
    columns = bam.FULL_SCHEMA.replace("path string, ", "").replace(", base_quality long, cell_barcode string", "")
    reads = spark.createDataFrame(full_reads(120, 5), columns).withColumn("cell_id", F.concat(F.lit("c"), (F.xxhash64("qname") % 3 + 3).cast("string")))
    bam.write_cell_bams(reads, str(tmp_path / "before"), HEADER)
    templates = reads.groupBy(F.col("cell_id").alias("cell"), F.col("qname").alias("name")).agg(F.collect_list(F.struct("*")).alias("reads"))
    bam.write_cell_bams(templates, str(tmp_path / "after"), HEADER, cell="cell", together=["name"], made=lambda t: t.select(F.inline("reads")))
    files = lambda part: {f.name: f for f in (tmp_path / part).iterdir()}
    load = lambda f: sorted(map(str, (r for b in bam.bam_batches(str(f), 0, 10**7, True) for r in b.drop_columns("path").to_pylist())))
    before, after = files("before"), files("after")
    assert set(before) == set(after) and all(load(before[f]) == load(after[f]) for f in before)
    asked, plain = [], bam.dealt_by_cell
    monkeypatch.setattr(bam, "dealt_by_cell", lambda rows, *a: asked.append(rows.columns) or plain(rows, *a))
    source_queries.bam_round_trip(spark, "/root/testdata/sf0.001")
    assert asked == [source_queries._OF_READS] and not {"sequence", "qualities"} & set(asked[0])


def test_columns_with_and_without_null_are_listed():
    for column in (pa.array([1, None, 3], pa.int32()), pa.array([1, 2**60], pa.int64()), pa.array(["a", None]), pa.array([b"\0x", None]), pa.array([], pa.string()), pa.array([1.5, None])):
        assert bam._listed(column) == column.to_pylist() and [type(v) for v in bam._listed(column)] == [type(v) for v in column.to_pylist()]
