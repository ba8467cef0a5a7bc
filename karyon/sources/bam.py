"""BAM files as a Spark data source: spark.read.format("bam").option("paths", "a.bam,b.bam").load(), and a writer of one file for each cell.

Reading: files are cut into byte ranges (option split_bytes), and a partition is a range; over `RANGES_APART` of them, as many as come to `task_bytes`, one at least, so that many small files are few tasks. A range owns the records that begin in BGZF blocks which begin in it. It looks for
the first such block by magic bytes, then for the first place in it from which a chain of records holds together (`_first_record`), and reads on
into later ranges only to finish its last record. Every range so finds where the one before it stopped, and no record is read twice. A file that is one plain gzip stream is
one partition. Rows come as Arrow batches of `ROWS`; one block is inflated at a time. option("full", "true") adds the bases, qualities and tags; option("header", "true")
gives the header's lines instead, as (path, value).

Writing: rows (cell_id and the columns of a full read) become `<cell_id>.bam` in a folder, in BGZF blocks with the end marker. Rows of a cell must
follow each other in a task (`write_cell_bams` deals them so); cells dealt to several tasks have a numbered file from each. Tasks write to a folder of their own attempt; the
driver's commit moves the files of the attempts that count, so a lost or repeated task leaves nothing behind.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bgzf import Blocks, BlockWriter, exists, moved, removed
from .shared import computed_once

READ_SCHEMA = "path string, qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, template_length long, base_quality long, cell_barcode string"
FULL_SCHEMA = READ_SCHEMA + ", sequence string, qualities binary, tags binary"
HEADER_SCHEMA = "path string, value string"
SPLIT_BYTES = 32 << 20
#: Bytes of the ranges that one task reads one after the other.
TASK_BYTES = 4 << 20
RANGES_APART = 64
#: Files that the driver looks at together for their size and kind.
_LOOKS = 16
ROWS = 4096
#: Records that must follow each other from a place for it to be taken for the beginning of one, unless the file ends before.
CHAIN = 8
RECORD_MOST = 1 << 26
_READ = 1 << 16
#: Operations of a CIGAR string, codes of bases, and sizes of the tag types, in the order and by the letters of the format.
_CIGAR = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_TAG_SIZE = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
_FIXED = struct.Struct("<iiBBHHHiiii")
#: Bases are half bytes: their hexadecimal digits are exchanged for letters, and letters for digits, what is no base for the last.
_LETTERS = str.maketrans("0123456789abcdef", _BASES)
_DIGITS = bytes(f"{_BASES.find(chr(b)) % 16:x}".encode()[0] for b in range(256))
_LOW = bytes(range(15))


class _Stream:
    """Bytes of a file in order: of BGZF blocks from a place on, or of plain gzip members."""

    def __init__(self, blocks: Blocks, at: int = 0) -> None:
        self.source = blocks.from_block(at) if blocks.is_blocked() else self._members(blocks)
        self.held, self.done = bytearray(), 0
        self.begins: list[tuple[int, int]] = []  # (place in the stream, place of the block), of blocks not read past

    @staticmethod
    def _members(blocks: Blocks) -> Iterator[tuple[int, bytes]]:
        at, inflater = 0, zlib.decompressobj(31)
        while at < blocks.size:
            data = blocks.bytes_at(at, _READ)
            at += len(data)
            while data:
                yield 0, inflater.decompress(data)
                data = inflater.unused_data
                if inflater.eof:
                    inflater = zlib.decompressobj(31)

    def fill(self, n: int) -> bool:
        """Whether n bytes are held, after reading on for them."""
        while len(self.held) < n:
            block = next(self.source, None)
            if block is None:
                return False
            if block[1]:
                self.begins.append((self.done + len(self.held), block[0]))
                self.held += block[1]
        return True

    def take(self, n: int) -> bytes:
        if len(self.held) < n:
            self.fill(n)
        out = bytes(self.held[:n])
        del self.held[:n]
        self.done += len(out)
        return out

    def place(self) -> int:
        """The place of the block that holds the next byte."""
        while len(self.begins) > 1 and self.begins[1][0] <= self.done:
            self.begins.pop(0)
        return self.begins[0][1] if self.begins else 0


@dataclass
class Header:
    """Lines, names and lengths of the references, and where the first record begins: its block, the place in it, and in the whole stream."""

    text: str
    names: list[str]
    lengths: list[int]
    block: int = 0
    within: int = 0
    first: int = 0  # bytes before the first record


def read_header(blocks: Blocks) -> Header:
    stream = _Stream(blocks)
    if stream.take(4) != b"BAM\x01":
        raise ValueError(f"{blocks.path} is not a BAM file")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    names, lengths = [], []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        lengths.append(struct.unpack("<i", stream.take(4))[0])
    found = Header(text, names, lengths, first=stream.done)
    if stream.fill(1):
        found.block = stream.place()
        found.within = stream.done - stream.begins[0][0]
    else:
        found.block = blocks.size
    return found


def _length_at(data: bytes | bytearray, at: int, header: Header) -> int | None:
    """The length of a record that may begin at a place of the data; None if none can. 0: too little data to tell."""
    if at + 36 > len(data):
        return 0
    (size,) = struct.unpack_from("<i", data, at)
    ref, pos, name_len, _, _, n_ops, _, n_bases, mate, mate_pos, _ = _FIXED.unpack_from(data, at + 4)
    if not (34 <= size <= RECORD_MOST and name_len >= 2 and n_bases >= 0 and 32 + name_len + 4 * n_ops + (n_bases + 1) // 2 + n_bases <= size):
        return None
    for r, p in ((ref, pos), (mate, mate_pos)):
        if not (-1 <= r < len(header.names) and -1 <= p and (r < 0 or p <= header.lengths[r])):
            return None
    head = at + 36
    if head + name_len + 4 * n_ops > len(data):
        return 0
    name = data[head : head + name_len]
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    ops = data[head + name_len : head + name_len + 4 * n_ops : 4]
    return 4 + size if all(op & 15 < len(_CIGAR) for op in ops) else None


def _first_record(stream: _Stream, header: Header, end: int) -> bool:
    """Moves the stream to the first record that begins in a block before `end`; False if none does."""
    while stream.fill(1) and stream.place() < end:
        at, n = 0, 0
        while n < CHAIN:
            length = _length_at(stream.held, at, header)
            if length == 0:
                if stream.fill(len(stream.held) + 1):
                    continue
                length = 4 if at == len(stream.held) and n else None  # the file ends with a whole record
                n = CHAIN if length else n
            if not length:
                break
            if n < CHAIN and not stream.fill(at + length):
                break
            at, n = at + length, n + 1
        if n >= CHAIN:
            return True
        stream.take(1)
    return False


def _barcode(tags: bytes) -> str | None:
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], tags[at + 2 : at + 3]
        at += 3
        if kind == b"Z" or kind == b"H":
            end = tags.index(b"\0", at)
            if name == b"CB":
                return tags[at:end].decode()
            at = end + 1
        elif kind == b"B":
            size, n = _TAG_SIZE[tags[at : at + 1]], struct.unpack("<i", tags[at + 1 : at + 5])[0]
            at += 5 + size * n
        else:
            at += _TAG_SIZE[kind]
    return None


def _decoded(path: str, body: bytes, names: list[str], full: bool) -> tuple:
    ref, pos, name_len, mapq, _, n_ops, flag, n_bases, mate, mate_pos, length = _FIXED.unpack_from(body)
    at = 32 + name_len
    bases = at + 4 * n_ops
    cigar = _cigar_of(body[at:bases])
    at = bases + (n_bases + 1) // 2
    quality = body[at : at + n_bases]
    total = sum(quality.translate(None, _LOW)) if quality[:1] != b"\xff" else 0
    tags = body[at + n_bases :]
    row = path, body[32 : 32 + name_len - 1].decode(), flag, names[ref] if ref >= 0 else None, pos + 1, mapq, cigar, names[mate] if mate >= 0 else None, mate_pos + 1, length, total, _barcode(tags)
    if not full:
        return row
    return *row, body[bases:at].hex().translate(_LETTERS)[:n_bases], quality if quality[:1] != b"\xff" else None, tags


def _types(full: bool) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [(n, kinds[k]) for n, k in (c.split(" ") for c in (FULL_SCHEMA if full else READ_SCHEMA).split(", "))]


def bam_batches(path: str, begin: int, end: int, full: bool = False) -> Iterator[pa.RecordBatch]:
    """The records of a file that begin in blocks from byte `begin` to `end`."""
    types = _types(full)
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])
    with Blocks(path) as blocks:
        header = read_header(blocks)
        if not blocks.is_blocked():
            stream = _Stream(blocks)
            stream.take(header.first)
            end = 1
        elif begin <= header.block:
            stream = _Stream(blocks, header.block)
            stream.take(header.within)
        else:
            stream = _Stream(blocks, blocks.first_block(begin))
            if not _first_record(stream, header, end):
                return
        rows: list[tuple] = []
        while stream.fill(4) and stream.place() < end:
            size = int.from_bytes(stream.held[:4], "little", signed=True)
            body = stream.take(4 + size)[4:]
            if len(body) < size:
                raise ValueError(f"{path} ends within a record")
            rows.append(_decoded(path, body, header.names, full))
            if len(rows) == ROWS:
                yield make(rows)
                rows = []
        if rows:
            yield make(rows)


class _Ranges(InputPartition):
    """(path, begin, end) of byte ranges."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], header: bool, full: bool, split_bytes: int, task_bytes: int) -> None:
        self.paths, self.header, self.full, self.split_bytes, self.task_bytes = paths, header, full, split_bytes, task_bytes

    def _ranges(self, path: str) -> list[tuple[str, int, int]]:
        with Blocks(path) as blocks:
            whole = self.header or not blocks.is_blocked()
            step = max(1, blocks.size if whole else self.split_bytes)
            return [(path, k, min(k + step, blocks.size)) for k in range(0, blocks.size, step)]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(_LOOKS) as pool:
            ranges = [r for own in pool.map(self._ranges, self.paths) for r in own]
        if len(ranges) <= RANGES_APART:
            return [_Ranges([r]) for r in ranges]
        found, held = [_Ranges([])], 0
        for one in ranges:
            size = one[2] - one[1]
            if found[-1].ranges and held + size > self.task_bytes:
                found.append(_Ranges([]))
                held = 0
            found[-1].ranges.append(one)
            held += size
        return found

    def read(self, partition: _Ranges) -> Iterator:
        for path, begin, end in partition.ranges:
            if not self.header:
                yield from bam_batches(path, begin, end, self.full)
            elif begin == 0:
                with Blocks(path) as blocks:
                    yield from ((path, line) for line in read_header(blocks).text.splitlines())


def encoded_header(text: str) -> tuple[bytes, dict[str, int]]:
    """The bytes of a header before the records, and the number of each reference, from its @SQ lines."""
    refs = [(m[1], int(m[2])) for m in (re.match(r"@SQ\t(?=.*\bSN:([^\t]+))(?=.*\bLN:(\d+))", line) for line in text.splitlines()) if m]
    own = text.encode()
    out = [b"BAM\x01", struct.pack("<i", len(own)), own, struct.pack("<i", len(refs))]
    for name, length in refs:
        out += [struct.pack("<i", len(name) + 1), name.encode(), b"\0", struct.pack("<i", length)]
    return b"".join(out), {name: k for k, (name, _) in enumerate(refs)}


def _interval(begin: int, end: int) -> int:
    """The smallest interval of the format's index that holds [begin, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


@lru_cache(1 << 16)
def _operations(cigar: str) -> tuple[bytes, int, int]:
    """(bytes, number, places of the reference) of a CIGAR string's operations."""
    ops = [(int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return b"".join(struct.pack("<I", n << 4 | _CIGAR.index(k)) for n, k in ops), len(ops), sum(n for n, k in ops if k in "MDN=X") or 1


@lru_cache(1 << 16)
def _cigar_of(ops: bytes) -> str:
    return "".join(f"{op >> 4}{_CIGAR[op & 15]}" for (op,) in struct.iter_unpack("<I", ops)) or "*"


def _listed(column: pa.Array) -> list:
    """The values as a list; strings, bytes, and whole numbers without NULL go through numpy, which is faster."""
    kind, types = column.type, pa.types
    if types.is_string(kind) or types.is_binary(kind) or types.is_large_string(kind) or types.is_large_binary(kind) or (types.is_integer(kind) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def encoded(row: dict, refs: dict[str, int]) -> bytes:
    """A record of the columns of a full read."""
    name = (row["qname"] or "*").encode() + b"\0"
    bases = row["sequence"] or ""
    ops, n_ops, span = _operations(row["cigar"] or "*")
    pos = (row["pos"] or 0) - 1
    code = bytes.fromhex((bases.encode("latin-1", "replace").translate(_DIGITS) + b"0" * (len(bases) % 2)).decode())
    quality = row["qualities"] if row["qualities"] is not None else b"\xff" * len(bases)
    if len(quality) != len(bases):
        raise ValueError(f"{row['qname']}: {len(bases)} bases and {len(quality)} qualities")
    chrom, mate = row["chrom"], row["mate_chrom"]
    fixed = _FIXED.pack(
        -1 if chrom is None else refs[chrom], pos, len(name), row["mapq"] or 0, _interval(pos, pos + span) if pos >= 0 else 4680, n_ops, row["flag"] or 0, len(bases), -1 if mate is None else refs[mate], (row["mate_pos"] or 0) - 1, row["template_length"] or 0
    )
    body = b"".join([fixed, name, ops, code, quality, row["tags"] or b""])
    return struct.pack("<i", len(body)) + body


@dataclass
class _Written(WriterCommitMessage):
    """(cell, file of the attempt) of a task."""

    files: list[tuple[str, str]]


class CellFiles(DataSourceArrowWriter):
    """Writes a file for each run of rows of one cell; the commit moves the files into the folder."""

    def __init__(self, folder: str, overwrite: bool, ending: str) -> None:
        self.folder, self.ending = folder.rstrip("/"), ending
        self.waiting = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
        if exists(self.folder) and overwrite:
            removed(self.folder)

    def begin(self, out: BlockWriter) -> None:
        """What stands before the first row of a file."""

    def one(self, row: dict) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        attempt, files, cell, out = uuid.uuid4().hex, [], None, None
        for batch in iterator:
            names = batch.schema.names
            for values in zip(*(_listed(column) for column in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if out is None or row["cell_id"] != cell:
                    if out:
                        out.close()
                    cell = row["cell_id"]
                    files.append((cell, f"{self.waiting}/{attempt}/{len(files)}"))
                    out = BlockWriter(files[-1][1])
                    self.begin(out)
                out.write(self.one(row))
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        by_cell: dict[str, list[str]] = {}
        for message in messages:
            for cell, path in message.files if message else []:
                by_cell.setdefault(cell, []).append(path)
        for cell, paths in by_cell.items():
            for k, path in enumerate(paths):
                part = f".part-{k:04d}" if len(paths) > 1 else ""
                moved(path, f"{self.folder}/{quote(str(cell), safe=' ')}{part}{self.ending}")
        removed(self.waiting)

    def abort(self, messages: list[_Written | None]) -> None:
        removed(self.waiting)


class _BamWriter(CellFiles):
    def __init__(self, folder: str, overwrite: bool, header: str) -> None:
        super().__init__(folder, overwrite, ".bam")
        self.head, self.refs = encoded_header(header)

    def begin(self, out: BlockWriter) -> None:
        out.write(self.head)

    def one(self, row: dict) -> bytes:
        return encoded(row, self.refs)


class _LineWriter(CellFiles):
    def one(self, row: dict) -> bytes:
        return row["line"].encode() + b"\n"


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def _is(self, option: str) -> bool:
        return str(self.options.get(option, "false")).lower() == "true"

    def schema(self) -> str:
        return HEADER_SCHEMA if self._is("header") else FULL_SCHEMA if self._is("full") else READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = self.options.get("paths") or self.options.get("path") or ""
        return _Reader([p for p in paths.split(",") if p], self._is("header"), self._is("full"), int(self.options.get("split_bytes", SPLIT_BYTES)), int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> CellFiles:
        return _BamWriter(self.options["path"], overwrite, self.options.get("header_text", ""))


class LinesDataSource(DataSource):
    """Rows (cell_id, line) as blocked gzip text, a file for each cell."""

    @classmethod
    def name(cls) -> str:
        return "cell_lines"

    def writer(self, schema, overwrite: bool) -> CellFiles:
        return _LineWriter(self.options["path"], overwrite, self.options.get("ending", ".gz"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamDataSource)
    spark.dataSource.register(LinesDataSource)


#: Rows of a cell for which one task writes one file, and rows of all cells of a task.
FILE_ROWS = 5_000_000
TASK_ROWS = 250_000


def dealt_by_cell(rows: DataFrame, together: list[str], file_rows: int = FILE_ROWS, cell: str = "cell_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """rows with those of a cell in one task; those of a cell of more than file_rows rows in several, by a hash of `together`. Rows without a cell are left out.

    Only the few cells of so many rows are joined to, so rows are shuffled once. Tasks grow in number and not in rows.
    """
    spark, rows = rows.sparkSession, rows.where(F.col(cell).isNotNull())
    counts = computed_once(rows.groupBy(cell).agg(F.count("*").alias("n")))
    large = counts.where(F.col("n") > file_rows).select(cell, F.ceil(F.col("n") / file_rows).cast("int").alias("__parts"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (counts.agg(F.sum("n")).first()[0] or 0) // task_rows)
    part = F.coalesce(F.pmod(F.xxhash64(*together), F.col("__parts")), F.lit(0))
    return rows.join(F.broadcast(large), cell, "left").withColumn("__part", part).repartition(tasks, cell, "__part").drop("__parts", "__part")


def write_cell_bams(reads: DataFrame, folder: str, header: str, file_rows: int = FILE_ROWS, cell: str = "cell_id", together: list[str] | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Full reads (cell_id, ...) as a BAM file for each cell, by place; mates of a pair are in one file.

    made: makes the full reads of other rows, such as templates, after these are dealt by `cell`, and those of a large one by `together`; so what it adds is not shuffled.
    """
    names = [c.split(" ")[0] for c in FULL_SCHEMA.split(", ") if not c.startswith(("path", "base_quality", "cell_barcode"))]
    dealt = dealt_by_cell(reads, together, file_rows, cell) if made else dealt_by_cell(reads.select("cell_id", *names), together or ["qname"], file_rows, cell)
    full = (made(dealt) if made else dealt).select(F.col("cell_id").cast("string").alias("cell_id"), *names)
    register(reads.sparkSession)
    full.sortWithinPartitions("cell_id", "chrom", "pos", "qname", "flag").write.format("bam").mode("append").option("header_text", header).save(folder)
