"""Tables of (key, values) in files of the shared folder that tasks map into memory page by page.

A table may be larger than any process: its rows lie in files by ranges of the key, sorted, keys apart from values, and a
task touches only the pages that its own keys fall on. spark.checkpoint.dir must be mounted on the driver and all executors.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import local_folder

#: Rows of a file.
FILE_ROWS = 1 << 22
#: Files that a worker keeps mapped.
_MAPPED_MOST = 64
_mapped: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def _maps(path: str, n: int, width: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    if path not in _mapped:
        _mapped[path] = np.memmap(path + ".keys", np.int64, "r", shape=(n,)), np.memmap(path + ".values", kind, "r", shape=(n, width))
        if len(_mapped) > _MAPPED_MOST:
            _mapped.popitem(last=False)
    _mapped.move_to_end(path)
    return _mapped[path]


def let_go() -> None:
    """Unmaps this process's files; a later look maps them again."""
    _mapped.clear()


class Lookup:
    def __init__(self, files: list[tuple[int, int, str, int]], width: int = 1, kind: type = np.float32):
        self.files, self.width, self.kind = sorted(files), width, kind

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key; nan where the key is not there."""
        some, inverse = np.unique(keys, return_inverse=True)
        found = np.full((len(some), self.width), np.nan, np.float32)
        for first, last, path, n in self.files:
            i, j = np.searchsorted(some, first, "left"), np.searchsorted(some, last, "right")
            if i < j:
                own, values = _maps(path, n, self.width, self.kind)
                at = np.minimum(np.searchsorted(own, some[i:j]), n - 1)
                here = np.flatnonzero(own[at] == some[i:j])
                found[i + here] = values[at[here]]
        return found[inverse]

    def find_one(self, keys: np.ndarray) -> np.ndarray:
        return self.find(keys)[:, 0]


def in_ranges(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows with a hash as their key, dealt to `parts` equal ranges of it and sorted: the ranges of a hash need no look at the rows first."""
    place = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), 32) * F.lit(parts)
    return rows.withColumn("__range", F.shiftright(place, 32).cast("int")).repartitionById(parts, "__range").drop("__range").sortWithinPartitions(key)


def lookup(rows: DataFrame, width: int = 1) -> Lookup:
    """Writes rows of (key long, value), keys once each, as the files of a Lookup. value: a number, or the bytes of `width` float32."""
    parts = max(1, -(-rows.count() // FILE_ROWS))
    return sorted_lookup(rows.select("key", "value").repartitionByRange(parts, "key").sortWithinPartitions("key"), width)


def sorted_lookup(ordered: DataFrame, width: int = 1, kind: type = np.float32, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> Lookup:
    """The same of rows whose partitions are ranges of the key and sorted. kind: the type of the values' bytes. made: makes the rows of what `ordered` has, in the same worker."""
    folder = local_folder(ordered.sparkSession)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/lookup-{name}-{uuid.uuid4().hex}"
        first = last = None
        n = 0
        with open(path + ".keys", "wb") as keys, open(path + ".values", "wb") as values:
            for batch in made(batches) if made else batches:
                if not batch.num_rows:
                    continue
                own = np.ascontiguousarray(batch.column(0).to_numpy())
                own.tofile(keys)
                if width > 1:
                    values.write(b"".join(batch.column(1).to_pylist()))
                else:
                    batch.column(1).to_numpy().astype(np.float32).tofile(values)
                first, last, n = int(own[0]) if first is None else first, int(own[-1]), n + len(own)
        if n:
            yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "path": path, "n": n}])
        else:
            os.remove(path + ".keys")
            os.remove(path + ".values")

    files = ordered.mapInArrow(run, "first bigint, last bigint, path string, n bigint").collect()  # a row for each file
    return Lookup([tuple(r) for r in files], width, kind)
