"""Blocked gzip (BGZF): reading from any byte of a file, and writing blocks with their end marker.

A BGZF file is a row of gzip members of at most 64 kB that name their own compressed size in an extra field, so a reader that starts anywhere finds the next
block by its magic bytes. Files are opened through Arrow, so a path may be local or in a store that Arrow knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyarrow import fs

#: Fixed values of the format: magic bytes, the extra field's name, the empty block at the end of a file.
MAGIC = b"\x1f\x8b\x08\x04"
EXTRA = b"BC"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a block before compression, so that it fits 64 kB after it.
BLOCK = 0xFF00
_WINDOW = 1 << 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path) if url.scheme else path
    return fs.FileSystem.from_uri(path)


def block_size(head: bytes) -> int | None:
    """The whole size of the block that begins with head, or None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        (length,) = struct.unpack_from("<H", head, at + 2)
        if head[at : at + 2] == EXTRA and length == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


class Blocks:
    """A file of BGZF blocks."""

    def __init__(self, path: str) -> None:
        store, own = store_of(path)
        self.path, self.file = path, store.open_input_file(own)
        self.size = self.file.size()
        self._held, self._at = b"", 0

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bytes_at(self, at: int, n: int) -> bytes:
        """Up to n bytes at a place, read a quarter of a megabyte at a time."""
        if not (self._at <= at and at + n <= self._at + len(self._held)):
            self.file.seek(at)
            self._held, self._at = self.file.read(max(n, 1 << 18)), at
        return self._held[at - self._at : at - self._at + n]

    def is_blocked(self) -> bool:
        return block_size(self.file.read_at(64, 0)) is not None

    def block(self, at: int) -> tuple[bytes, int] | None:
        """(data, place of the next block) of the block at a place; None at the end of the file or where no whole block is."""
        size = block_size(self.bytes_at(at, 64))
        if size is None:
            return None
        raw = self.bytes_at(at, size)
        try:
            data = zlib.decompress(raw, 31)  # with its checksum
        except zlib.error:
            return None
        return data, at + size

    def first_block(self, at: int) -> int:
        """The place of the first block that begins at or after a place; the size of the file if there is none.

        Magic bytes may occur inside compressed data, so the block must inflate to its checksum and be followed by another or by the end.
        """
        while at < self.size:
            window = self.bytes_at(at, _WINDOW + 3)
            k = window.find(MAGIC)
            if k < 0:
                at += max(1, len(window) - 3)
                continue
            found = self.block(at + k)
            if found and (found[1] == self.size or block_size(self.bytes_at(found[1], 64)) is not None):
                return at + k
            at += k + 1
        return self.size

    def from_block(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(place, data) of the blocks from a place on."""
        while at < self.size:
            found = self.block(at)
            if found is None:
                raise ValueError(f"{self.path} is damaged at byte {at}")
            yield at, found[0]
            at = found[1]


class BlockWriter:
    """Writes bytes as blocks to a file of a store, one block in memory at a time."""

    def __init__(self, path: str, level: int = 6) -> None:
        store, own = store_of(path)
        if "/" in own:
            store.create_dir(own.rsplit("/", 1)[0], recursive=True)
        self.out, self.level, self.held = store.open_output_stream(own, compression=None), level, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK:
            self._block(bytes(self.held[:BLOCK]))
            del self.held[:BLOCK]

    def _block(self, data: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        head = MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + EXTRA + struct.pack("<HH", 2, len(body) + 25)
        self.out.write(head + body + struct.pack("<II", zlib.crc32(data), len(data)))

    def close(self) -> None:
        if self.held:
            self._block(bytes(self.held))
        self.out.write(END)
        self.out.close()


def moved(old: str, new: str) -> None:
    store, own = store_of(old)
    store.move(own, store_of(new)[1])


def removed(path: str) -> None:
    store, own = store_of(path)
    if store.get_file_info(own).type == fs.FileType.Directory:
        store.delete_dir(own)
    elif store.get_file_info(own).type == fs.FileType.File:
        store.delete_file(own)


def exists(path: str) -> bool:
    store, own = store_of(path)
    return store.get_file_info(own).type != fs.FileType.NotFound


