"""Byte-level BPE encoding and decoding by fragments between forced boundaries.

A pair of bytes that stands inside no vocabulary token is never merged over, so the place between
them is a token border in every text: the encodings of the two sides, one after the other, are the
encoding of the whole. A text is cut at all such places that the tokenizer's pre-splitting cannot
notice either (see `fragments`); each distinct fragment is encoded once by the library and kept in a
bounded memo of the task, and the results are concatenated. Fragments are short and repeat, so
most are looked up, and a very long text needs no long call.

Null and empty texts have no tokens and decode to the empty text. Repeated rows give repeated
results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import chunks
from .workers import released

#: Each half of the memo holds so many fragments at most; longer fragments are not kept.
MEMO_FRAGMENTS = 150_000
MEMO_BYTES_EACH = 64
#: Texts are looked up so many bytes at a time (a longer text alone).
LOOK_UP_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space outside ASCII, as the pre-splitting pattern's \s knows it.
_WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_of_symbol() -> dict[str, int]:
    """The bytes behind the printable symbols of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ForcedBoundaryCodec:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; threads would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("forced boundaries are shown safe for byte-level BPE without normaliser or prefix space")
        symbols = _byte_of_symbol()
        self.pieces = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.special = any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        inside = np.zeros((256, 256), dtype=bool)
        for t in self.pieces.values():
            if len(t) > 1:
                inside[list(t[:-1]), list(t[1:])] = True
        forced = ~inside
        forced[:, 0x80:0xC0] = False  # only between characters
        forced[_SPACE, :] = False  # a run of white space and what follows it are split with regard to each other
        forced[:, ord("'")] = False  # an apostrophe at the start of a fragment could begin a contraction
        self.forced = forced.ravel()
        self.memo: tuple[dict[bytes, str], dict[bytes, str]] = {}, {}
        self.bytes_of = {str(i): piece for i, piece in self.pieces.items()}

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Places in the UTF-8 bytes of a text that no token spans and at which both sides split as in the whole.

        The pattern splits into runs of letters, of numbers and of other characters, each with at most one
        space before it, contractions, and white space, of which a run leaves its last character to what
        follows. It looks ahead only after white space and starts afresh at a change of class, so a cut
        within a run, or between runs, leaves all other splits as they are unless it follows white space or
        precedes an apostrophe. Such places are not taken.
        """
        pair = raw[:-1].astype(np.int64) << 8
        pair |= raw[1:]
        return np.flatnonzero(self.forced[pair]) + 1

    def fragments(self, raw: np.ndarray) -> list[bytes]:
        data = raw.tobytes()
        if not data:
            return []
        if self.special:
            return [data]
        at = self.cuts(raw)
        if wide := self._after_wide_space(data):
            at = at[~np.isin(at, wide)]
        ends = [*at.tolist(), len(data)]
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _after_wide_space(data: bytes) -> list[int]:
        if not (b"\xc2" in data or b"\xe1\x9a\x80" in data or b"\xe2" in data or b"\xe3\x80\x80" in data):
            return []
        text = data.decode("utf-8")
        places = [m.end() for m in _WIDE_SPACE.finditer(text)]
        out, at, total = [], 0, 0
        for p in places:
            total += len(text[at:p].encode("utf-8"))
            at = p
            out.append(total)
        return out

    def _learn(self, missing: list[bytes]) -> list[str]:
        found = self.tokenizer.encode_batch_fast([f.decode("utf-8") for f in missing], add_special_tokens=False)
        return [",".join(map(str, e.ids)) for e in found]

    def look_up(self, parts: list[bytes]) -> list[str]:
        """The ids of each fragment as text.

        The memo has two halves: a full new half becomes the old one, and what is found in the old half moves to the new.
        """
        new, old = self.memo
        known = dict.fromkeys(parts)
        fresh, missing = [], []
        for f in known:
            v = new.get(f)
            if v is None:
                fresh.append(f)
                v = old.get(f)
                if v is None:
                    missing.append(f)
            known[f] = v
        known.update(zip(missing, self._learn(missing), strict=True))
        if len(new) + len(fresh) > MEMO_FRAGMENTS:
            self.memo = new, old = {}, new
        for f in fresh:
            if len(f) <= MEMO_BYTES_EACH and len(new) < MEMO_FRAGMENTS:
                new[f] = known[f]
        return list(map(known.__getitem__, parts))

    def forget(self) -> None:
        self.memo = {}, {}

    def encode(self, text: str | None) -> list[int]:
        parts = self.fragments(np.frombuffer((text or "").encode("utf-8"), np.uint8))
        return [int(i) for ids in self.look_up(parts) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Bytes of all ids, one after the other, as text; what is not UTF-8 becomes U+FFFD, as in the library."""
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", errors="replace")

    def decode_listed(self, listed: str) -> bytes:
        """The decoded text, in UTF-8, of ids joined by commas."""
        back = b"".join(map(self.bytes_of.__getitem__, listed.split(","))) if listed else b""
        return back.decode("utf-8", errors="replace").encode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(path)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row; one pass, no shuffle. keep_ids adds the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            for batch in batches:
                for first, end, raw, bounds in chunks(batch.column(1), LOOK_UP_BYTES):
                    parts = [c.fragments(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    found = c.look_up([f for row in parts for f in row])
                    n, shas, backs, ids, at = [], [], [], [], 0
                    for k, row in enumerate(parts):
                        own = found[at : at + len(row)]
                        at += len(row)
                        listed = ",".join(own)
                        n.append(listed.count(",") + 1 if own else 0)
                        shas.append(hashlib.sha256(listed.encode()).hexdigest())
                        backs.append(hashlib.sha256(c.decode_listed(listed)).hexdigest())
                        if keep_ids:
                            ids.append([int(i) for i in listed.split(",")] if own else [])
                    columns = [batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
                    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            c.forget()  # the worker goes on to other stages

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(released(run), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
