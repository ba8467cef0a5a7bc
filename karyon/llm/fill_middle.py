"""Fill-in-the-middle: a text is cut at two line borders and its middle moves behind its suffix.

A text's units are its lines, each with its line feed. The two cuts are ranks of units, drawn from a hash of the id, so they are known before it is
known where in the text they fall. The text is decomposed into chunks of `CHUNK` bytes, each overlapping the one before by a character. Two predicates
of adjacent characters (a unit begins here: the character before is a line feed; a code point begins here) are counted in all chunks at once;
prefix sums of the counts give the number of units of the text and route each cut's rank to the one chunk that owns it. Only the owning chunks are read
again, for the place of the cut and its number of code points. A text of any length takes memory for `PIECE` bytes of predicates at a time.

Markers `<P>`, `<S>` and `<M>` stand before prefix, suffix and middle; a text that holds one of them, an empty text and one that the rate leaves out stay
plain. No piece of a text without markers can make one with its neighbours, since a marker ends where it begins to differ, so `restored` is exact.

A null text is empty, a null id counts as an empty one. Rows that repeat an id are cut at the same ranks of their own texts. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .text import chunks

CHUNK = 1 << 12
#: Bytes whose predicates are held at a time; a multiple of CHUNK.
PIECE = 1 << 20
MARKERS = ("<P>", "<S>", "<M>")
_CUTS = StructType([StructField(c, LongType()) for c in ("n", "first", "second")])


def _begins(raw: np.ndarray, begin: int, end: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a unit begins, a code point begins) at the bytes from begin to end; first: places where texts begin."""
    own = raw[begin:end]
    unit = np.empty(len(own), bool)
    unit[1:] = own[:-1] == 10
    unit[:1] = begin > 0 and raw[begin - 1] == 10  # the overlap
    unit[first[np.searchsorted(first, begin) : np.searchsorted(first, end)] - begin] = True
    return unit, (own & 0xC0) != 0x80


def cuts(raw: np.ndarray, bounds: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(units, code points before the first cut, before the second) of each text; draws: two numbers a text, taken modulo its units + 1 as the ranks of its cuts."""
    texts = len(bounds) - 1
    sizes = np.diff(bounds)
    pieces = -(-sizes // CHUNK)
    at = np.concatenate([[0], np.cumsum(pieces)])  # chunks before each text
    begin = np.repeat(bounds[:-1] - at[:-1] * CHUNK, pieces) + np.arange(at[-1]) * CHUNK
    end = np.minimum(begin + CHUNK, np.repeat(bounds[1:], pieces))
    first = bounds[:-1][sizes > 0]
    counts = np.zeros((2, at[-1] + 1), np.int64)
    k = 0
    while k < at[-1]:
        j = max(k + 1, int(np.searchsorted(end, begin[k] + PIECE, side="right")))
        for row, holds in zip(counts, _begins(raw, begin[k], end[j - 1], first), strict=True):
            row[k + 1 : j + 1] = np.add.reduceat(holds, begin[k:j] - begin[k], dtype=np.int64)
        k = j
    units, points = np.cumsum(counts, axis=1)
    n = units[at[1:]] - units[at[:-1]]
    out = np.empty((3, texts), np.int64)
    out[0] = n
    ranks = np.sort(draws % (n + 1), axis=0)
    for column, rank in zip(out[1:], ranks, strict=True):
        column[:] = points[at[1:]] - points[at[:-1]]  # a cut behind the last unit
        inside = np.flatnonzero(rank < n)
        owner = np.searchsorted(units, units[at[inside]] + rank[inside], side="right") - 1
        for i, c in zip(inside.tolist(), owner.tolist(), strict=True):
            unit, point = _begins(raw, begin[c], end[c], first)
            place = np.flatnonzero(unit)[units[at[i]] + rank[i] - units[c]]
            column[i] = points[c] - points[at[i]] + np.count_nonzero(point[:place])
    return out


@F.arrow_udf(_CUTS)
def _cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    draws = np.stack([one.to_numpy(zero_copy_only=False), other.to_numpy(zero_copy_only=False)])
    found = [cuts(raw, bounds, draws[:, i:j]) for i, j, raw, bounds in chunks(text, PIECE)]
    columns = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["n", "first", "second"])


def _rest(text: Column, begin: Column) -> Column:
    return F.substring(text, begin, F.lit((1 << 31) - 1))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form."""
    p, s, m = (F.instr(output, mark) for mark in MARKERS)
    one = F.lit(1)
    psm = F.concat(F.substring(output, F.lit(4), s - 4), _rest(output, m + 3), F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), _rest(output, m + 3), F.substring(output, one + 3, p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row. rate: percent of texts that are cut; spm_share: percent of those with the suffix first.

    form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle). n: units of the text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("__digest", 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), digest.alias("__digest"))
    rows = rows.select("__id", "__text", *[draw(k).alias(f"__h{k}") for k in range(4)])
    rows = rows.withColumn("__cuts", _cuts("__text", "__h0", "__h1"))
    text = F.col("__text")
    plain = (text == "") | (F.col("__h2") % 100 >= rate)
    for mark in MARKERS:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(F.col("__h3") % 100 < spm_share, "spm").otherwise("psm")
    rows = rows.select("__id", "__text", F.col("__cuts.n").alias("n"), form.alias("form"), F.col("__cuts.first").cast("int").alias("__first"), F.col("__cuts.second").cast("int").alias("__second"))
    prefix, middle, suffix = F.substring(text, F.lit(1), F.col("__first")), F.substring(text, F.col("__first") + 1, F.col("__second") - F.col("__first")), _rest(text, F.col("__second") + 1)
    psm = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle)
    spm = F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)
    cut = F.col("form") != "plain"
    return rows.select(
        F.col("__id").alias(id_col),
        "n",
        "form",
        F.when(cut, F.col("__first").cast("long")).alias("prefix_chars"),
        F.when(cut, (F.col("__second") - F.col("__first")).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text).alias("output"),
    )


def fill_digests(made: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts restored from them, in place of the outputs."""
    own = [c for c in made.columns if c != "output"]
    both = made.select(*own, "output", restored(F.col("output"), F.col("form")).alias("__restored"))
    return both.select(*own, F.sha2("output", 256).alias("output_sha256"), F.sha2("__restored", 256).alias("restored_sha256"))


def fill_digests_sql(seed: int = 7, rate: int = 100, spm_share: int = 50) -> str:
    """The same as DuckDB SQL over `documents`; the restored text is the text itself."""
    draws = ", ".join(f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT AS h{k}" for k in range(4))
    holds = " OR ".join(f"contains(t, '{m}')" for m in MARKERS)
    return rf"""WITH r AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, {draws} FROM r),
c AS (SELECT doc_id, t, units, len(units) AS n, CASE WHEN t = '' OR {holds} OR h2 % 100 >= {rate} THEN 'plain' WHEN h3 % 100 < {spm_share} THEN 'spm' ELSE 'psm' END AS form,
      least(h0 % (len(units) + 1), h1 % (len(units) + 1)) AS a, greatest(h0 % (len(units) + 1), h1 % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
