"""Licence scan by canonical digests, in DataFrame functions.

A text is brought to a canonical form: lines of copyright notices and title lines dropped; A-Z in lower case; every run of
other ASCII signs and white space made one space; equivalent spellings made one. The SHA-256 of all of
it is looked up among the digests of known licences, brought to the same form. The known table is a constant of a
few rows and is broadcast; the documents are read once and not shuffled.

A notice is a line that begins with "copyright" and a year, "(c)" or ©, with a capitalised "Copyright" and a name, with "(c)" and a year,
or with ©; and a line that says "all rights reserved" alone. A line of a wrapped licence that begins with "copyright notice" or the like is none.
A title is a line that says "MIT License", "The BSD 3-Clause License" or the like alone.

Only entire texts match: a licence inside a longer text is not found. Null and empty texts, and texts of notices alone, have no words and match
nothing. Repeated rows give repeated results; an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import DIGESTS, LICENCES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before a capitalised "copyright" that begins a line. A pattern's line begins with the line end before it; every line has both line ends to itself.
_CAPITAL = "\x02"
_INDENT = r"[ \t/*#;-]*"
#: The licences' own words after "copyright", and words that title a licence, lowered.
OWN_WORDS = r"(notices?|holders?|owners?|laws?|interests?|licen[sc]es?|statements?|permissions?|protection|and|or|in|to|is|are|as|for|on|it|that|which|treaty)"
TITLES = r"(mit|mit no attribution|mit-0|isc|zlib|zlib/libpng|expat|x11|0bsd|bsd|bsd zero[ -]clause|zero[ -]clause bsd|new bsd|modified bsd|simplified bsd|bsd[ -][0-9][ -]clause|[0-9][ -]clause bsd)"
#: Steps of the canonical form in order: pattern and what replaces it; \1 and so on are groups.
CAPITALS = (rf"(\n{_INDENT})C(opyright|OPYRIGHT)([ \t:])", rf"\1{_CAPITAL}copyright\3")
LINES = [
    (rf"{_CAPITAL}(copyright[ \t]+{OWN_WORDS}[^a-z])", r"\1"),
    (rf"\n{_INDENT}({_CAPITAL}|copyright[ \t:,]*(\(c\)|©|&copy;|[0-9]|[<\[{{(]?(year|yyyy))|\(c\)[ \t]*(copyright|[0-9])|©)[^\n]*", r"\n"),
    (rf"\n{_INDENT}all rights reserved[ \t\r.*/#;-]*\n", r"\n"),
    (rf"\n[ \t/*#;=-]*(the )?{TITLES}( \"[a-z]+\"( or \"[a-z]+\")?)? licen[sc]e( \([a-z0-9 -]+\))?[ \t\r.:*/#=-]*\n", r"\n"),
]
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("percent", "per cent"),
    ("https", "http"),
]


def _as_java(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement).replace(r"\n", "\n")


def canonical(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(_CAPITAL), F.lit(" "))
    out = F.concat(F.lit("\n"), F.replace(out, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
    out = F.regexp_replace(out, CAPITALS[0], _as_java(CAPITALS[1]))
    out = F.translate(out, _UPPER, _LOWER)
    for pattern, to in LINES:
        out = F.regexp_replace(out, pattern, _as_java(to))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[\x00-/:-`{-\x7F]+", " ")), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same in DuckDB."""
    quoted = lambda pattern, to: "'" + pattern.replace("'", "''") + "', '" + to.replace(r"\n", "\n") + "', 'g'"
    out = f"replace(coalesce({text}, ''), '{_CAPITAL}', ' ')"
    out = f"'\n' || replace({out}, '\n', '\n\n') || '\n'"
    out = f"regexp_replace({out}, {quoted(*CAPITALS)})"
    out = f"translate({out}, '{_UPPER}', '{_LOWER}')"
    for pattern, to in LINES:
        out = f"regexp_replace({out}, {quoted(pattern, to)})"
    out = rf"' ' || trim(regexp_replace({out}, '[\x00-/:-`{{-\x7F]+', ' ', 'g')) || ' '"
    for one, other in SPELLINGS:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim({out})"


def known_digests(spark, licences: dict[str, str] = LICENCES, more: dict[str, str] | None = None) -> DataFrame:
    """(canonical_sha256, license_id) of the known licences: of their texts, and of `more`, ids by digest."""
    texts = spark.createDataFrame(sorted(licences.items()), "license_id string, text string")
    found = texts.select(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"), "license_id")
    if more:
        found = found.unionByName(spark.createDataFrame(sorted(more.items()), "canonical_sha256 string, license_id string"))
    return found.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: dict[str, str] = LICENCES, more: dict[str, str] | None = DIGESTS) -> DataFrame:
    """(id, canonical_sha256, n_words, license_id, is_license) of every document; license_id is null if unknown."""
    form = docs.select(id_col, canonical(F.col(text_col)).alias("form"))
    words = F.when(F.col("form") == "", F.lit(0)).otherwise(F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit(""))) + 1)
    digested = form.select(id_col, F.sha2("form", 256).alias("canonical_sha256"), words.cast("long").alias("n_words"))
    found = digested.join(F.broadcast(known_digests(docs.sparkSession, licences, more)), "canonical_sha256", "left")
    return found.select(id_col, "canonical_sha256", "n_words", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def licence_scan_sql(docs: str = "documents") -> str:
    quoted = {k: v.replace("'", "''") for k, v in LICENCES.items()}
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(quoted.items()))
    more = ", ".join(f"('{d}', '{i}')" for d, i in sorted(DIGESTS.items()))
    return f"""
WITH texts AS (SELECT license_id, {canonical_sql("text")} AS form FROM (VALUES {rows}) AS t(license_id, text)),
known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256(form) AS digest, license_id FROM texts UNION ALL VALUES {more}) GROUP BY 1),
d AS (SELECT doc_id, {canonical_sql("text")} AS form FROM {docs})
SELECT doc_id, sha256(form) AS canonical_sha256, CAST(CASE WHEN form = '' THEN 0 ELSE length(form) - length(replace(form, ' ', '')) + 1 END AS BIGINT) AS n_words, license_id, license_id IS NOT NULL AS is_license
FROM d LEFT JOIN known ON digest = sha256(form)"""
