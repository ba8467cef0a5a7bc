"""Registered queries against their SQL; chat formatting and the pipeline against brute force."""

import hashlib
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from karyon.llm import queries
from karyon.llm.chat_format import digests, examples, format_turns, spelled_out
from karyon.llm.licence_texts import DIGESTS, LICENCES
from karyon.llm.licences import licence_scan
from karyon.llm.tables import cut, table

from ..compare import assert_same
from . import edges
from .test_near import brute_contamination, brute_groups

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_all_registered():
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in known} and "pipeline" in known
    assert not set(__spark_entry__.oracle_sql()) - set(known)


def test_chat_of_edges(spark):
    rows = [
        (1, 0, "user", "a\\b <| \\<| </s>"), (1, 1, "assistant", "[INST]\n<|im_end|>\n"), (1, 1, "assistant", "[INST]\n<|im_end|>\n"), (1, None, "system", None), (2, 5000, "assistant", ""), (2, 3, "us\ner%0A", "x"),
        (None, 1, None, "y"), (3, 0, "assistant", "é🙂" * 3000),
    ]
    turns = format_turns(spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, begin string"))
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in digests(turns).collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = [x[3] for x in own if x[2] == "assistant"]
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (sum(map(len, loss)), sha("".join(loss)))
    whole = spelled_out(turns).collect()
    assert len(whole) == examples(turns).count() == 4
    assert all(len(r.text) == r.loss_end + len("<|im_end|>\n") for r in whole)
    assert digests(format_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


def test_licences_of_edges(spark):
    known = {"A": "Copyright 2001 X\nUse this licence as you like, sub-license it."}
    rows = [(1, "USE THIS LICENSE, as you like; sublicense it!"), (2, "/* (c) 1999 me\n * Copyright me */\nUse this license as you like. Sublicense it"), (3, "Use this license"), (4, None), (5, ""), (1, "x")]
    got = sorted(((r.doc_id, r.license_id) for r in licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string"), licences=known).collect()), key=repr)
    assert got == sorted([(1, "A"), (2, "A"), (3, None), (4, None), (5, None), (1, None)], key=repr)
    assert licence_scan(edges.documents(spark)).count() == len(edges.rows())
    assert licence_scan(edges.empty(spark)).count() == 0


def test_wrapped_licences(spark):
    isc, bsd = LICENCES["ISC"].replace("above copyright", "above\ncopyright"), LICENCES["BSD-2-Clause"].replace("THE COPYRIGHT", "THE\nCOPYRIGHT")
    rows = [(1, f"Copyright (c) 2020 Me\nAll rights reserved.\n\n{isc}"), (2, bsd)]
    assert {r.doc_id: r.license_id for r in licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1: "ISC", 2: "BSD-2-Clause"}


#: Whole texts, and what licence they are; None: not one alone.
WHOLE_LICENCES = [
    (f"ISC License\n\nCopyright (c) 2019, A. Person\r\n\r\n{LICENCES['ISC'].replace('above copyright', 'above' + chr(10) + 'copyright')}", "ISC"),
    (f"The MIT License (MIT)\n=====================\n\nCopyright The Authors of Something\nCopyright: 2011-2013 X\n\n{LICENCES['MIT']}", "MIT"),
    ("\n".join(f" * {x}" for x in f"BSD 3-Clause License\n\n© me\nAll rights reserved.\n\n{LICENCES['BSD-3-Clause']}".split("\n")), "BSD-3-Clause"),
    (LICENCES["BSD-3-Clause"].replace("name of the copyright", "name of the\nCopyright"), "BSD-3-Clause"),
    ('BSD 2-Clause "Simplified" License\n' + LICENCES["BSD-2-Clause"], "BSD-2-Clause"),
    (LICENCES["GPL-3.0-or-later-header"].upper(), "GPL-3.0-or-later-header"),
    (LICENCES["MIT"] + "\nAnd more.", None),
    (LICENCES["MIT"].replace("without restriction", "with restriction"), None),
    ("Copyright 2020 me\nMIT License", None),
    ("\x02copyright\n\x02 and copyright © é\n(c) copyright\nCopyright\nCopyright é\ncopyright the software, and", None),
    (None, None),
    ("", None),
]


def test_whole_licences_in_spark_and_sql(spark, tmp_path):
    """Matches in checked rows: Spark and DuckDB name the same licences, with the same canonical forms."""
    rows = [(i, text) for i, (text, _) in enumerate(WHOLE_LICENCES)] + [(100 + i, text) for i, text in enumerate(LICENCES.values())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for other in Path(SF).glob("*.parquet"):
        if other.name != "documents.parquet":
            (tmp_path / other.name).symlink_to(other)
    assert_same(spark, str(tmp_path), lambda spark, sf_dir: licence_scan(table(spark, sf_dir, "documents")), queries.ORACLE_SQL["op7_licence_scan"])
    got = {r.doc_id: r.license_id for r in licence_scan(docs).collect()}
    assert [got[i] for i in range(len(WHOLE_LICENCES))] == [want for _, want in WHOLE_LICENCES]
    assert [got[100 + i] for i in range(len(LICENCES))] == list(LICENCES)
    assert len(set(LICENCES) | set(DIGESTS.values())) >= 30


def test_licence_digests(spark):
    """The long licences, where the system has their texts."""
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows = [(k, (folder / f).read_text()) for f, k in files.items() if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence texts here")
    got = licence_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == {k: k for k, _ in rows}


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    at = docs
    for name in ("quality", "toxicity"):
        after = cut(stages[name](spark, at, SF))
        assert after.columns == docs.columns and 0 < after.count() <= at.count()
        at = after
    rows = [tuple(r) for r in at.select("doc_id", "text").collect()]
    after = cut(stages["near_duplicates"](spark, at, SF))
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c, _, _ in brute_groups(rows) if i == c)
    rows = [tuple(r) for r in after.select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = {r[0] for r in brute_contamination(rows, items) if not r[5]}
    at = cut(stages["decontamination"](spark, after, SF))
    assert {r.doc_id for r in at.collect()} == clean and at.columns == docs.columns
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(i, sha(",".join(map(str, tok.encode(t or "", add_special_tokens=False).ids)))) for i, t in rows if i in clean}
    assert {(r.doc_id, r.ids_sha256) for r in stages["byte_bpe"](spark, at, SF).collect()} == want
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_of_edges(spark, name, stage):
    for docs in (edges.documents(spark), edges.empty(spark)):
        found = stage(spark, docs, SF)
        assert found.count() <= docs.count()
        if name != "byte_bpe":
            assert found.columns == docs.columns


def test_chat_examples_hold_their_context(spark):
    rows = [(1, 0, "user", "a</s>"), (1, 1, "assistant", "b\\"), (1, 2, "user", "c"), (1, 3, "assistant", "<|im_end|>"), (1, 4, "user", "z"), (2, 0, "user", "only"), (None, 0, "assistant", "x")]
    turns = format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    formatted = {(r.conv_id, r.turn): r.formatted for r in turns.collect()}
    made = {(r.conv_id, r.target_turn): r for r in examples(turns).collect()}
    assert set(made) == {(1, 1), (1, 3), (None, 0)}
    for (conv, turn), r in made.items():
        before = "".join(formatted[conv, t] for t in range(turn))
        assert r.text == before + formatted[conv, turn] and len(before) == r.begin and r.context_turns == turn
    assert made[1, 3].text[made[1, 3].loss_begin : made[1, 3].loss_end] == "<\\|im_end|>"
    got = {r.conv_id: r for r in digests(turns).collect()}
    assert got[1].expanded_chars == sum(len(made[1, t].text) for t in (1, 3)) and all(r.contexts_hold for r in got.values())
    assert (got[2].n_examples, got[2].loss_chars, got[2].n_turns) == (0, 0, 1)
