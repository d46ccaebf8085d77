"""Stages of the pipeline, each on its own, and run() against a brute-force version."""

import hashlib
import os

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sonolake import runtime
from sonolake.llm import bpe_tree, line_chunks

from . import cases
from .test_overlaps import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    item = cases.words(70, 40)
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in cases.rows() if i not in (None, 10)][:-1]
    rows += [(200, cases.words(200, 90) + " " + item, "en", "a", 0), (201, cases.words(201, 90), "en", "a", 0), (202, cases.words(201, 90) + " more", "en", "a", 0)]
    rows += [(300 + i, cases.words(300 + i, 80, a), lang, "s", 0) for i, (a, lang) in enumerate([("abcdefgh", "en"), ("äöüßé", "de")] * 6)]
    docs = spark.createDataFrame(rows, cases.COLUMNS)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    return cases.folder(spark, tmp_path_factory.mktemp("sf"), docs, benchmark=items)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.withColumns({c: F.lit("x") for c in cases.CLASHING}), docs.limit(0), cases.documents(spark)):
            out = stage(spark, given, folder)
            assert out.count() <= given.count()
            if name != "encoding":
                assert out.columns == given.columns and out.dtypes == given.dtypes


def test_rows_without_or_with_repeated_ids(spark, folder):
    text, other = cases.words("one", 60), cases.words("two", 60)
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 1), (None, text, "en", "a", 1), (None, other, "en", "a", 1), (None, other, "en", "b", 1), (4, None, "en", "a", 1)], cases.COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, text), (0, other), (4, "")])


def test_folders_are_freed(spark, folder):
    root = runtime.scratch_root(spark).removeprefix("file:") + "/sonolake/" + spark.sparkContext.applicationId
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    corpus_pipeline.run(spark, folder).count()
    made = set(os.listdir(root)) - before
    assert len(made) == 1 and made.pop().startswith("stage-decontamination")


def test_run(spark, folder):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    slim = {r.doc_id: r for r in line_chunks.remove(spark.createDataFrame(kept, cases.COLUMNS)).collect()}
    rows = [(i, r.text) for i, r in slim.items() if not r.removed_lines or r.text.strip()]
    roots = brute(rows)
    item = cases.words(70, 40)
    want = {i: t for i, t in rows if roots[i][1] == i and item not in t}
    assert set(got) == set(want) and 200 not in got and 202 not in got and 201 in got
    codec = bpe_tree.TreeCodec.load()
    library = tiktoken.Encoding("own", pat_str=bpe_tree.default_vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})
    for i, t in want.items():
        assert got[i].n_tokens == len(library.encode_ordinary(t)) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
