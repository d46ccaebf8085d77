"""The tree against the tokenizer library, whose vocabulary it reads."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolake.llm import bpe_tree, token_lengths

from . import cases

PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'ll", "é", "漢", "1", "22", "!", "?!", "\t", "\x1c", " ", "😀", "re", "l", "aaaa", "    ", "'r", "e", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return bpe_tree.TreeCodec.load()


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=bpe_tree.default_vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@pytest.mark.parametrize("leaf_chars, leaf_bytes", [(3, 4), (7, 8), (64, 16), (2048, 64)])
def test_random_texts(codec, library, monkeypatch, leaf_chars, leaf_bytes):
    monkeypatch.setattr(bpe_tree, "LEAF_CHARS", leaf_chars)
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", leaf_bytes)
    codec.cache.clear()
    r = random.Random(leaf_chars)
    for _ in range(800):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 60)))
        assert ids(codec, text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    codec.cache.clear()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=400))
def test_any_text(text):
    ((codec, library),) = _pair()
    assert ids(codec, text) == library.encode_ordinary(text)


_kept = []


def _pair():
    if not _kept:
        c = bpe_tree.TreeCodec.load()
        _kept.append((c, tiktoken.Encoding("own", pat_str=bpe_tree.default_vocabulary()[1], mergeable_ranks=c.ranks, special_tokens={})))
    return _kept


def test_long_matches(codec, library):
    for text in ("ab" * 20_000, "x" * 30_000 + " " * 5_000 + "y", "".join(random.Random(2).choice("thequickbrownfox") for _ in range(20_000))):
        assert ids(codec, text) == library.encode_ordinary(text)


def test_every_character_is_split_alike(codec, library):
    for c in range(0, 0x30000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}"
            assert ids(codec, text) == library.encode_ordinary(text)


def test_table(spark, library):
    docs = cases.documents(spark)
    got = sorted(tuple(r) for r in bpe_tree.round_trip(docs).na.fill(-1).collect())
    want = []
    for i, text, *_ in cases.rows():
        enc = library.encode_ordinary(text or "")
        want.append((-1 if i is None else i, len(enc), hashlib.sha256(np.array(enc, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_tree.round_trip(cases.empty(spark)).count() == 0


def test_lengths(spark, library, monkeypatch):
    monkeypatch.setattr(token_lengths, "SPAN", 8)
    n = sorted(len(library.encode_ordinary(t or "")) for _, t, *_ in cases.rows())
    got = {r.n_tokens: r for r in token_lengths.token_lengths(cases.documents(spark)).collect()}
    assert sorted(got) == sorted(set(n))
    for limit, r in got.items():
        assert (r.n_docs, r.docs_le, r.docs_gt) == (n.count(limit), sum(x <= limit for x in n), sum(x > limit for x in n))
        assert (r.tokens_le, r.tokens_gt) == (sum(x for x in n if x <= limit), sum(x for x in n if x > limit))
        assert r.truncated_total == sum(min(x, limit) for x in n) and r.lost_tokens == sum(n) - r.truncated_total and r.quantile == r.docs_le / len(n)
    assert token_lengths.token_lengths(cases.empty(spark)).count() == 0


def test_any_limit_and_quantile(spark):
    lengths = [0, 3, 3, 7, 10, 2000, 2000, 5000]
    rows = token_lengths.answers(token_lengths.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")))
    limits = [0, 2, 3, 5, 1999, 2000, 4999, 9999]
    for r in token_lengths.at_limits(rows, limits).collect():
        fit, cut = [n for n in lengths if n <= r.context], sum(min(n, r.context) for n in lengths)
        assert (r.docs_le, r.tokens_le, r.docs_gt, r.tokens_gt) == (len(fit), sum(fit), len(lengths) - len(fit), sum(lengths) - sum(fit))
        assert (r.truncated_total, r.lost_tokens) == (cut, sum(lengths) - cut)
    got = {r.share: r.n_tokens for r in token_lengths.at_quantiles(rows, [0.0, 0.125, 0.5, 0.51, 1.0]).collect()}
    assert got == {0.0: 0, 0.125: 0, 0.5: 7, 0.51: 10, 1.0: 5000}
    above = token_lengths.at_limits(rows.where("n_tokens > 0"), [0]).first()
    assert above.docs_le == 0
    none = rows.limit(0)
    assert token_lengths.at_limits(none, [5]).first().truncated_total == 0 and token_lengths.at_quantiles(none, [0.5]).first().n_tokens is None
