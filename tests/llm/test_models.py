"""Lattice, language mixture, isolation forest and positive-unlabelled learning."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolake.llm import isolation_rules, language_mixture, pu_quality, unigram_lattice
from sonolake.llm.rule_stats import base_counts, rule_stats

from . import cases


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def test_lattice_sums_all_segmentations():
    r = np.random.default_rng(0)
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba", b" ab", b"bb", b"bab"]
    lattice = unigram_lattice.Lattice(pieces, np.zeros(len(pieces)))
    lattice.logp = np.log(r.dirichlet(np.ones(len(lattice.pieces))))
    p = dict(zip(lattice.pieces, np.exp(lattice.logp)))
    words = ["".join(w).encode() for n in range(1, 6) for w in itertools.product("ab", repeat=n)]
    expect = np.zeros(len(lattice.pieces))
    got = lattice.score(words, expect, np.ones(len(words)))
    want, counts = [], Counter()
    for w in words:
        raw, total, seen = b" " + w, 0.0, Counter()
        for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(raw)]
            parts = [raw[a:b] for a, b in zip(ends, ends[1:])]
            q = math.prod(p.get(x, 0.0) for x in parts)
            total += q
            for x in parts:
                seen[x] += q
        want.append(math.log(total))
        for x, q in seen.items():
            counts[x] += q / total
    assert np.allclose(got, want)
    assert np.allclose(expect, [counts[x] for x in lattice.pieces])
    scalar = np.zeros(len(lattice.pieces))
    assert np.allclose([lattice.scalar(b" " + w, scalar, 1.0) for w in words], want) and np.allclose(scalar, expect)


def test_lattice_scores(spark, monkeypatch):
    monkeypatch.setattr(unigram_lattice, "BLOCK_DOCS", 4)
    rows = [(i, t) for i, t, *_ in cases.rows()]
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    train = Counter(w for (i, _), ws in zip(rows, tokens) if crc(i, 5) != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted((-1 if i is None else i, crc(i, 5) == 1, len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, tokens))
    got = unigram_lattice.lattice_scores(cases.documents(spark)).na.fill(-1).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    assert unigram_lattice.lattice_scores(cases.empty(spark)).count() == 0


def segmentations(raw):
    for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(raw)]
        yield [raw[a:b] for a, b in zip(ends, ends[1:])]


def slow_model(words, ends, pieces, weights, passes):
    """Expectation-maximisation over all segmentations of all training tokens. words: bytes and their counts."""
    p = dict(zip(pieces, weights / weights.sum()))
    single = min(p.values()) * unigram_lattice.Lattice.SINGLE
    p |= {bytes([i]): single for i in range(256) if bytes([i]) not in p}
    whole = sum(p.values())
    start = p = {x: q / whole for x, q in p.items()}
    for _ in range(passes):
        n = {x: unigram_lattice.PRIOR * q for x, q in start.items()}
        for w, c in words.items():
            ways = [(parts, math.prod(p.get(x, 0.0) for x in parts)) for parts in segmentations(b" " + w)]
            total = sum(q for _, q in ways)
            for parts, q in ways:
                for x in parts:
                    if q:
                        n[x] += c * q / total
        total = sum(n.values()) + ends + 1
        p, end = {x: q / total for x, q in n.items()}, (ends + 1) / total
    return p, end


def test_lattice_scores_equal_brute_force(spark):
    """Every score that leaves lattice_scores, from a model fitted and summed over all segmentations."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join("".join(r.choice(list("abc"), r.integers(1, 6))) for _ in range(r.integers(0, 12)))) for i in range(40)] + [(100, None), (101, "")]
    pieces, weights = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba", b" ab", b"bb", b" cab"], r.dirichlet(np.ones(10))
    train = [t or "" for i, t in rows if crc(i, 5) != 1]
    p, end = slow_model(Counter(w.encode() for t in train for w in t.split()), len(train), pieces, weights, unigram_lattice.FIT_PASSES)
    got = {x.doc_id: x.score for x in unigram_lattice.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary=(pieces, weights)).collect()}
    for i, t in rows:
        want = math.log10(end) + sum(math.log10(sum(math.prod(p.get(x, 0.0) for x in parts) for parts in segmentations(b" " + w.encode()))) for w in (t or "").split())
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_piece_weights():
    p = np.array([0.5, 0.2, 0.3])
    assert np.allclose(unigram_lattice.piece_weights(np.log(p)), p)
    ranks = unigram_lattice.piece_weights(np.array([-2.0, 0.0, -1.0, -7.0]))
    assert np.allclose(ranks, np.array([1 / 12, 1 / 10, 1 / 11, 1 / 13]) / (1 / 10 + 1 / 11 + 1 / 12 + 1 / 13))


def test_lattice_is_a_distribution(spark):
    """All words together have no more than all probability."""
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in ((b"aa", 5), (b"ab", 1), (b"b", 2))], "word binary, c long")
    pieces, logp, end = unigram_lattice.fit(counts, 3, ([b" ", b"a", b"b", b" a", b"ab"], np.ones(5)))
    every = [bytes(w) for n in range(1, 9) for w in itertools.product(b"ab", repeat=n)]
    assert np.exp(unigram_lattice.Lattice(pieces, logp).score(every)).sum() + math.exp(end) < 1


def slow_languages(docs):
    """The model and the mixture in plain loops; docs: (id, text, lang). Gives {id: (language, proportion)}."""
    def grams(text):
        raw = (" " + text.lower() + " ").encode()
        raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in raw)
        for x, y, z in zip(raw, raw[1:], raw[2:]):
            if not (y == 32 and 32 in (x, z)):
                yield ((x << 16 | y << 8 | z) * 2654435761 & 0xFFFFFFFF) >> 16

    counts = {}
    for i, t, lang in docs:
        if lang is not None and t is not None and crc(i, 3) != 1:
            counts.setdefault(lang, Counter()).update(grams(t))
    langs = sorted(counts)
    p = lambda lang, g: (counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * 65536)
    out = {}
    for i, t, _ in docs:
        if t is None or not any(map(str.isalpha, t)):
            out[i] = ("und", 0.0)
            continue
        n = Counter(grams(t))
        total = sum(n.values())
        like = lambda pi: sum(c * math.log(sum(q * p(lang, g) for lang, q in pi.items())) for g, c in n.items())
        best = max(langs, key=lambda lang: (like({lang: 1.0}), -langs.index(lang)))
        pi, value = {best: 1.0}, like({best: 1.0})
        while len(pi) < len(langs):
            mix = {g: sum(q * p(lang, g) for lang, q in pi.items()) for g in n}
            gain = {lang: sum(c / mix[g] * p(lang, g) for g, c in n.items()) / total for lang in langs if lang not in pi}
            new = max(gain, key=gain.get)
            if gain[new] <= 1 + 1e-9:
                break
            trial = {lang: 0.9 * q for lang, q in pi.items()} | {new: 0.1}
            for _ in range(language_mixture.STEPS):
                mix = {g: sum(q * p(lang, g) for lang, q in trial.items()) for g in n}
                step = {lang: q * sum(c / mix[g] * p(lang, g) for g, c in n.items()) / total for lang, q in trial.items()}
                moved = max(abs(step[lang] - trial[lang]) for lang in trial)
                trial = step
                if moved < language_mixture.TOLERANCE:
                    break
            if like(trial) - value <= language_mixture.PENALTY * math.log(total) / 2:
                break
            pi, value = trial, like(trial)
        top = max(sorted(pi), key=pi.get)
        out[i] = (top, min(1.0, pi[top]))
    return out


def test_languages_equal_a_slow_version(spark):
    """The rows of the query, on texts of one language, of two, and of none."""
    docs = [(i, cases.words(i, 25, a), lang) for i, (a, lang) in enumerate([("abcdefgh", "en"), ("äöüßqrst", "de"), ("ijklmnop", "fr")] * 8)]
    docs += [(100 + i, cases.words(i, 30) + " " + cases.words(i + 50, 10 * i, "ijklmnop"), None) for i in range(4)] + [(200, None, "en"), (201, "12 !", None), (202, "é", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_mixture.identify(spark.createDataFrame([(*d, "s", 0) for d in docs], cases.COLUMNS)).collect()}
    for i, (lang, share) in slow_languages(docs).items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(share, abs=1e-6)


def test_languages(spark):
    docs = [(i, cases.words(i, 40, a), lang, "s", 0) for i, (a, lang) in enumerate([("abcdefgh", "en"), ("äöüßqrst", "de"), ("ijklmnop", "fr")] * 30)]
    docs += [(900, cases.words(900, 60) + " " + cases.words(901, 30, "ijklmnop"), None, "s", 0), (901, None, "en", "s", 0), (902, "123 !!", None, "s", 0), (903, "", None, "s", 0)]
    got = {r.doc_id: r for r in language_mixture.identify(spark.createDataFrame(docs, cases.COLUMNS)).collect()}
    for i, _, lang, *_ in docs[:90]:
        assert got[i].held_out == (crc(i, 3) == 1) and got[i].lang_pred == lang and got[i].score > 0.95
    assert got[900].languages == ["en", "fr"] and abs(got[900].score - 2 / 3) < 0.08
    assert {got[i].lang_pred for i in (901, 902, 903)} == {"und"} and {got[i].score for i in (901, 902, 903)} == {0.0}
    assert language_mixture.identify(cases.empty(spark)).count() == 0
    assert language_mixture.identify(cases.documents(spark)).count() == len(cases.rows())
    unlabelled = language_mixture.identify(spark.createDataFrame([(1, "text", None, "s", 1)], cases.COLUMNS)).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)


def test_mixture_finds_proportions():
    r = np.random.default_rng(3)
    p = r.dirichlet(np.full(300, 0.1), 3).T + 1e-6
    n = r.multinomial(3000, 0.7 * p[:, 0] / p[:, 0].sum() + 0.3 * p[:, 2] / p[:, 2].sum()).astype(float)
    pi = language_mixture.mixture(p[n > 0], n[n > 0])
    assert pi[1] == 0 and abs(pi[0] - 0.7) < 0.05 and abs(pi.sum() - 1) < 1e-9


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_rule_statistics(spark):
    texts = [t for _, t, *_ in cases.rows()] + ["a b c a b c", "a\n\na\n \n a\na", "# x * y", "a b c d a b c", "é é é é é"]
    for t in texts:
        assert base_counts((t or "").encode(), (t or "").encode().split()) == slow_counts(t)
    assert rule_stats(cases.documents(spark)).count() == len(cases.rows())


def with_junk(spark, every):
    """Documents of which every n-th has symbols in all words, and labels of half of them."""
    docs = [(i, cases.words(i, 120) if i % every else " ".join(w + "###" for w in cases.words(i, 120).split()), "en", "s", 0) for i in range(400)]
    labels = [(i, int(i % every != 0), 0) for i in range(0, 400, 2)] + [(7, None, 0), (None, 1, 0), (9999, 1, 0)]
    return spark.createDataFrame(docs, cases.COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    return with_junk(spark, 5)


def test_isolation(spark, labelled):
    got = {r.doc_id: r for r in isolation_rules.screen(*with_junk(spark, 20)).collect()}
    bad = [i for i in got if i % 20 == 0]
    assert sum(not got[i].kept for i in bad) >= 0.9 * len(bad) and sum(got[i].kept for i in got if i % 20) >= 0.95 * (400 - len(bad))
    _, labels = labelled
    odd = isolation_rules.screen(cases.documents(spark), labels).collect()
    assert len(odd) == len(cases.rows()) and all(r.base_failed and not r.kept for r in odd if r.n_words < 50)
    assert isolation_rules.screen(cases.empty(spark), labels).count() == 0
    free = isolation_rules.screen(labelled[0], labels.limit(0)).collect()
    assert all(r.kept for r in free if not r.base_failed)


def test_isolation_equals_a_slow_version(spark, labelled):
    """Verdicts from a walk down every tree for every document and a threshold tried bin by bin."""
    docs, labels = labelled
    rows = isolation_rules.screen(docs, labels, trees=20, sample=32).collect()
    x = {r.doc_id: np.array([math.log1p(r.n_words), r.word_chars / max(1, r.n_words), math.log1p(100 * r.n_symbols / max(1, r.word_chars)), math.log1p(r.n_dup_lines), r.n_repeat_words / max(1, r.n_words)]) for r in rows}
    stats = rule_stats(docs).select("doc_id", *isolation_rules.BASE, *isolation_rules.features())
    forest = isolation_rules.grow(isolation_rules.smallest_hashes(stats, 20 * 32).toPandas().to_numpy(float), 20, 32)

    def path(v, at):
        while forest["feature"][at] >= 0:
            at = forest["left"][at] if v[forest["feature"][at]] < forest["value"][at] else forest["right"][at]
        return forest["length"][at]

    anomaly = {i: 2.0 ** (-np.mean([path(v, root) for root in forest["roots"]]) / forest["norm"]) for i, v in x.items()}
    failed = {r.doc_id: r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words for r in rows}
    marks = [(r.doc_id, r.quality == 1) for r in labels.collect() if r.quality is not None and r.doc_id in x and not failed[r.doc_id]]
    best = (0.0, 2000)
    for cut in range(isolation_rules.BINS + 1):
        lost, caught = (np.mean([math.floor(anomaly[i] * 1000) >= cut for i, g in marks if g is good]) for good in (True, False))
        if lost <= isolation_rules.MAX_LOSS and caught - lost > best[0] + 1e-12:
            best = (caught - lost, cut)
    for r in rows:
        assert r.anomaly == pytest.approx(anomaly[r.doc_id], abs=1e-9) and r.base_failed == failed[r.doc_id]
        assert r.kept == (not failed[r.doc_id] and math.floor(anomaly[r.doc_id] * 1000) < best[1])


def test_isolation_paths():
    x = np.concatenate([np.random.default_rng(1).normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    a = isolation_rules.anomaly(isolation_rules.grow(x, 50, 128), x)
    assert a.argmax() == 500 and 0 < a.min() and a.max() < 1
    same = isolation_rules.anomaly(isolation_rules.grow(np.ones((10, 2)), 5, 8), np.ones((3, 2)))
    assert len(set(same.tolist())) == 1


def test_positive_unlabelled(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in pu_quality.classify(docs, labels).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].held_out == (crc(i, 5) == 0) for i in got)
    good, bad = ([got[i].score for i in held if bool(i % 5) is g] for g in (True, False))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([got[i].predicted == int(i % 5 != 0) for i in held]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert pu_quality.classify(cases.documents(spark), labels).count() == len(cases.rows())
    assert pu_quality.classify(cases.empty(spark), labels).count() == 0
    nothing = pu_quality.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in nothing] == [0.5]
    flipped = labels.withColumn("quality", F.when(F.col("quality") == 1, 1))
    assert {r.doc_id: r.score for r in pu_quality.classify(docs, flipped).collect()} != {}


def tagged(docs, labels):
    marks = labels.where("quality is not null")
    return pu_quality.feature_table(docs).join(marks, "doc_id", "left").select("x", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("positive"))


def risk(x, positive, w, prior):
    """The non-negative risk with its ridge, as the definition says; and the term that is clipped."""
    loss = lambda z: np.logaddexp(0, -z)
    p, u = x[positive] @ w, x[~positive] @ w
    second = loss(-u).mean() - prior * loss(-p).mean()
    ridge = np.full(len(w), pu_quality.RIDGE)
    ridge[-1] = 1e-8
    return prior * loss(p).mean() + max(0.0, second) + (ridge * w * w).sum() / 2, second


@pytest.mark.parametrize("prior", [0.4, 0.8, 0.95])
def test_non_negative_risk_is_minimised(spark, labelled, prior):
    """Against subgradient descent on the definition; at the larger priors the term is clipped."""
    rows = tagged(*labelled).cache()
    got = rows.toPandas()
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]).astype(float)
    positive = got["positive"].to_numpy(bool)
    mine, _ = risk(x, positive, pu_quality.fit(rows, prior, steps=60), prior)
    slow, least = np.zeros(x.shape[1]), np.inf
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(6000):
        p, u = x[positive], x[~positive]
        gradient = -prior * ((1 - sigmoid(p @ slow)) @ p) / len(p) + pu_quality.RIDGE * slow
        value, term = risk(x, positive, slow, prior)
        if term > 0:
            gradient = gradient + (sigmoid(u @ slow) @ u) / len(u) - prior * (sigmoid(p @ slow) @ p) / len(p)
        least = min(least, value)
        slow = slow - 3.0 / math.sqrt(1 + step / 50) * gradient
    assert mine <= least + 5e-3


def test_prior_from_positives_and_unlabelled_alone(spark):
    docs, labels = with_junk(spark, 4)
    found = pu_quality.estimate_prior(tagged(docs, labels.where("quality = 1 and doc_id < 150")))
    assert abs(found - 0.72) < 0.15
    u, p = np.zeros(10), np.zeros(10)
    u[9], u[0], p[9] = 300, 700, 1000
    assert pu_quality.prior_of(u * 100, p * 100) == pytest.approx(0.3, abs=1e-6)
