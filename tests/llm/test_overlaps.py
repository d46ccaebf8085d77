"""Near duplicates, line chunks and decontamination against brute force and SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolake.llm import chosen_path, components, decontaminate, line_chunks
from sonolake.llm.queries import ORACLES, QUERIES

from . import cases


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(n_shingles, component_id) by id, comparing all pairs."""
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(seed, size, most):
    """Copies of one text with up to `most` changed words."""
    r, base = random.Random(seed), cases.words(seed, 150).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = cases.words(r.random(), 1)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def crowd():
    texts = family(1, 60, 12) + family(2, 40, 4) + family(3, 25, 20) + [cases.words(i, 60) for i in range(100, 160)] + ["a b c d e", "A b c d e", "a b", "a b", "", " \n", None]
    order = random.Random(5).sample(range(1000), len(texts))
    return list(zip(order, texts))


@pytest.mark.parametrize("small, few, depth", [(6000, 256, 6), (8, 2, 4), (4, 1, 1)])
def test_near_duplicates(spark, crowd, small, few, depth):
    docs = spark.createDataFrame(crowd, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in cases.CLASHING})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.near_duplicates(docs, small, few, depth).collect()}
    assert got == brute(crowd)


def test_pairs_of_a_large_node_meet_in_small_ones(spark):
    """Texts x and y are alike, each with a nearer copy, and share first a large node, then a small one with a hub of its own."""
    rows, nodes = [], []

    def changed(w, *at):
        return [f"changed{i}" if i in at else x for i, x in enumerate(w)]

    for f in range(20):
        x, z = cases.words(f"x{f}", 200).split(), cases.words(f"z{f}", 200).split()
        y = changed(x, 20, 60, 100, 140, 180)
        for w in (x, changed(x, 40), y, changed(y, 160), *(changed(z, 10 + 20 * i) for i in range(4))):
            nodes.append((len(rows), [-1, 1000 + f]))
            rows.append((len(rows), " ".join(w)))
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("text", F.col("text").cast("binary"))
    members = spark.createDataFrame(nodes, "id long, nodes array<long>")
    label = chosen_path.linked(members, lambda ids: texts.join(ids, "id"), small=8, few=2)
    got = {r.id: r.component for r in label.collect()}
    assert {i: got.get(i, i) for i, _ in rows} == {i: root for i, (_, root) in brute(rows).items()}


def test_pairs_meet_at_every_depth():
    """The share of pairs of 0.75 that share a node if all their nodes branch, level after level: measured by the operator's own choices."""
    r = np.random.default_rng(2)
    every, roots, pairs = np.arange(chosen_path.WIDTH), np.array(chosen_path.ROOTS), []
    for _ in range(150):
        both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (150, 25, 25))
        pairs.append([(chosen_path.minwise(s, roots), (chosen_path.mix(chosen_path.minwise(s, every)) & np.uint64(255)).astype(np.uint8)) for s in (np.concatenate([both, a]), np.concatenate([both, b]))])
    met = [[{i: set(v.tolist()) for i, v in enumerate(roots_of.reshape(len(roots), 1))} for roots_of, _ in pair] for pair in pairs]
    shared = [[{(i, v) for i in x for v in x[i]} & {(i, v) for i in y for v in y[i]} for x, y in [m]][0] for m in met]
    assert np.mean([len(s) > 0 for s in shared]) == 1
    for _ in range(5):
        now = []
        for s, ((_, sig_a), (_, sig_b)) in zip(shared, pairs):
            node = np.array([chosen_path.mix(np.array([v], np.uint64) + np.uint64(i))[0] for i, v in sorted(s)], np.uint64)
            a, b = (chosen_path.children(node, np.tile(sig, (len(node), 1))) for sig in (sig_a, sig_b))
            now.append({(0, int(x)) for u, v in zip(a, b) for x, y in zip(u, v) if x == y})
        shared = [set(sorted(s)[:64]) for s in now]
        assert np.mean([len(s) > 0 for s in shared]) >= 0.99


def test_texts_under_one_id(spark):
    """Equal sets meet under whatever id, and the result does not depend on the order of rows."""
    a, b = cases.words("a", 40), cases.words("b", 40)
    rows = [(5, a), (5, b), (9, b), (8, a), (None, b), (None, "of its own here and there")]
    for order in (rows, rows[::-1]):
        got = sorted(map(repr, ((r.doc_id, r.component_id, r.kept) for r in chosen_path.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(2)).collect())))
        assert got == sorted(map(repr, [(5, 5, True), (5, 5, True), (9, 5, False), (8, 5, False), (None, 5, False), (None, None, False)]))


def test_near_duplicates_of_odd_rows(spark):
    got = chosen_path.near_duplicates(cases.documents(spark)).collect()
    assert len(got) == len(cases.rows())
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[3].component_id == 1 and by[8].component_id == 7 and not by[8].kept and by[9].kept
    assert all(by[i].component_id == i and by[i].n_shingles == 0 and by[i].kept for i in (4, 5, 6))
    assert by[None].component_id is None and not by[None].kept
    assert chosen_path.near_duplicates(cases.empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(random.Random(1).sample(chain, len(chain)), "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100, **{500 + i: 500 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def oracle(path, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'") if path != "/root/testdata/sf0.001" else con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    out = con.sql(ORACLES[name])
    return out.columns, sorted(map(repr, out.fetchall()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    columns, want = oracle(sf_dir, name)
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, sf_dir).select(*columns).collect()))) == want


def test_line_chunks(spark):
    docs = cases.documents(spark, clashing=False)
    out = line_chunks.remove(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs.columns, "removed_lines", "removed_chunks"] and out.count() == len(cases.rows())
    assert got[12].removed_lines == 0 and got[13].removed_lines >= 2
    lines = got[13].text.split("\n")
    assert lines[0] == cases.words(5, 80) and lines[-1] == cases.words(6, 80)
    assert got[4].text is None and got[5].text == "" and got[10].text == "x" * 30_000
    assert line_chunks.remove(cases.empty(spark)).count() == 0
    assert line_chunks.remove(cases.documents(spark)).count() == len(cases.rows())


def test_repeated_passages_go_wherever_they_stand(spark):
    passage = "\n".join(cases.words(1000 + i, 15) for i in range(12))
    docs = [(i, cases.words(i, 30) + "\n" + cases.words(i + 100, 9) + "\n" + passage + "\n" + cases.words(i + 200, 30)) for i in range(20)]
    got = {r.doc_id: r for r in line_chunks.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].removed_lines == 0 and all(got[i].removed_lines >= 8 for i in range(1, 20))
    assert all(cases.words(i, 30) in got[i].text and cases.words(i + 200, 30) in got[i].text for i in range(20))


@pytest.mark.parametrize("lines", [2, 3, 7])
def test_passages_between_lines_of_their_own_go_whole(spark, lines):
    """80 passages in two documents each: a text is always cut at their rims."""
    passage = lambda p: "\n".join(cases.words(f"p{lines} {p} {i}", 30) for i in range(lines))
    around = lambda d, side: "\n".join(cases.words(f"{side}{lines} {d} {i}", 12) for i in range(3))
    docs = [(d, "\n".join([around(d, "before"), passage(d % 80), around(d, "after")])) for d in range(160)]
    got = {r.doc_id: r for r in line_chunks.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[d].removed_lines == 0 for d in range(80)) and all(around(d, s) in got[d].text for d in got for s in ("before", "after"))
    assert all(got[d].removed_lines == lines for d in range(80, 160))


def test_recall_of_passages_in_passages(spark):
    """Passages between lines that repeat elsewhere too, so that stretches differ from text to text. What has to go is found by
    comparing pairs of neighbouring lines with all earlier texts, without any cut."""
    r = random.Random(11)
    pool = [cases.words(f"pool {i}", 20) for i in range(150)]
    docs = []
    for d in range(200):
        text = [cases.words(f"own {d} {i}", 9) for i in range(4)]
        for _ in range(2):
            start, size = r.randrange(140), r.randint(2, 9)
            at = r.randrange(len(text) + 1)
            text[at:at] = pool[start : start + size]
        docs.append((d, "\n".join(text)))
    got = {x.doc_id: x for x in line_chunks.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen, wanted, found = set(), 0, 0
    for d, text in docs:
        lines = text.split("\n")
        hit = {j for i, pair in enumerate(zip(lines, lines[1:])) if pair in seen for j in (i, i + 1)}
        seen |= set(zip(lines, lines[1:]))
        wanted += len(hit)
        found += min(len(hit), got[d].removed_lines)
        assert all(line in got[d].text for line in lines if line.count(" ") == 8)
    assert found >= 0.97 * wanted


def test_line_chunks_keep_columns_of_any_name(spark):
    passage = "\n".join(cases.words(f"q{i}", 15) for i in range(4))
    docs = spark.createDataFrame([(i, f"{cases.words(i, 9)}\n{passage}", "mine", 7) for i in range(3)], "doc_id long, text string, removed_lines string, doc int")
    assert line_chunks.cleaned(docs).columns == docs.columns and {x.removed_lines for x in line_chunks.cleaned(docs).collect()} == {"mine"}
    assert line_chunks.remove(docs).columns == ["doc_id", "text", "doc", "removed_lines", "removed_chunks"]


def leaky(spark):
    item, short = cases.words(70, 40), "just seven words are in this item"
    items = spark.createDataFrame([(1, item), (2, short), (3, "too short"), (4, None), (5, ""), (1, item)], "item_id long, text string")
    w = item.split()
    swapped = list(w)
    for i in range(5, 40, 9):
        swapped[i] = "other"
    docs = cases.rows() + [(100, f"{cases.words(1, 30)} {item} {cases.words(2, 30)}", "en", "a", 0), (101, " ".join(swapped).upper() + "!", "en", "a", 0), (102, " ".join(w[10:30]), "en", "a", 0), (103, f"x {short}, y", "en", "a", 0), (104, " ".join(w[:8]) + cases.words(3, 50), "en", "a", 0), (105, "too short", "en", "a", 0), (None, item, "en", "a", 0)]
    return spark.createDataFrame(docs, cases.COLUMNS).withColumns({c: F.lit("x") for c in cases.CLASHING}), items


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_decontamination(spark, broadcast_words):
    docs, items = leaky(spark)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items, broadcast_words).collect()}
    assert set(got) == {(100, 1), (101, 1), (102, 1), (103, 2), (None, 1)}
    assert got[100, 1].identity == 1 and got[101, 1].identity < 1 and got[103, 2].matched == 7
    assert decontaminate.contaminated(cases.empty(spark), items, broadcast_words).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0), broadcast_words).count() == 0


def test_substitutions_and_excerpts(spark):
    """Recall by how words are substituted, and the shortest excerpts that count, in the middle of texts."""
    items = [(i, cases.words(f"item {i}", 40).split()) for i in range(60)]
    r = random.Random(3)
    frame = lambda k, w: f"{cases.words(f'l{k}', 30)} {' '.join(w)} {cases.words(f'r{k}', 30)}"
    swap = lambda w, at: [f"other{j}" if j in at else x for j, x in enumerate(w)]
    ways = {
        "every fourth": lambda w: swap(w, range(r.randrange(4), 40, 4)),
        "every fifth": lambda w: swap(w, range(r.randrange(5), 40, 5)),
        "tenth": lambda w: swap(w, r.sample(range(40), 4)),
        "fifth": lambda w: swap(w, r.sample(range(40), 8)),
        "20 words": lambda w: w[10:30],
        "11 words": lambda w: w[14:25],
    }
    names = list(ways)
    docs = [(1000 * k + i, frame(f"{k} {i}", ways[name](w))) for k, name in enumerate(names) for i, w in items]
    known = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(x.doc_id // 1000, x.doc_id % 1000, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()}
    assert all(i == item for _, i, item in got)
    share = {name: sum(k == n for k, *_ in got) / len(items) for n, name in enumerate(names)}
    assert share["every fourth"] == share["every fifth"] == share["tenth"] == share["20 words"] == 1.0
    assert share["fifth"] >= 0.97 and share["11 words"] == 0


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_places_around_the_rims_of_segments(spark, broadcast_words):
    """An item at every place of a segment and the next ones, and items of 4 to 9 words that are whole texts."""
    item = cases.words("rim", 40)
    short = [(n, " ".join(f"short{n}q{i}" for i in range(n))) for n in range(4, 10)]
    docs = [(1000 + n, f"{cases.words(n, n)} {item} {cases.words(-n, 30)}") for n in range(decontaminate.STEP + 40)] + short
    got = {(r.doc_id, r.item_id, r.matched, r.identity) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), *short], "item_id long, text string"), broadcast_words).collect()}
    assert got == {(i, 1, 25, 1.0) for i, _ in docs[: -len(short)]} | {(n, n, n, 1.0) for n in range(5, 10)}


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_one_word_over_and_over(spark, broadcast_words):
    docs = spark.createDataFrame([(1, "again " * 3000), (2, "again " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "again " * 3000)], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contaminated(docs, items, broadcast_words).collect())) == [(1, 1, 25, 1.0), (2, 1, 20, 1.0)]


def test_windows_are_found_in_one_compiled_loop(spark):
    """Hashes, join and all between are one stage of generated code, in methods that the JVM compiles (8000 bytes), and words are found once."""
    items = spark.createDataFrame([(n, cases.words(f"size {n}", n)) for n in (5, 6, 7, 8, 40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, cases.words(1, 300))], "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (decontaminate.contaminated(docs, items), decontaminate.clean(docs, items)):
            execution = found._jdf.queryExecution()
            stages = spark._jvm.PythonSQLUtils.explainString(execution, "codegen").split("== Subtree ")[1:]
            plans = [(int((re.findall(r"maxMethodCodeSize:(\d+)", s) or [65536])[0]), re.sub(r"(?m)^[ :+-]*", "", s.split("Generated code:")[0])) for s in stages]
            joins = [(size, [line for line in plan.split("\n") if line.startswith(f"*({number})")]) for number, (size, plan) in enumerate(plans, 1)]
            [(size, loop)] = [(size, loop) for size, loop in joins if any("BroadcastHashJoin [key" in line for line in loop)]
            assert size < 8000 and sum("Generate " in line for line in loop) == 3
            assert execution.optimizedPlan().toString().count("regexp_extract_all") == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_clean(spark):
    docs, items = leaky(spark)
    left = decontaminate.clean(docs, items)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and {100, 101, 102, 103}.isdisjoint(ids) and len(ids) == docs.count() - 5
    assert ids.count(None) == 1  # the row without an id that holds no item
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()
