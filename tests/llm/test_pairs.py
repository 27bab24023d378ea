"""Operators on pairs, against brute force."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespring.llm import near_dedup, ngram_join
from lorespring.llm.common import CLEAN_UP, written
from lorespring.llm.components import components
from lorespring.llm.shingles import shingle_sets, texts_in_parts


def closed(ids, links):
    """The smallest id that each id reaches."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closed({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def test_shingle_sets_equal_brute_force(monkeypatch):
    import lorespring.llm.shingles as s

    monkeypatch.setattr(s, "SEGMENT", 64)  # words and texts cross segments
    rng = random.Random(9)
    words = ["a", "B", "b", "été", "x" * 150, "W0rd", "\u00a0", "日本"]
    texts = ["", " \n", "a", "A b", "x" * 500] + [
        rng.choice([" ", "", "\n"]).join([""] + [rng.choice(words) + rng.choice([" ", "\t\n", " "]) for _ in range(rng.randrange(60))])
        for _ in range(80)
    ]
    sets = []
    for a, b in texts_in_parts(texts, 1000):
        sets += shingle_sets(texts[a:b])
    assert len(sets) == len(texts)
    by_set = {}
    for text, got in zip(texts, sets, strict=True):
        want = frozenset(brute_shingles(text))
        assert len(got) == len(want) and (np.diff(got) > 0).all()
        assert by_set.setdefault(got.tobytes(), want) == want
    assert len(by_set) == len({frozenset(brute_shingles(t)) for t in texts})


def family(rng, base, n, most):
    """Copies of a text with up to ``most`` words changed."""
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(most + 1)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = text(60)
    texts = [" ".join(text(rng.randrange(1, 200))) for _ in range(80)]
    texts += [" ".join(text(rng.randrange(20, 200)) + shared + text(30)) for _ in range(60)]
    texts += family(rng, text(120), 90, 8) + family(rng, text(40), 40, 3) + [" ".join(text(50))] * 30
    texts += ["", None, " \t", "one two", "One  TWO", "three"]
    rng.shuffle(texts)
    return texts


def documents(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, set_id string, component string")


def brute_components(texts):
    sets = [brute_shingles(t) for t in texts]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    return sets, closed(range(len(texts)), links)


def test_overlap_matrix_equals_set_intersections():
    rng = random.Random(6)
    for n_a, n_b, items, dense in ((3, 4, 5, 256), (40, 30, 60, 256), (40, 30, 600, 4), (1, 1, 1, 1)):
        left, right = ([sorted(rng.sample(range(items), rng.randrange(1, 1 + min(items, 50)))) for _ in range(n)] for n in (n_a, n_b))
        places = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s)) for s in (left, right)]
        got = ngram_join.overlap_matrix(*places[0], *places[1], (n_a, n_b), items, dense)
        assert got.tolist() == [[len(set(x) & set(y)) for y in right] for x in left]


def test_texts_alike_but_not_enough_stay_apart_and_make_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)]
    for _ in range(150):
        ws = list(base)
        for at in rng.sample(range(10, 90), 4):
            ws[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(ws))
    _, want = brute_components(texts)
    rows = ngram_join.jaccard_components(documents(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_sets_that_clash_in_their_first_id_stay_apart(spark, monkeypatch):
    assert ngram_join._set_ids(np.arange(3))[0] != ngram_join._set_ids(np.arange(3))[1]
    one, two = ngram_join._set_ids(np.arange(3))
    assert ngram_join._set_ids(np.arange(3), frozenset([one])) == (two, two)


@pytest.mark.parametrize("frequent,block", [(32, 1024), (3, 12), (3, 40)])
def test_jaccard_components_equal_brute_force(spark, corpus, monkeypatch, frequent, block):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TASK_SHINGLES", 3000)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 200)
    monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", 700)
    monkeypatch.setattr(ngram_join, "BROADCAST_DOCS", 10 if frequent == 3 else 10**6)
    docs = documents(spark, corpus)
    sets, want = brute_components(corpus)
    rows = ngram_join.jaccard_components(docs.repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {
        i: (len(s), want[i]) for i, s in enumerate(sets)
    }
    assert len(set(want.values())) < len(want) - 100


@pytest.mark.parametrize("pairs,block", [(0, 1024), (2, 20)])
def test_groups_with_more_pairs_than_are_listed_meet_whole(spark, corpus, monkeypatch, pairs, block):
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    _, want = brute_components(corpus[:400])
    rows = ngram_join.jaccard_components(documents(spark, corpus[:400])).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_texts_that_share_a_little_with_many_are_not_fetched(spark, monkeypatch):
    """Each shares half of its shingles, but with every other text no more than one passage of 10 words."""
    n, fetched, real = 40, [], ngram_join._with_members
    passage = lambda i, j: " ".join(f"p{min(i, j)}x{max(i, j)}w{k}" for k in range(10))
    texts = [" ".join(f"{passage(i, j)} u{i}x{j}" for j in range(n) if j != i) for i in range(n)]
    texts.append(texts[0] + " and more words at the end")
    monkeypatch.setattr(ngram_join, "_with_members", lambda rows, *more: fetched.append(rows.count()) or real(rows, *more))
    rows = ngram_join.jaccard_components(documents(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i % n for i in range(n + 1)}
    assert sum(fetched) == 2


def test_a_step_that_is_written_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in blocks.getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before, setting = files(), spark.conf.get(CLEAN_UP)
    out = written(spark.range(5000).repartition(3).groupBy("id").count(), "cleaned")
    for _ in range(50):  # they are deleted in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert out.count() == 5000 and spark.conf.get(CLEAN_UP) == setting


def test_jaccard_keeps_one_of_each_group(spark, corpus):
    texts = corpus[:120]
    docs = documents(spark, texts).unionByName(documents(spark, texts[:3]))
    _, want = brute_components(texts)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    none = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(none).collect()} == {(None, None), (1, 1)}
    assert ngram_join.keep_first(docs.limit(0)).count() == 0


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(5, a), (3, a), (5, b), (9, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect()} == {(5, 3), (3, 3), (9, 3)}


def test_an_id_with_several_vectors_has_the_links_of_all(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT", 6)
    monkeypatch.setattr(near_dedup, "CELL", 3)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(6, 8))
    data = []
    for i in range(60):
        for _ in range(1 + int(rng.integers(0, 3)) * (i % 3 == 0)):
            p = points[int(rng.integers(0, 6))]
            data.append((i, (p + rng.normal(scale=0.05, size=8) * int(rng.integers(0, 2))).tolist(), int(rng.integers(0, 2))))
    data += [(3, None, 1), (3, data[0][1], None)]
    good = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in data if v is not None and k is not None]
    links = {(a, b) for a, x, k in good for b, y, m in good if a != b and k == m and x @ y >= 0.93}
    want = closed(range(60), links)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(got) == sorted((i, len({b for a, b in links if a == i}), want[i]) for i, _, _ in data)


@pytest.mark.parametrize("cell,block", [(1024, 1024), (10, 7)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    monkeypatch.setattr(near_dedup, "SPLIT", 2 * cell)
    monkeypatch.setattr(near_dedup, "CHUNK", 5 * cell)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    points = rng.normal(size=(60, 16))
    rows = []
    for p in points:
        for _ in range(int(rng.integers(1, 6))):
            rows.append((p + rng.normal(scale=0.12, size=16)).astype("float32").tolist())
    rows += [rows[0]] * 20 + [[2 * x for x in rows[1]]]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    data = [(i, v, i % 3 if i % 11 else None, "x") for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, weight string")
    ok = [
        v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i % 11 != 0
        for i, v in enumerate(rows)
    ]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for v, k in zip(rows, ok)]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if ok[i] and ok[j] and i % 3 == j % 3 and len(rows[i]) == len(rows[j]) and units[i] @ units[j] >= 0.93
    ]
    want = closed(range(len(rows)), links)
    n = {i: sum(i in p for p in links) for i in range(len(rows))}
    got = near_dedup.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        i: (n[i], want[i], want[i] == i) for i in range(len(rows))
    }
    assert len(got) == len(rows) and len(links) > 50
    twice = near_dedup.near_duplicates(df.unionByName(df)).distinct().collect()
    assert {(r.vec_id, r.n_links) for r in twice} == {(r.vec_id, r.n_links) for r in got}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    none = df.where("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long")).withColumn("label", F.lit(1))
    assert [(r.n_links, r.component_id, r.kept) for r in near_dedup.near_duplicates(none).collect()] == [(0, None, True)]
