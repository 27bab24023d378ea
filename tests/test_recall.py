"""Searches within scopes, routes, verdicts, and neighbours whatever the blocks, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespring.operators import evidence, recall, store, vectors


def unit(rng, n, width=6):
    return rng.normal(size=(n, width)).round(3).tolist()


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 6)


@pytest.fixture(params=["broadcast", "groups", "tiny groups"])
def blocks(request, monkeypatch):
    """Both ways of bringing blocks together, and groups so small that every scope is cut."""
    if request.param != "broadcast":
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    if request.param == "tiny groups":
        for name, value in (("BLOCK_ROWS", 3), ("GROUP_BYTES", 200), ("BUCKET_ROWS", 10)):
            monkeypatch.setattr(vectors, name, value)


def test_scoped_neighbours_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    turns = [(c * 100 + t, c // 3, c, t, v) for c in range(9) for t, v in enumerate(unit(rng, 12))]
    asked = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 9)), i % 2, None if i % 3 == 0 else int(rng.integers(0, 13)), v) for i, v in enumerate(unit(rng, 40))]
    asked.append((99, None, 1, 0, None, [1.0] * 6))
    rows = spark.createDataFrame(turns, "id long, project long, conv_id long, turn long, vector array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, project long, current long, only int, before long, vector array<double>")
    found = vectors.nearest(
        queries, rows, 5, recall._rounded, within="project", admits=recall.admits, query_columns=["current", "only", "before"], row_columns=["conv_id", "turn"]
    )
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in found.collect())
    want = []
    for q, project, current, only, before, v in asked:
        inside = [
            (-cosine(v, w), i)
            for i, p, c, t, w in turns
            if p == project and (not only or c == current) and not (before is not None and c == current and t >= before)
        ]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(inside)[:5], 1)]
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_what_is_out_of_scope_takes_no_place(spark):
    """A hundred turns of another conversation say the very words, with the very vector, and still none is found."""
    near, far = [1.0, 0.0], [0.6, 0.8]
    turns = [(1000 + i, 0, 2, i, "blue harbour lights", near) for i in range(100)]
    turns += [(i, 0, 1, i, f"harbour number {i}", far) for i in range(8)] + [(9000, 1, 5, 0, "blue harbour lights", near)]
    rows = spark.createDataFrame(turns, "id long, project long, conv_id long, turn long, text string, vector array<double>")
    asked = [(1, "blue harbour lights", near, 0, 1, 1, 6), (2, "blue harbour lights", near, 0, 1, 0, 0), (3, "blue harbour lights", None, 1, 7, 0, None), (4, "blue", near, None, 1, 0, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string, vector array<double>, project long, current long, only int, before long")
    held = rows.select("id", "vector")
    got = recall.local_context(queries, rows.drop("vector"), held, 4).collect()
    of = lambda q: sorted(r.id for r in got if r.query_id == q)
    assert len(of(1)) == 4 and set(of(1)) <= set(range(6))
    assert set(of(2)) <= set(range(1000, 1100)) and len(of(2)) == 1  # the others repeat its text
    assert of(3) == [9000] and of(4) == []
    order = sorted((r.reading_rank, r.conv_id, r.turn) for r in got if r.query_id == 1)
    assert [x[1:] for x in order] == sorted(x[1:] for x in order)
    diverse = recall.local_context(queries, rows.drop("vector"), held, 3, diverse=True).where("query_id = 1")
    assert diverse.count() == 3 and recall.local_context(queries.limit(0), rows.drop("vector"), held, 4).count() == 0


def test_routes_go_by_latest_then_history(spark):
    e = lambda k: [float(i == k) for i in range(6)]
    mix = lambda a, b, s: [s * x + (1 - s * s) ** 0.5 * y for x, y in zip(e(a), e(b), strict=True)]
    snapshots = spark.createDataFrame(
        [(1, 10, 1, 1, e(0)), (1, 10, 2, 2, e(1)), (1, 11, 3, 1, mix(1, 2, 0.9)), (1, 12, 4, 1, e(0)), (2, 20, 5, 1, e(3))],
        "topic long, project long, id long, place int, vector array<double>",
    )
    summaries = spark.createDataFrame([(1, 10, 90, e(4)), (3, 30, 91, e(5))], "topic long, project long, id long, vector array<double>")
    mapping = spark.createDataFrame([(7, 20), (8, None)], "conv_id long, project long")
    asked = [
        (1, 7, 1, e(0)),  # known, whatever it asks
        (2, 8, 1, e(1)),  # project 10's latest
        (3, 9, 1, e(0)),  # 12's latest, though 10's history is as near
        (4, 9, 2, e(0)),  # nothing near
        (5, 9, 3, e(5)),  # by the summary of a project without snapshots
        (6, 9, 1, e(4)),  # 10 has snapshots, so its summary stands for nothing
        (7, 9, 4, e(0)),  # no such topic
        (8, 9, None, e(0)),
    ]
    queries = spark.createDataFrame(asked, "query_id long, current long, topic long, vector array<double>")
    got = {r.query_id: (r.stage, r.project, r.score and round(r.score, 3)) for r in recall.routed(queries, mapping, snapshots, summaries).collect()}
    none = {4: ("no_project", None, None), 6: ("no_project", None, None), 7: ("no_topic", None, None), 8: ("no_topic", None, None)}
    assert got == {1: ("known", 20, None), 2: ("latest", 10, 1.0), 3: ("latest", 12, 1.0), 5: ("latest", 30, 1.0)} | none
    strict = recall.routed(queries.where("query_id = 3"), mapping, snapshots, summaries, latest_floor=1.1).first()
    assert (strict.stage, strict.project) == ("history", 10)


def test_recall_ends_early_and_keeps_what_supports(spark):
    turns = spark.createDataFrame(
        [(1, 10, 1, 0, "the harbour at night"), (2, 10, 1, 1, "a far away thing"), (3, 11, 2, 0, "the harbour at night")],
        "id long, project long, conv_id long, turn long, text string",
    )
    held = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.1]), (3, [1.0, 0.0])], "id long, vector array<double>")
    mapping = spark.createDataFrame([(50, 10), (51, 12)], "conv_id long, project long")
    empty = spark.createDataFrame([], "topic long, project long, id long, place int, vector array<double>")
    asked = [(1, "harbour", [1.0, 0.0], 50, 1, None), (2, "harbour", [0.0, 1.0], 50, 1, None), (3, "harbour", [1.0, 0.0], 51, 1, None), (4, "harbour", [1.0, 0.0], 52, 1, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string, vector array<double>, current long, topic long, before long")
    rows = recall.recalled(queries, mapping, empty, empty.drop("place"), turns, held, 5).collect()
    got = sorted(((r.query_id, r.stage, r.verdict, r.id) for r in rows), key=str)
    assert got == [(1, "known", "FULL", 1), (2, "known", "NONE", None), (3, "known", None, None), (4, "no_topic", None, None)]


def test_best_between_cursors_looks_inwards_from_the_left(spark, blocks):
    rng = np.random.default_rng(5)
    shots = [(p, 100 * p + n, n, v) for p in range(3) for n, v in enumerate(rng.integers(-1, 2, size=(11, 2)).astype(float).tolist())]
    asked = [(i, int(rng.integers(0, 3)), int(a), int(b), v) for i, ((a, b), v) in enumerate(zip(rng.integers(0, 13, size=(60, 2)), rng.integers(-1, 2, size=(60, 2)).astype(float).tolist()))]
    rows = spark.createDataFrame(shots, "project long, id long, place long, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id long, project long, low long, high long, vector array<double>")
    got = {r.query_id: (r.place, r.score) for r in store.best_between(queries, rows).collect()}
    want = {}
    for q, project, low, high, v in asked:
        score = {n: round(float(vectors.cosine_scores(np.array([v]), np.array([w]))[0, 0]), 6) for p, _, n, w in shots if p == project}
        left, right, best = max(low, 0), min(high, max(score)), None
        while left <= right:
            for at in dict.fromkeys((left, right)):
                if best is None or score[at] > best[1]:
                    best = (at, score[at])
            left, right = left + 1, right - 1
        if best:
            want[q] = best
    assert got == want


def test_access_below_the_searches_still_fills_the_places(spark):
    rng = np.random.default_rng(1)
    docs = [(i, f"common words number {i} here") for i in range(300)]
    owners = spark.createDataFrame([(i, "other") for i in range(297)] + [(297, "me"), (298, "me"), (299, "me")], "doc_id long, owner string")
    frame = spark.createDataFrame(docs, "id long, text string")
    held = spark.createDataFrame([(i, v) for i, v in enumerate(unit(rng, 300))], "id long, vector array<double>")
    texts = spark.createDataFrame([(1, "common words")], "query_id long, text string")
    asked = spark.createDataFrame([(1, [1.0] * 6)], "query_id long, vector array<double>")
    below = store.hybrid(frame, held, texts, asked, 3, owners, "me", below=True).collect()
    assert sorted(r.id for r in below) == [297, 298, 299]
    after = store.hybrid(frame, held, texts, asked, 3, owners, "me").collect()
    assert {r.id for r in after} <= {297, 298, 299}
    assert store.hybrid(frame, held, texts, asked, 3, owners, None, below=True).count() == 0
    assert store.hybrid(frame, held, texts, asked, 3, owners.limit(0), None).count() == 3


def test_evidence_counts_once_and_is_capped_in_order_of_support(spark):
    held = [(i, [1.0, i / 10]) for i in range(14)] + [(50, [-1.0, 0.0])]
    hits = [(1, 0, i, 0.5, i + 1) for i in range(14)] + [(1, 1, 3, 0.9, 1), (1, 2, 3, 0.9, 1), (1, 1, 50, 1.0, 2), (1, 1, 77, 1.0, 3)]
    frame = spark.createDataFrame(hits, "query_id long, part int, id long, score double, rank int")
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, vector array<double>")
    found, told = evidence.verified_union(frame, spark.createDataFrame(held, "id long, vector array<double>"), questions)
    got = sorted((r["rank"], r.ref, r.id, r.part, r.score) for r in found.collect())
    assert [x[2] for x in got] == list(range(10)) and got[3] == (4, "G4", 3, 1, 0.9) and got[0][1] == "G1"
    assert sorted((r.query_id, r.verdict, r.n_passages) for r in told.collect()) == [(1, "FULL", 16), (2, "empty", 0)]


def test_widths_are_told(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0])], "id long, vector array<double>")
    queries = rows.where("id = 2").withColumnRenamed("id", "query_id")
    assert sorted(map(tuple, vectors.widths(queries, rows).collect()), key=str) == [(1, 0, 1), (2, 1, 1), (None, 0, 2)]
    assert [r.id for r in vectors.nearest(queries, rows, 9).collect()] == [2]
    assert vectors.nearest(queries, rows, 0).count() == 0


def test_no_vector_passes_the_driver(spark, monkeypatch):
    """Nothing of the queries is collected but their size."""
    rows = spark.range(50).select(F.col("id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"))
    queries = rows.where("id < 20").withColumnRenamed("id", "query_id")
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(rows), name, lambda *a, **k: pytest.fail("vectors on the driver"))
    assert vectors.nearest(queries, rows, 1).count() == 20


def test_a_product_of_full_blocks_takes_little_memory():
    import tracemalloc

    n = vectors.BLOCK_ROWS
    block = {"query_id": np.arange(n), "id": np.arange(n), "vectors": np.random.default_rng(1).random((n, 8))}
    tracemalloc.start()
    vectors._Best(5, vectors.cosine_scores, -1.0, None, None, None, None).add(b"q", block, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
