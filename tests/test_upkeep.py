"""Kept indexes, pages, labels, rules, plans and uploads against brute force."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lorespring.operators import constraints, jobs, lexical, tables
from lorespring.operators.constraints import check, foreign_key, primary_key, unique
from lorespring.operators.keyword_index import KeywordIndex
from lorespring.operators.vector_pages import VectorPages
from lorespring.plans import upload_queries
from lorespring.streaming import uploads


def test_kept_index_equals_one_built_at_once(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    index, held = KeywordIndex(spark, str(tmp_path / "index")), {}
    queries = spark.createDataFrame([(q, text() + " w1") for q in range(5)], "query_id long, text string")
    assert index.search(queries, 5).count() == 0
    for batch in range(4):
        new = {i: text() for i in range(batch * 20, batch * 20 + 30)}
        gone = rng.sample(sorted(held), min(len(held), 8)) + [10_000]
        for i in gone:
            held.pop(i, None)
        added = index.sync(frame(new | {batch * 20: None}), ids(gone))
        fresh = {i: t for i, t in (new | {batch * 20: None}).items() if i not in held}
        assert added == len(fresh)
        held |= fresh
        want = lexical.bm25(frame(held), queries, 7)
        for built in (index, index.compacted(str(tmp_path / f"compact{batch}"))):
            got = built.search(queries, 7)
            assert sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in got.collect()) == sorted(
                (r.query_id, r["rank"], r.id, round(r.score, 7)) for r in want.collect()
            )
    assert index.sync(frame(held)) == 0 and index.last_batch() == 5
    # A batch that broke off before its totals counts for nothing, and the next writes over it.
    before = sorted(map(tuple, index.search(queries, 7).collect()))
    spark.createDataFrame([("w1", 99_999, 50, 50)], "term string, id long, tf long, length int").write.parquet(f"{index.path}/postings/batch=6")
    assert sorted(map(tuple, index.search(queries, 7).collect())) == before
    index.sync(frame({70_000: "unheard of"}))
    assert index.live("postings").where("id = 99999").isEmpty() and index.live("postings").where("id = 70000").count() == 2


def test_kept_turn_index_goes_by_watermark(spark, tmp_path):
    turns = [(c * 10 + t, c, t, f"turn {t} of {c}") for c in range(3) for t in range(5)]
    frame = spark.createDataFrame(turns, "id long, conv_id long, turn long, text string")
    index = KeywordIndex(spark, str(tmp_path / "turns"))
    assert index.sync_turns(frame.where("turn < 2 or conv_id = 2")) == 9
    late = spark.createDataFrame([(21_000, 2, 1, "too late")], frame.schema)
    assert index.sync_turns(frame.unionByName(late)) == 6
    assert sorted(map(tuple, index.watermarks().collect())) == [(0, 4), (1, 4), (2, 4)]
    assert index.live("texts").count() == 15 and index.sync_turns(frame) == 0


def test_pages_go_on_after_a_stop(spark, tmp_path):
    labels = spark.createDataFrame([(n * 3, n) for n in range(50)], "label long, vector_id long")
    vectors = spark.createDataFrame([(n, [float(n)]) for n in range(50) if n % 4 and not 20 <= n < 30], "vector_id long, vector array<float>")
    whole = VectorPages(spark, str(tmp_path / "whole"), 7)
    assert whole.read(labels, vectors) == 8 and whole.pending(labels) == 0
    broken = VectorPages(spark, str(tmp_path / "broken"), 7)

    def stop(page):
        if page == 4:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        broken.read(labels, vectors, each=stop)
    assert broken.pending(labels) == 50 - 21 and broken.rows().where("page > 3").isEmpty()
    assert broken.read(labels, vectors, most=2) == 2 and broken.read(labels, vectors) == 3
    for of in (lambda p: p.rows().drop("vector"), lambda p: p.state()):
        assert sorted(map(tuple, of(broken).collect())) == sorted(map(tuple, of(whole).collect()))
    sums = whole.state().agg(F.sum("n_kept"), F.sum("n_missing"), F.max("through")).first()
    assert tuple(sums) == (30, 20, 147)
    # A vector that comes late is not looked for again; labels behind the watermark are.
    more = labels.unionByName(spark.createDataFrame([(500, 1)], labels.schema))
    assert whole.read(more, vectors.unionByName(spark.createDataFrame([(0, [0.0])], vectors.schema))) == 1
    assert whole.rows().count() == 31


def requests_decided(asked, stored):
    by_chunk, by_vector = {c: (label, v, m) for label, v, c, m in stored}, {v: label for label, v, c, m in stored}
    top, out = max([0, *by_vector.values()]), []
    for pos, v, c, m in sorted(asked, key=lambda r: r[0]):
        if v is None or v < 0 or c is None:
            out.append((pos, None, "malformed"))
        elif c not in by_chunk and v not in by_vector:
            top += 1
            by_chunk[c], by_vector[v] = (top, v, m), top
            out.append((pos, top, "created"))
        elif c in by_chunk and by_chunk[c][1] == v:
            out.append((pos, by_chunk[c][0], "same" if by_chunk[c][2] == m else "other_model"))
        else:
            out.append((pos, None, "conflict"))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_label_requests_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    stored = [(n, n, f"c{n}", "ab"[n % 2]) for n in range(0, 8)]
    asked = [(n * 3, rng.choice([*range(16), None, -1]), rng.choice([*(f"c{i}" for i in range(16)), None]), rng.choice("ab")) for n in range(120)]
    asked += [(1000 + n, 40 + (n + 1) // 2, f"d{n // 2}", "a") for n in range(20)]  # a chain, each at odds with the one before
    frame = spark.createDataFrame(asked, "pos long, vector_id long, chunk_id string, model string").repartition(3)
    labels = spark.createDataFrame(stored, "label long, vector_id long, chunk_id string, model string")
    first = tables.merged_labels(frame, labels)
    assert sorted((r.pos, r.label, r.verdict) for r in first.collect()) == requests_decided(asked, stored)
    made = first.where("verdict = 'created'").select("label", "vector_id", "chunk_id", "model")
    again = {r.verdict for r in tables.merged_labels(frame, labels.unionByName(made)).collect()}
    assert "created" not in again and "same" in again
    assert tables.merged_labels(frame.limit(0), labels).count() == 0


def test_rules_count_what_breaks_them_in_one_scan_a_table(spark, tmp_path):
    child = [(1, 1, "user", "t"), (2, 1, "boss", "f"), (2, 9, None, "t"), (None, None, "user", "t"), (3, 1, "user", "t")]
    data = {"parent": [(1, "a"), (1, "b"), (None, "c"), (2, " ")], "child": child}
    schema = {"parent": "id long, name string", "child": "id long, parent long, role string, active string"}
    frames = {}
    for name, rows in data.items():
        spark.createDataFrame(rows, schema[name]).write.parquet(str(tmp_path / name))
        frames[name] = spark.read.parquet(str(tmp_path / name))
    rules = (
        primary_key("parent", "id"),
        check("parent", "trim(name) <> ''"),
        primary_key("child", "id"),
        foreign_key("child", ("parent",), "parent", ("id",)),
        check("child", "role in ('user', 'system')"),
        unique("child", "parent", where="active = 't'"),
        unique("parent", "id", "name"),
    )
    found = constraints.violations(frames, rules)
    want = {"parent primary key": 2, "parent check trim(name) <> ''": 1, "child primary key": 2, "child parent in parent": 1}
    want |= {"child check role in ('user', 'system')": 1, "child unique parent where active = 't'": 1, "parent unique id, name": 0}
    assert dict(map(tuple, found.collect())) == want
    keys = {(r.rule, r.key) for r in constraints.violations(frames, rules, keys=True).collect()}
    assert ("child parent in parent", '["9"]') in keys and ("child primary key", '["2"]') in keys
    plan = constraints.violations(frames, rules, keys=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Join" not in plan
    assert {r.rule for r in constraints.broken_rules(frames, rules).collect()} == {k for k, n in want.items() if n}


def test_store_rules_fit_their_stores(spark):
    columns = {}
    for r in constraints.STORE_RULES:
        columns.setdefault(r.table, set()).update(r.unique + r.references)
        if r.parent:
            columns.setdefault(r.parent, set()).update(r.columns)
    more = {"turns": {"role"}, "mappings": {"topic_id"}, "exchanges": {"response", "answered_at"}, "conversations": {"name"}, "topics": {"is_active"}}
    frames = {t: spark.createDataFrame([], ", ".join(f"{c} string" for c in sorted(cs | more.get(t, set())))) for t, cs in columns.items()}
    topics = [("1", "a", "t"), ("2", "a", "f"), ("3", "a", "f")]
    frames["topics"] = spark.createDataFrame(topics, "topic_id string, topic_name string, is_active string")
    assert {r.n_rows for r in constraints.violations(frames, constraints.STORE_RULES).collect()} == {0}
    mapped = [("c1", None, "9"), ("c2", "1", "1")]
    frames["mappings"] = spark.createDataFrame(mapped, "conversation_id string, topic_id string, project_id string")
    broken = {r.rule for r in constraints.broken_rules(frames, constraints.STORE_RULES).collect()}
    assert broken == {"mappings project_id in projects", "mappings check (topic_id is null) = (project_id is null)"}


def plan_told(rows, needs):
    """Verdicts by walking the graph from each job."""
    names, out = set(), {}
    firsts = {}
    for name, place in sorted(rows, key=lambda r: r[1]):
        verdict = "empty" if name is None or not name.strip() else "duplicate" if name in firsts else None
        if verdict is None:
            firsts[name] = place
        out[place] = (name, verdict)
    names = set(firsts)
    edges = {n: {d for i, d in needs if i == n} for n in names}

    def reach(start, graph):
        seen, todo = set(), list(graph.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += graph.get(x, ())
        return seen

    inner = {n: {d for d in ds if d != n and d in names} for n, ds in edges.items()}
    above = {n: {m for m in names if n in inner[m]} for n in names}
    loops = {n for n in names if n in reach(n, inner)}
    core = {n for n in names if (n in loops or reach(n, inner) & loops) and (n in loops or reach(n, above) & loops)}
    bad = {n for n in names if n in edges[n] or edges[n] - names}
    stuck = {n for n in names if n in bad | core or reach(n, inner) & (bad | core)}
    level = {}

    def height(n):
        if n not in level:
            level[n] = 1 + max((height(d) for d in edges[n]), default=-1)
        return level[n]

    told = []
    for place, (name, verdict) in out.items():
        if verdict is None:
            verdict = "self" if name in edges[name] else "unknown" if edges[name] - names else "cycle" if name in core else "blocked" if name in stuck else "ok"
        told.append([name, place, verdict, height(name) if verdict == "ok" else None])
    order = sorted((t for t in told if t[2] == "ok"), key=lambda t: (t[3], t[1]))
    return {tuple(t) + ((order.index(t) + 1) if t in order else None,) for t in told}


@pytest.mark.parametrize("seed", range(3))
def test_plans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 25
    rows = [(f"j{i}", i) for i in range(n)] + [("j3", 100), (" ", 101), (None, 102)]
    needs = [(f"j{i}", f"j{rng.randrange(i)}") for i in range(1, n) for _ in range(rng.randrange(3))]
    needs += [(f"j{rng.randrange(n)}", f"j{rng.randrange(n)}") for _ in range(2 + seed)] + [("j5", "j5"), ("j9", "gone"), ("ghost", "j1")]
    frame = spark.createDataFrame(rows, "id string, place long")
    got = {tuple(r) for r in jobs.checked_plan(frame, spark.createDataFrame(needs, "id string, needs string")).collect()}
    assert got == plan_told(rows, needs)


def test_dependents_are_told_equal_shares(spark):
    log = [("a", 1, "accept", "x" * 500), ("b", 1, "accept", "y" * 100), ("c", 1, "accept", "old"), ("c", 2, "retract", None), ("d", 1, "retract", None), ("d", 2, "accept", "M2 G10 G2 Z9 M2")]
    results = jobs.accepted(spark.createDataFrame(log, "id string, at int, kind string, output string"))
    needs = spark.createDataFrame([("j", x) for x in "abc"] + [("k", x) for x in "abd"] + [("l", "c")], "id string, needs string")
    got = {(r.id, r.needs): r.text for r in jobs.dependency_context(needs, results, 600).collect()}
    assert got == {
        ("j", "a"): "x" * 300 + "…[truncated]",
        ("j", "b"): "y" * 100,
        ("k", "a"): "x" * 200 + "…[truncated]",
        ("k", "b"): "y" * 100,
        ("k", "d"): "M2 G10 G2 Z9 M2",
    }
    evidence = spark.createDataFrame([("G2", 1), ("G10", 2), ("M2", 3), ("M3", 4)], "ref string, item int")
    assert [r.ref for r in jobs.cited_evidence(results, evidence).orderBy("place").collect()] == ["G2", "G10", "M2"]


START = datetime(2024, 1, 1)


def pieces_of(upload, files, minute=0, damaged=()):
    rows = [("header", len(files), None, None, None)]
    for i, content in enumerate(files):
        rows.append(("start", i, f"f{i}.txt", None, None))
        rows += [("chunk", i, None, content[k : k + 4], None) for k in range(0, len(content), 4)]
        rows.append(("end", i, None, None, hashlib.sha256(content + b"!" * (i in damaged)).hexdigest()))
    return [(upload, n, *r, START + timedelta(minutes=minute)) for n, r in enumerate(rows)]


def test_uploads_in_pieces(spark, tmp_path):
    good, half = [b"hello world", b"", b"third file"], [b"one", b"two two two"]
    all_of = {
        1: pieces_of(1, good),
        2: pieces_of(2, half, damaged={1}),
        3: [p for p in pieces_of(3, half) if p[1] != 4],  # a piece is lost
        4: pieces_of(4, [b"x" * 40]),  # a file beyond the limit
        5: pieces_of(5, [b"y" * 30, b"z" * 30, b"w" * 30]),  # an upload beyond the limit
        6: [(*p[:3], 1, *p[4:]) if p[2] == "start" else p for p in pieces_of(6, [b"a"])],  # files out of order
        7: [(7, 0, "header", 0, None, None, None, START)],
        8: pieces_of(8, [b"late"], minute=300),
    }
    pieces = [p for ps in all_of.values() for p in ps] + all_of[1][1:6] + all_of[2]
    random.Random(1).shuffle(pieces)
    source, target = str(tmp_path / "pieces"), str(tmp_path / "out")
    for n in range(3):  # three micro-batches; the last upload comes when the others' time is over
        part = [p for i, p in enumerate(pieces) if i % 2 == n and p[0] != 8] if n < 2 else all_of[8]
        spark.createDataFrame(part, uploads.PIECE).coalesce(1).write.mode("append").parquet(source)
        uploads.assemble_files(spark, source, target, str(tmp_path / "state"), uploads.Limits(3, 32, 80, 3600))
    rows = spark.read.schema(uploads.RESULT).parquet(target).collect()
    files = {(r.upload_id, r.file_index): (r.status, r.code, r.content and bytes(r.content)) for r in rows if r.file_index is not None}
    ends = {r.upload_id: (r.status, r.code) for r in rows if r.file_index is None}
    assert len(files) + len(ends) == len(rows)
    for i, content in enumerate(good):
        assert files[1, i][:2] == ("ACCEPTED", None) and (files[1, i][2] or b"") == content
    assert files[2, 0][0] == "ACCEPTED" and files[2, 1] == ("REJECTED", "CHECKSUM_MISMATCH", None)
    assert files[3, 0][2] == b"one" and (3, 1) not in files and files[4, 0][:2] == ("REJECTED", "TOO_LARGE")
    assert ends == {
        1: ("COMPLETED", None), 2: ("PARTIAL", None), 3: ("FAILED", "INCOMPLETE"), 4: ("FAILED", None), 5: ("FAILED", "TOO_LARGE"),
        6: ("FAILED", "INVALID_REQUEST"), 7: ("FAILED", "INVALID_REQUEST"), 8: ("COMPLETED", None),
    }


class Kept:
    """State of one upload in memory, which counts its calls."""

    def __init__(self, calls, value=None):
        self.calls, self.value, self.of = calls, value, {}

    def __getattr__(self, name):
        acts = {
            "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: (setattr(self, "value", None), self.of.clear()),
            "getValue": lambda k: self.of.get(k), "updateValue": lambda k, v: self.of.update({k: v}), "removeKey": lambda k: self.of.pop(k, None),
            "exists": lambda: self.value is not None, "containsKey": lambda k: k in self.of, "listTimers": lambda: iter(list(self.of)),
            "registerTimer": lambda t: self.of.update({t: True}), "deleteTimer": lambda t: self.of.pop(t, None),
            "getValueState": lambda *_: Kept(self.calls), "getMapState": lambda *_: Kept(self.calls),
        }
        return lambda *a: (self.calls.append(name), acts[name](*a))[1]


@pytest.mark.parametrize("apart,held", [(64 << 10, 8 << 20), (3, 8 << 20), (64 << 10, 5), (3, 5)])
def test_calls_to_state_do_not_grow_with_the_pieces(monkeypatch, apart, held):
    monkeypatch.setattr(uploads, "APART", apart)
    monkeypatch.setattr(uploads, "HELD", held)
    rng, calls = random.Random(4), []
    files = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 700, 3, 90)]
    columns = [f.split()[0] for f in uploads.PIECE.split(", ")]
    pieces = [Row(*columns)(*p) for p in pieces_of(9, files, damaged={2})]
    pieces = pieces + pieces[5:60]
    rng.shuffle(pieces)
    assembly = uploads.Assembly(uploads.Limits())
    assembly.init(Kept(calls))
    out, cut = [], len(pieces) // 3
    for batch in (pieces[:cut], pieces[cut : 2 * cut], pieces[2 * cut :]):
        calls.clear()
        out += assembly.handleInputRows((9,), iter(batch), None)
        assert len(calls) <= 14 or min(apart, held) < 10
    assert [(r.file_index, r.status, r.content) for r in out] == [
        (0, "ACCEPTED", files[0]), (1, "ACCEPTED", files[1]), (2, "REJECTED", None), (3, "ACCEPTED", files[3]), (None, "PARTIAL", None)
    ]
    assert not any(m.of for m in (assembly.early, assembly.large, assembly.chunks))
    assert list(assembly.handle.of) == [int(START.timestamp() * 1000)]
    assert not list(assembly.handleExpiredTimer((9,), None, None)) and assembly.progress.value is None


def test_small_pages_share_their_jobs(spark, tmp_path):
    labels = spark.range(400).select(F.col("id").alias("label"), F.col("id").alias("vector_id"))
    vectors = labels.where("vector_id % 3 > 0").select("vector_id", F.array(F.col("vector_id").cast("float")).alias("vector"))
    jobs = []
    for size in (200, 2):
        spark.sparkContext.setJobGroup(f"pages of {size}", "")
        pages = VectorPages(spark, str(tmp_path / f"pages{size}"), size)
        assert pages.read(labels, vectors) == 400 // size and pages.rows().count() == 266
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pages of {size}")))
    assert sorted(r.through for r in pages.state().collect()) == list(range(1, 400, 2))
    assert jobs[1] <= jobs[0] + 2


def test_upload_pieces_lie_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * 600) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    runs = []
    monkeypatch.setattr(upload_queries, "FILE_BYTES", 20_000)
    monkeypatch.setattr(uploads, "assemble_files", lambda spark, source, target, *rest, **kinds: (runs.append((source, kinds)), spark.range(0).write.mode("overwrite").parquet(target)))
    upload_queries.uploads_in_pieces(spark, str(tmp_path))
    source, kinds = runs[0]
    files = spark.read.schema(uploads.PIECE).parquet(source).where("at < timestamp_seconds(1700050000)").groupBy(F.input_file_name()).agg(F.sum(F.length("data")).alias("n")).collect()
    assert kinds["files_a_batch"] >= 4 and len(files) > 6 and max(r.n or 0 for r in files) < 80_000
