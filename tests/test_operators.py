"""What SQL can't express, against brute force, invariants and worked examples."""

import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import acquisition, chunking, lexical, memory, retrieval, screening, tables, vectors
from lorespring.plans import QUERIES
from lorespring.sources import files, generations
from lorespring.streaming import sync


@pytest.mark.parametrize("size,overlap", [(256, 20), (10, 0), (10, 9), (1, 0)])
def test_windows_keep_their_rule(size, overlap):
    rng = random.Random(size + overlap)
    for _ in range(200):
        text = "".join(rng.choice("ab \n é") for _ in range(rng.randrange(60)))
        spans = chunking.windows(text, size, overlap)
        covered = set()
        for i, (a, b) in enumerate(spans):
            assert 0 < b - a <= size and not text[a].isspace()
            if b < len(text) and any(c.isspace() for c in text[a + 1 : b]):
                assert text[b].isspace()
            if i:
                assert a > spans[i - 1][0] and a >= max(spans[i - 1][1] - overlap, spans[i - 1][0] + 1)
            covered |= set(range(a, b))
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    with pytest.raises(ValueError):
        chunking.check_window(10, 10)


def test_windows_of_a_worked_example():
    assert chunking.windows("aaa bbb ccc ddd", 8, 3) == [(0, 7), (4, 11), (8, 15)]
    assert chunking.windows("abcdefghij", 4, 1) == [(0, 4), (3, 7), (6, 10)]


def test_recursive_spans_keep_their_rule():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb", " ", ". ", "\n", "\n\n", ", "]) for _ in range(rng.randrange(80)))
        spans = chunking.recursive_spans(text, 20, 5)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a <= c and b <= d and b - c <= 5
        assert all(0 < b - a <= 20 and text[a:b].strip() for a, b in spans)
        plain = chunking.recursive_spans(text, 20, 0)
        covered = {i for a, b in plain for i in range(a, b)}
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert chunking.recursive_spans("one two. three four. five", 12, 0) == [(0, 9), (9, 21), (21, 25)]


def test_hierarchical_chunks_are_where_they_say(spark):
    text = "intro\n\n# One\nfirst para\n  goes on\n\nsecond é para\n\n```\n# not a heading\n```\nTitle\n=====\nbody of title\n2. Numbered\n\n"
    flat = "just some words\nwithout a heading"
    df = spark.createDataFrame([(1, text), (2, flat), (3, ""), (4, None)], "id long, text string")
    parts = {(r.id, r.name): r.text for r in chunking.sections(df, "id").collect()}
    assert parts[1, "PREAMBLE"] == "intro" and parts[1, "Title"] == "body of title" and parts[2, "MAIN"] == flat
    assert "# not a heading" in parts[1, "One"] and (1, "2. Numbered") not in parts
    rows = chunking.hierarchical_chunks(df, "id", 12, 3).collect()
    for r in rows:
        assert (text if r.id == 1 else flat)[r.start : r.end] == r.chunk and len(r.chunk) <= 12
    contexts = chunking.contexts(chunking.sections(df, "id"), "id").where("id = 1 and name = 'One'").orderBy("context").collect()
    assert [c.text for c in contexts][:2] == ["first para\n  goes on", "second é para"]
    kinds = {(r.id, r.kind) for r in chunking.chunks(df, "id").select("id", "kind").distinct().collect()}
    assert kinds == {(1, "hierarchical"), (2, "recursive")}


def test_chunk_ids_are_unique_where_texts_repeat(spark):
    df = spark.createDataFrame([(1, "same words " * 60), (2, "same words " * 60)], "id long, text string")
    rows = chunking.window_chunks(df, "id", 22, 0).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) > len({r.chunk for r in rows})


@pytest.mark.parametrize(
    "word,want",
    [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"),
     ("adjustable", "adjust"), ("controll", "control"), ("rate", "rate"), ("agreed", "agre"), ("sky", "sky"), ("filing", "file")],
)
def test_porter_stems(word, want):
    assert lexical.stem(word) == want


def test_stemmed_search_folds_endings_and_accents(spark):
    df = spark.createDataFrame([(1, "Cafés opening"), (2, "other things"), (3, "opened cafe")], "id long, text string")
    q = spark.createDataFrame([(7, "open cafe")], "query_id long, text string")
    assert {r.id for r in lexical.bm25(df, q, stemming=True).collect()} == {1, 3}
    assert {r.id for r in lexical.bm25(df, q).collect()} == {3}


@pytest.mark.parametrize("name", ["bm25_stemmed", "bm25_top_k"])
def test_search_takes_every_term_of_a_long_query(spark, tmp_path, name):
    asked = " ".join(f"w{i}" for i in range(60))
    documents = [(1, "nothing of it"), (2, "w59 alone"), (3, "w0 alone"), (4, "w31 w32")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, asked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.id: r.score for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(found) == {2, 3, 4} and found[2] == found[3] > found[4]


def test_postings_are_counted_text_by_text(spark, monkeypatch):
    rows = [(1, "b a b"), (2, None), (3, "a"), (3, "a c"), (4, ""), (None, "z"), (None, "z z")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.term, r.id): r.tf for r in lexical.postings(df).collect()}
    assert got == {("a", 1): 1, ("b", 1): 2, ("a", 3): 2, ("c", 3): 1, ("z", None): 3}
    whole = lexical.postings(df.where("id < 3"))
    assert "Aggregate" not in whole._jdf.queryExecution().executedPlan().toString()
    q = spark.createDataFrame([(7, "a b"), (8, "b c a")], "query_id long, text string")
    found = lambda: sorted((r.query_id, r.id, round(r.score, 9), r.rank) for r in lexical.bm25(df, q, 2).collect())
    want = found()
    monkeypatch.setattr(lexical, "TASK_HITS", 2)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    assert found() == want and len(want) == 3


def test_cosine_of_zero_vectors_is_minus_one(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [-1.0, 1.0]
    assert vectors.cosine_scores(np.zeros((1, 2)), np.ones((1, 2)))[0, 0] == -1


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=4).tolist()) for i in range(50)] + [(99, None), (98, [1.0])]
    rows = spark.createDataFrame(data, "id long, vector array<double>")
    queries = rows.where("id < 9").withColumnRenamed("id", "query_id")

    def found():
        return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in vectors.nearest(queries, rows, 3).collect())

    whole = found()
    for name, value in (("BLOCK_ROWS", 2), ("BROADCAST_BYTES", 0), ("GROUP_BYTES", 256)):
        monkeypatch.setattr(vectors, name, value)
        assert found() == whole and len(whole) == 27
    assert all(q == i for q, rank, i, _ in whole if rank == 1)
    assert vectors.nearest(queries.limit(0), rows, 3).count() == 0


def test_diversity_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pools = [(q, i + 1, i, float(rng.normal()), rng.normal(size=3).tolist()) for q in range(4) for i in range([3, 9, 12, 5][q])]
    df = spark.createDataFrame(pools, "query_id long, rank int, id long, score double, vector array<double>")
    got = {}
    for r in sorted(retrieval.diversified(df, 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q in range(4):
        pool = [p for p in pools if p[0] == q]
        if len(pool) <= 5:
            assert got[q] == [p[2] for p in pool]
            continue
        scores = np.array([p[3] for p in pool])
        relevance = (scores - scores.min()) / (scores.max() - scores.min())
        chosen = [int(relevance.argmax())]
        while len(chosen) < 5:
            best = max(
                (i for i in range(len(pool)) if i not in chosen),
                key=lambda i: (0.7 * relevance[i] - 0.3 * max(unit(pool[i][4]) @ unit(pool[c][4]) for c in chosen), -i),
            )
            chosen.append(best)
        assert got[q] == [pool[i][2] for i in chosen]


def test_fusion_ties_go_to_the_earlier_list(spark):
    lists = spark.createDataFrame(
        [(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1), (1, "b", 10, 2), (1, "b", 10, 3)], "query_id long, list string, id long, rank int"
    )
    assert [r.id for r in sorted(retrieval.fuse(lists).collect(), key=lambda r: r.rank)] == [10, 11]


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 50)], "query_id long, rank int, cost long")
    fit = lambda **k: {(r.query_id, r.rank) for r in retrieval.within_budget(df, F.col("cost"), 10, **k).collect()}
    assert fit() == {(1, 1)} and fit(keep_first=True) == {(1, 1), (2, 1)}


def test_access_is_public_without_owner(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    owners = spark.createDataFrame([(1, "u"), (2, "v"), (2, "u")], "doc_id long, owner string")
    seen = lambda viewer: sorted(r.doc_id for r in retrieval.visible(docs, owners, viewer).collect())
    assert seen(None) == [3] and seen("u") == [1, 2, 3] and seen("v") == [2, 3]


def test_last_n_below_one_is_empty_and_batches_fold(spark):
    turns = spark.createDataFrame([(1, i, "user", "x" * n) for i, n in enumerate([4, 4, 4, 20, 2])], "conv_id long, turn long, role string, text string")
    assert memory.last_n(turns, 0).count() == 0 and memory.last_n(turns, 2).count() == 2
    rows = [(r.batch, r.first, r["last"], r.chars) for r in memory.batched(turns, 10, 4).orderBy("batch").collect()]
    assert rows == [(1, 0, 1, 8), (2, 1, 2, 8), (3, 3, 3, 20), (4, 4, 4, 2)]


def test_robots_longest_rule_and_allow_on_a_tie(spark):
    text = "User-agent: *\nUser-agent: x\nDisallow: /a # c\nAllow: /a/b\nDisallow: /*.pdf$\nAllow: /c\nDisallow: /c\nDisallow:\n\nUser-agent: y\nDisallow: /\n"
    rules = screening.robots_rules(spark.createDataFrame([("h", text)], "host string, text string"))
    paths = ["/a/x", "/a/b/c", "/x.pdf", "/x.pdf?y", "/c/d", "/z"]
    urls = spark.createDataFrame([(i, "h", p) for i, p in enumerate(paths)], "id long, host string, path string")
    got = {r.path: r.allowed for r in screening.robots_allowed(urls, rules).collect()}
    assert got == {"/a/x": False, "/a/b/c": True, "/x.pdf": False, "/x.pdf?y": True, "/c/d": True, "/z": True}


def test_labels_are_kept_and_dense(spark):
    old = spark.createDataFrame([("b", 1), ("a", 2)], "key string, label long")
    batch = spark.createDataFrame([(k,) for k in "dcabe"], "key string")
    got = {r.key: r.label for r in tables.labelled(old, batch, "key", "key").collect()}
    assert got == {"b": 1, "a": 2, "c": 3, "d": 4, "e": 5}


def office(name, parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, xml in parts.items():
            z.writestr(path, xml)
    return name, out.getvalue()


def test_files_of_every_kind(spark, tmp_path):
    contents = dict(
        [
            office("d.docx", {"word/document.xml": '<w:d xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:t>Head</w:t></w:p>'
                              "<w:p><w:t>te</w:t><w:t>xt</w:t></w:p><w:tbl><w:tr><w:tc><w:t>a</w:t></w:tc><w:tc><w:t>b</w:t></w:tc></w:tr></w:tbl></w:body></w:d>"}),
            office("s.pptx", {"ppt/slides/slide1.xml": '<s xmlns:a="a"><sp><ph type="title"/><a:p><a:t>Top</a:t></a:p></sp><sp><a:p><a:t>point</a:t></a:p></sp></s>'}),
            office("x.xlsx", {"xl/workbook.xml": '<w><sheets><sheet name="One"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>hi</t></si></s>",
                              "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>3</v></c></row></w>'}),
            ("p.html", b"<h1>T</h1><script>x</script><p>a &amp; b</p>"),
            ("j.json", json.dumps({"a": [1, {"b": "x"}], "c": None}).encode()),
            ("bad.json", b"{nope"),
            ("n.ipynb", json.dumps({"cells": [{"source": ["a\n", "b"]}, {"source": " "}, {"source": "c"}]}).encode()),
            ("latin.txt", "caf\xe9".encode("latin-1")), ("utf16.txt", "hey".encode("utf-16")), ("bin.txt", b"a\0b"), ("noend", b"plain"),
            ("q.pdf", b"%PDF-1.4"), ("empty.txt", b""), (".hidden/h.txt", b"no"),
        ]
    )
    for name, raw in contents.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    got = {r.path.rpartition("/")[2]: r for r in files.extracted(files.scan(spark, str(tmp_path / "in"))).collect()}
    text = {k: r.text for k, r in got.items()}
    assert text["d.docx"] == "## Head\ntext\na | b" and text["s.pptx"] == "# Top\npoint" and text["x.xlsx"] == "# ONE\nhi | 3"
    assert text["p.html"] == "# T\na & b" and text["j.json"] == "a[0]: 1\na[1].b: x\nc: None" and text["bad.json"] == "{nope"
    assert text["n.ipynb"] == "a\nb\n\nc" and text["latin.txt"] == "café" and text["utf16.txt"] == "hey" and text["noend"] == "plain"
    assert got["bin.txt"].error == "binary file" and got["q.pdf"].error and "empty.txt" not in got and "h.txt" not in got
    rows = [(n, bytearray(c)) for n, c in contents.items()] + [("f.pdf", bytearray(b"nope")), ("x", bytearray(b"a"))]
    reasons = {r.name: r.reason for r in files.upload_verdict(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert reasons["d.docx"] is None and reasons["q.pdf"] is None and reasons["f.pdf"] == "not a pdf"
    assert reasons["bad.json"] == "not json" and reasons["x"] == "unknown kind" and reasons["empty.txt"] == "empty"


def test_generations_fall_back(spark, tmp_path):
    root = str(tmp_path / "gen")
    assert generations.open_latest(spark, root) is None
    assert generations.publish(spark.range(3).toDF("a"), root) == 1 and generations.publish(spark.range(5).toDF("a"), root) == 2
    assert generations.open_latest(spark, root).count() == 5
    (tmp_path / "gen" / "gen-000002.json").write_text('{"rows": 9, "columns": ["a"]}')
    (tmp_path / "gen" / ".gen-000002.json.crc").unlink(missing_ok=True)
    assert generations.open_latest(spark, root).count() == 3
    log = str(tmp_path / "log")
    for origin in ("x", "x", "y"):
        generations.record(spark.createDataFrame([("u", origin, 5)], "url string, origin string, bytes long"), log)
    assert generations.acquired_bytes(spark, log, "x") == 10


def test_streams_add_each_turn_once(spark, tmp_path):
    src, store, check = (str(tmp_path / x) for x in ("src", "store", "check"))
    rows = [(1, i, "user", "t") for i in range(25)] + [(2, 0, "user", "t" * 40000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.mode("append").parquet(src)
    sync.sync_stream(sync.turn_stream(spark, src), store, check, ["conv_id", "turn"]).awaitTermination(120)
    df.unionByName(spark.createDataFrame([(3, 0, "user", "t")], df.schema)).write.mode("append").parquet(src)
    sync.sync_stream(sync.turn_stream(spark, src), store, check, ["conv_id", "turn"]).awaitTermination(120)
    assert spark.read.parquet(store).count() == len(rows) + 1
    due = str(tmp_path / "due")
    sync.snapshot_stream(sync.turn_stream(spark, src), due, check + "2").awaitTermination(120)
    assert {r.conv_id: r.due for r in spark.read.parquet(due).collect()} == {1: True, 2: True, 3: False}


def test_text_functions_are_unicode_aware(spark):
    df = spark.createDataFrame([("naïve  STRASSE\t x ",)], "t string")
    t = F.col("t")
    r = df.select(T.words(t), T.fold_white(t), T.strip_white(t)).first()
    assert r[0] == ["naïve", "STRASSE", "x"] and r[1] == "naïve STRASSE x" and r[2] == "naïve  STRASSE\t x"


def test_an_id_that_falls_by_its_text_is_not_seen(spark):
    rows = [(1, 1, 1, "X"), (1, 2, 2, " X "), (1, 3, 2, "Y"), (1, 4, 1, "Z"), (2, 1, 1, "X")]
    df = spark.createDataFrame(rows, "query_id long, rank int, id long, text string")
    got = sorted((r.query_id, r.rank) for r in retrieval.deduplicated(df).collect())
    assert got == [(1, 1), (1, 3), (2, 1)]


def test_dependents_of_long_chains_and_cycles(spark):
    edges = [(i, i - 1) for i in range(1, 12)] + [(100, 101), (101, 100)]
    jobs = spark.createDataFrame(edges, "id long, needs long")
    roots = spark.createDataFrame([(0,), (100,)], "id long")
    got = {(r.id, r.root, r.depth) for r in acquisition.dependents(jobs, roots).collect()}
    assert got == {(i, 0, i) for i in range(12)} | {(100, 100, 0), (101, 100, 1)}


def test_new_rows_with_null_keys_are_added_once(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "c"), (None, "d"), (2, "e")], "k long, v string")
    assert [tuple(r) for r in tables.new_rows(old, new, ["k"], F.col("v")).collect()] == [(2, "e")]


def test_steps_that_remove_characters(spark):
    text = "a1٢b  #c\r\n\r\n  d-e's  f!"
    rows = spark.createDataFrame([(text,), (None,), ("",), ("12\n#\n",)], "t string")
    bare = T.normalise(F.col("t"), T.Profile(numbers=True, special=True))
    got = rows.select("t", bare.alias("bare"), T.normalise(F.col("t"), T.MINIMAL).alias("minimal")).collect()
    want = {text: ("ab c d-e's f!", "a1٢b #c d-e's f!"), None: (None, None), "": ("", ""), "12\n#\n": ("", "12 #")}
    assert {r.t: (r.bare, r.minimal) for r in got} == want


def test_uploads_of_binary_content(spark):
    rows = {
        "nul.txt": b"a" * 5000 + b"\0",
        "at_limit.txt": b"\x01" + b"a" * 99,
        "over.txt": b"\x01" + b"a" * 98,
        "late.md": b"a" * 9000 + b"\x1f" * 91,
        "blanks.csv": b"\t\n\f\r" * 9,
        "high.txt": bytes(range(128, 256)),
        "over.json": b"\x02",
        "late.pdf": b"\0" * 900 + b"%PDF-1.7",
        "later.pdf": b" " * 1020 + b"%PDF-1.7",
        "null.txt": None,
    }
    docs = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows.items()], "name string, content binary")
    bad = {"nul.txt", "over.txt", "late.md", "over.json"}
    want = {n: "binary, not text" if n in bad else None for n in rows} | {"later.pdf": "not a pdf"}
    assert {r.name: r.reason for r in files.upload_verdict(docs).collect()} == want
