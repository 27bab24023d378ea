"""Search pages, addresses, names and prefixes against plain Python."""

from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import discovery, retrieval, screening, store
from lorespring.plans import discovery_queries

BASE = "https://a.example.com/x/y/z?q=1#top"
HREFS = [
    "", "#f", "?p=2", "w", "./w", "../w", "../../w", "../../../w", "w/..", "w/.", "/r/s", "/r/../s", "//b.org/t", "https://b.org/u#v",
    "mailto:a@b.c", " w ", "w?x=../y", "w/./v/u",
]


def test_addresses_are_resolved(spark):
    rows = spark.createDataFrame([(h,) for h in HREFS], "href string")
    got = {r.href: r.url for r in rows.select("href", discovery.joined_url(F.lit(BASE), F.col("href")).alias("url")).collect()}
    assert got == {h: urljoin(BASE, h.strip()).partition("#")[0] for h in HREFS}


def test_links_of_a_search_page(spark):
    html = """<header><a href="/menu">widget</a></header>
    <ul><li><a class='b' href='/docs/one'>First</a> about a widget_gear</li>
    <li><A HREF=/docs/two>Widget</A> and gear</li><li><a href="/docs/none">nothing</a></li></ul>
    <a href="/search?page=2">widget</a><a href="http://a.example.com/plain">widget</a><a href="https://b.org/widget">widget</a>
    <a href="https://a.example.com/docs/two#again">widget</a><a name="x">widget</a><a href="/">widget</a>"""
    rows = [(1, "https://a.example.com/find?q=w", html, "the Widget gear of example"), (2, "https://a.example.com/find", html, None), (3, None, None, "x")]
    got = discovery.result_links(spark.createDataFrame(rows, "page_id long, url string, html string, terms string"), 3).collect()
    site = "https://a.example.com/docs/"
    first = [(r.link, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r.page_id == 1]
    assert first == [(site + "one", 2, 1), (site + "two", 2, 2)]
    assert [r.link for r in sorted(got, key=lambda r: r["rank"]) if r.page_id == 2] == [site + "one", site + "two", site + "none"]
    assert {r.page_id for r in got} == {1, 2}


def test_readable_pages(spark):
    rows = [("no < markup",), ("<p>A <b>b</b>\n c</p><nav>menu<p>x</p></nav><SCRIPT>var a</SCRIPT><!-- d --><div> &lt;e </div>",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(discovery.readable(F.col("t"))).collect()]
    assert got == ["no < markup", "A\nb\nc\n<e", "", None]


def test_queries_are_cleaned(spark):
    rows = [("é \r\n\r\n\r\n\r\nb\x00c\t",), (" \n",), (None,), ("  in line  x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.clean_query(F.col("t"))).collect()]
    assert got == ["é\n\nbc", None, None, "in line  x"]


def test_file_names(spark):
    rows = [("a/b\\c:d?.PDF",), (None,), (" .. ",), ("x" * 300 + ".txt",), (".env",)]
    got = spark.createDataFrame(rows, "n string").select(T.safe_filename(F.col("n")).alias("n")).select("n", T.extension(F.col("n")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("c_d_.PDF", "pdf"), ("upload", ""), ("upload", ""), ("x" * 196 + ".txt", "txt"), ("env", "")]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=5), st.lists(st.integers(0, 2), max_size=5)), min_size=1, max_size=20))
def test_common_prefix(spark, pairs):
    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    rows = spark.createDataFrame(pairs, "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(store.common_prefix(F.col("a"), F.col("b"))).collect()] == [shared(a, b) for a, b in pairs]


@pytest.mark.parametrize("stem_is_taken", [True, False])
def test_imported_names_are_the_first_free(spark, stem_is_taken):
    here = [(1, "u", "T (3)"), (2, "u", "T (5)"), (3, "v", "T"), (9, "u", "S")] + [(4, "u", "T")] * stem_is_taken
    new = [(i, "u", "T") for i in range(10, 16)] + [(16, "u", "T (4)"), (17, "u", "T (3)"), (3, "v", "T"), (18, "w", "T")]
    schema = "id long, owner string, name string"
    got = {r.id: r.name for r in store.imported(spark.createDataFrame(here, schema), spark.createDataFrame(new, schema)).collect()}
    taken, want = {(o, n) for _, o, n in here}, {16: "T (4)", 18: "T"}
    taken |= {("u", "T (4)"), ("w", "T")}
    if not stem_is_taken:
        want[10] = "T"
        taken.add(("u", "T"))
    for i, owner, _ in sorted(r for r in new if r[0] not in (3, *want)):
        name = next(n for n in ("T", *(f"T ({k})" for k in range(2, 99))) if (owner, n) not in taken)
        taken.add((owner, name))
        want[i] = name
    assert got == want


def test_gathering_stops_when_answered(spark):
    rows = [(1, 1, 10, 0.5, 0.3), (1, 2, 11, 0.9, 0.99), (1, 3, 12, 0.9, 0.99), (2, 1, 20, 0.1, 0.99), (3, 1, 30, 0.4, 0.1), (3, 4, 31, 0.9, 0.99)]
    table = spark.createDataFrame(rows, "query_id long, round int, id long, topic_score double, query_score double")
    got = {(r.query_id, r.id, r.rounds, r.verdict, r.stored) for r in discovery.acquired(table).collect()}
    assert got == {(1, 10, 2, "FULL", True), (1, 11, 2, "FULL", True), (3, 30, 3, "NONE", False)}


def test_robots_by_status(spark):
    rows = [("ok", 200, "User-agent: *\nDisallow: /x"), ("gone", 404, None), ("down", 503, "User-agent: *\nAllow: /"), ("lost", None, None)]
    rules = screening.robots_rules(screening.robots_by_status(spark.createDataFrame(rows, "host string, status int, text string")))
    urls = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate((h, p) for h, *_ in rows for p in ("/x/1", "/y"))], "id int, host string, path string")
    got = {(r.host, r.path) for r in screening.robots_allowed(urls, rules).where("allowed").collect()}
    assert got == {("ok", "/y"), ("gone", "/x/1"), ("gone", "/y")}


def test_private_addresses(spark):
    inside = ["10.1.2.3", "127.0.0.1", "169.254.169.254", "172.16.0.1", "172.31.9.9", "192.168.0.1", "LOCALHOST", "[::1]", "[fd00::1]", "0.0.0.0"]
    outside = ["8.8.8.8", "172.32.0.1", "11.0.0.1", "10.example.com", "example.com", "[2001:db8::1]", "", None]
    rows = spark.createDataFrame([(h,) for h in inside + outside], "h string")
    assert [r[0] for r in rows.select(screening.private_address(F.col("h"))).collect()] == [True] * len(inside) + [False] * len(outside)


def test_reranking_needs_all_scores(spark):
    passages = [(1, 1, 0.9, 1), (1, 2, 0.8, 2), (2, 3, 0.9, 1), (2, 4, 0.8, 2), (3, 5, 0.9, 1), (4, 6, 0.9, 1), (4, 7, 0.8, 2)]
    scores = [(1, 1, 0.1), (1, 2, 0.2), (2, 3, 0.1), (3, 5, 0.3), (4, 6, float("nan")), (4, 7, 1.0)]
    table = spark.createDataFrame(passages, "query_id int, id int, score double, rank int")
    got = retrieval.reranked(table, spark.createDataFrame(scores, "query_id int, id int, new_score double")).collect()
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in got} == {
        (1, 1): (2, 0.2), (1, 2): (1, 0.1), (2, 1): (3, 0.9), (2, 2): (4, 0.8), (3, 1): (5, 0.9), (4, 1): (6, 0.9), (4, 2): (7, 0.8),
    }


def test_cursors_do_not_pass_each_other(spark):
    history = spark.createDataFrame([(p, k) for p in (1, 2, 3) for k in range(1, 5)], "project int, place int")
    moves = spark.createDataFrame([(1, 2, 1), (2, 9, 9)], "project int, advance int, back int")
    assert {tuple(r) for r in store.navigated(history, moves).collect()} == {(1, 3, 3), (2, 4, 4), (3, 1, 4)}


def test_the_first_way_that_finds_anything_counts(spark):
    schema = "target int, source string, link string"
    one, two = (spark.createDataFrame(rows, schema) for rows in ([(1, "a", "x")], [(1, "a", "y"), (1, "b", "z"), (2, "a", "w")]))
    assert {(r.target, r.source, r.link, r.tier) for r in discovery.first_tier(one, two).collect()} == {(1, "a", "x", 1), (1, "b", "z", 2), (2, "a", "w", 2)}


def test_gathering_takes_the_best_of_each_round_from_the_search(spark, tmp_path, monkeypatch):
    rows = [(i, i % 2, [1.0, i / 100, (i * 7 % 13) / 50]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, acquired = [], discovery.acquired

    def watched(candidates, **kinds):
        seen.append(candidates.groupBy("query_id", "round").count().collect())
        return acquired(candidates, **kinds)

    monkeypatch.setattr(discovery, "acquired", watched)
    got = discovery_queries.gathered_in_rounds(spark, str(tmp_path)).collect()
    assert {r["count"] for r in seen[0]} == {12} and {r["round"] for r in seen[0]} == {1, 2, 3}
    assert len(got) == 15 * 12 and all(r.id != r.query_id and r.id % 2 == r.query_id % 2 for r in got)


def test_texts_are_tidied_in_bounded_batches(spark):
    discovery_queries.cleaned_queries(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
