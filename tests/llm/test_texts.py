"""URL filters, personal data and HTML extraction."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lorespring.llm import html_extract, pii, url_filters
from lorespring.llm.url_filters import UrlRule, base_rule

URLS = [
    None,
    "",
    "no scheme",
    "http://Example.COM/en/742?x=1#y",
    "https://a.example.com/en/8",
    "http://com/en/",
    "http://.com/en/x",
    "http://xcom/en/x",
    "http://example.net/de/81",
    "http://x.net/de/8",
    "http://badexample.net/de/8",
    "ftp://org?/es/",
    "http://org/es/#",
    "http://www.cheap-pills.example.com/fr/1",
    "http://not-cheap-pills.example.com/fr/1",
    "a://b://com/en/",
    "http://h/p?q",
    "http://ÄB.com/EN/",
    "http://x.com/EN/",
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    table = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block")]
    table += [("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    fits = [(h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    if rule is None:
        verdict = "block" if {"ads-track", "cheap-pills"} & set(host.split(".")) else "allow"
    return host, path, rule, verdict


def test_url_verdicts_equal_brute_force(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS + URLS[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages).collect()}
    assert got == {i: brute_url(u) for i, u, *_ in rows}
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_base_rules_say_the_contracts_words(spark):
    told = {"http://com/en/1": "block", "http://example.com/en/7": "allow", "http://x.net/de/8": "allow"}
    told |= {"http://badexample.net/de/8": "allow", "http://example.net/de/81": "block", "http://org/es/": "block"}
    pages = spark.createDataFrame(list(enumerate(told)), "page_id long, url string")
    assert {r.url: r.verdict for r in url_filters.judge_urls(pages).collect()} == told


def test_rules_without_tokens_and_in_shuffled_tables(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://h.io/a1"), (2, "http://h.io/b")], "page_id long, url string")
    rules = [UrlRule("digits", "block", r"[0-9]$", ()), base_rule("allow", "h.io", "/b")]
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", 1)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {1: (None, "block"), 2: ("h.io/b", "allow")}


def test_pattern_rules_run_only_where_their_rarest_token_is(spark):
    blocked = [
        "http://m.casino-win.example.com/x", "http://free-bets.example.org/", "http://adult.io", "http://a.io/blog/wp-content/uploads/2024/setup.exe",
        "http://b.io/cgi-bin/redirect.pl/x", "http://c.io/en/affiliate/77/landing", "http://d.io/tracking/pixel.gif?x=1", "http://e.io/a;jsessionid=0123456789abcdef01",
    ]
    allowed = [
        "http://casinowin.example.com/x", "http://example.org/casino", "http://a.io/wp-content/uploads/setup.pdf", "http://b.io/redirect", "http://c.io/landing",
        "http://d.io/pixel.gif", "http://e.io/a;jsessionid=01", "http://f.io/?casino",
    ]
    usual = [f"http://h{i % 7}.example.com/fr/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(blocked + allowed + usual)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(got))] == ["block"] * len(blocked) + ["allow"] * (len(allowed) + len(usual))
    urls = pages.select("url", F.concat(url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url"))).alias("subject"))
    patterns = [r for r in url_filters.RULES if not r.base]
    tried = url_filters.candidates(urls, patterns).groupBy("name").count().collect()
    assert sum(r["count"] for r in tried) <= 2 * len(blocked + allowed) and not any("fr" in r.name for r in tried)
    assert url_filters.judge_urls(pages.where("page_id = 0").unionByName(pages.where("page_id = 0"))).count() == 2


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    alphabet = ["a", "Z", "9", "1", "25", "255", "256", ".", ".", "@", "-", "+", " ", "%", "é", "4111 1111 1111 1111", "(", ")", "\n", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.ips("1" * 200_000 + ".1") == [] and pii.emails("a" * 200_000 + "@") == []


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for i in range(120):
        texts.append(" ".join(word() for _ in range(60)))
        if i < 10:
            texts[-1] += " contact Marlowe at sam@mail.example.com today " + " ".join(word() for _ in range(30))
    texts += [texts[3]] * 20 + ["", None, "é ip 10.0.0.255 and card 4111-1111 1111 1111.", "contact us today"]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string"), texts


def test_spans_of_documents(spark, private):
    docs, texts = private
    terms = {(r.term, r.entity) for r in pii.disclosing_terms(docs).collect()}
    assert terms == {("marlowe", "email:sam@mail.example.com"), ("contact", "email:sam@mail.example.com"), ("today", "email:sam@mail.example.com")}
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        told = [f"{k}:{s}:{e}" for k, s, e in base]
        words = {"marlowe", "contact", "today"}
        more = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\w+", t or "") if m[0].lower() in words]
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in pii.KINDS[:4])
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert r.spans == ",".join(told + more)
    assert pii.find(docs.limit(0)).count() == 0


def test_terms_that_disclose_groups(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    near = {
        "Acmeworks": ["ann.1@acme.example.org", "bo@ACME.example.org", "c_d@acme.example.org", "e@acme.example.org"],
        "Rackroom": ["10.20.30.1", "10.20.30.77", "010.20.30.9"],
        "Cardbank": ["4111111111111111", "4111 1111 1111 1111", "4111-1199-9999-9999"],
        "Areacode": ["+1 (212) 555-0001", "+1 (212) 555-0002", "+12125550003"],
        "Elsewhere": ["x@one.example.org", "y@two.example.org", "z@three.example.org"],  # nothing in common
    }
    texts = [f"{prose(30)} {name} {value} {prose(30)}" for name, values in near.items() for value in values]
    texts += [prose(60) for _ in range(60)] + [None, "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.disclosing_terms(docs).count() == 0
    got = {(r.term, r.entity): (r.n_both, r.n_term, r.n_entity, r.share) for r in pii.disclosing_terms(docs, groups=True).collect()}
    luhn_ok = sum(bool(pii.cards(t)) for t in near["Cardbank"])
    want = {("acmeworks", "domain:acme.example.org"): (4, 4, 4, 1.0), ("rackroom", "network:10.20.30"): (3, 3, 3, 1.0)}
    want |= {("areacode", "area:1212"): (3, 3, 3, 1.0)}
    assert luhn_ok == 2 and got == want  # two cards are one short of three texts
    spans = {r.doc_id: r.n_term for r in pii.find(docs).collect()}
    assert [spans[i] for i in range(len(texts))] == [int(bool(t) and any(n in t for n in ("Acmeworks", "Rackroom", "Areacode"))) for t in texts]


def test_sanitised_documents(spark, private, monkeypatch):
    monkeypatch.setattr(pii, "TERM_BLOCK", 2)  # several blocks of terms
    docs, texts = private
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert " [TERM] [TERM] at [EMAIL] [TERM] " in rows[3].text and rows[3].n_chars == len(rows[3].text)
    assert rows[20].text == texts[20] and rows[20].n_chars == 5
    last = len(texts)
    assert rows[last - 2].text == "é ip [IP] and card [CARD]." and rows[last - 3].text is None


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/x'>menu</a></ul></nav><!-- <p>no</p> --><div class='ad'>buy</div>{0}<footer>&copy; f</footer>"
    "</body></html>"
)


@pytest.mark.parametrize(
    "inner,want",
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two<p><b>three<br>four<p>five</article>", "A & B\none two\nthree four\nfive"),
        ("<article><p>a<i>b</i>c</p>tail<ul><li>x<li>y</ul></article>", "abc\ntail\nx\ny"),
        ("<main><p>in</p><aside>no</aside><form>no</form></main><p>out</p>", "in"),
        ("<div><p>plain &lt;p&gt; &#233;</p></div>", "plain <p> é"),
        ("<article><p>text</p><section class='comments'><p>hi</p></section></article>", "text"),
        ("<article><p title='a>b'>x</p><p hidden>y</p></article>", "x"),
        ("<article></article>", ""),
        ("<p>5 < 6 and <3</p>", "5 < 6 and <3"),
        ("<article><p class='side note'>in</p><div class='legal analysis'>too</div><div class='comments'>no</div></article>", "in\ntoo"),
        ("<article><p title=it's>a</p><p title='b>b</p><p>c</article>", "a\nb\nc"),
    ],
)
def test_main_text_of_one_page(inner, want):
    assert html_extract.main_text(html_extract.parse(PAGE.format(inner))) == want


def test_template_nodes_are_found_by_alignment(spark, monkeypatch):
    page = "<body><div class='top'>Site name</div><div class='story'><p>{0}</p><p>more {0}</p></div><div class='x'>Read daily</div></body>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page.format(f"story {i}"), "t") for i in range(12)]
    rows += [(90, None, None, "t"), (91, "http://alone.org/", page.format("alone"), "t"), (92, "http://e.org", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in html_extract.extract(pages).collect()}
    for i in range(12):
        text = f"story {i}\nmore story {i}"
        assert got[i] == (text, len(text), rows[i][1])
    assert got[90] == ("", 0, None) and got[92][0] == "" and got[91][0].startswith("Site name\nalone")
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    assert html_extract.extract(pages.unionByName(pages)).count() == 2 * len(rows)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_template_inside_articles_is_dropped_and_a_copied_article_kept(spark):
    page = '<html><body><div class="x{2}">Today {2}</div><article><h1>{0}</h1><div class="line">Read it first with us.</div><p>{1}</p></article></body></html>'
    rows = [(i, "https://a.org/", page.format(f"Title {i}", f"Body {i} of its own.", 0)) for i in range(8)]
    rows += [(100 + i, "https://b.org/", page.format("One title", "One body.", i % 3)) for i in range(8)]
    # The first page is not of the usual shape, and one host has a few pages more than a chunk.
    rows.append((-1, "https://a.org/", "<html><body><section><p>Odd.</p></section></body></html>"))
    rows += [(200 + i, f"https://c.org/{i}", page.format(f"Title {i}", f"Body {i} of its own.", 0)) for i in range(25)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(100, 108)} == {"One title\nRead it first with us.\nOne body."} and got[-1] == "Odd."
    for first, n in ((0, 8), (200, 25)):
        assert [got[first + i] for i in range(n)] == [f"Title {i}\nBody {i} of its own." for i in range(n)]


def brute_match(a, b):
    """The most nodes of two trees that match, all ways tried; kinds of siblings are distinct."""
    left, right = (list(html_extract.kinds(x).values()) for x in (a, b))

    def best(i, j):
        if i == len(left) or j == len(right):
            return 0
        n = max(best(i + 1, j), best(i, j + 1))
        if left[i][0].sign == right[j][0].sign:
            n = max(n, brute_match(left[i][0], right[j][0]) + best(i + 1, j + 1))
        return n

    return 1 + best(0, 0)


def test_tree_matching_equals_brute_force():
    rng = random.Random(8)

    def tree(depth):
        if not depth:
            return ""
        return "".join(f"<div class='{c}'>{tree(depth - 1)}</div>" for c in rng.sample("abcdef", rng.randrange(1, 6)))

    for _ in range(60):
        a, b = (html_extract.parse(tree(3)) for _ in range(2))
        assert sum(len(nodes) for _, nodes in html_extract.match(a, b)) == brute_match(a, b)
    for _ in range(300):
        n = rng.randrange(8)
        places, weights = rng.sample(range(20), n), [rng.randrange(1, 9) for _ in range(n)]
        rising = lambda ks: all(places[x] < places[y] for x, y in zip(ks, ks[1:]))
        ways = [[k for k in range(n) if bits >> k & 1] for bits in range(1 << n)]
        got = html_extract.heaviest(places, weights)
        assert rising(got) and sum(weights[k] for k in got) == max(sum(weights[k] for k in w) for w in ways if rising(w))


def test_deep_long_and_broken_pages_take_linear_time(spark):
    deep = "<div>" * 10_000 + "deep" + "</div>" * 10_000
    many = "".join(f"<h2>t{i}</h2><p>text {i}</p>" for i in range(3000))
    quotes = "<a title='" * 5000 + "x"
    odd = "<p>" + "<a b=\">\" " * 5000 + "end"
    inline = "<b>" * 5000 + "<p>x" * 5000
    rows = [(i, "https://a.org/", p + f"<p>{i}</p>") for i, p in enumerate([deep, many, quotes, odd, inline, "</p>" * 5000 + "<script" * 5000] * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    begun = time.perf_counter()
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert time.perf_counter() - begun < 60
    assert got[0] == "deep\n0" and got[1].startswith("t0\ntext 0\nt1") and got[1].endswith("text 2999\n1") and len(got) == 12


def test_article_text_that_returns_is_kept(spark):
    """Headings, table headers and usual sentences stay; links, and what closes every article, go."""
    page = (
        "<html><body><article><h1>Title {0}</h1><h2>Background</h2><p>{1}</p><table><tr><th>Year</th><th>Town</th></tr>"
        "<tr><td>{0}</td><td>Town {0}</td></tr></table><p>{2}</p><ul class='more'><li><a href='/a'>First</a></li></ul>"
        "<p>As we said in {0}.</p>{3}</article></body></html>"
    )
    usual = "Results vary from year to year."
    rows = []
    for host, closing in (("a", ""), ("b", "<p>All rights with the authors.</p>")):
        for i in range(24):
            body = page.format(i, f"Body {i} of its own.", usual if i < 17 else f"In {i} results varied.", closing)
            rows.append((1000 * (host == "b") + i, f"https://{host}.org/{i}", body))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(24):
        want = ["Title %d" % i, "Background", f"Body {i} of its own.", "Year", "Town", str(i), f"Town {i}"]
        want += [usual if i < 17 else f"In {i} results varied.", f"As we said in {i}."]
        assert got[i] == got[1000 + i] == "\n".join(want)


def test_many_open_elements_close_in_linear_time():
    begun = time.perf_counter()
    html_extract.parse("<p><button>" + "<i>" * 40_000 + "<hr>" * 40_000)
    assert time.perf_counter() - begun < 4


def test_articles_without_marks_read_the_same(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    texts = [{(r.page_id, r.text) for r in html_extract.extract(df).collect()} for df in (pages, bare)]
    assert texts[0] == texts[1]


def test_odd_tables_of_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, chunk long"
    rows = [(1, None, "<p>a</p>", "x", "y", 1), (1, None, "<p>a</p>", "x", "y", 1), (None, "nothing", None, None, None, None)]
    got = [tuple(r) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "a", 1), (1, None, "a", 1), (None, "nothing", "", 0)], key=str)
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
