"""Finding documents on search pages, reading them, and gathering them until a query is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators.screening import TOPIC_FLOOR, robots_allowed
from lorespring.operators.vectors import ranked, verdict

# Words that say nothing about what a page is about.
PLAIN_WORDS = (
    "a", "an", "and", "are", "can", "does", "for", "from", "how", "into", "its", "the", "this", "that", "what", "when", "where",
    "which", "who", "why", "with", "use", "used", "using", "work", "works", "between", "difference", "explain",
)
# Parts of a site that every page repeats, the blocks of a result, and paths that are no documents.
CHROME = ("nav", "header", "footer")
BLOCKS = ("li", "tr", "dd", "dt", "p", "article")
NOT_DOCUMENTS = ("/search", "/login", "/logout", "/signup", "/register", "/submit", "/account", "/advanced")
CONTEXT_CHARS = 400
# The kinds of content that are read.
CONTENT_TYPES = (
    "text/plain", "text/html", "text/markdown", "application/json", "application/xhtml+xml", "application/xml", "text/xml",
)
# A word, a compound, and what shows that a text is markup.
WORD = "[a-z0-9][a-z0-9+#]*"
COMPOUND = "[a-z0-9]+(?:[_-][a-z0-9]+)+"
MARKUP = r"(?i)<\s*(html|body|div|p|li|a|span|h[1-6])\b"


def term_tokens(terms: Column, host: Column) -> Column:
    """Distinct words of three letters and more, then joined compounds, without plain words and parts of the host."""
    lower = F.lower(terms)
    compounds = F.regexp_extract_all(lower, F.lit(COMPOUND), F.lit(0))
    every = F.concat(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.transform(compounds, lambda c: F.translate(c, "_-", "")))
    good = lambda w: (F.length(w) >= 3) & ~w.isin(*PLAIN_WORDS) & ~F.contains(F.lower(host), w)
    return F.array_distinct(F.filter(every, good))


def without(html: Column, *names: str) -> Column:
    """Markup without the named elements; what is never closed stays."""
    for name in names:
        html = F.regexp_replace(html, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    return html


def plain(html: Column) -> Column:
    """Markup with a blank for each tag, character references decoded and white space folded."""
    return T.fold_white(T.unescape_xml(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " ")))


def readable(text: Column) -> Column:
    """What a reader sees of a page, a line for each run of text between tags; text without markup stays as it is."""
    shown = without(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), "script", "style", "noscript", *CHROME)
    lines = F.split(T.unescape_xml(F.regexp_replace(shown, "<[^>]*>", "\n")), r"\r\n|[\n\r]")
    lines = F.filter(F.transform(lines, T.strip_white), lambda line: line != "")
    return F.when(F.regexp_like(text, F.lit(MARKUP)), F.array_join(lines, "\n")).otherwise(text)


def joined_url(base: Column, href: Column) -> Column:
    """A reference resolved against the URL of its page, without its fragment; empty parts of a path stay."""
    scheme = r"(?i)^([a-z][a-z0-9+.-]*:)"
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    href = F.regexp_replace(F.btrim(href), "(?s)#.*", "")
    folder = F.regexp_replace(path, "[^/]*$", "")
    local = (
        F.when(href.startswith("/"), href)
        .when(href.startswith("?"), F.concat(path, href))
        .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
    )
    parts = F.split(F.regexp_extract(local, r"^([^?]*)", 1), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    step = lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return (
        F.when(href == "", F.regexp_replace(base, "(?s)#.*", ""))
        .when(F.regexp_like(href, F.lit(scheme)), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, scheme, 1), href))
        .otherwise(F.concat(site, F.array_join(kept, "/"), F.regexp_extract(local, r"(?s)(\?.*)$", 1)))
    )


def result_links(pages: DataFrame, limit: int = 5) -> DataFrame:
    """(page_id, link, score, rank) of the best links of search pages (page_id, url, html, terms).

    Links in menus go, and those that leave https or the host, lead back to the search or to no document. The score is
    how many tokens of ``terms`` the link's text, path or block holds, and at least one is needed; where ``terms`` is
    null all links stay in their order. A block is what lies between two block tags.
    """
    border = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>"
    blocks = pages.select("page_id", "url", "terms", F.posexplode(F.split(without(F.col("html"), *CHROME), border)).alias("block", "inside"))
    anchors = F.regexp_extract_all("inside", F.lit(r"(?is)<a\s[^>]*>.*?(?=</a\s*>|<a\s|$)"), F.lit(0))
    found = blocks.select("page_id", "url", "terms", "block", F.left(plain(F.col("inside")), F.lit(CONTEXT_CHARS)).alias("context"), F.posexplode(anchors).alias("nth", "anchor"))
    tag = F.regexp_extract("anchor", r"(?s)^(<[^>]*>)", 1)
    href = [F.regexp_extract(tag, rf"(?is)\shref\s*=\s*{v}", 1) for v in ('"([^"]*)"', "'([^']*)'", r"([^\s>\"']+)")]
    found = found.where(F.regexp_like(tag, F.lit(r"(?i)\shref\s*="))).withColumn("link", joined_url(F.col("url"), T.unescape_xml(F.concat(*href))))
    host = lambda url: F.rtrim(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("."))
    path = lambda url: F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))
    link, url = F.col("link"), F.col("url")
    found = found.where((link != url) & link.startswith("https://") & (host(link) == host(url)))
    found = found.where(~path(link).isin("", "/") & (path(link) != path(url)) & ~F.regexp_like(path(link), F.lit(f"^({'|'.join(NOT_DOCUMENTS)})")))
    first = found.groupBy("page_id", "link").agg(F.min_by(F.struct("url", "terms", "anchor", "context"), F.struct("block", "nth")).alias("of"), F.min(F.struct("block", "nth")).alias("pos"))
    said = F.concat_ws(" ", plain(F.col("of.anchor")), F.regexp_extract("link", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "of.context")
    said = F.array_join(F.regexp_extract_all(F.lower(F.translate(said, "_-", "  ")), F.lit(WORD), F.lit(0)), " ")
    tokens = term_tokens(F.col("of.terms"), host(F.col("of.url")))
    score = F.when(F.col("of.terms").isNull(), 0).otherwise(F.size(F.filter(tokens, lambda t: F.contains(said, t))))
    scored = first.withColumn("score", score).where(F.col("of.terms").isNull() | (F.col("score") > 0))
    return ranked(scored, ["page_id"], F.desc("score"), F.asc("pos"), limit=limit).select("page_id", "link", "score", "rank")


def content_type_allowed(header: Column) -> Column:
    return F.lower(T.strip_white(F.substring_index(header, ";", 1))).isin(*CONTENT_TYPES)


def acquired(candidates: DataFrame, floor: float = TOPIC_FLOOR, rounds: int = 3, most: int = 200, on_partial: bool = False) -> DataFrame:
    """What rounds of gathering keep of (query_id, round, id, topic_score, query_score), with rounds, verdict and stored.

    After each round all that was kept so far is gated and cut to the best ``most`` by topic; the first round whose
    verdict is FULL is the last. Nothing is stored but what answers the query, or in part where ``on_partial`` is set.
    """
    near = candidates.where((F.col("round") <= rounds) & (F.col("topic_score") >= floor))
    after = near.withColumn("rounds", F.explode(F.sequence(F.col("round").cast("int"), F.lit(rounds))))
    kept = ranked(after, ["query_id", "rounds"], F.desc("topic_score"), F.asc("round"), F.asc("id"), limit=most)
    told = kept.groupBy("query_id", "rounds").agg(verdict(F.max("query_score")).alias("verdict"))
    last = told.groupBy("query_id").agg(F.min_by(F.struct("rounds", "verdict"), F.struct(F.col("verdict") != "FULL", F.when(F.col("verdict") == "FULL", F.col("rounds")).otherwise(-F.col("rounds")))).alias("l"))
    last = last.select("query_id", "l.rounds", "l.verdict")
    good = F.col("verdict").isin("FULL", "PARTIAL") if on_partial else F.col("verdict") == "FULL"
    return kept.join(last, ["query_id", "rounds"]).withColumn("stored", good)


def target_terms(topic: Column, subtopics: Column, query: Column) -> Column:
    """What to type into a source's search: topic, subtopics and query, blank ones left out."""
    parts = F.concat(F.array(topic), F.coalesce(subtopics, F.array().cast("array<string>")), F.array(query))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (T.strip_white(p) != "")), " ")


def search_url(template: Column, terms: Column) -> Column:
    """A source's search address with the terms, form-encoded."""
    return F.replace(template, F.lit("{terms}"), F.url_encode(terms))


def indexed_sitemaps(files: DataFrame, most: int = 10) -> DataFrame:
    """(source, pos, url, child): which of the files (url, text) each index (``<sitemapindex``) names, the first few only."""
    named = files.where(F.contains("text", F.lit("<sitemapindex")))
    found = named.select(F.col("url").alias("source"), F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>")), 1, most)).alias("pos", "url"))
    return found.join(files.select("url", F.col("text").alias("child")), "url")


def permitted(links: DataFrame, rules: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, host, path, rank, place) of ranked links that robots rules allow, the first ``limit`` of each query."""
    good = robots_allowed(links.select("id", "host", "path").distinct(), rules).where("allowed").select("id", "host", "path")
    return ranked(links.withColumnRenamed("rank", "found").join(good, ["id", "host", "path"]), ["query_id"], F.asc("found"), F.asc("id"), limit=limit)


def first_tier(*tiers: DataFrame) -> DataFrame:
    """Of candidates (target, source, ...) those of the first way that finds any for a target at a source, with ``tier``."""
    every = None
    for n, found in enumerate(tiers, 1):
        found = found.withColumn("tier", F.lit(n))
        every = found if every is None else every.unionByName(found)
    best = every.groupBy("target", "source").agg(F.min("tier").alias("tier"))
    return every.join(best, ["target", "source", "tier"])
