"""What is let in: trusted hosts, robots rules, licences and sizes, relevance, quotas, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE_FLOOR, TOPIC_FLOOR = 0.25, 0.35
MAX_BYTES = 64 << 20


def trusted(url: Column, hosts: list[str]) -> Column:
    """Over https, at one of the hosts or a true subdomain of one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = F.lit(False)
    for h in hosts:
        known |= (host == h) | host.endswith(f".{h}")
    return F.coalesce(url.startswith("https://") & known, F.lit(False))


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, pattern) of the agent's groups in robots.txt files (host, text).

    A run of user-agent lines opens a group; comments and lines without a colon are skipped, empty values too.
    """
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    line = F.trim(F.element_at(F.split("raw", "#"), 1))
    lines = lines.withColumn("line", line).where(F.col("line").contains(":"))
    field, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("host", "pos", field.alias("field"), value.alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("pos")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("group", F.sum(opens.cast("int")).over(order))
    is_agent = (F.col("field") == "user-agent") & (F.lower("value") == agent)
    mine = F.max(is_agent.cast("int")).over(Window.partitionBy("host", "group"))
    rules = lines.withColumn("mine", mine).where((F.col("mine") == 1) & (F.col("field") != "user-agent") & (F.col("value") != ""))
    return rules.select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_pattern(pattern: Column) -> Column:
    """A regular expression for a rule: ``*`` for anything, ``$`` for the end."""
    literal = F.regexp_replace(F.regexp_replace(pattern, r"\$+$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (id, host, path) with ``allowed``: the longest rule that matches, allow on a tie, allowed without one."""
    hits = urls.join(rules, "host").where(F.regexp_like("path", robots_pattern(F.col("pattern"))))
    best = hits.groupBy("id").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("said"))
    return urls.join(best, "id", "left").select("id", "host", "path", F.coalesce("said", F.lit(True)).alias("allowed"))


def dataset_verdict(licence: Column, size: Column, allowed: Column | list[str], most: int = MAX_BYTES) -> Column:
    """Why a dataset is turned away, by the first reason that holds; null for one that is taken.

    ``allowed`` lists licences, or is a column that is true where a lookup has found the dataset's.
    """
    if isinstance(allowed, list):
        allowed = F.lower(F.trim(licence)).isin(allowed)
    return (
        F.when(licence.isNull() | (F.trim(licence) == ""), "licence missing")
        .when(~F.coalesce(allowed, F.lit(False)), "licence not allowed")
        .when(size.isNull(), "size unknown")
        .when(size > most, "too big")
    )


def selected(scored: DataFrame, floor: float = SOURCE_FLOOR, most: int = 3) -> DataFrame:
    """Of (query_id, id, score) the best few at or above the floor; the best one where none is."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.where((F.col("rank") == 1) | ((F.col("rank") <= most) & (F.col("score") >= floor)))


def admitted(items: DataFrame, cost: Column, limit: int, by: list[str], order: list[str]) -> DataFrame:
    """Items in order until the first that would exceed the limit; all later ones are turned away too."""
    spent = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = items.withColumn("spent", spent)
    return out.withColumn("admitted", F.col("spent") <= limit)


def evicted(items: DataFrame, size: str, limit: int, by: list[str], order: list[str]) -> DataFrame:
    """The least recently used items that have to go until the rest fits the limit."""
    whole = Window.partitionBy(*by)
    before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(size).over(whole) - F.coalesce(F.sum(size).over(before), F.lit(0))
    return items.withColumn("left", left).where(F.col("left") > limit).drop("left")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every anchor in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def robots_by_status(files: DataFrame) -> DataFrame:
    """Robots files (host, text) from fetches (host, status, text): read where there is one, all allowed on 4xx, else nothing."""
    status = F.col("status")
    text = F.when(status.between(200, 299), F.coalesce("text", F.lit(""))).when(status.between(400, 499), "")
    return files.select("host", F.coalesce(text, F.lit("User-agent: *\nDisallow: /")).alias("text"))


def private_address(host: Column) -> Column:
    """Whether a host is written as an address of its own network or machine; names are not resolved."""
    host = F.lower(host)
    parts = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    a, b = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    inside = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224)
    v4 = F.regexp_like(host, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) & inside
    return F.coalesce(v4 | (host == "localhost") | F.regexp_like(host, F.lit(r"^\[(::1?|f[cd].*|fe[89ab].*)\]$")), F.lit(False))
