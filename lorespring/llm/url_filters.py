"""URL filtering by pattern rules that are indexed by their rarest literal token.

Each rule is a regular expression with the literal tokens that every match holds. The tokens' frequencies over all
distinct URLs pick the rarest one of each rule as its index key; a URL's tokens fetch the rules to try, and only
those run their expressions. Base rules (a host with its subdomains and a path prefix) outrank pattern rules, and the
longest base rule wins.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default verdict; distinct
URLs are decided once, so a hot URL costs one row; repeated rows each get the verdict; ties between rules of one
length fall to the last in code-point order; an empty table gives an empty result. Only page_id and url are read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 50_000
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is tried on host + path; every match of it holds each of ``tokens`` as a whole token."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    base: bool = False


def base_rule(verdict: str, host: str, path: str) -> UrlRule:
    """The rule for a host, its subdomains, and paths that begin with ``path``."""
    literal = host + path
    whole = re.findall(TOKEN, re.sub(f"{TOKEN}$", "", path)) + re.findall(TOKEN, host)
    return UrlRule(literal, verdict, rf"^(?:[^/]*\.)?{re.escape(literal)}", tuple(whole), True)


def host_rule(label: str) -> UrlRule:
    """Block every host that has this label."""
    return UrlRule(label, "block", rf"^(?:[^/]*\.)?{re.escape(label)}(?:\.|/|$)", tuple(re.findall(TOKEN, label)))


def host_word_rule(word: str) -> UrlRule:
    """Block every host with a label that is, begins or ends with this word, or holds it between hyphens."""
    return UrlRule(f"host word {word}", "block", rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-]|/|$)", (word,))


def path_rule(name: str, pattern: str, *tokens: str) -> UrlRule:
    """Block paths that hold a pattern, on any host."""
    return UrlRule(name, "block", rf"^[^/]*/(?:.*/)?{pattern}", tokens)


#: The base rules; labels and words of advertising, tracking, betting and spam hosts; and paths of downloads and forwards.
RULES = (
    base_rule("block", "com", "/en/"),
    base_rule("allow", "example.com", "/en/7"),
    base_rule("allow", "net", "/de/"),
    base_rule("block", "example.net", "/de/8"),
    base_rule("block", "org", "/es/"),
    *(host_rule(x) for x in ("ads-track", "cheap-pills", "doubleclick", "adserver", "online-casino", "free-viagra", "spam-farm")),
    *(host_word_rule(x) for x in ("casino", "bets", "betting", "poker", "lottery", "adult", "porn", "xxx", "escort", "warez", "viagra")),
    path_rule("uploaded programs", r"wp-content/uploads/(?:[^/]+/)*[^/]+\.(?:exe|apk|msi|scr)$", "wp", "content", "uploads"),
    path_rule("forwarders", r"(?:cgi-bin|out|go)/redirect(?:\.[a-z]+)?/", "redirect"),
    path_rule("affiliate landings", r"affiliates?/[^/]+/landing(?:/|$)", "landing"),
    path_rule("tracking pixels", r"track(?:ing)?/pixel\.(?:gif|png)$", "pixel"),
    path_rule("session pages", r"[^/]*;jsessionid=[0-9A-Za-z]{16,}", "jsessionid"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to the next ``?`` or ``#``; it begins with ``/`` or is empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(urls: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """(url, subject, name, rule_verdict, pattern, base): the rules that each distinct url (url, subject) is to be tried on.

    Those are the rules whose rarest literal token, over all the urls, the url holds.
    """
    small = len(rules) <= BROADCAST_ROWS
    sized = F.broadcast if small else (lambda df: df)
    table = urls.sparkSession.createDataFrame(
        [(r.name, r.verdict, r.pattern, r.base, list(r.tokens) or [""]) for r in rules],
        "name string, rule_verdict string, pattern string, base boolean, tokens array<string>",
    )
    found = F.array_distinct(F.regexp_extract_all("subject", F.lit(f"({TOKEN})")))
    if any(not r.tokens for r in rules):
        found = F.concat(found, F.array(F.lit("")))  # rules without a literal are tried on every URL
    tokens = urls.select("url", "subject", F.explode(found).alias("token"))

    wanted = table.select("name", F.explode("tokens").alias("token"))
    seen = tokens.join(sized(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(sized(seen) if small else seen, "token", "left").groupBy("name")
    rarest = rarest.agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = table.drop("tokens").join(rarest, "name")
    return tokens.join(sized(index), "token").drop("token")


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict for each row of ``pages``."""
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    urls = urls.withColumn("subject", F.concat(host_of(F.col("url")), path_of(F.col("url"))))
    hits = candidates(urls, rules).where(F.regexp_like("subject", F.col("pattern")))
    rank = F.struct("base", F.length("name"), "name")
    best = hits.groupBy("url").agg(F.max_by(F.struct("name", "base", "rule_verdict"), rank).alias("best"))
    out = pages.select("page_id", "url").join(best, "url", "left")
    return out.select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(F.col("best.base"), F.col("best.name")).alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
