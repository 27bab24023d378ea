"""Personal data: patterns, and terms that disclose what the patterns found.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. The information-theoretic part asks
which words give a protected entity away: over all distinct texts it counts how many hold a term, how many hold it
near an entity (one address or number), and takes the share P(entity | term) and the pointwise mutual information.
A term that is near one entity in almost every text that holds it discloses the entity and is removed wherever it
stands; the entity itself is generalised to its kind. Single addresses hardly recur, so what they have in common is
protected as well: the domain of an address, the network of an IP, the issuer of a card, the area of a phone number.

Counts go by distinct text, so copies of a text are no evidence by themselves. Terms are looked up in blocks of
bounded size, a pass over the texts for each, so any number of them is handled. Near an entity are the eight words
before and after it; words are runs of letters of any length, and those inside of entities are left out.

Defined results: a null text is an empty one, without spans; texts of any length are searched whole, in linear time;
repeated rows get their spans each; an empty table gives an empty result. Only doc_id and text are read by ``find``;
``sanitise`` keeps all other columns as they are, whatever their names, but n_chars, which follows the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b, sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.llm.common import BATCHES, discard, free_name, in_parts, mapped, release, written

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A word is a run of letters; a term is one of four or more.
WORD, TERM = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]{4,}")

#: Words on either side of an entity that count as near it, whatever else lies between.
WINDOW, LEAST = 8, 4
#: A term discloses an entity if so many distinct texts show them together, at this share of all texts with the term,
#: with so many bits of mutual information.
MIN_TEXTS, MIN_SHARE, MIN_BITS = 3, 0.8, 3.0
#: Terms that one pass over the texts looks up.
TERM_BLOCK = 200_000

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost addresses: the run before each ``@`` and the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[Span]:
    """Each four numbers in a row of dotted numbers; those with a part over 255 are dropped."""
    out = []
    for m in NUMBERS.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := "".join(DIGIT.findall(m[0]))) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each base span, by kind and start, in code points."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)]
        out += [("card", *s) for s in cards(text)]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


class Covered:
    """Where a text's spans lie, overlapping ones as one."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def entity_of(text: str, kind: str, start: int, end: int) -> str:
    return f"{kind}:{''.join(text[start:end].lower().split())}"


def group_of(text: str, kind: str, start: int, end: int) -> str:
    """What an entity shares with others: its domain, first three parts, first six digits, or all but the last seven."""
    value = text[start:end].lower()
    if kind == "email":
        return f"domain:{value.rpartition('@')[2]}"
    if kind == "ip":
        return f"network:{'.'.join(str(int(p)) for p in value.split('.')[:3])}"
    digits = "".join(DIGIT.findall(value))
    return f"issuer:{digits[:6]}" if kind == "card" else f"area:{digits[:-7]}"


def near_terms(text: str, spans: list[tuple[str, int, int]], named: Callable[..., str] = entity_of) -> set[tuple[str, str]]:
    """(term, entity): the terms among the ``WINDOW`` words before and after each span, words in spans left out."""
    covered = Covered(spans)
    words = [m.span() for m in WORD.finditer(text)]
    words = [w for w in words if not covered.touches(*w)]
    starts = [a for a, _ in words]
    out = set()
    for kind, start, end in spans:
        entity = named(text, kind, start, end)
        before, after = bisect_left(starts, start), bisect_left(starts, end)
        for a, b in words[max(0, before - WINDOW) : before] + words[after : after + WINDOW]:
            if b - a >= LEAST:
                out.add((text[a:b].lower(), entity))
    return out


def term_spans(text: str, terms: frozenset, spans: list[tuple[str, int, int]]) -> list[Span]:
    """Where the terms stand in a text, outside of base spans."""
    if not terms or terms.isdisjoint(w.lower() for w in set(TERM.findall(text))):
        return []
    covered = Covered(spans)
    found = (m.span() for m in TERM.finditer(text) if m[0].lower() in terms)
    return [s for s in found if not covered.touches(*s)]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    for part in in_parts(batches, column):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _tables(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _digest(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=16).digest()


def _blocks(terms: DataFrame) -> Iterator[frozenset]:
    """The terms in sets of bounded size."""
    n = -(-terms.count() // TERM_BLOCK)
    for i in range(n):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) if n > 1 else terms
        yield frozenset(r.term for r in part.collect())


def disclosing_terms(docs: DataFrame, groups: bool = False) -> DataFrame:
    """The terms over the thresholds, with the entity each discloses, counts, share and bits; on demand those that
    disclose a group of entities too."""
    levels = (entity_of, group_of) if groups else (entity_of,)
    pair_schema = pa.schema([("term", pa.string()), ("entity", pa.string()), ("digest", pa.binary())])
    text_schema = pa.schema([("term", pa.string()), ("digest", pa.binary())])

    def pairs(batches):
        def rows():
            for (text,) in _texts(batches, 0):
                if text and (spans := base_spans(text)):
                    digest = _digest(text)
                    for named in levels:
                        for term, entity in near_terms(text, spans, named):
                            yield term, entity, digest
                        for entity in {named(text, *s) for s in spans}:
                            yield None, entity, digest

        return _tables(rows(), pair_schema)

    near = mapped(docs.select("text"), pairs, "term string, entity string, digest binary").distinct()
    near = written(near, "pii-near")
    counts = near.groupBy("term", "entity").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= MIN_TEXTS)
    entities = counts.where(F.col("term").isNull()).select("entity", F.col("n_both").alias("n_entity"))
    # A term is in as many texts as have it near any entity, at least: common words can't reach the share.
    least = near.where(F.col("term").isNotNull()).groupBy("term").agg(F.count_distinct("digest").alias("n_near"))
    both = counts.join(least, "term").where(F.col("n_both") >= MIN_SHARE * F.col("n_near")).drop("n_near")
    both = written(both, "pii-pairs")
    counted = []
    for block in _blocks(both.select("term").distinct()):

        def holders(batches, block=block):
            def rows():
                for (text,) in _texts(batches, 0):
                    if text and (hit := block.intersection({w.lower() for w in set(TERM.findall(text))})):
                        digest = _digest(text)
                        for term in hit:
                            yield term, digest

            return _tables(rows(), text_schema)

        part = mapped(docs.select("text"), holders, "term string, digest binary").distinct()
        counted.append(written(part.groupBy("term").agg(F.count("*").alias("n_term")), "pii-holding"))
    if counted:
        holding = reduce(DataFrame.unionByName, counted)
    else:
        holding = docs.sparkSession.createDataFrame([], "term string, n_term long")
    n_docs = max(1, docs.agg(F.count_distinct(F.xxhash64("text"))).first()[0])
    scored = both.join(holding, "term").join(entities, "entity")
    scored = scored.withColumn("share", F.col("n_both") / F.col("n_term"))
    scored = scored.withColumn("bits", F.log2(F.col("share") * n_docs / F.col("n_entity")))
    out = written(scored.where((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS)), "pii-terms")
    for df in (near, both, *counted):
        discard(df)
    return out


def _packed(spans: list[Span]) -> str:
    return ",".join(f"{a}:{b}" for a, b in spans)


def _unpacked(spans: str) -> list[Span]:
    return [tuple(map(int, s.split(":"))) for s in spans.split(",")] if spans else []


def _looked_up(docs: DataFrame, terms: DataFrame | None, found: str) -> tuple[DataFrame, frozenset]:
    """``docs`` with a column of the term spans found so far, and the block of terms that is left to look up.

    Each block but the last is a pass of its own over the texts, so no task holds more terms than one block.
    """
    for name, value in BATCHES.items():
        docs.sparkSession.conf.set(name, value)
    terms = disclosing_terms(docs, groups=True) if terms is None else terms
    out, last = docs.withColumn(found, F.lit("")), frozenset()
    for block in _blocks(terms.select("term").distinct()):
        if last:

            @F.pandas_udf("string")
            def more(texts, spans, block=last):
                return pd.Series(
                    [s if not t else _packed(_unpacked(s) + term_spans(t, block, base_spans(t))) for t, s in zip(texts, spans, strict=True)],
                    dtype=object,
                )

            out = written(out.withColumn(found, more("text", found)), "pii-looked-up")
        last = block
    return out, last


def find(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans for each row of ``docs``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain, last = _looked_up(plain, terms, "found")
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    schema = pa.schema(list(zip(names, types, strict=True)))

    def spans_of(batches):
        def rows():
            for doc, text, found in _texts(batches, 1):
                text = text or ""
                base = base_spans(text)
                every = base + [("term", *s) for s in sorted(_unpacked(found) + term_spans(text, last, base))]
                told = [f"{k}:{s}:{e}" for k, s, e in every]
                digest = sha256(",".join(told[: len(base)]).encode()).hexdigest()
                counts = Counter(k for k, _, _ in every)
                yield doc, *(counts[k] for k in KINDS), digest, ",".join(told)

        return _tables(rows(), schema)

    kinds = "n_email long, n_ip long, n_card long, n_phone long, n_term long"
    return mapped(plain, spans_of, f"doc_id long, {kinds}, base_sha256 string, spans string")


def mask(text: str, terms: frozenset, found: list[Span] = ()) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    base = base_spans(text)
    every = [(s, e, k) for k, s, e in base] + [(s, e, "term") for s, e in [*found, *term_spans(text, terms, base)]]
    out, at, end = [], 0, 0
    for s, e, kind in sorted(every):
        if s >= end:
            out += [text[at:s] if at < s else "", f"[{kind.upper()}]"]
        end = at = max(end, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with personal data generalised to its kind and disclosing terms removed from the text."""
    columns, found = docs.columns, free_name("found", docs)
    docs, last = _looked_up(docs, terms, found)

    @F.pandas_udf("string")
    def masked(texts, spans):
        out = [mask(t, last, _unpacked(s)) if t else t for t, s in zip(texts, spans, strict=True)]
        release()
        return pd.Series(out, dtype=object)

    name = free_name("masked_text", docs)
    out = docs.withColumn(name, masked("text", found))
    if "n_chars" in columns:
        changed = ~F.col(name).eqNullSafe(F.col("text"))
        length = F.length(name).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(name)).select(columns)
