"""Integrity rules as a catalogue: keys, references, conditions and partial uniqueness, audited in one scan a table.

Each table is read once: a row gives, for every rule that it takes part in, an entry of rule and key, as one that must be
unique, refers, is referred to or breaks a condition. The entries of all tables are counted by rule and key in one
shuffle, added up in the scanning tasks first, so a key that a third of the rows share is a few rows there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule on ``table``.

    ``unique`` or ``primary`` columns differ between all rows, those that ``where`` holds for if it is given; rows with
    a null among them count as different, but break a primary key. ``references`` columns equal ``columns`` of a row of
    ``parent``, unless one is null. A ``check`` condition must not be false; unknown passes.
    """

    name: str
    table: str
    unique: tuple[str, ...] = ()
    primary: bool = False
    where: str | None = None
    references: tuple[str, ...] = ()
    parent: str | None = None
    columns: tuple[str, ...] = ()
    check: str | None = None


def primary_key(table: str, *columns: str) -> Rule:
    return Rule(f"{table} primary key", table, unique=columns, primary=True)


def unique(table: str, *columns: str, where: str | None = None) -> Rule:
    return Rule(f"{table} unique {', '.join(columns)}" + (" where " + where if where else ""), table, unique=columns, where=where)


def foreign_key(table: str, columns: Sequence[str], parent: str, parent_columns: Sequence[str]) -> Rule:
    return Rule(f"{table} {', '.join(columns)} in {parent}", table, references=tuple(columns), parent=parent, columns=tuple(parent_columns))


def check(table: str, condition: str) -> Rule:
    return Rule(f"{table} check {condition}", table, check=condition)


def _key(columns: Sequence[str]) -> Column:
    return F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))


def _no_nulls(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def _entry(rule: Rule, kind: str, key: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule.name).alias("rule"), F.lit(kind).alias("kind"), key.alias("key")))


def _entries(table: str, rules: Sequence[Rule]) -> list[Column]:
    out = []
    for r in rules:
        if r.table == table and r.unique:
            holds = F.coalesce(F.expr(r.where), F.lit(False)) if r.where else F.lit(True)
            out.append(_entry(r, "own", _key(r.unique), holds & _no_nulls(r.unique)))
            if r.primary:
                out.append(_entry(r, "broken", _key(r.unique), ~_no_nulls(r.unique)))
        if r.table == table and r.references:
            out.append(_entry(r, "child", _key(r.references), _no_nulls(r.references)))
        if r.parent == table:
            out.append(_entry(r, "parent", _key(r.columns), _no_nulls(r.columns)))
        if r.table == table and r.check:
            out.append(_entry(r, "broken", F.lit(""), ~F.coalesce(F.expr(r.check), F.lit(True))))
    return out


def violations(tables: Mapping[str, DataFrame], rules: Sequence[Rule], keys: bool = False) -> DataFrame:
    """(rule, n_rows) for each rule of the catalogue, 0 where it holds; with ``keys`` (rule, key, n_rows) of what breaks it.

    Rows of a key beyond the first break uniqueness, all rows that refer to nothing a reference.
    """
    parts = []
    for name, df in tables.items():
        entries = _entries(name, rules)
        if entries:
            each = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
            parts.append(each.select("e.*"))
    if not parts:
        raise ValueError("no rule is on any of the tables")
    counted = reduce(DataFrame.unionByName, parts).groupBy("rule", "key").agg(
        *(F.count_if(F.col("kind") == k).alias(k) for k in ("own", "child", "parent", "broken"))
    )
    n = F.greatest(F.col("own") - 1, F.lit(0)) + F.when(F.col("parent") == 0, F.col("child")).otherwise(0) + F.col("broken")
    found = counted.select("rule", "key", n.alias("n_rows")).where("n_rows > 0")
    if keys:
        return found
    spark = parts[0].sparkSession
    names = spark.createDataFrame([(r.name,) for r in rules if r.table in tables], "rule string")
    return names.join(found.groupBy("rule").agg(F.sum("n_rows").alias("n_rows")), "rule", "left").select(
        "rule", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows")
    )


def broken_rules(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """The rules that any row breaks."""
    return violations(tables, rules).where("n_rows > 0")


#: The rules that the stores of chunks, turns, vectors, projects and snapshots keep.
STORE_RULES = (
    primary_key("documents", "documentId"),
    primary_key("sections", "sectionId"),
    foreign_key("sections", ("documentId",), "documents", ("documentId",)),
    primary_key("contexts", "contextId"),
    foreign_key("contexts", ("sectionId",), "sections", ("sectionId",)),
    primary_key("chunks", "chunkId"),
    foreign_key("chunks", ("contextId",), "contexts", ("contextId",)),
    primary_key("turns", "project_id", "conversation_id", "sequence_number"),
    unique("turns", "chunk_id"),
    check("turns", "role in ('user', 'assistant', 'system')"),
    primary_key("vector_labels", "label"),
    unique("vector_labels", "vectorId"),
    unique("vector_labels", "chunkId"),
    primary_key("projects", "project_id"),
    foreign_key("projects", ("topic_id",), "topics", ("topic_id",)),
    primary_key("snapshots", "project_id", "project_snapshot_id"),
    foreign_key("snapshots", ("project_id",), "projects", ("project_id",)),
    primary_key("mappings", "conversation_id"),
    foreign_key("mappings", ("project_id",), "projects", ("project_id",)),
    check("mappings", "(topic_id is null) = (project_id is null)"),
    primary_key("exchanges", "exchange_id"),
    check("exchanges", "(response is null) = (answered_at is null)"),
    primary_key("conversations", "conversation_id"),
    check("conversations", "trim(name) <> ''"),
    unique("topics", "topic_name", where="is_active = 't'"),
    primary_key("topics", "topic_id"),
)
