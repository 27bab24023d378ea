"""Exact Jaccard join on word n-grams, as a blocked sparse product of the document by n-gram incidence.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more. Shingles have one
global order, frequent ones last. A set of n shingles can only reach the similarity with another if they share one of
its first ``n - ceil(0.75 n) + 1`` shingles, so only those columns of the incidence matrix are kept. Sets that share
such a shingle meet in the group named by the smallest set that holds it. Sizes, ends of prefixes and numbers of shared
shingles rule out most pairs before a set is looked at: in groups with few pairs a set, a pair's shared shingles are added
up over all groups, so that texts which share a shingle with many others, by chance, but enough with none, go nowhere. What
is left is multiplied: the block's part of the incidence matrix with itself, in dense slices for the columns that many
sets hold and pair by pair for the others. The overlaps are those of whole sets, so the bound is decided in the block,
which returns a spanning forest of its links.

Equal sets are one row of the matrix. A group of over ``BLOCK`` sets is cut into parts at random, in two ways, and each
part is compared whole; that connects near copies. Sets outside the group's main component then meet all others, block
against block. So no link between components is lost, no group is in one task, and rows grow with the sets, not with
the pairs. In a group of texts alike, but not enough to link, all pairs of blocks are multiplied: that work is squared.

Frequent shingles are found from counts over all documents (a shingle that repeats within a part of the input); the
order may be any order, so what those counts miss costs time and no result.

Defined results: a null, empty or blank text has an empty set and links with nothing; a text of 1 to 4 words is one
shingle; texts of any length count whole; rows that share a doc_id count as one document with links of all; a null
doc_id gets a null component; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from lorespring.llm.common import discard, grouped, in_parts, mapped, written
from lorespring.llm.components import components, forest
from lorespring.llm.shingles import mixed, shingle_sets

#: A shingle counts as frequent from this many sightings; so many of the most frequent ones have a place in the order.
FREQUENT, MOST_FREQUENT = 8, 400_000
#: Postings of a block, at first and once there are many blocks.
BLOCK_POSTINGS, MANY_BLOCKS, LARGE_BLOCK = 100_000, 4096, 4_000_000
#: Rows of a block of groups that are looked at without their sets, and pairs a set up to which a group's are listed.
BLOCK_ROWS, PAIRS = 50_000, 32
#: Sets of one side of a block product; larger groups are cut into blocks.
BLOCK = 1024
#: Shingles that the sets of one task have together, on average; groups up to this size are compared pair by pair.
TASK_SHINGLES, FEW = 500_000, 48
#: Dense columns that are multiplied at a time.
SLICE = 512
#: Tables of documents to verify up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_DOCS = 1_000_000
#: Shingles of a part of the input whose repeats are counted together.
HELD = 4_000_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets, about a megabyte of text at a time."""
    for part in in_parts(batches):
        yield part.column(0).to_pylist(), shingle_sets([t or "" for t in part.column(1).to_pylist()])


def _set_ids(members: np.ndarray, clashing: frozenset = frozenset()) -> tuple[int, int]:
    """The id of a set, and a second one that it takes if its first is among the clashing ones."""
    digest = blake2b(members.tobytes(), digest_size=16).digest()
    one, two = (int.from_bytes(digest[k : k + 8], "little") >> 1 for k in (0, 8))
    return (two if one in clashing else one), two


def _batch(columns: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _scan(docs: DataFrame) -> DataFrame:
    """One row per document (true, doc_id, set_id, n, second id), and (false, null, shingle, sightings) for repeats.

    Sightings count the distinct sets of a part of the input that hold a shingle, where two or more do. A part's
    shingles are counted in slices by value, so that little is copied at a time.
    """
    names, types = ["document", "doc_id", "item", "n", "more"], [pa.bool_(), *[pa.int64()] * 4]

    def repeats(held: dict[int, np.ndarray]):
        for low in range(0, 1 << 62, 1 << 59):
            slices = (s[np.searchsorted(s, low) : np.searchsorted(s, low + (1 << 59))] for s in held.values())
            shingles, n = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *slices]), return_counts=True)
            if m := int((n > 1).sum()):
                yield _batch([[False] * m, [None] * m, shingles[n > 1], n[n > 1], [None] * m], names, types)

    def scan(batches):
        held: dict[int, np.ndarray] = {}
        for ids, sets in _parts(batches):
            own = [_set_ids(s) for s in sets]
            held.update(zip((x for x, _ in own), sets, strict=True))
            yield _batch([[True] * len(ids), ids, [x for x, _ in own], [len(s) for s in sets], [y for _, y in own]], names, types)
            if sum(map(len, held.values())) > HELD:
                yield from repeats(held)
                held.clear()
        yield from repeats(held)

    return mapped(docs, scan, "document boolean, doc_id long, item long, n long, more long")


def _postings(docs: DataFrame, frequent: np.ndarray, n_blocks: int, clashing: frozenset) -> DataFrame:
    """Of each shingle that the prefixes of two sets or more hold, the sets, as (false, low, set_id, keys).

    ``low`` is the smallest set of the shingle's list and names the group in which its sets meet; of several shingles
    with one ``low`` in a block, each set is told once, with their number. Rows (true, last, set_id, 1) tell where the
    prefix of a set ends. On the way postings are packed: (block, keys, sets), with the ends in blocks below 0.
    """
    by_value = np.argsort(frequent)
    ordered = frequent[by_value]

    def cut(batches):
        for _, sets in _parts(batches):
            own = {_set_ids(s, clashing)[0]: s for s in sets if len(s)}
            if not own:
                continue
            sizes = np.array([len(s) for s in own.values()])
            keys = np.concatenate(list(own.values()))
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
                hit = ordered[at] == keys
                keys[hit] = (1 << 62) + by_value[at[hit]]
            ends = np.cumsum(sizes)
            prefixes = []
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                n = b - a
                prefixes.append(np.sort(keys[a:b])[: n - (3 * n + 3) // 4 + 1])
            ids = np.array(list(own), dtype=np.int64)
            key = np.concatenate([np.concatenate(prefixes), np.array([p[-1] for p in prefixes])])
            owner = np.concatenate([np.repeat(ids, [len(p) for p in prefixes]), ids])
            block = (mixed(key.astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int64)
            block[-len(ids) :] = -1 - (ids % n_blocks)
            order = np.argsort(block, kind="stable")
            key, owner, block = key[order], owner[order], block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1)).tolist() + [len(block)]
            for i in range(0, len(cuts) - 1, 512):
                spans = list(zip(cuts[i : i + 512], cuts[i + 1 : i + 513]))
                yield _batch(
                    [
                        [int(block[a]) for a, _ in spans],
                        [key[a:b].tobytes() for a, b in spans],
                        [owner[a:b].tobytes() for a, b in spans],
                    ],
                    ["block", "keys", "sets"],
                    [pa.int64(), pa.binary(), pa.binary()],
                )

    def shared(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Of a block, the sets of each group; all of a negative one."""
        key = np.frombuffer(b"".join(rows["keys"]), dtype=np.int64)
        owner = np.frombuffer(b"".join(rows["sets"]), dtype=np.int64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        if rows["block"].iloc[0] < 0:
            return pd.DataFrame({"info": True, "low": key, "set_id": owner, "keys": 1})
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(first, len(key)))
        low, shared = np.repeat(owner[first], size), np.repeat(size > 1, size)
        low, owner = low[shared], owner[shared]
        order = np.lexsort((owner, low))
        low, owner = low[order], owner[order]
        new = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))[: len(low)])
        return pd.DataFrame({"info": False, "low": low[new], "set_id": owner[new], "keys": np.diff(np.append(new, len(low)))})

    packed = mapped(docs, cut, "block long, keys binary, sets binary")
    return grouped(packed.groupBy("block"), shared, "info boolean, low long, set_id long, keys long")


def needed(n_a: np.ndarray, n_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
    """How many shingles two sets' prefixes share at least, if the sets reach the similarity.

    Sets of these sizes have ``ceil(3 (n_a + n_b) / 7)`` shingles in common then. The set whose prefix ends first in
    the global order has no more than the rest of its own behind that end.
    """
    low = np.where(last_a <= last_b, n_a, n_b)
    return -(-3 * (n_a + n_b) // 7) - ((3 * low + 3) // 4 - 1)


def possible(n: np.ndarray, last: np.ndarray, most: np.ndarray, a, b) -> np.ndarray:
    """Whether two sets can link, by their sizes and by how many shared shingles their prefixes have in all."""
    fits = (4 * n[a] >= 3 * n[b]) & (4 * n[b] >= 3 * n[a])
    return fits & (np.minimum(most[a], most[b]) >= needed(n[a], n[b], last[a], last[b]))


def group_pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of one group, where groups are sorted; those a step apart at a time."""
    at, step = np.arange(len(group)), 1
    while len(at := at[at + step < len(group)]) and len(at := at[group[at] == group[at + step]]):
        yield at, at + step
        step += 1


def _pruned(blocks: GroupedData, most_pairs: int) -> DataFrame:
    """Of blocks of small groups (low, set_id, n, last, most, home, keys): pairs that can link, or whole groups.

    A group with up to ``most_pairs`` such pairs a set has a row (low, a, b, keys, need) for each: how many shingles they
    share in the group at most, and how many in all groups they need. Another has a row (low, set_id, -1, keys, need) for
    each set; ``need`` is 0 if the set can link with none there, or only with those that it meets in their common home.
    """

    def prune(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["low", "n", "set_id"], kind="stable", ignore_index=True)
        n, last, most, home, keys, low, ids = (rows[c].to_numpy() for c in ("n", "last", "most", "home", "keys", "low", "set_id"))
        group = np.cumsum(np.diff(low, prepend=low[0]) != 0)

        def fitting(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in group_pairs(low[places]):
                a, b = places[a], places[b]
                fits = possible(n, last, most, a, b)
                a, b = a[fits], b[fits]
                elsewhere = np.minimum(most[a] - keys[a], most[b] - keys[b])
                fits = np.minimum(keys[a], keys[b]) + elsewhere >= needed(n[a], n[b], last[a], last[b])
                yield a[fits], b[fits]

        count, keep = np.zeros(group[-1] + 1, dtype=np.int64), np.zeros(len(rows), dtype=bool)
        for a, b in fitting(np.arange(len(rows))):
            count += np.bincount(group[a], minlength=len(count))
            own = (home[a] != home[b]) | (home[a] == low[a])
            keep[a[own]] = True
            keep[b[own]] = True
        whole = count > most_pairs * np.bincount(group)
        of = np.flatnonzero(whole[group])
        out = [(low[of], ids[of], np.full(len(of), -1), keys[of], keep[of].astype(np.int64))]
        for a, b in fitting(np.flatnonzero((count > 0)[group] & ~whole[group])):
            need = needed(n[a], n[b], last[a], last[b])
            out.append((low[a], np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), np.minimum(keys[a], keys[b]), need))
        return pd.DataFrame(dict(zip(("low", "a", "b", "keys", "need"), map(np.concatenate, zip(*out)), strict=True)))

    return grouped(blocks, prune, "low long, a long, b long, keys long, need long")


def _to_meet(pruned: DataFrame, large: DataFrame) -> DataFrame:
    """(low, set_id) of the sets that meet in a group; ``large`` has (set_id, keys) of the groups that are not in ``pruned``.

    Two sets share at most the shingles of their listed pairs, and of other groups no more than the one with fewer has there.
    """
    whole = pruned.where("b < 0").select("low", F.col("a").alias("set_id"), "keys", "need")
    others = whole.select("set_id", "keys").unionByName(large).groupBy("set_id").agg(F.sum("keys").alias("more"))
    pairs = pruned.where("b >= 0").groupBy("a", "b").agg(
        F.sum("keys").alias("keys"), F.max("need").alias("need"), F.max_by("low", F.struct("keys", "low")).alias("low")
    )
    for end in "ab":
        pairs = pairs.join(others.select(F.col("set_id").alias(end), F.col("more").alias(f"more_{end}")), end, "left")
    more = F.least(*(F.coalesce(f"more_{end}", F.lit(0)) for end in "ab"))
    pairs = pairs.where(F.col("keys") + more >= F.col("need"))
    met = pairs.select("low", F.explode(F.array("a", "b")).alias("set_id"))
    return met.unionByName(whole.where("need > 0").select("low", "set_id")).distinct()


def overlap_matrix(
    row_a: np.ndarray, item_a: np.ndarray, row_b: np.ndarray, item_b: np.ndarray, shape: tuple, items: int, dense: int = 256
) -> np.ndarray:
    """The product of two incidence matrices, given by the rows and items of their ones.

    Items whose pairs of rows are over 1 in ``dense`` of all are columns of dense slices; for the others the pairs are
    added up one by one.
    """
    n_a, n_b = (np.bincount(x, minlength=items) for x in (item_a, item_b))
    work = n_a * n_b
    heavy = work * dense > shape[0] * shape[1]
    out = np.zeros(shape, dtype=np.float32)
    columns = np.cumsum(heavy) - 1
    sides = []
    for row, item in ((row_a, item_a), (row_b, item_b)):
        mine = heavy[item]
        column = columns[item[mine]]
        order = np.argsort(column, kind="stable")
        sides.append((row[mine][order], column[order]))
    for c in range(0, int(heavy.sum()), SLICE):
        parts = []
        for (row, column), n in zip(sides, shape):
            a, b = np.searchsorted(column, [c, c + SLICE])
            parts.append(np.zeros((n, SLICE), dtype=np.float32))
            parts[-1][row[a:b], column[a:b] - c] = 1
        out += parts[0] @ parts[1].T
    light = ~heavy & (work > 0)
    mine, theirs = light[item_a], light[item_b]
    row_a, item_a, row_b, item_b = row_a[mine], item_a[mine], row_b[theirs], item_b[theirs]
    order = np.argsort(item_b, kind="stable")
    row_b, item_b = row_b[order], item_b[order]
    first = np.searchsorted(item_b, item_a, side="left")
    count = np.searchsorted(item_b, item_a, side="right") - first
    ends = np.cumsum(count)
    for a, b in _slices(ends):
        k = np.arange(int(count[a:b].sum())) + np.repeat(first[a:b] - (ends[a:b] - count[a:b] - (ends[a - 1] if a else 0)), count[a:b])
        flat = np.repeat(row_a[a:b] * shape[1], count[a:b]) + row_b[k]
        out += np.bincount(flat, minlength=shape[0] * shape[1]).reshape(shape)
    return out


def _slices(ends: np.ndarray, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of entries, whose lengths add up to ``ends``, of about ``size`` together."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


class Members:
    """The sets of one task, with shingles numbered from 0 on, so that few bits tell them apart."""

    def __init__(self, rows: pd.DataFrame):
        self.id, self.n, self.last, self.most = (rows[c].to_numpy() for c in ("set_id", "n", "last", "most"))
        found, self.item = np.unique(np.frombuffer(b"".join(rows["members"]), dtype="<i8"), return_inverse=True)
        self.items = len(found)
        self.end = np.cumsum(self.n)
        self.begin = self.end - self.n

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each shingle of these sets, which of them holds it and where it lies."""
        n = self.n[rows]
        row = np.repeat(np.arange(len(rows)), n)
        return row, np.arange(len(row)) + np.repeat(self.begin[rows] - (np.cumsum(n) - n), n)

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of sets reach the similarity."""
        code = np.repeat(np.arange(len(self.n)) * self.items, self.n) + self.item
        out = np.zeros(len(a), dtype=bool)
        for s, e in _slices(np.cumsum(self.n[a])):
            row, place = self.places(a[s:e])
            wanted = b[s:e][row] * self.items + self.item[place]
            at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            common = np.bincount(row[code[at] == wanted], minlength=e - s)
            out[s:e] = 7 * common >= 3 * (self.n[a[s:e]] + self.n[b[s:e]])
        return out

    def links(self, left: np.ndarray, right: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, root) of a spanning forest of the links that ``allowed`` permits between two blocks of sets."""
        allowed = allowed & possible(self.n, self.last, self.most, left[:, None], right[None, :])
        left, right, allowed = left[allowed.any(axis=1)], right[allowed.any(axis=0)], allowed[allowed.any(axis=1)][:, allowed.any(axis=0)]
        if not len(left):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        (row_a, at_a), (row_b, at_b) = self.places(left), self.places(right)
        common = overlap_matrix(row_a, self.item[at_a], row_b, self.item[at_b], allowed.shape, self.items)
        mask = allowed & (7 * common >= 3 * (self.n[left][:, None] + self.n[right][None, :]))
        rows, columns = forest(mask, self.id[left], self.id[right])
        return np.concatenate([self.id[left], self.id[right]]), np.concatenate([rows, columns])


def _compare(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of a spanning forest of all links within the groups of one task; a group is all sets of one ``low``."""
    rows = rows.sort_values(["low", "n", "set_id"], kind="stable", ignore_index=True)
    sets, low = Members(rows), rows["low"].to_numpy()
    first = np.flatnonzero(np.diff(low, prepend=low[0] - 1))
    size = np.diff(np.append(first, len(low)))
    own = np.repeat(size, size)
    few = np.flatnonzero(own <= FEW)
    pairs = []
    for a, b in group_pairs(low[few]):
        a, b = few[a], few[b]
        fits = possible(sets.n, sets.last, sets.most, a, b)
        pairs.append((a[fits], b[fits]))
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, dtype=np.int64),) * 2
    hit = sets.linked(a, b)
    found = [(sets.id[b[hit]], sets.id[a[hit]])]
    for at, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
        block = np.arange(at, at + n)
        found.append(sets.links(block, block, ~np.eye(n, dtype=bool)))
    a, b = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"a": a, "b": b})[a != b]


def _compare_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of a spanning forest of the links of blocks x and y of a large group that join two components."""
    rows = rows.sort_values("set_id", kind="stable", ignore_index=True)
    sets, part, component = Members(rows), rows["part"].to_numpy(), rows["component"].to_numpy()
    left, right = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
    a, b = sets.links(left, right, component[left][:, None] != component[right][None, :])
    return pd.DataFrame({"a": a, "b": b})[a != b]


def _with_members(rows: DataFrame, docs: DataFrame, classes: DataFrame, clashing: frozenset) -> DataFrame:
    """``rows`` with a column of the members of their set_id, taken from the first document that has the set.

    Up to ``BROADCAST_DOCS`` rows go to the documents, so that sets are shuffled once, to their tasks; more than that
    meet the sets in a join.
    """
    light = written(rows.join(classes.select("set_id", "doc_id"), "set_id"), "to-compare")
    few = light.count() <= BROADCAST_DOCS
    more = F.collect_list(F.struct(*(c for c in rows.columns if c != "set_id"))).alias("rows")
    by_doc = light.groupBy("doc_id", "set_id").agg(more) if few else light.select("doc_id", "set_id").distinct()
    by_doc = written(by_doc, "to-hash")
    chosen = docs.join(F.broadcast(by_doc) if few else by_doc, "doc_id").select("doc_id", "text", "set_id", *(["rows"] if few else []))

    def members(batches):
        for part in in_parts(batches):
            sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
            same = pa.array([_set_ids(s, clashing)[0] == i for s, i in zip(sets, part.column(2).to_pylist(), strict=True)])
            columns = [pa.array([s.tobytes() for s in sets], pa.binary()), *part.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["members", *part.schema.names[2:]]).filter(same)

    kind = chosen.schema["rows"].dataType.simpleString() if few else ""
    found = mapped(chosen, members, f"members binary, set_id long, rows {kind}" if few else "members binary, set_id long")
    if docs.join(F.broadcast(by_doc.select("doc_id")) if few else by_doc, "doc_id", "left_semi").count() > by_doc.count():
        found = found.dropDuplicates(["set_id"])  # ids that several rows have
    if few:
        return found.select("set_id", "members", F.explode("rows").alias("row")).select("set_id", "members", "row.*")
    return light.drop("doc_id").join(found, "set_id")


def _links(groups: DataFrame, docs: DataFrame, classes: DataFrame, clashing: frozenset) -> list[DataFrame]:
    """Tables (a, b) of links that connect the sets. ``groups`` has low, set_id, n, last, most, home and keys.

    A set's home is the group in which it has most shingles; sets of one home need not meet anywhere else.
    """
    sizes = groups.groupBy("low").agg(F.count("*").alias("sets"), F.min("home").alias("home"), F.max("home").alias("other"))
    sizes = sizes.where(F.col("sets") > BLOCK)
    own = (F.col("home") != F.col("other")) | (F.col("home") == F.col("low"))
    sizes = sizes.select("low", F.when(own, F.ceil(F.col("sets") / BLOCK)).otherwise(0).cast("int").alias("parts"))
    large = written(sizes, "large-groups")
    n_large = large.count()
    listed = F.broadcast(large) if n_large <= BROADCAST_DOCS else large
    small = groups.join(listed.select("low"), "low", "left_anti")
    n_blocks = max(1, groups.count() // BLOCK_ROWS)
    blocks = small.groupBy(F.pmod(F.xxhash64("low"), F.lit(n_blocks)).alias("block"))
    listed_pairs = written(_pruned(blocks, PAIRS), "listed-pairs")
    elsewhere = groups.join(listed.select("low"), "low", "left_semi").select("set_id", "keys")
    groups = groups.drop("keys")
    pruned = groups.drop("home").join(_to_meet(listed_pairs, elsewhere), ["low", "set_id"])
    pruned = written(pruned.select("low", "set_id", "n", "last", "most"), "pruned")
    crowd = written(groups.join(listed.where("parts > 0"), "low"), "crowd")

    # Small groups are compared whole; of large ones, the parts of two random ways to cut them.
    n_tasks = max(1, (pruned.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES)
    tasks = [pruned.withColumn("task", F.pmod(F.xxhash64("low"), F.lit(n_tasks)))]
    for way in range(2 if n_large else 0):
        part = F.pmod(F.xxhash64("set_id", F.lit(way)), F.col("parts"))
        tasks.append(crowd.where("home = low").drop("home").withColumn("task", -1 - F.pmod(F.xxhash64("low", part, F.lit(way)), F.lit(1 << 62))).drop("parts"))
    tasks = _with_members(reduce(DataFrame.unionByName, tasks), docs, classes, clashing)
    near = written(grouped(tasks.groupBy("task"), _compare, "a long, b long"), "near-links")
    out = [near]
    if n_large:
        # What is still apart: the sets outside a group's main component meet all the others, block against block.
        known = crowd.join(components(near).withColumnRenamed("id", "set_id"), "set_id", "left")
        known = written(known.withColumn("component", F.coalesce("component", "set_id")), "known")
        main = known.groupBy("low", "component").agg(F.count("*").alias("sets")).groupBy("low")
        main = main.agg(F.max_by("component", F.struct("sets", "component")).alias("main"), F.max("sets").alias("most_sets"), F.sum("sets").alias("sets"))
        main = main.where(F.col("most_sets") < F.col("sets")).select(
            "low",
            "main",
            F.ceil((F.col("sets") - F.col("most_sets")) / BLOCK).cast("int").alias("apart"),
            F.ceil(F.col("most_sets") / BLOCK).cast("int").alias("inside"),
        )
        inner = F.col("component") == F.col("main")
        own = F.pmod(F.xxhash64("set_id"), F.when(inner, F.col("inside")).otherwise(F.col("apart"))).cast("int")
        dealt = known.join(F.broadcast(main) if n_large <= BROADCAST_DOCS else main, "low").withColumn("part", own + F.when(inner, F.col("apart")).otherwise(0))
        others = F.sequence(F.lit(0), F.when(inner, F.col("apart") - 1).otherwise(F.col("apart") + F.col("inside") - 1))
        dealt = dealt.withColumn("other", F.explode(others))
        dealt = dealt.select(
            "low", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "set_id", "component", "n", "last", "most"
        )
        dealt = _with_members(dealt, docs, classes, clashing)
        far = grouped(dealt.groupBy("low", "x", "y"), _compare_blocks, "a long, b long")
        out.append(written(far, "far-links"))
        discard(known)
    for df in (listed_pairs, pruned, crowd, large):
        discard(df)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = written(_scan(docs), "shingle-scan")
    every = scan.where("document")
    often = scan.where(~F.col("document")).groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "item").limit(MOST_FREQUENT).select("item").toArrow()
    frequent = often.column("item").to_numpy()[::-1].astype(np.int64)
    # Two digests of 63 bits stand for a set: the first, or the second where sets clash in the first.
    twice = every.where("n > 0").groupBy("item").agg(F.min("more").alias("x"), F.max("more").alias("y")).where("x < y")
    clashing = frozenset(r.item for r in twice.select("item").collect())
    set_id = F.when(F.col("item").isin(list(clashing)), F.col("more")).otherwise(F.col("item")) if clashing else F.col("item")
    found = every.select("doc_id", set_id.alias("set_id"), "n")

    classes = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = classes.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    classes = written(classes, "classes")
    total = (found.agg(F.sum("n")).first()[0] or 0) // 4
    n_blocks = max(1, min(total // BLOCK_POSTINGS, MANY_BLOCKS), total // LARGE_BLOCK)
    postings = written(_postings(docs, frequent, n_blocks, clashing), "postings")
    shared = postings.where(~F.col("info"))
    shared = shared.groupBy("set_id", "low").agg(F.sum("keys").alias("keys"))
    most = shared.groupBy("set_id").agg(F.sum("keys").alias("most"), F.max_by("low", F.struct("keys", "low")).alias("home"))
    sizes = postings.where("info").select("set_id", F.col("low").alias("last")).join(classes.select("set_id", "n"), "set_id")
    groups = shared.join(most, "set_id").join(sizes, "set_id")
    groups = written(groups.select("low", "set_id", "n", "last", "most", "home", "keys"), "groups")
    discard(postings)
    links = reduce(DataFrame.unionByName, _links(groups, docs, classes, clashing))
    discard(groups)

    # From sets to documents: a class stands for its first document, and an id with two texts joins their classes.
    first = classes.select("set_id", F.col("doc_id").alias("first"))
    links = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    texts = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).distinct()
    several = texts.groupBy("doc_id").agg(F.count("*").alias("texts")).where(F.col("texts") > 1)
    several = texts.join(several, "doc_id").join(first, "set_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    whole = components(links.unionByName(several)).withColumnRenamed("id", "first")
    of_class = first.join(whole, "first", "left").select("set_id", F.coalesce("component", "first").alias("component"))
    out = found.join(of_class, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are the first of their group of near copies.

    Of rows that repeat a doc_id one stays; rows with a null doc_id stay.
    """
    result = written(jaccard_components(docs), "components")
    gone = result.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if gone.count() <= BROADCAST_DOCS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = result.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"))
    twice = written(twice.where(F.col("rows") > 1).select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
