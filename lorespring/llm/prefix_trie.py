"""The trie of all conversations' prefixes, by collapsing whole sequences.

Turns are reduced to digests in the task that scans them: no text is shuffled. The place of a turn and the key of a
prefix are running sums, a prefix's key being the exclusive or of 128-bit hashes of (place, turn); runs are added up by
buckets of ``BUCKET`` places and carried over from bucket to bucket, so that one very long conversation is many groups.
Identical conversations collapse to one sequence with their number as weight and their ids as end lists, in blocks of
65,536 ids. Sequences that are proper prefixes of others drop out by anti-join; what is left are the leaves. Prefixes of
the weighted sequences are aggregated to nodes. A node's own saving is put on the leaf of the smallest id below it; the
running sum from a leaf upwards then has, for each node on its path, what lies below the node on this path, and summed
over leaves that is the whole subtree: linear in the length of the paths, however many conversations share a node.

Defined results: rows without conv_id are ignored; a null role or text is an empty one; a null turn comes first; turns
with one number are ordered by role and text; repeated rows are turns of their own; a conversation that is rebuilt
without turns ends at the root; an empty table has no root and gives no rows; texts of any length count by code points.
Equality of turns and prefixes is that of 128-bit hashes. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespring.llm.common import discard, mapped, written

#: Places of one bucket, as a power of two, and ids of one block of an end list.
BUCKET_BITS, BLOCK_BITS = 12, 16
#: A parent with so many children is broadcast to them, as long as there are no more of these parents than the second number.
MANY_CHILDREN, BROADCAST_PARENTS = 256, 100_000
#: Buckets of long conversations up to this many are broadcast; more join by shuffle.
BROADCAST_ROWS = 100_000

KEY = ["depth", "p1", "p2"]
_NONE = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, tuple[Callable, Column]], falling: bool = False) -> DataFrame:
    """``rows`` with running totals by ``order`` within ``key``; ``sums`` names each with its aggregate, a sum or a bit_xor.

    ``rows`` is a written table with a column ``bucket`` that ``order`` never crosses: each (key, bucket) is a group of
    its own, and totals of the buckets before are added where a key has several.
    """
    bucket = F.col("bucket").desc() if falling else F.col("bucket").asc()
    local = Window.partitionBy(key, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: f(v).over(local) for n, (f, v) in sums.items()})
    totals = rows.groupBy(key, "bucket").agg(*(f(v).alias(n) for n, (f, v) in sums.items()))
    totals = totals.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n > 1")
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "bucket", *(f(F.col(n)).over(before).alias(f"carried_{n}") for n, (f, _) in sums.items()))
    carried = written(carried, "carried")
    n = carried.count()
    if not n:
        discard(carried)
        return out
    out = out.join(F.broadcast(carried) if n <= BROADCAST_ROWS else carried, [key, "bucket"], "left")
    for name, (f, _) in sums.items():
        more = F.coalesce(f"carried_{name}", F.lit(0).cast("long"))
        out = out.withColumn(name, F.col(name) + more if f is F.sum else F.col(name).bitwiseXOR(more))
    return out.select(*rows.columns, *sums)


def _bucketed(df: DataFrame, place: str) -> DataFrame:
    return df.withColumn("bucket", F.shiftright(F.col(place), BUCKET_BITS))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, d1, d2, chars): each turn's place in its conversation from 1, a digest of role and text, and its code points."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    number = F.coalesce("turn", F.lit(0).cast("long")), F.col("turn").isNull()
    tied = rows.groupBy("conv_id", number[0].alias("number"), number[1].alias("no_number")).count().where("count > 1").drop("count")
    tied = written(tied, "tied-turns")
    n_tied = tied.count()
    digests = rows.select(
        "conv_id",
        "turn",
        number[0].alias("number"),
        number[1].alias("no_number"),
        F.xxhash64(F.lit(1), "role", "text").alias("d1"),
        F.xxhash64(F.lit(2), "text", "role").alias("d2"),
        F.char_length("text").cast("long").alias("chars"),
        *(["role", "text"] if n_tied else []),
    )
    order = [F.col("turn").asc_nulls_first()]
    if n_tied:  # only turns that share a number are ordered by what they say, so only these carry it
        listed = tied.withColumn("tied", F.lit(True))
        digests = digests.join(F.broadcast(listed) if n_tied <= BROADCAST_ROWS else listed, ["conv_id", "number", "no_number"], "left")
        digests = digests.withColumns({c: F.when(F.col("tied"), F.col(c)) for c in ("role", "text")}).drop("tied")
        order += [F.col("role"), F.col("text")]
    first = F.lit(-(1 << 62)).cast("long")
    digests = digests.withColumn("bucket", F.coalesce(F.shiftright("turn", BUCKET_BITS), first)).drop("number", "no_number")
    digests = written(digests, "turn-digests")
    out = running(digests, "conv_id", order, {"place": (F.sum, F.lit(1).cast("long"))})
    out = written(out.select("conv_id", "place", "d1", "d2", "chars"), "numbered-turns")
    discard(digests)
    discard(tied)
    return out


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of the conversation at the head of their hundred.

    ``turns`` is what ``numbered_turns`` returns. The result is all conv_ids, and the turns (conv_id, depth, d1, d2, chars).
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "d1", "d2", "chars"))).alias("head"))
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place:bigint,d1:bigint,d2:bigint,chars:bigint>>"))
    convs = written(convs.join(heads, "base", "left").select("conv_id", "h", taken.alias("head")), "conversations")
    begun = convs.select("conv_id", F.inline("head")).withColumnRenamed("place", "depth")
    shift = convs.select("conv_id", (F.col("h") - F.size("head")).alias("shift")).where("shift > 0")
    own = turns.where(F.col("place") > h).join(shift, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("shift", F.lit(0))).alias("depth"), "d1", "d2", "chars")
    return convs.select("conv_id"), written(_bucketed(begun.unionByName(own), "depth"), "rebuilt-turns")


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, chars): the keys of each prefix and of the one before it."""
    one, two = F.xxhash64(F.lit(3), "depth", "d1", "d2"), F.xxhash64(F.lit(4), "d2", "depth", "d1")
    keyed = running(turns, "conv_id", [F.col("depth")], {"p1": (F.bit_xor, one), "p2": (F.bit_xor, two)})
    before = F.col("p1").bitwiseXOR(one).alias("q1"), F.col("p2").bitwiseXOR(two).alias("q2")
    return written(keyed.select("conv_id", *KEY, *before, "chars"), "paths")


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, block, ids): the conversations that end at a node, ascending and comma-joined, in blocks of 65,536 ids at most."""
    blocks = ends.groupBy(*KEY, F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    return blocks.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))


def _end_digests(blocks: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256), reading each node's blocks in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if node == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(ids.encode())
            yield _told(out)
        if key is not None:
            yield _told([(*key, digest.hexdigest())])

    def _told(rows: list[tuple]) -> pa.RecordBatch:
        types = {"depth": pa.int64(), "p1": pa.int64(), "p2": pa.int64(), "ends_sha256": pa.string()}
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

    ordered = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return mapped(ordered, run, "depth long, p1 long, p2 long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id; parents of many children are broadcast, so that none of them is one task's."""
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    many, key = parents.where(F.col("n_children") >= MANY_CHILDREN).drop("n_children"), ["depth", "q1", "q2"]
    if many.count() > BROADCAST_PARENTS:
        return nodes.join(parents.drop("n_children"), key, "left")
    of_many = nodes.join(F.broadcast(many), key)
    rest = nodes.join(F.broadcast(many), key, "left_anti")
    few = parents.where(F.col("n_children") < MANY_CHILDREN).drop("n_children")
    return of_many.unionByName(rest.join(few, key, "left"))


def prefix_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations.

    ``convs`` has every conv_id, ``turns`` (conv_id, depth, d1, d2, chars, bucket) as ``rebuilt`` returns them. The
    result has conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    zero = F.lit(0).cast("long")
    paths = paths_of(turns)
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"end.{c}", zero).alias(c) for c in KEY))
    ends = written(ends, "ends")

    sequences = ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    inside = paths.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).distinct()
    inside = written(inside, "proper-prefixes")
    leaves = sequences.join(inside, KEY, "left_anti").withColumn("leaf", F.lit(True))
    rest = sequences.join(inside, KEY, "left_semi").withColumn("leaf", F.lit(False))
    sequences = written(leaves.unionByName(rest).select("conv_id", "weight", "leaf"), "sequences")

    rows = paths.join(sequences, "conv_id")
    roots = sequences.select(
        *(zero.alias(c) for c in KEY), *(F.lit(None).cast("long").alias(c) for c in ("q1", "q2")), zero.alias("chars"), "conv_id", "weight", "leaf"
    )
    rows = written(rows.unionByName(roots), "weighted-prefixes")
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("leaf_id"),
        F.max("chars").alias("chars"),
        F.max("q1").alias("q1"),
        F.max("q2").alias("q2"),
    )
    nodes = written(nodes, "nodes")
    saved = nodes.select(F.col("leaf_id").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    on_paths = rows.where("leaf").select("conv_id", *KEY).join(saved, ["conv_id", "depth"], "left")
    on_paths = written(_bucketed(on_paths.withColumn("saved", F.coalesce("saved", zero)), "depth"), "leaf-paths")
    below = running(on_paths, "conv_id", [F.col("depth").desc()], {"below": (F.sum, F.col("saved"))}, falling=True)
    below = below.groupBy(*KEY).agg(F.sum("below").alias("saved_tokens"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    children = children.agg(F.count("*").alias("n_children"))
    out = nodes.join(below, KEY).join(children, KEY, "left").join(_end_digests(end_lists(ends)), KEY, "left")
    out = written(out.withColumn("n_children", F.coalesce("n_children", zero)), "trie")
    for used in (paths, ends, inside, sequences, rows, nodes, on_paths):
        discard(used)
    return _with_parents(out).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    numbered = numbered_turns(conversations)
    convs, turns = rebuilt(numbered)
    discard(numbered)
    out = prefix_nodes(convs, turns)
    discard(turns)
    return out
