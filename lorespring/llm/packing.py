"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` in a transformer layer (matrix products and attention
within the piece). Each document's ids, closed by an end id, are cut into pieces of a full sequence and a rest. The
rests are dealt to packing groups of bounded size; within a group, pieces in descending order go to the sequence of
lowest cost that still has room for them, and a piece that fits nowhere whole is cut over the emptiest sequences. A
group opens just as many sequences as its tokens need, so at most one sequence's worth of padding remains a group.

Defined results: a null text packs as an empty one, which is its end id alone; texts of any length are packed whole;
repeated rows are packed each; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespring.llm.common import grouped, in_parts, mapped
from lorespring.llm.word_tokens import encoder

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Documents a packing group gets on average; a group is one task's unit of work.
GROUP_DOCS = 2048
#: Up to about so many groups, each is a partition of the shuffle.
MANY_PARTS = 4096

_CUT = "doc_id long, start long, length long, doc_tokens long, spread long, ids binary, crc long"
_PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces into ceil(total / capacity) sequences: (piece, start in it, length, sequence, offset).

    Pieces descend in length, ties in the order given. The heap holds the sequences by cost; those without room for
    the piece at hand are set aside and come back when the pieces have become smaller.
    """
    n = -(-int(lengths.sum()) // capacity)
    used = [0] * n
    heap = [(0.0, s) for s in range(n)]
    aside: list[tuple[int, int, float]] = []  # (-room, sequence, cost)
    out = []

    def put(piece: int, start: int, length: int, s: int, cost: float) -> None:
        out.append((piece, start, length, s, used[s]))
        used[s] += length
        if used[s] < capacity:
            heapq.heappush(heap, (cost + LINEAR * length + QUADRATIC * length * length, s))

    for piece in np.argsort(-lengths, kind="stable").tolist():
        left, start = int(lengths[piece]), 0
        while aside and -aside[0][0] >= left:
            _, s, cost = heapq.heappop(aside)
            heapq.heappush(heap, (cost, s))
        while heap and capacity - used[heap[0][1]] < left:
            cost, s = heapq.heappop(heap)
            heapq.heappush(aside, (used[s] - capacity, s, cost))
        if heap:
            cost, s = heapq.heappop(heap)
            put(piece, 0, left, s, cost)
            continue
        while left:  # fits nowhere whole: cut it over the sequences with most room
            room, s, cost = heapq.heappop(aside)
            part = min(left, -room)
            put(piece, start, part, s, cost)
            start, left = start + part, left - part
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, ranks_path: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``ranks_path`` may name the tokenizer's vocabulary as byte-level ranks, which encode new words faster.
    """
    n_groups = max(1, -(-docs.count() // GROUP_DOCS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, ranks_path), end_id.to_bytes(4, "little")
        row = 0
        for part in in_parts(batches):
            cols = [[] for _ in range(7)]
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = enc.ids_of(text or "") + end
                total = len(ids) // 4
                row += 1
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    n, full = len(piece) // 4, len(piece) == 4 * capacity
                    kept = None if full else np.frombuffer(piece, "<u4").tobytes()
                    for c, v in zip(cols, (doc, start, n, total, row, kept, zlib.crc32(piece)), strict=True):
                        c.append(v)
            types = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "start", "length", "doc_tokens", "spread", "ids", "crc"],
            )

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "crc", "spread"], kind="stable", ignore_index=True)
        base = int(key[0]) << 32
        rest = np.flatnonzero(group["length"].to_numpy() < capacity)
        full = group[group["length"] == capacity]
        lengths = group["length"].to_numpy()[rest]
        ids = group["ids"].to_numpy()
        rows = []
        for piece, start, length, s, offset in assign(lengths, capacity):
            r = int(rest[piece])
            whole = length == lengths[piece]
            crc = group["crc"][r] if whole else zlib.crc32(ids[r][4 * start : 4 * (start + length)])
            rows.append((group["doc_id"][r], group["start"][r] + start, length, crc, group["doc_tokens"][r], base + s, offset))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        packed = pd.DataFrame(rows, columns=names)
        first = base + -(-int(lengths.sum()) // capacity)
        whole = pd.DataFrame(
            {
                "doc_id": full["doc_id"],
                "start": full["start"],
                "length": full["length"],
                "ids_crc32": full["crc"],
                "doc_tokens": full["doc_tokens"],
                "sequence_id": np.arange(first, first + len(full), dtype="int64"),
                "offset": 0,
            }
        )
        return pd.concat([packed, whole], ignore_index=True)[names] if len(packed) else whole[names]

    pieces = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, _CUT)
    group = F.pmod(F.xxhash64("doc_id", "start", "spread"), F.lit(n_groups)).alias("packing_group")
    pieces = pieces.withColumn("packing_group", group).repartition(min(n_groups, MANY_PARTS + n_groups // 64), "packing_group")
    return grouped(pieces.groupBy("packing_group"), place, _PIECE)
