"""Near-duplicate passages by compact windows.

The tokens of a text are its 5-word shingles in order; a passage is a run of ``PASSAGE`` tokens (50 words). Under a
hash function, the Cartesian tree over the tokens' hashes has one node for each compact window: all passages of which
that node is the minimum. The nodes wide enough to hold a passage are the minima of a sliding passage; each is stored
once, with the interval of passages it stands for. Windows of all texts that share hash and minimum form a group.

Within a text the intervals of different hashes are joined: where the windows of two hashes overlap, all passages in
the overlap share both minima, and the two form a signature. Texts that share a signature are candidates: each is
compared with the first of its group. Candidates are laid on their minima; a pair of passages is a repeat if its
shingles are 0.75 alike or more.

Passages that no repeat covers so far are left, even where other passages of their interval are repeats. They are
compared with all members of their groups, covered or not, that share one of the 7 rarest tokens of a passage: any two
passages with 40 of 46 tokens in common do, while texts that share a line of 40 words differ in more tokens than that.
Large groups are gone through in slices of growing size, until each passage is covered or has met them all. So every
exact repeat is found, and every near repeat in place whose passages share a signature, but for those that only agree
inside long runs of one token (below). A passage that repeats its own tokens counts them as often as it has them.
Neighbouring repeats of two texts join into spans.

Where one word is repeated, tokens are equal in a row, and each of their places would meet each place of all such texts.
Passages of one token repeat each other wherever they are, and repeat those with 40 places of it: all of them meet the
longest run of the token. In other passages a run ends, and only the places near its ends are looked up. Exact repeats
share these; near ones do where the ends of their runs lie less than 8 places apart.

Equal texts are one text until the end, and each of them is a repeat as a whole.

Defined results: a null, empty or blank text and one of fewer than 50 words has no passage and no row; texts of any
length are searched whole; a passage repeated within one text counts if its places do not overlap; rows that share a
doc_id count as one document; rows with a null doc_id are left out; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespring.llm.common import cogrouped, discard, grouped, in_parts, mapped, written
from lorespring.llm.shingles import SHINGLE, mixed, token_sequences

#: Tokens of a passage: 50 words.
PASSAGE = 46
#: Hash functions; each two of them make a signature.
HASHES = 4
PAIRS = tuple((g, h) for h in range(HASHES) for g in range(h))
#: Tokens of a passage that agree in place, at least, for a similarity of 0.75: 40 / (46 + 46 - 40).
IN_PLACE = 40
#: Two passages that share 40 of 46 tokens share one of the 7 rarest of each.
RAREST = PASSAGE - IN_PLACE + 1
#: Places of a run of equal tokens that are looked up, from either end: more than two passages 0.75 alike in place differ in.
RUN_ENDS = PASSAGE - IN_PLACE + 2
#: Tokens whose count every task knows; only the order of tokens depends on it.
FREQUENT = 400_000
#: Members of a group that what is left is compared with at first; so many times more up to each later round.
LEADERS, MORE = 8, 8
#: Passages that are compared as sets at a time.
SET_PASSAGES = 8192
#: Windows of a block, at first and once there are many blocks.
BLOCK_WINDOWS, MANY_BLOCKS, LARGE_BLOCK = 100_000, 4096, 4_000_000
#: Tables of texts to verify up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_DOCS = 1_000_000
#: A stored window: its group, text, first passage, and from there to the last passage and to the minimum.
_PACKED = np.dtype([("key", "<i8"), ("text", "<i8"), ("lo", "<i4"), ("wide", "u1"), ("at", "u1")])
#: Passages of a text that are one token, or that one token has ``IN_PLACE`` places of.
_RUN = np.dtype([("token", "<i8"), ("s", "<i4"), ("e", "<i4"), ("whole", "u1")])
#: A signature of a text: the text's first document, first passage, and from there to the last passage and to the minimum.
_SIGNED = np.dtype([("sig", "<i8"), ("doc", "<i8"), ("text", "<i8"), ("s", "<i4"), ("wide", "u1"), ("at", "u1")])
#: Passages of two texts to compare: those of a from low to high (exclusive) with those of b that lie ``shift`` before.
_STRETCH = np.dtype([("a", "<i8"), ("b", "<i8"), ("shift", "<i4"), ("low", "<i4"), ("high", "<i4")])
_PLACES = np.dtype([("text", "<i8"), ("s", "<i4"), ("e", "<i4")])
_SEEDS = np.random.default_rng(8191).integers(0, 1 << 64, HASHES, dtype=np.uint64)


def text_id(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def minima(tokens: np.ndarray, seed: np.uint64, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows that hold a passage: place of the minimum, first and last passage start.

    ``starts`` are the passages to look at, where the tokens are those of several texts in a row. Ties fall to the
    leftmost token: each hash carries its place in its low bits. Sliding minima come from doubling their width.
    """
    n = len(tokens) - PASSAGE + 1
    starts = np.arange(max(n, 0)) if starts is None else starts
    if not len(starts):
        return (np.empty(0, dtype=np.int64),) * 3
    bits = len(tokens).bit_length()
    least = mixed(tokens.astype(np.uint64) ^ seed) >> np.uint64(bits) << np.uint64(bits)
    least |= np.arange(len(tokens), dtype=np.uint64)
    width = 1
    while 2 * width <= PASSAGE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[PASSAGE - width :])
    at = (least[starts] & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return at[first], starts[first], starts[last]


def token_runs(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages with ``least`` places of one token or more: the token, first and last passage of each run of them."""
    order = np.argsort(tokens, kind="stable")
    a, b = order[: max(0, len(tokens) - least + 1)], order[least - 1 :]
    good = (tokens[a] == tokens[b]) & (b - a < PASSAGE)
    a, b = a[good], b[good]
    s, e = np.maximum(b - PASSAGE + 1, 0), np.minimum(a, len(tokens) - PASSAGE)
    new = np.flatnonzero(np.append(True, (tokens[a[1:]] != tokens[a[:-1]]) | (s[1:] > e[:-1] + 1))) if len(a) else a
    return tokens[a[new]], s[new], e[np.append(new[1:], len(a)) - 1] if len(a) else a


def _packed_runs(tokens: np.ndarray) -> bytes | None:
    """The runs of a text, packed; None for none, as in most texts."""
    # Six other tokens between equal ones leave so many neighbours equal.
    if len(tokens) < PASSAGE or (tokens[1:] == tokens[:-1]).sum() < 2 * IN_PLACE - PASSAGE - 1:
        return None
    found = []
    for whole, least in ((0, IN_PLACE), (1, PASSAGE)):
        token, s, e = token_runs(tokens, least)
        part = np.empty(len(s), dtype=_RUN)
        part["token"], part["s"], part["e"], part["whole"] = token, s, e, whole
        found.append(part)
    return np.concatenate(found).tobytes() or None


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n, runs, low, high, row) of each document with a passage.

    Texts are read and cut into tokens here only; ``low`` and ``high`` are the halves of its ``n`` tokens.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("runs", "low", "high")])

    def scan(batches):
        for part in in_parts(batches, 1):
            ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            long = [(i, t, r) for i, t, r in zip(ids, texts, token_sequences(texts), strict=True) if len(r) >= PASSAGE]
            halves = [[(r >> k).astype("<u4").tobytes() for *_, r in long] for k in (0, 32)]
            yield _batch([[i for i, *_ in long], [text_id(t) for _, t, _ in long], [len(r) for *_, r in long], [_packed_runs(r) for *_, r in long], *halves], schema)

    scanned = mapped(docs, scan, "doc_id long, text long, n long, runs binary, low binary, high binary")
    return written(scanned.withColumn("row", F.monotonically_increasing_id()), "passage-scan")


def _dealt(rows: np.ndarray, block: np.ndarray) -> pd.DataFrame:
    """(block, rows) of each block, the rows packed."""
    order = np.argsort(block, kind="stable")
    rows, block = rows[order], block[order]
    cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
    spans = list(zip(cuts, cuts[1:]))
    return pd.DataFrame({"block": block[cuts[:-1]].astype("int64"), "rows": [rows[a:b].tobytes() for a, b in spans]})


def _block(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of hashes; ``pmod`` in Spark."""
    return ids % n_blocks


def _unpacked(rows: Iterable[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=kind)


def _shared_windows(scanned: DataFrame, n_blocks: int) -> DataFrame:
    """Windows whose minimum two places or more share, packed by the block of their text: block, rows."""
    schema = pa.schema([("block", pa.int64()), ("rows", pa.binary())])

    def cut(batches):
        for part in in_parts(batches, 1):
            halves = [[np.frombuffer(t, dtype="<u4").astype(np.int64) for t in part.column(c).to_pylist()] for c in ("low", "high")]
            own = {t: low | high << 32 for t, low, high in zip(part.column("text").to_pylist(), *halves, strict=True)}
            ids, row = np.array(list(own), dtype=np.int64), np.concatenate(list(own.values()))
            high = np.cumsum([len(r) for r in own.values()])
            low = np.append(0, high[:-1])
            text_of = np.repeat(np.arange(len(ids)), high - low)
            # Passages of one token are left to ``_run_repeats``.
            other = np.concatenate(([0], np.cumsum(row[1:] != row[:-1])))
            starts = np.flatnonzero(high[text_of] - np.arange(len(row)) >= PASSAGE)
            starts = starts[other[starts + PASSAGE - 1] > other[starts]]
            found = []
            for h in range(HASHES):
                at, lo, hi = minima(row, _SEEDS[h], starts)
                of = text_of[at]
                part = np.empty(len(at), dtype=_PACKED)
                part["key"] = (mixed(row[at].astype(np.uint64) ^ _SEEDS[h]) >> np.uint64(3)).astype(np.int64)
                part["key"] = part["key"] * HASHES + h
                part["text"], part["lo"], part["wide"], part["at"] = ids[of], lo - low[of], hi - lo, at - lo
                found.append(part)
            every = np.concatenate(found)
            yield pa.RecordBatch.from_pandas(_dealt(every, (mixed(every["key"].astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int64)), schema)

    def shared(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        every = _unpacked(rows["rows"], _PACKED)
        every = every[np.lexsort((every["lo"], every["text"], every["key"]))]
        again = np.zeros(len(every), dtype=bool)
        again[1:] = every[1:] == every[:-1]
        every = every[~again]
        same = every["key"][1:] == every["key"][:-1]
        keep = np.zeros(len(every), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        every = every[keep]
        return _dealt(every, _block(every["text"], n_blocks))

    packed = mapped(scanned.select("text", "low", "high"), cut, "block long, rows binary")
    return grouped(packed.groupBy("block"), shared, "block long, rows binary")


def _windows(docs: DataFrame, n_blocks: int) -> DataFrame:
    """The same of documents (doc_id, text), as rows: key, text, lo, hi, at."""
    out = pa.schema([(c, pa.int64()) for c in ("key", "text", "lo", "hi", "at")])

    def unpacked(batches):
        for batch in batches:
            w = _unpacked(batch.column("rows").to_pylist(), _PACKED)
            lo = w["lo"].astype(np.int64)
            yield _batch([w["key"], w["text"], lo, lo + w["wide"], lo + w["at"]], out)

    return mapped(_shared_windows(_scanned(docs), n_blocks), unpacked, "key long, text long, lo long, hi long, at long")


def _signatures(windows: DataFrame, first_docs: DataFrame, n_blocks: int) -> DataFrame:
    """The signatures of all texts, packed by the blocks of their text and of themselves: of, block, rows."""

    def signed(key: tuple, rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        w = {n: c.astype(np.int64) for n, c in ((n, _unpacked(rows["rows"], _PACKED)[n]) for n in _PACKED.names)}
        found = joined_intervals(w["key"], w["text"], w["lo"], w["lo"] + w["wide"], w["lo"] + w["at"], pairs=PAIRS)
        out = np.empty(len(found), dtype=_SIGNED)
        out["sig"], out["text"], out["s"] = found["sig"], found["text"], found["s"]
        out["wide"], out["at"] = found["e"] - found["s"], found["c"] - found["s"]
        out["doc"] = found["text"].map(first.set_index("text")["doc_id"])
        return _dealt(out, _block(out["sig"], n_blocks)).assign(of=key[0])[["of", "block", "rows"]]

    by_block = (windows.groupBy("block"), first_docs.groupBy(F.pmod("text", F.lit(n_blocks))))
    return cogrouped(*by_block, signed, "of long, block long, rows binary")


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of signature, the first of a group being its text of the smallest document, and each row's first."""
    rows = rows[np.lexsort((rows["s"], rows["text"], rows["doc"], rows["sig"]))]
    new = np.flatnonzero(np.diff(rows["sig"], prepend=-1))
    return rows, np.repeat(new, np.diff(np.append(new, len(rows))))


def _meetings(signed: DataFrame, n_blocks: int) -> DataFrame:
    """Stretches (a, b, shift, low, high): each member of a group with the first of it, laid on their minima."""

    def met(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, first = _groups(_unpacked(rows["rows"], _SIGNED))
        other = np.flatnonzero(first != np.arange(len(x)))
        x, y = x[other], x[first[other]]
        s_a, s_b = x["s"].astype(np.int64), y["s"].astype(np.int64)
        e_a, e_b, by_minima = s_a + x["wide"], s_b + y["wide"], s_a + x["at"] - s_b - y["at"]
        low = np.maximum(s_a, np.minimum(e_a, s_b + by_minima))
        high = np.maximum(low, np.minimum(e_a, e_b + by_minima)) + 1
        shift = low - np.maximum(s_b, np.minimum(e_b, low - by_minima))
        keep = (x["text"] != y["text"]) | (np.abs(shift) >= PASSAGE + SHINGLE - 1)
        out = np.empty(int(keep.sum()), dtype=_STRETCH)
        for name, column in zip(_STRETCH.names, (x["text"], y["text"], shift, low, high), strict=True):
            out[name] = column[keep]
        return _dealt(out, (mixed((out["a"] ^ out["b"]).astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int64))

    def joined(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        every = _unpacked(rows["rows"], _STRETCH)
        every = every[np.lexsort((every["shift"], every["b"], every["a"]))]
        new = np.zeros(len(every), dtype=bool)
        new[:1] = True
        for name in ("a", "b", "shift"):
            new[1:] |= every[name][1:] != every[name][:-1]
        first = np.flatnonzero(new)
        out = pd.DataFrame({n: every[n][first].astype("int64") for n in ("a", "b", "shift")})
        for name, function in (("low", np.minimum), ("high", np.maximum)):
            out[name] = function.reduceat(every[name].astype(np.int64), first) if len(first) else every[name].astype(np.int64)
        return out

    packed = grouped(signed.groupBy("block"), met, "block long, rows binary")
    return grouped(packed.groupBy("block"), joined, "a long, b long, shift long, low long, high long")


def _pool(signed: DataFrame, hits: DataFrame, n_blocks: int) -> DataFrame:
    """(text, places): of groups with a passage that no hit covers, the members' passages, packed by text."""

    def uncovered(_key: tuple, rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        x = _unpacked(rows["rows"], _SIGNED)
        s = x["s"].astype(np.int64)
        sigs = np.unique(x["sig"][~covered(x["text"], s, s + x["wide"], *(runs[c].to_numpy() for c in ("text", "at", "n")))])
        return _dealt(sigs, _block(sigs, n_blocks))

    def members(_key: tuple, rows: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        x, first = _groups(_unpacked(rows["rows"], _SIGNED))
        several = np.bincount(first, minlength=len(x))[first] > 1
        x = x[several & np.isin(x["sig"], _unpacked(left["rows"], np.dtype("<i8")))]
        out = np.empty(len(x), dtype=_PLACES)
        out["text"], out["s"], out["e"] = x["text"], x["s"], x["s"] + x["wide"]
        return _dealt(out, _block(out["text"], n_blocks))

    def by_text(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        every = _unpacked(rows["rows"], _PLACES)
        every = every[np.lexsort((every["e"], every["s"], every["text"]))]
        every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]
        cuts = [*np.flatnonzero(np.diff(every["text"], prepend=-1)).tolist(), len(every)]
        places = np.stack([every["s"], every["e"]], axis=1)
        return pd.DataFrame({"text": every["text"][cuts[:-1]].astype("int64"), "places": [places[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    by_block = (signed.groupBy("of"), _sides(hits).groupBy(F.pmod("text", F.lit(n_blocks))))
    left = cogrouped(*by_block, uncovered, "block long, rows binary")
    found = cogrouped(signed.groupBy("block"), left.groupBy("block"), members, "block long, rows binary")
    return grouped(found.groupBy("block"), by_text, "text long, places binary")


def joined_intervals(
    key: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, *_more: np.ndarray, pairs=((0, 1), (2, 3))
) -> pd.DataFrame:
    """Signatures (sig, text, s, e, c): from passage s to e, windows of both hashes of a pair overlap.

    ``c`` is the place of the first hash's minimum, by which two texts with the signature are aligned. Nothing but the
    two minima is in a signature: repeats need no further words in common. More columns than these are ignored.

    The intervals of one text and hash are disjoint. All ends cut the passages into segments; each hash's window over
    a segment is found by carrying the last interval start forward.
    """
    out = []
    names, place = np.unique(text, return_inverse=True)
    for pair in pairs:
        mine = np.isin(key % HASHES, pair)
        k, p, a, b, c = key[mine], place[mine], lo[mine], hi[mine] + 1, at[mine]
        step = int(b.max(initial=0)) + 1
        starts, ends = p * step + a, p * step + b
        cuts = np.unique(np.concatenate([starts, ends]))
        over = []
        for h in pair:
            of = k % HASHES == h
            state = np.zeros(len(cuts), dtype=np.int64)
            state[np.searchsorted(cuts, ends[of])] = -1
            state[np.searchsorted(cuts, starts[of])] = np.flatnonzero(of) + 1
            last = np.maximum.accumulate(np.where(state != 0, np.arange(len(cuts)), 0))
            over.append(np.maximum(state[last], 0) if len(cuts) else state)
        both = (over[0] > 0) & (over[1] > 0)
        x, y = over[0][both] - 1, over[1][both] - 1
        sig = mixed(k[x].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(k[y].astype(np.uint64)))
        begin, end = cuts[both], np.append(cuts[1:], 0)[both] - 1
        found = {"text": names[p[x]], "s": begin - p[x] * step, "e": end - p[x] * step, "c": c[x]}
        out.append(pd.DataFrame({"sig": (sig >> np.uint64(1)).astype("int64")} | found))
    return pd.concat(out, ignore_index=True)


def _kinds(n: int, keys: np.ndarray, texts: int = 1) -> np.ndarray:
    """How many kinds of tokens each of n passages has: ``keys`` are sorted tokens, with their place above the lowest bit.

    A token counts from the first passage that it is the first of its kind in up to the one that begins with it. Each
    place ends one such stretch a text, so only the beginnings are counted.
    """
    place = ((keys & np.uint64(0xFFFFFFFF)) >> np.uint64(1)).astype(np.int64)
    first = np.maximum(place - PASSAGE + 1, 0)
    same = (keys[1:] ^ keys[:-1]) < np.uint64(1 << 32)
    np.maximum(first[1:], (place[:-1] + 1) * same, out=first[1:])
    return np.cumsum(np.bincount(first, minlength=n)[:n]) - texts * np.arange(n)


def alike_sets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the passages of x and y from each place on are 0.75 alike or more as sets, tokens being 32-bit numbers.

    Sizes are counted in each text, the union in both texts, laid on each other.
    """
    n = len(x) - PASSAGE + 1
    if n < 1:
        return np.zeros(0, dtype=bool)
    place = np.arange(len(x), dtype=np.uint64) << np.uint64(1)
    keys = [t.astype(np.uint64) << np.uint64(32) | place | np.uint64(k) for k, t in enumerate((x, y))]
    union = _kinds(n, np.sort(np.concatenate(keys)), 2)
    both = _kinds(n, np.sort(keys[0])) + _kinds(n, np.sort(keys[1])) - union
    return 100 * both >= 75 * union


def _in_passages(marks: np.ndarray) -> np.ndarray:
    """How many of the marks are in the passage from each place on."""
    sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int32)))
    return sums[PASSAGE:] - sums[:-PASSAGE]


def compared(x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Laid on each other, where x and y repeat: first passage and number of each run.

    ``inside`` marks the passages to compare. Tokens in place decide first: where so many of a passage's tokens agree,
    the Jaccard similarity is 0.75 or more. The others, as with words put in or left out, are compared as sets.
    """
    n = len(x) - PASSAGE + 1
    hit = (_in_passages(x == y) >= IN_PLACE) & inside[:n]
    other = np.diff((inside[:n] & ~hit).astype(np.int8), prepend=0, append=0)
    at, ends = np.flatnonzero(other == 1), np.flatnonzero(other == -1)
    if len(at):
        size = ends - at + PASSAGE - 1
        begin = np.concatenate(([0], np.cumsum(size)))
        of = np.repeat(at - begin[:-1], size) + np.arange(begin[-1])
        alike = np.zeros(begin[-1], dtype=bool)
        for k in range(0, begin[-1] - PASSAGE + 1, SET_PASSAGES):
            part = of[k : k + SET_PASSAGES + PASSAGE - 1]
            alike[k : k + len(part) - PASSAGE + 1] = alike_sets(x[part], y[part])
        alike &= np.arange(begin[-1]) - np.repeat(begin[:-1], size) < np.repeat(ends - at, size)
        hit[of[alike]] = True
    runs = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return runs[::2], runs[1::2] - runs[::2]


def _aligned(pairs: DataFrame) -> DataFrame:
    """Candidates from pairs of signature rows (a, s_a, e_a, c_a, b, s_b, e_b, c_b), laid on their minima."""
    shift = F.col("c_a") - F.col("c_b")
    i = F.greatest("s_a", F.least(F.col("e_a"), F.col("s_b") + shift))
    last = F.greatest(i, F.least(F.col("e_a"), F.col("e_b") + shift))
    out = pairs.select(
        "a", i.alias("i"), (last - i + 1).alias("n"), "b",
        F.greatest("s_b", F.least(F.col("e_b"), i - shift)).alias("j"),
    )
    return out.where((F.col("a") != F.col("b")) | (F.abs(F.col("i") - F.col("j")) >= PASSAGE + SHINGLE - 1))


def _chosen(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """The row that is read of each text that is named."""
    return written(texts.select("text").distinct().join(firsts, "text").select("row"), "passage-texts")


def _tokens(wanted: DataFrame, scanned: DataFrame) -> DataFrame:
    """(text, tokens) of the rows ``wanted``, tokens as 32-bit numbers."""
    if wanted.count() <= BROADCAST_DOCS:
        wanted = F.broadcast(wanted)
    return scanned.select("row", "text", F.col("low").alias("tokens")).join(wanted, "row", "left_semi").select("text", "tokens")


def _stretches(pairs: DataFrame) -> DataFrame:
    """Of aligned candidates (a, i, n, b, j) the stretches (a, b, shift, low, high).

    A candidate says that the passages of ``a`` from i to i + n - 1 may be those of ``b`` from j on. Candidates of two
    texts with one shift between them are one stretch, from the first to the last.
    """
    i, n = F.col("i"), F.col("n")
    return pairs.groupBy("a", "b", (i - F.col("j")).alias("shift")).agg(F.min(i).alias("low"), F.max(i + n).alias("high"))


def _verified(stretches: DataFrame, scanned: DataFrame, firsts: DataFrame) -> DataFrame:
    """Of stretches the runs that repeat (a, i, b, j, n).

    Only the stretch of each text's tokens is joined to it, and all its passages are compared.
    """
    by_shift = written(stretches, "passage-pairs")
    wanted = _chosen(by_shift.select(F.explode(F.array("a", "b")).alias("text")), firsts)
    tokens = _tokens(wanted, scanned)

    def stretch(first):
        length = (F.col("high") - F.col("low") + PASSAGE - 1) * 4
        return F.substring("tokens", (first * 4 + 1).cast("int"), length.cast("int"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([(c, pa.int64()) for c in ("a", "i", "b", "j", "n")])
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                a, b, shift, low, high = (batch.column(c).to_numpy() for c in ("a", "b", "shift", "low", "high"))
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4") for c in ("left", "right"))
                ends = np.cumsum(high - low + PASSAGE - 1)
                begin = np.append(0, ends[:-1])
                steps = np.bincount(begin, minlength=len(x) + 1) - np.bincount(ends - PASSAGE + 1, minlength=len(x) + 1)
                at, length = compared(x, y, np.cumsum(steps) > 0)
                of = np.searchsorted(begin, at, side="right") - 1
                first = at - begin[of] + low[of]
                yield _batch([a[of], first, b[of], first - shift[of], length], out)

    left = by_shift.join(tokens.withColumnRenamed("text", "a"), "a").withColumn("left", stretch(F.col("low"))).drop("tokens")
    both = left.join(tokens.withColumnRenamed("text", "b"), "b").withColumn("right", stretch(F.col("low") - F.col("shift")))
    both = both.select("a", "b", "shift", "low", "high", "left", "right")
    hits = written(mapped(both, compare, "a long, i long, b long, j long, n long"), "repeats")
    for done in (by_shift, wanted):
        discard(done)
    return hits


def covered(text: np.ndarray, s: np.ndarray, e: np.ndarray, of: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether all passages of a text from s to e are in runs of n passages from ``at`` on in the text ``of``."""
    if not len(of):
        return np.zeros(len(text), dtype=bool)
    _, place = np.unique(np.concatenate([text, of]), return_inverse=True)
    place = place.astype(np.int64) << 32
    starts = place[len(text) :] + at
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate((starts + n)[order])
    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    last = ends[np.append(first[1:], len(starts)) - 1]
    k = np.searchsorted(starts[first], place[: len(text)] + s, side="right") - 1
    return (k >= 0) & (last[k] > place[: len(text)] + e)


def _run_repeats(runs: DataFrame) -> DataFrame:
    """Runs (a, i, b, j, n) of passages with ``IN_PLACE`` places of a token that repeat passages of that token only.

    ``runs`` has (token, text, s, e, whole). All meet the longest run of their token, or if that is in the same text the
    longest of another, or else the first and the last passage of the token in the text, where they don't overlap. If no
    other text has a run, its passages meet the most passages in a row of another that have ``IN_PLACE`` places of it.
    """
    run = F.struct((F.col("e") - F.col("s") + 1).alias("n"), "text", "s").alias("w")
    whole = runs.where("whole = 1").select("token", run)
    best = whole.groupBy("token").agg(F.max("w").alias("p"))
    second = whole.join(best, "token").where("w.text <> p.text").groupBy("token").agg(F.max("w").alias("q"))
    ends = runs.where("whole = 1").groupBy("token", "text").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    rows = runs.where("whole = 0").select("token", "text", "s", "e").join(best, "token").join(second, "token", "left")
    rows = rows.withColumn("w", F.when(F.col("text") != F.col("p.text"), F.col("p")).otherwise(F.col("q")))
    most = runs.where("whole = 0").select("token", run).join(best, "token").where("w.text <> p.text")
    most = most.join(second, "token", "left_anti").groupBy("token").agg(F.max("w").alias("w"))
    alone = runs.where("whole = 1").join(best, "token").where("text = p.text").join(most, "token")
    met = rows.where("w is not null").select("text", "s", "e", "w").unionByName(alone.select("text", "s", "e", "w"))
    met = met.withColumn("i", F.explode(F.sequence("s", "e", "w.n")))
    met = met.select(
        F.col("text").alias("a"), "i", F.col("w.text").alias("b"), F.col("w.s").alias("j"), F.least(F.col("w.n"), F.col("e") - F.col("i") + 1).alias("n")
    )
    own = rows.where("w is null").join(ends, ["token", "text"]).withColumn("i", F.explode(F.sequence("s", "e")))
    apart = F.lit(PASSAGE + SHINGLE - 1)
    j = F.when(F.col("i") - F.col("first") >= apart, F.col("first")).when(F.col("last") - F.col("i") >= apart, F.col("last"))
    own = own.select(F.col("text").alias("a"), "i", F.col("text").alias("b"), j.alias("j"), F.lit(1).cast("long").alias("n"))
    return met.unionByName(own.where("j is not null"))


def _sides(hits: DataFrame) -> DataFrame:
    """(text, at, n) of both texts of each hit."""
    sides = [hits.select(F.col(t).alias("text"), F.col(p).alias("at"), "n") for t, p in ("ai", "bj")]
    return sides[0].unionByName(sides[1]).distinct()


def _uncovered(rows: DataFrame, hits: DataFrame, n_blocks: int) -> DataFrame:
    """The rows (text, s, e and more) with a passage that no hit covers."""
    by_block = [t.groupBy(F.pmod("text", F.lit(n_blocks))) for t in (rows, _sides(hits))]

    def left(_key: tuple, rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        return rows[~covered(*(rows[c].to_numpy() for c in ("text", "s", "e")), *(runs[c].to_numpy() for c in ("text", "at", "n")))]

    return cogrouped(*by_block, left, rows.schema)


def rarest(order: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens are among the ``RAREST`` of a passage: the token's place, and the first and last passage of each run.

    ``order`` is small where a token is rare.
    """
    found = []
    for k in range(0, len(passages), 8192):
        at = passages[k : k + 8192]
        values = sliding_window_view(order, PASSAGE)[at]
        # Of the passages that may hold a place, in order, whether they are looked at and up to which order they take it.
        near = int(at[0]) - PASSAGE + 1
        bound = np.zeros(int(at[-1]) - near + PASSAGE, dtype=order.dtype)
        taken = np.zeros(len(bound), dtype=bool)
        bound[at - near], taken[at - near] = np.partition(values, RAREST - 1, axis=1)[:, RAREST - 1], True
        last = np.maximum.accumulate(np.where(taken, np.arange(len(bound)), -PASSAGE))
        held = np.flatnonzero(np.arange(len(bound)) - last < PASSAGE) - PASSAGE + 1
        meets = sliding_window_view(bound, PASSAGE)[held] >= order[held + near + PASSAGE - 1][:, None]
        meets &= sliding_window_view(taken, PASSAGE)[held]
        row, column = np.divmod(np.flatnonzero(meets), PASSAGE)
        place, passage = held[row] + near + PASSAGE - 1, held[row] + near + column
        new = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(passage) != 1)))
        found.append((place[new], passage[new], passage[np.append(new[1:], len(passage)) - 1]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 3


def inside_runs(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which places are ``RUN_ENDS`` or more places from both ends of a run of equal tokens; texts begin at ``begin``."""
    new = np.append(True, tokens[1:] != tokens[:-1])
    new[begin[begin < len(tokens)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(tokens)))
    at = np.arange(len(tokens)) - np.repeat(first, size)
    return (at >= RUN_ENDS) & (np.repeat(size, size) - at > RUN_ENDS)


def _by_rarest(pool: DataFrame, scanned: DataFrame, firsts: DataFrame, n_blocks: int) -> DataFrame:
    """(sig, text, s, e, c): in the pool's passages from s to e, the token sig at place c is one of the rarest."""
    wanted = _chosen(pool, firsts)
    joined = written(pool.join(_tokens(wanted, scanned), "text").select("text", "places", "tokens"), "left-texts")
    discard(wanted)
    counts = pa.schema([("block", pa.int64()), ("rows", pa.binary())])
    schema = pa.schema([(c, pa.int64()) for c in ("sig", "text", "s", "e", "c")])

    def parts(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                rows = [np.frombuffer(t, dtype="<u4") for t in batch.column("tokens").to_pylist()]
                begin = np.cumsum([0] + [len(r) for r in rows])
                places = [np.frombuffer(p, dtype="<i4").reshape(-1, 2) for p in batch.column("places").to_pylist()]
                row = np.repeat(np.arange(len(places)), [len(p) for p in places])
                s, e = np.concatenate(places).astype(np.int64).T
                inside = []
                for end in (e + 1, e + PASSAGE):
                    steps = np.zeros(begin[-1] + 1, dtype=np.int64)
                    np.add.at(steps, begin[row] + s, 1)
                    np.add.at(steps, begin[row] + end, -1)
                    inside.append(np.flatnonzero(np.cumsum(steps) > 0))
                yield batch.column("text").to_numpy(), begin, np.concatenate(rows), *inside

    def counted(batches):
        for *_, tokens, _, at in parts(batches):
            token, n = np.unique(tokens[at], return_counts=True)
            # Tokens are hashes: ranges of them are blocks of like size.
            block = (token.astype(np.uint64) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)
            yield pa.RecordBatch.from_pandas(_dealt(np.stack([token, n.astype("<u4")], axis=1), block), counts)

    def summed(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        every = _unpacked(rows["rows"], np.dtype("<u4")).reshape(-1, 2).astype(np.int64)
        every = every[np.argsort(every[:, 0], kind="stable")]
        first = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
        n = np.add.reduceat(every[:, 1], first)
        return pd.DataFrame({"token": every[first[n > 3], 0], "n": n[n > 3]})

    usual = grouped(mapped(joined, counted, "block long, rows binary").groupBy("block"), summed, "token long, n long")
    usual = usual.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow().sort_by("token")
    known, often = (usual.column(c).to_numpy().astype(np.uint64) for c in ("token", "n"))

    def postings(batches):
        for texts, begin, tokens, passages, _ in parts(batches):
            tokens = tokens.astype(np.uint64)
            order = mixed(tokens) >> np.uint64(32)
            if len(known):
                k = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                order |= np.where(known[k] == tokens, np.minimum(often[k], np.uint64((1 << 31) - 1)), np.uint64(0)) << np.uint64(32)
            inner = inside_runs(tokens, begin)
            order[inner] = np.iinfo(np.uint64).max
            place, lo, hi = (c[~inner[found[0]]] for found in [rarest(order, passages)] for c in found)
            # A run is of one text: its passages all hold the place, but neighbours in the buffer may be of the next.
            of = np.searchsorted(begin, place, side="right") - 1
            yield _batch([tokens[place].astype(np.int64), texts[of], lo - begin[of], hi - begin[of], place - begin[of]], schema)

    out = written(mapped(joined, postings, "sig long, text long, s long, e long, c long"), "rarest")
    discard(joined)
    return out


def _both(left: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates of each row that is left with each other member of its group (sig, text, s, e, c)."""
    ends = [t.select("sig", F.struct("text", "s", "e", "c").alias(n)) for t, n in ((left, "x"), (members, "y"))]
    both = ends[0].join(ends[1], "sig").where("x != y")
    both = both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    fields = [F.col(f"{o}.{c}").alias(f"{c}_{t}") for o, t in ("xa", "yb") for c in "sec"]
    return _aligned(both.select(F.col("x.text").alias("a"), F.col("y.text").alias("b"), *fields))


def _left_over(pool: DataFrame, hits: DataFrame, scanned: DataFrame, firsts: DataFrame, n_blocks: int) -> list[DataFrame]:
    """Runs (a, i, b, j, n) of the pool's passages that repeat others of the pool, until each is covered or met all."""
    postings = _by_rarest(pool, scanned, firsts, n_blocks)
    several = postings.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1")
    every = written(postings.join(several, "sig"), "rarest-shared")
    discard(postings)
    left = written(_uncovered(every, hits, n_blocks), "left-over")
    share = F.pmod(F.xxhash64("sig", "text", "s"), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("members")
    out, low, high = [], 0, LEADERS
    while not left.isEmpty():
        leaders = every.where((share >= low) & (share < high))
        out.append(_verified(_stretches(_both(left, leaders)), scanned, firsts))
        after = written(_uncovered(left.where(F.col("members") > high), out[-1], n_blocks), "left-over")
        discard(left)
        left, low, high = after, high, high * MORE
    discard(every)
    discard(left)
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words and first_doc_id of each repeated span.

    ``first_doc_id`` is the smallest id of the other documents that a passage of the span was found in, or the
    document's own where it repeats itself only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    def unpacked(batches):
        out = pa.schema([(c, pa.int64()) for c in ("token", "text", "s", "e", "whole")])
        for batch in batches:
            rows = [np.frombuffer(r, dtype=_RUN) for r in batch.column("runs").to_pylist()]
            every = np.concatenate(rows)
            texts = np.repeat(batch.column("text").to_numpy(), [len(r) for r in rows])
            yield _batch([every["token"], texts, *(every[c].astype(np.int64) for c in ("s", "e", "whole"))], out)

    scanned = _scanned(docs)
    listed = written(scanned.select("doc_id", "text", "n").distinct(), "passage-documents")
    firsts = written(scanned.groupBy("text").agg(F.min("row").alias("row")), "passage-rows")
    runs = scanned.where("runs is not null").join(firsts, ["text", "row"], "left_semi").select("text", "runs")
    runs = written(mapped(runs, unpacked, "token long, text long, s long, e long, whole long"), "token-runs")
    total = (listed.agg(F.sum("n")).first()[0] or 0) * 2 * HASHES // PASSAGE
    n_blocks = max(1, min(total // BLOCK_WINDOWS, MANY_BLOCKS), total // LARGE_BLOCK)
    windows = written(_shared_windows(scanned, n_blocks), "windows")

    first_docs = listed.groupBy("text").agg(F.min("doc_id").alias("doc_id"))

    signed = written(_signatures(windows, first_docs, n_blocks), "signatures")
    discard(windows)
    # Each member meets the first of its group. Passages that nothing covers then are looked up by their rarest tokens.
    hits = _verified(_meetings(signed, n_blocks), scanned, firsts).unionByName(written(_run_repeats(runs), "run-repeats"))
    discard(runs)
    pool = written(_pool(signed, hits, n_blocks), "left-members")
    discard(signed)
    if not pool.isEmpty():
        for more in _left_over(pool, hits, scanned, firsts, n_blocks):
            hits = hits.unionByName(more)
    discard(pool)
    discard(scanned)
    discard(firsts)

    # From places to spans, and from texts to documents.
    sides = [
        hits.select(F.col(t).alias("text"), F.col(p).alias("at"), "n", F.col(o).alias("other")) for t, p, o in ("aib", "bja")
    ]
    ids = listed.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    others = ids.select(F.col("text").alias("other"), F.col("first").alias("other_doc"))
    places = sides[0].unionByName(sides[1]).join(others, "other")
    places = places.groupBy("text", "at", "n").agg(F.min("other_doc").alias("source"))
    places = places.withColumn("end", F.col("at") + F.col("n") + PASSAGE + SHINGLE - 2).drop("n")
    whole = listed.join(ids.where("first < last"), "text").select(
        "text", F.lit(0).cast("long").alias("at"), F.col("first").alias("source"), (F.col("n") + SHINGLE - 1).alias("end")
    )
    places = places.unionByName(whole.distinct().select("text", "at", "source", "end"))
    by_text = Window.partitionBy("text").orderBy("at", "end")
    reach = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("begins", F.coalesce((F.col("at") > reach).cast("int"), F.lit(1)))
    places = places.withColumn("span", F.sum("begins").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = places.groupBy("text", "span").agg(
        F.min("at").alias("start_word"), F.max("end").alias("end_word"), F.min("source").alias("first_doc_id")
    )
    return spans.join(listed.select("doc_id", "text"), "text").select(
        "doc_id",
        "start_word",
        "end_word",
        (F.col("end_word") - F.col("start_word")).alias("n_words"),
        "first_doc_id",
    )
