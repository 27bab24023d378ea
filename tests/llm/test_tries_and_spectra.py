"""Prefix tries, whitening and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lorespring.llm import decontamination, prefix_trie, whitening

TURNS = "conv_id long, turn long, role string, text string, bucket string, depth int, p1 string"


def trie_of(rows):
    """The nodes by recursion over whole sequences."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = 0 if children[node] else 1
        for child in children[node]:
            n, s = below(child)
            leaves, saved = leaves + n, saved + s
        return leaves, saved

    out = set()
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(ms), len(node), parent, len(ms), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 207, 1000, 1001]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello", "yes", "é\U0001f600", ""])))
    rows += [(7, None, None, None), (7, None, "user", "first"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "assistant", "b")]
    rows += [(None, 0, "user", "nobody"), (900, 0, "user", "only"), (999, -3, "user", "x"), (999, 2, None, "y")]
    rows += [(c, t, "user", f"t{t}") for c in (300, 301, 302) for t in range(40)]
    return rows


@pytest.mark.parametrize("bits, children, broadcast", [(12, 256, 100_000), (2, 2, 100_000), (1, 2, 0)])
def test_trie_equals_recursion(spark, monkeypatch, bits, children, broadcast):
    for name, value in (("BUCKET_BITS", bits), ("BLOCK_BITS", bits), ("MANY_CHILDREN", children), ("BROADCAST_PARENTS", broadcast), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = some_turns(bits)
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS).repartition(5)
    got = [tuple(r) for r in prefix_trie.conversation_trie(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_of(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    short = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = prefix_trie.conversation_trie(spark.createDataFrame([(short, 1, "user", "a", None, None, None)], TURNS)).collect()
    want = hashlib.sha256(str(short).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(short, 0, None, 1, 0, 1, 0, want)]


VECTORS = "vec_id long, embedding array<double>, label int, x string, component string"


def whitened_by_numpy(vectors):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    far = n * x - sums
    return n, values, far / n @ q / np.sqrt(np.where(values > 0, values, 1)), (far * far).sum(axis=1)


@pytest.mark.parametrize("width, rows, parts", [(50, 400, 64), (50, 400, 0), (8, 100, 64)])
def test_whitening_equals_numpy(spark, monkeypatch, width, rows, parts):
    monkeypatch.setattr(whitening, "PARTS", parts)
    rng = np.random.default_rng(width)
    vectors = (rng.normal(size=(rows, width)) * (1 + np.arange(width) % 7)).tolist()
    vectors += vectors[:30]
    odd = [(900, None), (901, [float("nan")] * width), (902, [1.0] * (width - 1) + [None]), (903, [float("inf")] * width), (904, [])]
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in enumerate(vectors)] + [(i, v, None, None, None) for i, v in odd], VECTORS)
    got = whitening.whiten(frame.repartition(4)).toPandas()
    n, values, want, deviation = whitened_by_numpy(vectors)
    k = min(16, width)
    assert set(got["vec_id"]) == set(range(len(vectors))) and len(got) == k * len(vectors)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((table * want[:, :k]).sum(axis=0))
    assert np.abs(table * sign - want[:, :k]).max() < 1e-9
    assert got["n"].unique().tolist() == [n] and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation.tolist()
    assert np.allclose(got.groupby("component")["explained"].first(), values[:k] / values.sum(), rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    rng = np.random.default_rng(2)
    flat = [(1000 + i, [*map(float, rng.integers(0, 9, 3)), *[5.0] * 57], 0, "", "") for i in range(60)]  # rank 3 of 60
    same = [(i, [1.0, 2.0], 0, "", "") for i in range(5)]  # one distinct vector: no component
    pair = [(None, [1.0, 2.0, 3.0], 0, "", ""), (50, [2.0, 2.0, 3.0], 0, "", "")]
    huge = [(60, [float(1 << 39)], 0, "", ""), (61, [-float(1 << 39)], 0, "", ""), (62, [float(1 << 41)], 0, "", "")]
    got = whitening.whiten(spark.createDataFrame(flat + same + pair + huge, VECTORS)).collect()
    of = lambda ids: sorted((r.vec_id or -1, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in got if r.vec_id in ids)
    assert of({None, 50}) == [(-1, 1, 2, 64**2, 1.0), (50, 1, 2, 64**2, 1.0)]
    assert not of(range(5)) and not of({62}) and of({60, 61}) == [(60, 1, 2, None, 1.0), (61, 1, 2, None, 1.0)]
    assert {r.component for r in got if r.vec_id and r.vec_id >= 1000} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in got)


DOCS = "doc_id long, text string, id string, digest int, place int, window string, spans int"
ITEMS = "item_id long, text string, words string, hash int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits_of(text, items):
    own, hit, found = words_of(text), set(), set()
    for item, its in items:
        ws = words_of(its)
        n = min(10, len(ws))
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
        for i in range(len(own) - n + 1) if n else ():
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {item} - {None}
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit), hit


def some_documents(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Äpfel", "ÀB", "日本", "42"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(11, 40))) for i in range(12)] + [(20, "One, TWO three!"), (21, "w1"), (22, None), (23, "?!"), (None, "w2 w3"), (3, prose(12))]
    items += [items[0], (30, items[0][1])]
    docs = []
    for i in range(60):
        text = prose(rng.randrange(0, 60))
        if i % 3 == 0:
            held = rng.choice(items[:12])[1].split()
            at = rng.randrange(len(held) - 9)
            text += " — " + ", ".join(w.upper() if w.isascii() else w for w in held[at : at + rng.randrange(8, 20)]) + ". " + prose(5)
        docs.append((i, text))
    docs += [(None, "one-two.three"), (None, None), (70, ""), (71, "\n\t"), (1, docs[3][1]), docs[0], docs[0], (72, prose(3000) + " " + items[5][1])]
    return docs, items


@pytest.mark.parametrize("windows, docs_most, piece", [(1_000_000, 100_000, 4096), (7, 0, 4)])
def test_contamination_equals_brute_force(spark, monkeypatch, windows, docs_most, piece):
    for name, value in (("BROADCAST_WINDOWS", windows), ("BROADCAST_DOCS", docs_most), ("PIECE", piece)):
        monkeypatch.setattr(decontamination, name, value)
    docs, items = some_documents(piece)
    docs, items = ([d for d in docs if d[0] != 72], items[:6] + items[12:]) if windows == 7 else (docs, items)
    frame = spark.createDataFrame([(*d, "x", 1, 2, "y", 3) for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*b, "x", 1) for b in items], ITEMS)
    got = sorted((tuple(r) for r in decontamination.contamination(frame, bench).collect()), key=str)
    assert got == sorted(((d, *hits_of(t, items)[:5]) for d, t in docs), key=str)


def test_passages_are_cut_out_and_documents_dropped(spark):
    docs, items = some_documents(1)
    frame = spark.createDataFrame([(*d, "x", 1, 2, "y", 3) for d in docs], DOCS)
    bench = spark.createDataFrame([(*b, "x", 1) for b in items], ITEMS)
    cut = decontamination.without_passages(frame, bench)
    clean = decontamination.clean_documents(frame, bench)
    assert cut.columns == clean.columns == frame.columns

    def left(text):
        hit = hits_of(text, items)[5]
        return [w for i, w in enumerate(words_of(text)) if i not in hit]

    key = lambda x: (str(x[0]), x[1] or [])
    assert sorted(((r.doc_id, words_of(r.text)) for r in cut.collect()), key=key) == sorted(((d, left(t)) for d, t in docs), key=key)
    kept = sorted((d, t) for d, t in docs if not hits_of(t, items)[4] and d is not None and t is not None)
    assert sorted((r.doc_id, r.text) for r in clean.where("doc_id is not null and text is not null").collect()) == kept
    one = spark.createDataFrame([(1, "Keep this, — one TWO\nthree — and that.", "", 0, 0, "", 0)], DOCS)
    assert decontamination.without_passages(one, bench).first().text == "Keep this, — — and that."  # a dash that is not ASCII is a word


def test_contamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b", "", 0, 0, "", 0)], DOCS), spark.createDataFrame([(1, "a b", "", 0)], ITEMS)
    none = hashlib.sha256(b"").hexdigest()
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert [tuple(r) for r in decontamination.contamination(docs, bench.limit(0)).collect()] == [(1, 2, 0, 0, none, False)]
    assert decontamination.without_passages(docs, bench.limit(0)).collect() == docs.collect()
