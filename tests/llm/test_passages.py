"""Substring dedup, against brute force on exact repeats and on planted near repeats."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespring.llm import substring_dedup as sd
from lorespring.llm.shingles import mixed


def test_minima_equal_brute_force():
    rng = np.random.default_rng(6)
    for n in (1, 45, 46, 47, 92, 93, 300):
        tokens = rng.integers(0, 50, n)
        value = mixed(tokens.astype(np.uint64) ^ np.uint64(5)).tolist()
        at, lo, hi = sd.minima(tokens, np.uint64(5))
        got = {i: int(a) for a, x, y in zip(at, lo, hi) for i in range(x, y + 1)}
        assert got == {i: i + value[i : i + sd.PASSAGE].index(min(value[i : i + sd.PASSAGE])) for i in range(n - sd.PASSAGE + 1)}


def test_joined_intervals_equal_brute_force():
    rng = random.Random(8)
    rows, inside, want = [], [], defaultdict(set)
    for text in (3, 9, 12):
        cover = [[None] * 60 for _ in range(sd.HASHES)]
        for h in range(sd.HASHES):
            at = 0
            while at < 60:
                end = min(60, at + rng.randrange(1, 12))
                if rng.random() < 0.6:
                    key = rng.randrange(1000) * sd.HASHES + h
                    rows.append((key, text, at, end - 1, at + 7, 5, 0))
                    cover[h][at:end] = [key] * (end - at)
                at = end
        for pair in range(0, sd.HASHES, 2):
            runs = [(cover[pair][i], cover[pair + 1][i]) for i in range(60)]
            inside += [i for i, r in enumerate(runs) if None not in r]
            for i, r in enumerate(runs):
                if None not in r and (i == 0 or runs[i - 1] != r):
                    want[text, i].add(r)
    got = sd.joined_intervals(*(np.array(c) for c in zip(*rows)))
    covered = defaultdict(set)
    for r in got.itertuples():
        for i in range(r.s, r.e + 1):
            covered[r.text, r.sig].add(i)
    assert set(zip(got["text"], got["s"])) >= set(want)
    assert sorted(i for v in covered.values() for i in v) == sorted(inside)


def corpus():
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(4000)}"
    some = lambda n: [word() for _ in range(n)]
    exact, near, short = some(55), some(90), some(40)
    texts = [some(rng.randrange(30, 260)) for _ in range(60)]
    for i in range(0, 20, 2):
        texts[i] = some(40) + exact + some(30)
    for i in range(20, 32):
        changed = list(near)
        if i > 20:
            changed[rng.randrange(len(changed))] = word()
        texts[i] = some(20) + changed + some(60)
    for i in range(32, 36):
        texts[i] = some(50) + short + some(50)
    texts[40] = exact + some(80) + exact
    twice = some(60)
    texts[41] = twice + some(30) + twice
    texts.append(list(texts[50]) if len(texts[50]) >= 50 else some(70))
    texts[50] = list(texts[-1])
    return [" ".join(t) for t in texts]


@pytest.fixture(scope="module")
def found(spark):
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, "", "x"), (901, None, "x"), (902, "a b", "x"), (None, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    return docs, texts, sd.repeated_passages(docs).collect()


def test_every_exact_repeat_is_covered(found):
    _, texts, rows = found
    spans = defaultdict(list)
    for r in rows:
        assert 0 <= r.start_word < r.end_word <= len(texts[r.doc_id].split()) and r.n_words == r.end_word - r.start_word >= 50
        spans[r.doc_id].append((r.start_word, r.end_word))
    places = defaultdict(list)
    for d, t in enumerate(texts):
        ws = t.split()
        for i in range(len(ws) - 49):
            places[tuple(ws[i : i + 50])].append((d, i))
    repeats = [p for ps in places.values() if len(ps) > 1 for p in ps]
    assert len(repeats) > 100
    for d, i in repeats:
        assert any(a <= i and i + 50 <= b for a, b in spans[d]), (d, i)


def test_near_repeats_are_found_and_clean_documents_are_not(found):
    _, texts, rows = found
    ids = {r.doc_id for r in rows}
    assert len(ids & set(range(20, 32))) >= 11
    assert ids <= set(range(0, 20, 2)) | set(range(20, 32)) | {40, 41, 50, len(texts) - 1}
    first = {r.doc_id: r.first_doc_id for r in rows}
    assert first[2] == 0 and first[0] > 0 and first[41] == 41 and first[50] == 50


def test_shuffled_lookup_repeated_rows_and_empty_table(spark, found, monkeypatch):
    docs, _, rows = found
    monkeypatch.setattr(sd, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(sd, "BLOCK_WINDOWS", 50)
    again = sd.repeated_passages(docs.unionByName(docs.where("doc_id < 5"))).collect()
    assert sorted(again) == sorted(rows)
    assert sd.repeated_passages(docs.limit(0)).count() == 0


def test_repeats_changed_in_the_middle_are_found(spark):
    rng = random.Random(77)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(60):
        same = some(75 if k % 3 == 2 else 50)
        changed = list(same)
        for at in ((23,), (rng.randrange(18, 32),), (24, 49))[k % 3]:
            changed[at] = "other"
        texts += [some(30) + same + some(30), some(30) + changed + some(30)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = {r.doc_id for r in sd.repeated_passages(docs).collect()}
    of_kind = [sum(2 * k in ids and 2 * k + 1 in ids for k in range(kind, 60, 3)) for kind in range(3)]
    assert min(of_kind) >= 16, of_kind


def test_near_repeats_in_a_large_group_meet(spark):
    # All texts share a line of 40 words; near twins with changes beside it are told apart from the many others.
    rng = random.Random(5)
    some = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = some(40), []
    for k in range(120):
        before, after = some(5), some(5)
        texts.append(some(20) + before + line + after + some(20))
        if k % 6 == 0:
            changed = list(before)
            changed[0] = "other"
            texts.append(some(20) + changed + line + after + some(20))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    twins = {d for i, t in enumerate(texts) if t[20] == "other" for d in (i - 1, i)}
    assert {r.doc_id for r in sd.repeated_passages(docs).collect()} == twins


def test_covered_equals_brute_force():
    rng = np.random.default_rng(12)
    for n_runs in (0, 1, 40):
        text, of = rng.integers(0, 5, 200), rng.integers(0, 5, n_runs)
        s, at, n = rng.integers(0, 60, 200), rng.integers(0, 60, n_runs), rng.integers(1, 9, n_runs)
        e = s + rng.integers(0, 9, 200)
        inside = {(t, i) for t, a, m in zip(of, at, n) for i in range(a, a + m)}
        want = [all((t, i) in inside for i in range(a, b + 1)) for t, a, b in zip(text, s, e)]
        assert sd.covered(text, s, e, of, at, n).tolist() == want


def test_rarest_equal_brute_force():
    rng = np.random.default_rng(13)
    order = rng.integers(0, 40, 300).astype(np.uint64)
    passages = np.array([*range(0, 120), *range(180, 255)])
    got = {(int(p), i) for p, a, b in zip(*sd.rarest(order, passages)) for i in range(a, b + 1)}
    want = set()
    for i in passages.tolist():
        bound = sorted(order[i : i + sd.PASSAGE])[sd.RAREST - 1]
        want |= {(i + k, i) for k in range(sd.PASSAGE) if order[i + k] <= bound}
    assert got == want


def test_a_passage_is_found_where_others_of_its_interval_are(spark):
    # The elected text repeats the first part of the second text only, and the third repeats the second's other part.
    rng = random.Random(9)
    some = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    texts, want = [], []
    for k in range(40):
        one, mid, end = some((20, 15)[k % 2]), some((42, 40)[k % 2]), some((8, 10)[k % 2])
        d = len(texts)
        texts += [some(20) + t + some(20) for t in (one + mid, one + mid + end, mid + end)]
        want += [(d + 1, 20 + len(one)), (d + 2, 20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {(r.doc_id, r.start_word, r.end_word) for r in sd.repeated_passages(docs).collect()}
    lost = [(d, i) for d, i in want if not any(e == d and a <= i and i + 50 <= b for e, a, b in spans)]
    assert not lost


def test_near_repeats_are_found_whatever_the_edit(spark):
    """One and two words changed, put in and left out: 0.9 of the planted pairs and more of each kind."""
    rng = random.Random(23)
    words = lambda n: ["x%08d" % rng.randrange(10**8) for _ in range(n)]
    edits = {
        "changed": lambda w, p, k: w[:p] + words(k) + w[p + k :],
        "put in": lambda w, p, k: w[:p] + words(k) + w[p:],
        "left out": lambda w, p, k: w[:p] + w[p + k :],
    }
    rows, planted = [], {}
    for name, edit in edits.items():
        for k in (1, 2):
            for place in range(15, 40, 5):
                for _ in range(16):
                    passage = words(50 + k * (name == "left out"))
                    planted[len(rows)] = (name, k, 60, 60 + len(passage))
                    rows.append((len(rows), " ".join(words(60) + passage + words(60))))
                    rows.append((len(rows), " ".join(words(45) + edit(passage, place, k) + words(70))))
    rows += [(10_000 + i, " ".join(words(200))) for i in range(50)]
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.doc_id in planted and r.start_word < planted[r.doc_id][3] and r.end_word > planted[r.doc_id][2]}
    assert not any(r.doc_id >= 10_000 for r in got)
    for kind in {(n, k) for n, k, *_ in planted.values()}:
        ids = [d for d, p in planted.items() if p[:2] == kind]
        assert len(found.intersection(ids)) >= 0.9 * len(ids), kind


def test_sets_at_every_place_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, kinds in ((200, 6), (300, 40), (120, 1000), (60, 3), (46, 30), (45, 3)):
        for _ in range(10):
            x = rng.integers(0, kinds, n).astype(np.uint32)
            y = np.where(rng.random(n) < 0.1, rng.integers(0, kinds, n), np.roll(x, rng.integers(0, 3))).astype(np.uint32)
            pairs = [(set(x[i : i + 46].tolist()), set(y[i : i + 46].tolist())) for i in range(max(0, n - 45))]
            assert sd.alike_sets(x, y).tolist() == [100 * len(p & q) >= 75 * len(p | q) for p, q in pairs]


def test_token_runs_and_their_ends_equal_brute_force():
    rng = np.random.default_rng(31)
    for n in (46, 47, 90, 400):
        for _ in range(20):
            tokens = np.repeat(rng.integers(0, 3, n), rng.choice([1, 5, 20, 60], n))[:n]
            rows = [tokens[i : i + sd.PASSAGE].tolist() for i in range(n - sd.PASSAGE + 1)]
            for least in (sd.IN_PLACE, sd.PASSAGE):
                got = {(int(t), i) for t, s, e in zip(*sd.token_runs(tokens, least)) for i in range(s, e + 1)}
                assert got == {(t, i) for i, r in enumerate(rows) for t in set(r) if r.count(t) >= least}
            begin, k = np.array([0, n // 2, n]), sd.RUN_ENDS
            parts = [(b, tokens[a:c], i) for a, c in ((0, n // 2), (n // 2, n)) for i, b in enumerate(tokens[a:c])]
            want = [i >= k and len(set(t[i - k : i + k + 1].tolist())) == 1 and i + k < len(t) for _, t, i in parts]
            assert sd.inside_runs(tokens, begin).tolist() == want


def test_texts_of_repeated_words_meet_at_few_places(spark):
    # Each place of a run of one word was a window before, and met each place of all runs of the word.
    rng = random.Random(12)
    texts = []
    for _ in range(24):
        texts.append([w for _ in range(4) for w in [rng.choice("abcdef")] * rng.choice((3, 30, 60, 150))])
    texts += [["lone"] * 130, ["short"] * 99]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = sum(len(set(t[i : i + 50])) == 1 for t in texts for i in range(len(t) - 49))
    by_id = {sd.text_id(" ".join(t)): t for t in texts}
    starts = [(by_id[r.text], r.lo) for r in sd._windows(docs, 1).collect()]
    assert whole > 2000 and not any(len(set(t[lo : lo + 50])) == 1 for t, lo in starts)
    spans = defaultdict(list)
    for r in sd.repeated_passages(docs).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            places[tuple(t[i : i + 50])].append((d, i))
    repeats = [(d, i) for ps in places.values() for d, i in ps if any(e != d or abs(i - j) >= 50 for e, j in ps)]
    lost = [(d, i) for d, i in repeats if not any(a <= i and i + 50 <= b for a, b in spans[d])]
    assert len(repeats) > 2000 and not lost
    assert len(texts) - 2 in spans and len(texts) - 1 not in spans


def test_a_run_that_no_other_text_has_meets_passages_almost_of_its_word(spark):
    other = lambda n, k: [f"o{k + i}" for i in range(n)]
    texts = [other(20, 0) + ["deep"] * 70, other(30, 100) + ["deep"] * 47 + other(30, 200)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = [(r.start_word, r.end_word) for r in sd.repeated_passages(docs).collect() if r.doc_id == 0]
    assert any(a <= 20 and b == 90 for a, b in spans), spans


def test_texts_are_read_and_cut_into_tokens_once(spark):
    # Each step and each round read the texts of all documents again and cut those it compared into tokens.
    rng = random.Random(3)
    line = [f"w{rng.randrange(10**9)}" for _ in range(60)]
    texts = [" ".join(f"v{rng.randrange(10**9)}" for _ in range(80)) + " " + " ".join(line) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    found = sd.repeated_passages(docs.withColumn("text", counted("text"))).collect()
    assert {r.doc_id for r in found if r.start_word <= 80 and r.end_word == 140} == set(range(20))
    assert read.value == len(texts)
