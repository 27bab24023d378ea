"""Operators that judge documents one by one, or count and place all of their words."""

import random
import re
import zlib
from collections import defaultdict
from struct import pack as packed

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorespring.llm import mixing, packing, quality, token_counts
from lorespring.llm.word_tokens import WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, quality string, target string"
ODD = [
    "",
    None,
    " \n\t ",
    "one",
    "a  b\n\n c \t d ",
    "it's \n\n 'tis  we'll  ",
    "x y   z\x1fq\x0bw",
    "end<|endoftext|> of <|endoftext|>",
    "ΣΑΣ É é İ 12345 \U0001f600\U0001f600",
    "word " * 3000,
    "tab\tsep\r\nline\n",
    " lead and trail  ",
]


def docs_of(spark, texts, sources=("s1", "s2", None)):
    rows = [(i, t, None, sources[i % len(sources)], None, 1, "q", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def some_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r[0] for r in rows] + ODD


def test_words_of_a_full_memo_are_not_encoded_again(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, new = Tokenizer.from_file(path), WordEncoder(path, 7), []
    monkeypatch.setattr(own, "_lengths", lambda words, real=own._lengths: new.append(sorted(words)) or real(words))
    first, second, third = (" ".join(f"{c}Word{i}, e\u0301\u1100\u1161" for i in range(12)) for c in "abc")
    for text in (first, second, third, first, first + " <|endoftext|> can't"):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    # The third text fills the memo, but the first one's words are not encoded again; those of a text are, in one call.
    assert [len(x) for x in new] == [13, 12, 12, 2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_word_encoder_equals_library(name, ranks, some_texts):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), WordEncoder(path, 2000, ranks and public_tokenizers.path(ranks))
    for text in some_texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        if name.startswith("byte"):
            assert own.ids_of(text or "") == packed(f"<{len(ids)}I", *ids)
        else:
            assert own.count(text or "") == len(ids)


def test_token_counts_use_and_extend_the_cache(spark, some_texts, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    docs = docs_of(spark, some_texts + some_texts[:20])
    for part in (docs.where("doc_id < 50"), docs):
        got = {r.doc_id: r for r in token_counts.count_tokens(part, path, cache).collect()}
        for r in part.collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want = (len((r.text or "").encode()), n, n > 2048)
            assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in some_texts})
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_packing_is_an_exact_round_trip(spark, some_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = docs_of(spark, some_texts)
    pieces = packing.pack(docs, path, end_id=1).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc.pop(r.doc_id), key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(packed(f"<{len(part)}I", *part)))
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert len(by_sequence) * 2048 - total < 2048  # one group here
    assert packing.pack(docs.limit(0), path, end_id=1).count() == 0


def test_packing_balances_cost():
    import numpy as np

    rng = random.Random(5)
    lengths = np.array([rng.randint(1, 2047) for _ in range(3000)])
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.assign(lengths, 2048):
        cost[s] += n + n * n / 4096
    values = sorted(cost.values())
    assert values[-1] / values[len(values) // 10] < 1.5


def brute_quality(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = defaultdict(list)
    for i, g in enumerate(grams):
        seen[g].append(i)
    hit = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(ws),
        sum(map(len, ws)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(hit),
        len(ws) < 50 or 100 * len(hit) > 50 * len(ws),
    )


def test_quality_equals_brute_force(spark, some_texts):
    texts = some_texts + ["a b c a b c a", "a b c d a b", "x\nx\n \nx", "a a a a", "a b c x a b c y b c x"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        mine = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert mine == brute_quality(t), t
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_thresholds_are_a_table(spark):
    docs = docs_of(spark, ["the word " * 3 + " ".join(f"longish{i}" for i in range(80))])
    strict = [quality.Rule("mean_word_length", None, 3.0)]
    assert quality.judge(docs, []).first().kept and not quality.judge(docs, strict).first().kept


def test_mixing_meets_targets(spark, some_texts):
    docs = docs_of(spark, some_texts + ["w " * 5] * 3, ("a", "b", None, "c"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    assert abs(sum(t for t, _ in target.values()) - sum(r.size for r in rows)) < 1e-6
    for s, (t, size) in target.items():
        assert t <= 3 * size + 1e-9 and abs(taken[s] - t) <= 0.5
    again = {(r.doc_id, r.taken, r.position) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken, r.position) for r in rows}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: len(r.copies) for r in rows if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0
    empty = mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert all(r.taken == 0 and r.target == 0 for r in empty)


def test_targets_reshare_what_caps_cut_off(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got["a"] == 30 and got["b"] == 300 and got[None] == 15 and abs(got["c"] - (1115 - 345)) < 1e-9


def test_quality_knows_other_languages_and_capitals(spark):
    rng = random.Random(5)
    russian = "снег лежал на крышах и во дворах а мы шли по улице и молчали потому что на углу стоял старый дом в котором никто не жил "
    polish = "kiedy wiatr ucichł na polach i w lesie to stary dom na wzgórzu był cichy i pusty a my szliśmy do niego powoli i bez słowa bo na "
    salad = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(80))
    texts = [
        " ".join(russian.split() + ["слово%d" % i for i in range(40)]),
        " ".join(f"слово{chr(0x430 + i % 32)}{chr(0x430 + i // 32)}" for i in range(80)),
        " ".join(polish.split() + [f"łąka{i}" for i in range(40)]),
        " ".join(f"THE {w.upper()}" for w in salad.split()),
        salad,
    ]
    got = quality.judge(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in got] == [(False, True)] * 4 + [(False, False)]
