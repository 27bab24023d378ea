"""The five stages against brute force, and what they do with odd rows."""

import random

import pytest

import corpus_pipeline
from lorespring.llm import ngram_join, pii, quality
from tests.llm.test_pairs import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set_id string, found string"


def prose(rng, n):
    plain = "the of and to in that it was for with as on at by from this which".split()
    return [rng.choice(plain) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = [" ".join(prose(rng, 120)) for _ in range(12)]
    base = prose(rng, 150)
    for _ in range(5):
        ws = list(base)
        ws[rng.randrange(150)] = "changed"
        texts.append(" ".join(ws))
    texts += [texts[0], "too short", "", None, "# * $ " * 80, " ".join(prose(rng, 90)) + " write to ann@mail.example.com soon"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[3] + " of its own", "en", None, 5, "x", "y")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_equal_brute_force(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = stages["quality_rules"](spark, docs, corpus)
    verdict = {(r.doc_id, r.kept) for r in quality.judge(docs).select("doc_id", "kept").collect()}
    assert kept.columns == docs.columns and {(r.doc_id, True) for r in kept.collect()} == {v for v in verdict if v[1]}
    assert {17 + k for k in (1, 2, 3, 4)}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() >= 18

    unique = stages["ngram_jaccard"](spark, kept, corpus)
    own = [r for r in kept.dropDuplicates(["doc_id"]).orderBy("doc_id").collect() if r.doc_id is not None]
    _, root = brute_components([r.text for r in own])
    want = sorted(own[i].doc_id for i, c in root.items() if i == c)
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect() if r.doc_id is not None) == want
    assert len(want) < len(own) and unique.where("doc_id is null").count() == 1

    clean = stages["pii"](spark, unique, corpus)
    texts = {r.doc_id: r.text for r in unique.collect()}
    terms = frozenset(r.term for r in pii.disclosing_terms(unique).collect())
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {i: pii.mask(t, terms) for i, t in texts.items()}
    assert "[EMAIL]" in next(r.text for r in clean.collect() if r.doc_id == 22)

    mixed = stages["source_mixing"](spark, clean, corpus)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r.text for r in clean.collect()}

    rows = stages["packing"](spark, mixed, corpus).collect()
    used, whole = {}, {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    assert whole == {i: n * tokens[i] for i, n in copies.items()}


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert ngram_join.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0


def test_disclosing_terms_equal_brute_force(spark):
    rng = random.Random(31)
    names = ["Alma", "Bruno", "Cleo", "Dora"]
    texts = []
    for i in range(80):
        ws = prose(rng, 40)
        for n in rng.sample(range(4), rng.randrange(3)):
            at = rng.randrange(len(ws))
            ws[at:at] = [names[n], "x" * rng.choice([3, 300]), f"{names[n].lower()}@mail.example.org"] if rng.random() < 0.9 else [names[n]]
        texts.append(" ".join(ws))
    texts += texts[:5] + ["", None]
    both, holds, entities = {}, {}, {}
    for t in {t for t in texts if t}:
        spans = pii.base_spans(t)
        words = [m.span() for m in pii.WORD.finditer(t) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
        for w in {t[a:b].lower() for a, b in ((m.start(), m.end()) for m in pii.TERM.finditer(t))}:
            holds.setdefault(w, set()).add(t)
        for kind, s, e in spans:
            entity = f"{kind}:{t[s:e].lower()}"
            entities.setdefault(entity, set()).add(t)
            before = [w for w in words if w[0] < s][-pii.WINDOW :]
            after = [w for w in words if w[0] >= e][: pii.WINDOW]
            for a, b in before + after:
                if b - a >= 4:
                    both.setdefault((t[a:b].lower(), entity), set()).add(t)
    import math

    n_docs = len({t for t in texts if t is not None})
    want = set()
    for (w, entity), found in both.items():
        share = len(found) / len(holds[w])
        if len(found) >= pii.MIN_TEXTS and share >= pii.MIN_SHARE and math.log2(share * n_docs / len(entities[entity])) >= pii.MIN_BITS:
            want.add((w, entity))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.term, r.entity) for r in pii.disclosing_terms(docs).collect()} == want
