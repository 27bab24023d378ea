"""What is kept up over batches: keyword index, label and vector pages, labels with verdicts, rules, plans and their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.operators import constraints, evidence, jobs, tables
from lorespring.operators.constraints import check, foreign_key, primary_key, unique
from lorespring.operators.keyword_index import KeywordIndex
from lorespring.operators.steps import new_folder
from lorespring.operators.vector_pages import VectorPages
from lorespring.operators.vectors import cosine_scores, nearest, ranked
from lorespring.plans import recall_queries as M
from lorespring.plans import retrieval_queries as R
from lorespring.plans.registry import query, read


def _index_of_documents(spark, sf_dir) -> KeywordIndex:
    """Every document, in batches by length; then those in German leave, and short ones come again with their source."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    index = KeywordIndex(spark, new_folder(spark, "keyword-index"))
    short, middle = F.col("n_chars") < 400, F.col("n_chars") < 3000
    index.sync(docs.where(short))
    index.sync(docs.where(middle))  # the short ones are there already
    index.sync(docs.where(~middle), removed=docs.where("lang = 'de'"))
    again = docs.where(short & (F.col("source") == "src1")).withColumn("text", F.concat_ws(" ", "text", "source"))
    index.sync(again, removed=again)
    return index


_KEPT = """(SELECT doc_id, CASE WHEN n_chars < 400 AND source = 'src1' THEN text || ' src1' ELSE text END AS text FROM documents
  WHERE lang IS NULL OR lang <> 'de' OR n_chars >= 3000 OR (n_chars < 400 AND source = 'src1'))"""


@query(f'WITH {R._BM25.replace("FROM documents)", f"FROM {_KEPT})")} SELECT * FROM bm25')
def maintained_index_search(spark, sf_dir):
    """BM25 over tables that four batches have added to, two of which remove documents too."""
    return _index_of_documents(spark, sf_dir).search(R.text_queries(spark, sf_dir), R.K)


@query(f"""
WITH words AS (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, {R._W}), lambda x: lower(x)))) AS term FROM {_KEPT})
SELECT term, count(*) AS df FROM words GROUP BY 1""")
def maintained_frequencies(spark, sf_dir):
    """Document frequencies after the same batches, folded into one."""
    return _index_of_documents(spark, sf_dir).compacted(new_folder(spark, "keyword-index")).frequencies()


@query(f"""WITH {M._BM25.replace("{within}", "true").replace(f"rank <= {M.POOL}", f"rank <= {R.K}").replace("words AS", f"turns AS {M._TURNS}, queries AS (SELECT item_id AS query_id, text FROM benchmark), words AS", 1)} SELECT * FROM bm25""")
def maintained_turn_search(spark, sf_dir):
    """The turn index after three rounds of a growing log, each adding what lies behind the watermarks."""
    turns = M.memory_turns(spark, sf_dir).select("id", "conv_id", "turn", "text")
    index = KeywordIndex(spark, new_folder(spark, "turn-index"))
    for most in (1, 3, 1 << 40):
        index.sync_turns(turns.where(F.col("turn") <= most))
    return index.search(R.text_queries(spark, sf_dir), R.K)


@query("""
WITH l AS (SELECT doc_id AS label, doc_id // 2 AS vector_id, (row_number() OVER (ORDER BY doc_id) - 1) // 250 + 1 AS page FROM documents)
SELECT page::INTEGER AS page, max(l.label) AS through, count(vec_id) AS n_kept, count(*) - count(vec_id) AS n_missing,
  coalesce(sum(vec_id), 0)::BIGINT AS ids FROM l LEFT JOIN embeddings ON vec_id = vector_id GROUP BY 1""")
def label_pages(spark, sf_dir):
    """Labels with their vectors in pages, read in two runs, and what of each page has no vector."""
    labels = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), F.expr("doc_id div 2").alias("vector_id"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    pages = VectorPages(spark, new_folder(spark, "vector-pages"), 250)
    pages.read(labels, vectors, most=1)
    pages.read(labels, vectors)
    held = pages.rows().groupBy("page").agg(F.sum("vector_id").alias("ids"))
    return pages.state().join(held, "page", "left").select("page", "through", "n_kept", "n_missing", F.coalesce("ids", F.lit(0).cast("long")).alias("ids"))


@query("""
WITH stored AS (SELECT p_partkey AS label, p_partkey AS vector_id, 'c' || p_partkey AS chunk_id, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM part WHERE p_size < 25),
asked AS (SELECT p_partkey AS pos, CASE WHEN p_size % 10 = 9 THEN NULL WHEN p_size % 10 = 8 THEN p_partkey + 1 ELSE p_partkey END AS vector_id, 'c' || p_partkey AS chunk_id, 'a' AS model FROM part),
known AS (SELECT a.pos, a.vector_id, a.chunk_id, a.model, c.label AS by_chunk, c.vector_id AS its, c.model AS made, v.label AS by_vector
  FROM asked a LEFT JOIN stored c USING (chunk_id) LEFT JOIN stored v ON v.vector_id = a.vector_id),
new AS (SELECT * FROM known WHERE vector_id IS NOT NULL AND by_chunk IS NULL AND by_vector IS NULL),
-- p + 1 asks for its own vector after p took it: a conflict where p was created.
taken AS (SELECT n.pos, EXISTS (SELECT 1 FROM new m WHERE m.pos = n.pos - 1 AND m.vector_id = n.vector_id) AS late FROM new n),
made AS (SELECT pos, row_number() OVER (ORDER BY pos) + (SELECT max(label) FROM stored) AS label FROM taken WHERE NOT late)
SELECT k.pos, k.vector_id, k.chunk_id, k.model,
  CASE WHEN k.vector_id IS NULL THEN NULL WHEN its = k.vector_id THEN by_chunk ELSE made.label END AS label,
  CASE WHEN k.vector_id IS NULL THEN 'malformed' WHEN its = k.vector_id THEN CASE WHEN made = k.model THEN 'same' ELSE 'other_model' END
    WHEN made.label IS NOT NULL THEN 'created' ELSE 'conflict' END AS verdict
FROM known k LEFT JOIN made USING (pos)""".replace("CASE WHEN made = k.model", "CASE WHEN k.made = k.model"))
def merged_label_requests(spark, sf_dir):
    """Each part asks for a label: known, new, at odds with what is stored or with the request before it, or malformed."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("c"), "p_partkey").alias("chunk_id"))
    stored = part.where("p_size < 25").select(
        F.col("p_partkey").alias("label"), F.col("p_partkey").alias("vector_id"), "chunk_id", F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("model")
    )
    last = F.col("p_size") % 10
    vector = F.when(last == 9, None).when(last == 8, F.col("p_partkey") + 1).otherwise(F.col("p_partkey"))
    asked = part.select(F.col("p_partkey").alias("pos"), vector.alias("vector_id"), "chunk_id", F.lit("a").alias("model"))
    return tables.merged_labels(asked, stored)


#: The given tables as a catalogue of rules, of every kind.
RULES = (
    primary_key("region", "r_regionkey"),
    primary_key("nation", "n_nationkey"),
    foreign_key("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    primary_key("customer", "c_custkey"),
    foreign_key("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    primary_key("orders", "o_orderkey"),
    foreign_key("orders", ("o_custkey",), "customer", ("c_custkey",)),
    check("orders", "o_totalprice > 1000"),
    primary_key("lineitem", "l_orderkey", "l_linenumber"),
    foreign_key("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    check("lineitem", "l_discount <= 0.09"),
    primary_key("documents", "doc_id"),
    unique("documents", "text", where="lang = 'en'"),
    foreign_key("labels", ("doc_id",), "documents", ("doc_id",)),
    check("labels", "quality in (0, 1) and toxic = 0"),
    primary_key("conversations", "conv_id", "turn"),
    unique("conversations", "conv_id", where="role = 'user'"),
    foreign_key("conversations", ("turn",), "benchmark", ("item_id",)),
    check("conversations", "role in ('user', 'assistant', 'system')"),
)


def _rule_sql(rule: constraints.Rule) -> str:
    """The violations of one rule as DuckDB SQL."""
    if rule.check:
        count = f"SELECT count(*) FROM {rule.table} WHERE NOT ({rule.check})"
    elif rule.references:
        same = " AND ".join(f"p.{b} = c.{a}" for a, b in zip(rule.references, rule.columns, strict=True))
        given = " AND ".join(f"c.{a} IS NOT NULL" for a in rule.references)
        count = f"SELECT count(*) FROM {rule.table} c WHERE {given} AND NOT EXISTS (SELECT 1 FROM {rule.parent} p WHERE {same})"
    else:
        keys, given = ", ".join(rule.unique), " AND ".join(f"{c} IS NOT NULL" for c in rule.unique)
        count = f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {rule.table} WHERE {given} AND ({rule.where or 'true'}) GROUP BY {keys})"
        if rule.primary:
            count = f"SELECT ({count}) + (SELECT count(*) FROM {rule.table} WHERE NOT ({given}))"
    return f"SELECT '{rule.name.replace(chr(39), 2 * chr(39))}' AS rule, ({count})::BIGINT AS n_rows"


@query(" UNION ALL ".join(map(_rule_sql, RULES)))
def rule_catalogue(spark, sf_dir):
    """How many rows break each rule of a catalogue, each table being read once."""
    names = {r.table for r in RULES} | {r.parent for r in RULES if r.parent}
    return constraints.violations({n: read(spark, sf_dir, n) for n in sorted(names)}, RULES)


_PLAN = """jobs AS (SELECT 'j' || p_partkey AS id, p_partkey AS place FROM part WHERE p_size <> 50 UNION ALL SELECT ' ', p_partkey FROM part WHERE p_size = 50
  UNION ALL SELECT 'j' || p_partkey, p_partkey + 1000000000 FROM part WHERE p_size = 1),
needs AS (SELECT 'j' || p_partkey AS id, 'j' || (p_partkey // 2) AS needs FROM part WHERE p_partkey > 1 AND p_size < 46
  UNION SELECT 'j' || p_partkey, 'j' || (p_partkey // 3) FROM part WHERE p_partkey > 2 AND p_size < 30
  UNION SELECT 'j' || p_partkey, 'j' || p_partkey FROM part WHERE p_size = 49 AND p_partkey % 4 = 0
  UNION SELECT 'j' || p_partkey, 'none' FROM part WHERE p_size = 49 AND p_partkey % 4 = 1
  UNION SELECT 'j' || (p_partkey // 2), 'j' || p_partkey FROM part WHERE p_partkey > 1000 AND p_size = 45)"""


@query(f"""
WITH RECURSIVE {_PLAN},
ids AS (SELECT DISTINCT id FROM jobs WHERE trim(id) <> ''),
edges AS (SELECT DISTINCT n.id, n.needs FROM needs n JOIN ids USING (id)),
bad AS (SELECT id FROM edges WHERE id = needs OR needs NOT IN (SELECT id FROM ids)),
reach AS (SELECT id, needs AS above FROM edges UNION SELECT r.id, e.needs FROM reach r JOIN edges e ON e.id = r.above),
loops AS (SELECT DISTINCT id FROM reach WHERE id = above AND id NOT IN (SELECT id FROM edges WHERE id = needs)),
stuck AS (SELECT id FROM bad UNION SELECT id FROM loops UNION SELECT id FROM reach WHERE above IN (SELECT id FROM bad UNION ALL SELECT id FROM loops)),
between AS (SELECT DISTINCT a.id FROM reach a JOIN reach b ON b.above = a.id WHERE a.above IN (SELECT id FROM loops) AND b.id IN (SELECT id FROM loops)),
levels AS (SELECT id, 0 AS level FROM ids WHERE id NOT IN (SELECT id FROM edges) UNION SELECT e.id, l.level + 1 FROM levels l JOIN edges e ON e.needs = l.id WHERE e.id NOT IN (SELECT id FROM stuck)),
heights AS (SELECT id, max(level) AS level FROM levels GROUP BY 1),
told AS (SELECT j.id, place, CASE WHEN trim(j.id) = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY j.id ORDER BY place) > 1 THEN 'duplicate'
  WHEN j.id IN (SELECT id FROM edges WHERE id = needs) THEN 'self' WHEN j.id IN (SELECT id FROM bad) THEN 'unknown'
  WHEN j.id IN (SELECT id FROM loops UNION ALL SELECT id FROM between) THEN 'cycle' WHEN j.id IN (SELECT id FROM stuck) THEN 'blocked' ELSE 'ok' END AS verdict FROM jobs j)
SELECT t.id, place, verdict, CASE WHEN verdict = 'ok' THEN level END AS level,
  CASE WHEN verdict = 'ok' THEN row_number() OVER (PARTITION BY verdict ORDER BY level, place) END AS position FROM told t LEFT JOIN heights h USING (id)""")
def checked_job_plan(spark, sf_dir):
    """A plan in which each part waits for those at half and a third of its number, some for later ones, themselves or nothing known."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    name = lambda e: F.concat(F.lit("j"), F.expr(e))
    job = lambda rows, i, place: rows.select(i.alias("id"), F.expr(place).alias("place"))
    plan = job(part.where("p_size <> 50"), name("p_partkey"), "p_partkey").unionByName(job(part.where("p_size = 50"), F.lit(" "), "p_partkey"))
    plan = plan.unionByName(job(part.where("p_size = 1"), name("p_partkey"), "p_partkey + 1000000000"))
    edge = lambda where, a, b: part.where(where).select(a.alias("id"), b.alias("needs"))
    needs = edge("p_partkey > 1 and p_size < 46", name("p_partkey"), name("p_partkey div 2"))
    for more in (
        edge("p_partkey > 2 and p_size < 30", name("p_partkey"), name("p_partkey div 3")),
        edge("p_size = 49 and p_partkey % 4 = 0", name("p_partkey"), name("p_partkey")),
        edge("p_size = 49 and p_partkey % 4 = 1", name("p_partkey"), F.lit("none")),
        edge("p_partkey > 1000 and p_size = 45", name("p_partkey div 2"), name("p_partkey")),
    ):
        needs = needs.unionByName(more)
    return jobs.checked_plan(plan, needs)


def _results(spark, sf_dir):
    """Turns as results of jobs, each citing two pieces of evidence; every fourth is retracted, and every eighth accepted again."""
    turns = M.memory_turns(spark, sf_dir).where("text is not null")
    output = F.concat("text", F.lit(" M"), "turn", F.lit(" and G"), F.col("conv_id") % 20)
    log = turns.select("id", F.lit(1).alias("at"), F.lit("accept").alias("kind"), output.alias("output"))
    gone = turns.where("id % 4 = 3").select("id", F.lit(2).alias("at"), F.lit("retract").alias("kind"), F.lit(None).cast("string").alias("output"))
    back = turns.where("id % 8 = 3").select("id", F.lit(3).alias("at"), F.lit("accept").alias("kind"), F.concat(F.lit("again "), output).alias("output"))
    return turns, jobs.accepted(log.unionByName(gone).unionByName(back))


_ACCEPTED = f"""turns AS {M._TURNS}, results AS (SELECT id, CASE WHEN id % 8 = 3 THEN 'again ' ELSE '' END || text || ' M' || turn || ' and G' || conv_id % 20 AS output
  FROM turns WHERE text IS NOT NULL AND (id % 4 <> 3 OR id % 8 = 3))"""


@query(rf"""
WITH {_ACCEPTED}, needs AS (SELECT t.id, t.id - k AS needs FROM turns t, (VALUES (1), (2), (3)) AS b(k) WHERE t.text IS NOT NULL AND t.turn >= k),
told AS (SELECT n.id, n.needs, output, greatest(200, 900 // count(*) OVER (PARTITION BY n.id)) AS share FROM needs n JOIN results r ON r.id = n.needs)
SELECT id, needs, CASE WHEN length(output) > share THEN regexp_replace(left(output, share), '[\s\x0b\x85\p{{Z}}]+$', '') || '…[truncated]' ELSE output END AS text FROM told""")
def dependency_contexts(spark, sf_dir):
    """What each turn is told of the up to three before it, as results of jobs that it depends on."""
    turns, results = _results(spark, sf_dir)
    back = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")
    needs = turns.select("id", "turn", back).where("turn >= k").select("id", (F.col("id") - F.col("k")).alias("needs"))
    return jobs.dependency_context(needs, results, 900)


@query(rf"""
WITH {_ACCEPTED}, evidence AS (SELECT DISTINCT unnest(['M' || turn, 'G' || turn, 'K' || turn]) AS ref FROM turns),
cited AS (SELECT DISTINCT unnest(regexp_extract_all(output, '\b[A-Z][0-9]{{1,3}}\b')) AS ref FROM results)
SELECT ref, row_number() OVER (ORDER BY left(ref, 1), substring(ref, 2)::INTEGER) AS place FROM evidence JOIN cited USING (ref)""")
def evidence_cited(spark, sf_dir):
    turns, results = _results(spark, sf_dir)
    each = F.explode(F.array(*(F.concat(F.lit(x), "turn") for x in "MGK")))
    return jobs.cited_evidence(results, turns.select(each.alias("ref")).distinct())


_PARTS = """q AS (SELECT item_id AS query_id, 0 AS part, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id
  UNION ALL SELECT item_id, k, embedding::DOUBLE[] FROM benchmark, (VALUES (1), (2)) AS b(k) JOIN embeddings ON vec_id = item_id * 5 + k)"""


@query(f"""
WITH {_PARTS}, docs AS (SELECT doc_id AS id, embedding::DOUBLE[] AS d FROM documents JOIN embeddings ON vec_id = doc_id WHERE text IS NOT NULL),
hits AS (SELECT query_id, part, id, round(list_cosine_similarity(v, d), 6) AS score,
  row_number() OVER (PARTITION BY query_id, part ORDER BY round(list_cosine_similarity(v, d), 6) DESC, id)::INTEGER AS rank FROM q CROSS JOIN docs QUALIFY rank <= {R.K}),
best AS (SELECT query_id, id, max(score) AS score, arg_min(part, (-score, part)) AS part, min((part, rank)) AS found FROM hits GROUP BY 1, 2),
near_to AS (SELECT b.query_id, b.id, b.part, b.score, found, round(list_cosine_similarity(v, d), 6) AS similarity FROM best b JOIN q ON q.query_id = b.query_id AND q.part = 0 JOIN docs USING (id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, found)::INTEGER AS rank FROM near_to WHERE similarity >= 0.35 QUALIFY rank <= 10)
SELECT query_id, 'G' || rank AS ref, id, part, score, similarity, rank FROM kept""")
def evidence_of_sub_queries(spark, sf_dir):
    """Passages found for each benchmark question and two sub-queries of it, united, and verified by the question's vector."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = R.text_queries(spark, sf_dir).select(F.col("query_id").alias("item_id"))
    part = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("part")
    parts = asked.select("item_id", part).withColumn("vec_id", F.when(F.col("part") == 0, F.col("item_id")).otherwise(F.col("item_id") * 5 + F.col("part")))
    parts = parts.join(rows, "vec_id").select((F.col("item_id") * 3 + F.col("part")).alias("query_id"), "item_id", "part", "vector")
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("vec_id"))
    held = docs.join(rows, "vec_id").select(F.col("vec_id").alias("id"), "vector")
    found = nearest(parts.select("query_id", "vector"), held, R.K, lambda q, r: cosine_scores(q, r).round(6))
    hits = found.join(parts.drop("vector"), "query_id").select(F.col("item_id").alias("query_id"), "part", "id", "score", "rank")
    questions = parts.where("part = 0").select(F.col("item_id").alias("query_id"), "vector")
    return evidence.verified_union(hits, held, questions)[0]


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey % 7 + 1 = l.l_linenumber)""")
def rows_at_composite_keys(spark, sf_dir):
    """One line of each order, by order and number."""
    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return tables.looked_up(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), keys, ["l_orderkey", "l_linenumber"])


@query("""
SELECT event_id, nullif(trim(CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 5 = 1 THEN NULL ELSE ' ' || event_type || ' ' END), '') AS identifier,
  event_id % 5 > 1 AS usable FROM events""")
def identifiers_checked(spark, sf_dir):
    kind = F.col("event_id") % 5
    given = F.when(kind == 0, "  ").when(kind > 1, F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return read(spark, sf_dir, "events").select("event_id", tables.identifier_verdict(given).alias("v")).select("event_id", "v.*")


@query("""
WITH c AS (SELECT n_nationkey AS c_nationkey, n_nationkey % 3 AS rank FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 1000, 1)
SELECT c.c_nationkey, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS n_rows, CASE WHEN count(c_custkey) FILTER (WHERE c_acctbal > 0) > 0 THEN 'updated' ELSE 'not found' END AS verdict
FROM c LEFT JOIN customer USING (c_nationkey) GROUP BY 1""")
def updates_with_counts(spark, sf_dir):
    """How many rows each change has met."""
    nations = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("c_nationkey"), (F.col("n_nationkey") % 3).cast("string").alias("c_mktsegment"))
    changes = nations.unionByName(nations.limit(1).select(F.lit(1000).cast("long").alias("c_nationkey"), F.lit("1").alias("c_mktsegment")))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment", "c_acctbal")
    return tables.updated(customers, changes, ["c_nationkey"], F.col("c_acctbal") > 0)[1]


@query(f"""
WITH t AS {M._TURNS} SELECT c.vec_id AS chunk_id, t.conv_id, t.turn AS sequence_number FROM t JOIN (SELECT vec_id FROM embeddings WHERE label IS NOT NULL) c USING (vec_id)""")
def turns_of_chunks(spark, sf_dir):
    """The conversation and sequence number behind each chunk that is asked for, by chunk."""
    chunks = read(spark, sf_dir, "embeddings").where("label is not null").select("vec_id")
    found = tables.looked_up(M.memory_turns(spark, sf_dir).select("vec_id", "conv_id", "turn"), chunks, ["vec_id"])
    return found.select(F.col("vec_id").alias("chunk_id"), "conv_id", F.col("turn").alias("sequence_number"))


@query("""
SELECT c_mktsegment AS topic, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)::INTEGER AS place
FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))""")
def projects_of_topics(spark, sf_dir):
    """The projects of each topic, of some kinds only, in order of id."""
    kinds = tables.looked_up(
        read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("int").alias("n_regionkey")), spark.createDataFrame([(1,), (3,)], "n_regionkey int"), ["n_regionkey"]
    )
    customers = read(spark, sf_dir, "customer").join(F.broadcast(kinds.select(F.col("n_nationkey").alias("c_nationkey"))), "c_nationkey", "left_semi")
    placed = ranked(customers.select(F.col("c_mktsegment").alias("topic"), F.col("c_custkey").alias("id")), ["topic"], F.asc("id"))
    return placed.withColumnRenamed("rank", "place")
