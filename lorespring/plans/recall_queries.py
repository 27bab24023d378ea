"""Conversation memory: turns searched in scope, and what memory knows of a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespring.operators import recall
from lorespring.operators.vectors import ranked
from lorespring.plans import retrieval_queries as R
from lorespring.plans.registry import query, read

POOL = recall.POOL * R.K
ID, PROJECT, VECTOR = "conv_id * 1001 + turn", "conv_id div 10", "conv_id * 4 + turn"


def memory_turns(spark, sf_dir):
    """Turns with an id, and the project of ten conversations in a row that they belong to."""
    turns = read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    return turns.select(F.expr(ID).alias("id"), F.expr(PROJECT).alias("project"), "conv_id", "turn", "role", "text", F.expr(VECTOR).alias("vec_id"))


def memory_vectors(spark, sf_dir):
    """(id, vector) of the turns that have one."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return memory_turns(spark, sf_dir).select("id", "vec_id").join(rows, "vec_id").select("id", "vector")


_TURNS = "(SELECT conv_id * 1001 + turn AS id, conv_id // 10 AS project, conv_id, turn, role, text, conv_id * 4 + turn AS vec_id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"
_BM25 = R._BM25.replace("doc_id AS id", "id").replace("FROM documents)", "FROM turns)").replace("item_id AS query_id", "query_id")
_BM25 = _BM25.replace("FROM benchmark)", "FROM queries)").replace(
    "FROM scored QUALIFY", "FROM scored JOIN queries USING (query_id) JOIN turns USING (id) WHERE {within} QUALIFY"
).replace(f"rank <= {R.K}", f"rank <= {POOL}")
_WITHIN = """turns.project = queries.project AND (queries.only <> 1 OR turns.conv_id = queries.current)
  AND NOT coalesce(turns.conv_id = queries.current AND turns.turn >= queries.before, false)"""


def _local_sql(scopes: str) -> str:
    """From ``queries`` (query_id, text, q, project, current, only, before) to ``fit``, the context of each."""
    return rf"""turns AS {_TURNS}, {scopes},
vecs AS (SELECT id, embedding::DOUBLE[] AS v FROM turns JOIN embeddings USING (vec_id)),
{_BM25.replace("{within}", _WITHIN)},
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, v), 6) DESC, id)::INTEGER AS rank
  FROM queries JOIN turns ON turns.project = queries.project JOIN vecs USING (id) WHERE q IS NOT NULL AND {_WITHIN} QUALIFY rank <= {POOL}),
lists AS (SELECT query_id, 'dense' AS list, id, rank FROM dense UNION ALL SELECT query_id, 'lexical', id, rank FROM bm25),
sums AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(struct_pack(l := list, r := rank)) AS seen FROM lists GROUP BY 1, 2),
pool AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS place FROM sums QUALIFY place <= {POOL}),
texts AS (SELECT pool.*, conv_id, turn, text, regexp_replace(trim(text), '[\s\x0b\x85\p{{Z}}]+', ' ', 'g') AS key FROM pool JOIN turns USING (id) WHERE text IS NOT NULL),
once AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY place) = 1),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER AS rank FROM once QUALIFY rank <= {R.K}),
spending AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS spent FROM cut),
fit AS (SELECT * FROM spending WHERE spent <= 2048)"""


_EARLIER = """queries AS (SELECT t.id AS query_id, text, embedding::DOUBLE[] AS q, project, conv_id AS current, (turn % 2)::INTEGER AS only, turn AS before
  FROM turns t LEFT JOIN embeddings USING (vec_id) WHERE t.id % 20 = 0)"""


@query(f"""WITH {_local_sql(_EARLIER)}
SELECT query_id, id, conv_id, turn, score, rank, spent,
  row_number() OVER (PARTITION BY query_id ORDER BY conv_id, turn, rank)::INTEGER AS reading_rank FROM fit""")
def scoped_turn_search(spark, sf_dir):
    """What was said before each of every twentieth turn and answers it: in its conversation, or for even turns in its project."""
    turns, held = memory_turns(spark, sf_dir), memory_vectors(spark, sf_dir)
    asked = turns.where("id % 20 = 0").join(held, "id", "left").select(
        F.col("id").alias("query_id"), "text", "vector", "project", F.col("conv_id").alias("current"), (F.col("turn") % 2).alias("only"), F.col("turn").alias("before")
    )
    return recall.local_context(asked, turns, held, R.K)


_ASKED = """questions AS (SELECT item_id AS query_id, b.text, embedding::DOUBLE[] AS q, item_id AS current, (item_id * 7 // 40) % 4 AS topic,
    CASE WHEN item_id % 3 = 0 THEN 2 END AS before FROM benchmark b JOIN embeddings ON vec_id = item_id * 7),
vectors AS (SELECT id, project, project % 3 AS topic, role, embedding::DOUBLE[] AS v, turns.conv_id, turn FROM turns JOIN embeddings USING (vec_id)),
snaps AS (SELECT id, project, topic, v, row_number() OVER (PARTITION BY project ORDER BY conv_id, turn) AS place FROM vectors WHERE role = 'assistant' AND project % 5 <> 1),
tops AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY place DESC) AS back FROM snaps),
stand AS (SELECT id, project, topic, v FROM vectors WHERE project % 5 = 1 QUALIFY row_number() OVER (PARTITION BY project ORDER BY id) = 1),
latest AS (SELECT id, project, topic, v FROM tops WHERE back = 1 UNION ALL SELECT * FROM stand),
known AS (SELECT query_id, 'known' AS stage, project, NULL::DOUBLE AS score FROM questions JOIN (SELECT DISTINCT conv_id, project FROM turns WHERE conv_id % 5 = 0) m ON m.conv_id = questions.current),
near AS (SELECT query_id, 'latest' AS stage, project, round(list_cosine_similarity(q, v), 6) AS score FROM questions JOIN latest USING (topic)
  WHERE query_id NOT IN (SELECT query_id FROM known) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project, id) = 1),
far AS (SELECT query_id, 'history' AS stage, project, round(list_cosine_similarity(q, v), 6) AS score
  FROM questions JOIN (SELECT id, project, topic, v FROM snaps UNION ALL SELECT * FROM stand) USING (topic)
  WHERE query_id NOT IN (SELECT query_id FROM known UNION ALL SELECT query_id FROM near WHERE score >= 0.5)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project, id) = 1),
found AS (SELECT * FROM known UNION ALL SELECT * FROM near WHERE score >= 0.5 UNION ALL SELECT * FROM far WHERE score >= 0.3),
routes AS (SELECT query_id, coalesce(stage, CASE WHEN topic IN (SELECT topic FROM latest) THEN 'no_project' ELSE 'no_topic' END) AS stage, project, score
  FROM questions LEFT JOIN found USING (query_id))"""
_ROUTED = f"""{_ASKED}, queries AS (SELECT query_id, text, q, found.project, current, 0 AS only, before FROM questions JOIN found USING (query_id))"""


def _memory(spark, sf_dir):
    """Questions with their topics, known conversations, snapshots and the summaries of projects that have none."""
    turns, held = memory_turns(spark, sf_dir), memory_vectors(spark, sf_dir)
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 7).alias("item_id"), F.col("embedding").alias("vector"))
    asked = R.text_queries(spark, sf_dir).join(rows, F.col("query_id") == F.col("item_id")).select(
        "query_id", "text", "vector", F.col("query_id").alias("current"), F.expr("(query_id * 7 div 40) % 4").alias("topic"),
        F.when(F.col("query_id") % 3 == 0, 2).alias("before"),
    )
    mapping = turns.where("conv_id % 5 = 0").select("conv_id", "project").distinct()
    with_vectors = turns.join(held, "id").withColumn("topic", F.col("project") % 3)
    said = with_vectors.where("role = 'assistant' and project % 5 <> 1")
    snapshots = ranked(said, ["project"], F.asc("conv_id"), F.asc("turn")).select("topic", "project", "id", F.col("rank").alias("place"), "vector")
    summaries = ranked(with_vectors.where("project % 5 = 1"), ["project"], F.asc("id"), limit=1).select("topic", "project", "id", "vector")
    return asked, mapping, snapshots, summaries, turns, held


@query(f"WITH turns AS {_TURNS}, {_ASKED} SELECT * FROM routes")
def routed_by_snapshots(spark, sf_dir):
    """The project that each benchmark question belongs to: known, by its latest snapshot, by its history, or none."""
    asked, mapping, snapshots, summaries, _, _ = _memory(spark, sf_dir)
    return recall.routed(asked, mapping, snapshots, summaries, latest_floor=0.5, history_floor=0.3)


@query(f"""WITH {_local_sql(_ROUTED)},
near_to AS (SELECT query_id, id, rank, round(list_cosine_similarity(q, v), 6) AS similarity FROM fit LEFT JOIN vecs USING (id) JOIN queries USING (query_id)),
best AS (SELECT query_id, max(similarity) AS best,
  CASE WHEN max(similarity) >= 0.6 THEN 'FULL' WHEN max(similarity) >= 0.35 THEN 'PARTIAL' ELSE 'NONE' END AS verdict FROM near_to GROUP BY 1)
SELECT routes.query_id, stage, project, verdict, best, id, rank, similarity
FROM routes LEFT JOIN best USING (query_id) LEFT JOIN (SELECT * FROM near_to WHERE similarity >= 0.35) USING (query_id)""")
def memory_recall(spark, sf_dir):
    """Whether memory can answer each benchmark question, and by which turns."""
    return recall.recalled(*_memory(spark, sf_dir), R.K, latest_floor=0.5, history_floor=0.3)
