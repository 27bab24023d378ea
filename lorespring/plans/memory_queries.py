"""Conversation logs: ranges, watermarks, snapshots, pages, exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespring.functions import text as T
from lorespring.operators import memory, tables
from lorespring.plans.registry import query, read


def turns(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn BETWEEN 1 AND 3")
def turn_range(spark, sf_dir):
    return turns(spark, sf_dir).where(F.col("turn").between(1, 3)).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, NOT (conv_id = 4 AND turn >= 2) AS in_scope FROM conversations")
def turns_in_scope(spark, sf_dir):
    """Every turn with whether a search from turn 2 of conversation 4 may see it."""
    scope = memory.in_scope(F.col("conv_id"), F.col("turn"), None, 4, 2)
    return turns(spark, sf_dir).select("conv_id", "turn", scope.alias("in_scope"))


@query("""SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def last_turns(spark, sf_dir):
    return memory.last_n(turns(spark, sf_dir), 3).select("conv_id", "turn", "text")


@query("""
WITH u AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT a.conv_id, q.turn AS user_turn, a.turn AS assistant_turn, q.text AS question, a.text AS answer
FROM u a JOIN u q ON q.conv_id = a.conv_id AND q.role = 'user' AND q.turn < a.turn
WHERE a.role = 'assistant' AND NOT EXISTS (SELECT 1 FROM u x WHERE x.conv_id = a.conv_id AND x.turn > q.turn AND x.turn < a.turn AND x.role IN ('user', 'assistant'))""")
def paired_exchanges(spark, sf_dir):
    return memory.pairs(turns(spark, sf_dir))


@query("SELECT conv_id, max(turn) AS high, max(turn) + 1 AS next, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
def sequence_watermarks(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(
        F.max("turn").alias("high"), (F.max("turn") + 1).alias("next"), F.count("*").alias("turns"), F.count_distinct("role").alias("roles")
    )


@query("""
WITH marks AS (SELECT conv_id, max(turn) AS watermark FROM conversations WHERE role = 'system' GROUP BY 1),
fresh AS (SELECT c.conv_id, c.text FROM conversations c LEFT JOIN marks m USING (conv_id) WHERE c.turn > coalesce(m.watermark, -1))
SELECT conv_id, count(*) AS new_turns, (sum(length(text)) // 4)::BIGINT AS tokens,
  count(*) >= 20 OR sum(length(text)) // 4 >= 8192 AS due FROM fresh GROUP BY 1""")
def snapshots_due(spark, sf_dir):
    rows = turns(spark, sf_dir)
    marks = rows.where("role = 'system'").groupBy("conv_id").agg(F.max("turn").alias("watermark"))
    return memory.snapshots_due(rows, marks)


@query("""
WITH marks AS (SELECT conv_id, max(turn) AS watermark FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT c.conv_id, c.turn, greatest(0, least(greatest(0, c.turn - 2 - 1), coalesce(watermark, -1) + 1)) AS start
FROM conversations c LEFT JOIN marks USING (conv_id)""")
def summary_windows(spark, sf_dir):
    rows = turns(spark, sf_dir)
    marks = rows.where("role = 'system'").groupBy("conv_id").agg(F.max("turn").alias("watermark"))
    start = memory.window_start(F.col("turn"), F.col("watermark"), 2, 1)
    return rows.join(marks, "conv_id", "left").select("conv_id", "turn", start.alias("start"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS newest FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(orders, 0) AS orders, newest FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def activity_summaries(spark, sf_dir):
    """Each customer with the number and the newest of the orders, none included."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("newest"))
    customers = read(spark, sf_dir, "customer")
    out = customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left")
    return out.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), "newest")


@query("""
WITH mid AS (SELECT ts, event_id FROM events ORDER BY abs(event_id - (SELECT max(event_id) // 2 FROM events)), event_id LIMIT 1)
SELECT e.event_id, e.user_id FROM events e, mid WHERE (e.ts, e.event_id) > (mid.ts, mid.event_id) ORDER BY e.ts, e.event_id LIMIT 51""")
def keyset_page_ascending(spark, sf_dir):
    """The page after the event in the middle: fifty and one more, which says that there are more."""
    events = read(spark, sf_dir, "events")
    half = events.agg(F.max("event_id")).first()[0] // 2
    mid = events.orderBy(F.abs(F.col("event_id") - half), "event_id").select("ts", "event_id").first()
    page = events.where(memory.after(tuple(mid) if mid else (), "ts", "event_id"))
    return page.orderBy("ts", "event_id").limit(51).select("event_id", "user_id")


@query("""
WITH mid AS (SELECT ts, event_id FROM events ORDER BY abs(event_id - (SELECT max(event_id) // 2 FROM events)), event_id LIMIT 1)
SELECT e.event_id, e.user_id FROM events e, mid WHERE (e.ts, e.event_id) < (mid.ts, mid.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 51""")
def keyset_page_descending(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    half = events.agg(F.max("event_id")).first()[0] // 2
    mid = events.orderBy(F.abs(F.col("event_id") - half), "event_id").select("ts", "event_id").first()
    page = events.where(memory.after(tuple(mid) if mid else (), "ts", "event_id", descending=True))
    return page.orderBy(F.desc("ts"), F.desc("event_id")).limit(51).select("event_id", "user_id")


@query("""
SELECT conv_id, high + row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS turn, pos, text
FROM (SELECT conv_id, turn AS pos, upper(role) AS text FROM conversations) n JOIN (SELECT conv_id, max(turn) AS high FROM conversations GROUP BY 1) USING (conv_id)""")
def appended_turns(spark, sf_dir):
    log = turns(spark, sf_dir)
    new = log.select("conv_id", F.col("turn").alias("pos"), F.upper("role").alias("text"))
    return memory.appended(log, new).select("conv_id", "turn", "pos", "text")


@query("""
SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS spent FROM conversations) WHERE spent <= 1500""")
def recent_turns_in_budget(spark, sf_dir):
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    spent = turns(spark, sf_dir).withColumn("spent", F.sum(F.length("text")).over(newest))
    return spent.where("spent <= 1500").select("conv_id", "turn", "spent")


@query("""
SELECT conv_id, arg_max(text, turn) AS newest, arg_min(text, turn) AS oldest,
  (sum(length(text)) // 4)::BIGINT AS tokens, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY 1""")
def conversation_states(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("newest"),
        F.min_by("text", "turn").alias("oldest"),
        F.floor(F.sum(F.length("text")) / 4).alias("tokens"),
        F.count_if(F.col("role") == "assistant").alias("answers"),
    )


@query()
def turn_batches(spark, sf_dir):
    return memory.batched(turns(spark, sf_dir), 2000, 300)


@query(r"""
WITH names AS (SELECT p_size % 5 AS owner, p_type AS stem, p_partkey % 4 + 1 AS number FROM part)
SELECT owner, stem, min(n) AS free FROM (SELECT DISTINCT owner, stem, unnest(range(1, 6)) AS n FROM names) x
WHERE NOT EXISTS (SELECT 1 FROM names t WHERE t.owner = x.owner AND t.stem = x.stem AND t.number = x.n) GROUP BY 1, 2""")
def first_free_names(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    names = part.select((F.col("p_size") % 5).alias("owner"), F.col("p_type").alias("stem"), (F.col("p_partkey") % 4 + 1).alias("number"))
    return memory.first_free(names)


@query("""
SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, min(ts) AS first, max(ts) AS last,
  CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_kind FROM events GROUP BY 1""")
def owner_backfill(spark, sf_dir):
    """Per user the counts, and the kind of event where it is the only one."""
    only = F.when(F.count_distinct("event_type") == 1, F.min("event_type"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), only.alias("only_kind"),
    )


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_sources(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("""
SELECT event_id, event_type, sync_no FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sync_no FROM events
  WHERE event_id > (SELECT max(event_id) // 2 FROM events))""")
def incremental_sync(spark, sf_dir):
    """What a second sync adds after the first took the lower half of the ids."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    half = events.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    fresh = tables.new_rows(events.where(F.col("event_id") <= half), events, ["event_id"], F.asc("event_type"))
    order = Window.partitionBy("event_type").orderBy("event_id")
    return fresh.withColumn("sync_no", F.row_number().over(order)).withColumn("sync_no", F.col("sync_no").cast("long"))


@query(r"""SELECT conv_id, turn, lower(trim(regexp_replace(text, '[\s\x0b\x85\p{Z}]+', ' ', 'g'))) AS key FROM conversations
QUALIFY row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[\s\x0b\x85\p{Z}]+', ' ', 'g'))) ORDER BY conv_id, turn) = 1""")
def distinct_turn_texts(spark, sf_dir):
    keyed = turns(spark, sf_dir).withColumn("key", F.lower(T.fold_white(F.col("text"))))
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("conv_id", "turn")))
    return first.where("nth = 1").select("conv_id", "turn", "key")
