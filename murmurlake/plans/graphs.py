"""Entity, thread, topic and archive queries."""

from pyspark.sql import functions as F

from murmurlake.operators import entities, scores, threads, topics
from murmurlake.sources import archive
from murmurlake.sources.messages import SQL_DOCS, SQL_EVENTS, document_messages, event_messages, table


def _edges(s, d):
    return entities.edges(entities.capitalised(document_messages(s, d)))


def _topics(s, d):
    t = table(s, d, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("label").cast("bigint").alias("topic"))
    return document_messages(s, d).join(t, "message_id")


def _examples(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("label").cast("bigint").alias("topic"), F.col("embedding")[0].cast("double").alias("score"))
    return scores.examples(rows, "topic", "score")


def _turns(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), "role")


def _upsert(s, d):
    turns = _turns(s, d)
    edits = turns.where("role = 'user'").withColumn("text", F.concat("text", F.lit(" (edited)")))
    replies = turns.withColumn("message_id", F.col("message_id") + 100)
    return archive.upsert(turns.drop("role"), edits.unionByName(replies).drop("role"))


def _chats(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("chat_id"), F.lower("c_mktsegment").alias("chat_type"), F.col("c_name").alias("title"), F.concat(F.lit("U"), F.col("c_nationkey").cast("string")).alias("username"), F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "-").alias("slug"))


def _orders(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").alias("message_id"), "o_orderstatus")


def _sync(s, d):
    orders = _orders(s, d)
    state = orders.where("o_orderstatus = 'F'").groupBy("chat_id").agg(F.max("message_id").alias("last_message_id"))
    return archive.advance(state, archive.new_messages(orders, state))


def _missing(s, d):
    refs = F.when(F.col("value") > 100, F.array("text")).otherwise(F.array().cast("array<string>"))
    return archive.missing_media(event_messages(s, d).withColumn("media_refs", refs)).select("message_id", "timestamp")


def _communities(s, d):
    e = _edges(s, d)
    return entities.communities(e)


QUERIES = {
    "entity_summary": lambda s, d: entities.summary(entities.capitalised(document_messages(s, d))),
    "entity_pairs": lambda s, d: entities.pairs(entities.capitalised(document_messages(s, d))),
    "entity_network_edges": _edges,
    "entity_network_nodes": lambda s, d: entities.nodes(_edges(s, d)),
    "entity_ego": lambda s, d: entities.ego(_edges(s, d)),
    "entity_communities": _communities,
    "thread_depth": lambda s, d: threads.depths(event_messages(s, d)),
    "thread_summary": lambda s, d: threads.summaries(event_messages(s, d)),
    "topic_summary": lambda s, d: topics.summary(_topics(s, d)),
    "topic_daily_share": lambda s, d: topics.daily_share(_topics(s, d)),
    "topic_examples": _examples,
    "cosine_pairs": lambda s, d: topics.neighbour_cosine(table(s, d, "embeddings")),
    "topic_clusters": lambda s, d: topics.clusters(table(s, d, "embeddings")),
    "archive_upsert_merge": _upsert,
    "chat_filter": lambda s, d: archive.filter_chats(_chats(s, d), ("building", "machinery"), exclude=("@u7", "customer-000000010")).select("chat_id", "chat_type", "title", F.concat_ws(",", archive.selectors()).alias("selectors")),
    "missing_media": _missing,
    "incremental_sync": _sync,
}

_MENTIONS = f"WITH {SQL_DOCS}, me AS (SELECT message_id, timestamp, surface, lower(surface) AS entity FROM (SELECT message_id, timestamp, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{{3,}}')) AS surface FROM dm))"
_PAIRS = f"""{_MENTIONS}, di AS (SELECT DISTINCT message_id, timestamp, entity FROM me), kn AS (SELECT entity FROM di GROUP BY entity HAVING count(*) >= 3), dk AS (SELECT * FROM di SEMI JOIN kn USING (entity)),
pr AS (SELECT x.entity AS a, y.entity AS b, count(*) AS weight, min(x.timestamp) AS first_at, max(x.timestamp) AS last_at FROM dk x JOIN dk y ON x.message_id = y.message_id AND x.entity < y.entity GROUP BY ALL),
ed AS (SELECT a, b, weight FROM pr WHERE weight >= 2), bw AS (SELECT a AS x, b AS y, weight FROM ed UNION ALL SELECT b, a, weight FROM ed)"""
_THREADS = f"""WITH RECURSIVE {SQL_EVENTS},
t AS (SELECT message_id, coalesce(parent_id, message_id) AS root_id, (parent_id IS NOT NULL)::BIGINT AS depth, parent_id IS NOT NULL AND parent_id NOT IN (SELECT message_id FROM ev) AS external_root FROM ev WHERE parent_id IS NULL OR parent_id NOT IN (SELECT message_id FROM ev)
  UNION ALL SELECT ev.message_id, t.root_id, t.depth + 1, t.external_root FROM ev JOIN t ON ev.parent_id = t.message_id)"""
_TP = f"WITH {SQL_DOCS}, tp AS (SELECT dm.*, label::BIGINT AS topic FROM dm JOIN embeddings ON vec_id = message_id)"
SQL = {
    "entity_summary": f"{_MENTIONS}, fo AS (SELECT entity, surface, count(*) AS n FROM me GROUP BY ALL), ra AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, surface) AS p FROM fo), na AS (SELECT entity, sum(n)::BIGINT AS mentions, count(*) AS surfaces, string_agg(surface, ', ' ORDER BY p) FILTER (p <= 5) AS top_surfaces FROM ra GROUP BY entity) SELECT na.*, m.messages FROM na JOIN (SELECT entity, count(DISTINCT message_id) AS messages FROM me GROUP BY entity) m USING (entity)",
    "entity_pairs": f"{_PAIRS} SELECT * FROM pr",
    "entity_network_edges": f"{_PAIRS} SELECT * FROM ed",
    "entity_network_nodes": f"{_PAIRS} SELECT x AS entity, count(*) AS degree, sum(weight)::BIGINT AS weighted_degree, string_agg(y, ', ' ORDER BY p) FILTER (p <= 5) AS strongest FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY weight DESC, y) AS p FROM bw) GROUP BY x",
    "entity_ego": f"{_PAIRS}, ce AS (SELECT x AS centre FROM bw GROUP BY x ORDER BY sum(weight) DESC, x LIMIT 4) SELECT centre, row_number() OVER (PARTITION BY centre ORDER BY weight DESC, y)::BIGINT AS place, y AS neighbour, weight FROM bw JOIN ce ON centre = x QUALIFY place <= 10",
    "thread_depth": f"{_THREADS} SELECT 0::BIGINT AS channel_id, message_id, root_id, depth, external_root FROM t",
    "thread_summary": f"""{_THREADS}, ib AS (SELECT parent_id AS message_id, count(*) AS replies FROM ev WHERE parent_id IS NOT NULL GROUP BY 1),
r AS (SELECT t.*, timestamp, parent_id, coalesce(replies, 0) AS replies FROM t JOIN ev USING (message_id) LEFT JOIN ib USING (message_id))
SELECT 0::BIGINT AS channel_id, root_id, count(*) AS messages, count(parent_id) AS replies, max(depth) AS depth, bool_or(external_root) AS external_root, min(timestamp) AS first_at, max(timestamp) AS last_at, CASE WHEN max(r.replies) > 0 THEN arg_max(message_id, (r.replies, -message_id)) END AS top_replied_id, count(*) = 1 AS isolated FROM r GROUP BY root_id""",
    "topic_summary": f"{_TP} SELECT topic, count(*) AS messages, round(avg(length(coalesce(text, ''))), 6) AS mean_length, min(timestamp) AS first_at, max(timestamp) AS last_at, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM tp GROUP BY topic",
    "topic_daily_share": f"{_TP}, dg AS (SELECT unnest(generate_series(min(timestamp)::DATE, max(timestamp)::DATE, INTERVAL 1 DAY))::DATE AS day FROM tp), c AS (SELECT timestamp::DATE AS day, topic, count(*) AS n FROM tp GROUP BY ALL), f AS (SELECT day, topic, coalesce(n, 0)::BIGINT AS n FROM dg CROSS JOIN (SELECT DISTINCT topic FROM tp) LEFT JOIN c USING (day, topic)) SELECT day, topic, n AS messages, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY day), 0), 0), 9)::DOUBLE AS share FROM f",
    "topic_examples": "SELECT label::BIGINT AS topic, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id)::BIGINT AS place, vec_id AS message_id, embedding[1]::DOUBLE AS score FROM embeddings QUALIFY place <= 3",
    "cosine_pairs": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id - 1",
    "archive_upsert_merge": """WITH t AS (SELECT conv_id AS chat_id, turn AS message_id, text, conv_id * 1000 + turn AS position, role FROM conversations),
x AS (SELECT max(position) + 1 AS last FROM t), y AS (SELECT min(position) AS start FROM t)
SELECT chat_id, message_id, CASE WHEN role = 'user' THEN text || ' (edited)' ELSE text END AS text, position FROM t UNION ALL SELECT chat_id, message_id + 100, text, last + position - start FROM t, x, y""",
    "chat_filter": """WITH c AS (SELECT c_custkey AS chat_id, lower(c_mktsegment) AS chat_type, c_name AS title, 'U' || c_nationkey AS username, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug FROM customer),
n AS (SELECT *, CASE WHEN slug = lower(title) THEN [chat_id::VARCHAR, slug, lower(username), '@' || lower(username)] ELSE [chat_id::VARCHAR, slug, lower(title), lower(username), '@' || lower(username)] END AS names FROM c)
SELECT chat_id, chat_type, title, array_to_string(names, ',') AS selectors FROM n WHERE chat_type IN ('building', 'machinery') AND NOT list_has_any(names, ['@u7', 'customer-000000010'])""",
    "missing_media": f"WITH {SQL_EVENTS} SELECT message_id, timestamp FROM ev WHERE has_media AND NOT coalesce(value > 100, false)",
    "incremental_sync": """WITH s AS (SELECT o_custkey AS chat_id, max(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey AS chat_id, greatest(coalesce(any_value(m), 0), max(o_orderkey) FILTER (o_orderkey > coalesce(m, 0))) AS last_message_id, count(*) FILTER (o_orderkey > coalesce(m, 0)) AS exported FROM orders LEFT JOIN s ON chat_id = o_custkey GROUP BY 1""",
}
