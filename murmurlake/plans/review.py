"""Reply review, annotations, entity lists and one-row summaries."""

from pyspark.sql import functions as F

from murmurlake.operators import annotations, cadence, entities, lexical, review
from murmurlake.plans import graphs, replies, words
from murmurlake.sources.messages import SQL_DOCS, SQL_EVENTS, SQL_SCORES, document_messages, event_messages, label_scores, table, with_media_flags


def _threaded(s, d):
    """Documents as messages: each answers the last one before it whose id is a multiple of seven; captions of under
    100 characters stand for messages of media alone."""
    back = F.col("message_id") % 7
    messages = document_messages(s, d).withColumns({"channel_id": F.lit(0).cast("bigint"), "reply_to_message_id": F.when(back > 0, F.col("message_id") - back)})
    return messages.withColumn("is_media_only", F.col("has_media") & (F.length(F.coalesce("text", F.lit(""))) < 100))


def _review(s, d):
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("message_id"), "embedding")
    return review.review(_threaded(s, d), vectors, label_scores(s, d))


def _spikes(s, d):
    label = F.concat(F.col("messages").cast("string"), F.lit(" messages"))
    return cadence.top_spikes(event_messages(s, d)).select("rank", F.col("hour").alias("timestamp"), label.alias("label"))


def _manual(s, d):
    """Orders as a list of annotations, blank where they are open."""
    label = F.when(F.col("o_orderstatus") != "O", F.concat("o_orderstatus", F.lit(" "), F.col("o_custkey").cast("string"))).otherwise(" ")
    return table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"), label.alias("label"))


def _mentions(s, d):
    return entities.capitalised(document_messages(s, d))


def _allowed(s, d):
    common = _mentions(s, d).groupBy("entity").agg(F.count("*").alias("n")).where("n > 50")
    return annotations.allowed(_mentions(s, d), common).groupBy("entity").agg(F.count("*").alias("mentions"))


def _scored(s, d):
    return document_messages(s, d).select("message_id", "timestamp").join(label_scores(s, d), "message_id")


QUERIES = {
    "reply_order": lambda s, d: review.ordered(event_messages(s, d)),
    "reply_latency_histogram": lambda s, d: review.latency_histogram(event_messages(s, d)),
    "reply_review": _review,
    "annotations_automatic": lambda s, d: annotations.events(_spikes(s, d)),
    "annotations_manual": lambda s, d: annotations.events(_spikes(s, d), _manual(s, d)),
    "entity_allowed": _allowed,
    "entity_lists": lambda s, d: annotations.attached(document_messages(s, d), _mentions(s, d)),
    "entity_graph_summary": lambda s, d: annotations.with_graph(entities.summary(_mentions(s, d)), entities.nodes(entities.edges(_mentions(s, d)))),
    "entity_overview": lambda s, d: annotations.entity_overview(document_messages(s, d), _mentions(s, d), entities.edges(_mentions(s, d))),
    "sentiment_overview": lambda s, d: annotations.score_overview(_scored(s, d)),
    "media_length_spread": lambda s, d: annotations.spread(document_messages(s, d).withColumn("length", F.length("text")), "has_media", "length"),
    "word_cloud": lambda s, d: annotations.cloud(lexical.period_tfidf(document_messages(s, d))),
}

_MENTIONS = f"WITH {SQL_DOCS}, mn AS (SELECT message_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]{{3,}})', 1))) AS entity FROM dm)"
SQL = {
    "reply_order": f"WITH {SQL_EVENTS} SELECT 0::BIGINT AS channel_id, message_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY timestamp, message_id)::BIGINT AS place FROM ev WHERE parent_id IS NOT NULL",
    "reply_latency_histogram": f"""{replies._BASE}, b AS (SELECT least(20, greatest(6, floor(sqrt(count(*)))::BIGINT + 2)) AS bins, CASE WHEN min(minutes) = max(minutes) THEN min(minutes) - 0.5 ELSE min(minutes) END AS lo, CASE WHEN min(minutes) = max(minutes) THEN max(minutes) + 0.5 ELSE max(minutes) END AS hi FROM f),
g AS (SELECT unnest(range(bins)) AS bin, lo, (hi - lo) / bins AS width FROM b),
x AS (SELECT least(bins - 1, floor((minutes - lo) / ((hi - lo) / bins))::BIGINT) AS bin, count(*) AS parents FROM f, b GROUP BY 1)
SELECT bin, round(lo + bin * width, 6) AS low, round(lo + (bin + 1) * width, 6) AS high, coalesce(parents, 0)::BIGINT AS parents FROM g LEFT JOIN x USING (bin)""",
    "reply_review": f"""WITH {SQL_DOCS}, {SQL_SCORES},
r AS (SELECT *, CASE WHEN message_id % 7 > 0 THEN message_id - message_id % 7 END AS parent_id, has_media AND length(coalesce(text, '')) < 100 AS media_only, {replies._WORDS} AS ws FROM dm),
m AS (SELECT r.*, e.embedding::DOUBLE[] AS v, s.sentiment, coalesce(n.replies, 0)::BIGINT AS replies FROM r LEFT JOIN embeddings e ON e.vec_id = r.message_id LEFT JOIN sc s USING (message_id) LEFT JOIN (SELECT parent_id AS message_id, count(*) AS replies FROM r WHERE parent_id IS NOT NULL GROUP BY 1) n USING (message_id)),
j AS (SELECT c.message_id, c.parent_id, c.text, c.media_only, c.sentiment, p.sentiment AS parent_sentiment, p.replies AS parent_replies, CASE WHEN len(c.ws) > 0 AND len(p.ws) > 0 THEN len(list_intersect(c.ws, p.ws)) / len(list_distinct(list_concat(c.ws, p.ws))) ELSE 0 END AS l, list_cosine_similarity(p.v, c.v) AS s FROM m c JOIN m p ON p.message_id = c.parent_id)
SELECT 0::BIGINT AS channel_id, message_id, parent_id, round(l, 6) AS jaccard, round(s, 6) AS similarity, sentiment, parent_sentiment, parent_replies,
  CASE WHEN {replies._CORRECTS} THEN 'correction' WHEN media_only THEN 'media supplement' WHEN s >= 0.72 THEN 'continuation' WHEN s <= 0.35 THEN 'related' WHEN l > 0 THEN 'continuation' ELSE 'related' END AS hint FROM j""",
    "annotations_automatic": f"WITH {SQL_EVENTS} SELECT date_trunc('hour', timestamp)::TIMESTAMP AS timestamp, count(*) || ' messages' AS label FROM ev GROUP BY date_trunc('hour', timestamp) ORDER BY count(*) DESC, 1 LIMIT 5",
    "annotations_manual": "SELECT o_orderdate::TIMESTAMP AS timestamp, min(o_orderstatus || ' ' || o_custkey) AS label FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1",
    "entity_allowed": f"{_MENTIONS} SELECT entity, count(*) AS mentions FROM mn GROUP BY entity HAVING count(*) <= 50",
    "entity_lists": f"{_MENTIONS} SELECT message_id, coalesce(es, '') AS entities, coalesce(n, 0)::BIGINT AS n_entities FROM dm LEFT JOIN (SELECT message_id, string_agg(entity, ', ' ORDER BY entity) AS es, count(*) AS n FROM (SELECT DISTINCT message_id, entity FROM mn) GROUP BY 1) USING (message_id)",
    "entity_graph_summary": f"SELECT s.*, coalesce(degree, 0)::BIGINT AS degree, coalesce(weighted_degree, 0)::BIGINT AS weighted_degree, coalesce(strongest, '—') AS strongest FROM ({graphs.SQL['entity_summary']}) s LEFT JOIN ({graphs.SQL['entity_network_nodes']}) g USING (entity)",
    "entity_overview": f"""{_MENTIONS}, ed AS ({graphs.SQL['entity_network_edges']})
SELECT (SELECT count(*) FROM dm) AS messages, (SELECT count(DISTINCT message_id) FROM mn) AS with_entities, (SELECT count(*) FROM mn) AS mentions, (SELECT count(DISTINCT entity) FROM mn) AS entities,
  (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM ed UNION ALL SELECT b FROM ed)) AS nodes, (SELECT count(*) FROM ed) AS edges""",
    "sentiment_overview": f"""WITH {SQL_DOCS}, {SQL_SCORES}, j AS (SELECT * FROM dm JOIN sc USING (message_id))
SELECT count(*) AS messages, round(avg(score), 6) AS mean_score, round(100.0::DOUBLE * avg((score > 0)::INT), 6) AS positive_share, round(100.0::DOUBLE * avg((score < 0)::INT), 6) AS negative_share, min(timestamp) AS first_at, max(timestamp) AS last_at,
  (SELECT sentiment FROM j GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant FROM j""",
    "media_length_spread": f"WITH {SQL_DOCS} SELECT has_media, count(*) AS n, min(l)::DOUBLE AS least, quantile_cont(l, 0.25)::DOUBLE AS lower, quantile_cont(l, 0.5)::DOUBLE AS median, quantile_cont(l, 0.75)::DOUBLE AS upper, max(l)::DOUBLE AS greatest FROM (SELECT has_media, length(text) AS l FROM dm WHERE text IS NOT NULL) GROUP BY has_media",
    "word_cloud": f"{words._TFIDF} SELECT period, place, term, score FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, term)::BIGINT AS place FROM ts WHERE score > 0) WHERE place <= 120",
}
