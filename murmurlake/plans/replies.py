"""Reply queries over ``events`` and ``conversations``."""

from murmurlake.operators import replies
from murmurlake.sources.messages import SQL_EVENTS, conversation_messages, event_messages

NAMES = {
    "reply_edges": replies.edges,
    "reply_counts": replies.counts,
    "reply_distribution": replies.distribution,
    "reply_hourly_rate": replies.hourly_rate,
    "reply_first_latency": replies.first_latency,
    "reply_top": replies.top,
    "reply_missing_parent": replies.missing_parents,
    "reply_media_contingency": replies.media_contingency,
    "reply_summary": replies.summary,
}
QUERIES = {name: lambda spark, sf_dir, f=f: f(event_messages(spark, sf_dir)) for name, f in NAMES.items()}
QUERIES["reply_content_review"] = lambda spark, sf_dir: replies.content_review(conversation_messages(spark, sf_dir))

_BASE = f"""WITH {SQL_EVENTS},
e AS (SELECT 0::BIGINT AS channel_id, r.message_id, r.parent_id, p.message_id IS NOT NULL AS parent_present, (epoch_us(r.timestamp) - epoch_us(p.timestamp)) / 6e7 AS minutes, r.timestamp FROM ev r LEFT JOIN ev p ON p.message_id = r.parent_id WHERE r.parent_id IS NOT NULL),
c AS (SELECT 0::BIGINT AS channel_id, m.message_id, m.timestamp, m.has_media, m.parent_id, coalesce(n, 0)::BIGINT AS replies FROM ev m LEFT JOIN (SELECT parent_id, count(*) AS n FROM ev WHERE parent_id IS NOT NULL GROUP BY 1) i ON i.parent_id = m.message_id),
f AS (SELECT channel_id, parent_id, message_id AS first_reply_id, minutes FROM e WHERE parent_present QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY timestamp, message_id) = 1)
"""
_WORDS = "list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '([A-Za-z][A-Za-z''-]{2,})', 1), lambda x: lower(x)))"
_CORRECTS = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in replies.CORRECTIONS)
SQL = {
    "reply_edges": f"{_BASE} SELECT channel_id, message_id, parent_id, parent_present, minutes FROM e",
    "reply_counts": f"{_BASE} SELECT * FROM c",
    "reply_distribution": f"{_BASE} SELECT least(replies, 3) AS replies, count(*) AS messages, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY 1",
    "reply_hourly_rate": f"{_BASE} SELECT hour(timestamp)::BIGINT AS hour, count(*) AS messages, round(100.0::DOUBLE * avg((replies > 0)::INT), 6) AS reply_rate, round(avg(replies), 6) AS mean_replies FROM c GROUP BY 1",
    "reply_first_latency": f"{_BASE} SELECT * FROM f",
    "reply_top": f"{_BASE} SELECT row_number() OVER (ORDER BY replies DESC, timestamp, message_id)::BIGINT AS rank, channel_id, message_id, replies FROM c WHERE replies > 0 QUALIFY rank <= 20",
    "reply_missing_parent": f"{_BASE} SELECT channel_id, parent_id, count(*) AS replies FROM e WHERE NOT parent_present GROUP BY ALL",
    "reply_media_contingency": f"{_BASE} SELECT has_media, replies > 0 AS has_replies, count(*) AS messages FROM c GROUP BY ALL",
    "reply_summary": f"{_BASE} SELECT count(*) AS messages, count(parent_id) AS replies, count(*) FILTER (replies > 0) AS replied_to, max(replies) AS most_replies, (SELECT count(*) FILTER (parent_present) FROM e) AS parent_present, (SELECT round(quantile_cont(minutes, 0.5), 6) FROM f) AS median_minutes FROM c",
    "reply_content_review": f"""WITH m AS (SELECT conv_id AS channel_id, turn AS message_id, text, {_WORDS} AS ws FROM conversations),
j AS (SELECT r.channel_id, r.message_id, p.message_id AS parent_id, r.text, CASE WHEN len(r.ws) > 0 AND len(p.ws) > 0 THEN len(list_intersect(r.ws, p.ws)) / len(list_distinct(list_concat(r.ws, p.ws))) ELSE 0 END AS s FROM m r JOIN m p ON p.channel_id = r.channel_id AND p.message_id = r.message_id - 1)
SELECT channel_id, message_id, parent_id, round(s, 6) AS jaccard, CASE WHEN {_CORRECTS} THEN 'correction' WHEN s >= 0.72 THEN 'continuation' WHEN s <= 0.35 THEN 'related' WHEN s > 0 THEN 'continuation' ELSE 'related' END AS hint FROM j""",
}
