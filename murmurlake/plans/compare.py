"""Segment comparison, score and frame queries over ``documents``, ``labels`` and ``embeddings``."""

from pyspark.sql import functions as F

from murmurlake.functions import stats
from murmurlake.operators import scores, segments
from murmurlake.operators.entities import capitalised
from murmurlake.sources.messages import SQL_DOCS, SQL_EVENTS, SQL_SCORES, document_messages, event_messages, label_scores, table


def _topics(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("label").cast("bigint").alias("topic"))


def _joined(s, d):
    return segments.star(document_messages(s, d), label_scores(s, d), _topics(s, d))


def _scored(s, d):
    return document_messages(s, d).select("message_id", "timestamp").join(label_scores(s, d), "message_id")


def _framed(s, d):
    """Eight coordinates of each vector stand in for the frame scores of its message."""
    hours = F.make_dt_interval(hours=F.col("vec_id").cast("int"))
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("message_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("timestamp"), *(F.abs(F.col("embedding")[i].cast("double")).alias(x) for i, x in enumerate(scores.FRAMES)))
    return rows.withColumns(scores.best_two({x: F.col(x) for x in scores.FRAMES}, 0.15))


QUERIES = {
    "media_star_join": lambda s, d: _joined(s, d).select("message_id", "has_media", "sentiment", "score", "topic", "frame"),
    "media_segment_summary": lambda s, d: segments.summary(_joined(s, d)),
    "media_hourly_share": lambda s, d: segments.hourly_share(event_messages(s, d)),
    "media_topic_distribution": lambda s, d: segments.distribution(_joined(s, d), "topic"),
    "media_entity_distribution": lambda s, d: segments.entity_distribution(document_messages(s, d), capitalised(document_messages(s, d))),
    "media_top_value": lambda s, d: segments.top_value(_joined(s, d), "topic"),
    "media_overview": lambda s, d: segments.overview(_joined(s, d)),
    "media_mannwhitney": lambda s, d: stats.mann_whitney(event_messages(s, d), "has_media", "value"),
    "media_chisquare": lambda s, d: stats.chi_square(_joined(s, d), "has_media", "sentiment"),
    "media_hour_density": lambda s, d: stats.hour_density(event_messages(s, d).withColumn("h", F.hour("timestamp")), "has_media", "h"),
    "sentiment_window": lambda s, d: scores.windows(_scored(s, d)),
    "sentiment_hourly_change": lambda s, d: scores.hourly_change(_scored(s, d)),
    "sentiment_candidate_events": lambda s, d: scores.candidate_events(_scored(s, d)),
    "label_counts": lambda s, d: scores.label_counts(_scored(s, d)),
    "dominant_label_hourly": lambda s, d: scores.dominant_hourly(_scored(s, d)),
    "emotion_window_share": lambda s, d: scores.window_shares(_scored(s, d)),
    "frame_second_best": lambda s, d: _framed(s, d).select("message_id", "frame", "frame_confidence", "second_frame", "second_confidence", "confidence_gap"),
    "frame_label_counts": lambda s, d: scores.frame_counts(_framed(s, d), (*scores.FRAMES, "mixed")),
    "frame_window_share": lambda s, d: scores.frame_windows(_framed(s, d)),
    "frame_half_summary": lambda s, d: scores.frame_halves(_framed(s, d)),
    "frame_half_flow": lambda s, d: scores.frame_flow(_framed(s, d)),
    "frame_sentiment_crosstab": lambda s, d: scores.crosstab(_framed(s, d), label_scores(s, d)),
    "frame_examples": lambda s, d: scores.examples(_framed(s, d), "frame", "frame_confidence"),
    "frame_validation_sample": lambda s, d: scores.stratified_sample(_framed(s, d), "frame").select("frame", "place", "message_id"),
}

_J = f"""WITH {SQL_DOCS}, {SQL_SCORES},
j AS (SELECT dm.*, CASE WHEN has_media THEN 'media' ELSE 'text' END AS segment, sentiment, score, label::BIGINT AS topic FROM dm LEFT JOIN (SELECT message_id, (min({{'a': sentiment, 'b': score}})).a AS sentiment, (min({{'a': sentiment, 'b': score}})).b AS score FROM sc GROUP BY 1) s USING (message_id) LEFT JOIN embeddings ON vec_id = message_id)"""
_SC = f"WITH {SQL_DOCS}, {SQL_SCORES}, s AS (SELECT message_id, timestamp, sentiment, score FROM dm JOIN sc USING (message_id))"
_W6 = "date_trunc('day', timestamp)::TIMESTAMP + (hour(timestamp) // 6 * 6)::INT * INTERVAL 1 HOUR"
_LABELS = ", ".join(f"count(*) FILTER (sentiment = '{x}') AS {x}" for x in scores.SENTIMENTS)
_HOURLY = f"""{_SC}, hh AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, count(*) AS n, avg(score) AS mean, arg_max(message_id, (abs(score), -message_id)) AS extreme_id FROM s GROUP BY 1),
hg AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hh),
h AS (SELECT hour, coalesce(n, 0)::BIGINT AS n, coalesce(mean, 0) AS mean, extreme_id FROM hg LEFT JOIN hh USING (hour)),
hc AS (SELECT hour, n, round(mean, 9) AS mean, round(abs(mean), 9) AS size, round(coalesce(abs(mean - lag(mean) OVER (ORDER BY hour)), 0), 9) AS change, extreme_id FROM h)"""
_F = list(scores.FRAMES)
_GREATEST = "greatest(" + ", ".join(_F) + ")"
_FRAMED = f"""WITH v AS (SELECT vec_id AS message_id, TIMESTAMP '2024-01-01' + vec_id::INT * INTERVAL 1 HOUR AS timestamp, {", ".join(f"abs(embedding[{i + 1}]::DOUBLE) AS {x}" for i, x in enumerate(_F))} FROM embeddings),
lg AS (SELECT message_id, x.i, x.k, x.s, row_number() OVER (PARTITION BY message_id ORDER BY x.s DESC, x.i) AS p FROM (SELECT message_id, unnest([{", ".join(f"{{'i': {i}, 'k': '{x}', 's': {x}}}" for i, x in enumerate(_F))}]) AS x FROM v)),
f AS (SELECT v.*, CASE WHEN a.s < 0.15 THEN 'mixed' ELSE a.k END AS frame, a.s AS frame_confidence, b.k AS second_frame, b.s AS second_confidence, a.s - b.s AS confidence_gap FROM v JOIN lg a ON a.message_id = v.message_id AND a.p = 1 JOIN lg b ON b.message_id = v.message_id AND b.p = 2)"""
_HALF = f"""{_FRAMED}, md AS (SELECT epoch_us(min(timestamp)) + (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 2 AS m FROM f),
hv AS (SELECT half, frame, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY half), 6) AS share FROM (SELECT frame, CASE WHEN epoch_us(timestamp) <= m THEN 1 ELSE 2 END::BIGINT AS half FROM f, md) GROUP BY half, frame)"""
_TOTAL = " + ".join(_F)
SQL = {
    "media_star_join": f"{_J} SELECT message_id, has_media, sentiment, score, topic, NULL::VARCHAR AS frame FROM j",
    "media_segment_summary": f"{_J} SELECT segment, count(*) AS messages, round(avg(length(coalesce(text, ''))), 6) AS mean_length, quantile_cont(length(coalesce(text, ''))::DOUBLE, 0.5) AS median_length, round(avg(score), 6) AS mean_score, quantile_cont(score, 0.5) AS median_score, count(topic) AS with_topic, count(sentiment) AS with_sentiment, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM j GROUP BY segment",
    "media_hourly_share": f"WITH {SQL_EVENTS}, g AS (SELECT s AS segment, h AS hour FROM (SELECT unnest(['media', 'text']) AS s), (SELECT unnest(range(24))::BIGINT AS h)), c AS (SELECT CASE WHEN has_media THEN 'media' ELSE 'text' END AS segment, hour(timestamp)::BIGINT AS hour, count(*) AS n FROM ev GROUP BY ALL) SELECT segment, hour, coalesce(n, 0)::BIGINT AS messages, round(coalesce(100.0::DOUBLE * coalesce(n, 0) / nullif(sum(n) OVER (PARTITION BY segment), 0), 0), 6) AS share FROM g LEFT JOIN c USING (segment, hour)",
    "media_topic_distribution": f"{_J}, t AS (SELECT topic::VARCHAR AS category, count(*) AS total, count(*) FILTER (has_media) AS media, count(*) FILTER (NOT has_media) AS text FROM j WHERE topic IS NOT NULL GROUP BY 1 ORDER BY total DESC, category LIMIT 8), x AS (SELECT *, 100.0::DOUBLE * media / sum(media) OVER () AS ms, 100.0::DOUBLE * text / sum(text) OVER () AS ts FROM t) SELECT category, total, media, text, round(ms, 6) AS media_share, round(ts, 6) AS text_share, round(ms - ts, 6) AS gap FROM x",
    "media_entity_distribution": f"{_J}, e AS (SELECT DISTINCT message_id, has_media, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'))) AS entity FROM dm WHERE trim(coalesce(text, '')) <> ''), n AS (SELECT count(*) FILTER (has_media) AS nm, count(*) FILTER (NOT has_media) AS nt FROM dm WHERE trim(coalesce(text, '')) <> '') SELECT entity, count(*) FILTER (has_media) AS media, count(*) FILTER (NOT has_media) AS text, round(100.0::DOUBLE * count(*) FILTER (has_media) / any_value(nm), 6) AS media_share, round(100.0::DOUBLE * count(*) FILTER (NOT has_media) / any_value(nt), 6) AS text_share FROM e, n GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 15",
    "media_top_value": f"{_J} SELECT segment, coalesce(v, '') AS value, CASE WHEN v IS NULL THEN 0 ELSE n END AS n FROM (SELECT segment, topic::VARCHAR AS v, count(*) AS n FROM j GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY segment ORDER BY v IS NULL, n DESC, v) = 1",
    "media_overview": f"{_J} SELECT count(*) AS messages, count(*) FILTER (has_media) AS media, round(100.0::DOUBLE * avg(has_media::INT), 6) AS media_share, bool_or(sentiment IS NOT NULL) AS has_sentiment, bool_or(topic IS NOT NULL) AS has_topics FROM j",
    "media_mannwhitney": f"""WITH {SQL_EVENTS}, v AS (SELECT has_media AS g, value AS v, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM ev WHERE value IS NOT NULL),
t AS (SELECT sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS n FROM v GROUP BY v)),
s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, quantile_cont(v, 0.5) FILTER (g) AS median_1, quantile_cont(v, 0.5) FILTER (NOT g) AS median_2, sum(r) FILTER (g)::DOUBLE AS r1 FROM v),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, (n1 + n2)::DOUBLE AS n, n1::DOUBLE * n2 AS nn FROM s)
SELECT n1, n2, median_1, median_2, u, 1 - 2 * u / nn AS rank_biserial, round((greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u, t""",
    "media_chisquare": f"""{_J}, o AS (SELECT has_media AS r, sentiment AS c, count(*) AS o FROM j WHERE sentiment IS NOT NULL GROUP BY ALL), nr AS (SELECT r, sum(o) AS nr FROM o GROUP BY r), nc AS (SELECT c, sum(o) AS nc FROM o GROUP BY c),
k AS (SELECT (SELECT count(*) FROM nr) AS rows, (SELECT count(*) FROM nc) AS cols, (SELECT sum(o) FROM o)::DOUBLE AS n),
x AS (SELECT abs(coalesce(o, 0) - nr * nc / n) AS d, nr * nc / n AS e, rows, cols, n FROM nr CROSS JOIN nc CROSS JOIN k LEFT JOIN o USING (r, c)),
s AS (SELECT sum(power(CASE WHEN (rows - 1) * (cols - 1) = 1 THEN greatest(0, d - least(0.5, d)) ELSE d END, 2) / e) AS chi2, any_value(rows) AS rows, any_value(cols) AS cols, any_value(n) AS n FROM x)
SELECT round(chi2, 6) AS chi2, (rows - 1) * (cols - 1) AS dof, n::BIGINT AS n, round(sqrt(chi2 / (n * (least(rows, cols) - 1))), 6) AS cramers_v FROM s""",
    "media_hour_density": f"""WITH {SQL_EVENTS}, h AS (SELECT has_media AS segment, hour(timestamp)::DOUBLE AS h, count(*)::DOUBLE AS w FROM ev GROUP BY ALL), s AS (SELECT segment, sum(w) AS n, sqrt((sum(w * h * h) - sum(w * h) * sum(w * h) / sum(w)) / (sum(w) - 1)) * power(sum(w), -0.2) AS b FROM h GROUP BY segment HAVING sum(w) >= 3 AND count(*) >= 2)
SELECT segment, x, round(sum(w * exp(-0.5 * power((x - h) / b, 2)) / (n * b * sqrt(2 * pi()))), 9) AS density FROM h JOIN s USING (segment), (SELECT i * 23.0::DOUBLE / 239 AS x FROM (SELECT unnest(range(240)) AS i)) GROUP BY ALL""",
    "sentiment_window": f"""{_SC}, w AS (SELECT {_W6} AS start, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd FROM s GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(start) FROM w), (SELECT max({_W6.replace("timestamp)", "timestamp - INTERVAL 1 MICROSECOND)")}) + INTERVAL 6 HOUR FROM s), INTERVAL 6 HOUR)) AS start),
f AS (SELECT start, coalesce(n, 0)::BIGINT AS n, mean, CASE WHEN n > 0 THEN coalesce(sd, 0) END AS sd FROM g LEFT JOIN w USING (start))
SELECT start, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(sd / sqrt(greatest(n, 1)), 9) AS se, round(1.96::DOUBLE * sd / sqrt(greatest(n, 1)), 9) AS ci95, round(avg(mean) OVER (ORDER BY start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS rolling_mean FROM f""",
    "sentiment_hourly_change": f"{_HOURLY} SELECT * FROM hc",
    "sentiment_candidate_events": f"{_HOURLY} SELECT * FROM ((SELECT * FROM hc WHERE n > 0 ORDER BY change DESC, hour LIMIT 5) UNION (SELECT * FROM hc WHERE n > 0 ORDER BY size DESC, hour LIMIT 5) UNION (SELECT * FROM hc WHERE n > 0 ORDER BY n DESC, hour LIMIT 5)) ORDER BY change DESC, size DESC, n DESC, hour LIMIT 10",
    "label_counts": f"{_SC} SELECT sentiment, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY sentiment",
    "dominant_label_hourly": f"""{_SC}, hh AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, {_LABELS} FROM s GROUP BY 1), hg AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hh),
f AS (SELECT hour, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in scores.SENTIMENTS)} FROM hg LEFT JOIN hh USING (hour))
SELECT *, CASE WHEN greatest(negative, neutral, positive) = 0 THEN 'no_data' WHEN negative >= greatest(neutral, positive) THEN 'negative' WHEN neutral >= positive THEN 'neutral' ELSE 'positive' END AS dominant FROM f""",
    "emotion_window_share": f"""{_SC}, w AS (SELECT {_W6} AS start, {_LABELS}, count(*) AS n FROM s GROUP BY 1), g AS (SELECT unnest(generate_series(min(start), max(start), INTERVAL 6 HOUR)) AS start FROM w)
SELECT start, {", ".join(f"round(coalesce({x} / n, 0)::DOUBLE, 9) AS share_{x}" for x in scores.SENTIMENTS)} FROM g LEFT JOIN w USING (start)""",
    "frame_second_best": f"{_FRAMED} SELECT message_id, frame, frame_confidence, second_frame, second_confidence, confidence_gap FROM f",
    "frame_label_counts": f"{_FRAMED}, d AS (SELECT i::BIGINT AS place, k AS frame FROM (SELECT unnest([{', '.join(f'''{{'i': {i}, 'k': '{x}'}}''' for i, x in enumerate((*_F, 'mixed')))}], recursive := true))) SELECT place, frame, count(message_id) AS n, round(100.0::DOUBLE * count(message_id) / sum(count(message_id)) OVER (), 6) AS share FROM d LEFT JOIN f USING (frame) GROUP BY ALL",
    "frame_window_share": f"""{_FRAMED}, w AS (SELECT date_trunc('day', timestamp)::TIMESTAMP + (hour(timestamp) // 12 * 12)::INT * INTERVAL 1 HOUR AS start, {", ".join(f"avg({x}) AS {x}" for x in _F)} FROM f GROUP BY 1), g AS (SELECT unnest(generate_series(min(start), max(start), INTERVAL 12 HOUR)) AS start FROM w)
SELECT start, {", ".join(f"round(coalesce({x} / ({_TOTAL}), 0), 9) AS {x}" for x in _F)} FROM g LEFT JOIN w USING (start)""",
    "frame_half_summary": f"{_HALF} SELECT * FROM hv",
    "frame_half_flow": f"{_HALF} SELECT a.frame AS source, b.frame AS target, round(a.n * b.n / (SELECT sum(n) FROM hv WHERE half = 2), 6)::DOUBLE AS flow FROM hv a, hv b WHERE a.half = 1 AND b.half = 2",
    "frame_sentiment_crosstab": f"{_FRAMED}, {SQL_SCORES}, x AS (SELECT frame, {_LABELS}, count(*) AS n FROM f JOIN (SELECT message_id, min(sentiment) AS sentiment FROM sc GROUP BY 1) USING (message_id) GROUP BY frame) SELECT frame, negative, neutral, positive, {', '.join(f'round({x} / n, 6) AS share_{x}' for x in scores.SENTIMENTS)} FROM x",
    "frame_examples": f"{_FRAMED} SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY frame_confidence DESC, message_id)::BIGINT AS place, message_id, frame_confidence FROM f QUALIFY place <= 3",
}
