"""Cadence queries over ``events``."""

from murmurlake.operators import cadence
from murmurlake.sources.messages import SQL_EVENTS, event_messages

NAMES = {
    "cadence_hourly": cadence.hourly,
    "cadence_daily": cadence.daily,
    "cadence_daily_peak": cadence.peaks,
    "cadence_weekday_hour": cadence.weekday_hour,
    "cadence_weekday_observed": cadence.weekday_observed,
    "cadence_top_spikes": cadence.top_spikes,
    "cadence_spike_messages": cadence.spike_messages,
    "cadence_summary": cadence.summary,
    "cadence_calendar_pivot": cadence.calendar,
    "cadence_smoothed_media_share": cadence.smoothed_media_share,
}
QUERIES = {name: lambda spark, sf_dir, f=f: f(event_messages(spark, sf_dir)) for name, f in NAMES.items()}

_HOURS = f"""WITH {SQL_EVENTS},
hh AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, count(*) AS n, count(*) FILTER (has_media) AS m FROM ev GROUP BY 1),
hg AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hh),
h AS (SELECT hour, coalesce(n, 0)::BIGINT AS messages, coalesce(m, 0)::BIGINT AS media FROM hg LEFT JOIN hh USING (hour)),
dg AS (SELECT unnest(generate_series(min(timestamp)::DATE, max(timestamp)::DATE, INTERVAL 1 DAY))::DATE AS day FROM ev),
d AS (SELECT day, count(message_id)::BIGINT AS messages, count(*) FILTER (has_media)::BIGINT AS media FROM dg LEFT JOIN ev ON timestamp::DATE = day GROUP BY day),
c AS (SELECT day, x.hour, count(message_id) AS messages FROM dg CROSS JOIN (SELECT unnest(range(24)) AS hour) x LEFT JOIN ev ON timestamp::DATE = day AND hour(timestamp) = x.hour GROUP BY ALL),
pk AS (SELECT day, hour::BIGINT AS peak_hour, messages::BIGINT AS peak_messages FROM c WHERE messages > 0 QUALIFY row_number() OVER (PARTITION BY day ORDER BY messages DESC, hour) = 1),
sp AS (SELECT row_number() OVER (ORDER BY messages DESC, hour)::BIGINT AS rank, hour, messages, media FROM h WHERE messages > 0 QUALIFY rank <= 10)
"""
_SHARE = "round(100.0::DOUBLE * media / nullif(messages, 0), 6) AS media_share"
SQL = {
    "cadence_hourly": f"{_HOURS} SELECT hour, messages, media, {_SHARE} FROM h",
    "cadence_daily": f"{_HOURS} SELECT day, messages, media, {_SHARE}, peak_hour, peak_messages FROM d LEFT JOIN pk USING (day)",
    "cadence_daily_peak": f"{_HOURS} SELECT * FROM pk",
    "cadence_weekday_hour": f"{_HOURS} SELECT (isodow(day) - 1)::BIGINT AS weekday, hour::BIGINT AS hour, round(avg(messages), 6) AS mean_messages FROM c GROUP BY ALL",
    "cadence_weekday_observed": f"{_HOURS} SELECT (isodow(day) - 1)::BIGINT AS weekday, count(*) AS days FROM dg GROUP BY ALL",
    "cadence_top_spikes": f"{_HOURS} SELECT * FROM sp",
    "cadence_spike_messages": f"{_HOURS} SELECT rank, sp.hour, messages, message_id, text FROM sp JOIN ev ON date_trunc('hour', timestamp)::TIMESTAMP = sp.hour QUALIFY row_number() OVER (PARTITION BY rank ORDER BY length(text) DESC, message_id) = 1",
    "cadence_summary": f"""{_HOURS} SELECT sum(messages)::BIGINT AS messages, count(*) AS days, round(sum(messages) / count(*), 6) AS mean_a_day, round(100.0::DOUBLE * sum(media) / nullif(sum(messages), 0), 6) AS media_share,
  (SELECT day FROM d ORDER BY messages DESC, day LIMIT 1) AS busiest_day, (SELECT hour(timestamp)::BIGINT FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour FROM d""",
    "cadence_calendar_pivot": f"{_HOURS} SELECT day, " + ", ".join(f"sum(messages) FILTER (hour = {h})::BIGINT AS h{h:02d}" for h in range(24)) + " FROM c GROUP BY day",
    "cadence_smoothed_media_share": f"{_HOURS} SELECT hour, round(100.0::DOUBLE * sum(media) OVER w / nullif(sum(messages) OVER w, 0), 6) AS media_share FROM h WINDOW w AS (ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
}
