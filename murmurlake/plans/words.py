"""Vocabulary and phrase queries over ``documents``."""

from pyspark.sql import functions as F

from murmurlake.functions.text import clip_middle, lexical_tokens_sql, phrase_tokens_sql, probably_english
from murmurlake.operators import lexical, phrases
from murmurlake.sources.messages import SQL_DOCS, document_messages, table


def _scores(spark, sf_dir):
    return lexical.period_tfidf(document_messages(spark, sf_dir))


def _clean(spark, sf_dir):
    own = lexical.tokens(document_messages(spark, sf_dir))
    return own.select("message_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_different"), F.array_join("tokens", " ").alias("clean"))


QUERIES = {
    "clean_tokens": _clean,
    "period_docs": lambda s, d: lexical.period_documents(document_messages(s, d)),
    "tfidf_period": _scores,
    "tfidf_rank_shift": lambda s, d: lexical.rank_shift(_scores(s, d)),
    "tfidf_risers_fallers": lambda s, d: lexical.movers(_scores(s, d)),
    "tfidf_top_terms_status": lambda s, d: lexical.top_terms(_scores(s, d)),
    "segment_tfidf_lift": lambda s, d: lexical.segment_lift(document_messages(s, d)),
    "ctfidf_topics": lambda s, d: lexical.class_tfidf(document_messages(s, d), "source_language"),
    "bigram_counts": lambda s, d: phrases.counts(phrases.tokens(document_messages(s, d)), 2),
    "bigram_pmi": lambda s, d: phrases.pmi(phrases.tokens(document_messages(s, d)), 2, 5),
    "trigram_pmi": lambda s, d: phrases.pmi(phrases.tokens(document_messages(s, d)), 3, 3),
    "bigram_half_shift": lambda s, d: phrases.half_shift(document_messages(s, d)),
    "phrase_network_edges": lambda s, d: phrases.edges(document_messages(s, d)),
    "phrase_network_nodes": lambda s, d: phrases.nodes(phrases.edges(document_messages(s, d))),
    "phrase_summary": lambda s, d: phrases.summary(document_messages(s, d)),
    "probably_english": lambda s, d: table(s, d, "documents").select("doc_id", probably_english(F.col("text")).alias("english")),
    "clip_text": lambda s, d: table(s, d, "documents").select("doc_id", clip_middle(F.col("text"), 80).alias("clipped")),
}

_LEX = f"""WITH {SQL_DOCS},
tk AS MATERIALIZED (SELECT * FROM (SELECT *, {lexical_tokens_sql("coalesce(text, '')")} AS ws FROM dm) WHERE len(ws) > 0),
b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM tk),
pt AS (SELECT tk.*, greatest(1, least(4, ceil(coalesce((epoch_us(timestamp) - epoch_us(lo)) * 4 / nullif((epoch_us(hi) - epoch_us(lo))::DOUBLE, 0), 1))))::BIGINT AS period FROM tk, b)"""
_TFIDF = f"""{_LEX},
pc AS (SELECT period, term, count(*) AS n FROM (SELECT period, unnest(flatten(list_transform(ws, lambda w: string_split(w, '-')))) AS term FROM pt) WHERE length(term) >= 2 GROUP BY ALL),
tot AS (SELECT term, count(*) AS df FROM pc GROUP BY term ORDER BY sum(n) DESC, term LIMIT 500),
wt AS (SELECT period, term, n, n * (ln(5.0::DOUBLE / (1 + df)) + 1) AS w FROM pc JOIN tot USING (term)),
ts AS MATERIALIZED (SELECT period, term, n, round(w / sqrt(sum(w * w) OVER (PARTITION BY period)), 9) AS score FROM wt),
terms AS (SELECT DISTINCT term FROM ts),
rk AS MATERIALIZED (SELECT term, period, score, CASE WHEN score > 0 THEN row_number() OVER (PARTITION BY period ORDER BY score DESC, term) ELSE (SELECT count(*) + 1 FROM terms) END::BIGINT AS rank
  FROM (SELECT term, g.period, coalesce(score, 0) AS score FROM terms CROSS JOIN (SELECT unnest(range(1, 5))::BIGINT AS period) g LEFT JOIN ts USING (term, period))),
sh AS (SELECT term, max(rank) FILTER (period = 1) AS first_rank, max(rank) FILTER (period = 4) AS last_rank, min(rank) AS best_rank, max(score) AS max_score, max(score) FILTER (period = 1) AS first_score, max(score) FILTER (period = 4) AS last_score, first_rank - last_rank AS delta FROM rk GROUP BY term)"""


def _phrase_base(where: str = "true") -> str:
    return f"""WITH {SQL_DOCS},
pa AS MATERIALIZED (SELECT * FROM (SELECT *, {phrase_tokens_sql("coalesce(text, '')")} AS ws FROM dm) WHERE len(ws) > 0)"""


def _pmi(name: str, source: str, n: int, least: int, floor: str) -> str:
    """Words as rows with their place; the n - 1 words after each make its phrase."""
    leads = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, n))
    phrase = " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, n))])
    each = ", ".join(["w", *(f"w{k}" for k in range(1, n))])
    joins = " ".join(f"JOIN {name}u u{i} ON u{i}.w = c.{'w' + str(i) if i else 'w'}" for i in range(n))
    product = " - ".join(f"log2(u{i}.c)" for i in range(n))
    return f""",
{name}w AS MATERIALIZED (SELECT message_id, timestamp, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM {source} WHERE len(ws) >= {n}),
{name}u AS MATERIALIZED (SELECT w, count(*)::DOUBLE AS c FROM {name}w GROUP BY w),
{name}g AS (SELECT message_id, timestamp, w, {leads} FROM {name}w WINDOW o AS (PARTITION BY message_id ORDER BY i)),
{name}m AS (SELECT message_id, {each}, count(*) AS k, min(timestamp) AS t FROM {name}g WHERE w{n - 1} IS NOT NULL GROUP BY ALL),
{name}c AS (SELECT {each}, {phrase} AS phrase, sum(k)::BIGINT AS n, count(*) AS messages, min(t) AS first_at, max(t) AS last_at FROM {name}m GROUP BY {each}),
{name} AS (SELECT phrase, n, messages, first_at, last_at, pmi, round(pmi * n, 6) AS network_score FROM (SELECT c.*, round(log2(n::DOUBLE) + {n - 1} * log2((SELECT sum(c) FROM {name}u)) - {product}, 6) AS pmi FROM (SELECT * FROM {name}c WHERE n >= {least}) c {joins}) WHERE {floor})"""


_PH = _phrase_base()
_EDGES = f"{_PH}{_pmi('p2', 'pa', 2, 5, 'pmi >= 3')}, ed AS (SELECT string_split(phrase, ' ')[1] AS src, string_split(phrase, ' ')[2] AS dst, n, pmi, network_score AS weight FROM p2 ORDER BY network_score DESC, phrase LIMIT 40)"
_TOP = "ORDER BY pmi DESC, n DESC, messages DESC, phrase LIMIT 50"
SQL = {
    "clean_tokens": f"{_LEX} SELECT message_id, len(ws) AS n_tokens, len(list_distinct(ws)) AS n_different, array_to_string(ws, ' ') AS clean FROM tk",
    "period_docs": f"{_LEX} SELECT period, count(*) AS messages, sum(len(ws))::BIGINT AS tokens, min(timestamp) AS first_at, max(timestamp) AS last_at FROM pt GROUP BY period",
    "tfidf_period": f"{_TFIDF} SELECT * FROM ts",
    "tfidf_rank_shift": f"{_TFIDF} SELECT * FROM sh",
    "tfidf_risers_fallers": f"""{_TFIDF} SELECT * FROM (SELECT 'riser' AS kind, term, first_rank, last_rank, delta FROM sh WHERE best_rank <= 30 AND delta > 0 AND last_score > 0 ORDER BY delta DESC, last_rank, term LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'faller', term, first_rank, last_rank, delta FROM sh WHERE best_rank <= 30 AND delta < 0 AND first_score > 0 ORDER BY delta, first_rank, term LIMIT 5)""",
    "tfidf_top_terms_status": f"""{_TFIDF}, bo AS (SELECT a.*, p.rank AS pr, p.score AS ps FROM rk a LEFT JOIN rk p ON p.term = a.term AND p.period = a.period - 1)
  SELECT period, term, rank, CASE WHEN period = 1 THEN 'baseline' WHEN pr <= 30 AND ps > 0 THEN 'recurring' ELSE 'new' END AS status FROM bo WHERE score > 0 AND rank <= 15
  UNION ALL SELECT * FROM (SELECT period, term, pr, 'dropped' FROM bo WHERE pr <= 15 AND ps > 0 AND (rank > 15 OR score <= 0) QUALIFY row_number() OVER (PARTITION BY period ORDER BY pr, term) <= 5)""",
    "segment_tfidf_lift": f"""{_LEX}, wc AS (SELECT message_id, has_media, term, count(*) AS n FROM (SELECT message_id, has_media, unnest(ws) AS term FROM tk) GROUP BY ALL),
  tot AS (SELECT term, count(*) AS df FROM wc GROUP BY term ORDER BY sum(n) DESC, term LIMIT 500),
  w AS (SELECT *, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM tk)) / (1 + df)) + 1) AS w FROM wc JOIN tot USING (term)),
  s AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY message_id)) AS score FROM w),
  m AS (SELECT term, coalesce(sum(score) FILTER (has_media), 0) / (SELECT count(*) FROM tk WHERE has_media) AS media, coalesce(sum(score) FILTER (NOT has_media), 0) / (SELECT count(*) FROM tk WHERE NOT has_media) AS plain FROM s GROUP BY term),
  l AS (SELECT term, round(media, 9) AS media, round(plain, 9) AS plain, 'media' AS segment, round((media + 1e-9) / (plain + 1e-9), 6) AS lift FROM m UNION ALL SELECT term, round(media, 9), round(plain, 9), 'plain', round((plain + 1e-9) / (media + 1e-9), 6) FROM m)
  SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY lift DESC, term)::BIGINT AS place, term, media, plain, lift FROM l QUALIFY place <= 15""",
    "ctfidf_topics": f"""{_LEX}, wc AS (SELECT topic, term, count(*) AS n FROM (SELECT lang AS topic, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM tk JOIN documents ON doc_id = message_id) GROUP BY ALL),
  tot AS (SELECT term, sum(n) AS total FROM wc GROUP BY term ORDER BY total DESC, term LIMIT 5000),
  s AS (SELECT topic, term, round(n / sum(n) OVER (PARTITION BY topic) * (ln((1.0::DOUBLE + (SELECT sum(total) FROM tot)) / (1 + total)) + 1), 9) AS score FROM wc JOIN tot USING (term))
  SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term)::BIGINT AS place, term, score FROM s QUALIFY place <= 10""",
    "bigram_counts": f"{_PH}{_pmi('p2', 'pa', 2, 1, 'true')} SELECT phrase, n, messages, first_at, last_at FROM p2c",
    "bigram_pmi": f"{_PH}{_pmi('p2', 'pa', 2, 5, 'pmi >= 3')} SELECT * FROM p2",
    "trigram_pmi": f"{_PH}{_pmi('p3', 'pa', 3, 3, 'pmi >= 3')} SELECT * FROM p3",
    "bigram_half_shift": f"""{_PH}, md AS (SELECT quantile_cont(epoch_us(timestamp), 0.5)::BIGINT AS m FROM pa), h1 AS (SELECT pa.* FROM pa, md WHERE epoch_us(timestamp) <= m), h2 AS (SELECT pa.* FROM pa, md WHERE epoch_us(timestamp) > m){_pmi('a', 'h1', 2, 3, 'true')}{_pmi('z', 'h2', 2, 3, 'true')},
  a1 AS (SELECT phrase, n AS n_1, pmi AS pmi_1 FROM a {_TOP}), z1 AS (SELECT phrase, n AS n_2, pmi AS pmi_2 FROM z {_TOP})
  SELECT phrase, n_1, pmi_1, n_2, pmi_2, CASE WHEN n_1 IS NULL THEN 'new' WHEN n_2 IS NULL THEN 'dropped' ELSE 'retained' END AS status FROM a1 FULL JOIN z1 USING (phrase)""",
    "phrase_network_edges": f"{_EDGES} SELECT * FROM ed",
    "phrase_network_nodes": f"{_EDGES} SELECT word, count(*) FILTER (o) AS out_degree, round(coalesce(sum(weight) FILTER (o), 0), 6) AS out_weight, count(*) FILTER (NOT o) AS in_degree, round(coalesce(sum(weight) FILTER (NOT o), 0), 6) AS in_weight FROM (SELECT src AS word, true AS o, weight FROM ed UNION ALL SELECT dst, false, weight FROM ed) GROUP BY word",
    "phrase_summary": f"{_PH}{_pmi('p2', 'pa', 2, 5, 'pmi >= 3')}{_pmi('p3', 'pa', 3, 3, 'pmi >= 3')} SELECT count(*) AS messages, sum(len(ws))::BIGINT AS tokens, (SELECT count(DISTINCT w) FROM (SELECT unnest(ws) AS w FROM pa)) AS unique_tokens, (SELECT count(*) FROM p2) AS pairs, (SELECT count(*) FROM p3) AS triples FROM pa",
    "probably_english": r"""SELECT doc_id, trim(t) <> '' AND NOT regexp_matches(t, '[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{4E00}-\x{9FFF}]') AND (l = 0 OR a / nullif(l, 0) >= 0.9) AS english
  FROM (SELECT doc_id, coalesce(text, '') AS t, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS l FROM documents)""",
    "clip_text": "SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(left(text, 40)) || chr(10) || ltrim(right(text, 39)) ELSE text END AS clipped FROM documents",
}
