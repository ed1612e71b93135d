"""URL filters by link-graph propagation: trust along links from trusted seeds, distrust against them from blocked ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import dropped, written

#: Seeds where no tables are given: domains; a host is one's if it is the domain or ends in a dot and the domain.
TRUSTED = ("edu", "gov", "example.org")
BLOCKED = tuple(f"{name}.example.{end}" for name in ("casino-win", "spam-farm", "free-bets", "cheap-pills", "adult-x", "ads-track") for end in ("com", "net", "org"))
#: Share of a host's score that follows links; rounds at most, and change of all scores together from which they end;
#: distrust (1: a blocked seed's own) from which a host is dropped.
DAMPING, ROUNDS, TOLERANCE, LIMIT = 0.85, 20, 1e-12, 0.05

_LINK = r"(?i)href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``src, dst, share``: links between different hosts, shares of a host's links adding up to 1."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1))
    pairs = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("link")).select("src", host_of(F.col("link")).alias("dst"))
    return pairs.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domains(spark, names: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "domain string")


def seeded(hosts: DataFrame, trusted: DataFrame, blocked: DataFrame) -> DataFrame:
    """``host, trusted, blocked``: whether a host or a domain that it is in stands in either table; blocked wins."""
    parts = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    listed = [t.select(F.lower(F.trim(t.columns[0])).alias("domain"), F.lit(k).alias("kind")) for t, k in ((trusted, 0), (blocked, 1))]
    found = hosts.select("host", F.explode(up).alias("domain")).join(listed[0].unionAll(listed[1]).where("domain <> ''").distinct(), "domain")
    kind = found.groupBy("host").agg(F.max("kind").alias("kind"))
    return hosts.join(kind, "host", "left").select("host", F.coalesce(F.col("kind") == 0, F.lit(False)).alias("trusted"), F.coalesce(F.col("kind") == 1, F.lit(False)).alias("blocked"))


def host_scores(edges: DataFrame, hosts: DataFrame, damping: float, rounds: int) -> DataFrame:
    """``host, blocked, trust, distrust`` of ``host, trusted, blocked``, the scores in multiples of what a lone seed has
    of its own.

    Personalised PageRank; what reaches a host without links goes back to the seeds. Both directions are one graph of
    two kinds, so a round is one join along the links; it is written, which ends its lineage, and the one before is
    deleted. Rounds end when scores stand still; without links there are none."""
    seed = F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trusted").cast("double").alias("seed")), F.struct(F.lit("d").alias("kind"), F.col("blocked").cast("double").alias("seed"))))
    kinds = hosts.select("host", "blocked", seed.alias("k")).select("host", "blocked", "k.kind", "k.seed")
    total = kinds.groupBy("kind").agg(F.sum("seed").alias("seeds"))
    both = edges.select(F.lit("t").alias("kind"), "src", "dst", "n").unionAll(edges.select(F.lit("d"), "dst", "src", "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    start = F.coalesce(F.col("seed") / F.nullif("seeds", F.lit(0.0)), F.lit(0.0))
    base = kinds.join(F.broadcast(total), "kind").join(out.withColumnRenamed("src", "host"), ["kind", "host"], "left")
    rank = written(base.select("kind", "host", "blocked", start.alias("s"), "seeds", F.col("out").isNotNull().alias("links"), start.alias("r"), F.lit(0.0).alias("moved")), "rank")
    if edges.limit(1).count():
        graph = written(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("share")), "graph")
        for _ in range(rounds):
            lost = {row.kind: row.lost or 0.0 for row in rank.groupBy("kind").agg(F.sum(F.when(~F.col("links"), F.col("r"))).alias("lost")).collect()}
            back = F.when(F.col("kind") == "t", F.lit(lost.get("t", 0.0))).otherwise(F.lit(lost.get("d", 0.0)))
            flow = rank.where("r > 0 and links").select("kind", "host", "r").join(graph, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("r") * F.col("share")).alias("in"))
            now = F.col("s") * ((1 - damping) + damping * back) + damping * F.coalesce("in", F.lit(0.0))
            before, rank = rank, written(rank.join(flow, ["kind", "host"], "left").select("kind", "host", "blocked", "s", "seeds", "links", now.alias("r"), F.abs(now - F.col("r")).alias("moved")), "rank")
            dropped(before)
            if (rank.agg(F.sum("moved")).first()[0] or 0.0) <= TOLERANCE:
                break
        dropped(graph)
    scaled = F.col("r") * F.col("seeds") / (1 - damping)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, scaled).otherwise(0.0))
    return rank.groupBy("host").agg(F.bool_or("blocked").alias("blocked"), of("t").alias("trust"), of("d").alias("distrust"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trusted: DataFrame | None = None, blocked: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, limit: float = LIMIT) -> DataFrame:
    """``page_id, host, trust, distrust, keep`` for each row of ``pages``.

    ``trusted`` and ``blocked`` are tables of domains in their first column (``TRUSTED`` and ``BLOCKED`` where they
    aren't given); hosts in both are blocked. A host is dropped if its distrust is at least ``limit`` and above its
    trust, so at a tie it is kept; blocked seeds always are. Links within a host, relative ones among them, carry
    nothing. Scores are rounded to nine digits. Rows without a host (null or odd URLs) have no score and are kept; null
    and empty ``html`` has no links, a very long one is read whole; hosts that are only linked to take part in the
    propagation; repeated rows count as repeated links and are reported each; an empty table gives an empty one; other
    columns are ignored, whatever their names."""
    spark = pages.sparkSession
    trusted = domains(spark, TRUSTED) if trusted is None else trusted
    blocked = domains(spark, BLOCKED) if blocked is None else blocked
    edges = written(host_edges(pages, url_col, html_col), "edges")
    named = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host_of(F.col(url_col)).alias("host"))
    hosts = named.select("host").unionAll(edges.select("dst")).where("host is not null").distinct()
    scores = host_scores(edges, seeded(hosts, trusted, blocked), damping, rounds)
    scores = scores.select("host", "blocked", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
    drop = F.col("blocked") | ((F.col("distrust") >= limit) & (F.col("distrust") > F.col("trust")))
    return named.join(scores, "host", "left").select("page_id", "host", "trust", "distrust", F.coalesce(~drop, F.lit(True)).alias("keep"))


def linked(pages: DataFrame) -> DataFrame:
    """``pages`` with links in place of their own text: each links to the page with the next id, whose host differs for
    most. The tables' pages have only relative links; on these the propagation can be compared at their size."""
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.concat(F.lit('<a href="'), "url", F.lit('">')).alias("html"))
    return pages.select("page_id", "url").join(after, "page_id", "left")


LINKED_SQL = """(SELECT a.page_id, a.url, '<a href="' || b.url || '">' AS html FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1)"""


def sql(pages: str = "pages", trusted: tuple[str, ...] = TRUSTED, blocked: tuple[str, ...] = BLOCKED, damping: float = DAMPING, rounds: int = ROUNDS, limit: float = LIMIT) -> str:
    """The same in DuckDB SQL, a common table expression for each round."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    host = "nullif(lower(regexp_extract({}, " + quote(_HOST) + ", 1)), '')"
    within = lambda names: " OR ".join(f"ends_with('.' || host, {quote('.' + n)})" for n in names) or "false"
    trusted, blocked = within(trusted), within(blocked)
    steps = "".join(
        f""",
r{k + 1} AS MATERIALIZED (SELECT base.kind, base.host, s * ({1 - damping!r} + {damping!r} * coalesce(lost, 0)) + {damping!r} * coalesce(i, 0) AS r FROM base
  LEFT JOIN (SELECT r{k}.kind, dst AS host, sum(r * share) AS i FROM r{k} JOIN graph ON graph.kind = r{k}.kind AND graph.host = r{k}.host GROUP BY ALL) f ON f.kind = base.kind AND f.host = base.host
  LEFT JOIN (SELECT r{k}.kind, sum(r) AS lost FROM r{k} JOIN base USING (kind, host) WHERE NOT links GROUP BY ALL) l ON l.kind = base.kind)"""
        for k in range(rounds)
    )
    return f"""WITH p AS (SELECT page_id, {host.format("url")} AS host, regexp_extract_all(coalesce(html, ''), {quote(_LINK)}, 1) AS links FROM {pages}),
e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT src, {host.format("link")} AS dst FROM (SELECT host AS src, unnest(links) AS link FROM p)) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL),
h AS (SELECT host, ({trusted}) AND NOT ({blocked}) AS t, ({blocked}) AS d FROM (SELECT host FROM p UNION SELECT dst FROM e) WHERE host IS NOT NULL),
kinds AS (SELECT host, 't' AS kind, t::INT::DOUBLE AS seed FROM h UNION ALL SELECT host, 'd', d::INT::DOUBLE FROM h),
both_ AS (SELECT 't' AS kind, src, dst, n FROM e UNION ALL SELECT 'd', dst, src, n FROM e),
graph AS MATERIALIZED (SELECT kind, src AS host, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_),
base AS MATERIALIZED (SELECT kind, host, coalesce(seed / nullif(sum(seed) OVER (PARTITION BY kind), 0), 0) AS s, sum(seed) OVER (PARTITION BY kind) AS seeds, (kind, host) IN (SELECT kind, host FROM graph) AS links FROM kinds),
r0 AS (SELECT kind, host, s AS r FROM base){steps},
scores AS (SELECT host, round(sum(r * seeds / {1 - damping!r}) FILTER (kind = 't'), 9) AS trust, round(sum(r * seeds / {1 - damping!r}) FILTER (kind = 'd'), 9) AS distrust FROM r{rounds} JOIN base USING (kind, host) GROUP BY host)
SELECT page_id, host, trust, distrust, coalesce(NOT (({blocked}) OR (distrust >= {limit!r} AND distrust > trust)), true) AS keep FROM p LEFT JOIN scores USING (host)"""
