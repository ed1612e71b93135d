"""Two-sample rank test, contingency test and density as DataFrame aggregates; tails as plain functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: str, amount: str, name: str, parts: int = 200) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before, in the order of a column of distinct doubles.

    Rows are split at approximate quantiles; each part is summed on its own and starts from the totals of those
    before it, of which there are ``parts`` at most. So no task orders the whole table."""
    points = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    edges = F.broadcast(df.agg(F.percentile_approx(order, points, F.lit(10 * parts)).alias("__edges")))
    split = df.crossJoin(edges).withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col(order)))).drop("__edges")
    totals = split.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(totals.select("__part", before.alias("__start")))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return split.withColumn("__inside", inside).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__inside")).drop("__part", "__start", "__inside")


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: sizes, medians, U of the first group (``group`` true), rank-biserial correlation, and z with tie and
    continuity correction. Null values are left out; z is null if a group is empty or all values are equal.

    Ranks come from counts of equal values, so only distinct values are ordered."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("boolean").alias("g"), F.col(value).cast("double").alias("v"))
    each = rows.groupBy("v").agg(F.count("*").alias("t"), F.count_if("g").alias("a"))
    ranked = running_total(each, "v", "t", "below").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2.0)
    total = ranked.agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("r1"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    medians = rows.agg(F.percentile(F.when(F.col("g"), F.col("v")), F.lit(0.5)).alias("median_1"), F.percentile(F.when(~F.col("g"), F.col("v")), F.lit(0.5)).alias("median_2"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return total.crossJoin(F.broadcast(medians)).select("n1", "n2", "median_1", "median_2", u.alias("u"), (1 - 2 * u / F.nullif(n1 * n2, F.lit(0.0))).alias("rank_biserial"), F.round(z, 6).alias("z"))


def two_sided(z: float | None) -> float | None:
    """Probability of a normal value as far from 0."""
    return None if z is None else min(1.0, math.erfc(max(0.0, z) / math.sqrt(2)))


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided probability of U without ties, by counting arrangements; for small groups."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for k in range(1, n1 + n2 + 1):  # ranks, of which n1 are chosen; their sum less the least is U
        for i in range(min(n1, k), 0, -1):
            shift = k - i
            for x in range(n1 * n2, shift - 1, -1):
                ways[i][x] += ways[i - 1][x - shift]
    low = int(min(u, n1 * n2 - u))
    return min(1.0, 2 * sum(ways[n1][: low + 1]) / math.comb(n1 + n2, n1))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """One row: chi-square of independence (Yates' correction for two by two), its degrees of freedom, the count and
    Cramér's V; null with fewer than two rows or columns. Null categories are left out."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy("r").agg(F.sum("o").alias("nr")), cells.groupBy("c").agg(F.sum("o").alias("nc"))
    full = rows.crossJoin(F.broadcast(columns)).join(cells, ["r", "c"], "left").fillna(0, ["o"])
    shape = F.broadcast(rows.agg(F.count("*").alias("rows"), F.sum("nr").cast("double").alias("n")).crossJoin(columns.agg(F.count("*").alias("columns"))))
    dof = (F.col("rows") - 1) * (F.col("columns") - 1)
    expected = F.col("nr") * F.col("nc") / F.col("n")
    off = F.abs(F.col("o") - expected)
    off = F.when(dof == 1, F.greatest(F.lit(0.0), off - F.least(F.lit(0.5), off))).otherwise(off)
    out = full.crossJoin(shape).groupBy("rows", "columns", "n").agg(F.sum(off * off / expected).alias("chi2"))
    chi2 = F.when(dof > 0, F.col("chi2"))
    return out.select(F.round(chi2, 6).alias("chi2"), dof.alias("dof"), F.col("n").cast("bigint").alias("n"), F.round(F.sqrt(chi2 / (F.col("n") * F.nullif(F.least("rows", "columns") - 1, F.lit(0)))), 6).alias("cramers_v"))


def chi_square_tail(x: float, dof: int) -> float:
    """Probability of a larger chi-square: the regularised upper incomplete gamma function."""
    a, y = dof / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - front * total)
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def hour_density(df: DataFrame, group: str, hour: str, points: int = 240) -> DataFrame:
    """Gaussian kernel density of the hour of day for each group, on a grid over [0, 23]; Scott's bandwidth. Groups of
    fewer than three rows or of one hour have none."""
    each = df.groupBy(F.col(group).alias("segment"), F.col(hour).cast("double").alias("h")).agg(F.count("*").alias("w"))
    n, mean = F.sum("w").alias("n"), F.sum(F.col("w") * F.col("h")).alias("s")
    stats = each.groupBy("segment").agg(n, mean, F.sum(F.col("w") * F.col("h") * F.col("h")).alias("q"), F.count("*").alias("hours")).where("n >= 3 and hours >= 2")
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    wide = each.join(F.broadcast(stats.select("segment", "n", (sd * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("b"))), "segment")
    grid = df.sparkSession.range(points).select((F.col("id") * 23.0 / (points - 1)).alias("x"))
    kernel = F.col("w") * F.exp(-0.5 * F.pow((F.col("x") - F.col("h")) / F.col("b"), F.lit(2.0))) / (F.col("n") * F.col("b") * math.sqrt(2 * math.pi))
    return wide.crossJoin(F.broadcast(grid)).groupBy("segment", "x").agg(F.round(F.sum(kernel), 9).alias("density"))
