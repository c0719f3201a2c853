"""Diagnostics of panels, residuals and draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import linear
from panelcast.operators.fit import average_linkage


def autocorrelation(rows: DataFrame, by: list[str], value: str, most: int, time: str = "week") -> DataFrame:
    """by, lag, acf: sums of products around the mean of the whole series over its sum of squares."""
    w = Window.partitionBy(*by)
    d = rows.withColumn("_d", F.col(value) - F.avg(value).over(w))
    lagged = d.withColumns({f"_l{k}": F.lag("_d", k).over(w.orderBy(time)) for k in range(1, most + 1)})
    sums = lagged.groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_p{k}") for k in range(1, most + 1)])
    return sums.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_p{k}") / F.col("_s")).alias("acf")) for k in range(1, most + 1)])).alias("x")).select(*by, "x.lag", "x.acf")


def correlations(rows: DataFrame, value: str, time: str = "week") -> DataFrame:
    """a, b, corr, n for pairs of locations (a < b) over common weeks."""
    a = rows.select(F.col("location").alias("a"), time, F.col(value).alias("x"))
    b = rows.select(F.col("location").alias("b"), time, F.col(value).alias("y"))
    return a.join(b, time).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))


def nearest(rows: DataFrame, value: str, time: str = "week") -> DataFrame:
    """location and the other location it correlates with most; ties to the first by name."""
    c = correlations(rows, value, time)
    both = c.select(F.col("a").alias("location"), F.col("b").alias("other"), "corr").union(c.select("b", "a", "corr"))
    return both.groupBy("location").agg(F.min_by("other", F.struct(-F.round("corr", 9), F.col("other"))).alias("nearest"), F.max("corr").alias("corr"))


def running_correlations(rows: DataFrame, value: str, time: str = "week", least: int = 8) -> DataFrame:
    """a, b, time, corr, n at every common time, from the rows up to it."""
    a = rows.select(F.col("location").alias("a"), time, F.col(value).alias("x"))
    b = rows.select(F.col("location").alias("b"), time, F.col(value).alias("y"))
    w = Window.partitionBy("a", "b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    both = a.join(b, time).filter("a < b").withColumns({"corr": F.corr("x", "y").over(w), "n": F.count(F.lit(1)).over(w)})
    return both.filter(F.col("n") >= least).select("a", "b", time, "corr", "n")


def power_law(rows: DataFrame, by: list[str], value: str, least: int = 8) -> DataFrame:
    """exponent, intercept, n: log variance on log mean over groups."""
    groups = rows.groupBy(*by).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("k")).filter((F.col("k") >= least) & (F.col("m") > 0) & (F.col("v") > 0))
    return groups.agg(F.regr_slope(F.log("v"), F.log("m")).alias("exponent"), F.regr_intercept(F.log("v"), F.log("m")).alias("intercept"), F.count(F.lit(1)).alias("n"))


def box_cox(rows: DataFrame, by: list[str], value: str, grid: list[int]) -> DataFrame:
    """by, power, loglik: the power (fiftieths in the grid, so that 0 is exact) of greatest profile likelihood."""
    pos = rows.filter(F.col(value) > 0).withColumn("k", F.explode(F.array(*[F.lit(g) for g in grid])))
    p = F.col("k") / 50
    t = F.when(F.col("k") == 0, F.log(value)).otherwise((F.pow(F.col(value), p) - 1) / p)
    fits = pos.groupBy(*by, "k").agg(F.var_pop(t).alias("v"), F.sum(F.log(value)).alias("s"), F.count(F.lit(1)).alias("n"))
    fits = fits.withColumn("ll", -F.col("n") / 2 * F.log("v") + (F.col("k") / 50 - 1) * F.col("s"))
    return fits.groupBy(*by).agg((F.max_by("k", F.struct(F.round("ll", 6), -F.col("k"))) / 50).alias("power"), F.max("ll").alias("loglik"))


def bins(rows: DataFrame, value: str, parts: int = 5) -> DataFrame:
    """rows with `bin`: right-closed bins at exact quantiles (one row of cut points, broadcast)."""
    cuts = rows.agg(F.percentile(value, F.array(*[F.lit(k / parts) for k in range(1, parts)])).alias("_cuts"))
    joined = rows.crossJoin(F.broadcast(cuts))
    return joined.withColumn("bin", F.size(F.filter("_cuts", lambda c: F.col(value) > c)) + 1).drop("_cuts")


def theil_sen(rows: DataFrame, by: list[str], value: str, index: str, last: int) -> DataFrame:
    """by, slope: median of the slopes of all pairs among the last rows of each group; pairs are made within a row's array
    of at most `last` values."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(index)))
    got = rows.withColumn("_b", back).filter(F.col("_b") <= last).groupBy(*by).agg(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))).alias("p"))
    pairs = got.select(*by, "p", F.explode("p").alias("a")).select(*by, "a", F.explode("p").alias("b")).filter("a.i < b.i")
    return pairs.groupBy(*by).agg(F.percentile((F.col("b.v") - F.col("a.v")) / (F.col("b.i") - F.col("a.i")), F.lit(0.5)).alias("slope"))


def summary(rows: DataFrame, value: str, low: float, high: float, by: list[str]) -> DataFrame:
    """by, n, mean, sd, min, max, median, outside (share beyond a range), bad (share not finite)."""
    v = F.col(value)
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.when(fine, v)
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(F.when(fine, (~v.between(low, high)).cast("double"))).alias("outside"), F.avg((~fine).cast("double")).alias("bad"))


def predictive_coverage(draws: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, in50, in90: whether the observation lies in the central intervals of its draws."""
    q = F.percentile("draw", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.75, 0.95)]))
    rows = draws.groupBy(*keys).agg(q.alias("q")).join(observed, keys)
    inside = lambda lo, hi: F.col("observed").between(F.get("q", F.lit(lo)), F.get("q", F.lit(hi)))
    return rows.select(*keys, inside(1, 2).alias("in50"), inside(0, 3).alias("in90"))


def partial_autocorrelation(acf: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, lag, pacf from (by, lag, acf) at lags 1 .. most: the last coefficients of the Yule-Walker systems."""
    r = acf.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))
    rows = r.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most))))
    every = F.sequence(F.lit(1), F.col("lag"))
    matrix = F.transform(every, lambda i: F.concat(F.transform(every, lambda j: F.when(i == j, F.lit(1.0)).otherwise(F.get("r", F.abs(i - j) - 1))), F.array(F.get("r", i - 1))))
    return rows.select(*by, "lag", F.element_at(linear.solved(matrix, F.col("lag")), -1).alias("pacf"))


def clusters(rows: DataFrame, value: str, k: int, most: int = 5000) -> DataFrame:
    """location, cluster: average linkage on 1 - correlation. Distances are made in Spark; the merges are a sequence by
    nature and run on the driver, over at most `most` pairs of locations (more raise)."""
    pairs = correlations(rows, value).limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError(f"more than {most} pairs of locations")
    names = sorted({p.a for p in pairs} | {p.b for p in pairs})
    place = {n: i for i, n in enumerate(names)}
    distance = [[0.0] * len(names) for _ in names]
    for p in pairs:
        distance[place[p.a]][place[p.b]] = distance[place[p.b]][place[p.a]] = 1 - p["corr"]
    return rows.sparkSession.createDataFrame(list(zip(names, average_linkage(np.array(distance), k))), "location string, cluster int")


def qq_points(rows: DataFrame, by: list[str], value: str, normal: dict[int, float]) -> DataFrame:
    """by, level, sample, theory: quantiles of the z-scores against the normal ones at the levels."""
    w = Window.partitionBy(*by)
    scores = rows.withColumn("_s", (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w))
    got = scores.groupBy(*by).agg(F.percentile("_s", F.array(*[F.lit(k / 1000) for k in normal])).alias("q"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(z).alias("theory")) for k, z in normal.items()])
    return got.select(*by, F.inline(F.zip_with(levels, "q", lambda a, b: F.struct(a["level"].alias("level"), b.alias("sample"), a["theory"].alias("theory")))))


def coefficients_of(pacf: Column) -> Column:
    """Autoregressive coefficients from partial autocorrelations: each of these in (-1, 1) gives a stationary process."""

    def step(phi: Column, a: Column) -> Column:
        return F.concat(F.zip_with(phi, F.reverse(phi), lambda x, y: x - a * y), F.array(a))

    return F.aggregate(pacf, F.array().cast("array<double>"), step)
