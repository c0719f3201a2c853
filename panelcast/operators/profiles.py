"""Seasonal profiles, all origins at once, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import calendar
from panelcast.operators import linear


def circular_mean(df: DataFrame, index: str, value: str, n: int, width: int, by: list[str]) -> DataFrame:
    """by, index, value averaged over `width` (odd) neighbours on a circle 1..n; every index must be there."""
    half = (width - 1) // 2
    around = F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: calendar.mod1(F.col(index) + o, n).cast("int")))
    return df.withColumn("_to", around).groupBy(*by, F.col("_to").alias(index)).agg(F.avg(value).alias(value))


def seasonal(history: DataFrame, by: list[str], period: int = 52, min_support: int = 3, width: int = 5) -> DataFrame:
    """by, woy, s: pooled over locations: deviations from each location's mean by folded week, 0 where the support is
    too small, smoothed, with mean zero. history: by, location, woy, z."""
    folded = history.withColumn("woy", calendar.mod1(F.col("woy"), period).cast("int"))
    demeaned = folded.withColumn("d", F.col("z") - F.avg("z").over(Window.partitionBy(*by, "location")))
    bins = demeaned.groupBy(*by, "woy").agg(F.when(F.count("d") >= min_support, F.avg("d")).otherwise(0.0).alias("s"))
    weeks = folded.sparkSession.range(1, period + 1).select(F.col("id").cast("int").alias("woy"))
    full = history.select(*by).distinct().crossJoin(F.broadcast(weeks)).join(bins, [*by, "woy"], "left").fillna(0.0, ["s"])
    smooth = circular_mean(full, "woy", "s", period, width, by)
    return smooth.withColumn("s", F.col("s") - F.avg("s").over(Window.partitionBy(*by)))


def climatology(history: DataFrame, by: list[str], period: int = 52, width: int = 5) -> DataFrame:
    """by (with the location), woy, c: the median by folded week, the overall one for weeks without rows, smoothed."""
    folded = history.withColumn("woy", calendar.mod1(F.col("woy"), period).cast("int"))
    bins = folded.groupBy(*by, "woy").agg(F.percentile("z", F.lit(0.5)).alias("c"))
    overall = folded.groupBy(*by).agg(F.percentile("z", F.lit(0.5)).alias("m"))
    weeks = folded.sparkSession.range(1, period + 1).select(F.col("id").cast("int").alias("woy"))
    full = overall.crossJoin(F.broadcast(weeks)).join(bins, [*by, "woy"], "left").withColumn("c", F.coalesce("c", "m")).drop("m")
    return circular_mean(full, "woy", "c", period, width, by)


def trimmed_weighted(history: DataFrame, by: list[str], decay: float = 0.8, trim: float = 0.1) -> DataFrame:
    """by, woy, c: mean by week with weights decay^(seasons ago), of which `trim` of the weight is cut at each end."""
    ago = F.max("season_year").over(Window.partitionBy(*by)) - F.col("season_year")
    rows = history.withColumn("w", F.pow(F.lit(decay), ago))
    bin_ = Window.partitionBy(*by, "woy")
    rows = rows.withColumns({"total": F.sum("w").over(bin_), "upto": F.sum("w").over(bin_.orderBy("z", "week").rowsBetween(Window.unboundedPreceding, 0))})
    lo, hi = trim * F.col("total"), (1 - trim) * F.col("total")
    kept = F.greatest(F.least(F.col("upto"), hi) - F.greatest(F.col("upto") - F.col("w"), lo), F.lit(0.0))
    return rows.withColumn("k", kept).groupBy(*by, "woy").agg((F.sum(F.col("k") * F.col("z")) / F.sum("k")).alias("c"))


def robust(history: DataFrame, by: list[str], decay: float, trim: float, pooled: float, period: int = 52, width: int = 5) -> DataFrame:
    """by, location, woy, c: trimmed weighted means by folded week, blended with the weighted means of all locations
    (weight `pooled`), the mean of its weeks where a week has no rows, smoothed on the circle."""
    folded = history.withColumn("woy", calendar.mod1(F.col("woy"), period).cast("int"))
    own = trimmed_weighted(folded, [*by, "location"], decay, trim)
    ago = F.max("season_year").over(Window.partitionBy(*by)) - F.col("season_year")
    whole = folded.withColumn("_w", F.pow(F.lit(decay), ago)).groupBy(*by, "woy").agg((F.sum(F.col("_w") * F.col("z")) / F.sum("_w")).alias("q"))
    mixed = own.join(whole, [*by, "woy"]).withColumn("c", (1 - pooled) * F.col("c") + pooled * F.col("q")).drop("q")
    weeks = folded.sparkSession.range(1, period + 1).select(F.col("id").cast("int").alias("woy"))
    overall = mixed.groupBy(*by, "location").agg(F.avg("c").alias("m"))
    full = overall.crossJoin(F.broadcast(weeks)).join(mixed, [*by, "location", "woy"], "left").withColumn("c", F.coalesce("c", "m")).drop("m")
    return circular_mean(full, "woy", "c", period, width, [*by, "location"])


def fourier_shape(history: DataFrame, by: list[str], period: float = 52.0) -> DataFrame:
    """by, b_sin, b_cos: the first harmonic by least squares on demeaned values, from sums (a Gram matrix)."""
    s, c = calendar.fourier(F.col("woy"), 1, period)
    rows = history.select(*by, (F.col("z") - F.avg("z").over(Window.partitionBy(*by, "location"))).alias("d"), s.alias("s"), c.alias("c"))
    g = rows.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("c")).alias("sc"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("s") * F.col("d")).alias("sd"), F.sum(F.col("c") * F.col("d")).alias("cd"))
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    return g.select(*by, ((F.col("sd") * F.col("cc") - F.col("cd") * F.col("sc")) / det).alias("b_sin"), ((F.col("cd") * F.col("ss") - F.col("sd") * F.col("sc")) / det).alias("b_cos"))


def deseasonalised(panel: DataFrame, profile: DataFrame, by: list[str], period: int = 52) -> DataFrame:
    """panel with r = z - location mean - profile (0 for a week without one)."""
    key = calendar.mod1(F.col("woy"), period).cast("int")
    rows = panel.withColumns({"level": F.avg("z").over(Window.partitionBy(*by, "location")), "_w": key})
    joined = rows.join(profile.select(*by, F.col("woy").alias("_w"), "s"), [*by, "_w"], "left")
    return joined.withColumn("r", F.col("z") - F.col("level") - F.coalesce("s", F.lit(0.0))).drop("_w", "s")


def slope_through_zero(x: Column, y: Column, least: float = 1e-8, shrink: float = 1.0) -> Column:
    """1 + shrink * (b - 1) with b = sum(xy) / sum(xx), and 1 where the denominator is too small."""
    xx = F.sum(x * x)
    return F.when(xx > least, 1 + shrink * (F.sum(x * y) / xx - 1)).otherwise(1.0)


def blended(own: DataFrame, pooled: DataFrame, lam: float, keys: list[str], value: str) -> DataFrame:
    """(1 - lam) * pooled + lam * own."""
    joined = own.join(pooled.withColumnRenamed(value, "_p"), keys)
    return joined.withColumn(value, (1 - lam) * F.col("_p") + lam * F.col(value)).drop("_p")


def severity(panel: DataFrame, climate: DataFrame, last: int = 8, min_locations: int = 3) -> DataFrame:
    """season_year, severity: mean over locations (at least min_locations) of the mean ratio to climatology in the last
    weeks of each season."""
    back = F.row_number().over(Window.partitionBy("location", "season_year").orderBy(F.desc("week")))
    rows = panel.withColumn("_b", back).filter(F.col("_b") <= last).join(climate, ["location", "woy"])
    own = rows.groupBy("location", "season_year").agg(F.avg(F.col("z") / F.col("c")).alias("ratio"))
    return own.groupBy("season_year").agg(F.avg("ratio").alias("severity"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_locations)


def severity_difference(panel: DataFrame, climate: DataFrame, last: int = 8) -> DataFrame:
    """season_year, location, severity: mean difference to climatology in the last weeks of each season."""
    back = F.row_number().over(Window.partitionBy("location", "season_year").orderBy(F.desc("week")))
    rows = panel.withColumn("_b", back).filter(F.col("_b") <= last).join(climate, ["location", "woy"])
    return rows.groupBy("season_year", "location").agg(F.avg(F.col("z") - F.col("c")).alias("severity"))


def whittaker(panel: DataFrame, by: list[str], penalty: float, period: int = 52) -> DataFrame:
    """by, woy, c: means by folded week (the overall one for weeks without rows), smoothed on the circle: solves
    (I + penalty D'D) c = means with D the second difference."""
    rows = panel.withColumn("_w", calendar.mod1(F.col("woy"), period).cast("int"))
    whole = rows.groupBy(*by).agg(F.avg("z").alias("_m"))
    weeks = rows.sparkSession.range(1, period + 1).select(F.col("id").cast("int").alias("_w"))
    bins = whole.crossJoin(F.broadcast(weeks)).join(rows.groupBy(*by, "_w").agg(F.avg("z").alias("_v")), [*by, "_w"], "left")
    raw = bins.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", F.coalesce("_v", "_m").alias("v")))), lambda x: x["v"]).alias("raw"))
    every = F.sequence(F.lit(0), F.lit(period - 1))
    far = lambda i, j: F.least(F.pmod(i - j, F.lit(period)), F.pmod(j - i, F.lit(period)))
    cell = lambda i, j: F.when(i == j, 1 + 6 * penalty).when(far(i, j) == 1, -4.0 * penalty).when(far(i, j) == 2, 1.0 * penalty).otherwise(0.0)
    matrix = F.transform(every, lambda i: F.concat(F.transform(every, lambda j: cell(i, j)), F.array(F.get("raw", i))))
    return raw.select(*by, F.posexplode(linear.solved(matrix, period)).alias("k", "c")).select(*by, (F.col("k") + 1).alias("woy"), "c")
