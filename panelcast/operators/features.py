"""Sequence features by windows over location and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import calendar


def lags(panel: DataFrame, value: str, order: int, by: list[str], time: str = "week") -> DataFrame:
    """Columns lag1 .. lag<order>; rows without all of them are dropped."""
    w = Window.partitionBy(*by).orderBy(time)
    out = panel.withColumns({f"lag{k}": F.lag(value, k).over(w) for k in range(1, order + 1)})
    return out.filter(F.col(f"lag{order}").isNotNull())


def direct(panel: DataFrame, value: str, order: int, horizon: int, by: list[str], time: str = "week") -> DataFrame:
    """Design of a direct regression: the value `horizon` steps ahead, and now and the lags before."""
    w = Window.partitionBy(*by).orderBy(time)
    out = panel.withColumns({"target": F.lead(value, horizon).over(w), "lag0": F.col(value), **{f"lag{k}": F.lag(value, k).over(w) for k in range(1, order)}})
    return out.filter(F.col("target").isNotNull() & F.col(f"lag{max(order - 1, 0)}").isNotNull())


def difference(value: str, by: list[str], time: str = "week") -> Column:
    return F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(time))


def runs(panel: DataFrame, above: Column, by: list[str], least: int = 2, time: str = "week") -> DataFrame:
    """by, onset, offset, n: first and last week of the runs of at least `least` rows above a threshold."""
    w = Window.partitionBy(*by).orderBy(time)
    rows = panel.withColumns({"_a": above, "_i": F.row_number().over(w)}).filter("_a")
    rows = rows.withColumn("_g", F.col("_i") - F.row_number().over(w))
    return rows.groupBy(*by, "_g").agg(F.min(time).alias("onset"), F.max(time).alias("offset"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("_g")


def so_far(panel: DataFrame, value: str, by: list[str], time: str = "week") -> DataFrame:
    """Running maximum, sum and median within `by`: seen up to and with the row."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns({"max_so_far": F.max(value).over(w), "sum_so_far": F.sum(value).over(w), "median_so_far": F.percentile(value, F.lit(0.5)).over(w)})


def drift(panel: DataFrame, profile: DataFrame, by: list[str], shifts: range, period: int = 52, most: float = 3.0) -> DataFrame:
    """by, phi, amplitude, sse: the shift of the profile that fits best, the first of equal ones; amplitude by least
    squares without a constant, cut to [0, most]. panel: by, woy, r; profile: woy, s."""
    grid = panel.withColumn("phi", F.explode(F.array(*[F.lit(s) for s in shifts])))
    at = calendar.mod1(F.col("woy") + F.col("phi"), period).cast("int")
    rows = grid.withColumn("_w", at).join(F.broadcast(profile.select(F.col("woy").alias("_w"), "s")), "_w")
    fits = rows.groupBy(*by, "phi").agg(F.sum(F.col("r") * F.col("s")).alias("xy"), F.sum(F.col("s") * F.col("s")).alias("xx"), F.sum(F.col("r") * F.col("r")).alias("yy"))
    a = F.greatest(F.lit(0.0), F.least(F.lit(most), F.when(F.col("xx") > 1e-8, F.col("xy") / F.col("xx")).otherwise(1.0)))
    fits = fits.withColumn("amplitude", a).withColumn("sse", F.col("yy") - 2 * F.col("amplitude") * F.col("xy") + F.col("amplitude") * F.col("amplitude") * F.col("xx"))
    best = F.min_by(F.struct("phi", "amplitude", "sse"), F.struct(F.round("sse", 9), F.col("phi")))
    return fits.groupBy(*by).agg(best.alias("b")).select(*by, "b.phi", "b.amplitude", "b.sse")


def weighted_recent(value: Column, age: Column, rho: float) -> Column:
    """Exponentially weighted mean of a group; age 0 is the latest row."""
    w = F.pow(F.lit(rho), age)
    return F.sum(w * value) / F.sum(w)


def with_profile(rows: DataFrame, profile: DataFrame, by: list[str], period: int = 52) -> DataFrame:
    """rows (by, woy) with clim: the profile (by, woy, s) at the folded week."""
    key = calendar.mod1(F.col("woy"), period).cast("int")
    return rows.withColumn("_w", key).join(profile.select(*by, F.col("woy").alias("_w"), F.col("s").alias("clim")), [*by, "_w"]).drop("_w")


def wide(panel: DataFrame, value: str, locations: list[str], time: str = "week") -> DataFrame:
    """A column per location; times at which one is missing are left out."""
    return panel.groupBy(time).pivot("location", locations).agg(F.first(value)).na.drop(subset=locations)


def accumulated(panel: DataFrame, value: str, by: list[str], phi: float | Column | None = None, time: str = "week") -> DataFrame:
    """by, time, total: running sum, or with phi the recursion x = phi * x + value, as a fold over each series; phi may be a
    column, a coefficient that varies in time."""
    if phi is None:
        w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        return panel.select(*by, time, F.sum(value).over(w).alias("total"))
    series = panel.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"), (phi if isinstance(phi, Column) else F.lit(phi)).alias("p")))).alias("xs"))
    zero = F.array().cast(f"array<struct<t:{panel.schema[time].dataType.simpleString()},total:double>>")
    step = lambda s, x: F.concat(s, F.array(F.struct(x["t"].alias("t"), (F.coalesce(F.try_element_at(s, F.lit(-1))["total"], F.lit(0.0)) * x["p"] + x["v"]).alias("total"))))
    return series.select(*by, F.inline(F.aggregate("xs", zero, step))).withColumnRenamed("t", time)


def feature_rows(panel: DataFrame, profile: DataFrame, horizon: int, order: int = 4, trend: int = 4, period: int = 52) -> DataFrame:
    """location, week, the values now and before, trend, clim of the target's week, the season's peak so far over the
    running median, the natural level, sin and cos of the week: known at the row's week. panel: location, week, woy,
    season_year, y, z; profile: woy, s."""
    w = Window.partitionBy("location").orderBy("week")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    season = Window.partitionBy("location", "season_year").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.withColumns({**{f"now{k}": F.lag("z", k).over(w) for k in range(order)}, "trend": (F.col("z") - F.lag("z", trend - 1).over(w)) / (trend - 1), "amplitude": F.max("z").over(season) - F.percentile("z", F.lit(0.5)).over(upto), "target": F.lead("z", horizon).over(w)})
    rows = rows.filter(F.col(f"now{order - 1}").isNotNull() & F.col("trend").isNotNull())
    at = calendar.mod1(calendar.week_of_season(F.date_add("week", 7 * horizon)), period).cast("int")
    rows = rows.withColumn("_w", at).join(profile.select(F.col("woy").alias("_w"), F.col("s").alias("clim")), "_w").drop("_w")
    sin, cos = calendar.fourier(F.col("woy"), 1, float(period))
    return rows.select("location", "week", *[f"now{k}" for k in range(order)], "trend", "clim", "amplitude", F.col("y").alias("natural"), sin.alias("sin"), cos.alias("cos"), "target")
