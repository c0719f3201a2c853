"""Quantile tables: from samples and distributions, ensembles, recalibration, conformal intervals.

The interchange table has model, location, origin, horizon, target_week, level (thousandths), value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import calendar, distributions, transforms
from panelcast.functions.distributions import LEVELS, NORMAL

TASK = ["model", "location", "origin", "horizon", "target_week"]


def level_table(values: dict[int, float]) -> Column:
    """An array of (level, q) structs, to be exploded."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.lit(q).alias("q")) for level, q in values.items()])


def from_normal(ahead: DataFrame, scale: str, model: str) -> DataFrame:
    """Rows of mean and sd_h on the modelling scale become 23 quantiles on the natural one."""
    rows = ahead.withColumn("x", F.explode(level_table(NORMAL)))
    value = transforms.from_scale(F.col("mean") + F.col("x.q") * F.col("sd_h"), scale)
    return rows.select(F.lit(model).alias("model"), "location", "origin", "horizon", F.date_add("origin", 7 * F.col("horizon")).alias("target_week"), F.col("x.level").alias("level"), value.alias("value"))


def from_sample(rows: DataFrame, by: list[str], value: Column, levels: list[int] = LEVELS) -> DataFrame:
    """by, level, value: exact quantiles with linear interpolation, one aggregate."""
    got = rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(q / 1000) for q in levels])).alias("qs"))
    return got.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in levels]).alias("level"), F.col("qs").alias("value"))).alias("x")).select(*by, "x.level", "x.value")


def band_history(history: DataFrame, targets: DataFrame, band: int = 2, period: int = 52) -> DataFrame:
    """targets (origin, location, horizon, target_week) with the history before the origin whose week of season is
    within `band` weeks of the target's: the band is exploded on the side of the targets, so it is an equi-join."""
    around = F.explode(F.transform(F.sequence(F.lit(-band), F.lit(band)), lambda o: calendar.mod1(calendar.week_of_season(F.col("target_week")) + o, period).cast("int")))
    wanted = targets.withColumn("_w", around)
    past = history.select("location", F.col("week").alias("_d"), calendar.mod1(F.col("woy"), period).cast("int").alias("_w"), "y")
    return past.join(wanted, ["location", "_w"]).filter(F.col("_d") < F.col("origin"))


def band_or_all(history: DataFrame, targets: DataFrame, least: int, band: int = 2, period: int = 52) -> DataFrame:
    """band_history with `banded`; targets whose band has fewer than `least` rows get the whole history before the origin."""
    keys = ["location", "origin", "horizon", "target_week"]
    near = band_history(history, targets, band, period).select(*keys, "y")
    counts = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = targets.join(counts, keys, "left").withColumn("banded", F.coalesce("_n", F.lit(0)) >= least).drop("_n")
    rest = history.select("location", F.col("week").alias("_d"), "y").join(known.filter("NOT banded"), "location").filter(F.col("_d") < F.col("origin"))
    return near.join(known.filter("banded"), keys).select(*keys, "banded", "y").unionByName(rest.select(*keys, "banded", "y"))


def student(points: DataFrame, df: int, scale: float) -> DataFrame:
    """location, origin, horizon, level, value: point + sd * t, matched in variance, times scale."""
    rows = points.withColumn("x", F.explode(level_table(distributions.student(df))))
    return rows.select("location", "origin", "horizon", F.col("x.level").alias("level"), (F.col("point") + F.col("sd") * math.sqrt((df - 2) / df) * scale * F.col("x.q")).alias("value"))


def ensemble(tables: DataFrame, how: str = "mean", model: str = "ensemble", weights: DataFrame | None = None) -> DataFrame:
    """Level by level: mean, median, or weighted mean (weights: model, weight; a row per model, broadcast)."""
    by = [c for c in [*TASK, "level"] if c != "model"]
    if how == "median":
        return tables.groupBy(*by).agg(F.percentile("value", F.lit(0.5)).alias("value")).withColumn("model", F.lit(model))
    if how == "mean":
        return tables.groupBy(*by).agg(F.avg("value").alias("value")).withColumn("model", F.lit(model))
    joined = tables.join(F.broadcast(weights), "model")
    return joined.groupBy(*by).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value")).withColumn("model", F.lit(model))


def with_median(tables: DataFrame) -> DataFrame:
    """Adds each task's median without a join."""
    return tables.withColumn("median", F.max(F.when(F.col("level") == 500, F.col("value"))).over(Window.partitionBy(*TASK)))


def recalibrated(tables: DataFrame, shift: DataFrame, width: DataFrame, by_location: DataFrame | None = None) -> DataFrame:
    """On the log1p scale: x' = median + shift + width * (x - median). shift and width: a row per horizon; by_location: a
    further factor (location, width)."""
    rows = with_median(tables).join(shift, "horizon").join(width, "horizon")
    factor = F.col("width")
    if by_location is not None:
        rows = rows.join(by_location.withColumnRenamed("width", "_l"), "location")
        factor = factor * F.col("_l")
    m = F.log1p("median")
    moved = m + F.col("shift") + factor * (F.log1p("value") - m)
    return rows.withColumn("value", F.greatest(F.expm1(moved), F.lit(0.0))).select(*tables.columns)


def fit_shift(tables: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, shift: mean log1p error of the median."""
    rows = tables.filter("level = 500").join(truth, ["location", "target_week"])
    return rows.groupBy(*by).agg(F.avg(F.log1p("truth") - F.log1p("value")).alias("shift"))


def fit_width(tables: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """horizon, width: the factor with the least mean pinball loss on the log1p scale; one job for the whole grid."""
    rows = with_median(tables).join(truth, ["location", "target_week"]).withColumn("width", F.explode(F.array(*[F.lit(g) for g in grid])))
    m = F.log1p("median")
    x, y, q = m + F.col("width") * (F.log1p("value") - m), F.log1p("truth"), F.col("level") / 1000
    loss = F.when(y < x, (1 - q) * (x - y)).otherwise(q * (y - x))
    means = rows.groupBy("horizon", "width").agg(F.avg(loss).alias("loss"))
    return means.groupBy("horizon").agg(F.min_by("width", F.struct(F.round("loss", 9), F.col("width"))).alias("width"))


def _loss(x: Column, y: Column, level: Column) -> Column:
    q = level / 1000
    return F.when(y < x, (1 - q) * (x - y)).otherwise(q * (y - x))


def fit_location_width(tables: DataFrame, truth: DataFrame, shift: DataFrame, width: DataFrame, grid: list[float]) -> DataFrame:
    """location, width: the factor on top of the shifts and widths of the horizons with the least loss at the location."""
    rows = with_median(tables).join(truth, ["location", "target_week"]).join(shift, "horizon").join(width.withColumnRenamed("width", "_h"), "horizon")
    rows = rows.withColumn("width", F.explode(F.array(*[F.lit(g) for g in grid])))
    m = F.log1p("median")
    x = m + F.col("shift") + F.col("_h") * F.col("width") * (F.log1p("value") - m)
    means = rows.groupBy("location", "width").agg(F.avg(_loss(x, F.log1p("truth"), F.col("level"))).alias("loss"))
    return means.groupBy("location").agg(F.min_by("width", F.struct(F.round("loss", 9), F.col("width"))).alias("width"))


def fit_width_without(tables: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """season_year, horizon, width: the factor with the least loss over all other seasons, from each season's sums."""
    rows = with_median(tables).join(truth, ["location", "target_week"]).withColumn("width", F.explode(F.array(*[F.lit(g) for g in grid])))
    m = F.log1p("median")
    x = m + F.col("width") * (F.log1p("value") - m)
    sums = rows.groupBy(calendar.season_year(F.col("origin")).alias("season_year"), "horizon", "width").agg(F.sum(_loss(x, F.log1p("truth"), F.col("level"))).alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("horizon", "width")
    rest = sums.withColumn("loss", (F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0))).filter("loss IS NOT NULL")
    return rest.groupBy("season_year", "horizon").agg(F.min_by("width", F.struct(F.round("loss", 9), F.col("width"))).alias("width"))


def conformal_pool(points: DataFrame, versions_known: DataFrame, scale: str) -> DataFrame:
    """Walk-forward errors: points (location, origin, horizon, target_week, point) mature at the first origin that is on or
    after the target and knows a version of it; the error is frozen there. Returns origin, horizon, error for every
    error that is in the pool at an origin. versions_known: location, origin, target_week, value (as of the origin)."""
    seen = versions_known.withColumnsRenamed({"origin": "at", "value": "actual"})
    mature = points.join(seen, ["location", "target_week"]).filter(F.col("at") >= F.col("target_week"))
    frozen = mature.groupBy("location", "origin", "horizon", "target_week", "point").agg(F.min("at").alias("mature"), F.min_by("actual", "at").alias("actual"))
    error = transforms.to_scale(F.col("actual"), scale) - F.col("point")
    errors = frozen.select("horizon", "mature", error.alias("error"))
    later = points.select("origin").distinct()
    return errors.join(F.broadcast(later), F.col("origin") >= F.col("mature")).select("origin", "horizon", "error")


def conformal(points: DataFrame, pool: DataFrame, fallback: DataFrame, scale: str, width: float = 1.0, least: int = 10) -> DataFrame:
    """Quantiles of point + width * (quantile of the pool), where the pool has at least `least` errors; else from the
    fallback (location, origin, horizon, level, value on the modelling scale)."""
    sizes = pool.groupBy("origin", "horizon").agg(F.count(F.lit(1)).alias("n"))
    qs = from_sample(pool, ["origin", "horizon"], F.col("error")).withColumnRenamed("value", "q")
    rows = points.join(fallback, ["location", "origin", "horizon"]).join(sizes, ["origin", "horizon"], "left").join(qs, ["origin", "horizon", "level"], "left")
    value = F.when(F.col("n") >= least, F.col("point") + width * F.col("q")).otherwise(F.col("value"))
    return rows.select("location", "origin", "horizon", "target_week", "level", transforms.from_scale(value, scale).alias("value"), (F.coalesce("n", F.lit(0)) >= least).alias("calibrated"))
