"""Scores of quantile tables: one pass over the rows, no self-joins, no Python.

With n symmetric levels the weighted interval score is twice the mean pinball loss, and its three parts are sums over
the levels as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.quantiles import TASK


def pinball(value: Column, truth: Column, level: Column) -> Column:
    q = level / 1000
    return F.when(truth < value, (1 - q) * (value - truth)).otherwise(q * (truth - value))


def checked_truth(truth: DataFrame) -> DataFrame:
    """truth; a task with two values fails the job instead of doubling rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("location", "target_week"))
    return truth.withColumn("truth", F.when(n == 1, F.col("truth")).otherwise(F.raise_error(F.lit("two truths for a task")).cast("double")))


def guarded(truth: DataFrame, seasons: list[int]) -> DataFrame:
    """The truth of the given seasons; a row of another one that gets through fails the job."""
    kept = truth.na.drop(subset=["truth"]).filter(F.col("season_year").isin(seasons))
    return kept.withColumn("truth", F.when(F.col("season_year").isin(seasons), F.col("truth")).otherwise(F.raise_error(F.lit("a season that is held out")).cast("double")))


def scored(tables: DataFrame, truth: DataFrame, log: bool = False) -> DataFrame:
    """A row per task: wis, dispersion, overprediction, underprediction, n_quantiles. Levels must be symmetric and
    include the median, else the job fails. Tasks without truth are left out (see missing_truth)."""
    rows = tables.join(checked_truth(truth), ["location", "target_week"])
    v, y = (F.log1p("value"), F.log1p("truth")) if log else (F.col("value"), F.col("truth"))
    below, above, middle = F.col("level") < 500, F.col("level") > 500, F.col("level") == 500
    q = F.col("level") / 1000
    n = F.count(F.lit(1))
    sums = rows.groupBy(*TASK).agg(
        F.sum(pinball(v, y, F.col("level"))).alias("loss"),
        F.sum(v * F.when(below, -q).when(above, 1 - q).otherwise(0.0)).alias("d"),
        F.sum(F.when(below, F.greatest(v - y, F.lit(0.0))).when(middle, 0.5 * F.greatest(v - y, F.lit(0.0))).otherwise(0.0)).alias("o"),
        F.sum(F.when(above, F.greatest(y - v, F.lit(0.0))).when(middle, 0.5 * F.greatest(y - v, F.lit(0.0))).otherwise(0.0)).alias("u"),
        n.alias("n_quantiles"),
        F.sum(F.col("level") - 500).alias("balance"),
        F.sum(middle.cast("int")).alias("medians"),
    )
    sound = (F.col("balance") == 0) & (F.col("medians") == 1) & (F.col("n_quantiles") >= 3)
    checked = sums.withColumn("loss", F.when(sound, F.col("loss")).otherwise(F.raise_error(F.lit("levels must be symmetric with one median")).cast("double")))
    half = F.col("n_quantiles") / 2
    return checked.select(*TASK, (F.col("loss") / half).alias("wis"), (F.col("d") / half).alias("dispersion"), (F.col("o") / half).alias("overprediction"), (F.col("u") / half).alias("underprediction"), "n_quantiles")


def covered_levels(tables: DataFrame, truth: DataFrame, pairs: dict[str, tuple[int, int]], by: list[str]) -> DataFrame:
    """by, a column of coverage for each named pair of levels, n: one pass for all pairs."""
    ends = {f"_{side}_{name}": F.max(F.when(F.col("level") == level, F.col("value"))) for name, pair in pairs.items() for side, level in zip(("lo", "hi"), pair)}
    tasks = tables.groupBy(*TASK).agg(*[c.alias(n) for n, c in ends.items()]).join(truth, ["location", "target_week"])
    shares = [F.avg(F.col("truth").between(F.col(f"_lo_{name}"), F.col(f"_hi_{name}")).cast("double")).alias(name) for name in pairs]
    return tasks.groupBy(*by).agg(*shares, F.count(F.lit(1)).alias("n"))


def both_scales(tables: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, natural_wis, log_wis: mean scores on both scales in one pass over the rows."""
    rows = tables.join(checked_truth(truth), ["location", "target_week"])
    loss = lambda v, y: 2 * F.avg(pinball(v, y, F.col("level")))
    tasks = rows.groupBy(*TASK).agg(loss(F.col("value"), F.col("truth")).alias("_n"), loss(F.log1p("value"), F.log1p("truth")).alias("_l"))
    return tasks.groupBy(*by).agg(F.avg("_n").alias("natural_wis"), F.avg("_l").alias("log_wis"))


def missing_truth(tables: DataFrame, truth: DataFrame) -> DataFrame:
    """Tasks that can't be scored."""
    return tables.select(*TASK).distinct().join(truth, ["location", "target_week"], "left_anti")


def covered(tables: DataFrame, truth: DataFrame, lower: int, upper: int, by: list[str]) -> DataFrame:
    """by, coverage, n: share of tasks whose truth lies between two levels; one conditional aggregate per task."""
    ends = tables.filter(F.col("level").isin(lower, upper)).groupBy(*TASK).agg(F.max(F.when(F.col("level") == lower, F.col("value"))).alias("lo"), F.max(F.when(F.col("level") == upper, F.col("value"))).alias("hi"))
    rows = ends.join(truth, ["location", "target_week"])
    return rows.groupBy(*by).agg(F.avg(F.col("truth").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def bias(tables: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, bias, log_bias of the median (forecast minus truth)."""
    rows = tables.filter("level = 500").join(truth, ["location", "target_week"])
    return rows.groupBy(*by).agg(F.avg(F.col("value") - F.col("truth")).alias("bias"), F.avg(F.log1p("value") - F.log1p("truth")).alias("log_bias"), F.count(F.lit(1)).alias("n"))


def breakdown(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean scores by each column of `by` alone, in one pass (grouping sets)."""
    view = "panelcast_scores_" + str(id(scores))
    scores.createOrReplaceTempView(view)
    sets = ", ".join(f"(model, {c})" for c in by)
    picks = ", ".join(f"cast({c} as string)" for c in by)
    names = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by)
    return scores.sparkSession.sql(f"SELECT model, CASE {names} END AS dimension, coalesce({picks}) AS member, avg(wis) AS wis, count(*) AS n FROM {view} GROUP BY GROUPING SETS ({sets}) ORDER BY 1, 2, 3")
