"""Choosing between candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite(scores: DataFrame, penalty: float = 0.5) -> DataFrame:
    """model, mean_wis, cv, worst_location, worst_origin (relative excesses), composite; the smaller the better."""
    whole = scores.groupBy("model").agg(F.avg("wis").alias("mean_wis"), F.stddev_samp("wis").alias("sd"))
    by_location = scores.groupBy("model", "location").agg(F.avg("wis").alias("w")).groupBy("model").agg(F.max("w").alias("worst_l"))
    by_origin = scores.groupBy("model", "origin").agg(F.avg("wis").alias("w"))
    spread = by_origin.groupBy("model").agg(F.max("w").alias("worst_o"), (F.stddev_samp("w") / F.avg("w")).alias("cv"))
    rows = whole.join(by_location, "model").join(spread, "model")
    rows = rows.withColumns({"worst_location": F.col("worst_l") / F.col("mean_wis") - 1, "worst_origin": F.col("worst_o") / F.col("mean_wis") - 1})
    return rows.withColumn("composite", F.col("mean_wis") * (1 + penalty * (F.col("cv") + F.col("worst_location") + F.col("worst_origin")))).select("model", "mean_wis", "cv", "worst_location", "worst_origin", "composite")


def ranked(rows: DataFrame, score: str, name: str = "rank", tie: float = 0.0, parameters: Column | None = None) -> DataFrame:
    """rows with a rank by score, then model. Within `tie` of the best score, fewer parameters come first. The window has
    a row per candidate."""
    order = [F.col(score), F.col("model")]
    if parameters is not None:
        least = F.min(score).over(Window.partitionBy())
        near = F.col(score) <= least * (1 + tie)
        order = [F.when(near, 0).otherwise(1), F.when(near, parameters), *order]
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def worst(scores: DataFrame, by: str) -> DataFrame:
    """model and the member of `by` with its highest mean score."""
    means = scores.groupBy("model", by).agg(F.avg("wis").alias("w"))
    return means.groupBy("model").agg(F.max_by(by, F.struct("w", by)).alias(by), F.max("w").alias("worst_wis"))


def wide(scores: DataFrame, models: list[str]) -> DataFrame:
    """origin, a column per model, mean of those that aren't null."""
    rows = scores.groupBy("origin").pivot("model", models).agg(F.avg("wis"))
    there = F.filter(F.array(*models), lambda x: x.isNotNull())
    return rows.withColumn("mean", F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def net_positive(scores: DataFrame, base: str, candidate: str, tolerance: float = 0.01) -> DataFrame:
    """accepted: short horizons (1, 2) no worse than by tolerance, one of 3 and 4 better, the mean no worse."""
    m = lambda model, h=None: F.avg(F.when((F.col("model") == model) & (F.lit(True) if h is None else F.col("horizon") == h), F.col("wis")))
    short = [m(candidate, h) <= m(base, h) * (1 + tolerance) for h in (1, 2)]
    long = [m(candidate, h) < m(base, h) for h in (3, 4)]
    return scores.agg((short[0] & short[1] & (long[0] | long[1]) & (m(candidate) <= m(base))).alias("accepted"), m(base).alias("base_wis"), m(candidate).alias("candidate_wis"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k models with the least mean score; ties by name."""
    means = scores.groupBy("model").agg(F.avg("wis").alias("_w"))
    return means.withColumn("_k", F.row_number().over(Window.orderBy("_w", "model"))).filter(F.col("_k") <= k).select("model")


def tally(rows: DataFrame, column: str) -> DataFrame:
    """column, n: how often each value is there, the most frequent first."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def status(scores: DataFrame, expected: list[str]) -> DataFrame:
    """model, status (ok, failed: fewer tasks than the others, missing), tasks, score (infinite unless ok)."""
    have = scores.groupBy("model").agg(F.count(F.lit(1)).alias("tasks"), F.avg("wis").alias("w"))
    most = have.agg(F.max("tasks").alias("most"))
    names = scores.sparkSession.createDataFrame([(m,) for m in expected], "model string")
    rows = names.join(have, "model", "left").crossJoin(F.broadcast(most))  # one row
    state = F.when(F.col("tasks").isNull(), "missing").when(F.col("tasks") < F.col("most"), "failed").otherwise("ok")
    return rows.select("model", state.alias("status"), F.coalesce("tasks", F.lit(0)).alias("tasks"), F.when(state == "ok", F.col("w")).otherwise(F.lit(float("inf"))).alias("score"))
