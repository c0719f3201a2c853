"""Model fits: closed forms as aggregates, recursions as folds, linear systems as grouped pandas functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ar1(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, slope, intercept, sd, n, last: least squares of z on lag1, one aggregate. sd has n - 2 degrees, 1 at least."""
    out = rows.groupBy(*by).agg(F.regr_slope("z", "lag1").alias("slope"), F.regr_intercept("z", "lag1").alias("intercept"), F.regr_syy("z", "lag1").alias("syy"), F.regr_sxy("z", "lag1").alias("sxy"), F.count(F.lit(1)).alias("n"), F.max_by("z", "week").alias("last"), F.max("week").alias("last_week"))
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return out.withColumn("sd", F.sqrt(sse / F.greatest(F.col("n") - 2, F.lit(1)))).drop("syy", "sxy")


def ar1_running(rows: DataFrame, by: list[str]) -> DataFrame:
    """The same at every row, from the rows of its group up to it, by running sums: by, week, slope, intercept, sd, n, last."""
    w = Window.partitionBy(*by).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    made = {"slope": F.regr_slope("z", "lag1").over(w), "intercept": F.regr_intercept("z", "lag1").over(w), "_yy": F.regr_syy("z", "lag1").over(w), "_xy": F.regr_sxy("z", "lag1").over(w), "n": F.count(F.lit(1)).over(w)}
    out = rows.select(*by, "week", F.col("z").alias("last"), *[c.alias(n) for n, c in made.items()])
    sse = F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0))
    return out.withColumn("sd", F.sqrt(sse / F.greatest(F.col("n") - 2, F.lit(1)))).drop("_yy", "_xy")


def blend(own: DataFrame, pooled: DataFrame, weight: float, by: list[str], columns: list[str]) -> DataFrame:
    """(1 - weight) * own + weight * pooled for each column. pooled has a row per `by`."""
    renamed = pooled.select(*by, *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = own.join(renamed, by)
    return joined.withColumns({c: (1 - weight) * F.col(c) + weight * F.col(f"_p_{c}") for c in columns}).drop(*[f"_p_{c}" for c in columns])


def shrunk(fits: DataFrame, value: str, variance: str, by: list[str]) -> DataFrame:
    """Estimates of a group shrunk to their mean: one weight tau2 / (tau2 + v) for the group, with the mean variance v and
    tau2 = max(var - v, 1e-8)."""
    w = Window.partitionBy(*by)
    v, mean = F.avg(variance).over(w), F.avg(value).over(w)
    tau = F.greatest(F.var_samp(value).over(w) - v, F.lit(1e-8))
    return fits.withColumn("shrunk", mean + tau / (tau + v) * (F.col(value) - mean))


def in_order(rows: DataFrame, by: list[str], value: str = "z", time: str = "week") -> DataFrame:
    """by, ys: each group's values in order of time, for folds. A group is one series: bounded by its weeks."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, value))), lambda x: x[value]).alias("ys"))


def smoothing(series: DataFrame, alphas: list[float]) -> DataFrame:
    """series with alpha, level, sse of simple exponential smoothing for each alpha: a fold that starts at y[1]."""
    grid = series.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    zero = F.struct(F.element_at("ys", 1).alias("level"), F.lit(0.0).alias("sse"))
    fold = F.aggregate(F.slice("ys", F.lit(2), F.greatest(F.size("ys") - 1, F.lit(0))), zero, lambda s, y: F.struct((s["level"] + F.col("alpha") * (y - s["level"])).alias("level"), (s["sse"] + (y - s["level"]) * (y - s["level"])).alias("sse")))
    return grid.withColumn("f", fold).select(*grid.columns, "f.level", "f.sse")


def holt(series: DataFrame, grid: list[tuple[float, float, float]]) -> DataFrame:
    """series with alpha, beta, phi, level, trend, sse of (damped) Holt filters: level y[1], trend y[2] - y[1]."""
    rows = series.withColumn("g", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(p).alias("phi")) for a, b, p in grid])))
    rows = rows.select(*series.columns, "g.alpha", "g.beta", "g.phi")
    zero = F.struct(F.element_at("ys", 1).alias("level"), (F.element_at("ys", 2) - F.element_at("ys", 1)).alias("trend"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        ahead = s["level"] + F.col("phi") * s["trend"]
        level = ahead + F.col("alpha") * (y - ahead)
        trend = F.col("beta") * (level - s["level"]) + (1 - F.col("beta")) * F.col("phi") * s["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"), (s["sse"] + (y - ahead) * (y - ahead)).alias("sse"))

    fold = F.aggregate(F.slice("ys", F.lit(2), F.greatest(F.size("ys") - 1, F.lit(0))), zero, step)
    return rows.withColumn("f", fold).select(*rows.columns, "f.level", "f.trend", "f.sse")


def best(fits: DataFrame, by: list[str], parameters: list[str], others: list[str]) -> DataFrame:
    """The fit with the least sse of each group; ties to the smaller parameters."""
    pick = F.min_by(F.struct(*parameters, *others, "sse"), F.struct(F.round("sse", 9), *parameters))
    return fits.groupBy(*by).agg(pick.alias("b")).select(*by, "b.*")


def random_walk(rows: DataFrame, by: list[str], value: str = "z", time: str = "week") -> DataFrame:
    """by, last, drift (mean step), sd (root mean square step), n."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(time))
    rows = rows.withColumn("_s", step)
    return rows.groupBy(*by).agg(F.max_by(value, time).alias("last"), F.avg("_s").alias("drift"), F.sqrt(F.avg(F.col("_s") * F.col("_s"))).alias("sd"), F.count("_s").alias("n"))


def random_walk_running(rows: DataFrame, by: list[str], value: str = "z", time: str = "week") -> DataFrame:
    """random_walk at every row, from the rows up to it: by, time, last, drift, sd, n."""
    order = Window.partitionBy(*by).orderBy(time)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.select(*by, time, F.col(value).alias("last"), (F.col(value) - F.lag(value).over(order)).alias("_s"))
    return steps.select(*by, time, "last", F.avg("_s").over(upto).alias("drift"), F.sqrt(F.avg(F.col("_s") * F.col("_s")).over(upto)).alias("sd"), F.count("_s").over(upto).alias("n"))


def damped_walk(rows: DataFrame, by: list[str], phi: float, value: str = "z", time: str = "week") -> DataFrame:
    """by, anchor, slope (0), phi, sd: a random walk that goes back to 0 by phi a step (1: none)."""
    e = F.col(value) - phi * F.lag(value).over(Window.partitionBy(*by).orderBy(time))
    out = rows.withColumn("_e", e).groupBy(*by).agg(F.max_by(value, time).alias("anchor"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("sd"))
    return out.withColumns({"slope": F.lit(0.0), "phi": F.lit(phi)})


def local_line(rows: DataFrame, by: list[str], last: int, value: str = "z", time: str = "week") -> DataFrame:
    """by, anchor, slope, phi (1), sd: the median slope of all pairs among the last values, and the root mean square of the
    steps that it leaves."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time)))
    ends = rows.withColumn("_b", back).filter(F.col("_b") <= last)
    got = ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_b"), F.col(value).alias("v")))), lambda x: x["v"]).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda b, j: (b - a) / (j + 1))))
    slopes = got.select(*by, "v", F.explode(pairs).alias("s")).groupBy(*by, "v").agg(F.percentile("s", F.lit(0.5)).alias("slope"))
    steps = F.transform(F.slice("v", F.lit(2), F.size("v") - 1), lambda b, i: b - F.get("v", i) - F.col("slope"))
    square = F.aggregate(steps, F.lit(0.0), lambda t, x: t + x * x) / F.size(steps)
    return slopes.select(*by, F.element_at("v", -1).alias("anchor"), "slope", F.lit(1.0).alias("phi"), F.sqrt(square).alias("sd"))


def damped_level(series: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """series with alpha, phi, level, sse: a level that is smoothed by alpha and goes back to the mean by phi a step."""
    rows = series.withColumn("g", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(p).alias("phi")) for a, p in grid])))
    mu = F.aggregate("ys", F.lit(0.0), lambda a, x: a + x) / F.size("ys")
    rows = rows.select(*series.columns, "g.alpha", "g.phi", mu.alias("mu"))
    zero = F.struct(F.element_at("ys", 1).alias("level"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        ahead = F.col("mu") + F.col("phi") * (s["level"] - F.col("mu"))
        return F.struct((ahead + F.col("alpha") * (y - ahead)).alias("level"), (s["sse"] + (y - ahead) * (y - ahead)).alias("sse"))

    fold = F.aggregate(F.slice("ys", F.lit(2), F.greatest(F.size("ys") - 1, F.lit(0))), zero, step)
    return rows.withColumn("f", fold).select(*rows.columns, "f.level", "f.sse")


# linear systems, for one series (or panel) at a time


def design(y: np.ndarray, order: int, horizon: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(X with a constant and `order` lags, target `horizon` steps ahead)."""
    n = len(y) - order - horizon + 1
    x = np.column_stack([np.ones(n), *[y[order - k : order - k + n] for k in range(1, order + 1)]])
    return x, y[order + horizon - 1 : order + horizon - 1 + n]


def least_squares(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 0.0, penalised: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, residual sd). Weights scale rows by their root, and the sd then uses unweighted residuals with
    weights over sum(w) - k. ridge penalises the columns under `penalised` (default: all but the first)."""
    k = x.shape[1]
    root = np.ones(len(y)) if weights is None else np.sqrt(weights)
    xw, yw = x * root[:, None], y * root
    if ridge:
        mask = np.arange(k) > 0 if penalised is None else penalised
        b = np.linalg.solve(xw.T @ xw + ridge * np.diag(mask.astype(float)), xw.T @ yw)
    else:
        b = np.linalg.lstsq(xw, yw, rcond=None)[0]
    e = y - x @ b
    w = root * root
    return b, float(np.sqrt((w * e * e).sum() / max(w.sum() - k, 1)))


def recursive(x: np.ndarray, y: np.ndarray, forget: float, start: float = 1e6) -> np.ndarray:
    """Recursive least squares with forgetting, from a diffuse start."""
    b, p = np.zeros(x.shape[1]), np.eye(x.shape[1]) * start
    for row, target in zip(x, y):
        gain = p @ row / (forget + row @ p @ row)
        b = b + gain * (target - row @ b)
        p = (p - np.outer(gain, row @ p)) / forget
    return b


def standardised_ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float, float]:
    """(coefficients on the natural scale, constant, sd): columns scaled to sd 1 (sd under 1e-8 counts as 1), constant free."""
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    sd = np.where(sd < 1e-8, 1.0, sd)
    z = (x - mean) / sd
    b = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean())) / sd
    c = float(y.mean() - mean @ b)
    e = y - c - x @ b
    return b, c, float(np.sqrt((e * e).sum() / max(len(y) - (x.shape[1] + 1), 1)))


def fit_each(rows: DataFrame, by: list[str], fit: Callable[[np.ndarray], dict], schema: str, value: str = "z", time: str = "week") -> DataFrame:
    """One applyInPandas group per series. A series whose fit fails becomes a row with status and error, not a failed
    job."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        out = {c: pdf[c].iloc[0] for c in by}
        try:
            made = fit(pdf[value].to_numpy(float)) | {"status": "ok", "error": None}
        except (ValueError, np.linalg.LinAlgError) as e:
            made = {n: None for n in names} | {"status": "failed", "error": str(e)}
        return pd.DataFrame([out | made])[[*by, *names, "status", "error"]]

    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, time, value).groupBy(*by).applyInPandas(run, f"{keys}, {schema}, status string, error string")


def ar(order: int, discount: float = 1.0) -> Callable[[np.ndarray], dict]:
    """A fit for fit_each: coefficients and sd of an autoregression; too few rows raise."""

    def fit(y: np.ndarray) -> dict:
        if len(y) - order < order + 2:
            raise ValueError("too few rows")
        x, target = design(y, order)
        w = None if discount == 1.0 else discount ** np.arange(len(target) - 1, -1, -1)
        b, sd = least_squares(x, target, w)
        return {"coef": b.tolist(), "sd": sd, "n": len(target)}

    return fit


def vector_ridge(wide: pd.DataFrame, order: int, penalty: float, cross_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (equations, 1 + locations * order) and sds of a ridge vector autoregression on a wide panel. With
    cross_only, an equation's own lags and constant are free."""
    y = wide.to_numpy(float)
    n, m = y.shape
    x = np.column_stack([np.ones(n - order), *[y[order - k : n - k] for k in range(1, order + 1)]])
    out, sds = [], []
    for j in range(m):
        mask = np.arange(x.shape[1]) > 0
        if cross_only:
            mask &= (np.arange(x.shape[1]) - 1) % m != j
        b, _ = least_squares(x, y[order:, j], ridge=penalty, penalised=mask)
        e = y[order:, j] - x @ b
        out.append(b)
        sds.append(np.sqrt((e * e).sum() / max(len(e) - x.shape[1], 1)))
    return np.array(out), np.array(sds)


def whittaker(raw: np.ndarray, penalty: float) -> np.ndarray:
    """Circular smoother: solves (I + penalty D'D) x = raw with D the circular second difference."""
    eye = np.eye(len(raw))
    d = np.roll(eye, 1, axis=1) - 2 * eye + np.roll(eye, -1, axis=1)
    return np.linalg.solve(eye + penalty * d.T @ d, raw)


def average_linkage(distance: np.ndarray, k: int) -> list[int]:
    """Cluster number of each item, by merging the closest pair (the first of equal ones) until k are left."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > k:
        _, a, b = min((float(np.mean([distance[i, j] for i in groups[a] for j in groups[b]])), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        joined = groups[a] + groups[b]
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [joined]
    out = [0] * len(distance)
    for number, g in enumerate(sorted(groups, key=min), 1):
        for i in g:
            out[i] = number
    return out


def partial_autocorrelation(acf: np.ndarray) -> np.ndarray:
    """From autocorrelations at lags 1.. by the Durbin-Levinson recursion."""
    n = len(acf)
    out, phi = np.zeros(n), np.zeros(0)
    for k in range(1, n + 1):
        a = acf[k - 1] if k == 1 else (acf[k - 1] - phi @ acf[k - 2 :: -1][: k - 1]) / (1 - phi @ acf[: k - 1])
        phi = np.append(phi - a * phi[::-1], a) if k > 1 else np.array([a])
        out[k - 1] = a
    return out
