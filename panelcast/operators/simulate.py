"""Paths ahead: closed forms where the model is linear and Gaussian, seeded draws per group elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_of(*parts) -> int:
    """A seed from a group's key: results don't depend on the order of groups."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little")


def ar1_ahead(fits: DataFrame, horizons: list[int]) -> DataFrame:
    """fits with horizon, mean, sd_h: mean recursion and sd * sqrt(sum of slope^(2i)), as folds."""
    rows = fits.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    steps = F.sequence(F.lit(1), F.col("horizon"))
    mean = F.aggregate(steps, F.col("last"), lambda m, _: F.col("intercept") + F.col("slope") * m)
    spread = F.aggregate(steps, F.lit(0.0), lambda s, _: 1 + F.col("slope") * F.col("slope") * s)
    return rows.withColumns({"mean": mean, "sd_h": F.col("sd") * F.sqrt(spread)})


def point_path(last: Column, slope: Column, intercept: Column, steps: Column) -> Column:
    """The recursion without noise."""
    return F.aggregate(F.sequence(F.lit(1), steps), last, lambda m, _: intercept + slope * m)


def walk_ahead(fits: DataFrame, horizons: list[int]) -> DataFrame:
    """fits (anchor, slope, phi, sd) with horizon, mean, sd_h: phi^h * anchor + h * slope, sd * sqrt(sum of phi^(2i))."""
    rows = fits.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    spread = F.aggregate(F.sequence(F.lit(1), F.col("horizon")), F.lit(0.0), lambda s, _: 1 + F.col("phi") * F.col("phi") * s)
    return rows.withColumns({"mean": F.pow("phi", "horizon") * F.col("anchor") + F.col("slope") * F.col("horizon"), "sd_h": F.col("sd") * F.sqrt(spread)})


def damped_blend(point: Column, last: Column, drift: Column, horizon: Column, most: int, phi: float, weight: float) -> Column:
    """The point and a damped trend from the last value, with a weight for the latter that grows from 0 to `weight`."""
    trend = last + drift * F.aggregate(F.sequence(F.lit(1), horizon), F.lit(0.0), lambda s, _: (s + 1) * phi)
    w = weight * (horizon - 1) / (most - 1)
    return (1 - w) * point + w * trend


def innovations(rng: np.random.Generator, kind: str, sd: float, shape: tuple, df: int = 10, scale: float = 1.0, residuals: np.ndarray | None = None) -> np.ndarray:
    """Gaussian, Student-t matched in variance (times scale), or drawn from residuals."""
    if kind == "gaussian":
        return rng.normal(0, sd, shape)
    if kind == "student":
        return sd * np.sqrt((df - 2) / df) * scale * rng.standard_t(df, shape)
    return rng.choice(residuals, shape)


def ar_paths(y: np.ndarray, coef: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Paths (n, h) of an autoregression with a constant from the tail of y."""
    p = len(coef) - 1
    tail = np.tile(y[-p:][::-1], (len(noise), 1))
    out = np.empty_like(noise)
    for h in range(noise.shape[1]):
        out[:, h] = coef[0] + tail @ coef[1:] + noise[:, h]
        tail = np.column_stack([out[:, h], tail[:, :-1]])
    return out


def joint_paths(y: np.ndarray, coef: np.ndarray, noise: np.ndarray, order: int) -> np.ndarray:
    """Paths (n, h, locations) of a vector autregression: all locations step together."""
    n, h, m = noise.shape
    tail = [np.tile(y[-k], (n, 1)) for k in range(1, order + 1)]
    out = np.empty_like(noise)
    for t in range(h):
        x = np.column_stack([np.ones(n), *tail])
        out[:, t] = x @ coef.T + noise[:, t]
        tail = [out[:, t], *tail[:-1]]
    return out


def analogue_paths(y: np.ndarray, length: int, horizon: int, n: int, rng: np.random.Generator, spread: float = 1.0, jitter: float = 0.05) -> np.ndarray:
    """Increments that followed the past segments most like the last one: an anchor per path, kept over horizons."""
    ends = np.arange(length, len(y) - horizon + 1)
    now = y[-length:] - y[-1]
    distance = np.array([np.sqrt(np.mean((y[e - length : e] - y[e - 1] - now) ** 2)) for e in ends])
    width = max(float(np.median(distance)) * spread, 1e-9)
    weight = np.exp(-0.5 * (distance / width) ** 2)
    anchor = rng.choice(ends, n, p=weight / weight.sum())
    ahead = np.stack([y[anchor + k] - y[anchor - 1] for k in range(horizon)], axis=1)
    return y[-1] + ahead + rng.normal(0, jitter, (n, 1))


def nowcast_paths(y: np.ndarray, coef: np.ndarray, noise: np.ndarray, changes: list[np.ndarray | None], rng: np.random.Generator) -> np.ndarray:
    """Paths of an autoregression whose last values are still revised: on every path each of them is moved by a change
    drawn from its own past ones (changes: the last value first; None for a settled value), and the recursion goes on
    from there, so that the doubt about the present carries into every horizon."""
    p = len(coef) - 1
    tail = np.tile(y[-p:][::-1], (len(noise), 1))
    for k, past in enumerate(changes[:p]):
        if past is not None and len(past):
            tail[:, k] += rng.choice(past, len(noise))
    out = np.empty_like(noise)
    for h in range(noise.shape[1]):
        out[:, h] = coef[0] + tail @ coef[1:] + noise[:, h]
        tail = np.column_stack([out[:, h], tail[:, :-1]])
    return out


def mechanistic_paths(y: np.ndarray, coef: np.ndarray, noise: np.ndarray, so_far: float, total: float, natural: Callable[[np.ndarray, int], np.ndarray], depletion: float | None = None, renewal: tuple[float, float, float] | None = None) -> np.ndarray:
    """Paths of an autoregression that slow down as a season's usual total is used up: each path adds what it has reached
    on the natural scale (natural(values, step)) to `so_far`, and its step from the last value shrinks by the share that is
    left to the power of depletion; renewal (size, decay, power) adds a drift that fades with the step and that share.
    Without a usual total (not positive or nan) they are plain paths."""
    p = len(coef) - 1
    tail = np.tile(y[-p:][::-1], (len(noise), 1))
    used = np.full(len(noise), so_far)
    out = np.empty_like(noise)
    for h in range(noise.shape[1]):
        mean = coef[0] + tail @ coef[1:]
        if total > 0:
            left = np.maximum(1 - np.minimum(used / total, 1.5), 0.0)
            if depletion is not None:
                mean = tail[:, 0] + (mean - tail[:, 0]) * left**depletion
            if renewal is not None:
                mean = mean + renewal[0] * renewal[1] ** (h + 1) * left ** renewal[2]
        out[:, h] = mean + noise[:, h]
        tail = np.column_stack([out[:, h], tail[:, :-1]])
        used = used + np.maximum(natural(out[:, h], h), 0.0)
    return out


def simulate_each(rows: DataFrame, by: list[str], make: Callable[[np.ndarray, np.random.Generator], np.ndarray], levels: list[int], back: Callable[[np.ndarray], np.ndarray], value: str = "z", time: str = "week") -> DataFrame:
    """by, horizon, level, value: quantiles of make()'s paths on the modelling scale, then back to the natural one and cut
    at zero. One group per series; the seed comes from its key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        key = [pdf[c].iloc[0] for c in by]
        paths = make(pdf[value].to_numpy(float), np.random.default_rng(seed_of(*key)))
        q = np.quantile(paths, np.array(levels) / 1000, axis=0)
        out = [(*key, h + 1, level, max(float(back(q[i, h])), 0.0)) for h in range(paths.shape[1]) for i, level in enumerate(levels)]
        return pd.DataFrame(out, columns=[*by, "horizon", "level", "value"])

    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, time, value).groupBy(*by).applyInPandas(run, f"{keys}, horizon int, level int, value double")
