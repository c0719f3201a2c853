"""A hierarchical model of a panel, fitted per split, with draws as rows.

    z = level + week + deviation[week, location] + season + residual[location] + revision[delay, location] + noise

The week's effect is a random walk over the weeks of the season with mean zero; deviations, seasons and the locations'
revisions are exchangeable; the revision by delay is a random walk that is anchored at the settled values. Residuals are
autoregressions whose coefficients are pooled over locations through their inverse hyperbolic tangents, or random walks,
or autoregressions with a coefficient that drifts, or of a higher order with partial autocorrelations as parameters.

Draws come from Gibbs steps: residual paths by forward filtering and backward sampling, all linear effects at once from
their joint normal distribution, scales and coefficients on grids of their conditional densities.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import calendar
from panelcast.operators.simulate import seed_of

#: Prior scales, as in the text above: level, half-normal scales of effects, anchor of the revisions.
LEVEL_SD, EFFECT_SD, REVISION_SD, ANCHOR_SD = 2.0, 1.0, 0.3, 0.05
GRID = np.exp(np.linspace(np.log(0.005), np.log(3.0), 80))
PHI = np.tanh(np.linspace(-2.3, 2.3, 93))


def paths(y: np.ndarray, phi: np.ndarray, sigma: float, noise: float, rng: np.random.Generator, start: float) -> np.ndarray:
    """A draw of x with x[t] = phi[t] x[t-1] + N(0, sigma^2), y = x + N(0, noise^2) (nan: not seen), x[0] ~ N(0, start^2)."""
    n = len(y)
    q, r = sigma * sigma, noise * noise
    mean, var = [0.0] * n, [0.0] * n
    m, v = 0.0, start * start
    seen, coef = y.tolist(), phi.tolist()
    for t in range(n):
        if t:
            m, v = coef[t] * m, coef[t] * coef[t] * v + q
        if seen[t] == seen[t]:
            k = v / (v + r)
            m, v = m + k * (seen[t] - m), v * (1 - k)
        mean[t], var[t] = m, v
    z = rng.standard_normal(n).tolist()
    out = [0.0] * n
    out[-1] = mean[-1] + z[-1] * var[-1] ** 0.5
    for t in range(n - 2, -1, -1):
        c = coef[t + 1]
        k = var[t] * c / (c * c * var[t] + q)
        out[t] = mean[t] + k * (out[t + 1] - c * mean[t]) + z[t] * max(var[t] * (1 - k * c), 0.0) ** 0.5
    return np.array(out)


def _pick(grid: np.ndarray, log_density: np.ndarray, rng: np.random.Generator) -> float:
    w = np.exp(log_density - log_density.max())
    return float(rng.choice(grid, p=w / w.sum()))


def _scale(sum_squares: float, n: int, prior: float, rng: np.random.Generator) -> float:
    """A draw of the scale of n normal effects under a half-normal prior."""
    return _pick(GRID, -n * np.log(GRID) - sum_squares / (2 * GRID**2) - GRID**2 / (2 * prior**2) + np.log(GRID), rng)


def ar_of_pacf(pacf: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from partial autocorrelations."""
    phi = np.zeros(0)
    for a in pacf:
        phi = np.append(phi - a * phi[::-1], a)
    return phi


class Effects:
    """The linear effects: columns, prior precision, and draws of all of them at once."""

    def __init__(self, woy: np.ndarray, location: np.ndarray, season: np.ndarray, delay: np.ndarray, weeks: int, locations: int, seasons: int, delays: int):
        sizes = {"level": 1, "week": weeks, "deviation": weeks * locations, "season": seasons, "revision": delays, "own": delays * locations}
        at = np.cumsum([0, *sizes.values()])
        self.part = {k: slice(int(a), int(b)) for k, a, b in zip(sizes, at, at[1:])}
        n, k = len(woy), int(at[-1])
        x = np.zeros((n, k))
        rows = np.arange(n)
        for name, index in (("level", np.zeros(n, int)), ("week", woy), ("deviation", woy * locations + location), ("season", season), ("revision", delay), ("own", delay * locations + location)):
            x[rows, self.part[name].start + index] = 1.0
        self.x, self.gram = x, x.T @ x
        # roots of the walks' precisions; that of the weeks has its mean held at zero
        self.week = np.vstack([np.diff(np.eye(weeks), axis=0), np.ones((1, weeks))])
        self.revision = np.diff(np.eye(delays), axis=0)

    def draw(self, y: np.ndarray, noise: float, sd: dict[str, float], rng: np.random.Generator) -> np.ndarray:
        """The solution of the normal equations with every observation and every prior term moved by its own draw has the
        joint conditional distribution: one system, no factor."""
        precision = self.gram / noise**2
        right = self.x.T @ (y / noise**2 + rng.standard_normal(len(y)) / noise)
        for name, p in self.part.items():
            if name in ("week", "revision"):
                root = getattr(self, name) / sd[name]
                precision[p, p] += root.T @ root
                right[p] += root.T @ rng.standard_normal(len(root))
                if name == "revision":
                    precision[p.stop - 1, p.stop - 1] += 1 / ANCHOR_SD**2
                    right[p.stop - 1] += rng.standard_normal() / ANCHOR_SD
            else:
                precision[range(p.start, p.stop), range(p.start, p.stop)] += 1 / sd[name] ** 2
                right[p] += rng.standard_normal(p.stop - p.start) / sd[name]
        return np.linalg.solve(precision, right)


def gibbs(z: np.ndarray, woy: np.ndarray, location: np.ndarray, draws: int, warm: int, rng: np.random.Generator, season: np.ndarray | None = None, delay: np.ndarray | None = None, time: np.ndarray | None = None, residual: str = "ar", order: int = 1, progress: Callable[[int, int], None] | None = None) -> dict[str, np.ndarray]:
    """Draws of level, week, deviation (week, location), season (the last one's effect), phi (the coefficients of the last time), sigma,
    noise, revision (delay, location), last (the latest residuals). Rows in order of location and time; woy from 1, season and delay
    from 0 (default: one season, all settled). residual: `ar` (of an order), `difference` or `drift`. progress(done, all) is called
    for every tenth of the steps."""
    weeks, locations = int(woy.max()), int(location.max()) + 1
    season = np.zeros(len(z), int) if season is None else season
    delay = np.zeros(len(z), int) if delay is None else delay
    if time is None:
        first = np.r_[0, np.flatnonzero(location[1:] != location[:-1]) + 1]
        time = np.arange(len(z)) - np.repeat(first, np.diff(np.append(first, len(z))))
    span = int(time.max()) + 1
    effects = Effects(woy - 1, location, season, delay, weeks, locations, int(season.max()) + 1, int(delay.max()) + 1)
    sd = {"level": LEVEL_SD, "week": 0.1, "deviation": 0.1, "season": 0.1, "revision": 0.05, "own": 0.05}
    spread = float(z.std() + 1e-3)
    noise, sigma = 0.5 * spread, np.full(locations, 0.5 * spread)
    pacf = np.full((locations, order), 0.0)
    pacf[:, 0] = 1.0 if residual == "difference" else 0.5
    phi_t = np.full((locations, span), pacf[0, 0])
    drift, centre, width, log_mean, log_width = 0.05, 0.5, 0.5, np.log(0.2), 0.5
    x = np.zeros((locations, span))
    keep: dict[str, list] = {k: [] for k in ("level", "week", "deviation", "season", "phi", "sigma", "noise", "revision", "last")}
    every = draws + warm
    for it in range(every):
        b = effects.draw(z - x[location, time], noise, sd, rng)
        fit = effects.x @ b
        rest = np.full((locations, span), np.nan)
        rest[location, time] = z - fit
        for k in range(locations):
            coef = ar_of_pacf(pacf[k])
            if order == 1 or residual != "ar":
                x[k] = paths(rest[k], phi_t[k], sigma[k], noise, rng, 2 * spread)
            else:
                x[k] = _ar_path(rest[k], coef, sigma[k], noise, rng, x[k])
            x[k] = np.clip(x[k], -50 * spread, 50 * spread)
            now, before = x[k][order:], x[k]
            lagged = np.column_stack([before[order - j : span - j] for j in range(1, order + 1)])
            prior = -((np.arctanh(PHI) - centre) ** 2) / (2 * width**2)
            if residual == "ar":
                for j in range(order):
                    tries = np.repeat(pacf[k][None], len(PHI), axis=0)
                    tries[:, j] = PHI
                    errors = now - np.stack([ar_of_pacf(p) for p in tries]) @ lagged.T
                    pacf[k, j] = _pick(PHI, -(errors**2).sum(axis=1) / (2 * sigma[k] ** 2) + (prior if j == 0 else -(np.arctanh(PHI) ** 2) / 0.5), rng)
                phi_t[k] = pacf[k, 0]
            elif residual == "drift":
                phi_t[k] = _drifting(x[k], sigma[k], drift, rng)
                pacf[k, 0] = float(np.clip(phi_t[k, -1], PHI[0], PHI[-1]))
            errors = now - (lagged @ ar_of_pacf(pacf[k]) if residual == "ar" else phi_t[k][order:] * lagged[:, 0])
            level = -((np.log(GRID) - log_mean) ** 2) / (2 * log_width**2)
            sigma[k] = _pick(GRID, -len(errors) * np.log(GRID) - float(errors @ errors) / (2 * GRID**2) + level, rng)
        # what is pooled over locations
        a = np.arctanh(np.clip(pacf[:, 0], -0.98, 0.98))
        precision = locations / width**2 + 1
        centre = float(a.sum() / width**2 / precision + rng.standard_normal() / np.sqrt(precision))
        width = _scale(float(((a - centre) ** 2).sum()), locations, 0.5, rng)
        log_sigma = np.log(sigma)
        precision = locations / log_width**2 + 1
        log_mean = float((log_sigma.sum() / log_width**2 + np.log(0.2)) / precision + rng.standard_normal() / np.sqrt(precision))
        log_width = _scale(float(((log_sigma - log_mean) ** 2).sum()), locations, 0.5, rng)
        if residual == "drift":
            drift = _scale(float((np.diff(phi_t, axis=1) ** 2).sum()), phi_t.size - locations, 0.1, rng)
        part = {k: b[p] for k, p in effects.part.items()}
        sd["week"] = _scale(float((np.diff(part["week"]) ** 2).sum()), weeks - 1, EFFECT_SD, rng)
        for name, prior_sd in (("deviation", EFFECT_SD), ("season", EFFECT_SD), ("own", REVISION_SD)):
            sd[name] = _scale(float((part[name] ** 2).sum()), len(part[name]), prior_sd, rng)
        if len(part["revision"]) > 1:
            sd["revision"] = _scale(float((np.diff(part["revision"]) ** 2).sum()), len(part["revision"]) - 1, REVISION_SD, rng)
        error = z - fit - x[location, time]
        noise = _scale(float(error @ error), len(error), 1.0, rng)
        if it >= warm:
            last = int(season[np.argmax(time)])
            values = (float(part["level"][0]), part["week"], part["deviation"].reshape(weeks, locations), float(part["season"][last]), np.array([phi_t[k, -1] for k in range(locations)]), sigma.copy(), noise, part["revision"][:, None] + part["own"].reshape(-1, locations), x[:, -1].copy())
            for k, v in zip(keep, values):
                keep[k].append(v)
        if progress is not None and ((it + 1) * 10) // every > (it * 10) // every:
            progress(it + 1, every)
    return {k: np.array(v) for k, v in keep.items()}


def _drifting(x: np.ndarray, sigma: float, drift: float, rng: np.random.Generator) -> np.ndarray:
    """A draw of the coefficient's path: a random walk that is seen through x[t] = phi[t] x[t-1] + noise."""
    n = len(x)
    mean, var = np.zeros(n), np.zeros(n)
    m, v = 0.5, 0.25
    for t in range(n):
        if t:
            v += drift * drift
            g = v * x[t - 1] / (x[t - 1] ** 2 * v + sigma**2)
            m, v = m + g * (x[t] - x[t - 1] * m), v * (1 - g * x[t - 1])
        mean[t], var[t] = m, v
    out = np.empty(n)
    out[-1] = mean[-1] + rng.standard_normal() * np.sqrt(var[-1])
    for t in range(n - 2, -1, -1):
        k = var[t] / (var[t] + drift * drift)
        out[t] = mean[t] + k * (out[t + 1] - mean[t]) + rng.standard_normal() * np.sqrt(max(var[t] * (1 - k), 0.0))
    return np.clip(out, -1.2, 1.2)


def _ar_path(y: np.ndarray, coef: np.ndarray, sigma: float, noise: float, rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
    """Residuals of a higher order, one by one from their conditionals given the others."""
    x, p, n = x.copy(), len(coef), len(x)
    full = np.r_[-1.0, coef]
    for t in range(n):
        precision, total = 1 / (100 * sigma * sigma), 0.0
        for j in range(p + 1):  # x[t] enters the error at t + j
            s = t + j
            if p <= s < n:
                others = sum(full[i] * x[s - i] for i in range(p + 1) if i != j)
                precision += full[j] ** 2 / sigma**2
                total -= full[j] * others / sigma**2
        if y[t] == y[t]:
            precision += 1 / noise**2
            total += y[t] / noise**2
        x[t] = total / precision + rng.standard_normal() / np.sqrt(precision)
    return x


def fit_splits(panel: DataFrame, draws: int = 100, warm: int = 100, delays: int = 12, residual: str = "ar", order: int = 1) -> DataFrame:
    """origin, draw, location, level, season, phi, sigma, noise, last, revision: a row per draw and location; season is what a
    week of the season adds (the last season's effect and the location's deviation included), revision what each delay does. panel:
    origin, location, week, woy, season_year, z (the history of each origin). One group per origin: a panel of some thousand
    cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["location", "week"])
        origin = pdf["origin"].iloc[0]
        names = sorted(pdf["location"].unique())
        place = pdf["location"].map({n: k for k, n in enumerate(names)}).to_numpy()
        days = pd.to_datetime(pdf["week"])
        time = ((days - days.min()).dt.days // 7).to_numpy()
        delay = np.minimum((time.max() - time), delays)
        season = (pdf["season_year"] - pdf["season_year"].min()).to_numpy()
        d = gibbs(pdf["z"].to_numpy(float), pdf["woy"].to_numpy(int), place, draws, warm, np.random.default_rng(seed_of(origin)), season, delay, time, residual, order)
        rows = []
        for i in range(draws):
            whole = d["week"][i][:, None] + d["deviation"][i] + d["season"][i]
            for k, n in enumerate(names):
                rows.append((origin, i, n, float(d["level"][i]), whole[:, k].tolist(), float(d["phi"][i][k]), float(d["sigma"][i][k]), float(d["noise"][i]), float(d["last"][i][k]), d["revision"][i][:, k].tolist()))
        return pd.DataFrame(rows, columns=["origin", "draw", "location", "level", "season", "phi", "sigma", "noise", "last", "revision"])

    return panel.select("origin", "location", "week", "woy", "season_year", "z").groupBy("origin").applyInPandas(run, "origin date, draw int, location string, level double, season array<double>, phi double, sigma double, noise double, last double, revision array<double>")


def project(draws: DataFrame, horizons: int) -> DataFrame:
    """draws with horizon, latent: level + season + phi^h * last, in Catalyst; noise is left to the caller."""
    rows = draws.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    week = calendar.week_of_season(F.date_add("origin", 7 * F.col("horizon")))
    s = F.coalesce(F.get("season", week - 1), F.lit(0.0))
    return rows.withColumn("latent", F.col("level") + s + F.pow("phi", F.col("horizon")) * F.col("last"))


def predictive(draws: DataFrame, z: Column) -> DataFrame:
    """draws (with latent) with ahead: the latent value and a draw of noise, from z, a column of standard normal values."""
    h = F.col("horizon")
    var = F.aggregate(F.sequence(F.lit(1), h), F.lit(0.0), lambda s, _: 1 + F.col("phi") * F.col("phi") * s)
    return draws.withColumn("ahead", F.col("latent") + z * F.sqrt(F.col("sigma") * F.col("sigma") * var + F.col("noise") * F.col("noise")))
