"""Queries of the regressions: designs, weighted and penalised least squares from sums, and what is forecast with them.

The SQL solves the same systems by elimination on nested lists, one pivot a step of a recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import calendar
from panelcast.functions.distributions import NORMAL
from panelcast.operators import diagnostics, features, linear, panel, profiles, quantiles
from panelcast.plans import base
from panelcast.plans.base import HORIZONS, ORIGINS, PANEL, sql_solve, sql_sse, sql_system
from panelcast.plans.queries import HIST, SEASONAL, _history, query, rounded


def _one() -> Column:
    """The constant of a design; a column needs a session, so it is made when it is used."""
    return F.lit(1.0)


def _terms(fits: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    """A row per coefficient."""
    rows = fits.select(*by, *more, F.posexplode("coef").alias("term", "value"))
    return rounded(rows, "value", *more, digits=5)


def _sql_terms(fits: str, by: str, more: str = "") -> str:
    return f"SELECT {by}, (unnest(range(1, len(coef) + 1)) - 1)::INTEGER AS term, round(unnest(coef), 5) + 0.0 AS value{more} FROM {fits}"


def _lag_names(p: int, first: int = 1) -> list[str]:
    return [f"lag{k}" for k in range(first, p + first)]


def sql_lags(name: str, p: int, source: str = "p", value: str = "z", columns: str = "location, week, woy, z") -> str:
    lags = ", ".join(f"lag({value}, {k}) OVER w AS lag{k}" for k in range(1, p + 1))
    return f"{name} AS (SELECT * FROM (SELECT {columns}, {lags} FROM {source} WINDOW w AS (PARTITION BY location ORDER BY week)) WHERE lag{p} IS NOT NULL)"


def _at_origins(spark, d, fits: DataFrame) -> DataFrame:
    return panel.latest(fits, base.origins(spark, d), [c for c in ("location",) if c in fits.columns])


def _sd(n: int, source: str = "s") -> str:
    return f"sqrt({sql_sse(source)} / greatest({source}.sw - {n}, 1))"


_OL = ["origin", "location"]


@query(f"""WITH RECURSIVE {PANEL}, {ORIGINS}, {sql_lags('l', 6)}, s AS (SELECT origin, location, {sql_system(['1.0', *_lag_names(6)], 'z')} FROM l, o WHERE week <= origin GROUP BY 1, 2), {sql_solve('c', 's', 'origin, location')},
f AS (SELECT c.*, n, {_sd(7)} AS sd FROM c JOIN s USING (origin, location)) {_sql_terms('f', 'origin, location', ', round(sd, 5) AS sd, n')}""")
def ar6_fit(spark, d):
    """Autoregressions of order 6 at every origin, from running sums."""
    rows = features.lags(base.logged(spark, d), "z", 6, ["location"])
    fits = linear.running(rows, ["location"], "week", [_one(), *map(F.col, _lag_names(6))], F.col("z"))
    return _terms(_at_origins(spark, d, fits).select(*_OL, "coef", "sd", "n"), [*_OL, "n"], ["sd"])


@query(f"""WITH RECURSIVE {PANEL}, {ORIGINS}, {sql_lags('l', 6)}, s AS (SELECT origin, {sql_system(['1.0', *_lag_names(6)], 'z')} FROM l, o WHERE week <= origin GROUP BY 1), {sql_solve('c', 's', 'origin')},
f AS (SELECT c.*, {_sd(7)} AS sd FROM c JOIN s USING (origin)) {_sql_terms('f', 'origin', ', round(sd, 5) AS sd')}""")
def ar6_fullpool(spark, d):
    """One regression of all locations' rows: sums by week first, then running ones."""
    rows = features.lags(base.logged(spark, d), "z", 6, ["location"])
    xs = [_one(), *map(F.col, _lag_names(6))]
    weeks = rows.groupBy("week").agg(*[F.sum(x).alias(f"_s{k}") for k, x in enumerate(linear.products(xs, F.col("z")))], F.count(F.lit(1)).alias("_n"))
    return _terms(_at_origins(spark, d, linear.running_sums(weeks, [], "week", 7)), ["origin"], ["sd"])


@query(f"""WITH RECURSIVE {PANEL}, {ORIGINS}, {sql_lags('l', 3)}, r AS (SELECT l.*, origin, row_number() OVER (PARTITION BY origin, location ORDER BY week DESC) AS back FROM l, o WHERE week <= origin), s AS (SELECT origin, location, {sql_system(['1.0', *_lag_names(3)], 'z')} FROM r WHERE back <= 104 GROUP BY 1, 2), {sql_solve('c', 's', 'origin, location')},
f AS (SELECT c.*, {_sd(4)} AS sd FROM c JOIN s USING (origin, location)) {_sql_terms('f', 'origin, location', ', round(sd, 5) AS sd')}""")
def ar_rolling(spark, d):
    """Order 3 on the last 104 rows of each origin."""
    rows = features.lags(base.logged(spark, d), "z", 3, ["location"])
    fits = linear.running(rows, ["location"], "week", [_one(), *map(F.col, _lag_names(3))], F.col("z"), last=104)
    return _terms(_at_origins(spark, d, fits), _OL, ["sd"])


def _aged(spark, d, order: int) -> DataFrame:
    """Every origin's design with the age of each row in steps back from the last one."""
    rows = panel.expanding(features.lags(base.logged(spark, d), "z", order, ["location"]), base.origins(spark, d))
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(*_OL).orderBy(F.desc("week"))) - 1)


_AGED = f"{PANEL}, {ORIGINS}, {sql_lags('l', 3)}, r AS (SELECT l.*, origin, row_number() OVER (PARTITION BY origin, location ORDER BY week DESC) - 1 AS age FROM l, o WHERE week <= origin)"


def _weighted_sql(weight: str, penalties: list[str] | None = None) -> str:
    return f"""WITH RECURSIVE {_AGED}, s AS (SELECT origin, location, {sql_system(['1.0', *_lag_names(3)], 'z', weight, penalties)} FROM r GROUP BY 1, 2), {sql_solve('c', 's', 'origin, location')},
f AS (SELECT c.*, {_sd(4)} AS sd FROM c JOIN s USING (origin, location)) {_sql_terms('f', 'origin, location', ', round(sd, 5) AS sd')}"""


@query(_weighted_sql("pow(0.99, age)"))
def ar_discounted(spark, d):
    """Order 3, weights 0.99^age."""
    return _terms(linear.fitted(_aged(spark, d, 3), _OL, [_one(), *map(F.col, _lag_names(3))], F.col("z"), F.pow(F.lit(0.99), "age")), _OL, ["sd"])


@query(_weighted_sql("exp(-0.5 * (age / 26.0) * (age / 26.0))"))
def ar_kernel(spark, d):
    """Order 3, half-Gaussian weights of 26 weeks."""
    return _terms(linear.fitted(_aged(spark, d, 3), _OL, [_one(), *map(F.col, _lag_names(3))], F.col("z"), F.exp(-0.5 * (F.col("age") / 26) * (F.col("age") / 26))), _OL, ["sd"])


@query(f"""WITH RECURSIVE {_AGED}, s AS (SELECT origin, location, {sql_system(['1.0', *_lag_names(3)], 'z', 'pow(0.99, age)', ['pow(0.99, count(*)) / 1e6'] * 4)} FROM r GROUP BY 1, 2), {sql_solve('c', 's', 'origin, location')} {_sql_terms('c', 'origin, location')}""")
def rls_fit(spark, d):
    """Recursive least squares with forgetting 0.99 from a diffuse start of 1e6: its end is that of discounted least squares
    with the start's weight as a penalty."""
    start = F.pow(F.lit(0.99), F.col("n")) / 1e6
    return _terms(linear.fitted(_aged(spark, d, 3), _OL, [_one(), *map(F.col, _lag_names(3))], F.col("z"), F.pow(F.lit(0.99), "age"), [start] * 4), _OL, [])


_WAVES = [(fn, k) for k in (1, 2) for fn in ("sin", "cos")]
_SQL_WAVES = [f"{fn}(2.0 * {k} * pi() * woy / 52.0)" for fn, k in _WAVES]


def _harmonic_sql(penalty: float) -> str:
    xs = ["1.0", "lag1", "lag2", *_SQL_WAVES]
    return f"""WITH RECURSIVE {PANEL}, {ORIGINS}, {sql_lags('l', 2)}, s0 AS (SELECT origin, location, {sql_system(xs, 'z')} FROM l, o WHERE week <= origin GROUP BY 1, 2),
s AS (SELECT * REPLACE (list_transform(range(1, 8), lambda i: list_transform(range(1, 9), lambda j: m[i][j] + CASE WHEN i = j AND i > 3 THEN {penalty} ELSE 0.0 END)) AS m) FROM s0), {sql_solve('c', 's', 'origin, location')},
f AS (SELECT c.*, sqrt({sql_sse('s0')} / greatest(s0.sw - 7, 1)) AS sd FROM c JOIN s0 USING (origin, location)) {_sql_terms('f', 'origin, location', ', round(sd, 5) AS sd')}"""


def _harmonics(spark, d, penalty: float) -> DataFrame:
    rows = features.lags(base.logged(spark, d), "z", 2, ["location"])
    xs = [_one(), F.col("lag1"), F.col("lag2"), *calendar.fourier(F.col("woy"), 2)]
    fits = linear.running(rows, ["location"], "week", xs, F.col("z"), [0.0] * 3 + [penalty] * 4)
    return _terms(_at_origins(spark, d, fits), _OL, ["sd"])


@query(_harmonic_sql(0.0))
def ar_fourier(spark, d):
    """Order 2 with two harmonics of the season, jointly."""
    return _harmonics(spark, d, 0.0)


@query(_harmonic_sql(5.0))
def ar_ridge_harmonics(spark, d):
    """The same with a penalty on the harmonics alone."""
    return _harmonics(spark, d, 5.0)


# autoregression with the season's profile as a regressor


def _climate_rows(spark, d, order: int) -> DataFrame:
    """Every origin's design: lags, and the pooled profile of that origin (from weeks before it) at the row's week."""
    lagged = panel.without_leak(panel.expanding(features.lags(base.logged(spark, d), "z", order, ["location"]), base.origins(spark, d)))
    return features.with_profile(lagged, profiles.seasonal(_history(spark, d), ["origin"]), ["origin"])


_CLIM = f"{SEASONAL}, {sql_lags('l', 6)}, r AS (SELECT l.*, o.origin, s AS clim FROM l, o JOIN sp USING (origin) WHERE l.week <= o.origin AND sp.woy = (l.woy - 1) % 52 + 1)"
_CLIM_X = ["1.0", *_lag_names(6), "clim"]
_CLIM_FIT = f"""{_CLIM}, s AS (SELECT origin, location, {sql_system(_CLIM_X, 'z')}, arg_max([z, lag1, lag2, lag3, lag4, lag5], week) AS tail FROM r GROUP BY 1, 2), {sql_solve('c', 's', 'origin, location')},
f AS (SELECT c.*, tail, {_sd(8)} AS sd FROM c JOIN s USING (origin, location))"""


@query(f"WITH {_CLIM} SELECT origin, location, count(*) AS n, round(sum(z * lag1), 5) AS z_lag1, round(sum(z * clim), 5) + 0.0 AS z_clim, round(sum(clim * clim), 5) AS clim2 FROM r GROUP BY 1, 2")
def ar_climate_design(spark, d):
    """The designs of all origins, as sums."""
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    rows = _climate_rows(spark, d, 6).groupBy(*_OL).agg(F.count(F.lit(1)).alias("n"), total("z", "lag1").alias("z_lag1"), total("z", "clim").alias("z_clim"), total("clim", "clim").alias("clim2"))
    return rounded(rows, "z_lag1", "z_clim", "clim2", digits=5)


@query(f"WITH RECURSIVE {_CLIM_FIT} {_sql_terms('f', 'origin, location', ', round(sd, 5) AS sd')}")
def ar_climate_fit(spark, d):
    return _terms(_climate_fits(spark, d), _OL, ["sd"])


def _climate_fits(spark, d) -> DataFrame:
    rows = _climate_rows(spark, d, 6)
    fits = linear.fitted(rows, _OL, [_one(), *map(F.col, _lag_names(6)), F.col("clim")], F.col("z"))
    tails = rows.groupBy(*_OL).agg(F.max_by(F.array("z", *_lag_names(5)), "week").alias("tail"))
    return fits.join(tails, _OL)


def climate_ahead(spark, d) -> DataFrame:
    """location, origin, horizon, mean, sd_h of AR(6) with climatology: means by recursion, spreads by impulse responses."""
    rows = _climate_fits(spark, d).join(_profile_ahead(spark, d), "origin")
    last = F.get("coef", F.lit(7))
    rows = rows.withColumns({"means": linear.extended(F.slice("coef", 1, 7), F.col("tail"), F.transform("ahead", lambda c: last * c), 4), "spreads": linear.spread(F.col("coef"), 6, 4)})
    out = rows.select(*_OL, "sd", F.posexplode(F.arrays_zip("means", "spreads")).alias("k", "x"))
    return out.select(*_OL, (F.col("k") + 1).alias("horizon"), F.col("x.means").alias("mean"), (F.col("sd") * F.col("x.spreads")).alias("sd_h"))


def _profile_ahead(spark, d) -> DataFrame:
    """origin, ahead: each origin's profile at its horizons."""
    profile = profiles.seasonal(_history(spark, d), ["origin"])
    later = base.origins(spark, d).select("origin", F.explode(F.array(*map(F.lit, HORIZONS))).alias("h"))
    later = later.withColumn("woy", calendar.week_of_season(F.date_add("origin", 7 * F.col("h"))))
    return features.with_profile(later, profile, ["origin"]).groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "clim"))), lambda x: x["clim"]).alias("ahead"))


_AHEAD_LEVELS = "lv(level, q) AS (VALUES " + ", ".join(f"({k}, {q!r}::DOUBLE)" for k, q in NORMAL.items()) + ")"


@query(f"""WITH RECURSIVE {_CLIM_FIT}, fw AS (SELECT origin, h, s AS clim FROM o JOIN sp USING (origin), (SELECT unnest([1, 2, 3, 4]) AS h) hh WHERE sp.woy = ({base.sql_woy('(origin + 7 * h)')} - 1) % 52 + 1),
a AS (SELECT origin, location, coef, sd, 0 AS h, tail, [1.0, 0, 0, 0, 0, 0]::DOUBLE[] AS psi, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS v FROM f
 UNION ALL SELECT a.origin, location, coef, sd, fw.h, list_concat([coef[1] + coef[8] * clim + list_sum(list_transform(range(1, 7), lambda i: coef[i + 1] * tail[i]))], tail[1:5]), list_concat([list_sum(list_transform(range(1, 7), lambda i: coef[i + 1] * psi[i]))], psi[1:5]), coef[1] + coef[8] * clim + list_sum(list_transform(range(1, 7), lambda i: coef[i + 1] * tail[i])), v + psi[1] * psi[1]
 FROM a JOIN fw ON fw.origin = a.origin AND fw.h = a.h + 1), {_AHEAD_LEVELS}
SELECT 'climate_ar6' AS model, location, origin, h::INTEGER AS horizon, origin + 7 * h::INTEGER AS target_week, level, round(greatest(exp(mean + q * sd * sqrt(v)), 0), 5) AS value FROM a, lv WHERE h > 0""")
def ar_climate_quantiles(spark, d):
    """The 23 quantiles of AR(6) with climatology at every origin and horizon, in closed form."""
    return rounded(quantiles.from_normal(climate_ahead(spark, d), "log", "climate_ar6"), "value", digits=5)


_STEP = "coef[1] + list_sum(list_transform(range(1, 7), lambda i: coef[i + 1] * tail[i]))"


@query(f"""WITH RECURSIVE {PANEL}, {ORIGINS}, {sql_lags('l', 6)}, s AS (SELECT origin, location, {sql_system(['1.0', *_lag_names(6)], 'z')}, arg_max([z, lag1, lag2, lag3, lag4, lag5], week) AS tail FROM l, o WHERE week <= origin GROUP BY 1, 2), {sql_solve('c', 's', 'origin, location')},
bk AS (SELECT origin, location, z, week, row_number() OVER (PARTITION BY origin, location ORDER BY week DESC) AS b FROM p, o WHERE week <= origin), sl AS (SELECT origin, location, regr_slope(z, -b) AS slope FROM bk WHERE b <= 9 GROUP BY 1, 2),
f AS (SELECT c.*, tail, slope, {_sd(7)} AS sd FROM c JOIN s USING (origin, location) JOIN sl USING (origin, location)),
a AS (SELECT origin, location, coef, sd, slope, 0 AS h, tail, [1.0, 0, 0, 0, 0, 0]::DOUBLE[] AS psi, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS v FROM f
 UNION ALL SELECT origin, location, coef, sd, slope, h + 1, list_concat([{_STEP} + 0.5 * pow(0.7, h) * slope], tail[1:5]), list_concat([list_sum(list_transform(range(1, 7), lambda i: coef[i + 1] * psi[i]))], psi[1:5]), {_STEP} + 0.5 * pow(0.7, h) * slope, v + psi[1] * psi[1] FROM a WHERE h < 4), {_AHEAD_LEVELS}
SELECT 'momentum' AS model, location, origin, h::INTEGER AS horizon, origin + 7 * h::INTEGER AS target_week, level, round(greatest(exp(mean + q * sd * sqrt(v)), 0), 5) AS value FROM a, lv WHERE h > 0""")
def ar_momentum_quantiles(spark, d):
    """AR(6) with a drift of half the slope of the last nine values, which fades by 0.7 a step: quantiles in closed form."""
    lagged = features.lags(base.logged(spark, d), "z", 6, ["location"])
    slope = F.regr_slope("z", F.col("_i")).over(Window.partitionBy("location").orderBy("week").rowsBetween(-8, 0))
    numbered = base.logged(spark, d).withColumn("_i", F.row_number().over(Window.partitionBy("location").orderBy("week")))
    ends = numbered.withColumn("slope", slope).select("location", "week", "slope")
    fits = linear.running(lagged, ["location"], "week", [_one(), *map(F.col, _lag_names(6))], F.col("z"))
    rows = fits.join(lagged.select("location", "week", F.array("z", *_lag_names(5)).alias("tail")), ["location", "week"]).join(ends, ["location", "week"])
    push = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda h: 0.5 * F.pow(F.lit(0.7), h) * F.col("slope"))
    ahead = panel.latest(rows, base.origins(spark, d), ["location"]).withColumns({"means": linear.extended(F.col("coef"), F.col("tail"), push, 4), "spreads": linear.spread(F.col("coef"), 6, 4)})
    out = ahead.select(*_OL, "sd", F.posexplode(F.arrays_zip("means", "spreads")).alias("k", "x"))
    out = out.select(*_OL, (F.col("k") + 1).alias("horizon"), F.col("x.means").alias("mean"), (F.col("sd") * F.col("x.spreads")).alias("sd_h"))
    return rounded(quantiles.from_normal(out, "log", "momentum"), "value", digits=5)


@query(f"""WITH RECURSIVE {_CLIM_FIT}, rc AS (SELECT r.origin, location, z - clim AS e, row_number() OVER (PARTITION BY r.origin, location ORDER BY week DESC) AS b FROM r), sv AS (SELECT origin, avg(e) AS severity FROM (SELECT origin, location, avg(e) AS e FROM rc WHERE b <= 8 GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3),
fw AS (SELECT origin, h, s + 0.5 * (severity - m) AS clim FROM o JOIN sp USING (origin) JOIN sv USING (origin) JOIN (SELECT origin, avg(z - clim) AS m FROM r GROUP BY 1) USING (origin), (SELECT unnest([1, 2, 3, 4]) AS h) hh WHERE sp.woy = ({base.sql_woy('(origin + 7 * h)')} - 1) % 52 + 1),
a AS (SELECT origin, location, coef, 0 AS h, tail, 0.0::DOUBLE AS mean FROM f
 UNION ALL SELECT a.origin, location, coef, fw.h, list_concat([{_STEP} + coef[8] * clim], tail[1:5]), {_STEP} + coef[8] * clim FROM a JOIN fw ON fw.origin = a.origin AND fw.h = a.h + 1)
SELECT location, origin, h::INTEGER AS horizon, round(exp(mean), 5) AS median FROM a WHERE h > 0""")
def ar_severity_points(spark, d):
    """Medians of AR(6) with climatology, the season ahead moved by half of how far the last eight weeks of all locations lie
    off their usual distance to it."""
    rows = _climate_rows(spark, d, 6)
    back = F.row_number().over(Window.partitionBy(*_OL).orderBy(F.desc("week")))
    own = rows.withColumns({"e": F.col("z") - F.col("clim"), "b": back})
    severity = own.filter("b <= 8").groupBy(*_OL).agg(F.avg("e").alias("e")).groupBy("origin").agg(F.avg("e").alias("severity"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    usual = own.groupBy("origin").agg(F.avg("e").alias("m"))
    used = severity.join(usual, "origin").select("origin", (0.5 * (F.col("severity") - F.col("m"))).alias("used"))
    fits = _climate_fits(spark, d).join(_profile_ahead(spark, d), "origin").join(used, "origin")
    last = F.get("coef", F.lit(7))
    means = linear.extended(F.slice("coef", 1, 7), F.col("tail"), F.transform("ahead", lambda c: last * (c + F.col("used"))), 4)
    out = fits.select(*_OL, F.posexplode(means).alias("k", "mean")).select(*_OL, (F.col("k") + 1).alias("horizon"), F.exp("mean").alias("median"))
    return rounded(out, "median", digits=5)


# other designs


def _order_sql(p: int) -> str:
    return f"""l{p} AS (SELECT * FROM (SELECT location, week, dz, {', '.join(f'lag(dz, {k}) OVER w AS lag{k}' for k in range(1, p + 1))} FROM df WINDOW w AS (PARTITION BY location ORDER BY week)) WHERE lag{p} IS NOT NULL),
s{p} AS (SELECT origin, location, {sql_system(['1.0', *_lag_names(p)], 'dz')} FROM l{p}, o WHERE week <= origin GROUP BY 1, 2), {sql_solve(f'c{p}', f's{p}', 'origin, location')},
a{p} AS (SELECT c{p}.origin, c{p}.location, {p} AS p, coef, n * ln({sql_sse(f's{p}')} / n) + 2 * ({p} + 1) AS aic FROM c{p} JOIN s{p} ON s{p}.origin = c{p}.origin AND s{p}.location = c{p}.location)"""


@query(f"""WITH RECURSIVE {PANEL}, {ORIGINS}, df AS (SELECT * FROM (SELECT location, week, z - lag(z) OVER (PARTITION BY location ORDER BY week) AS dz FROM p) WHERE dz IS NOT NULL), {', '.join(_order_sql(p) for p in (1, 2, 3, 4))},
u AS ({' UNION ALL '.join(f'SELECT * FROM a{p}' for p in (1, 2, 3, 4))}), b AS (SELECT *, row_number() OVER (PARTITION BY origin, location ORDER BY round(aic, 6), p) AS k FROM u)
SELECT origin, location, p::INTEGER AS p, round(aic, 4) AS aic, round(coef[2], 5) + 0.0 AS first FROM b WHERE k = 1""")
def ar_diff_aic(spark, d):
    """Autoregressions of the differences: the order 1 to 4 with the least AIC at each origin."""
    steps = base.logged(spark, d).withColumn("dz", features.difference("z", ["location"])).filter("dz IS NOT NULL")
    fits = []
    for p in (1, 2, 3, 4):
        rows = linear.running(features.lags(steps, "dz", p, ["location"]), ["location"], "week", [_one(), *map(F.col, _lag_names(p))], F.col("dz"))
        fits.append(_at_origins(spark, d, rows).withColumns({"p": F.lit(p), "aic": F.col("n") * F.log(F.col("sse") / F.col("n")) + 2 * (p + 1)}))
    both = reduce(DataFrame.unionByName, fits)
    best = both.groupBy(*_OL).agg(F.min_by(F.struct("p", "aic", F.get("coef", F.lit(1)).alias("first")), F.struct(F.round("aic", 6), F.col("p"))).alias("b")).select(*_OL, "b.*")
    return rounded(rounded(best, "aic", digits=4), "first", digits=5)


def _direct_sql(h: int) -> str:
    return f"""l{h} AS (SELECT * FROM (SELECT location, week, z, lag(z, {h}) OVER w AS a, lag(z, {h + 1}) OVER w AS b FROM p WINDOW w AS (PARTITION BY location ORDER BY week)) WHERE b IS NOT NULL),
s{h} AS (SELECT origin, location, {h} AS horizon, {sql_system(['1.0', 'a', 'b'], 'z')} FROM l{h}, o WHERE week <= origin GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {PANEL}, {ORIGINS}, {', '.join(map(_direct_sql, HORIZONS))}, s AS ({' UNION ALL '.join(f'SELECT * FROM s{h}' for h in HORIZONS)}), {sql_solve('c', 's', 'origin, location, horizon')},
f AS (SELECT c.*, {_sd(3)} AS sd FROM c JOIN s USING (origin, location, horizon)) {_sql_terms('f', 'origin, location, horizon', ', round(sd, 5) AS sd')}""")
def direct_fit(spark, d):
    """A regression of its own for each horizon on the two values known then."""
    fits = []
    for h in HORIZONS:
        w = Window.partitionBy("location").orderBy("week")
        rows = base.logged(spark, d).withColumns({"a": F.lag("z", h).over(w), "b": F.lag("z", h + 1).over(w)}).filter("b IS NOT NULL")
        fits.append(_at_origins(spark, d, linear.running(rows, ["location"], "week", [_one(), F.col("a"), F.col("b")], F.col("z"))).withColumn("horizon", F.lit(h)))
    return _terms(reduce(DataFrame.unionByName, fits), [*_OL, "horizon"], ["sd"])


_RIDGE_X = ["1.0", "a0", "a1", "a2", "a3"]


@query(f"""WITH RECURSIVE {PANEL}, {ORIGINS}, l AS (SELECT * FROM (SELECT location, week, z, {', '.join(f'lag(z, {k + 2}) OVER w AS a{k}' for k in range(4))} FROM p WINDOW w AS (PARTITION BY location ORDER BY week)) WHERE a3 IS NOT NULL),
s AS (SELECT origin, location, {sql_system(_RIDGE_X, 'z', '1.0', ['0.0', *[f'5.0 * CASE WHEN stddev_samp({x}) < 1e-8 THEN 1.0 ELSE var_samp({x}) END' for x in _RIDGE_X[1:]]])} FROM l, o WHERE week <= origin GROUP BY 1, 2), {sql_solve('c', 's', 'origin, location')} {_sql_terms('c', 'origin, location')}""")
def ridge_direct(spark, d):
    """Two steps ahead on four values: ridge on columns scaled to sd 1, the constant free. On the natural scale a column's
    penalty is its variance times the ridge's."""
    w = Window.partitionBy("location").orderBy("week")
    names = _RIDGE_X[1:]
    rows = base.logged(spark, d).withColumns({n: F.lag("z", k + 2).over(w) for k, n in enumerate(names)}).filter("a3 IS NOT NULL")
    fits = linear.running(rows, ["location"], "week", [_one(), *map(F.col, names)], F.col("z"), linear.standardised(5, 5.0))
    return _terms(_at_origins(spark, d, fits), _OL, [])


_PLACES = ["A", "N", "R"]
_VAR_X = ["1.0", *[f"{x}{k}" for k in (1, 2) for x in _PLACES]]


def _var_sql(cross_only: bool) -> str:
    wide = ", ".join(f"max(CASE WHEN location = '{x}' THEN z END) AS {x}0" for x in _PLACES)
    lags = ", ".join(f"lag({x}0, {k}) OVER (ORDER BY week) AS {x}{k}" for k in (1, 2) for x in _PLACES)
    system = lambda x: sql_system(_VAR_X, f"{x}0", "1.0", ["0.0", *["0.0" if cross_only and n[0] == x else "10.0" for n in _VAR_X[1:]]])
    return f"""WITH RECURSIVE {PANEL}, {ORIGINS}, wd AS (SELECT week, {wide} FROM p GROUP BY 1), l AS (SELECT * FROM (SELECT *, {lags} FROM wd WHERE {' AND '.join(f'{x}0 IS NOT NULL' for x in _PLACES)}) WHERE A2 IS NOT NULL),
s AS ({' UNION ALL '.join(f"SELECT origin, '{x}' AS location, {system(x)} FROM l, o WHERE week <= origin GROUP BY 1" for x in _PLACES)}), {sql_solve('c', 's', 'origin, location')} {_sql_terms('c', 'origin, location')}"""


def _ridge_var(spark, d, cross_only: bool) -> DataFrame:
    wide = features.wide(base.logged(spark, d), "z", _PLACES)
    w = Window.orderBy("week")  # a row per week
    rows = wide.withColumns({f"{x}{k}": F.lag(x, k).over(w) for k in (1, 2) for x in _PLACES}).filter("A2 IS NOT NULL")
    fits = []
    for x in _PLACES:
        penalties = [0.0, *[0.0 if cross_only and n[0] == x else 10.0 for n in _VAR_X[1:]]]
        fits.append(linear.running(rows, [], "week", [_one(), *map(F.col, _VAR_X[1:])], F.col(x), penalties).withColumn("location", F.lit(x)))
    return _terms(_at_origins(spark, d, reduce(DataFrame.unionByName, fits)), _OL, [])


@query(_var_sql(True))
def ridge_var(spark, d):
    """Vector autoregression of order 2; only the other locations' lags are penalised."""
    return _ridge_var(spark, d, True)


@query(_var_sql(False))
def ridge_var_all(spark, d):
    """The same with a penalty on every lag."""
    return _ridge_var(spark, d, False)


# season's level, harmonics, smoothers


@query(f"WITH {SEASONAL} SELECT h.origin, location, round(regr_intercept(z, s), 5) + 0.0 AS alpha, round(regr_slope(z, s), 5) + 0.0 AS beta FROM h JOIN sp ON sp.origin = h.origin AND sp.woy = h.w GROUP BY 1, 2")
def seasonal_level(spark, d):
    """alpha + beta * profile for each location and origin."""
    h = _history(spark, d)
    rows = features.with_profile(h, profiles.seasonal(h, ["origin"]), ["origin"])
    return rounded(rows.groupBy(*_OL).agg(F.regr_intercept("z", "clim").alias("alpha"), F.regr_slope("z", "clim").alias("beta")), "alpha", "beta", digits=5)


@query(f"""WITH RECURSIVE {HIST}, dm AS (SELECT origin, woy, z - avg(z) OVER (PARTITION BY origin, location) AS dd FROM h), s AS (SELECT origin, {sql_system(_SQL_WAVES, 'dd')} FROM dm GROUP BY 1), {sql_solve('c', 's', 'origin')} {_sql_terms('c', 'origin')}""")
def fourier_shape2(spark, d):
    """Two harmonics, without a constant, of all locations' deviations."""
    rows = _history(spark, d).withColumn("dd", F.col("z") - F.avg("z").over(Window.partitionBy("origin", "location")))
    return _terms(linear.fitted(rows, ["origin"], calendar.fourier(F.col("woy"), 2), F.col("dd")), ["origin"], [])


_CYCLE = "list_transform(range(52), lambda i: list_concat(list_transform(range(52), lambda j: (CASE WHEN i = j THEN 1.0 ELSE 0.0 END) + 10.0 * (CASE least((i - j + 52) % 52, (j - i + 52) % 52) WHEN 0 THEN 6.0 WHEN 1 THEN -4.0 WHEN 2 THEN 1.0 ELSE 0.0 END)), [raw[i + 1]]))"


@query(f"""WITH RECURSIVE {PANEL}, b AS (SELECT location, ((woy - 1) % 52 + 1)::INTEGER AS w, avg(z) AS v FROM p GROUP BY 1, 2), a AS (SELECT location, avg(z) AS m FROM p GROUP BY 1),
g AS (SELECT location, list(coalesce(v, m) ORDER BY w) AS raw FROM (SELECT location, w, m FROM a, (SELECT unnest(range(1, 53))::INTEGER AS w)) LEFT JOIN b USING (location, w) GROUP BY 1), s AS (SELECT location, {_CYCLE} AS m FROM g), {sql_solve('c', 's', 'location')}
SELECT location, unnest(range(1, 53))::INTEGER AS woy, round(unnest(coef), 5) + 0.0 AS c FROM c""")
def whittaker(spark, d):
    """Weekly means smoothed on the circle: one banded system a location."""
    return rounded(profiles.whittaker(base.logged(spark, d), ["location"], 10.0), "c", digits=5)


@query(f"""WITH RECURSIVE {PANEL}, x AS (SELECT *, z - avg(z) OVER (PARTITION BY location) AS dd FROM p), y AS (SELECT location, k AS lag, dd, lag(dd, k) OVER (PARTITION BY location, k ORDER BY week) AS ld FROM x, (SELECT unnest(range(1, 9))::INTEGER AS k)),
r AS (SELECT location, list(v ORDER BY lag) AS r FROM (SELECT location, lag, sum(dd * ld) / sum(dd * dd) AS v FROM y GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT location, n, list_transform(range(1, n + 1), lambda i: list_concat(list_transform(range(1, n + 1), lambda j: CASE WHEN i = j THEN 1.0 ELSE r[abs(i - j)] END), [r[i]])) AS m FROM r, (SELECT unnest(range(1, 9))::INTEGER AS n)), {sql_solve('c', 's', 'location, n')}
SELECT location, n AS lag, round(coef[n], 5) + 0.0 AS pacf FROM c""")
def partial_acf(spark, d):
    """The last coefficients of the Yule-Walker systems of order 1 to 8."""
    acf = diagnostics.autocorrelation(base.logged(spark, d), ["location"], "z", 8)
    return rounded(diagnostics.partial_autocorrelation(acf, ["location"], 8), "pacf", digits=5)


@query(f"""WITH RECURSIVE {PANEL}, x AS (SELECT *, z - avg(z) OVER (PARTITION BY location) AS dd FROM p), y AS (SELECT location, k AS lag, dd, lag(dd, k) OVER (PARTITION BY location, k ORDER BY week) AS ld FROM x, (SELECT unnest(range(1, 9))::INTEGER AS k)),
r AS (SELECT location, list(v ORDER BY lag) AS r FROM (SELECT location, lag, sum(dd * ld) / sum(dd * dd) AS v FROM y GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT location, list_transform(range(1, 9), lambda i: list_concat(list_transform(range(1, 9), lambda j: CASE WHEN i = j THEN 1.0 ELSE r[abs(i - j)] END), [r[i]])) AS m FROM r), {sql_solve('c', 's', 'location')}
SELECT location, unnest(range(1, 9))::INTEGER AS lag, round(unnest(coef), 5) + 0.0 AS phi FROM c""")
def pacf_to_ar(spark, d):
    """Coefficients of order 8 stepped up from the partial autocorrelations; the SQL solves the Yule-Walker system."""
    acf = diagnostics.autocorrelation(base.logged(spark, d), ["location"], "z", 8)
    pacf = diagnostics.partial_autocorrelation(acf, ["location"], 8)
    rows = pacf.groupBy("location").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "pacf"))), lambda x: x["pacf"]).alias("p"))
    out = rows.select("location", F.posexplode(diagnostics.coefficients_of(F.col("p"))).alias("k", "phi"))
    return rounded(out.select("location", (F.col("k") + 1).alias("lag"), "phi"), "phi", digits=5)


@query(f"""WITH {PANEL}, cr AS (SELECT x.location AS a, y.location AS b, 1 - corr(x.z, y.z) AS d FROM p x JOIN p y ON x.week = y.week AND x.location < y.location GROUP BY 1, 2), j AS (SELECT arg_min({{'a': a, 'b': b}}, (d, a, b)) AS j FROM cr),
g AS (SELECT location, location IN (j.a, j.b) AS up FROM (SELECT DISTINCT location FROM p), j), k AS (SELECT location, dense_rank() OVER (ORDER BY f)::INTEGER AS cluster FROM (SELECT location, min(location) OVER (PARTITION BY up) AS f FROM g)),
h AS (SELECT cluster, location, ((woy - 1) % 52 + 1)::INTEGER AS w, z - avg(z) OVER (PARTITION BY cluster, location) AS dd FROM p JOIN k USING (location)), bn AS (SELECT cluster, w, CASE WHEN count(*) >= 3 THEN avg(dd) ELSE 0.0 END AS s FROM h GROUP BY 1, 2),
fu AS (SELECT cluster, q.w, coalesce(s, 0.0) AS s FROM (SELECT DISTINCT cluster FROM h) CROSS JOIN (SELECT unnest(range(1, 53))::INTEGER AS w) q LEFT JOIN bn USING (cluster, w)), sm AS (SELECT cluster, ((fu.w - 1 + x.k + 52) % 52 + 1)::INTEGER AS woy, avg(s) AS s FROM fu, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) x GROUP BY 1, 2)
SELECT cluster, woy, round(s - avg(s) OVER (PARTITION BY cluster), 6) + 0.0 AS s FROM sm""")
def cluster_profiles(spark, d):
    """Profiles of two clusters of locations by the correlation of their series. The SQL knows three locations."""
    groups = diagnostics.clusters(base.logged(spark, d), "z", 2)
    rows = base.logged(spark, d).join(groups, "location")
    return rounded(profiles.seasonal(rows, ["cluster"]), "s")


# blends


@query(f"""WITH {PANEL}, {ORIGINS}, {base.AR1}, pl AS (SELECT origin, regr_slope(z, lag1) AS ps, regr_intercept(z, lag1) AS pi FROM lagged, o WHERE week <= origin GROUP BY 1),
b AS (SELECT origin, location, 0.4 * slope + 0.6 * ps AS slope, 0.4 * intercept + 0.6 * pi AS intercept FROM fit1 JOIN pl USING (origin))
SELECT b.origin, b.location, round(any_value(slope), 6) AS slope, round(sqrt(sum((z - intercept - slope * lag1) * (z - intercept - slope * lag1)) / greatest(count(*) - 2, 1)), 6) AS sd FROM b JOIN lagged ON lagged.location = b.location AND week <= origin GROUP BY 1, 2""")
def ar1_blend_sd(spark, d):
    """Coefficients blended with the pooled ones, and the residual deviation under the blend, from the sums of the fits."""
    lagged = features.lags(base.logged(spark, d), "z", 1, ["location"])
    xs = [_one(), F.col("lag1")]
    rows = panel.expanding(lagged, base.origins(spark, d))
    own = linear.fitted(rows, _OL, xs, F.col("z"), gram=True)
    pooled = linear.fitted(rows, ["origin"], xs, F.col("z")).select("origin", F.col("coef").alias("p"))
    mixed = own.join(pooled, "origin").withColumn("coef", F.zip_with("coef", "p", lambda a, b: 0.4 * a + 0.6 * b))
    out = mixed.withColumn("sd", F.sqrt(linear.residual(F.col("coef"), F.col("m"), F.col("r"), 2) / F.greatest(F.col("n") - 2, F.lit(1))))
    return rounded(out.select(*_OL, F.get("coef", F.lit(1)).alias("slope"), "sd"), "slope", "sd")


