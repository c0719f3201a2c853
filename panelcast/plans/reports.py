"""Queries of features, checks, smoothers, ensembles and selection that build on the tables of base.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import calendar, distributions, transforms
from panelcast.functions.distributions import LEVELS, NORMAL
from panelcast.operators import diagnostics, features, fit, panel, profiles, quantiles, scoring, selection, simulate, vintage
from panelcast.plans import base
from panelcast.plans.base import AR1, FORECASTS, HORIZONS, ORIGINS, PANEL, SCORES, TRIANGLE
from panelcast.plans.queries import _COMP, _GRID, HIST, SEASONAL, SERIES, WIDTH, _history, query, rounded
from panelcast.sources import validation
from panelcast.sources.files import read_table
from panelcast.streaming import revisions

_OL = ["origin", "location"]

# labels, distances, distributions


@query(f"WITH {PANEL}, {ORIGINS} SELECT DISTINCT origin, CASE WHEN woy <= 9 THEN 'early' WHEN woy <= 17 THEN 'rise' WHEN woy <= 26 THEN 'peak' ELSE 'decline' END AS phase, least(abs(woy - 20), 52 - abs(woy - 20))::INTEGER AS from_peak FROM p JOIN o ON week = origin")
def origin_phases(spark, d):
    """Each origin's phase of the season, and how far it is from week 20 on the circle."""
    woy = calendar.week_of_season(F.col("origin"))
    return base.origins(spark, d).select("origin", calendar.phase_label(woy, {9: "early", 17: "rise", 26: "peak"}, "decline").alias("phase"), calendar.circular_distance(woy, F.lit(20)).alias("from_peak"))


@query("SELECT replace(o_orderpriority, '-', ' ') AS label, replace(o_orderpriority, 'NOT SPECIFIED', 'n/a') AS short, count(*) AS n FROM orders GROUP BY 1, 2")
def short_labels(spark, d):
    name = F.col("o_orderpriority")
    return read_table(spark, d, "orders").groupBy(F.replace(name, F.lit("-"), F.lit(" ")).alias("label"), F.replace(name, F.lit("NOT SPECIFIED"), F.lit("n/a")).alias("short")).agg(F.count(F.lit(1)).alias("n"))


_CDF = "0.5 + 0.5 * sin(atan(x / sqrt(10.0))) * (1 + 0.5 * c + 0.375 * c * c + 0.3125 * c * c * c + 0.2734375 * c * c * c * c)"


@query(f"""WITH RECURSIVE lv AS (SELECT unnest({LEVELS}) AS level), b AS (SELECT level, -50.0::DOUBLE AS lo, 50.0::DOUBLE AS hi, 0 AS k FROM lv
 UNION ALL SELECT level, CASE WHEN up THEN lo ELSE x END, CASE WHEN up THEN x ELSE hi END, k + 1 FROM (SELECT *, {_CDF} > level / 1000.0 AS up FROM (SELECT *, pow(cos(atan(x / sqrt(10.0))), 2) AS c FROM (SELECT *, (lo + hi) / 2 AS x FROM b WHERE k < 60))))
SELECT level, round(lo, 5) + 0.0 AS t FROM b WHERE k = 60""")
def student_quantiles(spark, d):
    """Quantiles of Student's t with 10 degrees of freedom at the levels. The SQL has the closed form for even degrees."""
    return rounded(spark.createDataFrame(sorted(distributions.student(10).items()), "level int, t double"), "t", digits=5)


@query(f"WITH {PANEL}, s AS (SELECT location, (z - avg(z) OVER w) / stddev_samp(z) OVER w AS s FROM p WINDOW w AS (PARTITION BY location)), q AS (SELECT location, unnest({list(NORMAL)}) AS level, unnest(quantile_cont(s, {[k / 1000 for k in NORMAL]})) AS sample, unnest({list(NORMAL.values())}) AS theory FROM s GROUP BY 1) SELECT location, level, round(sample, 6) + 0.0 AS sample, round(theory::DOUBLE, 6) + 0.0 AS theory FROM q")
def qq_points(spark, d):
    return rounded(diagnostics.qq_points(base.logged(spark, d), ["location"], "z", NORMAL), "sample", "theory")


# panels and sequences


@query(f"WITH {PANEL}, {ORIGINS}, s AS (SELECT origin, split, (CASE WHEN month(origin) >= 10 THEN year(origin) ELSE year(origin) - 1 END)::INTEGER AS season_year FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY season_year ORDER BY origin)::INTEGER AS place FROM s) SELECT * FROM r WHERE place <= 4")
def first_splits(spark, d):
    """The first four origins of each season."""
    return panel.first_splits(base.origins(spark, d), 4)


@query(f"WITH {PANEL}, r AS (SELECT location, week, row_number() OVER (PARTITION BY location ORDER BY md5(location || '|' || CAST(week AS VARCHAR)), location, week) AS k FROM p) SELECT location, week FROM r WHERE k <= 25")
def subsample(spark, d):
    """25 weeks of each location, without replacement: a sampling operator."""
    return panel.subsample(base.weekly(spark, d).select("location", "week"), ["location"], ["location", "week"], 25)


@query(f"WITH {PANEL}, {ORIGINS}, e AS (SELECT origin, location, season_year, y, max(season_year) OVER (PARTITION BY origin, location) AS last FROM p, o WHERE week <= origin) SELECT origin, location, any_value(season_year) AS season_year, count(*) AS n, round(max(y), 6) AS peak FROM e WHERE season_year = last GROUP BY 1, 2")
def current_season(spark, d):
    """The running season at every origin, from a history that is checked for leaks."""
    history = panel.without_leak(panel.expanding(base.weekly(spark, d), base.origins(spark, d)))
    rows = panel.current_season(history, _OL)
    return rounded(rows.groupBy(*_OL).agg(F.first("season_year").alias("season_year"), F.count(F.lit(1)).alias("n"), F.max("y").alias("peak")), "peak")


@query(f"""WITH RECURSIVE {PANEL}, df AS (SELECT location, week, coalesce(z - lag(z) OVER w, z) AS e, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY location ORDER BY week)),
a AS (SELECT location, week, i, e AS x FROM df WHERE i = 1 UNION ALL SELECT a.location, df.week, df.i, 0.7 * x + e FROM a JOIN df ON df.location = a.location AND df.i = a.i + 1)
SELECT location, week, round(sum(e) OVER (PARTITION BY location ORDER BY week), 6) + 0.0 AS total, round(x, 6) + 0.0 AS ar FROM df JOIN a USING (location, week)""")
def accumulate(spark, d):
    """Steps summed up again, and accumulated with a coefficient of 0.7."""
    steps = base.logged(spark, d).withColumn("e", F.coalesce(features.difference("z", ["location"]), "z"))
    total = features.accumulated(steps, "e", ["location"])
    ar = features.accumulated(steps, "e", ["location"], 0.7).withColumnRenamed("total", "ar")
    return rounded(total.join(ar, ["location", "week"]), "total", "ar")


@query(f"""WITH RECURSIVE {PANEL}, df AS (SELECT location, week, coalesce(z - lag(z) OVER w, z) AS e, 0.6 + 0.3 * sin(t / 10.0) AS phi, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY location ORDER BY week)),
a AS (SELECT location, week, i, e AS x FROM df WHERE i = 1 UNION ALL SELECT a.location, df.week, df.i, phi * x + e FROM a JOIN df ON df.location = a.location AND df.i = a.i + 1) SELECT location, week, round(x, 6) + 0.0 AS x FROM a""")
def time_varying_ar(spark, d):
    """Steps accumulated with a coefficient that varies in time."""
    steps = base.logged(spark, d).withColumn("e", F.coalesce(features.difference("z", ["location"]), "z"))
    return rounded(features.accumulated(steps, "e", ["location"], 0.6 + 0.3 * F.sin(F.col("t") / 10)).withColumnRenamed("total", "x"), "x")


_FEATURES = ["now0", "now1", "now2", "now3", "trend", "clim", "amplitude", "natural", "sin", "cos", "target"]


@query(f"""WITH {SEASONAL}, lst AS (SELECT max(origin) AS origin FROM o), pr AS (SELECT woy, s FROM sp JOIN lst USING (origin)),
x AS (SELECT location, week, woy, y, z, {', '.join(f'lag(z, {k}) OVER w AS now{k}' for k in range(4))}, (z - lag(z, 3) OVER w) / 3 AS trend, max(z) OVER (PARTITION BY location, season_year ORDER BY week) - quantile_cont(z, 0.5) OVER (PARTITION BY location ORDER BY week ROWS UNBOUNDED PRECEDING) AS amplitude, lead(z, 2) OVER w AS target FROM p WINDOW w AS (PARTITION BY location ORDER BY week))
SELECT location, week, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('now0', 'now1', 'now2', 'now3', 'trend', 'amplitude', 'target'))}, round(s, 6) + 0.0 AS clim, round(y, 6) AS "natural", round(sin(2 * pi() * x.woy / 52.0), 6) + 0.0 AS sin, round(cos(2 * pi() * x.woy / 52.0), 6) + 0.0 AS cos
FROM x JOIN pr ON pr.woy = ({base.sql_woy('(week + 14)')} - 1) % 52 + 1 WHERE now3 IS NOT NULL""")
def feature_rows(spark, d):
    """The features known at each week for a target two weeks ahead, with the last origin's profile."""
    h = _history(spark, d)
    last = base.origins(spark, d).agg(F.max("origin").alias("origin"))
    profile = profiles.seasonal(h, ["origin"]).join(last, "origin").select("woy", "s")
    return rounded(features.feature_rows(base.logged(spark, d), profile, 2), *_FEATURES)


# vintages


@query(f"WITH {TRIANGLE}, t AS (SELECT *, count(*) OVER w AS versions, arg_max(value, as_of) OVER w AS settled, max(as_of) OVER w AS sa FROM ver WINDOW w AS (PARTITION BY location, day)) SELECT location, day, (as_of - day)::INTEGER AS delay, versions, round(value / settled, 6) AS completeness FROM t WHERE versions > 1 AND settled > 0.05 AND as_of < sa AND as_of - day <= 20")
def revised_series(spark, d):
    """Versions, before the settled one and at most 20 days late, of days that have several."""
    rows = vintage.settled(vintage.revised(base.versions(spark, d))).withColumn("delay", F.datediff("as_of", "day"))
    rows = rows.filter((F.col("settled") > 0.05) & (F.col("as_of") < F.col("settled_as_of")) & (F.col("delay") <= 20))
    return rounded(rows.select("location", "day", "delay", "versions", (F.col("value") / F.col("settled")).alias("completeness")), "completeness")


_DAYS = f"""{TRIANGLE}, od AS (SELECT DISTINCT day AS origin FROM ver), kn AS (SELECT location, origin, day, arg_max(value, as_of) AS value FROM ver, od WHERE as_of <= origin GROUP BY 1, 2, 3)"""
_POINTS = f"""{_DAYS}, st AS (SELECT *, ln(greatest(value, 1e-4)) AS z FROM kn), sg AS (SELECT *, z - lag(z) OVER (PARTITION BY location, origin ORDER BY day) AS e FROM st),
rw AS (SELECT location, origin, arg_max(z, day) AS point, sqrt(avg(e * e)) AS sd FROM sg GROUP BY 1, 2 HAVING count(e) >= 2),
pt AS (SELECT location, origin, h AS horizon, origin + h::INTEGER AS target, point, sd FROM rw, (SELECT unnest([1, 2, 3, 4]) AS h)),
mt AS (SELECT pt.location, pt.origin, horizon, point, min(kn.origin) AS mature, arg_min(value, kn.origin) AS actual FROM pt JOIN kn ON kn.location = pt.location AND kn.day = pt.target AND kn.origin >= pt.target GROUP BY ALL),
pool AS (SELECT od.origin, horizon, ln(greatest(actual, 1e-4)) - point AS error FROM mt JOIN od ON od.origin >= mature)"""


def _vintage_points(spark, d) -> tuple[DataFrame, DataFrame]:
    """(known values by origin, random-walk points with their sd): each origin sees the versions of its day only."""
    v = base.versions(spark, d)
    days = v.select(F.col("day").alias("origin")).distinct()
    known = vintage.known_at(v, days)
    walk = vintage.walk(known.withColumn("z", transforms.to_scale(F.col("value"), "log")), least=2)
    rows = walk.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS)))).withColumn("target_week", F.date_add("origin", F.col("horizon")))
    return known.withColumnRenamed("day", "target_week"), rows


@query(f"WITH {_POINTS} SELECT origin, horizon, count(*) AS n, round(avg(error), 6) + 0.0 AS mean, round(quantile_cont(error, 0.9), 6) + 0.0 AS q90 FROM pool GROUP BY 1, 2")
def vintage_conformal_pool(spark, d):
    """Errors frozen at the first origin that knows a version of the target: later revisions don't change them."""
    known, points = _vintage_points(spark, d)
    pool = quantiles.conformal_pool(points, known, "log")
    return rounded(pool.groupBy("origin", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean"), F.percentile("error", F.lit(0.9)).alias("q90")), "mean", "q90")


_T10 = distributions.student(10)
_TV = "tv(level, t) AS (VALUES " + ", ".join(f"({k}, {t!r}::DOUBLE)" for k, t in _T10.items()) + ")"


@query(f"""WITH {_POINTS}, {_TV}, pn AS (SELECT origin, horizon, count(*) AS n FROM pool GROUP BY 1, 2), pq AS (SELECT origin, horizon, unnest({LEVELS}) AS level, unnest(quantile_cont(error, {[k / 1000 for k in LEVELS]})) AS e FROM pool GROUP BY 1, 2)
SELECT pt.location, pt.origin, pt.horizon, pt.target AS target_week, tv.level, round(greatest(exp(point + CASE WHEN n >= 10 THEN e ELSE sd * sqrt(0.8) * 1.4 * t END), 0), 6) AS value, coalesce(n, 0) >= 10 AS calibrated
FROM pt CROSS JOIN tv LEFT JOIN pn ON pn.origin = pt.origin AND pn.horizon = pt.horizon LEFT JOIN pq ON pq.origin = pt.origin AND pq.horizon = pt.horizon AND pq.level = tv.level""")
def vintage_conformal(spark, d):
    """Split-conformal quantiles on the versions known at each origin; before the pool has 10 errors, Student's t with 10
    degrees of freedom, matched in variance and 1.4 times as wide."""
    known, points = _vintage_points(spark, d)
    fallback = quantiles.student(points, 10, 1.4)
    return rounded(quantiles.conformal(points.drop("sd"), quantiles.conformal_pool(points, known, "log"), fallback, "log"), "value")


# random walks, smoothers: fits and closed-form quantiles


_ETS = f"""ag AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY week DESC) AS b, lag(z) OVER (PARTITION BY location ORDER BY week) AS l FROM p),
rw AS (SELECT location, arg_max(z, week) AS anchor, sqrt(avg((z - l) * (z - l))) AS sd FROM ag WHERE l IS NOT NULL GROUP BY 1),
dw AS (SELECT location, arg_max(z, week) AS anchor, sqrt(avg((z - 0.9 * l) * (z - 0.9 * l))) AS sd FROM ag WHERE l IS NOT NULL GROUP BY 1),
lt AS (SELECT * FROM ag WHERE b <= 8), ts AS (SELECT x.location, quantile_cont((y.z - x.z) / (x.b - y.b), 0.5) AS slope FROM lt x JOIN lt y ON x.location = y.location AND y.b < x.b GROUP BY 1),
ll AS (SELECT lt.location, arg_max(z, week) AS anchor, any_value(slope) AS slope, sqrt(avg(CASE WHEN b < 8 THEN (z - l - slope) * (z - l - slope) END)) AS sd FROM lt JOIN ts USING (location) GROUP BY 1)"""


@query(f"WITH {PANEL}, {_ETS} SELECT 'rw' AS model, location, round(anchor, 6) AS anchor, 0.0::DOUBLE AS slope, round(sd, 6) AS sd FROM rw UNION ALL SELECT 'damped', location, round(anchor, 6), 0.0, round(sd, 6) FROM dw UNION ALL SELECT 'local_linear', location, round(anchor, 6), round(slope, 6) + 0.0, round(sd, 6) FROM ll")
def walk_fits(spark, d):
    """Driftless and damped random walks and a robust local line."""
    return rounded(_walk_fits(spark, d).select("model", "location", "anchor", "slope", "sd"), "anchor", "slope", "sd")


def _walk_fits(spark, d) -> DataFrame:
    rows = base.logged(spark, d)
    fits = [(fit.damped_walk(rows, ["location"], 1.0), "rw"), (fit.damped_walk(rows, ["location"], 0.9), "damped"), (fit.local_line(rows, ["location"], 8), "local_linear")]
    return reduce(DataFrame.unionByName, [f.withColumn("model", F.lit(name)) for f, name in fits])


@query(f"""WITH {PANEL}, {_ETS}, u AS (SELECT 'rw' AS model, location, anchor, 0.0 AS slope, 1.0 AS phi, sd FROM rw UNION ALL SELECT 'damped', location, anchor, 0.0, 0.9, sd FROM dw UNION ALL SELECT 'local_linear', location, anchor, slope, 1.0, sd FROM ll),
lv(level, q) AS (VALUES {', '.join(f'({k}, {q!r}::DOUBLE)' for k, q in NORMAL.items())}), lw AS (SELECT location, max(week) AS origin FROM p GROUP BY 1)
SELECT model, location, origin, h::INTEGER AS horizon, origin + 7 * h::INTEGER AS target_week, level, round(greatest(exp(pow(phi, h) * anchor + slope * h + q * sd * sqrt(list_sum(list_transform(range(h), lambda i: pow(phi, 2 * i))))), 0), 6) AS value FROM u JOIN lw USING (location), lv, (SELECT unnest([1, 2, 3, 4]) AS h)""")
def walk_quantiles(spark, d):
    """Their quantiles, in closed form."""
    ends = base.weekly(spark, d).groupBy("location").agg(F.max("week").alias("origin"))
    ahead = simulate.walk_ahead(_walk_fits(spark, d).join(ends, "location"), HORIZONS)
    return rounded(reduce(DataFrame.unionByName, [quantiles.from_normal(ahead.filter(F.col("model") == m), "log", m) for m in ("rw", "damped", "local_linear")]), "value")


@query(f"""WITH RECURSIVE {SERIES}, mu AS (SELECT location, avg(z) AS mu FROM p GROUP BY 1), g AS (SELECT a.v / 10.0 AS alpha, b.v / 10.0 AS phi FROM (VALUES (2), (5), (8)) a(v), (VALUES (7), (9), (10)) b(v)),
f AS (SELECT location, mu, alpha, phi, 1::BIGINT AS i, z AS level, 0.0::DOUBLE AS sse FROM sr JOIN mu USING (location), g WHERE i = 1
UNION ALL SELECT f.location, mu, alpha, phi, sr.i, mu + phi * (level - mu) + alpha * (z - mu - phi * (level - mu)), sse + pow(z - mu - phi * (level - mu), 2) FROM f JOIN sr ON sr.location = f.location AND sr.i = f.i + 1),
e AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY round(sse, 9), alpha, phi) AS k FROM f WHERE i = (SELECT max(i) FROM sr s WHERE s.location = f.location))
SELECT location, alpha::DOUBLE AS alpha, phi::DOUBLE AS phi, round(level, 6) AS level, round(sse, 6) AS sse FROM e WHERE k = 1""")
def damped_level(spark, d):
    """A local level that goes back to the mean, the best of a grid."""
    grid = [(a / 10, b / 10) for a in (2, 5, 8) for b in (7, 9, 10)]
    fits = fit.damped_level(fit.in_order(base.logged(spark, d), ["location"]), grid)
    return rounded(fit.best(fits, ["location"], ["alpha", "phi"], ["level"]), "level", "sse")


@query(f"WITH {PANEL}, {ORIGINS}, {AR1} SELECT origin, location, h::INTEGER AS horizon, round(exp(intercept * list_sum(list_transform(range(h), lambda i: pow(slope, i))) + pow(slope, h) * last), 6) AS point FROM fit1, (SELECT unnest([1, 2, 3, 4]) AS h)")
def point_paths(spark, d):
    """Autoregressions without noise."""
    fits = fit.ar1(panel.expanding(features.lags(base.logged(spark, d), "z", 1, ["location"]), base.origins(spark, d)), _OL)
    rows = fits.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    return rounded(rows.select(*_OL, "horizon", F.exp(simulate.point_path(F.col("last"), F.col("slope"), F.col("intercept"), F.col("horizon"))).alias("point")), "point")


@query(f"""WITH {PANEL}, {ORIGINS}, {AR1}, x AS (SELECT origin, location, h, intercept * list_sum(list_transform(range(h), lambda i: pow(slope, i))) + pow(slope, h) * last AS point FROM fit1, (SELECT unnest([1, 2, 3, 4]) AS h)),
s AS (SELECT location, week, z - lag(z) OVER (PARTITION BY location ORDER BY week) AS s FROM p), dr AS (SELECT origin, location, avg(s) AS drift FROM s, o WHERE week <= origin GROUP BY 1, 2)
SELECT x.origin, x.location, h::INTEGER AS horizon, round((1 - 0.5 * (h - 1) / 3.0) * point + 0.5 * (h - 1) / 3.0 * (last + drift * list_sum(list_transform(range(1, h + 1), lambda i: pow(0.8, i)))), 6) + 0.0 AS point FROM x JOIN dr USING (origin, location) JOIN fit1 USING (origin, location)""")
def damped_blend(spark, d):
    """Points blended with a damped trend, with a weight that grows with the horizon up to a half."""
    rows = panel.expanding(features.lags(base.logged(spark, d), "z", 1, ["location"]), base.origins(spark, d))
    drift = panel.expanding(base.logged(spark, d).withColumn("s", features.difference("z", ["location"])), base.origins(spark, d)).groupBy(*_OL).agg(F.avg("s").alias("drift"))
    fits = fit.ar1(rows, _OL).join(drift, _OL).withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    point = simulate.point_path(F.col("last"), F.col("slope"), F.col("intercept"), F.col("horizon"))
    return rounded(fits.select(*_OL, "horizon", simulate.damped_blend(point, F.col("last"), F.col("drift"), F.col("horizon"), 4, 0.8, 0.5).alias("point")), "point")


# climatology with fall-back, blended and robust profiles


@query(f"""WITH {PANEL}, {ORIGINS}, tg AS (SELECT origin, location, h AS horizon, origin + 7 * h::INTEGER AS target_week FROM o, (SELECT DISTINCT location FROM p), (SELECT unnest([1, 2, 3, 4]) AS h)),
hb AS (SELECT tg.*, p.y, abs((((p.woy - 1) % 52) - (({base.sql_woy('target_week')} - 1) % 52) + 52 + 1) % 52 - 1) <= 1 AS near FROM tg JOIN p USING (location) WHERE p.week < origin), c AS (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY origin, location, horizon) AS n FROM hb)
SELECT origin, location, horizon::INTEGER AS horizon, any_value(n) >= 12 AS banded, round(quantile_cont(y, 0.5), 6) AS median, count(*) AS n FROM c WHERE near OR n < 12 GROUP BY 1, 2, 3""")
def band_fallback(spark, d):
    """Climatology medians of a band of a week on each side; of the whole history where the band has under 12 rows."""
    rows = quantiles.band_or_all(base.weekly(spark, d), base.targets(spark, d), 12, band=1)
    return rounded(rows.groupBy("origin", "location", "horizon").agg(F.first("banded").alias("banded"), F.percentile("y", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n")), "median")


@query(f"""WITH {SEASONAL}, bl AS (SELECT origin, location, w, CASE WHEN count(*) >= 3 THEN avg(dd) ELSE 0.0 END AS s FROM dm GROUP BY 1, 2, 3),
fl AS (SELECT origin, location, k.w, coalesce(s, 0.0) AS s FROM (SELECT DISTINCT origin, location FROM h) CROSS JOIN (SELECT unnest(range(1, 53))::INTEGER AS w) k LEFT JOIN bl USING (origin, location, w)),
sl AS (SELECT origin, location, ((fl.w - 1 + x.k + 52) % 52 + 1)::INTEGER AS woy, avg(s) AS s FROM fl, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) x GROUP BY 1, 2, 3), ol AS (SELECT origin, location, woy, s - avg(s) OVER (PARTITION BY origin, location) AS s FROM sl)
SELECT origin, location, woy, round(0.7 * sp.s + 0.3 * ol.s, 6) + 0.0 AS s FROM ol JOIN sp USING (origin, woy)""")
def profile_blend(spark, d):
    """Profiles of each location, blended with the pooled one."""
    h = _history(spark, d)
    own = profiles.seasonal(h, ["origin", "location"])
    return rounded(profiles.blended(own, profiles.seasonal(h, ["origin"]), 0.3, ["origin", "woy"], "s"), "s")


@query(f"""WITH {HIST}, a AS (SELECT *, pow(0.8, max(season_year) OVER (PARTITION BY origin, location) - season_year) AS wt, pow(0.8, max(season_year) OVER (PARTITION BY origin) - season_year) AS wp FROM h),
b AS (SELECT *, sum(wt) OVER (PARTITION BY origin, location, w) AS tot, sum(wt) OVER (PARTITION BY origin, location, w ORDER BY z, week ROWS UNBOUNDED PRECEDING) AS cum FROM a),
c AS (SELECT origin, location, w, sum(greatest(least(cum, 0.9 * tot) - greatest(cum - wt, 0.1 * tot), 0) * z) / sum(greatest(least(cum, 0.9 * tot) - greatest(cum - wt, 0.1 * tot), 0)) AS c FROM b GROUP BY 1, 2, 3),
q AS (SELECT origin, w, sum(wp * z) / sum(wp) AS q FROM a GROUP BY 1, 2), m AS (SELECT origin, w, location, 0.6 * c + 0.4 * q AS c FROM c JOIN q USING (origin, w)),
o2 AS (SELECT origin, location, avg(c) AS m FROM m GROUP BY 1, 2), fu AS (SELECT origin, location, k.w, coalesce(c, m) AS c FROM o2 CROSS JOIN (SELECT unnest(range(1, 53))::INTEGER AS w) k LEFT JOIN m USING (origin, location, w))
SELECT origin, location, ((fu.w - 1 + x.k + 52) % 52 + 1)::INTEGER AS woy, round(avg(c), 6) + 0.0 AS c FROM fu, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) x GROUP BY 1, 2, 3""")
def climatology_robust(spark, d):
    """Recency-weighted trimmed means, blended with the pooled ones and smoothed on the circle."""
    return rounded(profiles.robust(_history(spark, d), ["origin"], 0.8, 0.1, 0.4), "c")


@query(f"""WITH {PANEL}, cl AS (SELECT location, woy, quantile_cont(z, 0.5) AS c FROM p GROUP BY 1, 2), x AS (SELECT p.*, row_number() OVER (PARTITION BY location, season_year ORDER BY week DESC) AS b FROM p)
SELECT season_year, location, round(avg(z - c), 6) + 0.0 AS severity FROM x JOIN cl USING (location, woy) WHERE b <= 8 GROUP BY 1, 2""")
def severity_difference(spark, d):
    rows = base.logged(spark, d)
    climate = rows.groupBy("location", "woy").agg(F.percentile("z", F.lit(0.5)).alias("c"))
    return rounded(profiles.severity_difference(rows, climate), "severity")


@query(f"WITH {PANEL}, df AS (SELECT location, week, z - lag(z) OVER (PARTITION BY location ORDER BY week) AS e FROM p), st AS (SELECT location, season_year, max(y) - quantile_cont(y, 0.5) AS e FROM p GROUP BY 1, 2 HAVING count(*) >= 40) SELECT 'steps' AS kind, x.location AS a, y.location AS b, round(corr(x.e, y.e), 6) + 0.0 AS corr, count(x.e + y.e) AS n FROM df x JOIN df y ON x.week = y.week AND x.location < y.location WHERE x.e IS NOT NULL AND y.e IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'amplitude', x.location, y.location, round(corr(x.e, y.e), 6) + 0.0, count(*) FROM st x JOIN st y ON x.season_year = y.season_year AND x.location < y.location GROUP BY 2, 3")
def corr_kinds(spark, d):
    """Correlations between locations of the weekly steps and of the seasons' amplitudes."""
    rows = base.logged(spark, d)
    steps = rows.withColumn("e", features.difference("z", ["location"])).filter("e IS NOT NULL")
    seasons = rows.groupBy("location", "season_year").agg((F.max("y") - F.percentile("y", F.lit(0.5))).alias("e"), F.count(F.lit(1)).alias("n")).filter("n >= 40")
    both = [diagnostics.correlations(steps, "e").withColumn("kind", F.lit("steps")), diagnostics.correlations(seasons, "e", "season_year").withColumn("kind", F.lit("amplitude"))]
    return rounded(both[0].unionByName(both[1]), "corr")


@query(f"WITH {PANEL}, {ORIGINS}, c AS (SELECT origin, x.location, y.location AS other, corr(x.z, y.z) AS r FROM p x JOIN p y ON x.week = y.week AND x.location <> y.location JOIN o ON x.week <= origin GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY origin, location ORDER BY round(r, 9) DESC, other) AS i FROM c) SELECT origin, location, other AS nearest, round(r, 6) AS corr FROM k WHERE i = 1")
def nearest_by_origin(spark, d):
    """Each location's nearest one at every origin, from what is known by then."""
    known = panel.latest(diagnostics.running_correlations(base.logged(spark, d), "z"), base.origins(spark, d), ["a", "b"])
    both = known.select("origin", F.col("a").alias("location"), F.col("b").alias("other"), "corr").unionByName(known.select("origin", F.col("b").alias("location"), F.col("a").alias("other"), "corr"))
    best = F.min_by(F.struct("other", "corr"), F.struct(-F.round("corr", 9), F.col("other")))
    return rounded(both.groupBy("origin", "location").agg(best.alias("m")).select("origin", "location", F.col("m.other").alias("nearest"), "m.corr"), "corr")


@query(f"""WITH {PANEL}, {ORIGINS}, h AS (SELECT origin, location, woy, z FROM p, o WHERE week < origin), dm AS (SELECT *, z - avg(z) OVER (PARTITION BY origin, location) AS dd FROM h),
bn AS (SELECT origin, woy, CASE WHEN count(*) >= 3 THEN avg(dd) ELSE 0.0 END AS s FROM dm GROUP BY 1, 2), fu AS (SELECT origin, k.w, coalesce(s, 0.0) AS s FROM (SELECT DISTINCT origin FROM h) g CROSS JOIN (SELECT unnest(range(1, 54))::INTEGER AS w) k LEFT JOIN bn USING (origin) WHERE bn.woy = k.w UNION ALL SELECT g.origin, k.w, 0.0 FROM (SELECT DISTINCT origin FROM h) g CROSS JOIN (SELECT unnest(range(1, 54))::INTEGER AS w) k WHERE NOT EXISTS (SELECT 1 FROM bn WHERE bn.origin = g.origin AND bn.woy = k.w)),
sm AS (SELECT fu.origin, ((fu.w - 1 + x.k + 53) % 53 + 1)::INTEGER AS woy, avg(s) AS s FROM fu, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) x GROUP BY 1, 2) SELECT origin, woy, round(s - avg(s) OVER (PARTITION BY origin), 6) + 0.0 AS s FROM sm""")
def seasonal_profile_53(spark, d):
    """The pooled profile on 53 weeks, none folded."""
    return rounded(profiles.seasonal(_history(spark, d), ["origin"], period=53), "s")


# scores, calibration, selection


@query(f"WITH {FORECASTS}, {SCORES}, x AS (SELECT *, (CASE WHEN month(origin) >= 10 THEN year(origin) ELSE year(origin) - 1 END)::INTEGER AS season, {base.sql_woy('origin')} AS elapsed FROM sc) " + " UNION ALL ".join(f"SELECT model, '{c}' AS dimension, CAST({c} AS VARCHAR) AS member, round(avg(wis), 6) AS wis, count(*) AS n FROM x GROUP BY model, {c}" for c in ("season", "elapsed")))
def breakdown_seasons(spark, d):
    scores = scoring.scored(base.forecasts(spark, d), base.truth(spark, d))
    rows = scores.withColumns({"season": calendar.season_year(F.col("origin")), "elapsed": calendar.week_of_season(F.col("origin"))})
    return rounded(scoring.breakdown(rows, ["season", "elapsed"]), "wis")


_TOP = "wt AS (SELECT model FROM (SELECT model, row_number() OVER (ORDER BY avg(wis), model) AS k FROM sc GROUP BY model) WHERE k <= 2)"


@query(f"WITH {FORECASTS}, {SCORES}, {_TOP} SELECT 'ensemble' AS model, location, origin, horizon, target_week, level, round(avg(value), 6) AS value FROM f JOIN wt USING (model) GROUP BY location, origin, horizon, target_week, level")
def ensemble_top2(spark, d):
    """The mean of the two best members."""
    f = base.forecasts(spark, d)
    best = selection.top(scoring.scored(f, base.truth(spark, d)), 2)
    return rounded(quantiles.ensemble(f.join(best, "model")).select(*quantiles.TASK, "level", "value"), "value")


@query(f"WITH {FORECASTS}, {SCORES}, x AS (SELECT model, location, avg(wis) AS w FROM sc GROUP BY 1, 2), r AS (SELECT location, row_number() OVER (PARTITION BY model ORDER BY w DESC, location DESC) AS k FROM x) SELECT location, count(*) AS n FROM r WHERE k = 1 GROUP BY 1")
def worst_tally(spark, d):
    """How often each location is the worst of a model."""
    return selection.tally(selection.worst(scoring.scored(base.forecasts(spark, d), base.truth(spark, d)), "location"), "location")


@query(f"WITH {FORECASTS}, {SCORES}, {_COMP}, pr(model, parameters) AS (VALUES ('ar1', 3), ('climate', 1), ('walk', 2)), x AS (SELECT *, min(composite) OVER () AS least FROM cp JOIN pr USING (model)) SELECT model, parameters, row_number() OVER (ORDER BY CASE WHEN composite <= least * 1.25 THEN 0 ELSE 1 END, CASE WHEN composite <= least * 1.25 THEN parameters END, composite, model)::INTEGER AS rank FROM x")
def parsimony_rank(spark, d):
    """Near ties in the composite score go to fewer parameters."""
    known = spark.createDataFrame([("ar1", 3), ("climate", 1), ("walk", 2)], "model string, parameters int")
    rows = selection.composite(scoring.scored(base.forecasts(spark, d), base.truth(spark, d))).join(known, "model")
    return selection.ranked(rows, "composite", tie=0.25, parameters=F.col("parameters")).select("model", "parameters", "rank")


@query(f"""WITH {FORECASTS}, {SCORES}, ex(model) AS (VALUES ('ar1'), ('walk'), ('climate'), ('other')), t AS (SELECT model, count(*) AS n, avg(wis) AS w FROM sc WHERE NOT (model = 'walk' AND horizon = 4) GROUP BY 1)
SELECT model, CASE WHEN n IS NULL THEN 'missing' WHEN n < (SELECT max(n) FROM t) THEN 'failed' ELSE 'ok' END AS status, coalesce(n, 0) AS tasks, CASE WHEN n = (SELECT max(n) FROM t) THEN round(w, 6) ELSE 'Infinity'::DOUBLE END AS score FROM ex LEFT JOIN t USING (model)""")
def candidate_status(spark, d):
    """A candidate is ok, failed (tasks are missing: its score is infinite) or missing."""
    scores = scoring.scored(base.forecasts(spark, d), base.truth(spark, d)).filter("NOT (model = 'walk' AND horizon = 4)")
    return rounded(selection.status(scores, ["ar1", "walk", "climate", "other"]), "score")


_LOC = f"""lw AS (SELECT md.location, width, avg(CASE WHEN ln(1 + truth) < x THEN (1 - level / 1000.0) * (x - ln(1 + truth)) ELSE level / 1000.0 * (ln(1 + truth) - x) END) AS loss FROM (SELECT md.*, truth, g.width, ln(1 + med) + shift + wb.width * g.width * (ln(1 + value) - ln(1 + med)) AS x FROM md JOIN truth USING (location, target_week) JOIN wb USING (horizon) JOIN sh USING (horizon), (SELECT unnest({_GRID})::DOUBLE AS width) g) md GROUP BY 1, 2),
ws AS (SELECT location, width FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY round(loss, 9), width) AS k FROM lw) WHERE k = 1)"""


@query(f"WITH {FORECASTS}, {WIDTH}, {_LOC} SELECT location, width FROM ws")
def width_by_location(spark, d):
    """Factors of the locations on top of those of the horizons."""
    f, t = base.forecasts(spark, d), base.truth(spark, d)
    return quantiles.fit_location_width(f, t, quantiles.fit_shift(f, t, ["horizon"]), quantiles.fit_width(f, t, _GRID), _GRID)


@query(f"WITH {FORECASTS}, {WIDTH}, {_LOC} SELECT model, location, origin, horizon, target_week, level, round(greatest(exp(ln(1 + med) + shift + wb.width * ws.width * (ln(1 + value) - ln(1 + med))) - 1, 0), 6) AS value FROM md JOIN wb USING (horizon) JOIN sh USING (horizon) JOIN ws USING (location)")
def recalibrate_locations(spark, d):
    f, t = base.forecasts(spark, d), base.truth(spark, d)
    shift, width = quantiles.fit_shift(f, t, ["horizon"]), quantiles.fit_width(f, t, _GRID)
    return rounded(quantiles.recalibrated(f, shift, width, quantiles.fit_location_width(f, t, shift, width, _GRID)), "value")


_SY = "(CASE WHEN month(origin) >= 10 THEN year(origin) ELSE year(origin) - 1 END)::INTEGER"


@query(f"""WITH {FORECASTS}, md AS (SELECT *, max(CASE WHEN level = 500 THEN value END) OVER (PARTITION BY model, location, origin, horizon) AS med, {_SY} AS season_year FROM f),
g AS (SELECT season_year, horizon, width, sum(CASE WHEN ln(1 + truth) < x THEN (1 - level / 1000.0) * (x - ln(1 + truth)) ELSE level / 1000.0 * (ln(1 + truth) - x) END) AS s, count(*) AS n FROM (SELECT md.*, truth, width, ln(1 + med) + width * (ln(1 + value) - ln(1 + med)) AS x FROM md JOIN truth USING (location, target_week), (SELECT unnest({_GRID})::DOUBLE AS width)) GROUP BY 1, 2, 3),
r AS (SELECT *, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS loss FROM g WINDOW w AS (PARTITION BY horizon, width)), k AS (SELECT *, row_number() OVER (PARTITION BY season_year, horizon ORDER BY round(loss, 9), width) AS k FROM r WHERE loss IS NOT NULL)
SELECT season_year, horizon, width FROM k WHERE k = 1""")
def loso_width(spark, d):
    """For each season the widths that fit the other seasons best."""
    return quantiles.fit_width_without(base.forecasts(spark, d), base.truth(spark, d), _GRID)


@query(f"WITH {PANEL}, t AS (SELECT location, week, season_year, y FROM p WHERE season_year IN (1995, 1996)) SELECT season_year, location, count(*) AS n, round(avg(y), 6) AS mean FROM t GROUP BY 1, 2")
def guarded_truth(spark, d):
    """Truth of the validation seasons alone; a row of another season would fail the job."""
    rows = base.weekly(spark, d).select("location", "season_year", F.col("week").alias("target_week"), F.col("y").alias("truth"))
    kept = scoring.guarded(scoring.checked_truth(rows), [1995, 1996])
    return rounded(kept.groupBy("season_year", "location").agg(F.count(F.lit(1)).alias("n"), F.avg("truth").alias("mean")), "mean")


@query(f"WITH {FORECASTS}, c(kind, item) AS (VALUES ('horizon', '1'), ('horizon', '2'), ('horizon', '3'), ('horizon', '5'), ('location', 'A'), ('location', 'N'), ('location', 'R'), ('location', 'X')), g AS (SELECT DISTINCT 'horizon' AS kind, CAST(horizon AS VARCHAR) AS item FROM f UNION SELECT DISTINCT 'location', location FROM f) SELECT kind, item, 'missing' AS side FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.kind = c.kind AND g.item = c.item) UNION ALL SELECT kind, item, 'extra' FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE g.kind = c.kind AND g.item = c.item)")
def config_drift(spark, d):
    """What a configuration names and the files lack, and the other way round."""
    config = spark.createDataFrame([(["A", "N", "R", "X"], [1, 2, 3, 5])], "locations array<string>, horizons array<int>")
    return validation.drift(config, base.forecasts(spark, d))


# streams run to their end


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS location, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Daily windows of the events, read as a stream and run to its end."""
    return rounded(revisions.drained(_events(spark, d), revisions.windowed), "total", digits=4)


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    """Sessions of the users, as a stream."""
    return revisions.drained(_events(spark, d), revisions.sessions)


def _events(spark, d) -> DataFrame:
    schema = read_table(spark, d, "events").schema
    # a pattern, as a stream takes no single file by its name; it also fits a folder of files
    return spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")
