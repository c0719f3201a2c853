"""One query per operator family, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions import calendar, distributions, transforms
from panelcast.functions.distributions import LEVELS, NORMAL
from panelcast.operators import bayes, diagnostics, features, fit, panel, profiles, quantiles, scoring, selection, simulate, vintage
from panelcast.plans import base
from panelcast.plans.base import AR1, CUT, FORECASTS, HORIZONS, ORIGINS, PAIRS, PANEL, SCORES, TRIANGLE, sql_woy
from panelcast.sources import validation
from panelcast.sources.files import read_table
from panelcast.streaming import revisions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Paths of a simulation.
PATHS = 1000


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """nudge moves values that lie halfway between two roundings, whose last bits depend on the order of a sum."""
    return df.withColumns({c: F.round(F.col(c) + nudge, digits) + F.lit(0.0) for c in columns})


# panel and calendar


@query(f"WITH {PANEL} SELECT DISTINCT week, season_year, woy, (CASE WHEN dayofyear(week) >= 205 THEN year(week) ELSE year(week) - 1 END)::INTEGER AS summer_year, (CASE WHEN woy <= 26 THEN 1 ELSE 2 END)::INTEGER AS half, ((woy - 1) % 52 + 1)::INTEGER AS folded FROM p")
def season_calendar(spark, d):
    rows = base.weekly(spark, d).select("week", "season_year", "woy").distinct()
    return rows.select("week", "season_year", "woy", calendar.summer_season_year(F.col("week")).alias("summer_year"), F.when(F.col("woy") <= 26, 1).otherwise(2).alias("half"), calendar.mod1(F.col("woy"), 52).alias("folded"))


@query("""WITH p0 AS (SELECT o_orderpriority AS location, CAST(date_trunc('week', o_orderdate) AS DATE) + 5 AS week, sum(o_totalprice) / 1000.0 AS y FROM orders GROUP BY 1, 2),
wk AS (SELECT DISTINCT week FROM p0), lastw AS (SELECT week FROM wk ORDER BY week DESC LIMIT 104), e AS (SELECT max(week) AS last_week FROM lastw),
g AS (SELECT l.location, week FROM lastw, (SELECT DISTINCT location FROM p0) l),
s AS (SELECT *, (CASE WHEN month(week) >= 10 THEN year(week) ELSE year(week) - 1 END) AS sy FROM g)
SELECT s.location, s.week, round(y, 6) AS y, least(12, (last_week - s.week) // 7)::INTEGER AS delay, """ + sql_woy("s.week") + """ AS woy, dense_rank() OVER (ORDER BY sy)::INTEGER AS season FROM s CROSS JOIN e LEFT JOIN p0 ON p0.location = s.location AND p0.week = s.week""")
def panel_dense(spark, d):
    rows = panel.weekly(read_table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", 1000.0)
    return rounded(panel.dense(rows, 104, 12), "y")


@query(f"WITH {PANEL} SELECT location, count(*) AS n, min(week) AS first_week, round(sum(y), 6) AS total FROM p WHERE week IN (SELECT DISTINCT week FROM p ORDER BY week DESC LIMIT 104) GROUP BY 1")
def trailing_window(spark, d):
    return rounded(panel.trailing(base.weekly(spark, d), 104).groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.min("week").alias("first_week"), F.sum("y").alias("total")), "total")


@query(f"WITH {PANEL}, {ORIGINS} SELECT split, origin, count(*) AS n, round(avg(y), 6) AS mean FROM p, o WHERE week <= origin GROUP BY 1, 2")
def split_origins(spark, d):
    return rounded(panel.expanding(base.weekly(spark, d), base.origins(spark, d)).groupBy("split", "origin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")), "mean")


@query(f"""WITH {PANEL}, l AS (SELECT *, least(greatest(y / 100, 1e-6), 1 - 1e-6) AS q FROM p)
SELECT location, week, round(ln(greatest(y, 1e-4)), 6) AS log, round(ln(1 + greatest(y, 0)), 6) AS log1p, round(ln(q / (1 - q)), 6) AS logit, round(pow(greatest(y, 0), 0.25), 6) AS fourthroot, round(pow(greatest(y, 0), 0.3), 6) AS power03,
 round(CASE WHEN location = 'N' THEN sqrt(greatest(y, 0)) ELSE ln(greatest(y, 1e-4)) END, 6) AS special, round(greatest(pow(pow(greatest(y, 0), 0.25), 4), 0), 6) AS back FROM l""")
def transform_roundtrip(spark, d):
    y = F.col("y")
    forward, _ = transforms.power(0.3)
    cols = {s: transforms.to_scale(y, s) for s in ("log", "log1p", "logit", "fourthroot")} | {"power03": forward(y), "special": transforms.by_location(y, F.col("location"), "log", {"N": "sqrt"}), "back": transforms.from_scale(transforms.to_scale(y, "fourthroot"), "fourthroot")}
    return rounded(base.weekly(spark, d).select("location", "week", *[c.alias(n) for n, c in cols.items()]), *cols)


@query("SELECT CAST(k AS INTEGER) AS level, q AS z FROM (VALUES " + ", ".join(f"({k}, {round(q, 5)!r}::DOUBLE)" for k, q in NORMAL.items()) + ") v(k, q)")
def normal_quantiles(spark, d):
    levels = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level"))
    return rounded(levels.withColumn("z", distributions.normal_quantile(F.col("level") / 1000)), "z", digits=5)


@query(f"WITH {PANEL} SELECT week, woy, " + ", ".join(f"round({fn}(2.0 * {k} * pi() * woy / 52.0), 6) + 0.0 AS {fn}{k}" for k in (1, 2) for fn in ("sin", "cos")) + " FROM (SELECT DISTINCT week, woy FROM p)")
def fourier_features(spark, d):
    names = ["sin1", "cos1", "sin2", "cos2"]
    return rounded(base.weekly(spark, d).select("week", "woy").distinct().select("week", "woy", *[c.alias(n) for c, n in zip(calendar.fourier(F.col("woy"), 2), names)]), *names)


@query(f"WITH {PANEL} SELECT location, week, round((y - avg(y) OVER w) / stddev_samp(y) OVER w, 6) + 0.0 AS zscore, CASE WHEN y >= quantile_cont(y, 0.5) OVER w THEN 'high' ELSE 'low' END AS phase FROM p WINDOW w AS (PARTITION BY location)")
def zscore_phase(spark, d):
    w = Window.partitionBy("location")
    rows = base.weekly(spark, d).withColumns({"zscore": (F.col("y") - F.avg("y").over(w)) / F.stddev_samp("y").over(w), "phase": F.when(F.col("y") >= F.percentile("y", F.lit(0.5)).over(w), "high").otherwise("low")})
    return rounded(rows.select("location", "week", "zscore", "phase"), "zscore")


# vintages

_ASOF = "SELECT location, day, {pick}(value, as_of) AS value, {when}(as_of) AS as_of FROM ver WHERE as_of {op} DATE '" + CUT + "' GROUP BY 1, 2"


def _cut():
    return F.lit(CUT).cast("date")


@query(f"WITH {TRIANGLE} " + _ASOF.format(pick="arg_max", when="max", op="<="))
def asof_latest(spark, d):
    return vintage.as_of(base.versions(spark, d), _cut())


@query(f"WITH {TRIANGLE} " + _ASOF.format(pick="arg_max", when="max", op="<"))
def asof_strict(spark, d):
    return vintage.as_of(base.versions(spark, d), _cut(), strict=True)


@query(f"WITH {TRIANGLE} " + _ASOF.format(pick="arg_min", when="min", op="<="))
def asof_earliest(spark, d):
    return vintage.as_of(base.versions(spark, d), _cut(), earliest=True)


@query(f"WITH {TRIANGLE}, t AS (SELECT *, arg_max(value, as_of) OVER (PARTITION BY location, day) AS settled FROM ver) SELECT location, (as_of - day)::INTEGER AS delay, count(*) AS n, round(avg(value / settled), 6) AS completeness, round(avg(CASE WHEN settled > value THEN 1.0 ELSE 0.0 END), 6) AS upward FROM t WHERE settled > 0.05 GROUP BY 1, 2")
def settled_vintage(spark, d):
    rows = vintage.settled(base.versions(spark, d)).filter("settled > 0.05").withColumn("delay", F.datediff("as_of", "day"))
    return rounded(rows.groupBy("location", "delay").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value") / F.col("settled")).alias("completeness"), F.avg((F.col("settled") > F.col("value")).cast("double")).alias("upward")), "completeness", "upward")


REV = f"""{TRIANGLE}, known AS (SELECT *, arg_max(value, as_of) OVER w AS settled, max(as_of) OVER w AS sa FROM ver WHERE as_of < DATE '{CUT}' WINDOW w AS (PARTITION BY location, day)),
rv AS (SELECT location, day, (as_of - day)::INTEGER AS delay, settled - value AS change, CASE WHEN abs(value) >= 1e-6 THEN settled / value END AS ratio FROM known WHERE as_of < sa)"""


@query(f"WITH {REV} SELECT location, delay, round(quantile_cont(change, 0.5), 6) AS correction, count(*) AS n FROM rv GROUP BY 1, 2 HAVING count(*) >= 5")
def revision_profile_add(spark, d):
    return rounded(vintage.revision_profile(base.versions(spark, d), _cut()), "correction")


@query(f"WITH {REV} SELECT location, delay, round(avg(ratio), 6) AS correction, count(ratio) AS n FROM rv GROUP BY 1, 2 HAVING count(ratio) >= 5")
def revision_profile_mult(spark, d):
    return rounded(vintage.revision_profile(base.versions(spark, d), _cut(), mode="multiplicative", stat="mean"), "correction")


@query(f"WITH {REV} SELECT delay, round(quantile_cont(change, 0.5), 6) AS correction, count(*) AS n FROM rv GROUP BY 1 HAVING count(*) >= 5")
def revision_profile_pooled(spark, d):
    return rounded(vintage.revision_profile(base.versions(spark, d), _cut(), pooled=True), "correction")


@query(f"""WITH {REV}, a AS (SELECT location, delay, quantile_cont(change, 0.5) AS o FROM rv GROUP BY 1, 2 HAVING count(*) >= 5), b AS (SELECT delay, quantile_cont(change, 0.5) AS q FROM rv GROUP BY 1 HAVING count(*) >= 5),
k AS (SELECT location, delay FROM a UNION SELECT location, b.delay FROM b, (SELECT DISTINCT location FROM a))
SELECT location, delay, round(coalesce(0.7 * o + 0.3 * q, o, q), 6) AS correction FROM k LEFT JOIN a USING (location, delay) LEFT JOIN b USING (delay)""")
def revision_profile_blend(spark, d):
    v = base.versions(spark, d)
    return rounded(vintage.blended_profile(vintage.revision_profile(v, _cut()), vintage.revision_profile(v, _cut(), pooled=True), 0.7), "correction")


@query(f"""WITH {REV}, first AS (SELECT location, day, arg_min(value, as_of) AS v FROM ver GROUP BY 1, 2),
ph AS (SELECT * FROM (SELECT location, day, CASE WHEN v >= lag(v, 3) OVER w THEN 'rising' WHEN v < lag(v, 3) OVER w THEN 'falling' END AS phase FROM first WINDOW w AS (PARTITION BY location ORDER BY day)) WHERE phase IS NOT NULL),
r AS (SELECT rv.*, phase FROM rv JOIN ph USING (location, day)),
k AS (SELECT DISTINCT r1.location, r2.delay, r3.phase FROM r r1, (SELECT DISTINCT delay FROM r) r2, (SELECT DISTINCT phase FROM r) r3),
c1 AS (SELECT location, delay, phase, quantile_cont(change, 0.5) AS c FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 12), c2 AS (SELECT location, delay, quantile_cont(change, 0.5) AS c FROM r GROUP BY 1, 2 HAVING count(*) >= 12), c3 AS (SELECT delay, quantile_cont(change, 0.5) AS c FROM r GROUP BY 1 HAVING count(*) >= 12)
SELECT location, delay, phase, CASE WHEN c1.c IS NOT NULL THEN 'own' WHEN c2.c IS NOT NULL THEN 'location' WHEN c3.c IS NOT NULL THEN 'pooled' ELSE 'none' END AS tier, round(coalesce(c1.c, c2.c, c3.c), 6) AS correction
FROM k LEFT JOIN c1 USING (location, delay, phase) LEFT JOIN c2 USING (location, delay) LEFT JOIN c3 USING (delay)""")
def revision_tiers(spark, d):
    v = base.versions(spark, d)
    rows = vintage.phased(vintage.revisions(v, _cut()), vintage.phases(v))
    grid = rows.select("location").distinct().crossJoin(rows.select("delay").distinct()).crossJoin(rows.select("phase").distinct())
    return rounded(vintage.tiers(rows, grid, 12), "correction")


@query(f"""WITH {REV}, a AS (SELECT location, delay, quantile_cont(change, 0.5) AS c FROM rv GROUP BY 1, 2 HAVING count(*) >= 5),
x AS (SELECT location, day, arg_max(value, as_of) AS value, (DATE '{CUT}' - day)::INTEGER AS delay FROM ver WHERE as_of <= DATE '{CUT}' GROUP BY 1, 2)
SELECT location, day, delay, value, round(CASE WHEN delay BETWEEN 0 AND 5 AND c IS NOT NULL THEN value + c ELSE value END, 6) AS corrected FROM x LEFT JOIN a USING (location, delay)""")
def backfill_apply(spark, d):
    v = base.versions(spark, d)
    rows = vintage.as_of(v, _cut()).select("location", "day", "value", F.datediff(_cut(), "day").alias("delay"))
    return rounded(vintage.corrected(rows, vintage.revision_profile(v, _cut()), 5), "corrected")


# seasonal profiles, all origins at once

HIST = f"{PANEL}, {ORIGINS}, h AS (SELECT origin, location, week, season_year, woy, ((woy - 1) % 52 + 1)::INTEGER AS w, z, y FROM p, o WHERE week < origin)"
SEASONAL = f"""{HIST}, dm AS (SELECT *, z - avg(z) OVER (PARTITION BY origin, location) AS dd FROM h),
bn AS (SELECT origin, w, CASE WHEN count(*) >= 3 THEN avg(dd) ELSE 0.0 END AS s FROM dm GROUP BY 1, 2),
fu AS (SELECT origin, k.w, coalesce(s, 0.0) AS s FROM (SELECT DISTINCT origin FROM h) CROSS JOIN (SELECT unnest(range(1, 53))::INTEGER AS w) k LEFT JOIN bn USING (origin, w)),
sm AS (SELECT fu.origin, ((fu.w - 1 + x.k + 52) % 52 + 1)::INTEGER AS w, avg(s) AS s FROM fu, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) x GROUP BY 1, 2),
sp AS (SELECT origin, w AS woy, s - avg(s) OVER (PARTITION BY origin) AS s FROM sm)"""


def _history(spark, d):
    return panel.expanding(base.logged(spark, d), base.origins(spark, d), strict=True)


@query(f"WITH {SEASONAL} SELECT origin, woy, round(s, 6) + 0.0 AS s FROM sp")
def seasonal_profile_pooled(spark, d):
    return rounded(profiles.seasonal(_history(spark, d), ["origin"]), "s")


@query(f"""WITH {HIST}, b AS (SELECT origin, location, w, quantile_cont(z, 0.5) AS c FROM h GROUP BY 1, 2, 3), m AS (SELECT origin, location, quantile_cont(z, 0.5) AS c0 FROM h GROUP BY 1, 2),
fu AS (SELECT origin, location, k.w, coalesce(c, c0) AS c FROM m CROSS JOIN (SELECT unnest(range(1, 53))::INTEGER AS w) k LEFT JOIN b USING (origin, location, w))
SELECT origin, location, ((fu.w - 1 + x.k + 52) % 52 + 1)::INTEGER AS woy, round(avg(c), 6) + 0.0 AS c FROM fu, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) x GROUP BY 1, 2, 3""")
def climatology_median(spark, d):
    return rounded(profiles.climatology(_history(spark, d), ["origin", "location"]), "c")


@query(f"""WITH {HIST}, a AS (SELECT *, pow(0.8, max(season_year) OVER (PARTITION BY origin, location) - season_year) AS wt FROM h),
b AS (SELECT *, sum(wt) OVER (PARTITION BY origin, location, woy) AS tot, sum(wt) OVER (PARTITION BY origin, location, woy ORDER BY z, week ROWS UNBOUNDED PRECEDING) AS cum FROM a),
c AS (SELECT *, greatest(least(cum, 0.9 * tot) - greatest(cum - wt, 0.1 * tot), 0) AS k FROM b)
SELECT origin, location, woy, round(sum(k * z) / sum(k), 6) + 0.0 AS c FROM c GROUP BY 1, 2, 3""")
def climatology_trimmed(spark, d):
    return rounded(profiles.trimmed_weighted(_history(spark, d), ["origin", "location"]), "c")


@query(f"WITH {SEASONAL}, pl AS (SELECT o.origin, p.location, p.week, p.woy, z, z - avg(z) OVER (PARTITION BY o.origin, p.location) AS dv FROM p, o WHERE p.week <= o.origin) SELECT pl.origin, location, count(*) AS n, round(stddev_samp(dv - coalesce(s, 0)), 6) AS sd, round(max(dv - coalesce(s, 0)), 6) AS top FROM pl LEFT JOIN sp ON sp.origin = pl.origin AND sp.woy = (pl.woy - 1) % 52 + 1 GROUP BY 1, 2")
def deseasonalize(spark, d):
    rows = profiles.deseasonalised(panel.expanding(base.logged(spark, d), base.origins(spark, d)), profiles.seasonal(_history(spark, d), ["origin"]), ["origin"])
    return rounded(rows.groupBy("origin", "location").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("r").alias("sd"), F.max("r").alias("top")), "sd", "top")


@query(f"WITH {SEASONAL}, dv AS (SELECT *, z - avg(z) OVER (PARTITION BY origin, location) AS r FROM h) SELECT origin, location, round(CASE WHEN sum(s * s) > 1e-8 THEN 1 + 0.5 * (sum(s * r) / sum(s * s) - 1) ELSE 1 END, 6) AS scale FROM dv JOIN sp USING (origin) WHERE sp.woy = dv.w GROUP BY 1, 2")
def amplitude_scale(spark, d):
    h = _history(spark, d)
    rows = h.withColumns({"r": F.col("z") - F.avg("z").over(Window.partitionBy("origin", "location")), "_w": calendar.mod1(F.col("woy"), 52).cast("int")})
    joined = rows.join(profiles.seasonal(h, ["origin"]).withColumnRenamed("woy", "_w"), ["origin", "_w"])
    return rounded(joined.groupBy("origin", "location").agg(profiles.slope_through_zero(F.col("s"), F.col("r"), shrink=0.5).alias("scale")), "scale")


@query(f"""WITH {PANEL}, cl AS (SELECT location, woy, quantile_cont(y, 0.5) AS c FROM p GROUP BY 1, 2),
x AS (SELECT p.*, row_number() OVER (PARTITION BY location, season_year ORDER BY week DESC) AS b FROM p),
own AS (SELECT location, season_year, avg(y / c) AS ratio FROM x JOIN cl USING (location, woy) WHERE b <= 8 GROUP BY 1, 2)
SELECT season_year, round(avg(ratio), 6) AS severity, count(*) AS n FROM own GROUP BY 1 HAVING count(*) >= 3""")
def severity_index(spark, d):
    rows = base.weekly(spark, d).withColumn("z", F.col("y"))
    climate = rows.groupBy("location", "woy").agg(F.percentile("y", F.lit(0.5)).alias("c"))
    return rounded(profiles.severity(rows, climate), "severity")


@query(f"""WITH {HIST}, dm AS (SELECT origin, sin(2 * pi() * woy / 52.0) AS s, cos(2 * pi() * woy / 52.0) AS c, z - avg(z) OVER (PARTITION BY origin, location) AS dd FROM h),
g AS (SELECT origin, sum(s * s) AS ss, sum(s * c) AS sc, sum(c * c) AS cc, sum(s * dd) AS sd, sum(c * dd) AS cd FROM dm GROUP BY 1)
SELECT origin, round((sd * cc - cd * sc) / (ss * cc - sc * sc), 6) + 0.0 AS b_sin, round((cd * ss - sd * sc) / (ss * cc - sc * sc), 6) + 0.0 AS b_cos FROM g""")
def fourier_shape(spark, d):
    return rounded(profiles.fourier_shape(_history(spark, d), ["origin"]), "b_sin", "b_cos")


# sequence features


@query(f"WITH {PANEL} SELECT location, week, round(z, 6) AS z, " + ", ".join(f"round(lag{k}, 6) AS lag{k}" for k in (1, 2, 3)) + " FROM (SELECT *, " + ", ".join(f"lag(z, {k}) OVER w AS lag{k}" for k in (1, 2, 3)) + " FROM p WINDOW w AS (PARTITION BY location ORDER BY week)) WHERE lag3 IS NOT NULL")
def lag_design(spark, d):
    return rounded(features.lags(base.logged(spark, d), "z", 3, ["location"]).select("location", "week", "z", "lag1", "lag2", "lag3"), "z", "lag1", "lag2", "lag3")


@query(f"WITH {PANEL} SELECT location, week, round(target, 6) AS target, round(z, 6) AS lag0, round(lag1, 6) AS lag1 FROM (SELECT *, lead(z, 3) OVER w AS target, lag(z) OVER w AS lag1 FROM p WINDOW w AS (PARTITION BY location ORDER BY week)) WHERE target IS NOT NULL AND lag1 IS NOT NULL")
def direct_design(spark, d):
    return rounded(features.direct(base.logged(spark, d), "z", 2, 3, ["location"]).select("location", "week", "target", "lag0", "lag1"), "target", "lag0", "lag1")


@query(f"WITH {PANEL} SELECT location, round(stddev_samp(s), 6) AS volatility FROM (SELECT location, z - lag(z) OVER (PARTITION BY location ORDER BY week) AS s FROM p) GROUP BY 1")
def diff_volatility(spark, d):
    rows = base.logged(spark, d).withColumn("s", features.difference("z", ["location"]))
    return rounded(rows.groupBy("location").agg(F.stddev_samp("s").alias("volatility")), "volatility")


@query(f"""WITH {PANEL}, a AS (SELECT *, y > quantile_cont(y, 0.5) OVER (PARTITION BY location) AS up, row_number() OVER (PARTITION BY location, season_year ORDER BY week) AS i FROM p),
b AS (SELECT *, i - row_number() OVER (PARTITION BY location, season_year ORDER BY week) AS g FROM a WHERE up)
SELECT location, season_year, min(week) AS onset, max(week) AS "offset", count(*) AS n FROM b GROUP BY location, season_year, g HAVING count(*) >= 2""")
def onset_runs(spark, d):
    rows = base.weekly(spark, d).withColumn("m", F.percentile("y", F.lit(0.5)).over(Window.partitionBy("location")))
    return features.runs(rows, F.col("y") > F.col("m"), ["location", "season_year"])


@query(f"WITH {PANEL} SELECT location, week, round(max(y) OVER w, 6) AS max_so_far, round(sum(y) OVER w, 6) AS sum_so_far, round(quantile_cont(y, 0.5) OVER w, 6) AS median_so_far FROM p WINDOW w AS (PARTITION BY location, season_year ORDER BY week ROWS UNBOUNDED PRECEDING)")
def season_so_far(spark, d):
    rows = features.so_far(base.weekly(spark, d), "y", ["location", "season_year"])
    return rounded(rows.select("location", "week", "max_so_far", "sum_so_far", "median_so_far"), "max_so_far", "sum_so_far", "median_so_far")


@query(f"WITH {PANEL}, a AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY week DESC) - 1 AS age FROM p) SELECT location, round(sum(pow(0.9, age) * z) / sum(pow(0.9, age)), 6) AS mean FROM a GROUP BY 1")
def ewma_mean(spark, d):
    rows = base.logged(spark, d).withColumn("age", F.row_number().over(Window.partitionBy("location").orderBy(F.desc("week"))) - 1)
    return rounded(rows.groupBy("location").agg(features.weighted_recent(F.col("z"), F.col("age"), 0.9).alias("mean")), "mean")


@query(f"""WITH {SEASONAL}, l AS (SELECT max(origin) AS origin FROM o), pr AS (SELECT woy, s FROM sp JOIN l USING (origin)),
r AS (SELECT location, season_year, woy, z - avg(z) OVER (PARTITION BY location) AS r FROM p),
j AS (SELECT r.*, phi, s FROM r CROSS JOIN (SELECT unnest(range(-3, 4))::INTEGER AS phi) JOIN pr ON pr.woy = (r.woy + phi - 1 + 52) % 52 + 1),
f AS (SELECT season_year, phi, sum(r * s) AS xy, sum(s * s) AS xx, sum(r * r) AS yy FROM j GROUP BY 1, 2),
a AS (SELECT *, greatest(0, least(3, CASE WHEN xx > 1e-8 THEN xy / xx ELSE 1 END)) AS amp FROM f),
b AS (SELECT *, yy - 2 * amp * xy + amp * amp * xx AS sse FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY season_year ORDER BY round(sse, 9), phi) AS k FROM b)
SELECT season_year, phi, round(amp, 6) AS amplitude, round(sse, 6) AS sse FROM c WHERE k = 1""")
def drift_search(spark, d):
    h = _history(spark, d)
    last = base.origins(spark, d).agg(F.max("origin").alias("origin"))
    profile = profiles.seasonal(h, ["origin"]).join(F.broadcast(last), "origin").select("woy", "s")
    rows = base.logged(spark, d).withColumn("r", F.col("z") - F.avg("z").over(Window.partitionBy("location")))
    return rounded(features.drift(rows, profile, ["season_year"], range(-3, 4)), "amplitude", "sse")


# diagnostics

@query(f"""WITH {PANEL}, a AS (SELECT *, z - avg(z) OVER (PARTITION BY location) AS dd FROM p), b AS (SELECT location, k AS lag, dd, lag(dd, k) OVER (PARTITION BY location, k ORDER BY week) AS ld FROM a, (SELECT unnest(range(1, 9))::INTEGER AS k))
SELECT location, lag, round(sum(dd * ld) / sum(dd * dd), 6) AS acf FROM b GROUP BY 1, 2""")
def acf_lags(spark, d):
    return rounded(diagnostics.autocorrelation(base.logged(spark, d), ["location"], "z", 8), "acf")


@query(f"WITH {PANEL} SELECT x.location AS a, y.location AS b, round(corr(x.z, y.z), 6) AS corr, count(*) AS n FROM p x JOIN p y ON x.week = y.week AND x.location < y.location GROUP BY 1, 2")
def corr_matrix(spark, d):
    return rounded(diagnostics.correlations(base.logged(spark, d), "z"), "corr")


@query(f"WITH {PANEL}, c AS (SELECT x.location, y.location AS other, corr(x.z, y.z) AS r FROM p x JOIN p y ON x.week = y.week AND x.location <> y.location GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY round(r, 9) DESC, other) AS i FROM c) SELECT location, other AS nearest, round(r, 6) AS corr FROM k WHERE i = 1")
def nearest_location(spark, d):
    return rounded(diagnostics.nearest(base.logged(spark, d), "z"), "corr")


@query(f"WITH {PANEL}, g AS (SELECT location, season_year, avg(y) AS m, var_samp(y) AS v FROM p GROUP BY 1, 2 HAVING count(*) >= 8 AND avg(y) > 0 AND var_samp(y) > 0) SELECT round(regr_slope(ln(v), ln(m)), 6) AS exponent, round(regr_intercept(ln(v), ln(m)), 6) AS intercept, count(*) AS n FROM g")
def taylor_power(spark, d):
    return rounded(diagnostics.power_law(base.weekly(spark, d), ["location", "season_year"], "y"), "exponent", "intercept")


@query(f"""WITH {PANEL}, g AS (SELECT location, k, y, CASE WHEN k = 0 THEN ln(y) ELSE (pow(y, k / 50.0) - 1) / (k / 50.0) END AS t FROM p, (SELECT unnest(range(-30, 51))::INTEGER AS k) WHERE y > 0),
f AS (SELECT location, k, -count(*) / 2.0 * ln(var_pop(t)) + (k / 50.0 - 1) * sum(ln(y)) AS ll FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY round(ll, 6) DESC, k) AS i FROM f)
SELECT location, k / 50.0 AS power, round(ll, 4) AS loglik FROM r WHERE i = 1""")
def boxcox_grid(spark, d):
    return rounded(diagnostics.box_cox(base.weekly(spark, d), ["location"], "y", list(range(-30, 51))), "loglik", digits=4)


@query(f"WITH {PANEL}, c AS (SELECT quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS q FROM p) SELECT (len(list_filter(q, lambda x: y > x)) + 1)::INTEGER AS bin, count(*) AS n, round(avg(y), 6) AS mean FROM p, c GROUP BY 1")
def quintile_bins(spark, d):
    return rounded(diagnostics.bins(base.weekly(spark, d), "y").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")), "mean")


@query(f"WITH {PANEL}, l AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY t DESC) AS b FROM p QUALIFY b <= 26) SELECT x.location, round(quantile_cont((y.z - x.z) / (y.t - x.t), 0.5), 8) AS slope FROM l x JOIN l y ON x.location = y.location AND x.t < y.t GROUP BY 1")
def theil_sen(spark, d):
    return rounded(diagnostics.theil_sen(base.logged(spark, d), ["location"], "z", "t", 26), "slope", digits=8)


@query(f"WITH {PANEL} SELECT location, floor(y / 0.5)::BIGINT AS bin, count(*) AS n FROM p GROUP BY 1, 2")
def histogram(spark, d):
    return base.weekly(spark, d).groupBy("location", F.floor(F.col("y") / 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PANEL}, s AS (SELECT location, season_year, sum(y) AS total, max(y) AS peak, arg_max(week, y) AS peak_week, count(*) AS weeks FROM p GROUP BY 1, 2 HAVING count(*) >= 40) SELECT location, season_year, round(total, 6) AS total, round(peak, 6) AS peak, peak_week, weeks FROM s")
def season_totals(spark, d):
    rows = base.weekly(spark, d).groupBy("location", "season_year").agg(F.sum("y").alias("total"), F.max("y").alias("peak"), F.max_by("week", "y").alias("peak_week"), F.count(F.lit(1)).alias("weeks"))
    return rounded(rows.filter("weeks >= 40"), "total", "peak")


# fits

@query(f"WITH {PANEL}, {ORIGINS}, {AR1} SELECT origin, location, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sd, 6) AS sd, n, round(last, 6) AS last FROM fit1")
def ar1_fit(spark, d):
    lagged = features.lags(base.logged(spark, d), "z", 1, ["location"])
    return rounded(fit.ar1(panel.expanding(lagged, base.origins(spark, d)), ["origin", "location"]).drop("last_week"), "slope", "intercept", "sd", "last")


@query(f"WITH {PANEL}, {ORIGINS}, {AR1}, pl AS (SELECT origin, regr_slope(z, lag1) AS ps, regr_intercept(z, lag1) AS pi FROM lagged, o WHERE week <= origin GROUP BY 1) SELECT origin, location, round(0.4 * slope + 0.6 * ps, 6) AS slope, round(0.4 * intercept + 0.6 * pi, 6) AS intercept FROM fit1 JOIN pl USING (origin)")
def ar1_pooled_blend(spark, d):
    rows = panel.expanding(features.lags(base.logged(spark, d), "z", 1, ["location"]), base.origins(spark, d))
    out = fit.blend(fit.ar1(rows, ["origin", "location"]), fit.ar1(rows, ["origin"]), 0.6, ["origin"], ["slope", "intercept"])
    return rounded(out.select("origin", "location", "slope", "intercept"), "slope", "intercept")


@query(f"WITH {PANEL}, {ORIGINS}, {AR1}, v AS (SELECT origin, location, slope, sd * sd / n AS var FROM fit1), t AS (SELECT *, greatest(var_samp(slope) OVER w - avg(var) OVER w, 1e-8) AS tau, avg(var) OVER w AS vb, avg(slope) OVER w AS m FROM v WINDOW w AS (PARTITION BY origin)) SELECT origin, location, round(m + tau / (tau + vb) * (slope - m), 6) AS shrunk FROM t")
def js_shrink(spark, d):
    fits = fit.ar1(panel.expanding(features.lags(base.logged(spark, d), "z", 1, ["location"]), base.origins(spark, d)), ["origin", "location"])
    rows = fits.withColumn("var", F.col("sd") * F.col("sd") / F.col("n"))
    return rounded(fit.shrunk(rows, "slope", "var", ["origin"]).select("origin", "location", "shrunk"), "shrunk")


SERIES = f"{PANEL}, sr AS (SELECT location, z, row_number() OVER (PARTITION BY location ORDER BY week) AS i FROM p)"


@query(f"""WITH RECURSIVE {SERIES}, f AS (SELECT location, alpha, 1::BIGINT AS i, z AS level, 0.0::DOUBLE AS sse FROM sr, (SELECT unnest(range(1, 10)) / 10.0 AS alpha) WHERE i = 1
UNION ALL SELECT f.location, alpha, sr.i, level + alpha * (z - level), sse + (z - level) * (z - level) FROM f JOIN sr ON sr.location = f.location AND sr.i = f.i + 1),
e AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY i DESC, round(sse, 9), alpha) AS k FROM f WHERE i = (SELECT max(i) FROM sr s WHERE s.location = f.location))
SELECT location, alpha::DOUBLE AS alpha, round(level, 6) AS level, round(sse, 6) AS sse FROM e WHERE k = 1""")
def ses_fit(spark, d):
    fits = fit.smoothing(fit.in_order(base.logged(spark, d), ["location"]), [k / 10 for k in range(1, 10)])
    return rounded(fit.best(fits, ["location"], ["alpha"], ["level"]), "level", "sse")


@query(f"""WITH RECURSIVE {SERIES}, g AS (SELECT a.v / 10.0 AS alpha, b.v / 10.0 AS beta, c.v / 10.0 AS phi FROM (VALUES (2), (5), (8)) a(v), (VALUES (1), (3)) b(v), (VALUES (8), (10)) c(v)),
f AS (SELECT sr.location, alpha, beta, phi, 1::BIGINT AS i, sr.z AS level, s2.z - sr.z AS trend, 0.0::DOUBLE AS sse FROM sr JOIN sr s2 ON s2.location = sr.location AND s2.i = 2, g WHERE sr.i = 1
UNION ALL SELECT f.location, alpha, beta, phi, sr.i, level + phi * trend + alpha * (z - level - phi * trend), beta * (phi * trend + alpha * (z - level - phi * trend)) + (1 - beta) * phi * trend, sse + (z - level - phi * trend) * (z - level - phi * trend) FROM f JOIN sr ON sr.location = f.location AND sr.i = f.i + 1),
e AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY round(sse, 9), alpha, beta, phi) AS k FROM f WHERE i = (SELECT max(i) FROM sr s WHERE s.location = f.location))
SELECT location, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, phi::DOUBLE AS phi, round(level, 6) AS level, round(trend, 6) + 0.0 AS trend, round(sse, 6) AS sse FROM e WHERE k = 1""")
def holt_filter(spark, d):
    grid = [(a / 10, b / 10, c / 10) for a in (2, 5, 8) for b in (1, 3) for c in (8, 10)]
    fits = fit.holt(fit.in_order(base.logged(spark, d), ["location"]), grid)
    return rounded(fit.best(fits, ["location"], ["alpha", "beta", "phi"], ["level", "trend"]), "level", "trend", "sse")


@query(f"WITH {PANEL}, s AS (SELECT location, week, z, z - lag(z) OVER (PARTITION BY location ORDER BY week) AS s FROM p) SELECT location, round(arg_max(z, week), 6) AS last, round(avg(s), 8) + 0.0 AS drift, round(sqrt(avg(s * s)), 6) AS sd, count(s) AS n FROM s GROUP BY 1")
def rw_drift(spark, d):
    return rounded(rounded(fit.random_walk(base.logged(spark, d), ["location"]), "last", "sd"), "drift", digits=8)


# forecasts, scores, ensembles


@query(f"WITH {FORECASTS} SELECT model, location, origin, horizon, target_week, level, round(value, 6) AS value FROM f")
def forecast_quantiles(spark, d):
    return rounded(base.forecasts(spark, d), "value")


@query(f"WITH {FORECASTS} SELECT model, location, origin, horizon, target_week, level, round(value, 6) AS value FROM f WHERE model = 'climate'")
def climatology_quantiles(spark, d):
    return rounded(base.climate_table(spark, d), "value")


@query(f"WITH {FORECASTS}, {SCORES} SELECT model, location, origin, horizon, target_week, round(wis + 1e-9, 6) AS wis, round(dispersion + 1e-9, 6) AS dispersion, round(overprediction + 1e-9, 6) AS overprediction, round(underprediction + 1e-9, 6) AS underprediction, n_quantiles FROM sc")
def wis_score(spark, d):
    return rounded(scoring.scored(base.forecasts(spark, d), base.truth(spark, d)), "wis", "dispersion", "overprediction", "underprediction", nudge=1e-9)


@query(f"WITH {FORECASTS}, {SCORES} SELECT location, round(avg(wis), 6) AS wis, count(*) AS n FROM sc WHERE model = 'ar1' GROUP BY 1")
def ar1_forecast_wis(spark, d):
    scores = scoring.scored(base.ar1_table(spark, d), base.truth(spark, d))
    return rounded(scores.groupBy("location").agg(F.avg("wis").alias("wis"), F.count(F.lit(1)).alias("n")), "wis")


@query(f"WITH {FORECASTS}, {SCORES} SELECT model, round(avg(wis), 6) AS wis, round(stddev_samp(wis), 6) AS sd, count(*) AS n FROM sc GROUP BY 1")
def wis_summary(spark, d):
    scores = scoring.scored(base.forecasts(spark, d), base.truth(spark, d))
    return rounded(scores.groupBy("model").agg(F.avg("wis").alias("wis"), F.stddev_samp("wis").alias("sd"), F.count(F.lit(1)).alias("n")), "wis", "sd")


@query(f"WITH {FORECASTS}, {PAIRS}, l AS (SELECT model, location, origin, horizon, 2 * avg(CASE WHEN ln(1 + truth) < ln(1 + value) THEN (1 - level / 1000.0) * (ln(1 + value) - ln(1 + truth)) ELSE level / 1000.0 * (ln(1 + truth) - ln(1 + value)) END) AS w, 2 * avg(CASE WHEN truth < value THEN (1 - level / 1000.0) * (value - truth) ELSE level / 1000.0 * (truth - value) END) AS n FROM ft GROUP BY 1, 2, 3, 4), m AS (SELECT model, avg(w) AS w, avg(n) AS n FROM l GROUP BY 1) SELECT model, round(n, 6) AS natural_wis, round(w, 6) AS log_wis, row_number() OVER (ORDER BY n, model)::INTEGER AS natural_rank, row_number() OVER (ORDER BY w, model)::INTEGER AS log_rank FROM m")
def wis_log_compare(spark, d):
    f, t = base.forecasts(spark, d), base.truth(spark, d)
    rows = scoring.both_scales(f, t, ["model"])
    return rounded(selection.ranked(selection.ranked(rows, "natural_wis", "natural_rank"), "log_wis", "log_rank"), "natural_wis", "log_wis")


_COVER = "e AS (SELECT model, location, origin, horizon, max(truth) AS truth, max(CASE WHEN level = 250 THEN value END) AS l50, max(CASE WHEN level = 750 THEN value END) AS u50, max(CASE WHEN level = 25 THEN value END) AS l95, max(CASE WHEN level = 975 THEN value END) AS u95 FROM ft GROUP BY 1, 2, 3, 4)"


@query(f"WITH {FORECASTS}, {PAIRS}, {_COVER} SELECT model, horizon, round(avg(CASE WHEN truth BETWEEN l50 AND u50 THEN 1.0 ELSE 0.0 END), 6) AS cover50, round(avg(CASE WHEN truth BETWEEN l95 AND u95 THEN 1.0 ELSE 0.0 END), 6) AS cover95, count(*) AS n FROM e GROUP BY 1, 2")
def coverage_levels(spark, d):
    f, t = base.forecasts(spark, d), base.truth(spark, d)
    return rounded(scoring.covered_levels(f, t, {"cover50": (250, 750), "cover95": (25, 975)}, ["model", "horizon"]), "cover50", "cover95")


@query(f"WITH {FORECASTS}, {PAIRS} SELECT model, location, round(avg(value - truth), 6) + 0.0 AS bias, round(avg(ln(1 + value) - ln(1 + truth)), 6) + 0.0 AS log_bias, count(*) AS n FROM ft WHERE level = 500 GROUP BY 1, 2")
def bias_median(spark, d):
    return rounded(scoring.bias(base.forecasts(spark, d), base.truth(spark, d), ["model", "location"]), "bias", "log_bias")


@query(f"WITH {FORECASTS}, {SCORES} SELECT model, horizon, round(avg(overprediction), 6) AS over, round(avg(underprediction), 6) AS under FROM sc GROUP BY 1, 2")
def asymmetry(spark, d):
    scores = scoring.scored(base.forecasts(spark, d), base.truth(spark, d))
    return rounded(scores.groupBy("model", "horizon").agg(F.avg("overprediction").alias("over"), F.avg("underprediction").alias("under")), "over", "under")


@query(f"WITH {FORECASTS}, {SCORES} " + " UNION ALL ".join(f"SELECT model, '{c}' AS dimension, CAST({c} AS VARCHAR) AS member, round(avg(wis), 6) AS wis, count(*) AS n FROM sc GROUP BY model, {c}" for c in ("horizon", "location", "origin")))
def breakdown_grouping_sets(spark, d):
    return rounded(scoring.breakdown(scoring.scored(base.forecasts(spark, d), base.truth(spark, d)), ["horizon", "location", "origin"]), "wis")


_ENS = "SELECT 'ensemble' AS model, location, origin, horizon, target_week, level, round({}, 6) AS value FROM f {} GROUP BY location, origin, horizon, target_week, level"
_ENS_COLUMNS = ["model", "location", "origin", "horizon", "target_week", "level", "value"]


@query(f"WITH {FORECASTS} " + _ENS.format("avg(value)", ""))
def ensemble_mean(spark, d):
    return rounded(quantiles.ensemble(base.forecasts(spark, d)).select(*_ENS_COLUMNS), "value")


@query(f"WITH {FORECASTS} " + _ENS.format("quantile_cont(value, 0.5)", ""))
def ensemble_median(spark, d):
    return rounded(quantiles.ensemble(base.forecasts(spark, d), "median").select(*_ENS_COLUMNS), "value")


@query(f"WITH {FORECASTS}, {SCORES}, wt AS (SELECT model, 1 / avg(wis) AS w FROM sc GROUP BY 1) " + _ENS.format("sum(w * value) / sum(w)", "JOIN wt USING (model)"))
def ensemble_weighted(spark, d):
    f = base.forecasts(spark, d)
    weights = scoring.scored(f, base.truth(spark, d)).groupBy("model").agg((1 / F.avg("wis")).alias("weight"))
    return rounded(quantiles.ensemble(f, "weighted", weights=weights).select(*_ENS_COLUMNS), "value")


_GRID = [0.6, 0.8, 1.0, 1.2, 1.4]
WIDTH = f"""md AS (SELECT *, max(CASE WHEN level = 500 THEN value END) OVER (PARTITION BY model, location, origin, horizon) AS med FROM f),
wg AS (SELECT horizon, width, avg(CASE WHEN ln(1 + truth) < x THEN (1 - level / 1000.0) * (x - ln(1 + truth)) ELSE level / 1000.0 * (ln(1 + truth) - x) END) AS loss FROM (SELECT md.*, truth, width, ln(1 + med) + width * (ln(1 + value) - ln(1 + med)) AS x FROM md JOIN truth USING (location, target_week), (SELECT unnest({_GRID})::DOUBLE AS width)) GROUP BY 1, 2),
wb AS (SELECT horizon, width FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(loss, 9), width) AS k FROM wg) WHERE k = 1),
sh AS (SELECT horizon, avg(ln(1 + truth) - ln(1 + value)) AS shift FROM f JOIN truth USING (location, target_week) WHERE level = 500 GROUP BY 1)"""


@query(f"WITH {FORECASTS}, {WIDTH} SELECT horizon, width FROM wb")
def width_grid_search(spark, d):
    return quantiles.fit_width(base.forecasts(spark, d), base.truth(spark, d), _GRID)


@query(f"WITH {FORECASTS}, {WIDTH} SELECT model, location, origin, horizon, target_week, level, round(greatest(exp(ln(1 + med) + shift + width * (ln(1 + value) - ln(1 + med))) - 1, 0), 6) AS value FROM md JOIN wb USING (horizon) JOIN sh USING (horizon)")
def recalibrate(spark, d):
    f, t = base.forecasts(spark, d), base.truth(spark, d)
    return rounded(quantiles.recalibrated(f, quantiles.fit_shift(f, t, ["horizon"]), quantiles.fit_width(f, t, _GRID)), "value")


_SEASON = "(CASE WHEN month({0}) >= 10 THEN year({0}) ELSE year({0}) - 1 END)::INTEGER"


@query(f"WITH {FORECASTS}, {PAIRS}, e AS (SELECT model, horizon, {_SEASON.format('origin')} AS season_year, ln(1 + truth) - ln(1 + value) AS e FROM ft WHERE level = 500), s AS (SELECT model, horizon, season_year, sum(e) AS s, count(*) AS n FROM e GROUP BY 1, 2, 3), a AS (SELECT *, sum(s) OVER w AS ts, sum(n) OVER w AS tn FROM s WINDOW w AS (PARTITION BY model, horizon)) SELECT model, horizon, season_year, round((ts - s) / (tn - n), 6) + 0.0 AS shift FROM a WHERE tn > n")
def loso_bias(spark, d):
    rows = base.forecasts(spark, d).filter("level = 500").join(base.truth(spark, d), ["location", "target_week"])
    sums = rows.groupBy("model", "horizon", calendar.season_year(F.col("origin")).alias("season_year")).agg(F.sum(F.log1p("truth") - F.log1p("value")).alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model", "horizon")
    rest = (F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))
    out = sums.withColumns({"shift": F.when(F.sum("n").over(w) > F.col("n"), rest)}).filter("shift IS NOT NULL")
    return rounded(out.select("model", "horizon", "season_year", "shift"), "shift")


def _conformal_parts(spark, d):
    points = base.ar1_table(spark, d).filter("level = 500").select("location", "origin", "horizon", "target_week", F.log(F.greatest("value", F.lit(1e-4))).alias("point"))
    known = base.truth(spark, d).join(F.broadcast(base.origins(spark, d).select("origin")), F.col("target_week") <= F.col("origin")).select("location", "origin", "target_week", F.col("truth").alias("value"))
    return points, quantiles.conformal_pool(points, known, "log")


CONF = f"""pt AS (SELECT location, origin, horizon, target_week, ln(greatest(value, 1e-4)) AS point FROM f WHERE model = 'ar1' AND level = 500),
mt AS (SELECT pt.*, min(o.origin) AS mature, ln(greatest(any_value(truth), 1e-4)) - point AS error FROM pt JOIN truth USING (location, target_week) JOIN o ON o.origin >= pt.target_week GROUP BY ALL),
pool AS (SELECT o.origin, horizon, error FROM mt JOIN o ON o.origin >= mature)"""
CONF = CONF.replace("SELECT pt.*, min(o.origin) AS mature, ln(greatest(any_value(truth), 1e-4)) - point AS error FROM pt JOIN truth USING (location, target_week) JOIN o ON o.origin >= pt.target_week GROUP BY ALL", "SELECT pt.location, pt.origin, pt.horizon, pt.point, min(o.origin) AS mature, ln(greatest(any_value(truth), 1e-4)) - pt.point AS error FROM pt JOIN truth USING (location, target_week) JOIN o ON o.origin >= pt.target_week GROUP BY pt.location, pt.origin, pt.horizon, pt.point")


@query(f"WITH {FORECASTS}, {CONF} SELECT origin, horizon, count(*) AS n, round(quantile_cont(error, 0.1), 6) + 0.0 AS q10, round(quantile_cont(error, 0.5), 6) + 0.0 AS q50, round(quantile_cont(error, 0.9), 6) + 0.0 AS q90 FROM pool GROUP BY 1, 2")
def conformal_pool(spark, d):
    _, pool = _conformal_parts(spark, d)
    q = lambda x: F.percentile("error", F.lit(x))
    return rounded(pool.groupBy("origin", "horizon").agg(F.count(F.lit(1)).alias("n"), q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90")), "q10", "q50", "q90")


@query(f"""WITH {FORECASTS}, {CONF}, pn AS (SELECT origin, horizon, count(*) AS n FROM pool GROUP BY 1, 2), pq AS (SELECT origin, horizon, unnest({LEVELS}) AS level, unnest(quantile_cont(error, {[k / 1000 for k in LEVELS]})) AS e FROM pool GROUP BY 1, 2)
SELECT pt.location, pt.origin, pt.horizon, pt.target_week, f.level, round(greatest(exp(CASE WHEN n >= 10 THEN point + e ELSE ln(greatest(f.value, 1e-4)) END), 0), 6) AS value, coalesce(n, 0) >= 10 AS calibrated
FROM pt JOIN f ON f.model = 'ar1' AND f.location = pt.location AND f.origin = pt.origin AND f.horizon = pt.horizon LEFT JOIN pn ON pn.origin = pt.origin AND pn.horizon = pt.horizon LEFT JOIN pq ON pq.origin = pt.origin AND pq.horizon = pt.horizon AND pq.level = f.level""")
def conformal_forecast(spark, d):
    points, pool = _conformal_parts(spark, d)
    fallback = base.ar1_table(spark, d).select("location", "origin", "horizon", "level", F.log(F.greatest("value", F.lit(1e-4))).alias("value"))
    return rounded(quantiles.conformal(points, pool, fallback, "log"), "value")


@query(f"WITH {FORECASTS}, {SCORES}, m AS (SELECT model, horizon, avg(wis) AS w FROM sc GROUP BY 1, 2), w AS (SELECT model, max(CASE WHEN horizon = 1 THEN w END) AS h1, max(CASE WHEN horizon = 2 THEN w END) AS h2, max(CASE WHEN horizon = 3 THEN w END) AS h3, max(CASE WHEN horizon = 4 THEN w END) AS h4 FROM m GROUP BY 1), t AS (SELECT model, avg(wis) AS a FROM sc GROUP BY 1) SELECT c.h1 <= b.h1 * 1.01 AND c.h2 <= b.h2 * 1.01 AND (c.h3 < b.h3 OR c.h4 < b.h4) AND tc.a <= tb.a AS accepted, round(tb.a, 6) AS base_wis, round(tc.a, 6) AS candidate_wis FROM w b, w c, t tb, t tc WHERE b.model = 'walk' AND c.model = 'ar1' AND tb.model = 'walk' AND tc.model = 'ar1'")
def net_positive(spark, d):
    scores = scoring.scored(base.forecasts(spark, d), base.truth(spark, d))
    return rounded(selection.net_positive(scores, "walk", "ar1"), "base_wis", "candidate_wis")


_COMP = "l AS (SELECT model, max(w) AS wl FROM (SELECT model, location, avg(wis) AS w FROM sc GROUP BY 1, 2) GROUP BY 1), g AS (SELECT model, max(w) AS wo, stddev_samp(w) / avg(w) AS cv FROM (SELECT model, origin, avg(wis) AS w FROM sc GROUP BY 1, 2) GROUP BY 1), t AS (SELECT model, avg(wis) AS m FROM sc GROUP BY 1), cp AS (SELECT model, m AS mean_wis, cv, wl / m - 1 AS worst_location, wo / m - 1 AS worst_origin, m * (1 + 0.5 * (cv + wl / m - 1 + wo / m - 1)) AS composite FROM t JOIN l USING (model) JOIN g USING (model))"


@query(f"WITH {FORECASTS}, {SCORES}, {_COMP} SELECT model, round(mean_wis, 6) AS mean_wis, round(cv, 6) AS cv, round(worst_location, 6) AS worst_location, round(worst_origin, 6) AS worst_origin, round(composite, 6) AS composite, row_number() OVER (ORDER BY composite, model)::INTEGER AS rank FROM cp")
def composite_rank(spark, d):
    rows = selection.composite(scoring.scored(base.forecasts(spark, d), base.truth(spark, d)))
    return rounded(selection.ranked(rows, "composite"), "mean_wis", "cv", "worst_location", "worst_origin", "composite")


@query(f"WITH {FORECASTS}, {SCORES}, {_COMP}, r AS (SELECT model, row_number() OVER (ORDER BY mean_wis, model) AS a, row_number() OVER (ORDER BY composite, model) AS b FROM cp) SELECT model, a::INTEGER AS mean_rank, b::INTEGER AS composite_rank, a <> b AS changed FROM r")
def rank_changed(spark, d):
    rows = selection.composite(scoring.scored(base.forecasts(spark, d), base.truth(spark, d)))
    both = selection.ranked(selection.ranked(rows, "mean_wis", "mean_rank"), "composite", "composite_rank")
    return both.select("model", "mean_rank", "composite_rank", (F.col("mean_rank") != F.col("composite_rank")).alias("changed"))


@query(f"WITH {FORECASTS}, {SCORES}, x AS (SELECT model, origin, avg(wis) AS w FROM sc GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY w DESC, origin DESC) AS k FROM x) SELECT model, origin, round(w, 6) AS worst_wis FROM r WHERE k = 1")
def worst_origin(spark, d):
    return rounded(selection.worst(scoring.scored(base.forecasts(spark, d), base.truth(spark, d)), "origin"), "worst_wis")


@query(f"WITH {FORECASTS}, {SCORES}, w AS (SELECT origin, avg(CASE WHEN model = 'ar1' THEN wis END) AS ar1, avg(CASE WHEN model = 'climate' THEN wis END) AS climate, avg(CASE WHEN model = 'walk' THEN wis END) AS walk FROM sc GROUP BY 1) SELECT origin, round(ar1 + 1e-9, 6) AS ar1, round(climate + 1e-9, 6) AS climate, round(walk + 1e-9, 6) AS walk, round(list_avg(list_filter([ar1, climate, walk], lambda x: x IS NOT NULL)) + 1e-9, 6) AS mean FROM w")
def pivot_wis(spark, d):
    return rounded(selection.wide(scoring.scored(base.forecasts(spark, d), base.truth(spark, d)), ["ar1", "climate", "walk"]), "ar1", "climate", "walk", "mean", nudge=1e-9)


@query(f"WITH {FORECASTS} SELECT model, location, origin, horizon, target_week FROM f WHERE level = 500 AND NOT EXISTS (SELECT 1 FROM truth WHERE truth.location = f.location AND truth.target_week = f.target_week)")
def missing_truth(spark, d):
    return scoring.missing_truth(base.forecasts(spark, d), base.truth(spark, d))


@query(f"WITH {FORECASTS}, e AS (SELECT DISTINCT week AS origin FROM p WHERE t >= 150), g AS (SELECT DISTINCT origin FROM f) SELECT origin, 'missing' AS side FROM e WHERE origin NOT IN (SELECT origin FROM g) UNION ALL SELECT origin, 'extra' FROM g WHERE origin NOT IN (SELECT origin FROM e WHERE origin IS NOT NULL)")
def coverage_gap_anti(spark, d):
    expected = base.weekly(spark, d).filter("t >= 150").select(F.col("week").alias("origin"))
    return validation.coverage_gaps(expected, base.forecasts(spark, d), ["origin"])


_FILE = "tb AS (SELECT model AS file, CASE WHEN model = 'walk' THEN NULL ELSE origin END AS file_origin, location, origin, horizon, target_week, 'ili perc' AS target, 'quantile' AS output_type, level, CASE WHEN model = 'climate' AND level = 990 AND horizon = 4 THEN -1.0 WHEN model = 'climate' AND level = 10 AND horizon = 1 THEN 1e9 ELSE value END AS value FROM f JOIN (SELECT max(origin) AS mo FROM o) ON origin = mo WHERE NOT (model = 'ar1' AND location = 'N' AND horizon = 2 AND level = 500) AND NOT (model = 'ar1' AND location = 'R'))"


@query(f"""WITH {FORECASTS}, {_FILE}
SELECT DISTINCT file, 'file name' AS rule, file AS detail FROM tb WHERE file_origin IS NULL
UNION ALL SELECT DISTINCT 'ar1', 'missing location', 'R' UNION ALL SELECT DISTINCT 'ar1', 'quantile levels', 'N/2'
UNION ALL SELECT file, 'value', location || '/' || horizon || '/' || level FROM tb WHERE value < 0
UNION ALL SELECT DISTINCT file, 'monotone', location || '/' || horizon FROM (SELECT *, lag(value) OVER (PARTITION BY file, location, horizon ORDER BY level) AS b FROM tb) WHERE value < b - 1e-9""")
def validate_rules(spark, d):
    """The last origin's files with faults put in: no origin in a name, a missing location and level, bad values."""
    last = base.origins(spark, d).agg(F.max("origin").alias("origin"))
    rows = base.forecasts(spark, d).join(F.broadcast(last), "origin").filter("NOT (model = 'ar1' AND location = 'N' AND horizon = 2 AND level = 500) AND NOT (model = 'ar1' AND location = 'R')")
    value = F.expr("CASE WHEN model = 'climate' AND level = 990 AND horizon = 4 THEN -1.0D WHEN model = 'climate' AND level = 10 AND horizon = 1 THEN 1e9D ELSE value END")
    table = rows.select(F.col("model").alias("file"), F.when(F.col("model") != "walk", F.col("origin")).alias("file_origin"), "location", "origin", "horizon", "target_week", F.lit("ili perc").alias("target"), F.lit("quantile").alias("output_type"), "level", value.alias("value"))
    return validation.validate(table, ["A", "N", "R"], HORIZONS, base.origins(spark, d), "ili perc")


@query(f"WITH {FORECASTS}, x AS (SELECT *, lag(value) OVER (PARTITION BY model, location, origin, horizon ORDER BY level) AS b FROM f) SELECT model, count(*) FILTER (WHERE value < b - 1e-9) AS crossings, count(*) AS n FROM x GROUP BY 1")
def quantile_monotone(spark, d):
    b = F.lag("value").over(Window.partitionBy(*quantiles.TASK).orderBy("level"))
    rows = base.forecasts(spark, d).withColumn("b", b)
    return rows.groupBy("model").agg(F.count(F.when(F.col("value") < F.col("b") - 1e-9, 1)).alias("crossings"), F.count(F.lit(1)).alias("n"))


# draws


def _draws(spark, d):
    """Deterministic draws around the panel."""
    rows = base.weekly(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(200))))
    return rows.select("location", "week", (F.col("y") * (1 + 0.3 * F.sin(F.col("k") * 1.7 + F.col("t")))).alias("draw"), "y")


DRAWS = f"{PANEL}, dr AS (SELECT location, week, y * (1 + 0.3 * sin(k * 1.7 + t)) AS draw, y FROM p, (SELECT unnest(range(1, 201)) AS k))"


@query(f"WITH {DRAWS}, q AS (SELECT location, week, any_value(y) * 1.1 AS obs, quantile_cont(draw, [0.05, 0.25, 0.75, 0.95]) AS q FROM dr GROUP BY 1, 2) SELECT location, round(avg(CASE WHEN obs BETWEEN q[2] AND q[3] THEN 1.0 ELSE 0.0 END), 6) AS in50, round(avg(CASE WHEN obs BETWEEN q[1] AND q[4] THEN 1.0 ELSE 0.0 END), 6) AS in90 FROM q GROUP BY 1")
def predictive_coverage(spark, d):
    observed = base.weekly(spark, d).select("location", "week", (F.col("y") * 1.1).alias("observed"))
    rows = diagnostics.predictive_coverage(_draws(spark, d), observed, ["location", "week"])
    return rounded(rows.groupBy("location").agg(F.avg(F.col("in50").cast("double")).alias("in50"), F.avg(F.col("in90").cast("double")).alias("in90")), "in50", "in90")


@query(f"WITH {DRAWS} SELECT location, count(draw) AS n, round(avg(draw), 6) AS mean, round(stddev_samp(draw), 6) AS sd, round(min(draw), 6) AS min, round(max(draw), 6) AS max, round(quantile_cont(draw, 0.5), 6) AS median, round(avg(CASE WHEN draw BETWEEN 0 AND 15 THEN 0.0 ELSE 1.0 END), 6) AS outside, 0.0::DOUBLE AS bad FROM dr GROUP BY 1")
def prior_predictive_summary(spark, d):
    return rounded(diagnostics.summary(_draws(spark, d), "draw", 0.0, 15.0, ["location"]), "mean", "sd", "min", "max", "median", "outside", "bad")


@query(f"WITH {PANEL}, r AS (SELECT location, t, z - avg(z) OVER (PARTITION BY location, woy) AS r FROM p) SELECT location, count(*) AS n, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r), 6) AS sd, round(regr_slope(r, t), 8) + 0.0 AS trend FROM r GROUP BY 1")
def residual_by_location(spark, d):
    rows = base.logged(spark, d).withColumn("r", F.col("z") - F.avg("z").over(Window.partitionBy("location", "woy")))
    return rounded(rounded(rows.groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.regr_slope("r", "t").alias("trend")), "mean", "sd"), "trend", digits=8)


# fits and simulations that SQL can't say: the tests hold them against numpy


def _whole_history(spark, d):
    return panel.expanding(base.logged(spark, d), base.origins(spark, d), strict=True)


def _wide(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot_table(index="week", columns="location", values="z").sort_index().dropna()


@query()
def var_paths(spark, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(pdf)
        b, sd = fit.vector_ridge(wide, 2, 10.0)
        rng = np.random.default_rng(simulate.seed_of(pdf["origin"].iloc[0]))
        paths = simulate.joint_paths(wide.to_numpy(), b, rng.normal(0, sd, (PATHS, 4, len(sd))), 2)
        return pd.DataFrame([(pdf["origin"].iloc[0], name, h + 1, float(np.exp(np.median(paths[:, h, j])))) for j, name in enumerate(wide.columns) for h in range(4)], columns=["origin", "location", "horizon", "median"])

    return _whole_history(spark, d).select("origin", "location", "week", "z").groupBy("origin").applyInPandas(run, "origin date, location string, horizon int, median double")


def _ar_maker(kind: str):
    def make(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        x, target = fit.design(y, 6)
        b, sd = fit.least_squares(x, target)
        noise = simulate.innovations(rng, kind, sd, (PATHS, 4), scale=1.4 if kind == "student" else 1.0, residuals=target - x @ b)
        return simulate.ar_paths(y, b, noise)

    return make


@query()
def gaussian_paths(spark, d):
    return simulate.simulate_each(_whole_history(spark, d), ["origin", "location"], _ar_maker("gaussian"), LEVELS, np.exp)


@query()
def student_t_paths(spark, d):
    return simulate.simulate_each(_whole_history(spark, d), ["origin", "location"], _ar_maker("student"), LEVELS, np.exp)


@query()
def bootstrap_paths(spark, d):
    return simulate.simulate_each(_whole_history(spark, d), ["origin", "location"], _ar_maker("empirical"), LEVELS, np.exp)


@query()
def analogue_paths(spark, d):
    return simulate.simulate_each(_whole_history(spark, d), ["origin", "location"], lambda y, rng: simulate.analogue_paths(y, 8, 4, PATHS, rng), LEVELS, np.exp)


def _nowcast_parts(spark, d):
    """Per location the known series, newest last, with the distributions of the changes of the values still revised."""
    v = base.versions(spark, d)
    rows = vintage.phased(vintage.revisions(v, _cut()), vintage.phases(v))
    known = vintage.as_of(v, _cut()).select("location", "day", "value", F.datediff(_cut(), "day").alias("delay"))
    before = F.lag("value", 3).over(Window.partitionBy("location").orderBy("day"))
    known = known.withColumn("phase", F.when(F.col("value") < before, "falling").otherwise("rising"))
    return known.join(vintage.change_sets(rows, known.select("location", "delay", "phase").distinct()), ["location", "delay", "phase"])


@query()
def nowcast_bootstrap(spark, d):
    """Quantiles of autoregressive paths on the natural scale, each from its own draw of the values that are still revised."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        y, name = pdf["value"].to_numpy(float), pdf["location"].iloc[0]
        rng = np.random.default_rng(simulate.seed_of(name))
        x, target = fit.design(y, 3)
        b, sd = fit.least_squares(x, target)
        changes = [np.array(c) if c is not None and delay < 7 else None for c, delay in zip(pdf["changes"][::-1], pdf["delay"][::-1])]
        paths = simulate.nowcast_paths(y, b, rng.normal(0, sd, (PATHS, 4)), changes, rng)
        q = np.quantile(paths, np.array(LEVELS) / 1000, axis=0)
        return pd.DataFrame([(name, h + 1, level, max(float(q[i, h]), 0.0)) for h in range(4) for i, level in enumerate(LEVELS)], columns=["location", "horizon", "level", "value"])

    return _nowcast_parts(spark, d).groupBy("location").applyInPandas(run, "location string, horizon int, level int, value double")


@query(f"""WITH {REV}, first AS (SELECT location, day, arg_min(value, as_of) AS v FROM ver GROUP BY 1, 2),
ph AS (SELECT * FROM (SELECT location, day, CASE WHEN v >= lag(v, 3) OVER w THEN 'rising' WHEN v < lag(v, 3) OVER w THEN 'falling' END AS phase FROM first WINDOW w AS (PARTITION BY location ORDER BY day)) WHERE phase IS NOT NULL), r AS (SELECT rv.*, phase FROM rv JOIN ph USING (location, day)),
x AS (SELECT location, day, arg_max(value, as_of) AS value, (DATE '{CUT}' - day)::INTEGER AS delay FROM ver WHERE as_of <= DATE '{CUT}' GROUP BY 1, 2), y AS (SELECT *, CASE WHEN value < lag(value, 3) OVER (PARTITION BY location ORDER BY day) THEN 'falling' ELSE 'rising' END AS phase FROM x),
c1 AS (SELECT location, delay, phase, count(*) AS n FROM r GROUP BY 1, 2, 3), c2 AS (SELECT location, delay, count(*) AS n FROM r GROUP BY 1, 2), c3 AS (SELECT delay, count(*) AS n FROM r GROUP BY 1)
SELECT y.location, y.day, y.phase, CASE WHEN c1.n >= 8 THEN 'own' WHEN c2.n >= 8 THEN 'location' WHEN c3.n >= 8 THEN 'pooled' ELSE 'none' END AS tier FROM y LEFT JOIN c1 USING (location, delay, phase) LEFT JOIN c2 USING (location, delay) LEFT JOIN c3 USING (delay)""")
def nowcast_tiers(spark, d):
    """Which distribution of changes each known value draws from."""
    return _nowcast_parts(spark, d).select("location", "day", "phase", "tier")


@query()
def bayes_draws(spark, d):
    rows = panel.expanding(base.logged(spark, d), base.origins(spark, d))
    draws = bayes.project(bayes.fit_splits(rows), 4)
    return draws.groupBy("origin", "location", "horizon").agg(F.avg("latent").alias("mean"), F.stddev_samp("latent").alias("sd"), F.avg((~(F.abs("latent") < float("inf"))).cast("double")).alias("bad"))
