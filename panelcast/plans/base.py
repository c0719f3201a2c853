"""Tables that the queries start from, in Spark and as SQL building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import transforms
from panelcast.functions.distributions import LEVELS, NORMAL
from panelcast.operators import features, fit, panel, quantiles, simulate, vintage
from panelcast.sources.files import read_table

FIRST, HORIZONS = 156, [1, 2, 3, 4]
CUT = "2024-01-24"


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """location, week, y, t, season_year, woy from lineitem."""
    return panel.with_calendar(panel.weekly(read_table(spark, d, "lineitem"), "l_returnflag", "l_shipdate", "l_quantity", 1000.0))


def logged(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d).withColumn("z", transforms.to_scale(F.col("y"), "log"))


def origins(spark: SparkSession, d: str) -> DataFrame:
    """Every week from the FIRST on."""
    return panel.origins(weekly(spark, d), FIRST)


def truth(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d).select("location", F.col("week").alias("target_week"), F.col("y").alias("truth"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    return vintage.triangle(read_table(spark, d, "events"))


def ar1_table(spark: SparkSession, d: str) -> DataFrame:
    lagged = features.lags(logged(spark, d), "z", 1, ["location"])
    fits = panel.latest(fit.ar1_running(lagged, ["location"]), origins(spark, d), ["location"])
    return quantiles.from_normal(simulate.ar1_ahead(fits, HORIZONS), "log", "ar1")


def walk_table(spark: SparkSession, d: str) -> DataFrame:
    fits = panel.latest(fit.random_walk_running(logged(spark, d), ["location"]), origins(spark, d), ["location"])
    rows = fits.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    rows = rows.withColumns({"mean": F.col("last") + F.col("drift") * F.col("horizon"), "sd_h": F.col("sd") * F.sqrt("horizon")})
    return quantiles.from_normal(rows, "log", "walk")


def targets(spark: SparkSession, d: str) -> DataFrame:
    rows = weekly(spark, d).select("location").distinct().crossJoin(F.broadcast(origins(spark, d).select("origin")))  # the grid of what is forecast; weeks are few
    return rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS]))).withColumn("target_week", F.date_add("origin", 7 * F.col("horizon")))


def climate_table(spark: SparkSession, d: str) -> DataFrame:
    rows = quantiles.band_history(weekly(spark, d), targets(spark, d))
    keys = ["location", "origin", "horizon", "target_week"]
    return quantiles.from_sample(rows, keys, F.col("y")).select(F.lit("climate").alias("model"), *keys, "level", "value")


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Three models' quantile tables. The union is read several times by most queries: Spark reuses its exchanges."""
    return ar1_table(spark, d).unionByName(walk_table(spark, d)).unionByName(climate_table(spark, d))


# the same in DuckDB's SQL

_START = "(make_date(sy, 10, 1) + ((6 - dayofweek(make_date(sy, 10, 1)) + 7) % 7)::INTEGER)"


def sql_woy(d: str) -> str:
    sy = f"(CASE WHEN month({d}) >= 10 THEN year({d}) ELSE year({d}) - 1 END)"
    start = f"(make_date({sy}, 10, 1) + ((6 - dayofweek(make_date({sy}, 10, 1)) + 7) % 7)::INTEGER)"
    return f"(trunc(({d} - {start}) / 7.0)::INTEGER + 1)"


PANEL = f"""p0 AS (SELECT l_returnflag AS location, CAST(date_trunc('week', l_shipdate) AS DATE) + 5 AS week, sum(l_quantity) / 1000.0 AS y FROM lineitem GROUP BY 1, 2),
p AS (SELECT location, week, y, dense_rank() OVER (ORDER BY week)::INTEGER AS t, (CASE WHEN month(week) >= 10 THEN year(week) ELSE year(week) - 1 END)::INTEGER AS season_year, {sql_woy('week')} AS woy, ln(greatest(y, 1e-4)) AS z FROM p0)"""
ORIGINS = f"""o AS (SELECT week AS origin, row_number() OVER (ORDER BY week)::INTEGER AS split FROM (SELECT DISTINCT t, week FROM p) WHERE t >= {FIRST})"""
TRUTH = "truth AS (SELECT location, week AS target_week, y AS truth FROM p)"
TRIANGLE = """tri0 AS (SELECT event_type AS location, CAST(ts AS DATE) AS day, CAST(regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1) AS INTEGER) % 8 AS d, sum(value + 0.0) AS v FROM events GROUP BY 1, 2, 3),
ver AS (SELECT location, day, day + d AS as_of, round(sum(v) OVER (PARTITION BY location, day ORDER BY d), 6) AS value FROM tri0)"""
_LEVELS = "lv(level, q) AS (VALUES " + ", ".join(f"({k}, {q!r}::DOUBLE)" for k, q in NORMAL.items()) + ")"
_H = "hz(horizon) AS (VALUES " + ", ".join(f"({h})" for h in HORIZONS) + ")"
AR1 = """lagged AS (SELECT * FROM (SELECT location, week, z, lag(z) OVER (PARTITION BY location ORDER BY week) AS lag1 FROM p) WHERE lag1 IS NOT NULL),
fit1 AS (SELECT origin, location, regr_slope(z, lag1) AS slope, regr_intercept(z, lag1) AS intercept, sqrt(greatest(regr_syy(z, lag1) - regr_slope(z, lag1) * regr_sxy(z, lag1), 0) / greatest(count(*) - 2, 1)) AS sd, count(*) AS n, arg_max(z, week) AS last FROM lagged, o WHERE week <= origin GROUP BY 1, 2)"""
FORECASTS = f"""{PANEL}, {ORIGINS}, {TRUTH}, {_LEVELS}, {_H}, {AR1},
ahead1 AS (SELECT origin, location, horizon, intercept * list_sum(list_transform(range(horizon), lambda i: pow(slope, i))) + pow(slope, horizon) * last AS mean, sd * sqrt(list_sum(list_transform(range(horizon), lambda i: pow(slope, 2 * i)))) AS sd_h FROM fit1, hz),
steps AS (SELECT location, week, z, z - lag(z) OVER (PARTITION BY location ORDER BY week) AS s FROM p),
fit2 AS (SELECT origin, location, arg_max(z, week) AS last, avg(CASE WHEN first = 0 THEN s END) AS drift, sqrt(avg(CASE WHEN first = 0 THEN s * s END)) AS sd FROM (SELECT *, CASE WHEN s IS NULL THEN 1 ELSE 0 END AS first FROM steps), o WHERE week <= origin GROUP BY 1, 2),
ahead2 AS (SELECT origin, location, horizon, last + drift * horizon AS mean, sd * sqrt(horizon) AS sd_h FROM fit2, hz),
tg AS (SELECT origin, location, horizon, origin + 7 * horizon AS target_week FROM o, (SELECT DISTINCT location FROM p), hz),
band AS (SELECT tg.*, p.y FROM tg JOIN p USING (location) WHERE p.week < origin AND abs((((p.woy - 1) % 52) - (({sql_woy('target_week')} - 1) % 52) + 52 + 2) % 52 - 2) <= 2),
f AS (SELECT 'ar1' AS model, location, origin, horizon, origin + 7 * horizon AS target_week, level, greatest(exp(mean + q * sd_h), 0) AS value FROM ahead1, lv
 UNION ALL SELECT 'walk', location, origin, horizon, origin + 7 * horizon, level, greatest(exp(mean + q * sd_h), 0) FROM ahead2, lv
 UNION ALL SELECT 'climate', location, origin, horizon, target_week, unnest({LEVELS}), unnest(quantile_cont(y, {[k / 1000 for k in LEVELS]})) FROM band GROUP BY location, origin, horizon, target_week)"""
PAIRS = "ft AS (SELECT f.*, truth FROM f JOIN truth USING (location, target_week))"
SCORES = f"""{PAIRS},
sc AS (SELECT model, location, origin, horizon, target_week,
  (0.5 * max(CASE WHEN level = 500 THEN abs(truth - value) END) + sum(CASE WHEN level < 500 THEN level / 1000.0 * (m.hi - value) + (CASE WHEN truth < value THEN value - truth ELSE 0 END) + (CASE WHEN truth > m.hi THEN truth - m.hi ELSE 0 END) ELSE 0 END)) / (11 + 0.5) AS wis,
  sum(CASE WHEN level < 500 THEN level / 1000.0 * (m.hi - value) ELSE 0 END) / 11.5 AS dispersion,
  (sum(CASE WHEN level < 500 THEN greatest(value - truth, 0) ELSE 0 END) + 0.5 * max(CASE WHEN level = 500 THEN greatest(value - truth, 0) END)) / 11.5 AS overprediction,
  (sum(CASE WHEN level < 500 THEN greatest(truth - m.hi, 0) ELSE 0 END) + 0.5 * max(CASE WHEN level = 500 THEN greatest(truth - value, 0) END)) / 11.5 AS underprediction, count(*) AS n_quantiles
  FROM ft LEFT JOIN (SELECT model, location, origin, horizon, 1000 - level AS level, value AS hi FROM f WHERE level > 500) m USING (model, location, origin, horizon, level)
  GROUP BY model, location, origin, horizon, target_week)"""


def sql_system(xs: list[str], y: str, weight: str = "1.0", penalties: list[str] | None = None) -> str:
    """Aggregates `m` (augmented Gram matrix as nested lists), `yy`, `sw`, `n` of a weighted regression of y on xs."""
    pen = penalties or ["0.0"] * len(xs)
    cell = lambda i, j: f"sum({weight} * {xs[i]} * {xs[j]})" + (f" + {pen[i]}" if i == j else "")
    rows = ", ".join("[" + ", ".join([*(cell(i, j) for j in range(len(xs))), f"sum({weight} * {xs[i]} * {y})"]) + "]" for i in range(len(xs)))
    return f"[{rows}] AS m, sum({weight} * {y} * {y}) AS yy, sum({weight} * 1.0) AS sw, count(*) AS n"


def sql_solve(name: str, source: str, by: str) -> str:
    """CTEs that solve the systems `m` of source by elimination: name(by, coef)."""
    return f"""{name}_e AS (SELECT {by}, 1 AS k, m FROM {source}
 UNION ALL SELECT {by}, k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k]) ELSE list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM {name}_e WHERE k <= len(m)),
{name} AS (SELECT {by}, list_transform(m, lambda r: r[len(m) + 1]) AS coef FROM {name}_e WHERE k = len(m) + 1)"""


def sql_sse(source: str = "s", coef: str = "coef") -> str:
    """Residual sum of squares of a system without penalties under coef."""
    return f"greatest({source}.yy - list_sum(list_transform(range(1, len({coef}) + 1), lambda i: {coef}[i] * (2 * {source}.m[i][len({coef}) + 1] - list_sum(list_transform(range(1, len({coef}) + 1), lambda j: {source}.m[i][j] * {coef}[j]))))), 0)"
