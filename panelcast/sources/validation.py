"""Rules for forecast files: each rule is a filter or anti-join that gives (file, rule, detail); no rows, no fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions.distributions import LEVELS


def _fault(rows: DataFrame, rule: str, detail) -> DataFrame:
    return rows.select("file", F.lit(rule).alias("rule"), detail.cast("string").alias("detail")).distinct()


def validate(table: DataFrame, locations: list[str], horizons: list[int], origins: DataFrame, target: str, levels: list[int] = LEVELS) -> DataFrame:
    """Faults of a table with file, file_origin, location, origin, horizon, target_week, target, output_type, level, value."""
    wanted = table.sparkSession.createDataFrame([(x,) for x in locations], "location string")
    files = table.select("file").distinct()
    sets = table.groupBy("file", "location", "horizon").agg(F.sort_array(F.collect_list("level")).alias("ls"))
    level_array = F.array(*[F.lit(x) for x in levels])
    by_horizon = table.groupBy("file", "location").agg(F.sort_array(F.collect_set("horizon")).alias("hs"))
    pairs = table.select("file", "location", "horizon", F.col("level").alias("l"), F.col("value").alias("v"))
    before = F.lag("v").over(Window.partitionBy("file", "location", "horizon").orderBy("l"))
    rules = [
        _fault(table.filter(F.col("file_origin").isNull()), "file name", F.col("file")),
        _fault(table.filter(F.col("target") != target), "target", F.col("target")),
        _fault(table.filter(~F.col("location").isin(locations)), "unknown location", F.col("location")),
        _fault(files.crossJoin(F.broadcast(wanted)).join(table, ["file", "location"], "left_anti"), "missing location", F.col("location")),
        _fault(table.filter(~F.col("horizon").isin(horizons)), "horizon", F.col("horizon")),
        _fault(by_horizon.filter(F.size(F.array_except(F.array(*[F.lit(h) for h in horizons]), "hs")) > 0), "horizon coverage", F.col("location")),
        _fault(table.filter(F.col("origin") != F.col("file_origin")), "origin date", F.col("origin")),
        _fault(table.join(F.broadcast(origins.select("origin")), "origin", "left_anti"), "unknown origin", F.col("origin")),
        _fault(table.filter(F.datediff("target_week", "origin") != 7 * F.col("horizon")), "target end date", F.col("target_week")),
        _fault(table.filter(F.col("output_type") != "quantile"), "output type", F.col("output_type")),
        _fault(sets.filter(F.col("ls") != level_array), "quantile levels", F.concat_ws("/", "location", F.col("horizon").cast("string"))),
        _fault(table.filter(F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0)), "value", F.concat_ws("/", "location", F.col("horizon").cast("string"), F.col("level").cast("string"))),
        _fault(pairs.withColumn("b", before).filter("v < b - 1e-9"), "monotone", F.concat_ws("/", "location", F.col("horizon").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, rules)


def coverage_gaps(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: `missing` (expected only) and `extra` (produced only)."""
    e, p = expected.select(*keys).distinct(), produced.select(*keys).distinct()
    return e.join(p, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(p.join(e, keys, "left_anti").withColumn("side", F.lit("extra")))


def complete(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """produced, or an error that counts what is missing."""
    n = coverage_gaps(expected, produced, keys).filter("side = 'missing'").count()
    if n:
        raise ValueError(f"{n} of the expected {', '.join(keys)} are missing")
    return produced


def drift(config: DataFrame, table: DataFrame) -> DataFrame:
    """kind, item, side: locations and horizons that the configuration names and the table lacks, or the other way round."""
    items = lambda c, kind: c.select(F.lit(kind).alias("kind"), F.col("item").cast("string").alias("item"))
    named = items(config.select(F.explode("locations").alias("item")), "location").unionByName(items(config.select(F.explode("horizons").alias("item")), "horizon"))
    there = items(table.select(F.col("location").alias("item")), "location").unionByName(items(table.select(F.col("horizon").alias("item")), "horizon"))
    return coverage_gaps(named, there, ["kind", "item"])


def headers(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Faults (file, rule, detail) of the CSV files below a folder whose first line isn't the columns in their order."""
    wanted = ",".join(columns)
    lines = spark.read.text(f"{folder}/*/*.csv", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.substring_index("value", "\n", 1).alias("line"))
    line = F.regexp_replace(F.trim(F.regexp_replace("line", "\r", "")), '"', "")
    return lines.withColumn("line", line).filter(F.col("line") != wanted).select("file", F.lit("columns").alias("rule"), F.col("line").alias("detail"))
