"""Panels: dense, gap-aware tables keyed by location and week; windows and expanding splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import calendar


def weekly(df: DataFrame, location: str, moment: str, value: str, scale: float = 1.0) -> DataFrame:
    """location, week (the Saturday that ends it), y: sums by week, pre-aggregated before the shuffle."""
    week = F.date_add(F.date_trunc("week", F.col(moment)).cast("date"), 5)
    return df.groupBy(F.col(location).alias("location"), week.alias("week")).agg((F.sum(value) / scale).alias("y"))


def with_calendar(panel: DataFrame) -> DataFrame:
    """Adds season_year, woy and t (place of the week among the weeks of any location)."""
    weeks = panel.select("week").distinct().withColumn("t", F.row_number().over(Window.orderBy("week")))
    return panel.join(F.broadcast(weeks), "week").withColumns({"season_year": calendar.season_year(F.col("week")), "woy": calendar.week_of_season(F.col("week"))})


def trailing(panel: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Rows of the last n weeks that are present (not calendar weeks), of each group in `by`."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    weeks = panel.select(*(by or []), "week").distinct().withColumn("_back", F.row_number().over(w.orderBy(F.desc("week"))))
    return panel.join(F.broadcast(weeks.filter(F.col("_back") <= n).drop("_back")), [*(by or []), "week"])


def dense(panel: DataFrame, n: int, most_delay: int, versions: DataFrame | None = None) -> DataFrame:
    """location x last n weeks, with y left null where it is missing, the delay (from versions where known, else
    the weeks to the last one; capped) and the season's number."""
    last = trailing(panel, n)
    weeks = last.select("week").distinct()
    grid = panel.select("location").distinct().crossJoin(F.broadcast(weeks))  # the panel's cells; its weeks are n
    cells = grid.join(last.select("location", "week", "y"), ["location", "week"], "left")
    end = weeks.agg(F.max("week").alias("end"))
    cells = cells.crossJoin(F.broadcast(end))
    recency = calendar.delay(F.col("week"), F.col("end"), 7, most_delay)
    if versions is not None:
        known = versions.groupBy("location", "week").agg(F.max("as_of").alias("known"))
        cells = cells.join(known, ["location", "week"], "left")
        recency = F.coalesce(calendar.delay(F.col("week"), F.col("known"), 7, most_delay), recency)
    seasons = weeks.select(calendar.season_year(F.col("week")).alias("season_year")).distinct().withColumn("season", F.row_number().over(Window.orderBy("season_year")))
    out = cells.withColumns({"delay": recency, "season_year": calendar.season_year(F.col("week")), "woy": calendar.week_of_season(F.col("week"))})
    return out.join(F.broadcast(seasons), "season_year").select("location", "week", "y", "delay", "woy", "season")


def origins(panel: DataFrame, first: int, held_out: list[int] | None = None, allow_held_out: bool = False) -> DataFrame:
    """origin, split: every week from the first-th on. Seasons that are held out raise unless allowed."""
    known = panel if "t" in panel.columns else with_calendar(panel)
    out = known.select("t", "week", "season_year").distinct().filter(F.col("t") >= first)
    if held_out and not allow_held_out:
        out = out.withColumn("t", F.when(~F.col("season_year").isin(held_out), F.col("t")).otherwise(F.raise_error(F.lit("a held-out season is asked for")).cast("int"))).filter("t IS NOT NULL")
    return out.select(F.col("week").alias("origin"), F.row_number().over(Window.orderBy("week")).alias("split"))


def first_splits(origin_table: DataFrame, n: int) -> DataFrame:
    """The first n origins of each season."""
    season = calendar.season_year(F.col("origin"))
    place = F.row_number().over(Window.partitionBy(season).orderBy("origin"))
    return origin_table.withColumns({"season_year": season, "place": place}).filter(F.col("place") <= n)


def without_leak(history: DataFrame, strict: bool = False, time: str = "week") -> DataFrame:
    """history (origin, time); a row of the origin's future (strict: or of the origin itself) fails the job."""
    fine = F.col(time) < F.col("origin") if strict else F.col(time) <= F.col("origin")
    return history.withColumn(time, F.when(fine, F.col(time)).otherwise(F.raise_error(F.lit("a row from after the origin")).cast("date")))


def current_season(panel: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the latest season of each group."""
    return panel.withColumn("_last", F.max("season_year").over(Window.partitionBy(*by))).filter(F.col("season_year") == F.col("_last")).drop("_last")


def subsample(rows: DataFrame, by: list[str], key: list[str], n: int) -> DataFrame:
    """n rows of each group without replacement, in the order of a hash of their key: the same whatever the partitions."""
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return rows.withColumn("_o", F.row_number().over(Window.partitionBy(*by).orderBy(order, *key))).filter(F.col("_o") <= n).drop("_o")


def expanding(panel: DataFrame, origin_table: DataFrame, strict: bool = False) -> DataFrame:
    """Each origin's history: the weeks up to it (strict: before it). Origins are few, so they are broadcast."""
    upto = F.col("week") < F.col("origin") if strict else F.col("week") <= F.col("origin")
    return panel.join(F.broadcast(origin_table), upto)


def latest(rows: DataFrame, origin_table: DataFrame, by: list[str], time: str = "week") -> DataFrame:
    """Each group's last row up to each origin, with `origin` in place of the time: as-of by a window over the union of
    rows and origins, without a join on a range."""
    columns = [c for c in rows.columns if c not in (*by, time)]
    marks = origin_table.select(F.col("origin").alias(time), F.lit(True).alias("_at"))
    groups = rows.select(*by).distinct()
    grid = groups.crossJoin(F.broadcast(marks)) if by else marks  # groups times origins: what is returned
    both = rows.select(*by, time, F.struct(*columns).alias("_row")).join(grid, [*by, time], "full")
    known = F.last("_row", ignorenulls=True).over(Window.partitionBy(*by).orderBy(time))
    return both.withColumn("_row", known).filter("_at AND _row IS NOT NULL").select(*by, F.col(time).alias("origin"), "_row.*")
