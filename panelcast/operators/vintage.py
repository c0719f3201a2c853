"""Vintages: as-of reads, reporting triangles, revision profiles and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["location", "day"]


def triangle(events: DataFrame, delays: int = 8) -> DataFrame:
    """location, day, as_of, value: an event is known `k mod delays` days after its day; values add up over delays."""
    k = F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1).cast("int") % delays
    cells = events.select(F.col("event_type").alias("location"), F.col("ts").cast("date").alias("day"), k.alias("d"), (F.col("value") + F.lit(0.0)).alias("v"))
    sums = cells.groupBy("location", "day", "d").agg(F.sum("v").alias("v"))
    running = F.sum("v").over(Window.partitionBy(*KEY).orderBy("d"))
    return sums.select("location", "day", F.date_add("day", F.col("d")).alias("as_of"), F.round(running, 6).alias("value"))


def as_of(versions: DataFrame, origin: Column, strict: bool = False, earliest: bool = False) -> DataFrame:
    """Of each reference day the version known at the origin: the latest (or earliest) one. One pre-aggregated group-by;
    strict leaves out versions of the origin's own day."""
    known = versions.filter(F.col("as_of") < origin if strict else F.col("as_of") <= origin)
    pick = F.min_by if earliest else F.max_by
    when = F.min if earliest else F.max
    return known.groupBy(*KEY).agg(pick("value", "as_of").alias("value"), when("as_of").alias("as_of"))


def settled(versions: DataFrame) -> DataFrame:
    """Each version with its day's last value and when that was known."""
    w = Window.partitionBy(*KEY)
    return versions.withColumns({"settled": F.max_by("value", "as_of").over(w), "settled_as_of": F.max("as_of").over(w)})


def revisions(versions: DataFrame, origin: Column, max_delay: int = 12, mode: str = "additive") -> DataFrame:
    """location, day, delay, correction of the versions before the origin that aren't the settled one."""
    known = settled(versions.filter(F.col("as_of") < origin))
    delay = F.datediff("as_of", "day")
    rows = known.filter((F.col("as_of") < F.col("settled_as_of")) & delay.between(0, max_delay))
    if mode == "additive":
        change = F.col("settled") - F.col("value")
    else:
        rows = rows.filter(F.abs("value") >= 1e-6)
        change = F.col("settled") / F.col("value")
    return rows.select("location", "day", delay.alias("delay"), change.alias("change"))


def revision_profile(versions: DataFrame, origin: Column, max_delay: int = 12, mode: str = "additive", stat: str = "median", min_support: int = 5, pooled: bool = False) -> DataFrame:
    """(location,) delay, correction, n: the median or mean change, of groups with enough versions."""
    rows = revisions(versions, origin, max_delay, mode)
    by = ["delay"] if pooled else ["location", "delay"]
    value = F.percentile("change", F.lit(0.5)) if stat == "median" else F.avg("change")
    return rows.groupBy(*by).agg(value.alias("correction"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)


def blended_profile(own: DataFrame, pooled: DataFrame, weight: float) -> DataFrame:
    """location, delay, correction: weight on the location's own value, the rest on the pooled one; where only one
    exists, that one."""
    locations = own.select("location").distinct()
    keys = own.select("location", "delay").union(pooled.select("delay").crossJoin(locations).select("location", "delay")).distinct()
    both = keys.join(own.select("location", "delay", F.col("correction").alias("o")), ["location", "delay"], "left").join(pooled.select("delay", F.col("correction").alias("p")), "delay", "left")
    return both.select("location", "delay", F.coalesce(weight * F.col("o") + (1 - weight) * F.col("p"), "o", "p").alias("correction"))


def phased(rows: DataFrame, phase: DataFrame) -> DataFrame:
    """rows with the phase (rising, falling) of their location and day."""
    return rows.join(phase, KEY)


def phases(versions: DataFrame, lag: int = 3) -> DataFrame:
    """location, day, phase from first known values: rising if not below the one `lag` days before."""
    first = versions.groupBy(*KEY).agg(F.min_by("value", "as_of").alias("v"))
    before = F.lag("v", lag).over(Window.partitionBy("location").orderBy("day"))
    return first.select(*KEY, F.when(F.col("v") >= before, "rising").when(F.col("v") < before, "falling").alias("phase")).filter("phase IS NOT NULL")


def tiers(rows: DataFrame, keys: DataFrame, min_support: int = 8) -> DataFrame:
    """For each key (location, delay, phase) the median change of the finest tier with enough rows: (location, delay,
    phase), (location, delay), (delay)."""
    out = keys
    levels = [("own", ["location", "delay", "phase"]), ("location", ["location", "delay"]), ("pooled", ["delay"])]
    for name, by in levels:
        got = rows.groupBy(*by).agg(F.percentile("change", F.lit(0.5)).alias(f"c_{name}"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support).drop("n")
        out = out.join(got, by, "left")
    tier = F.when(F.col("c_own").isNotNull(), "own").when(F.col("c_location").isNotNull(), "location").when(F.col("c_pooled").isNotNull(), "pooled").otherwise("none")
    return out.select(*keys.columns, tier.alias("tier"), F.coalesce(*[f"c_{n}" for n, _ in levels]).alias("correction"))


def corrected(values: DataFrame, profile: DataFrame, max_delay: int, mode: str = "additive") -> DataFrame:
    """values (location, delay, value) with `value` moved by the profile where the delay is known and at most
    max_delay and the key is there; other rows stay as they are. The profile has a row per key."""
    joined = values.join(profile.select("location", "delay", F.col("correction").alias("_c")), ["location", "delay"], "left")
    use = F.col("delay").between(0, max_delay) & F.col("_c").isNotNull() & F.col("value").isNotNull()
    moved = F.col("value") + F.col("_c") if mode == "additive" else F.col("value") * F.col("_c")
    return joined.withColumn("corrected", F.when(use, moved).otherwise(F.col("value"))).drop("_c")


def revised(versions: DataFrame) -> DataFrame:
    """The versions of days that have several, with their number."""
    return versions.withColumn("versions", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).filter("versions > 1")


def known_at(versions: DataFrame, origin_table: DataFrame) -> DataFrame:
    """location, origin, day, value: for every origin the latest version of each day that is known by then. Each version
    holds from its own date to the next one's, so that it meets its origins only."""
    until = F.lead("as_of").over(Window.partitionBy(*KEY).orderBy("as_of"))
    spans = versions.withColumn("_until", until)
    holds = (F.col("origin") >= F.col("as_of")) & (F.col("_until").isNull() | (F.col("origin") < F.col("_until")))
    return spans.join(origin_table.select("origin"), holds).select("location", "origin", "day", "value")


def walk(known: DataFrame, least: int) -> DataFrame:
    """location, origin, point (last z), sd (root mean square step) from (location, origin, day, z)."""
    rows = known.withColumn("_e", F.col("z") - F.lag("z").over(Window.partitionBy("location", "origin").orderBy("day")))
    out = rows.groupBy("location", "origin").agg(F.max_by("z", "day").alias("point"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("sd"), F.count("_e").alias("_n"))
    return out.filter(F.col("_n") >= least).drop("_n")


def change_sets(rows: DataFrame, keys: DataFrame, min_support: int = 8) -> DataFrame:
    """keys (location, delay, phase) with tier and `changes`: the distribution of the past changes of the finest tier with
    enough of them, as 200 even quantiles, so that its size doesn't grow with the history."""
    out = keys
    levels = [("own", ["location", "delay", "phase"]), ("location", ["location", "delay"]), ("pooled", ["delay"])]
    for name, by in levels:
        got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile("change", F.array(*[F.lit((k + 0.5) / 200) for k in range(200)])).alias(f"q_{name}")).filter(F.col("_n") >= min_support).drop("_n")
        out = out.join(got, by, "left")
    tier = F.when(F.col("q_own").isNotNull(), "own").when(F.col("q_location").isNotNull(), "location").when(F.col("q_pooled").isNotNull(), "pooled").otherwise("none")
    return out.select(*keys.columns, tier.alias("tier"), F.coalesce(*[f"q_{n}" for n, _ in levels]).alias("changes"))
