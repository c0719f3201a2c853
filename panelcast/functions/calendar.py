"""Season calendar and circular week arithmetic, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_year(d: Column, first_month: int = 10) -> Column:
    """The year in which the season of d began."""
    return F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)


def season_start(d: Column, first_month: int = 10) -> Column:
    """The first Saturday on or after the first day of the season."""
    return F.next_day(F.date_sub(F.make_date(season_year(d, first_month), F.lit(first_month), F.lit(1)), 1), "SAT")


def week_of_season(d: Column) -> Column:
    """1 in the first week; truncating division, so the days before the first Saturday are week 1, too."""
    days = F.datediff(d, season_start(d))
    return (F.when(days >= 0, F.floor(days / 7)).otherwise(F.ceil(days / 7)) + 1).cast("int")


def summer_season_year(d: Column, first_day: int = 205) -> Column:
    """Seasons that begin on a day of the year."""
    return F.when(F.dayofyear(d) >= first_day, F.year(d)).otherwise(F.year(d) - 1)


def mod1(i: Column, n: int) -> Column:
    """1 .. n, circular."""
    return F.pmod(i - 1, F.lit(n)) + 1


def circular_distance(a: Column, b: Column, period: int = 52) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(period) - d)


def delay(reference: Column, known: Column, unit_days: int = 7, most: int | None = None) -> Column:
    """Whole units from the reference date to the date at which a value was known, cut at `most`; null without a date."""
    n = F.floor(F.datediff(known, reference) / unit_days).cast("int")
    return n if most is None else F.when(n.isNotNull(), F.least(F.lit(most), n))


def fourier(week: Column, harmonics: int, period: float = 52.0) -> list[Column]:
    """sin and cos of the first harmonics."""
    out = []
    for k in range(1, harmonics + 1):
        angle = F.lit(2.0 * 3.141592653589793 * k / period) * week
        out += [F.sin(angle), F.cos(angle)]
    return out


def phase_label(woy: Column, upto: dict[int, str], rest: str) -> Column:
    """The label of the first bound that the week doesn't pass."""
    out = F.lit(rest)
    for bound in sorted(upto, reverse=True):
        out = F.when(woy <= bound, upto[bound]).otherwise(out)
    return out
