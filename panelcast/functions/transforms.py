"""Modelling scales: pairs of a Column function and its inverse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scales.
LOG_FLOOR, LOGIT_MARGIN = 1e-4, 1e-6

Pair = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def power(p: float) -> Pair:
    """x -> max(x, 0)^p with a sign-preserving inverse; p = 0 is the logarithm."""
    if p == 0:
        return SCALES["log"]
    return (lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(p))), (lambda z: F.signum(z) * F.pow(F.abs(z), F.lit(1.0 / p)))


def _logit(x: Column) -> Column:
    q = F.least(F.greatest(x / 100, F.lit(LOGIT_MARGIN)), F.lit(1 - LOGIT_MARGIN))
    return F.log(q / (1 - q))


SCALES: dict[str, Pair] = {
    "log": (lambda x: F.log(F.greatest(x, F.lit(LOG_FLOOR))), F.exp),
    "log1p": (lambda x: F.log1p(F.greatest(x, F.lit(0.0))), F.expm1),
    "logit": (_logit, lambda z: 100 / (1 + F.exp(-z))),
    "fourthroot": (lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(0.25)), lambda z: F.pow(z, F.lit(4.0))),
    "sqrt": (lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), lambda z: z * z),
    "identity": (lambda x: x, lambda z: z),
}


def to_scale(x: Column, scale: str) -> Column:
    return SCALES[scale][0](x)


def from_scale(z: Column, scale: str) -> Column:
    """Back to the natural scale, never below zero."""
    return F.greatest(SCALES[scale][1](z), F.lit(0.0))


def by_location(x: Column, location: Column, default: str, special: dict[str, str]) -> Column:
    """A scale of its own for some locations."""
    out = to_scale(x, default)
    for name, scale in special.items():
        out = F.when(location == name, to_scale(x, scale)).otherwise(out)
    return out
