"""Weighted least squares from sums: one pre-aggregated group-by (or a running window) gives each group's Gram matrix,
and a fold over its pivots solves it. No Python and no group in one place, whatever the number of rows.

Columns of a design are x_0 (the constant, where there is one), x_1 ..; the matrix has the target as its last column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def products(xs: list[Column], y: Column, weight: Column | None = None) -> list[Column]:
    """Products whose sums are the Gram matrix with its target, row by row, then those of the target and the weight."""
    w = F.lit(1.0) if weight is None else weight
    n = len(xs)
    return [w * xs[i] * xs[j] for i in range(n) for j in range(i, n)] + [w * x * y for x in xs] + [w * y * y, w]


def assembled(sums: list[Column], n: int, penalties: list[Column | float] | None = None) -> tuple[Column, Column, Column]:
    """(augmented matrix with penalties on its diagonal, plain one, [sum of squares of the target, sum of weights])."""
    place, k = {}, 0
    for i in range(n):
        for j in range(i, n):
            place[i, j] = place[j, i] = k
            k += 1
    cell = lambda i, j: sums[place[i, j]] if j < n else sums[k + i]
    plain = [[cell(i, j) for j in range(n + 1)] for i in range(n)]
    pen = penalties or [0.0] * n
    ridge = [[c + (pen[i] if isinstance(pen[i], Column) else F.lit(float(pen[i]))) if i == j else c for j, c in enumerate(row)] for i, row in enumerate(plain)]
    table = lambda rows: F.array(*[F.array(*r) for r in rows])
    return table(ridge), table(plain), F.array(*sums[-2:])


def solved(matrix: Column, n: int | Column) -> Column:
    """Solution of a positive definite system (n rows of n + 1) by elimination, pivot by pivot; null if a pivot is 0."""

    def step(m: Column, k: Column) -> Column:
        lead = F.get(m, k)
        pivot = F.nullif(F.get(lead, k), F.lit(0.0))
        return F.transform(m, lambda row, i: F.when(i == k, F.transform(lead, lambda x: x / pivot)).otherwise(F.transform(row, lambda x, j: x - F.get(row, k) * F.get(lead, j) / pivot)))

    size = F.lit(n) if isinstance(n, int) else n
    done = F.aggregate(F.sequence(F.lit(0), size - 1), matrix, step)
    return F.transform(done, lambda row: F.element_at(row, -1))


def residual(coef: Column, m: Column, r: Column, n: int) -> Column:
    """Residual sum of squares under any coefficients: y'y - 2 b'X'y + b'X'Xb, 0 at least."""
    every = F.sequence(F.lit(0), F.lit(n - 1))
    row = lambda i: F.aggregate(every, F.lit(0.0), lambda t, j: t + F.get(F.get(m, i), j) * F.get(coef, j))
    gain = F.aggregate(every, F.lit(0.0), lambda s, i: s + F.get(coef, i) * (2 * F.get(F.get(m, i), F.lit(n)) - row(i)))
    return F.greatest(F.get(r, F.lit(0)) - gain, F.lit(0.0))


def _solved_rows(out: DataFrame, n: int, penalties, dof: Column, keep: list[str], gram: bool = False) -> DataFrame:
    ridge, plain, rest = assembled([F.col(f"_s{k}") for k in range(n * (n + 1) // 2 + n + 2)], n, penalties)
    out = out.withColumns({"m": plain, "r": rest, "coef": solved(ridge, n)})
    out = out.withColumn("sse", residual(F.col("coef"), F.col("m"), F.col("r"), n))
    return out.withColumn("sd", F.sqrt(F.col("sse") / F.greatest(dof, F.lit(1.0)))).select(*keep, "coef", "sse", "sd", "n", *(["m", "r"] if gram else []))


def standardised(n: int, penalty: float) -> list[Column | float]:
    """Penalties of a ridge on columns scaled to sd 1 (sd under 1e-8 counts as 1) with a free constant, for a design of n
    columns with the constant first: each column's variance times the penalty."""
    count, out, at = F.col("_s0"), [0.0], n
    for i in range(1, n):
        var = (F.col(f"_s{at}") - F.col(f"_s{i}") * F.col(f"_s{i}") / count) / F.nullif(count - 1, F.lit(0.0))
        out.append(penalty * F.when(var < 1e-16, F.lit(1.0)).otherwise(var))
        at += n - i
    return out


def fitted(rows: DataFrame, by: list[str], xs: list[Column], y: Column, weight: Column | None = None, penalties: list[Column | float] | None = None, least: int | None = None, gram: bool = False) -> DataFrame:
    """by, coef, sse (weighted), sd, n: one aggregate. sd has sum(w) - columns degrees of freedom, 1 at least. Groups of
    fewer than `least` rows (default: columns + 1) have no row. With gram, the matrix `m` and [y'y, sum(w)] `r` as well."""
    n = len(xs)
    sums = [F.sum(p).alias(f"_s{k}") for k, p in enumerate(products(xs, y, weight))]
    out = rows.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= (n + 1 if least is None else least))
    return _solved_rows(out, n, penalties, F.col(f"_s{n * (n + 1) // 2 + n + 1}") - n, by, gram)


def running(rows: DataFrame, by: list[str], time: str, xs: list[Column], y: Column, penalties: list[Column | float] | None = None, least: int | None = None, last: int | None = None) -> DataFrame:
    """by, time, coef, sse, sd, n at every row: the fit to the rows up to it (of the last `last` ones). Running sums, so
    that expanding windows cost one pass and not a row for every pair of an origin and an earlier week."""
    made = rows.select(*by, time, *[p.alias(f"_s{k}") for k, p in enumerate(products(xs, y))], F.lit(1).alias("_n"))
    return running_sums(made, by, time, len(xs), penalties, least, last)


def running_sums(made: DataFrame, by: list[str], time: str, n: int, penalties: list[Column | float] | None = None, least: int | None = None, last: int | None = None) -> DataFrame:
    """The same from rows of products (_s0 .., _n), which may be sums of several rows of a time already. Without `by` that is
    wanted: one task then has a row per time, and no more."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    names = [f"_s{k}" for k in range(n * (n + 1) // 2 + n + 2)]
    out = made.select(*by, time, *[F.sum(c).over(w).alias(c) for c in names], F.sum("_n").over(w).alias("n")).filter(F.col("n") >= (n + 1 if least is None else least))
    return _solved_rows(out, n, penalties, F.col("n") - n, [*by, time])


def extended(coef: Column, tail: Column, extra: Column, steps: int) -> Column:
    """Means of an autoregression 1 .. steps ahead. coef: constant, then one for each of tail (latest first); extra: what
    other regressors add at each step, as an array."""
    zero = F.struct(tail.alias("tail"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        lags = F.zip_with(F.slice(coef, F.lit(2), F.size(s["tail"])), s["tail"], lambda a, b: a * b)
        new = F.get(coef, F.lit(0)) + F.aggregate(lags, F.lit(0.0), lambda a, x: a + x) + F.get(extra, h - 1)
        return F.struct(F.concat(F.array(new), F.slice(s["tail"], F.lit(1), F.size(s["tail"]) - 1)).alias("tail"), F.concat(s["out"], F.array(new)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)["out"]


def spread(coef: Column, order: int, steps: int) -> Column:
    """Root of the sums of squared impulse responses 1 .. steps ahead: standard deviations for innovations of 1."""
    slopes = F.concat(F.array(F.lit(0.0)), F.slice(coef, 2, order))
    first = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), order - 1))
    psi = F.concat(F.array(F.lit(1.0)), extended(slopes, first, F.array_repeat(F.lit(0.0), steps), steps))
    sums = F.aggregate(F.slice(psi, 1, steps), F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x * x)))
    return F.transform(sums, lambda x: F.sqrt(x))
