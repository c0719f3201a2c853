"""License scans (operator 6), by DataFrame functions only.

A text's words are its lower-cased runs of letters and digits; a shingle is the hash of SHINGLE words in a row. Templates
are taken in classes of lengths that lie within a factor of eight (Class). For a class with templates of up to M words,
windows of M + stride - 1 words start every `stride` words, so that each run of M words lies whole in one.

Templates are retrieved by MinHash in its one-permutation form: a window's shingles are dealt out to `bands` bands by the
first bits of their hashes, and a band's value is its smallest hash. A template is retrieved if one band agrees. How
likely it is that none does, for a window that holds a share of `threshold` of a template's shingles, follows from how
balls in random order fill boxes (miss_rate); stride and bands are the widest and fewest that keep it at MISS or less.
Retrieved pairs are checked exactly: the share of the template's shingles that the window holds.

A template of fewer words than a shingle has a shingle of its own length.

Defined results: null and empty texts match nothing; rows with equal ids and texts count as one; a template counts once
for each of them, with its best window, ties to the first; templates without a word match nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.license_texts import TEMPLATES

SHINGLE, THRESHOLD, MISS, BANDS = 5, 0.8, 1e-6, (64, 256, 1024, 4096)


def once(value: Column) -> Column:
    """explode() of one element: the optimiser doesn't inline value into what uses it, where a lambda would work it
    out for every element."""
    return F.explode(F.array(value))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` words, in order; none of fewer words."""
    run = lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) < size, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), run))


def miss_rate(shared: int, others: int, bands: int) -> float:
    """Probability that no band's smallest of shared + others random hashes is a shared one: hashes come in random order,
    the first in a band is its smallest, so every shared one must come to a band that is taken. Of large sets, smaller
    ones with the same share are taken, which miss more often."""
    if others <= 0:
        return 0.0
    if shared + others > 160:
        scale = 160 / (shared + others)
        shared, others = max(1, math.floor(shared * scale)), math.ceil(others * scale)
    taken = np.arange(bands + 1) / bands
    # rows[i][o]: i shared ones left, with the others of the outer loop, o bands taken
    before = [taken**i for i in range(shared + 1)]
    for j in range(1, others + 1):
        now = [np.ones(bands + 1)]
        for i in range(1, shared + 1):
            up = np.append(before[i][1:], before[i][-1])
            now.append(i / (i + j) * taken * now[i - 1] + j / (i + j) * (taken * before[i] + (1 - taken) * up))
        before = now
    return float(before[shared][0])


@dataclass(frozen=True)
class Class:
    """Templates of like lengths: a shingle's words, a window's shingles, the words between two windows' starts, the bands
    and how often a template is missed at most."""

    size: int
    window: int
    stride: int
    bands: int
    miss: float


def plan(lengths: list[int], size: int, threshold: float) -> Class:
    """The widest stride, then the fewest bands, for templates of these numbers of words."""
    longest = max(lengths)
    best = None
    stride = longest
    while True:
        window = longest + stride - size
        for bands in BANDS:
            miss = 0.0
            for m in set(lengths):
                own = m - size + 1
                need = math.ceil(threshold * own - 1e-9)
                miss = max(miss, 0.0 if need == own == window else miss_rate(need, window - need + own - need, bands))
            if best is None or miss < best.miss:
                best = Class(size, window, stride, bands, miss)
            if miss <= MISS:
                return Class(size, window, stride, bands, miss)
        if stride == 1:
            return best
        stride = max(1, stride // 2)


def classes(lengths: dict[str, int], threshold: float = THRESHOLD) -> dict[str, Class]:
    """The class of each template (name: words): one-shingle templates, those of up to three words more, and
    lengths within a factor of eight."""
    groups: dict[tuple[int, int], list[str]] = {}
    for name, m in lengths.items():
        if m:
            kind = 0 if m <= SHINGLE else 1 if m <= SHINGLE + 3 else 2 + int(math.log(m / (SHINGLE + 4), 8))
            groups.setdefault((min(SHINGLE, m), kind), []).append(name)
    out = {}
    for (size, _), names in groups.items():
        made = plan([lengths[n] for n in names], size, threshold)
        out |= dict.fromkeys(names, made)
    return out


def signature(ordered: Column, bands: int) -> Column:
    """The smallest hash of each band, from different hashes in order: the first with its leading bits."""
    shift = 64 - bands.bit_length() + 1
    return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(ordered, i - 1), shift)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template, containment, window (first word of the best one, from 0), n_windows: a row for each template
    found."""
    spark = docs.sparkSession
    raw = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "template string, body string")
    lengths = {r.template: r.m for r in raw.select("template", F.size(words(F.col("body"))).alias("m")).collect()}  # a parameter's size
    chosen = classes(lengths, threshold)
    if not chosen:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    made = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), once(words(F.col(text_col))).alias("w"))
    sizes = sorted({c.size for c in chosen.values()})
    made = made.select("doc_id", "row", *[once(shingles(F.col("w"), s)).alias(f"sh{s}") if k == 0 else shingles(F.col("w"), s).alias(f"sh{s}") for k, s in enumerate(sizes)])
    plans = sorted(set(chosen.values()), key=lambda c: (c.size, c.window))

    number = F.create_map(*[F.lit(v) for name, c in chosen.items() for v in (name, plans.index(c))])
    own = raw.filter(F.col("template").isin(sorted(chosen))).select("template", once(words(F.col("body"))).alias("w")).withColumn("k", number[F.col("template")])
    body = reduce(lambda o, s: F.when(F.size("w") == s, shingles(F.col("w"), s)).otherwise(o), [s for s in sizes if s < SHINGLE], shingles(F.col("w"), SHINGLE))
    own = own.select("template", "k", once(F.array_sort(F.array_distinct(body))).alias("sh"))
    by_class = reduce(lambda o, k: F.when(F.col("k") == k, signature(F.col("sh"), plans[k].bands)).otherwise(o), range(len(plans)), F.array().cast("array<bigint>"))
    known = own.withColumn("sig", by_class).collect()  # a parameter's size
    literal = lambda values: F.array(*[F.lit(v) for v in values])

    def values(k: int) -> list[int]:
        return sorted({v for r in known if r.k == k for v in r.sig})

    def retrieved(k: int, c: Class) -> Column:
        """Windows that agree with a template of the class in a band, with those templates: (template, at, wsh). A band can
        only agree where its value is one of a template's bands, so signatures are made of the windows around these."""
        sh = F.col(f"sh{c.size}")
        spots = F.filter(F.transform(sh, lambda x, i: F.when(x.isin(values(k)), i)), lambda i: i.isNotNull())
        first = lambda i: F.greatest(F.lit(0), F.ceil((i - (c.window - 1)) / c.stride).cast("int"))
        starts = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.sequence(first(i), F.floor(i / c.stride).cast("int")))))
        made = F.transform(starts, lambda w: F.struct((w * c.stride).alias("at"), F.array_sort(F.array_distinct(F.slice(sh, w * c.stride + 1, c.window))).alias("wsh")))
        signed = F.transform(made, lambda x: F.struct(x["at"].alias("at"), x["wsh"].alias("wsh"), signature(x["wsh"], c.bands).alias("sig")))
        table = F.array(*[F.struct(F.lit(r.template).alias("template"), literal(r.sig).alias("sig")) for r in known if r.k == k])
        agree = lambda x: F.transform(F.filter(table, lambda t: F.arrays_overlap(t["sig"], x["sig"])), lambda t: F.struct(t["template"].alias("template"), x["at"].alias("at"), x["wsh"].alias("wsh")))
        return F.flatten(F.transform(signed, agree))

    def some(size: int) -> Column:
        every = [v for k, c in enumerate(plans) if c.size == size for v in values(k)]
        return F.exists(f"sh{size}", lambda x: x.isin(every))

    pairs = made.filter(reduce(lambda o, x: o | x, map(some, sizes))).select("doc_id", "row", F.explode(F.concat(*[retrieved(k, c) for k, c in enumerate(plans)])).alias("x")).select("doc_id", "row", "x.template", "x.at", "x.wsh")
    pairs = pairs.join(F.broadcast(own.select("template", "sh")), "template")  # the templates: a parameter
    share = F.size(F.array_intersect("wsh", "sh")) / F.size("sh")
    found = pairs.select("doc_id", "row", "template", "at", share.alias("containment")).filter(F.col("containment") >= threshold)
    best = found.groupBy("doc_id", "row", "template").agg(F.max("containment").alias("containment"), F.min_by("at", F.struct(-F.col("containment"), F.col("at"))).cast("long").alias("window"), F.count(F.lit(1)).alias("n_windows"))
    return best.drop("row")


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL over `documents`, without MinHash: every window that has a template's shingle is
    compared. Templates have SHINGLE words or more."""
    import re

    known = templates or TEMPLATES
    lengths = {n: len(re.findall(r"[^\W_]+", t)) for n, t in known.items()}
    chosen = classes(lengths, threshold)
    values = ", ".join("('{}', '{}', {}, {})".format(name, body.replace("'", "''"), chosen[name].window, chosen[name].stride) for name, body in sorted(known.items()))
    cut = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT name AS template, n AS size, stride, {cut.format('body')} AS w FROM (VALUES {values}) v(name, body, n, stride)),
ts AS (SELECT template, size, stride, unnest(list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))) AS s FROM t),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS r, {cut.format('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
ds AS (SELECT doc_id, r, i, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS s FROM (SELECT doc_id, r, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM d WHERE len(w) >= {SHINGLE})),
hit AS (SELECT doc_id, r, template, size, stride, i, s FROM ds JOIN ts USING (s)),
win AS (SELECT DISTINCT doc_id, r, template, stride * unnest(range(greatest(0, ceil((i - size + 1) / stride)::BIGINT), floor(i / stride)::BIGINT + 1)) AS "window", s FROM hit),
c AS (SELECT doc_id, r, template, "window", count(*) / n AS containment FROM win JOIN tn USING (template) GROUP BY doc_id, r, template, "window", n)
SELECT doc_id, template, max(containment) AS containment, arg_min("window", (-containment, "window")) AS "window", count(*) AS n_windows
FROM c WHERE containment >= {threshold} GROUP BY doc_id, r, template"""
