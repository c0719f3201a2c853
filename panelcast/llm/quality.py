"""Quality rules with a verdict on hosts (operator 3).

Every document gets rule figures from its whole text; a document fails the base rules if it has fewer than
`min_words` words or if more than `max_repeat_pct` % of its words lie in repeated 8-word windows. Failures are
summed by host; each host's failure rate is shrunk towards a beta prior whose two parameters come from the
hosts' own rates by the method of moments; a host whose shrunk rate is over `max_host_rate` is rejected, and
the verdict is joined back to its documents. A document is kept if it passes and its host isn't rejected.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; a repeated
row counts each time and gets the same figures; an empty table gives an empty result; names of other columns
don't matter. Hosts with few documents stay near the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import appended, cut

_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>"))
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list, size: int = 8) -> int:
    """Words that lie in a window of `size` (a power of two) words found twice or more, the first included.
    Windows are named exactly, by doubling: a window of 2k words is the pair of names of its halves."""
    n = len(words)
    if n <= size:
        return 0
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if len(names) == n:
        return 0
    length = 1
    while length < size:
        pairs = ids[:-length] * (n + 1) + ids[length:]
        found, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(found) == len(pairs):
            return 0
        length *= 2
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[ids] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text. Words are runs of characters other
    than the six ASCII white-space ones, which is how bytes.split() cuts."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    seen: set[bytes] = set()
    repeated = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line and not line.isspace():
            seen.add(line)
    chars = len(text) - (len(data) - sum(map(len, words)))
    return len(words), chars, len(data.translate(None, _SYMBOL)), repeated, repeat_words(words)


def base_failed(n_words: Column, n_repeat: Column, min_words: int = 20, max_repeat_pct: int = 30) -> Column:
    return (n_words < min_words) | (100 * n_repeat > max_repeat_pct * n_words)


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the five figures and base_failed, each named with prefix."""

    def rows(texts):
        return list(map(list, zip(*map(figures, texts))))

    out = appended(docs, [text_col], rows, [(prefix + f, "long", pa.int64()) for f in FIGURES])
    return out.withColumn(prefix + "base_failed", base_failed(F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")))


def host_verdicts(rated: DataFrame, host: str, failed: str, max_host_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), rejected: one row a host. The prior comes from one row of sums over
    the hosts: mean m of all documents, spread v of the hosts' rates beyond binomial noise."""
    hosts = rated.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("h"), F.sum(rate * F.col("n_failed")).alias("q"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2")).first()
    a, b = prior(s.n or 0, s.f or 0, s.h or 0, s.q or 0.0, s.n2 or 0.0)
    shrunk = (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return hosts.withColumn("rate", shrunk).withColumn("rejected", shrunk > max_host_rate)


def prior(n: int, f: int, h: int, q: float, n2: float) -> tuple[float, float]:
    """Beta parameters from sums over hosts: documents n, failures f, hosts h, sum of f_i^2 / n_i, sum of n_i^2.
    The weighted analysis-of-variance estimate of the spread; a strength from 1 to 10,000 documents."""
    if n == 0:
        return 0.5, 0.5
    m = (f + 0.5) / (n + 1)
    if h < 2 or n * n <= n2:
        return m, 1 - m
    between = (q - n * (f / n) ** 2) / (h - 1)  # expected: noise + k * v
    noise = max(f - q, 0.0) / max(n - h, 1)
    v = (between - noise) / ((n - n2 / n) / (h - 1))
    strength = 10_000.0 if v <= 0 else min(max(m * (1 - m) / v - 1, 1.0), 10_000.0)
    return m * strength, (1 - m) * strength


def rated(docs: DataFrame, text_col: str = "text", prefix: str = "", keep_text: bool = False) -> DataFrame:
    """measured(), worked out once and kept in the shared folder: without the text unless keep_text."""
    out = measured(docs, text_col, prefix)
    return cut(out if keep_text else out.drop(text_col))


def verdict(rows: DataFrame, host_col: str = "source", prefix: str = "", max_host_rate: float = 0.5, broadcast_rows: int = 100_000) -> DataFrame:
    """rated() rows with `kept`, named with prefix."""
    verdicts = host_verdicts(rows, host_col, prefix + "base_failed", max_host_rate)
    bad = verdicts.filter("rejected").select(F.col("host").alias(prefix + "_host"), F.lit(True).alias(prefix + "_bad"))
    # rejected hosts are few; many are dealt out with the rows' hosts salted, as one host may have a third of all rows
    if bad.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = rows.join(F.broadcast(bad), rows[host_col].eqNullSafe(bad[prefix + "_host"]), "left")
    else:
        salts = 64
        salted = rows.withColumn(prefix + "_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        many = bad.withColumn(prefix + "_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(many, salted[host_col].eqNullSafe(many[prefix + "_host"]) & (F.col(prefix + "_salt") == F.col(prefix + "_salt2")), "left").drop(prefix + "_salt", prefix + "_salt2")
    kept = ~F.col(prefix + "base_failed") & F.col(prefix + "_bad").isNull()
    return joined.withColumn(prefix + "kept", kept).drop(prefix + "_host", prefix + "_bad")
