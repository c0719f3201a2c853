"""Canonical exact digests (operator 5), by DataFrame functions only.

A text's canonical form: Unicode compatibility composition (NFKC), full case folding, NFKC again, runs of white
space as one blank, none at the ends. Its fingerprint is 128 bits: two xxhash64 values over the canonical form
that start from different seeds. Rows with equal fingerprints are compared byte by byte: the classes are grouped
by fingerprint and canonical form (pre-aggregated before the shuffle), and likenesses compare the forms themselves
where fingerprints are equal. So a collision never joins two texts. What a class found is carried to its rows by the
fingerprint and the SHA-256 of the form; should these not tell two forms apart either, the job fails.

Normalisation and folding are the JVM's own ICU functions, which Spark brings along, called through the SQL
function `reflect`.

Defined results: null counts as empty; rows that repeat share a class; equal ids are ordered by text; a table of
one row is its own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import cut


def canonical(text: Column) -> Column:
    """The canonical form."""
    compose = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"[\s\p{Z}\x85]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 lowercase hex digits."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(1), canon)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint, sha (of the canonical form), class_id (smallest id), n_docs: one row for each canonical form."""
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("canon"))
    rows = rows.select("doc_id", "canon", digest(F.col("canon")).alias("fingerprint"))
    forms = rows.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"))
    told = forms.select("fingerprint", F.unhex(F.sha2("canon", 256)).alias("sha"), "class_id", "n_docs")
    n = F.count(F.lit(1)).over(Window.partitionBy("fingerprint", "sha"))
    return told.withColumn("n_docs", F.when(n == 1, F.col("n_docs")).otherwise(F.raise_error(F.lit("two forms with equal digests")).cast("long")))


def _ranges(docs: DataFrame, range_mb: float, knots: int) -> tuple[Column, int]:
    """(the range of ids that a row falls in, as a column; the number of ranges at most). Ids are cut at up to `knots`
    quantiles and between two of them evenly, so that a range holds some range_mb MB. The driver gets the quantiles."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.percentile_approx("doc_id", [i / knots for i in range(1, knots + 1)], 10_000).alias("q"), F.min("doc_id").alias("lo")).first()
    ends = sorted(set(size.q or [0]))
    parts = int((size.b or 0) / (len(ends) * range_mb * 1_000_000)) + 1
    starts = [size.lo or 0, *[e + 1 for e in ends[:-1]]]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            width = F.lit(max(1, -(-(ends[lo] - starts[lo] + 1) // parts)))
            inner = F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - F.lit(starts[lo])) / width))
            return F.lit(lo * parts).cast("long") + inner.cast("long")
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(ends[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    # null ids come last in a descending order
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), tree(0, len(ends) - 1)), F.lit(-1).cast("long")), len(ends) * parts


def _below(buckets: DataFrame, block: int = 4096) -> DataFrame:
    """bucket, lower: the next lower of the buckets that are there; of the lowest the highest. In blocks of numbers, so that
    one window over all has a row for each block only."""
    rows = buckets.withColumn("_block", F.floor(F.col("bucket") / block))
    tops = rows.groupBy("_block").agg(F.max("bucket").alias("_top"))
    order = Window.orderBy("_block")
    before = tops.select("_block", F.coalesce(F.lag("_top").over(order), F.max("_top").over(Window.partitionBy())).alias("_before"))
    inside = F.lag("bucket").over(Window.partitionBy("_block").orderBy("bucket"))
    return rows.withColumn("_lower", inside).join(before, "_block").select("bucket", F.coalesce("_lower", "_before").alias("lower"))


def with_next(docs: DataFrame, range_mb: float = 8, knots: int = 64, deal_mb: float = 32) -> DataFrame:
    """docs (doc_id, text, fingerprint) with next_text, next_fingerprint of the next row by descending doc_id, the last one's being the
    first row. One shuffle of the texts by ranges of ids, into tasks of some deal_mb MB. The last row of a range gets the first one of
    the range below from a table of one row a range, which is stored: whether it is broadcast depends on its size."""
    bucket, ranges = _ranges(docs, range_mb, knots)
    known = docs.select("doc_id", "text", "fingerprint", bucket.alias("bucket"))
    first = F.min_by("text", F.struct(-F.col("doc_id"), F.col("text")))
    heads = known.groupBy("bucket").agg(first.alias("head")).select(F.col("bucket").alias("lower"), "head", digest(canonical(F.col("head"))).alias("head_print"))
    ends = cut(_below(known.select("bucket").distinct()).join(heads, "lower").select(F.col("bucket").alias("of"), "head", "head_print"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(ranges * range_mb / deal_mb) + 1)
    w = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    rows = known.repartition(tasks, "bucket").withColumns({"next_text": F.lead("text").over(w), "next_fingerprint": F.lead("fingerprint").over(w), "last": F.lead(F.lit(False), 1, True).over(w)})
    joined = rows.join(ends, (F.col("bucket") == F.col("of")) & F.col("last"), "left")
    end = lambda inside, outside: F.when(F.col("last"), F.col(outside)).otherwise(F.col(inside)).alias(inside)
    return joined.select("doc_id", "text", "fingerprint", end("next_text", "head"), end("next_fingerprint", "head_print"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last floor(n_chars / 2) code points replaced by the
    first as many of the next document. Likeness of two fingerprints is 1 if the canonical forms are equal, else 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    near = with_next(rows.select("doc_id", "text", digest(canonical(F.col("text"))).alias("fingerprint")), **how)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    near = near.select("*", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    near = near.select("doc_id", "n_chars", "fingerprint", "edited", "text", "next_text", "next_fingerprint", canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"))
    near = near.select("*", digest(F.col("edited_canon")).alias("edited_fingerprint"))
    same_edited = (F.col("fingerprint") == F.col("edited_fingerprint")) & (F.col("canon") == F.col("edited_canon"))
    same_next = F.when(F.col("fingerprint") == F.col("next_fingerprint"), F.col("canon") == canonical(F.col("next_text"))).otherwise(False)
    flat = near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", same_edited.cast("double").alias("near_edited"), same_next.cast("double").alias("near_next"), F.unhex(F.sha2("canon", 256)).alias("sha"))
    return flat.join(classes(rows), ["fingerprint", "sha"]).drop("sha", "n_docs")
