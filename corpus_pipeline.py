"""A pipeline for training data over `documents`: each stage applies one operator of panelcast.llm.

Stages get the rows that the one before kept and return the columns of documents; the last one returns pieces of
packed sequences. Null texts fail the quality rules, so later stages see none unless they are run alone, where the
operators' own results for null texts hold.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import langid, near_copies, packing, quality, suffix_dedup
from panelcast.llm.common import cut, drop_cut, fresh, table

MIN_LANGUAGE_SCORE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that aren't rejected. Null, empty and short texts fail; a null source
    is a host like any other; repeated rows are judged alike and all stay; an empty table gives an empty result."""
    q = fresh(docs.columns, "_q_")
    rows = quality.verdict(quality.rated(docs, prefix=q, keep_text=True), prefix=q)
    return rows.filter(F.col(q + "kept")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose bytes are labelled alike to at least MIN_LANGUAGE_SCORE. Texts without a letter and
    null ones go, and so does all of a table that is empty or has no labelled text; ties go to the first language by
    name; repeated rows are judged alike; long texts are read in windows, whole."""
    network = langid.trained(docs, hidden=8, steps=400)
    p = fresh(docs.columns, "_l_")
    rows = langid.predicted(docs, network, prefix=p)
    return rows.filter((F.col(p + "lang_pred") != langid.UND) & (F.col(p + "score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies have a Jaccard similarity of 0.8 or more over shingles of five words. One row of each component of
    near copies stays: the one with the smallest id (null is the largest), and of several texts with that id, the one
    with the smallest hash of the row. Null, empty and blank texts are copies of each other only; of repeated rows one
    stays; an empty table gives an empty result; texts of any length are compared whole."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(columns))])  # by position, so that clashing names do no harm
    key, text = (f"c{columns.index(name)}" for name in ("doc_id", "text"))
    rows = plain.withColumns({"row": F.xxhash64(*plain.columns), "id": F.col(key)})
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    found = near_copies.grouped(rows, ["id", "row"], text)
    first = found.groupBy("group").agg(F.min(rank).alias("first")).select("first.id", "first.row")
    copies = found.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n"))
    # stored, so that their size is known when the join is planned; equal rows are few, and only they are grouped
    stays = cut(first.withColumnsRenamed({"id": "f_id", "row": "f_row"}).join(copies, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("row") == F.col("f_row"))).select("f_id", "f_row", "n"))
    same = rows["id"].eqNullSafe(F.col("f_id")) & (rows["row"] == F.col("f_row"))
    alone = rows.join(stays.filter("n = 1"), same, "left_semi")
    equal = rows.join(stays.filter("n > 1"), same, "left_semi").dropDuplicates(["id", "row"])
    return alone.unionByName(equal).select(*plain.columns).toDF(*columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; halves of characters at a cut go, too. Null texts stay null; a
    repeated row's text is a repeated passage where it has 200 bytes; an empty table gives an empty result."""
    p = fresh(docs.columns, "_s_")
    # workers hold what earlier stages left: smaller sorts than the operator's own, with the same result
    rows = suffix_dedup.without_repeats(docs, length=200, as_text=True, prefix=p, shard_bytes=1_500_000, memory=12_000_000, many=12_000)
    new = {"text": F.when(F.col("text").isNotNull(), F.col(p + "text")), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(p + "text").cast("long"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens. A null or empty text has the end id only; repeated rows are packed each;
    long texts are cut into several pieces; an empty table gives an empty result."""
    tokens = packing.token_ids(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.pack(tokens, window=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packed),
]

#: A trained network, components and suffix arrays are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            made = cut(made)
            if k:
                drop_cut(docs)
        docs = made
    return docs
