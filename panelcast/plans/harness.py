"""Runs of candidate models: each on its own, so that one that fails or takes too long is a row of the report and not the
end of the round."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import scoring, selection


def run_round(spark: SparkSession, candidates: dict[str, Callable[[], DataFrame]], truth: DataFrame, limit: float | None = None, folder: str | None = None) -> DataFrame:
    """model, status (ok, failed, late), error, seconds, tasks, score, rank of each candidate. A candidate gives a quantile
    table; what is beyond `limit` seconds is cancelled by its tag. With folder, its scores are kept there and one that has
    them already isn't run again."""
    rows = []
    for name, make in candidates.items():
        began, status, error, tasks, score = time.time(), "ok", None, 0, float("inf")
        tag = f"panelcast-{uuid.uuid4().hex}"

        def job(name=name, make=make, tag=tag):
            spark.addTag(tag)
            try:
                return _score(spark, name, make, truth, folder)
            finally:
                spark.removeTag(tag)

        pool = ThreadPoolExecutor(1)
        try:
            tasks, score = pool.submit(job).result(limit)
        except Late:
            spark.interruptTag(tag)
            status, error = "late", f"over {limit} s"
        except Exception as e:  # whatever a candidate raises is its result
            status, error = "failed", str(e).splitlines()[0][:200]
        pool.shutdown(wait=True)
        rows.append((name, status, error, time.time() - began, tasks, float(score)))
    out = spark.createDataFrame(rows, "model string, status string, error string, seconds double, tasks long, score double")
    return selection.ranked(out, "score")


def _score(spark: SparkSession, name: str, make: Callable[[], DataFrame], truth: DataFrame, folder: str | None) -> tuple[int, float]:
    path = f"{folder}/{name}" if folder else None
    if path and _there(spark, path):
        scores = spark.read.parquet(path)
    else:
        scores = scoring.scored(make(), truth)
        if path:
            scores.write.mode("overwrite").parquet(path)
            scores = spark.read.parquet(path)
    found = scores.agg(F.count(F.lit(1)).alias("n"), F.avg("wis").alias("w")).first()
    if not found.n:
        raise ValueError("no task has a truth")
    return found.n, found.w


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
