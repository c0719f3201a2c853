"""Structured Streaming forms: vintages as a stream, walk-forward calibration with state, windows with watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelcast.sources.files import remove, shared_dir

#: State on disk with bounded memory, not in the heap of whoever runs the tasks.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """window start, location, n, total; rows later than the watermark are dropped (an extension: vintages never are)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window.alias("w"), F.col("event_type").alias("location")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "location", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n by sessions. An event just `gap` after the one before begins a new session; session_window
    would join the two, so its gap is the last microsecond shorter."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", f"{gap} -1 microseconds").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n")


def drained(stream: DataFrame, form: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole table that form makes of a stream at its end. Executors write it as Parquet to the shared folder, so that the
    driver holds no rows; each batch replaces the one before."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    table = form(stream)
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        rows = table.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"))
        q = rows.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    remove(spark, f"{path}/state")
    return spark.read.schema(table.schema).parquet(f"{path}/rows")


def conformal_stream(tasks: DataFrame, levels: list[int], least: int = 10) -> DataFrame:
    """horizon, origin, n, level, q: walk-forward error quantiles. tasks is a stream of (horizon int, origin date, mature
    date, error double), in order of origin: at an origin first all errors mature by then enter the pool, then the quantiles
    are given, then its own errors wait. State is per horizon."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool, wait = (list(map(list, x)) for x in state.get) if state.exists else ([], [])
        pool = [p[0] for p in pool]
        rows = pd.concat(list(parts)).sort_values("origin")
        out = []
        for origin, group in rows.groupby("origin", sort=True):
            day = pd.Timestamp(origin).toordinal()
            pool += [e for m, e in wait if m <= day]
            wait = [w for w in wait if w[0] > day]
            if len(pool) >= least:
                qs = np.quantile(np.array(pool), np.array(levels) / 1000)
                out += [(int(key[0]), pd.Timestamp(origin).date(), len(pool), level, float(q)) for level, q in zip(levels, qs)]
            wait += [[pd.Timestamp(m).toordinal(), float(e)] for m, e in zip(group["mature"], group["error"])]
        state.update(([[e] for e in pool], wait))
        yield pd.DataFrame(out, columns=["horizon", "origin", "n", "level", "q"])

    return tasks.groupBy("horizon").applyInPandasWithState(step, "horizon int, origin date, n int, level int, q double", "pool array<array<double>>, wait array<array<double>>", "append", GroupStateTimeout.NoTimeout)
