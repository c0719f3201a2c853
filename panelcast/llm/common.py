"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from panelcast.sources.files import remove, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], prefix: str) -> str:
    """The prefix, with more underscores until no column begins with it."""
    while any(c.startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: a cut lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a frame made by cut() that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        remove(df.sparkSession, name.rpartition("/")[0])


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers outlive tasks and share the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that few whole texts are Python objects at a time; memory is released at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    release()


def arrow_map(f: Callable[[list[list]], Iterable[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one over the columns of a batch that gives row tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = list(f([column.to_pylist() for column in batch.columns]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


class Memo(dict):
    """A dict that fills itself by make(key) and holds at most 2 * size entries: when the young generation is
    full it becomes the old one, so words in use stay and memory is bounded whatever the input. Very long keys
    aren't kept."""

    def __init__(self, make: Callable, size: int = 250_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > 200:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def appended(df: DataFrame, inputs: list[str], f: Callable[..., list[list]], new: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """df with new columns (name, SQL type, Arrow type): f takes the input columns of a batch as lists and gives
    the new ones. The others pass through as Arrow arrays; a column that has a new one's name is replaced by it."""
    at = [df.columns.index(c) for c in inputs]
    stays = [i for i, c in enumerate(df.columns) if c not in {name for name, _, _ in new}]
    types = [t for _, _, t in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = f(*[batch.column(i).to_pylist() for i in at])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stays), *(pa.array(x, t) for x, t in zip(made, types))], names=[f"c{i}" for i in range(len(stays) + len(types))])

    # by position, so that clashing names do no harm
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    ddl = StructType([plain.schema.fields[i] for i in stays])
    for k, (_, sql, _) in enumerate(new):
        ddl = ddl.add(f"n{k}", sql)
    return plain.mapInArrow(run, ddl).toDF(*[df.columns[i] for i in stays], *[name for name, _, _ in new])
