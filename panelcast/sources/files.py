"""Readers and writers: explicit schemas, partitioned forecast files, resumable sinks."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelcast.functions import calendar

#: Schemas of the interchange files.
SERIES = "location string, origin_date date, wili double"
VERSIONS = "location string, origin_date date, as_of date, wili double"
FORECAST = ["origin_date", "location", "target", "horizon", "target_end_date", "output_type", "output_type_id", "value"]
FORECAST_SCHEMA = "origin_date date, location string, target string, horizon int, target_end_date date, output_type string, output_type_id double, value double"


def plain_names(df: DataFrame) -> DataFrame:
    """Without the leading dots that some names have in their files."""
    return df.toDF(*[c.lstrip(".") for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema, found by name in a CSV table with a header; NA and empty are null. Columns in another order or
    more of them do no harm, one that is missing fails. Names may have a leading dot in the file."""
    rows = plain_names(spark.read.option("header", True).option("nullValue", "NA").csv(path))
    wanted = StructType.fromDDL(schema)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def seasoned(df: DataFrame, day: str = "origin_date") -> DataFrame:
    """With season_year (from the 205th day of the year on) and the week's rank in its season."""
    rows = df.withColumn("season_year", calendar.summer_season_year(F.col(day)))
    weeks = rows.select("season_year", day).distinct().withColumn("woy", F.row_number().over(Window.partitionBy("season_year").orderBy(day)))
    return rows.join(weeks, ["season_year", day])


def read_versions(spark: SparkSession, path: str, last_season: int) -> DataFrame:
    """Versions up to a season, with the season and the delay in weeks, rounded."""
    rows = read_csv(spark, path, VERSIONS).withColumn("season_year", calendar.summer_season_year(F.col("origin_date")))
    return rows.filter(F.col("season_year") <= last_season).withColumn("delay", F.round(F.datediff("as_of", "origin_date") / 7).cast("int"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local session (as in tests) gets a folder
    of its own, which is removed with the process; on a cluster, where no such folder is shared, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="panelcast-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder in any store that Spark writes."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """location, target_end_date, value; rows without a value are dropped."""
    rows = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    return rows.select("location", F.col("target_end_date").cast("date"), F.col("oracle_value").cast("double").alias("value")).na.drop()


def read_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files below a folder, with model_id and the origin of the file's name. The files must have the columns in the
    fixed order (validation.headers names those that don't): one that has another order fails the job."""
    rows = spark.read.schema(FORECAST_SCHEMA).option("header", True).option("enforceSchema", False).option("nullValue", "NA").csv(f"{folder}/*/*.csv").withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumns({"model_id": F.regexp_extract("file", r"^\d{4}-\d{2}-\d{2}-(.+)\.csv$", 1), "file_origin": F.expr("try_to_date(regexp_extract(file, '^([0-9]{4}-[0-9]{2}-[0-9]{2})-', 1))")})


def read_model(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """One model's table; model_id is the file's own column where it has one."""
    rows = plain_names(spark.read.option("header", True).option("nullValue", "NA").csv(path))
    name = F.col("model_id") if "model_id" in rows.columns else F.lit(model_id)
    return rows.select(name.alias("model_id"), *[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(FORECAST_SCHEMA)])


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row: origin_dates, locations, horizons, target, levels of a hub's tasks file."""
    task = F.col("rounds")[0]["model_tasks"][0]
    ids = task["task_ids"]
    return spark.read.option("multiLine", True).json(path).select(ids["origin_date"]["optional"].alias("origin_dates"), ids["location"]["optional"].alias("locations"), ids["horizon"]["optional"].alias("horizons"), ids["target"]["required"][0].alias("target"), task["output_type"]["quantile"]["output_type_id"]["required"].alias("levels"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """file and a map of its key=value lines."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).filter(F.instr("value", "=") > 0)
    pair = F.split("value", "=", 2)
    return lines.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.trim(pair[0]), F.trim(pair[1])))).alias("pairs"))


def write_forecasts(table: DataFrame, folder: str, dry_run: bool = False) -> list[str]:
    """One quoted CSV per (model_id, origin_date), in the fixed order of columns: the file names that are, or with dry_run
    would be, written. Executors write the rows, a folder per file; the driver renames, file by file."""
    keys = table.select("model_id", "origin_date").distinct().collect()
    names = sorted(f"{folder}/{r.model_id}/{r.origin_date}-{r.model_id}.csv" for r in keys)
    if dry_run:
        return names
    spark = table.sparkSession
    stage = f"{folder}/_stage"
    order = [F.col(c) for c in FORECAST]
    rows = table.select("model_id", F.col("origin_date").alias("_origin"), *order)
    rows.repartition("model_id", "_origin").write.mode("overwrite").partitionBy("model_id", "_origin").option("header", True).option("quoteAll", True).csv(stage)
    Path_ = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path_(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in keys:
        target = Path_(f"{folder}/{r.model_id}/{r.origin_date}-{r.model_id}.csv")
        fs.mkdirs(target.getParent())
        part = next(s.getPath() for s in fs.listStatus(Path_(f"{stage}/model_id={r.model_id}/_origin={r.origin_date}")) if s.getPath().getName().endswith(".csv"))
        fs.delete(target, False)
        fs.rename(part, target)
    fs.delete(Path_(stage), True)
    return names


def write_metadata(path: str, team: str, model: str, designated: bool) -> None:
    """A model's small YAML file."""
    Path(path).write_text(f'team_abbr: "{team}"\nmodel_abbr: "{model}"\ndesignated_model: {json.dumps(designated)}\n')


def read_metadata(path: str) -> dict[str, str]:
    """Flat `key: value` YAML."""
    rows = [line.split(":", 1) for line in Path(path).read_text().splitlines() if ":" in line and not line.startswith("#")]
    return {k.strip(): v.strip().strip("'\"") for k, v in rows}


def check_metadata(path: str, model_id: str) -> list[str]:
    """What is wrong with a model's YAML file: names of letters, digits, _ and + of up to 25 characters that make up the
    model's id, and a flag."""
    if not Path(path).is_file():
        return ["no file"]
    found = read_metadata(path)
    out = [f"{key} is missing or malformed" for key in ("team_abbr", "model_abbr") if not re.fullmatch(r"[a-zA-Z0-9_+]{1,25}", found.get(key, ""))]
    if found.get("designated_model") not in ("true", "false"):
        out.append("designated_model is no flag")
    if not out and f"{found['team_abbr']}-{found['model_abbr']}" != model_id:
        out.append("names don't make up the model's id")
    return out


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def write_resumable(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Replaces only the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def to_markdown(rows: DataFrame, digits: int = 4) -> str:
    """A small result as a Markdown table."""
    pdf = rows.toPandas()
    cell = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(pdf.columns) + " |", "|" + "---|" * len(pdf.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in pdf.itertuples(index=False)])
