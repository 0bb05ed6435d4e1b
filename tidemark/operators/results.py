"""A store of results that belong to a run, a fold and a configuration: predictions, components, losses of a grid.

A part is written to a folder of its own first, then a line in the log commits it. Of the parts of one (run, fold, config) the one of
the last line counts, so a rerun replaces its own part and no other, and whatever stops between writing and committing leaves no trace
in what is read. The log has a line per commit; a part's rows are read from its folder alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG = "run string, fold string, config string, part string, number long, rows long"


def log(spark: SparkSession, path: str) -> DataFrame:
    """The commits: run, fold, config, part, number, rows."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def current(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The commits that count."""
    last = F.row_number().over(Window.partitionBy("run", "fold", "config").orderBy(F.desc("number"), "part"))
    lines = log(spark, path) if run is None else log(spark, path).where(F.col("run") == run)
    return lines.withColumn("_last", last).where("_last = 1").drop("_last")


def stage(df: DataFrame, path: str) -> tuple[str, int]:
    """Writes a part and returns its name and number of rows; nobody reads it before it is committed."""
    part = uuid.uuid4().hex
    df.write.parquet(f"{path}/parts/{part}")
    return part, df.sparkSession.read.parquet(f"{path}/parts/{part}").count()


def commit(spark: SparkSession, path: str, part: str, rows: int, *, run: str, fold: str = "", config: str = "") -> None:
    """Makes a part the one that counts for its run, fold and configuration."""
    own = log(spark, path).where((F.col("run") == run) & (F.col("fold") == fold) & (F.col("config") == config))
    number = (own.agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(run, fold, config, part, number, rows)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def put(df: DataFrame, path: str, *, run: str, fold: str = "", config: str = "") -> None:
    commit(df.sparkSession, path, *stage(df, path), run=run, fold=fold, config=config)


def done(spark: SparkSession, path: str, run: str) -> set[tuple[str, str]]:
    """The (fold, config) of a run that are committed: what a run that goes on may skip."""
    return {(r["fold"], r["config"]) for r in current(spark, path, run).select("fold", "config").collect()}


def get(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The rows of all parts that count, with run, fold and config."""
    lines = current(spark, path, run).collect()
    if not lines:
        raise ValueError("nothing is committed")
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/parts/{r['part']}" for r in lines]).withColumn("_part", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    names = spark.createDataFrame([(r["part"], r["run"], r["fold"], r["config"]) for r in lines], "_part string, run string, fold string, config string")
    return rows.join(F.broadcast(names), "_part").drop("_part")
