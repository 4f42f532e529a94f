"""Tables in and out: CSV, JSON, Parquet bundles, weekly partitions."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import clean_doubles, finite, require_columns
from ..operators.sets import assert_unique_keys


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in ``spark.checkpoint.dir``, which all machines share; what is written there goes when
    the application ends. Where the setting is unset on one machine, a temporary folder takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="epigrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to a scratch folder and read again: what several queries read is made once, and a
    lost executor costs no more than that."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; without a schema one is inferred. NaN becomes null."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    return clean_doubles((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def read_lookup(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    df = read_csv(spark, path)
    require_columns(df, columns, path)
    assert_unique_keys(df, [key], path)
    return df


def read_json_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return (reader.schema(schema) if schema else reader).json(path).withColumn("source_file", F.input_file_name())


def read_located(df: DataFrame, source: str, project=None) -> DataFrame:
    """Observations with x and y from an explicit coordinate source: "xy", or "lonlat" in
    range with a projection (a function of two columns to two)."""
    if source not in ("xy", "lonlat"):
        raise ValueError("the coordinate source must be xy or lonlat")
    if source == "xy":
        return df.where(finite("x") & finite("y"))
    kept = df.where(finite("lon") & finite("lat") & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    x, y = project("lon", "lat")
    return kept.withColumns({"x": x, "y": y})


def write_bundle(tables: dict[str, DataFrame], path: str, facts: dict | None = None) -> None:
    """Each table as Parquet under path, then a manifest.json; an existing one is an error."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), **(facts or {})}),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest.json")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    facts = json.loads(spark.read.text(f"{path}/manifest.json").first()["value"])
    return {n: spark.read.parquet(f"{path}/{n}") for n in facts["tables"]}, facts


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, and CSV beside it."""
    df.write.mode("errorifexists").parquet(f"{path}.parquet")
    df.write.mode("errorifexists").option("header", True).csv(f"{path}.csv")


def write_weekly(df: DataFrame, path: str, order: list[str] | None = None) -> DataFrame:
    """One partition a week; returns the manifest (epiyear, epiweek, files, rows, sha256). The
    hash is that of the week's rows: of the sorted hashes of ranges of at most some thousand
    rows' JSON, so it does not depend on files or partitions."""
    # Weeks of many rows are split over tasks, small ones put together.
    df.hint("rebalance", "epiyear", "epiweek").write.mode("errorifexists").partitionBy("epiyear", "epiweek").parquet(path)
    back = df.sparkSession.read.parquet(path)
    columns = sorted(c for c in back.columns)
    rows = back.select("epiyear", "epiweek", F.col("_metadata.file_path").alias("_file"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("_h"))
    parts = rows.groupBy("epiyear", "epiweek", F.substring("_h", 1, 3).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.collect_set("_file").alias("_f"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_h"))
    weeks = parts.groupBy("epiyear", "epiweek").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_f")))).cast("long").alias("files"), F.sum("_n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("_p", "_h"))), ""), 256).alias("sha256"))
    return weeks


def commit_tables(tables: dict[str, DataFrame], path: str, facts: dict | None = None) -> None:
    """``write_bundle`` all or nothing: into a folder beside it, renamed when all is written. An
    existing path is an error, before anything is written."""
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staged")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    fs.delete(staged, True)
    write_bundle(tables, f"{path}.staged", facts)
    if not fs.rename(staged, target):
        raise OSError(f"{path} could not be put in place")
