"""Scratch tables in the folder that driver and executors share, and ranks that need no single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where the session names none (one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch/{uuid.uuid4().hex}"


def ranked(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with its gapless rank (long, from 0) in the order of ``by``.

    Rows are range-partitioned, sorted and written, so that a partition's rows and its size come from one partitioning;
    the sizes, a row per partition, are the only thing that one task adds up.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark)
    df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    rows, total = [], 0
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(rows, "__part long, __start long"))  # a row per partition
    return kept.join(offsets, "__part").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")
