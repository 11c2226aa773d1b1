"""Helpers that the operators of this subpackage share: tables, scratch tables, distributed ranks, text keys.

Scratch tables go to the folder named in ``spark.checkpoint.dir`` (shared by driver and executors), so that a lost
executor costs a re-read and never a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOW33 = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the session names none (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths of the scratch tables made inside each open ``scratch_scope``.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made inside go at its end, but for the last one made."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
    for path in made[:-1]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if (name := path.rsplit("/", 1)[-1]).startswith("scratch_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers as SQL VALUES, which needs no Python on the executors."""
    fields = [f.split() for f in schema.split(", ")]
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in fields) + " WHERE false")
    listed = ", ".join("(" + ", ".join(repr(float(x)) + "D" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {listed} AS t({', '.join(name for name, _ in fields)})")


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the data: a small file can hold many rows, so its size proves nothing."""
    return left.join(right.hint("merge"), on, how)


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and fixes what was computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    # The write's shuffle files go when it ends; what is read later is the written table.
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, folder: str | None = None) -> DataFrame:
    """Write df as a table of as many buckets as there are shuffle partitions, each sorted by ``by``, and read it back.

    Joins and groupings by that column need no exchange of such a table. Without a folder it is a scratch table.
    """
    spark = df.sparkSession
    name = f"scratch_{uuid.uuid4().hex}"
    made = f"{folder or shared_dir(spark) + '/scratch'}/{name}"
    n = partitions(spark)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", made).option("compression", "zstd").saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, was)
    if _SCOPES and not folder:
        _SCOPES[-1].append(made)
    return spark.table(name)


def reopened(spark: SparkSession, path: str, schema: str, by: str, n: int) -> DataFrame:
    """A table that ``bucketed`` wrote, perhaps in another session."""
    name = path.rsplit("/", 1)[-1]
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def drop_scratch(*dfs: DataFrame) -> None:
    """Delete the files of scratch tables that nothing reads any more."""
    for df in dfs:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/scratch/" in path:
                _delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, by: list[str | Column], name: str = "rank") -> DataFrame:
    """df and its gapless rank (long, from 0) in the order of ``by``, without a single-task sort.

    Rows are range-partitioned and sorted; the partition-local number comes from monotonically_increasing_id. The
    numbered rows are written once, so that counts and rows come from the same partitioning. Only one row per partition
    is summed in one task. ``by`` must order equal rows only if they're interchangeable.
    """
    spark = df.sparkSession
    n = partitions(spark)
    order = [F.col(c) if isinstance(c, str) else c for c in by]
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = materialize(placed.withColumn("__mono", F.monotonically_increasing_id()))
    kept = kept.withColumn("__part", F.shiftright("__mono", 33).cast("int"))
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append((part, total))
        total += sizes.get(part, 0)
    offsets = values(spark, starts, "__part int, __start long")
    local = F.col("__mono").bitwiseAND(F.lit(LOW33))
    return (
        kept.join(F.broadcast(offsets), "__part")  # one row per shuffle partition
        .withColumn(name, F.col("__start") + local)
        .drop("__mono", "__part", "__start")
    )


def text_key(text: Column) -> tuple[Column, Column]:
    """128-bit key of a text: two xxhash64 runs whose start values differ."""
    return F.xxhash64(F.lit(0), text), F.xxhash64(F.lit(1), text)
