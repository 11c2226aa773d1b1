"""Shell counts that grow as particle files arrive: one micro-batch per file against static halos.

``count_files`` keeps running counts as state and shows them in a table of the driver's memory, for small halo lists;
``count_files_to`` writes each micro-batch's counts to a folder of its own, which a batch that runs again replaces, and
``read_counts`` adds them up, so that neither state nor driver hold a row per halo.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from radialspark.functions.geometry import check_radii
from radialspark.operators.shells import neighbours, shell_of
from radialspark.sources.binary import read_particles


def streaming_counts(halos: DataFrame, particles: DataFrame, radii: Sequence[float], **options) -> DataFrame:
    """The running counts of halos that have met a particle; state is one row per halo."""
    radii = check_radii(radii)
    near = neighbours(halos, particles, radii[-1], **options).withColumn("shell", shell_of(F.col("d2"), radii))
    return near.groupBy("halo_row").agg(*[F.count(F.when(F.col("shell") == i, 1)).alias(f"n{i}") for i in range(len(radii))])


def count_files(spark: SparkSession, halos: DataFrame, folder: str, radii: Sequence[float], name: str, checkpoint: str | None = None, **options) -> StreamingQuery:
    """Start counting the files of folder into the in-memory table ``name``, as far as they are there now."""
    rows = streaming_counts(halos, read_particles(spark, folder, stream=True), radii, **options)
    writer = rows.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def with_zeros(halos: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts of all halos, as the batch query returns them."""
    names = [c for c in counts.columns if c != "halo_row"]
    return halos.select("halo_row", "id").join(counts, "halo_row", "left").select("halo_row", "id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def count_files_to(spark: SparkSession, halos: DataFrame, folder: str, radii: Sequence[float], out: str, checkpoint: str, **options) -> StreamingQuery:
    """Start counting the files of folder that are there now and were not counted before, into out/batch=<number>."""

    def write(files: DataFrame, number: int) -> None:
        streaming_counts(halos, files, radii, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = read_particles(spark, folder, stream=True).writeStream.foreachBatch(write).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def read_counts(spark: SparkSession, halos: DataFrame, out: str) -> DataFrame:
    """The counts of all halos over all micro-batches so far."""
    rows = spark.read.parquet(out).drop("batch")
    return with_zeros(halos, rows.groupBy("halo_row").agg(*[F.sum(c).cast("long").alias(c) for c in rows.columns if c != "halo_row"]))
