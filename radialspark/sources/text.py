"""Halo lists and id lists: text sources, and the text reports of halos, particles and counts."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER_LINES = 16
HALO_SCHEMA = "halo_row long, id long, mass float, x float, y float, z float"
#: Fixed positions of the fields of a halo line that are read.
FIELDS = {"id": 0, "mass": 2, "x": 8, "y": 9, "z": 10}


def numbered_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, value, n) with the number of each line in its file, and (file, lines, before) for the files in path order.

    A split of a file is read by one task, in order; what lies before it in the file is summed over the splits.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *meta).withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("k"), F.min("at").alias("low"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("low")).select("file", "block", "start")
    files = splits.groupBy("file").agg(F.sum("k").alias("lines"))
    return lines.join(starts, ["file", "block"]).select("file", "value", (F.col("at") + F.col("start")).alias("n")), files


def read_halos(spark: SparkSession, path: str | list[str], filter_ids: DataFrame | None = None, header: int = HEADER_LINES) -> DataFrame:
    """Halo lists as halo_row, id, mass, x, y, z; halo_row is the ordinal of the data line, on from file to file by path.

    Every file has ``header`` lines before its data; a file with fewer is refused. Lines are split at single spaces; a
    line with too few or malformed fields fails the query. A last line without a line end counts. With filter_ids (one
    column), only halos with a listed id are kept.
    """
    lines, files = numbered_lines(spark, path)
    sizes = sorted((r["file"], r["lines"]) for r in files.collect())  # a row per file
    if short := [f for f, n in sizes if n < header]:
        raise ValueError(f"fewer than {header} header lines in {short[0]}")
    rows, total = [], 0
    for file, n in sizes:
        rows.append((file, total - header))
        total += n - header
    base = F.broadcast(spark.createDataFrame(rows, "file string, base long"))  # a row per file
    part = F.split("value", " ")
    typed = {k: F.get(part, F.lit(i)).try_cast("long" if k == "id" else "float") for k, i in FIELDS.items()}
    bad = F.raise_error(F.concat(F.lit("malformed halo line: "), F.col("value")))
    # Filters on a field may be asked before the one on n, so each field asks for itself whether its line is data.
    fields = [F.when(F.col("n") < header, None).when(F.size(part) > 10, F.coalesce(c, bad)).otherwise(bad).alias(k) for k, c in typed.items()]
    out = lines.filter(F.col("n") >= header).join(base, "file").select((F.col("n") + F.col("base")).alias("halo_row"), *fields)
    return out if filter_ids is None else out.join(filter_ids.toDF("id"), "id", "left_semi").select(*out.columns)


def write_halos(halos: DataFrame, folder: str, files: int = 1) -> None:
    """halos(halo_row, id, mass, x, y, z) as halo lists, one in each of the folders part=0, part=1, ... of folder."""
    spark = halos.sparkSession
    fields = ["0"] * 40
    texts = {"id": "%d", "mass": "%s", "x": "%f", "y": "%f", "z": "%f"}
    for k, i in FIELDS.items():
        fields[i] = texts[k]
    values = [F.col("id").cast("long"), F.col("mass").cast("string"), *[F.col(a).cast("double") for a in "xyz"]]
    data = halos.select(F.pmod("halo_row", F.lit(files)).alias("part"), F.col("halo_row").alias("place"), F.format_string(" ".join(fields), *values).alias("value"))
    head = spark.range(files).select(F.col("id").alias("part"), F.explode(F.sequence(F.lit(-HEADER_LINES).cast("long"), F.lit(-1).cast("long"))).alias("place"))
    head = head.withColumn("value", F.format_string("# dummy header %d", F.col("place") + HEADER_LINES))
    rows = head.unionByName(data).repartition(files, "part").sortWithinPartitions("part", "place")
    rows.select("part", "value").write.partitionBy("part").text(folder)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """An id list: the integer that each line starts with; other lines give 0."""
    found = F.regexp_extract("value", r"^\s*([+-]?\d+)", 1)
    return spark.read.text(path).select(F.when(found == "", 0).otherwise(found.try_cast("long")).alias("id"))


def halo_line() -> Column:
    return F.format_string("%d: %f {%f %f %f}", "id", F.col("mass").cast("double"), *[F.col(a).cast("double") for a in "xyz"])


def particle_line() -> Column:
    return F.format_string("{%f %f %f}", *[F.col(a).cast("double") for a in "xyz"])


def report_rows(counts: DataFrame, radii: Sequence[float]) -> DataFrame:
    """One text per halo: its id and a line per shell."""
    names = [f"n{i}" for i in range(len(radii))]
    lines, low = [F.format_string("id %d", "id")], 0.0
    for name, r in zip(names, radii, strict=True):
        lines.append(F.format_string(f"  [{low:f} ~ {r:f}]: %d", name))
        low = r
    return counts.select("halo_row", F.concat_ws("\n", *lines).alias("text"))


def write_report(counts: DataFrame, radii: Sequence[float], path: str, legacy_total: bool = False) -> None:
    """The shell report in halo order, streamed through the driver, with the grand total at its end."""
    from radialspark.operators.shells import total

    sums = total(counts, legacy_total).first()
    tmp = path if path.startswith("/dev/") else f"{path}.tmp"
    with open(tmp, "w") as f:
        for row in report_rows(counts, radii).orderBy("halo_row").toLocalIterator():
            f.write(row["text"] + "\n")
        f.write("\nTotal\n")
        low = 0.0
        for i, r in enumerate(radii):
            f.write(f"  [{low:f} ~ {r:f}]: {sums[f'n{i}']}\n")
            low = r
    if tmp != path:
        os.replace(tmp, path)


def write_report_files(counts: DataFrame, radii: Sequence[float], folder: str, legacy_total: bool = False) -> None:
    """The shell report as text files of a folder, which in the order of their names are the report; written in parallel."""
    from radialspark.operators.shells import total

    names = [f"n{i}" for i in range(len(radii))]
    low, lines = 0.0, [F.lit("\nTotal")]
    for name, r in zip(names, radii, strict=True):
        lines.append(F.format_string(f"  [{low:f} ~ {r:f}]: %d", name))
        low = r
    last = total(counts, legacy_total).select(F.lit(1).alias("end"), F.lit(None).cast("long").alias("halo_row"), F.concat_ws("\n", *lines).alias("text"))
    rows = report_rows(counts, radii).select(F.lit(0).alias("end"), "halo_row", "text").unionByName(last)
    rows.repartitionByRange("end", "halo_row").sortWithinPartitions("end", "halo_row").select("text").write.mode("overwrite").text(folder)
