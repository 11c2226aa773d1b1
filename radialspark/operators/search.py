"""A whole search from files to counts: halos, an optional id list, particle files, in one batch or as a stream of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from radialspark.operators.shells import shell_counts
from radialspark.sources.binary import decode_compressed, read_particles
from radialspark.sources.scratch import new_folder
from radialspark.sources.text import read_halos, read_ids

MODES = ("batch", "incremental")


def search(
    spark: SparkSession,
    halo_file: str,
    particle_files: str | Sequence[str],
    radii: Sequence[float],
    *,
    filter_file: str | None = None,
    compressed: bool = False,
    mode: str = "batch",
    **options,
) -> DataFrame:
    """Counts per halo: all files in one pass (batch), or a micro-batch per file whose counts add up (incremental).

    Incremental takes one folder or pattern of decoded files.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    files = [particle_files] if isinstance(particle_files, str) else list(particle_files)
    if not files or not halo_file:
        raise ValueError("a halo file and particle files are needed")
    halos = read_halos(spark, halo_file, read_ids(spark, filter_file) if filter_file else None)
    if mode == "batch":
        particles = decode_compressed(spark, files) if compressed else read_particles(spark, files)
        return shell_counts(halos, particles, radii, **options)
    if compressed or len(files) != 1:
        raise ValueError("incremental mode takes one folder or pattern of decoded files")
    from radialspark.streaming.incremental import count_files_to, read_counts

    out = new_folder(spark)
    count_files_to(spark, halos, files[0], radii, f"{out}/counts", f"{out}/progress", **options).awaitTermination()
    return read_counts(spark, halos, f"{out}/counts")
