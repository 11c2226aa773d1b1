"""Decoded and compressed particle files, parsed with numpy in Arrow batches.

Files up to WHOLE bytes come through Spark's reader, a file a row, from any store that Spark reads. Larger ones are read in
ranges of records by as many tasks, through Arrow's file systems (local, HDFS, S3, GCS). A file's header is parsed where
its records are, so that any number of files makes one plan.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radialspark.functions.grid import Decoding

PARTICLE_SCHEMA = "file string, pid long, x float, y float, z float"
COMPRESSED_SCHEMA = "file string, pid long, ux int, uy int, uz int"
#: Fixed layout of the header of a compressed file: it follows a 4-byte marker, and 8 bytes of markers follow it.
HEADER_FORMAT = "<6i6d2d2i6i2i4d3i2fi2q56s"
HEADER_AT, HEADER_SIZE, PAYLOAD_AT = 4, 256, 268
HEADER_FIELDS = (
    ("npart", 6), ("mass", 6), ("time", 1), ("redshift", 1), ("flag_sfr", 1), ("flag_feedback", 1), ("npartTotal", 6), ("flag_cooling", 1),
    ("num_files", 1), ("BoxSize", 1), ("Omega0", 1), ("OmegaLambda", 1), ("HubbleParam", 1), ("flag_stellarage", 1), ("flag_metals", 1),
    ("hashsize", 1), ("disp_min", 1), ("disp_max", 1), ("pos_bits", 1), ("id_start", 1), ("id_end", 1), ("fill", 1),
)
ROWS = 1 << 16


def parse_header(raw: bytes) -> dict:
    """The header fields of the first 260 bytes of a compressed file."""
    if len(raw) < HEADER_AT + HEADER_SIZE:
        raise ValueError("file is shorter than a header")
    values = iter(struct.unpack(HEADER_FORMAT, raw[HEADER_AT : HEADER_AT + HEADER_SIZE]))
    out = {}
    for name, n in HEADER_FIELDS:
        out[name] = next(values) if n == 1 else [next(values) for _ in range(n)]
    return out


#: Bytes up to which a file is one row, and bytes that a task reads of a larger one.
WHOLE, RANGE = 256 << 20, 64 << 20


def _files(spark: SparkSession, paths: str | list[str], stream: bool = False) -> DataFrame:
    if stream:
        return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 1).load(paths)
    return spark.read.format("binaryFile").load(paths)


def _open(path: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _scan(spark: SparkSession, paths: str | list[str], record: int, at: int, parse: Callable, schema: str, stream: bool, whole: int) -> DataFrame:
    """parse(path, head, first record, bytes of records) over all files; records start at byte ``at``, head comes before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from parse(path, content[:at], 0, content[at:])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n")), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    head = f.read_at(at, 0) if at else b""
                    yield from parse(path, head, first, f.read_at(n * record, at + first * record))

    files = _files(spark, paths, stream)
    if stream:
        return files.select("path", "content").mapInArrow(rows, schema)
    small = files.filter(F.col("length") <= whole).select("path", "content").mapInArrow(rows, schema)
    large = files.filter(F.col("length") > whole).select("path", "length")
    if large.isEmpty():
        return small
    step = max(1, RANGE // record)
    total = F.expr(f"(length - {at}) div {record}")
    cut = large.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0)), F.lit(step).cast("long"))))
    cut = cut.select("path", "first", F.least(F.lit(step).cast("long"), total - F.col("first")).alias("n"))
    return small.unionByName(cut.repartition("path", "first").mapInArrow(ranges, schema))


def _batches(file: str, first: int, rows: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows[0]), ROWS):
        part = [r[low : low + ROWS] for r in rows]
        n = len(part[0])
        columns = [pa.array([file] * n, pa.string()), pa.array(np.arange(first + low, first + low + n))] + [pa.array(np.ascontiguousarray(x)) for x in part]
        yield pa.RecordBatch.from_arrays(columns, names)


def read_particles(spark: SparkSession, paths: str | list[str], stream: bool = False, whole: int = WHOLE) -> DataFrame:
    """Decoded particles: headerless records of three little-endian float32; a partial record at the end is ignored."""

    def parse(file: str, head: bytes, first: int, content: bytes) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(content, "<f4", len(content) // 12 * 3).reshape(-1, 3)
        yield from _batches(file, first, [rows[:, k] for k in range(3)], ["file", "pid", "x", "y", "z"])

    return _scan(spark, paths, 12, 0, parse, PARTICLE_SCHEMA, stream, whole)


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, bytes; the contents are not read."""
    return _files(spark, paths).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_headers(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, dict]]:
    """(file, header) of each compressed file; 260 bytes of each reach the driver."""
    rows = _files(spark, paths).select("path", F.substring("content", 1, HEADER_AT + HEADER_SIZE).alias("head")).collect()
    return sorted((r["path"], parse_header(bytes(r["head"]))) for r in rows)


def header_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, field, value (text) of the headers of compressed files, to be shown."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, head in zip(batch.column("path").to_pylist(), batch.column("head").to_pylist(), strict=True):
                found = {k: v for k, v in parse_header(head).items() if k != "fill"}
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(list(found)), pa.array([str(v) for v in found.values()])], ["file", "field", "value"])

    return _files(spark, paths).select("path", F.substring("content", 1, HEADER_AT + HEADER_SIZE).alias("head")).mapInArrow(parse, "file string, field string, value string")


def _codes(head: bytes, first: int, content: bytes) -> np.ndarray:
    """Of the records that start with number ``first``, those that the header counts."""
    n = max(0, min(parse_header(head)["npart"][1] - first, len(content) // 6))
    return np.frombuffer(content, "<u2", n * 3).reshape(-1, 3)


def read_compressed(spark: SparkSession, paths: str | list[str], whole: int = WHOLE) -> DataFrame:
    """Compressed particles: npart[1] records of three uint16 behind the header; what is missing in the file is missing."""

    def parse(file: str, head: bytes, first: int, content: bytes) -> Iterator[pa.RecordBatch]:
        rows = _codes(head, first, content).astype(np.int32)
        yield from _batches(file, first, [rows[:, k] for k in range(3)], ["file", "pid", "ux", "uy", "uz"])

    return _scan(spark, paths, 6, PAYLOAD_AT, parse, COMPRESSED_SCHEMA, False, whole)


def decode_compressed(spark: SparkSession, paths: str | list[str], tiles: int = 1, wrap: bool = False, whole: int = WHOLE) -> DataFrame:
    """file, pid, x, y, z of compressed files, each by its own header."""

    def parse(file: str, head: bytes, first: int, content: bytes) -> Iterator[pa.RecordBatch]:
        codes = _codes(head, first, content)
        pid = np.arange(first, first + len(codes))
        yield from _batches(file, first, Decoding.of(parse_header(head), tiles).positions(pid, codes, wrap), ["file", "pid", "x", "y", "z"])

    return _scan(spark, paths, 6, PAYLOAD_AT, parse, PARTICLE_SCHEMA, False, whole)


def decode_files(spark: SparkSession, paths: str | list[str], folder: str, tiles: int = 1) -> DataFrame:
    """Decode compressed files to ``decoded_<name>`` in folder, a file a task: file, rows of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                codes = _codes(content[:PAYLOAD_AT], 0, content[PAYLOAD_AT:])
                xyz = Decoding.of(parse_header(content), tiles).positions(np.arange(len(codes)), codes)
                to = f"{folder.rstrip('/')}/decoded_{path.rsplit('/', 1)[-1]}"
                _write_file(to, np.stack(xyz, axis=1).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([len(codes)], pa.int64())], ["file", "rows"])

    rows = _files(spark, paths).select("path", "content").mapInArrow(run, "file string, rows long").collect()  # a row per file
    return spark.createDataFrame(rows, "file string, rows long")


def _write_file(path: str, content: bytes) -> None:
    """A file of its own name first, then moved, so that a task that runs again does no harm."""
    from pyarrow import fs

    system, name = _open(path) if ":" in path else (fs.LocalFileSystem(), path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(content)
    system.move(part, name)


def write_particle_files(particles: DataFrame, folder: str) -> int:
    """Decoded particles in the order of file and pid as files part-00000, part-00001, ... of folder, a task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [np.stack([b.column(a).to_numpy(zero_copy_only=False) for a in "xyz"], axis=1).astype("<f4") for b in batches if b.num_rows]
        n = sum(map(len, rows))
        if n:
            _write_file(f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}", b"".join(r.tobytes() for r in rows))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["rows"])

    by = [c for c in ("file", "pid") if c in particles.columns]
    placed = particles.repartitionByRange(*by).sortWithinPartitions(*by).select("x", "y", "z")
    return placed.mapInArrow(run, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def pack_compressed(header: dict, codes: np.ndarray) -> bytes:
    """A compressed file's bytes from header fields and an (n, 3) array of codes."""
    flat: list = []
    for name, n in HEADER_FIELDS:
        value = header.get(name, b"" if name == "fill" else 0 if n == 1 else [0] * n)
        flat.extend([value] if n == 1 else value)
    size = struct.pack("<i", HEADER_SIZE)
    return size + struct.pack(HEADER_FORMAT, *flat) + size + struct.pack("<i", codes.size * 2) + np.ascontiguousarray(codes, "<u2").tobytes()


def write_particles(particles: DataFrame, path: str) -> None:
    """Decoded particles in the order of file and pid, streamed through the driver into one local file."""
    with open(path, "wb") as f:
        for r in particles.orderBy(*[c for c in ("file", "pid") if c in particles.columns]).toLocalIterator():
            f.write(struct.pack("<3f", r["x"], r["y"], r["z"]))
