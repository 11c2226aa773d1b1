"""Suffix-array deduplication: bytes inside a long string that also starts earlier are removed.

Windows of WINDOW bytes are found again by content-chosen spans (see repeats.py). Equal spans are settled together. The
distinct spans of one fingerprint go to one shard as byte segments; each shard is sorted by external induced sorting, and
equal windows are neighbours there. Order is by ascending doc_id and place; all but the first of equal windows go. Windows
are judged on the input.

Null texts are empty; texts shorter than a window lose nothing. Equal texts: that with the least doc_id (null first) is
judged, all others lose everything. Rows with one doc_id and one text count as one document, each with its result.
Matches never cross documents. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, merge_join, partitions, table, text_key
from .induced import equal_windows
from .langid import chunks
from .repeats import CHUNK, Units, covered, settle, settle_windows, several, spans, text_store, with_lists

WINDOW, GRAM = 100, 32
#: A shard ends with the fingerprint that brings it to SHARD bytes; a fingerprint of more than HOT is split.
SHARD, HOT = 1 << 20, 1 << 23


def segments(store: DataFrame, look: DataFrame, window: int) -> DataFrame:
    """The bytes of the spans to look into: fp, tid, at, n, seg."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                units = Units(batch.column("text"), False)
                data = units.data.tobytes()
                tids = batch.column("tid").to_numpy(zero_copy_only=False)
                size = np.diff(batch.column("at").offsets.to_numpy())
                text = np.repeat(np.arange(batch.num_rows), size)
                fp, at, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("fp", "at", "n"))
                low = units.first[text] + at
                seg = [data[a:b] for a, b in zip(low.tolist(), (low + n + window - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(tids[text]), pa.array(at), pa.array(n), pa.array(seg, pa.binary())], ["fp", "tid", "at", "n", "seg"])

    some = with_lists(store.select("tid", "text"), look, ["fp", "at", "n"])
    return some.mapInArrow(cut, "fp long, tid long, at int, n int, seg binary")


def _late(rows: pa.Table, window: int) -> pa.RecordBatch:
    """tid, start of the windows in segments (tid, at, n, seg) that are equal to an earlier one."""
    tid, at, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("tid", "at", "n"))
    size = n + window  # each segment is followed by a separator
    begin = np.cumsum(size) - size
    s = np.ones(int(size.sum()) + 1, np.int16)  # 1 separates, bytes are 2 and more, 0 ends
    inside = np.ones(len(s) - 1, bool)
    inside[begin + size - 1] = False
    s[:-1][inside] = np.frombuffer(b"".join(rows.column("seg").to_pylist()), np.uint8).astype(np.int16) + 2
    s[-1] = 0
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n, -1)
    group, place = equal_windows(s, np.cumsum(edge)[:-1] > 0, window)
    which = np.searchsorted(begin, place, "right") - 1
    t, start = tid[which], at[which] + place - begin[which]
    order = np.lexsort((start, t, group))
    group, t, start = group[order], t[order], start[order]
    late = np.zeros(len(group), bool)
    late[1:] = group[1:] == group[:-1]
    return pa.RecordBatch.from_arrays([pa.array(t[late]), pa.array(start[late].astype(np.int32))], ["tid", "start"])


def later_windows(pieces: DataFrame, window: int) -> DataFrame:
    """tid, start of the windows in pieces that are equal to a window earlier in (tid, start).

    Each partition is in order of fp and read as a stream, of which one shard is held at a time.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for big in batches:
            for batch in chunks(big, "seg", SHARD):
                fp = batch.column("fp").to_numpy()
                before = np.append(0, np.cumsum(batch.column("n").to_numpy().astype(np.int64) + window))
                # Equal windows share a fingerprint, so a shard may end where one begins.
                cuts = np.flatnonzero(np.append(last is None or fp[0] != last, fp[1:] != fp[:-1]))
                low = 0
                while len(fits := cuts[(cuts >= low) & (before[cuts] >= before[low] + SHARD - size)]):
                    cut = int(fits[0])
                    yield _late(pa.Table.from_batches([*held, batch.slice(low, cut - low)]), window)
                    held, size, low = [], 0, cut
                held.append(batch.slice(low))
                size += int(before[-1] - before[low])
                last = fp[-1]
        if held:
            yield _late(pa.Table.from_batches(held), window)

    return pieces.mapInArrow(sort, "tid long, start int")


def repeated_byte_ranges(store: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """tid, low, high: byte ranges of windows that also start earlier; store's tids ascend with the documents."""
    found = materialize(spans(store, window, gram, False))
    hot = materialize(found.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp"))
    again = materialize(merge_join(found, hot, "fp"))
    drop_scratch(found, hot)
    rows, pairs = settle([store], again, window, False)
    drop_scratch(again)
    look = several(rows).select("fp", "tid", "at", "n")
    # A fingerprint of too many bytes for one task goes window by window, which no key holds together.
    large = materialize(look.groupBy("fp").agg(F.sum(F.col("n") + window).alias("size")).filter(F.col("size") > HOT).select("fp"))
    rest, split = look, None
    if large.count():
        many = merge_join(look, large, "fp", "left_semi").select("tid", "at", "n", F.lit(True).alias("single"))
        split = settle_windows([store], many, window, False).filter("tid <> rt OR at <> ra").select("tid", F.col("at").alias("start"))
        rest = merge_join(look, large, "fp", "left_anti")
    pieces = segments(store, rest, window).repartition(partitions(store.sparkSession), "fp").sortWithinPartitions("fp")
    windows = later_windows(pieces, window)
    if split is not None:
        windows = windows.unionByName(split)
    windows = windows.select("tid", F.col("start").alias("low"), (F.col("start") + window).alias("high"))
    whole = pairs.select("tid", F.col("at").alias("low"), (F.col("at") + F.col("n") + window - 1).alias("high"))
    out = materialize(whole.unionByName(windows))
    drop_scratch(rows, pairs, large)
    return out


RESULT = "k1 long, k2 long, first_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, raw_sha256 string"


def cut_bytes(store: DataFrame, keep: bool = False) -> DataFrame:
    """store(k1, k2, first_id, text, low, high) -> what is left of each text, and the text itself (whole characters)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                units = Units(batch.column("text"), False)
                low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
                rows: list[list] = [[] for _ in range(6)]
                for i in range(batch.num_rows):
                    data = units.data[units.first[i] : units.first[i + 1]]
                    gone = covered(len(data), np.array(low[i] or [], np.int64), np.array(high[i] or [], np.int64))
                    left = data[~gone].tobytes()
                    raw = hashlib.sha256(data.tobytes()).hexdigest()
                    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    for column, x in zip(rows, (len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), raw, left.decode("utf-8", "ignore") if keep else ""), strict=True):
                        column.append(x)
                out = [batch.column(c) for c in ("k1", "k2", "first_id")] + [pa.array(r, pa.int64() if k < 3 else pa.string()) for k, r in enumerate(rows[: 5 + keep])]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = RESULT + (", kept string" if keep else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return store.select("k1", "k2", "first_id", "text", "low", "high").mapInArrow(cut, schema)


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: bool = False) -> DataFrame:
    """All columns of docs but text -> the same with n_bytes, n_removed, n_spans, kept_sha256 (and kept, the text)."""
    store = text_store(docs, True)
    ranges_ = repeated_byte_ranges(store, window, gram)
    results = materialize(cut_bytes(with_lists(store, ranges_, ["low", "high"], "left"), keep))
    drop_scratch(store, ranges_)
    k1, k2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    both = docs.withColumn("__k1", k1).withColumn("__k2", k2).drop("text")
    names = [c for c in docs.columns if c != "text"]
    both = merge_join(both, results.select(*[F.col(c).alias(f"__{c}") for c in results.columns]), ["__k1", "__k2"])
    late = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) != F.col("__first_id")) & (F.col("__n_bytes") >= window)
    out = [
        F.col("__n_bytes").alias("n_bytes"),
        F.when(late, F.col("__n_bytes")).otherwise(F.col("__n_removed")).alias("n_removed"),
        F.when(late, F.lit(1)).otherwise(F.col("__n_spans")).cast("long").alias("n_spans"),
        F.when(late, F.sha2(F.lit(""), 256)).otherwise(F.col("__kept_sha256")).alias("kept_sha256"),
    ]
    if keep:
        out.append(F.when(late, F.lit("")).otherwise(F.col("__kept")).alias("kept"))
    return both.select(*[F.col(c) for c in names], *out)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
