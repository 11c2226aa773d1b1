"""MinHash near-deduplication with DartMinHash signatures.

A text is a weighted set: its five-word shingles, weighted by how often it has them. Each unit of weight is a region on
which hashed darts land over time (a Poisson process whose gaps and targets are hashes of shingle, unit and dart number);
of the darts that hit a coordinate of the signature, the earliest counts. Texts thus agree in a coordinate with the
probability of their weighted Jaccard similarity, and only as many darts are thrown as the coordinates need.

Signatures are cut into bands; texts with a common band are candidates. In each bucket of a band, all members are first
compared with one pivot, by signature and then exactly and on whole texts. Links at or above the threshold join classes.
Then, of each bucket with several classes, what lies outside the largest one is compared with the members of other classes,
until no two classes that could be linked are left uncompared. Exact bounds of what two texts share, taken from bitmaps,
rule nearly all of these pairs out before they are made. No bucket is capped.

Equal texts are one text from the start. Texts of fewer words than a shingle have one shingle of all their words; texts
without words (null, empty) only equal each other. A null doc_id counts as the least one. Repeated rows share a class.
Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, drop_scratch, materialize, merge_join, table, text_key
from .langid import _binary, chunks
from .repeats import text_store
from .textbytes import BASES, PUNCT, U64, Words, mix, prefix, ranges

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
#: Deviations below the threshold from which a signature's estimate rules a pair out.
SIGMAS = 5.5
CHUNK = 1 << 19
#: 64-bit words of a text's bitmap of shared shingles.
WORDS = 16
#: Members of a bucket that a task compares with the bucket's pivots.
BLOCK = 512
#: Pairs a row above which a round takes only some pivots of each bucket (PIVOTS, four times as many in each later round).
ROW_PAIRS, PIVOTS = 4, 8
#: Pairs that a task verifies with one and the same text.
PAIRS = 256


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of every shingle occurrence of a batch, texts ascending."""
    data, ends = _binary(texts)
    words = Words(data, ends, PUNCT, fold=True)
    count = np.diff(words.first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    low = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + words.first[text]
    high = np.minimum(low + size, words.first[text + 1])
    return text, ranges(prefix(words.hash[0], BASES[0]), low, high, BASES[0])


def dart_signatures(text: np.ndarray, shingle: np.ndarray, texts: int, k: int) -> np.ndarray:
    """texts x k signatures (uint64) of weighted sets; a text without shingles has zeros."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    begin = np.flatnonzero(fresh)
    unit = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    with np.errstate(over="ignore"):
        region = mix(shingle + mix(unit.astype(U64) + U64(0x51ED2701)))
    weight = np.bincount(text, minlength=texts)
    sig = np.zeros((texts, k), U64)
    todo = np.flatnonzero(weight)
    until = np.zeros(texts)
    until[todo] = (k * np.log(k) + 2 * k) / weight[todo]
    while len(todo):
        mine = np.isin(text, todo)
        owner, seed = text[mine], region[mine]
        time = np.zeros(len(seed))
        found: list[tuple[np.ndarray, ...]] = []
        dart = 0
        while len(seed):
            with np.errstate(over="ignore"):
                h = mix(seed + U64(0x9E3779B97F4A7C15) * U64(2 * dart + 1))
                h2 = mix(seed + U64(0x9E3779B97F4A7C15) * U64(2 * dart + 2))
            time = time - np.log(((h >> U64(11)).astype(np.float64) + 1) * 2.0**-53)
            near = time <= until[owner]
            owner, seed, time, h2 = owner[near], seed[near], time[near], h2[near]
            found.append((owner * k + (h2 % U64(k)).astype(np.int64), time, h2))
            dart += 1
        cell, when, what = (np.concatenate(x) for x in zip(*found, strict=True))
        late = np.argsort(-when, kind="stable")
        best = np.zeros(texts * k, U64)
        best[cell[late]] = what[late] | U64(1)  # of equal cells the last one, the earliest dart, stays
        best = best.reshape(texts, k)
        full = (best[todo] != 0).all(axis=1)
        sig[todo[full]] = best[todo[full]]
        todo = todo[~full]
        until[todo] *= 2
    return sig


def signatures(store: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """store(tid, text) -> tid, buckets (a key per band), sketch (a byte per coordinate), for texts with shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                text, shingle = shingles(batch.column("text"), size)
                sig = dart_signatures(text, shingle, batch.num_rows, bands * rows)
                with np.errstate(over="ignore"):
                    key = np.tile(mix(np.arange(1, bands + 1, dtype=U64)), (batch.num_rows, 1))
                    for r in range(rows):
                        key = mix(key * U64(0xD6E8FEB86659FD93) + sig[:, r::rows])
                some = np.flatnonzero(sig[:, 0])
                key = key[some].view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), pa.array(key.ravel()))
                bytes_ = pa.array([x.tobytes() for x in (sig[some] >> U64(32)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(some)), lists, bytes_], ["tid", "buckets", "sketch"])

    return store.select("tid", "text").mapInArrow(sign, "tid long, buckets array<long>, sketch binary")


def hopeful(pairs: DataFrame, sketches: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs whose signatures agree in no fewer coordinates than SIGMAS deviations below ``least``.

    A pair at the threshold is lost here with a probability below 1e-7, less than a band-wise miss.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                k = a.shape[1]
                good = pa.array((a == b).sum(axis=1) >= k * least - SIGMAS * np.sqrt(k * least * (1 - least)))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    left = merge_join(pairs, sketches.select(F.col("tid").alias("a"), F.col("sketch").alias("sa")), "a")
    both = merge_join(left, sketches.select(F.col("tid").alias("b"), F.col("sketch").alias("sb")), "b")
    return materialize(both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"))


def jaccard(left: pa.Array, right: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of each pair of texts."""
    n = len(left)
    parts = [shingles(x, size) for x in (left, right)]
    text = np.concatenate([p[0] for p in parts])
    shingle = np.concatenate([p[1] for p in parts])
    sign = np.concatenate([np.ones(len(parts[0][0]), np.int64), np.zeros(len(parts[1][0]), np.int64)])
    order = np.lexsort((shingle, text))
    text, shingle, sign = text[order], shingle[order], sign[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return np.zeros(n)
    both = np.diff(np.append(begin, len(text)))
    a = np.add.reduceat(sign, begin)
    low = np.bincount(text[begin], np.minimum(a, both - a), n)
    high = np.bincount(text[begin], np.maximum(a, both - a), n)
    return low / np.maximum(high, 1)


def linked(pairs: DataFrame, store: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, "ta", CHUNK):
                good = jaccard(batch.column("ta"), batch.column("tb")) >= least
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    # Counted before texts are moved: a text with many pairs meets them block by block.
    ends = pairs.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("tid")), F.struct(F.lit("b").alias("side"), F.col("b").alias("tid")))).alias("x"))
    many = ends.groupBy("x.side", "x.tid").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("blocks")).filter("blocks > 1")
    many = materialize(many) if pairs.count() > PAIRS else None
    both, counted = pairs, None
    if many is not None and not many.isEmpty():
        for side in ("a", "b"):
            both = merge_join(both, many.filter(F.col("side") == side).select(F.col("tid").alias(side), F.col("blocks").alias(f"{side}_blocks")), side, "left")
        both = counted = materialize(both)
    for side, other in (("a", "b"), ("b", "a")):
        both = _with_text(both, store, side, other, counted)
    out = materialize(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"))
    drop_scratch(*(x for x in (many, counted) if x is not None))
    return out


def _with_text(pairs: DataFrame, store: DataFrame, side: str, other: str, counted: DataFrame | None) -> DataFrame:
    """pairs with the text of one side; counted: their ids alone, with the number of blocks of a text that has several."""
    texts = store.select(F.col("tid").alias(side), F.col("text").alias(f"t{side}"))
    if counted is None:
        return merge_join(pairs, texts, side)
    n = F.col(f"{side}_blocks")
    block = F.pmod(F.xxhash64(other), n).cast("int").alias("block")
    few = merge_join(pairs.filter(n.isNull()), texts, side)
    copies = merge_join(texts, counted.filter(n > 1).select(side, block).distinct(), side)
    return few.unionByName(merge_join(pairs.filter(n > 1).withColumn("block", block), copies, [side, "block"]).drop("block"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> tid, c (the least tid of its component), by minimum labels and pointer jumping."""
    edges = materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = materialize(edges.groupBy(F.col("x").alias("tid")).agg(F.least(F.min("y"), F.first("x")).alias("c")))
    while True:
        near = merge_join(edges, label.withColumnRenamed("tid", "y"), "y").groupBy(F.col("x").alias("tid")).agg(F.min("c").alias("m"))
        step = materialize(merge_join(label, near, "tid").select("tid", "c", F.least("c", "m").alias("m")))
        up = step.select(F.col("tid").alias("m"), F.col("m").alias("mm"))
        after = materialize(merge_join(step, up, "m", "left").select("tid", F.col("c").alias("old"), F.least(F.col("m"), F.coalesce("mm", "m")).alias("c")))
        drop_scratch(step, label)
        label = after.select("tid", "c")
        if after.filter("old <> c").isEmpty():
            drop_scratch(edges)
            return label


def near_classes(store: DataFrame, least: float = SIMILAR) -> DataFrame:
    """tid, c for the texts of store(tid, text) that are linked to another; all other texts are on their own."""
    signed = materialize(signatures(store))
    sketches = signed.select("tid", "sketch")
    rows = signed.select(F.explode("buckets").alias("bucket"), "tid")
    shared = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    left = materialize(merge_join(rows, shared, "bucket"))
    # A bucket's first pivot is the text that meets most others over all bands: the original, if a bucket holds copies of it.
    met_by = materialize(left.groupBy("tid").agg(F.sum(F.col("n") - 1).alias("met")))
    left = materialize(merge_join(left, met_by, "tid").select("bucket", "tid", F.struct((-F.col("met")).alias("m"), F.xxhash64("tid").alias("h"), "tid").alias("p")))
    first = materialize(left.groupBy("bucket").agg(F.min("p").alias("f")).select("bucket", F.col("f.tid").alias("pivot")))
    left = materialize(merge_join(left, first, "bucket").filter("tid <> pivot"))
    checked = materialize(left.select(F.least("tid", "pivot").alias("a"), F.greatest("tid", "pivot").alias("b")).distinct())
    # Only texts with a candidate are moved again, once for all rounds.
    store = bucketed(merge_join(store.select("tid", "text"), met_by.select("tid"), "tid", "left_semi"), "tid")
    drop_scratch(shared, first, met_by)
    links = linked(hopeful(checked, sketches, least), store, least)
    label = components(links)
    drop_scratch(checked, links)
    rest = materialize(merge_join(left.select("bucket", "tid"), label, "tid", "left").withColumn("c", F.coalesce("c", "tid")))
    # Aggregates are written before they are joined: then both sides of the join are shuffled, and a large bucket is split.
    several = materialize(rest.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("bucket"))
    rest = materialize(merge_join(rest, several, "bucket"))
    if not rest.count():
        return label
    rest = materialize(merge_join(rest, shared_bits(store, rest.select("tid").distinct()), "tid"))
    some = PIVOTS
    while True:
        rest = _open(rest, least)
        rows = rest.count()
        if not rows:
            return label
        met = meetings(rest, least)
        last = met.count() <= ROW_PAIRS * rows
        if not last:  # groups that the first pivots missed: a few more in each bucket join most of them
            met = meetings(rest, least, some)
        near = materialize(met.distinct())
        found = linked(near.select("a", "b"), store, least)
        if not found.isEmpty():
            joined = merge_join(near, found, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
            merged = components(joined)
            renamed = merged.select(F.col("tid").alias("c"), F.col("c").alias("to"))
            alone = merge_join(merged, label, "tid", "left_anti").select("tid", F.col("tid").alias("c"))
            label = materialize(merge_join(label.unionByName(alone), renamed, "c", "left").select("tid", F.coalesce("to", "c").alias("c")))
            rest = merge_join(rest, renamed, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")
        if last:
            return label
        rest = rest.filter(~F.col("pivot") | ~_chosen(some))
        some *= 4


def _open(rows: DataFrame, least: float) -> DataFrame:
    """The rows of buckets with several classes that can have a link there, and what their bucket holds.

    A text that shares too little even for the lightest of its bucket has no link in it. pivot: the row is outside the
    largest class of its bucket, so that comparing all such rows with the bucket leaves no two classes uncompared.
    """
    rows = rows.drop("size", "minor", "pivot")
    lightest = materialize(rows.groupBy("bucket").agg(F.min("w").alias("wm")))
    rows = materialize(merge_join(rows, lightest, "bucket")).filter(F.col("s") >= _need(least) * (F.col("w") + F.col("wm")) - 1e-6).drop("wm")
    classes = rows.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    buckets = classes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("classes"))
    buckets = materialize(buckets.filter("classes > 1").select("bucket", "size", (F.col("size") - F.col("top.n")).alias("minor"), F.col("top.c").alias("main")))
    return materialize(merge_join(rows, buckets, "bucket").withColumn("pivot", F.col("c") != F.col("main")).drop("main"))


def _need(least: float) -> float:
    """Of the summed weights of two texts: what they must share."""
    return least / (1 + least)


def _chosen(some: int) -> Column:
    """About ``some`` of a bucket's pivots; all of them once ``some`` has reached their number."""
    return F.expr(f"pmod(xxhash64(tid, {some}), greatest(1, minor div {some})) = 0")


def meetings(rest: DataFrame, least: float, some: int | None = None) -> DataFrame:
    """a, b, ca, cb: pivots and members of other classes of one bucket that may be linked, once per common bucket.

    Pairs are ruled out inside the join, by exact bounds of the shared weight, and never made. The members of a bucket are
    split into blocks of BLOCK rows, and its pivots meet each block in another task.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    names = ["tid", "c", "w", "s", "over", *[f"m{i}" for i in range(WORDS)]]
    pivots = rest.filter("pivot") if some is None else rest.filter(F.col("pivot") & _chosen(some))
    left = pivots.select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *[F.col(n).alias(f"q_{n}") for n in names])
    right = rest.select("bucket", F.pmod(F.xxhash64("tid"), blocks).cast("int").alias("block"), "pivot", *names)
    once = F.lit(True) if some else ~F.col("pivot") | (F.col("q_tid") < F.col("tid"))
    need = _need(least) * (F.col("w") + F.col("q_w")) - 1e-6
    bits = sum((F.bit_count(F.col(f"m{i}").bitwiseAND(F.col(f"q_m{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("m0").bitwiseAND(F.col("q_m0"))))
    may = (F.col("c") != F.col("q_c")) & once & (F.least("s", "q_s") >= need) & (bits + F.least("over", "q_over") >= need)
    both = left.join(right, (left.bucket == right.bucket) & (left.block == right.block) & may)
    first = F.col("tid") < F.col("q_tid")
    return both.select(F.least("tid", "q_tid").alias("a"), F.greatest("tid", "q_tid").alias("b"), F.when(first, F.col("c")).otherwise(F.col("q_c")).alias("ca"), F.when(first, F.col("q_c")).otherwise(F.col("c")).alias("cb"))


def shared_bits(store: DataFrame, tids: DataFrame) -> DataFrame:
    """tid, w (weight of the text's shingles), s (of those that another of the tids has, too), m0, m1, ... and over.

    The m are WORDS * 64 bits, set where a shared shingle falls; over is what s exceeds the number of set bits by. No two
    of the texts can share more than the smaller s, or than their common bits and the smaller over: exact bounds, which
    edits of one original, each unlike the others, do not meet.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                text, shingle = shingles(batch.column("text"))
                order = np.lexsort((shingle, text))
                text, shingle = text[order], shingle[order]
                begin = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1]))) if len(text) else np.zeros(0, np.int64)
                n = np.diff(np.append(begin, len(text)))
                tids_ = batch.column("tid").to_numpy(zero_copy_only=False)[text[begin]]
                yield pa.RecordBatch.from_arrays([pa.array(tids_), pa.array(shingle[begin].view(np.int64)), pa.array(n.astype(np.int64))], ["tid", "h", "n"])

    rows = materialize(merge_join(store.select("tid", "text"), tids, "tid", "left_semi").mapInArrow(count, "tid long, h long, n long"))
    shared = materialize(rows.groupBy("h").agg(F.count("*").alias("d")).filter("d > 1").select("h", F.lit(True).alias("also")))
    word = F.when(F.col("also"), F.pmod(F.shiftright("h", 6), F.lit(WORDS)))
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    both = merge_join(rows, shared, "h", "left").select("tid", "n", "also", word.alias("word"), bit.alias("bit"))
    masks = [F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0)).cast("long").alias(f"m{i}") for i in range(WORDS)]
    out = both.groupBy("tid").agg(F.sum("n").alias("w"), F.sum(F.when(F.col("also"), F.col("n")).otherwise(0)).alias("s"), *masks)
    out = materialize(out.withColumn("over", F.col("s") - sum((F.bit_count(f"m{i}") for i in range(1, WORDS)), F.bit_count("m0"))))
    drop_scratch(rows, shared)
    return out


def text_classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """docs(doc_id, text) -> k1, k2, class_id, h1, h2, copies: a row per distinct text, and the key of its class's head.

    The head is the text with the least (first_id, k1, k2) of its class. No two classes have one head, whereas they share
    a class_id where their least doc_ids are null or repeat.
    """
    store = text_store(docs, False)
    label = near_classes(store, least)
    named = merge_join(store.select("tid", "k1", "k2", "first_id", "copies"), label, "tid", "left").withColumn("c", F.coalesce("c", "tid"))
    heads = materialize(named.groupBy("c").agg(F.min(F.struct("first_id", "k1", "k2")).alias("h")))
    heads = heads.select("c", F.col("h.first_id").alias("class_id"), F.col("h.k1").alias("h1"), F.col("h.k2").alias("h2"))
    classes = materialize(merge_join(named, heads, "c").select("k1", "k2", "class_id", "h1", "h2", "copies"))
    drop_scratch(store)
    return classes


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id (the least doc_id of its class), copies (rows with the same text), class_key.

    class_key names the class: the key of its head's text in hexadecimal. Classes with null or repeated doc_ids can share
    a class_id, but never a class_key.
    """
    key = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in ("h1", "h2")])
    classes = text_classes(docs, least).select("k1", "k2", "class_id", "copies", key.alias("class_key"))
    k1, k2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    return merge_join(keys, classes, ["k1", "k2"]).select("doc_id", "class_id", "copies", "class_key")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
