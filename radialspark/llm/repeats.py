"""Finding windows that repeat anywhere in a corpus, by content-chosen spans: what word and byte deduplication share.

A text is a row of units (words or bytes). Each window of W units is owned by one gram of G units inside it, the one with
the least hash (the leftmost of equals). Equal windows have equal owners at equal places, so a window can only repeat if
its owner's fingerprint does. Neighbouring windows with one owner form a span. Spans whose fingerprint is unique are done
with; equal spans are settled at once, however many there are; only the distinct spans of one fingerprint are looked into.

Hashes only propose. What they call equal is compared unit by unit with the first of its group: the ranges of a text that
match one other text in a row are joined, cut where the first text's units are multiples of PIECE, and all copies of a
piece meet in an aggregate that keeps a least and a greatest one. A group in which one copy differs is taken apart.

Texts come in stores, tables (tid, text, ...) that are bucketed by tid, so that no join by tid moves a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_scratch, global_rank, materialize, merge_join, text_key
from .langid import _binary, chunks
from .textbytes import BASES, SPACES, U64, Words, mix, powers, prefix, ranges

CHUNK = 1 << 20
#: Units of a piece that is compared.
PIECE = 256


def text_store(docs: DataFrame, ordered: bool, base: int = 0, folder: str | None = None) -> DataFrame:
    """The distinct texts of docs(doc_id, text): tid, k1, k2, first_id, copies, text; bucketed by tid.

    Null is the empty text. With ordered, tids ascend with the least doc_id of the text (null ids first). tids start at base.
    """
    k1, k2 = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    low = F.coalesce("doc_id", F.lit(-(1 << 63)))
    kept = rows.groupBy("k1", "k2").agg(F.min(low).alias("first_id"), F.count("*").alias("copies"), F.first("text").alias("text"))
    # Ids are written before anything is dealt by them: a task that runs again would number its rows anew.
    if not ordered:
        kept = materialize(kept.withColumn("tid", F.monotonically_increasing_id() + base))
        out = bucketed(kept, "tid", folder)
    else:
        kept = materialize(kept)
        ranked = global_rank(kept.select("first_id", "k1", "k2"), ["first_id", "k1", "k2"], "tid")
        out = bucketed(merge_join(kept, ranked.drop("first_id"), ["k1", "k2"]), "tid")
    drop_scratch(kept)
    return out


class Units:
    """The units of a batch of texts: a value each, and where each text's units start."""

    def __init__(self, texts: pa.Array, words: bool) -> None:
        self.data, ends = _binary(texts)
        self.words = Words(self.data, ends, SPACES, bases=2) if words else None
        if self.words:
            self.first, self.values = self.words.first, self.words.hash
        else:
            self.first = np.concatenate([[0], ends]).astype(np.int64)
            self.values = [self.data.astype(np.uint16) + 1] * 2
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, low: np.ndarray, high: np.ndarray, base: int = 0) -> np.ndarray:
        if base not in self._sums:
            self._sums[base] = prefix(self.values[base], BASES[base])
        return ranges(self._sums[base], low, high, BASES[base])

    def content(self, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        """The units of each range: bytes as they are, words with a space after each."""
        data, begin = self.words.spaced() if self.words else (self.data.tobytes(), None)
        if begin is not None:
            low, high = begin[low], begin[high]
        return [data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]

    def grams(self, size: int) -> np.ndarray:
        """The hash of the gram that starts at each unit (of the whole batch)."""
        n = int(self.first[-1]) - size + 1
        if n <= 0:
            return np.zeros(0, U64)
        sums = self._sums.setdefault(0, prefix(self.values[0], BASES[0]))
        with np.errstate(over="ignore"):
            return mix((sums[size:] - sums[:-size]) * powers(BASES[0], len(sums), True)[:n])

    def spans(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """Per span: text, fingerprint, hash, first window (unit in the text) and number of windows."""
        count = np.maximum(np.diff(self.first) - window + 1, 0)
        total = int(count.sum())
        if not total:
            return (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        value = self.grams(gram)
        low = (value & U64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=U64)
        width, have = window - gram + 1, 1
        while have < width:  # the least over width neighbours, by doubling
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        text = np.repeat(np.arange(len(count)), count)
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[:-1], count)
        owner = (low[at] & U64(0xFFFFFFFF)).astype(np.int64)
        start = np.ones(total, bool)
        start[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(start)
        n = np.diff(np.append(begin, total))
        s = at[begin]
        return text[begin], value[owner[begin]], self.hashes(s, s + n + window - 1), s - self.first[text[begin]], n


SPAN_SCHEMA = "fp long, span long, tid long, at int, n int"


def spans(store: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    """store(tid, text) -> one row per span: fp, span, tid, at, n."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                tids = batch.column("tid").to_numpy(zero_copy_only=False)
                text, fp, span, at, n = Units(batch.column("text"), words).spans(window, gram)
                columns = [fp.view(np.int64), span.view(np.int64), tids[text], at.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "span", "tid", "at", "n"])

    return store.select("tid", "text").mapInArrow(find, SPAN_SCHEMA)


def with_lists(store: DataFrame, rows: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """store joined with what rows has of each tid, as one array per column; a text has no more rows than units."""
    lists = rows.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("x"))
    return merge_join(store, lists.select("tid", *[F.col(f"x.{c}").alias(c) for c in columns]), "tid", how)


def _listed(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, ...]:
    """The text of each listed row of a batch of ``with_lists``, and its columns."""
    text = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(columns[0]).offsets.to_numpy()))
    return text, *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in columns)


def _mapped(stores: list[DataFrame], rows: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """f over the batches of every store with the rows' lists."""
    out = None
    for store in stores:
        part = with_lists(store.select("tid", "text"), rows, columns).mapInArrow(f, schema)
        out = part if out is None else out.unionByName(part)
    return out


PIECE_SCHEMA = "rt long, low int, size int, units binary"


def _pieces(text: np.ndarray, at: np.ndarray, n: np.ndarray, rt: np.ndarray, ra: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of spans that are to equal spans of other texts: text, first unit, other text, its first unit, size of each piece."""
    order = np.lexsort((at, ra - at, rt, text))
    text, at, n, rt, ra = (x[order] for x in (text, at, n, rt, ra))
    end = at + n + window - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (rt[1:] != rt[:-1]) | ((ra - at)[1:] != (ra - at)[:-1]) | (at[1:] > end[:-1])
    begin = np.flatnonzero(fresh)
    size = end[np.append(begin[1:], len(at)) - 1] - at[begin]
    text, at, rt, ra = (x[begin] for x in (text, at, rt, ra))
    first, last = ra // PIECE, (ra + size - 1) // PIECE
    which = np.repeat(np.arange(len(at)), last - first + 1)
    cell = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
    low = np.maximum(ra[which], cell * PIECE)
    high = np.minimum((ra + size)[which], (cell + 1) * PIECE)
    return text[which], at[which] + low - ra[which], rt[which], low, high - low


def unlike(stores: list[DataFrame], pairs: DataFrame, window: int, words: bool) -> DataFrame | None:
    """pairs(tid, at, n, rt, ra): spans that hashes call equal to that of text rt at ra -> the (rt, ra) where one differs.

    None if none does.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                units = Units(batch.column("text"), words)
                listed = _listed(batch, ["at", "n", "rt", "ra"])
                text, at, rt, low, size = _pieces(*(x.astype(np.int64) for x in listed), window)
                at = at + units.first[text]
                columns = [pa.array(rt), pa.array(low.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(units.content(at, at + size), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rt", "low", "size", "units"])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                units = Units(batch.column("text"), words)
                text, low, size = _listed(batch, ["low", "size"])
                at = low + units.first[text]
                tids = batch.column("tid").to_numpy(zero_copy_only=False)[text]
                columns = [pa.array(tids), pa.array(low), pa.array(size), pa.array(units.content(at, at + size), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rt", "low", "size", "units"])

    # Copies of one piece meet before they move: each task sends a least and a greatest one.
    extremes = [F.min("units").alias("least"), F.max("units").alias("most")]
    copies = materialize(_mapped(stores, pairs, ["at", "n", "rt", "ra"], members, PIECE_SCHEMA).groupBy("rt", "low", "size").agg(*extremes))
    needed = copies.select(F.col("rt").alias("tid"), "low", "size")
    own = _mapped(stores, needed, ["low", "size"], firsts, PIECE_SCHEMA)
    odd = merge_join(copies, own, ["rt", "low", "size"]).filter("least <> units OR most <> units").select("rt", "low", "size")
    if not odd.count():
        drop_scratch(copies)
        return None
    hit = F.expr(f"ra < low + size AND ra + n + {window} - 1 > low")
    out = materialize(pairs.select("rt", "ra", "n").distinct().join(odd, "rt").filter(hit).select("rt", "ra").distinct())
    drop_scratch(copies)
    return out


def settle(stores: list[DataFrame], found: DataFrame, window: int, words: bool) -> tuple[DataFrame, DataFrame]:
    """found(fp, span, tid, at, n) -> rows(fp, span, n, c, tid, at, odd) and pairs(tid, at, n, rt, ra).

    rows: a row per distinct span, with its number of occurrences (the sum of c, if found has it) and the first (least tid,
    at) of them; pairs: the other occurrences and the one that they equal, unit by unit. Spans that share their hashes but are not equal have a row
    each, with odd set.
    """
    by = ["fp", "span", "n"]
    c = F.sum("c") if "c" in found.columns else F.count("*")
    groups = found.groupBy(*by).agg(c.alias("c"), F.count("*").alias("k"), F.min(F.struct("tid", "at")).alias("f"))
    groups = materialize(groups.select(*by, "c", "k", F.col("f.tid").alias("tid"), F.col("f.at").alias("at")))
    many = groups.filter("k > 1").select(*by, F.col("tid").alias("rt"), F.col("at").alias("ra"))
    pairs = materialize(merge_join(found, many, by).filter("tid <> rt OR at <> ra").select(*by, "tid", "at", "rt", "ra"))
    bad = unlike(stores, pairs, window, words)
    rows = groups.drop("k").withColumn("odd", F.lit(False))
    if bad is None:
        return rows, pairs.select("tid", "at", "n", "rt", "ra")
    alone = [F.lit(1).cast("long").alias("c"), "tid", "at", F.lit(True).alias("odd")]
    whose = bad.select(F.col("rt").alias("tid"), F.col("ra").alias("at"))
    rows = rows.join(whose, ["tid", "at"], "left_anti").select(*by, "c", "tid", "at", "odd").unionByName(rows.join(whose, ["tid", "at"], "left_semi").select(*by, *alone))
    rows = rows.unionByName(pairs.join(bad, ["rt", "ra"], "left_semi").select(*by, *alone))
    return materialize(rows), materialize(pairs.join(bad, ["rt", "ra"], "left_anti").select("tid", "at", "n", "rt", "ra"))


def several(rows: DataFrame) -> DataFrame:
    """The rows of fingerprints that have more than one row."""
    again = materialize(rows.groupBy("fp").agg(F.count("*").alias("k")).filter("k > 1").select("fp"))
    return materialize(merge_join(rows, again, "fp", "left_semi"))


def settle_windows(stores: list[DataFrame], look: DataFrame, window: int, words: bool, bits: int = 64) -> DataFrame:
    """look(tid, at, n, single): spans -> tid, at, rt, ra, single of their windows that equal that of text rt at ra.

    The first window of each group of equal ones has a row with itself. single is passed on. bits: of either hash.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                units = Units(batch.column("text"), words)
                tids = batch.column("tid").to_numpy(zero_copy_only=False)
                text, at, n, single = _listed(batch, ["at", "n", "single"])
                at, n = at.astype(np.int64), n.astype(np.int64)
                which = np.repeat(np.arange(len(at)), n)
                start = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                low = units.first[text[which]] + start
                columns = [(units.hashes(low, low + window, b) & U64((1 << bits) - 1)).view(np.int64) for b in (0, 1)]
                columns += [tids[text[which]], start.astype(np.int32), single[which].astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w1", "w2", "tid", "at", "single"])

    rows = materialize(_mapped(stores, look, ["at", "n", "single"], find, "w1 long, w2 long, tid long, at int, single boolean"))
    again = _equal(rows, ["w1", "w2"])
    bad = unlike(stores, again.filter("tid <> rt OR at <> ra").select("tid", "at", F.lit(1).alias("n"), "rt", "ra"), window, words)
    if bad is None:
        drop_scratch(rows)
        return again

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                units = Units(batch.column("text"), words)
                text, at, single = _listed(batch, ["at", "single"])
                low = units.first[text] + at
                columns = [pa.array(units.content(low, low + window), pa.binary()), pa.array(batch.column("tid").to_numpy(zero_copy_only=False)[text]), pa.array(at), pa.array(single.astype(bool))]
                yield pa.RecordBatch.from_arrays(columns, ["units", "tid", "at", "single"])

    # Unlike windows with one hash: their units themselves are the key.
    mixed = again.join(bad, ["rt", "ra"], "left_semi").select("tid", "at", "single")
    spelt = materialize(_mapped(stores, mixed, ["at", "single"], spell, "units binary, tid long, at int, single boolean"))
    return materialize(again.join(bad, ["rt", "ra"], "left_anti").select("tid", "at", "rt", "ra", "single").unionByName(_equal(spelt, ["units"])))


def _equal(rows: DataFrame, by: list[str]) -> DataFrame:
    """tid, at, rt, ra, single of the rows whose key is not theirs alone; (rt, ra) is the first with the key."""
    many = materialize(rows.groupBy(*by).agg(F.count("*").alias("c"), F.min(F.struct("tid", "at")).alias("f")).filter("c > 1").select(*by, F.col("f.tid").alias("rt"), F.col("f.at").alias("ra")))
    return materialize(merge_join(rows, many, by).select("tid", "at", "rt", "ra", "single"))


def covered(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of size units lie in one of the ranges."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.cumsum(edge[:-1]) > 0
