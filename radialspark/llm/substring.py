"""Substring deduplication over a log-structured index of window fingerprints.

The index is a list of immutable runs: tables bucketed and sorted by fingerprint, with a row per distinct span of windows
(see repeats.py). A new batch becomes a run and is merge-joined with the older runs, bucket by bucket, without moving them;
what occurs again is verified word by word; and runs are compacted into one when there are more than FAN of them. An index
with a folder stays there and is opened again by later sessions. Windows are judged on the input, and both sides of a
repeat are removed.

Words are runs of bytes other than ASCII white space. Null and empty texts have no words; texts of fewer words than a
window lose none. Repeated rows (also with one doc_id) are occurrences like any others. Null doc_ids are kept. Extra
columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, drop_scratch, materialize, merge_join, reopened, table, text_key
from .langid import chunks
from .repeats import CHUNK, Units, covered, settle, settle_windows, several, spans, text_store, with_lists

WINDOW, GRAM = 35, 8
BATCHES, FAN = 2, 2
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
RUN_SCHEMA = "fp LONG, span LONG, n INT, c LONG, tid LONG, at INT, odd BOOLEAN"
STORE_SCHEMA = "k1 LONG, k2 LONG, first_id LONG, copies LONG, text STRING, tid LONG"


class WindowIndex:
    """Sorted immutable runs of all spans seen so far, and the stores of their texts.

    A run has a row per distinct span of a batch: fingerprint, hash, number of windows, occurrences, and the first one.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fan: int = FAN, folder: str | None = None) -> None:
        self.spark, self.window, self.gram, self.fan, self.folder = spark, window, gram, fan, folder
        self.runs: list[DataFrame] = []
        self.stores: list[DataFrame] = []
        self.version, self.next_tid = 0, 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> WindowIndex:
        """The index that an earlier session left in folder."""
        rows = spark.read.parquet(f"{folder}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        listed = rows.filter(F.col("version") == last).orderBy("place").collect()  # a row per run and store
        of = listed[0]
        out = cls(spark, of["window"], of["gram"], of["fan"], folder)
        out.version, out.next_tid = last, of["next_tid"]
        for r in listed:
            if r["kind"] == "run":
                out.runs.append(reopened(spark, r["path"], RUN_SCHEMA, "fp", r["buckets"]))
            else:
                out.stores.append(reopened(spark, r["path"], STORE_SCHEMA, "tid", r["buckets"]))
        return out

    def _commit(self) -> None:
        """Name the tables that the index has now; one small file, so that a reader sees all of it or nothing."""
        if not self.folder:
            return
        self.version += 1
        rows = []
        for kind, dfs in (("run", self.runs), ("store", self.stores)):
            for df in dfs:
                path = df.inputFiles()[0].rsplit("/", 1)[0]
                about = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {path.rsplit('/', 1)[-1]}").collect()}
                rows.append((self.version, len(rows), kind, path, int(about["Num Buckets"]), self.window, self.gram, self.fan, self.next_tid))
        schema = "version int, place int, kind string, path string, buckets int, window int, gram int, fan int, next_tid long"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def add_documents(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index docs(doc_id, text): the store of their texts, and the ranges that ``add`` finds."""
        store = text_store(docs, False, self.next_tid, self.folder)
        self.next_tid = (store.agg(F.max("tid")).first()[0] or self.next_tid - 1) + 1
        self.stores.append(store)
        return store, self.add(store)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch(tid, text) of a store of the index -> tid, low, high: word ranges that repeat, in it or in older texts.

        All ranges in which the batch takes part; what older texts share among themselves was found when they came.
        """
        was = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            return self._add(batch)
        finally:
            self.spark.conf.set(ORDERED, was)

    def _add(self, batch: DataFrame) -> DataFrame:
        window = self.window
        found = materialize(spans(batch, window, self.gram, True))
        rows, pairs = settle(self.stores, found, window, True)
        run = bucketed(rows, "fp", self.folder)
        drop_scratch(found, rows)
        # The merge join: older rows whose fingerprint the batch has, bucket by bucket.
        mine = run.select("fp", "span", "n", "c", "tid", "at", "odd")
        both = mine
        for old in self.runs:
            both = both.unionByName(merge_join(old, run.select("fp").distinct(), "fp", "left_semi").select(mine.columns))
        both = several(both)
        self.runs.append(run)
        equal, look = pairs, both
        if len(self.runs) > 1:
            merged, across = settle(self.stores, both.filter("NOT odd"), window, True)
            equal = equal.unionByName(across)
            look = several(merged.unionByName(both.filter("odd").select(merged.columns)))
        look = look.select("tid", "at", "n", (F.col("c") == 1).alias("single"))
        windows = settle_windows(self.stores, look, window, True).filter("single").select("tid", F.col("at").alias("low"), (F.col("at") + window).alias("high"))
        equal = equal.select("tid", "at", "n").unionByName(equal.select(F.col("rt").alias("tid"), F.col("ra").alias("at"), "n").distinct())
        whole = equal.select("tid", F.col("at").alias("low"), (F.col("at") + F.col("n") + window - 1).alias("high"))
        out = materialize(whole.unionByName(windows).distinct())
        drop_scratch(both, pairs)
        if len(self.runs) > self.fan:
            self.compact()
        self._commit()
        return out

    def compact(self) -> None:
        """All runs become one, with a row per distinct span; the old ones go."""
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.unionByName(run)
        merged, pairs = settle(self.stores, rows.filter("NOT odd"), self.window, True)
        merged = merged.unionByName(rows.filter("odd").select(merged.columns))
        old, self.runs = self.runs, [bucketed(merged, "fp", self.folder)]
        drop_scratch(pairs, *old)


def cut_words(store: DataFrame, window: int) -> DataFrame:
    """store(k1, k2, copies, text, low, high) -> k1, k2, n_words, n_removed, kept (binary), kept_sha256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                units = Units(batch.column("text"), True)
                data, begin = units.words.spaced()
                copies = batch.column("copies").to_pylist()
                low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
                total, removed, digest = [], [], []
                for i in range(batch.num_rows):
                    a, b = int(units.first[i]), int(units.first[i + 1])
                    n = b - a
                    if copies[i] > 1 and n >= window:
                        gone = np.ones(n, bool)
                    else:
                        gone = covered(n, np.array(low[i] or [], np.int64), np.array(high[i] or [], np.int64))
                    # Runs of kept words, each with a space at its end.
                    edge = np.flatnonzero(np.diff(np.concatenate([[1], gone, [1]]).astype(np.int8))) + a
                    kept = b"".join([data[x:y] for x, y in zip(begin[edge[::2]].tolist(), begin[edge[1::2]].tolist(), strict=True)])
                    digest.append(hashlib.sha256(kept[:-1]).hexdigest())
                    total.append(n)
                    removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["k1", "k2", "n_words", "n_removed", "kept_sha256"])

    return store.select("k1", "k2", "copies", "text", "low", "high").mapInArrow(cut, "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string")


def repeated_word_ranges(store: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """tid, low, high: word ranges of windows that start anywhere else among the distinct texts of store."""
    index = WindowIndex(store.sparkSession, window, gram)
    index.stores.append(store)
    out = None
    for b in range(batches):
        found = index.add(store.filter(F.pmod(F.xxhash64("tid"), F.lit(batches)) == b))
        out = found if out is None else out.unionByName(found)
    drop_scratch(*index.runs)
    return out


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    store = text_store(docs, False)
    out = _cut_rows(docs, store, repeated_word_ranges(store, window, gram), window)
    drop_scratch(store)
    return out


def dedup_batch(index: WindowIndex, docs: DataFrame) -> DataFrame:
    """What ``dedup_words`` returns, for a batch of documents judged against each other and all that the index has."""
    store, found = index.add_documents(docs)
    return _cut_rows(docs, store, found, index.window)


def _cut_rows(docs: DataFrame, store: DataFrame, found: DataFrame, window: int) -> DataFrame:
    results = materialize(cut_words(with_lists(store, found, ["low", "high"], "left"), window))
    k1, k2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    return merge_join(docs.select("doc_id", k1.alias("k1"), k2.alias("k2")), results, ["k1", "k2"]).drop("k1", "k2")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(0, len(w) - 34)) AS s, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, s, md5(array_to_string(w[s + 1 : s + 35], ' ')) AS win FROM s),
t AS (SELECT win FROM h GROUP BY win HAVING count(*) > 1),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(s, s + 35)) AS p FROM h JOIN t USING (win)) GROUP BY r),
u AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
v AS (SELECT r, unnest(gone) AS p FROM g),
k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN v ON u.r = v.r AND u.p = v.p WHERE v.p IS NULL GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)
"""
