"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes, learned from a bounded sample of labelled rows, whose texts
are counted whole and on the executors; the driver gets the counts of strings of ORDER + 1 bytes. A context's
node holds symbol counts; an unseen symbol costs an escape (method C: q / (n + q) for q distinct of n) and is then coded
one order lower, with the symbols that the node already has excluded, down to a uniform order. The statistics are frozen
after learning, so the code length of a text is exact and can be looked up: every reachable node is flattened to a row of
code lengths, and a byte's row is that of the longest context that the tree has.

A text's language is the one with the least code length, and its score is the posterior of that language under equal
priors, tempered by the text's length. Null texts, empty texts and texts without a letter are ``und`` with score 0.0.
With nothing to learn from, every text is ``und``. Repeated rows each get the same result; null doc_ids are kept (and are
in the learning set, as their remainder is unknown, never in the held-out one). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_key

LETTER = regex.compile(r"\p{L}")
#: Bound of the learning sample: distinct texts per language.
SAMPLE_DOCS = 400
#: Nodes with fewer symbols than this are left out, and their parents code in their place.
LEAST_SEEN = 3
ORDER = 3
#: Bytes of text that are scored in one go.
CHUNK = 1 << 20
#: Bits of a symbol in a gram's code; 0 stands before the text, bytes are one up.
BITS = 9


def gram_counts(text: bytes, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the strings of order + 1 symbols that end at each byte of a text of any length."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    for low in range(0, len(data), CHUNK):
        part = data[max(0, low - order) : low + CHUNK].astype(np.int64) + 1
        part = np.concatenate([np.zeros(max(0, order - low), np.int64), part])
        code = np.zeros(len(part) - order, np.int64)
        for j in range(order + 1):
            code = (code << BITS) + part[j : len(part) - order + j]
        codes, counts = _added(codes, counts, *np.unique(code, return_counts=True))
    return codes, counts


def _added(codes: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)


class Tree:
    """The flattened context trees of all languages over one alphabet, from the gram counts of each."""

    def __init__(self, samples: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        self.langs = sorted(samples)
        self.order = order
        seen = np.zeros(1 << BITS, np.int64)
        for codes, counts in samples.values():
            seen += np.bincount(codes & ((1 << BITS) - 1), counts, 1 << BITS).astype(np.int64)
        used = np.flatnonzero(seen[1:257])
        #: Symbol 0 stands for each byte that no sample has (they share its probability).
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        self.rest = max(1, 256 - len(used))
        self.rows: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        for lang in self.langs:
            row_of, cost = self._learn(samples[lang])
            self.nodes.append(row_of)
            self.rows.append(cost)

    def _learn(self, counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        s, top = self.size, self.order
        of = np.zeros(1 << BITS, np.int64)
        of[1:257] = self.symbol
        # Column j holds the symbol j places before the last one.
        columns = [of[(counted[0] >> (BITS * j)) & ((1 << BITS) - 1)] for j in range(top + 1)]
        probs = np.full((1, s), 1 / 256)
        probs[0, 0] = self.rest / 256
        row_of = np.zeros(1, np.int32)  # of the context of order k, the row of its longest known suffix
        for k in range(top + 1):
            ctx = np.zeros(len(counted[0]), np.int64)
            for j in range(k, 0, -1):
                ctx = ctx * s + columns[j]
            keys, at = np.unique(ctx * s + columns[0], return_inverse=True)
            counts = np.bincount(at, counted[1], len(keys)).astype(np.int64)
            nodes, start = np.unique(keys // s, return_index=True)
            n = np.add.reduceat(counts, start) if len(start) else np.zeros(0, np.int64)
            q = np.diff(np.append(start, len(keys)))
            good = n >= (LEAST_SEEN if k else 1)
            lower = np.tile(row_of, s) if k else row_of  # the parent context drops the oldest symbol, the highest digit
            index = np.cumsum(good) - 1
            which = np.repeat(np.arange(len(nodes)), q)
            pick = good[which]
            at, sym, cnt = index[which[pick]], (keys % s)[pick], counts[pick]
            below = probs[lower[nodes[good]]]
            has = np.zeros(below.shape, bool)
            has[at, sym] = True
            unseen = np.where(has, 0.0, below)
            total = unseen.sum(axis=1, keepdims=True)
            ng, qg = n[good][:, None].astype(float), q[good][:, None].astype(float)
            new = np.where(total > 0, qg / (ng + qg) * unseen / np.where(total > 0, total, 1), 0.0)
            new[at, sym] = cnt / (n[good] + q[good] * (total[:, 0] > 0))[at]
            row_of = lower.copy()
            row_of[nodes[good]] = len(probs) + np.arange(len(new))
            probs = np.concatenate([probs, new])
        cost = -np.log2(np.maximum(probs, 1e-12))
        cost[:, 0] += np.log2(self.rest)
        return row_of, cost.astype(np.float32).ravel()

    def bits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths, texts x languages, of texts that lie one after another in data (uint8); ends: their ends."""
        s = self.size
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sym = self.symbol[data].astype(np.int32)
        ctx = np.zeros(len(sym), np.int32)
        place = np.arange(len(sym), dtype=np.int64) - np.repeat(starts, ends - starts)
        for j in range(self.order, 0, -1):
            prev = np.zeros(len(sym), np.int32)
            prev[j:] = sym[:-j]
            prev[place < j] = 0  # a text starts in the context of order 0
            ctx *= s
            ctx += prev
        out = np.zeros((len(ends), len(self.langs)))
        full = ends > starts
        for i, (row_of, cost) in enumerate(zip(self.nodes, self.rows, strict=True)):
            at = row_of[ctx]
            at *= s
            at += sym
            if full.any():
                out[full, i] = np.add.reduceat(cost[at], starts[full], dtype=np.float64)
        return out


def sample(docs: DataFrame, label: str = "lang", per_label: int = SAMPLE_DOCS, order: int = ORDER) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The gram counts of at most per_label distinct texts per label, those with the least hashes of the whole learning set.

    docs must hold the learning rows only. Texts are counted whole, where they are; what reaches the driver are the
    distinct strings of order + 1 bytes in the sample of each label.
    """
    known = docs.filter(F.col(label).isNotNull() & (F.octet_length("text") > 0))
    k1, k2 = text_key(F.col("text"))
    known = known.select(F.col(label).alias("label"), k1.alias("k1"), k2.alias("k2"), "text")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("k1").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_label / n + 30 / n)))])
    u = F.pmod("k1", F.lit(1 << 30)) / float(1 << 30)
    few = known.filter(u < share[F.col("label")]).dropDuplicates(["label", "k1", "k2"])
    order_ = Window.partitionBy("label").orderBy(u, "k1", "k2")  # about 1.5 * per_label rows a label
    picked = few.withColumn("r", F.row_number().over(order_)).filter(F.col("r") <= per_label).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                old = held.get(name, (np.zeros(0, np.int64),) * 2)
                held[name] = _added(*old, *gram_counts(text.encode(), order))
        for name, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["label", "gram", "n"])

    counted = picked.mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    labels = np.array(counted.column("label").to_pylist(), object)
    for name in sizes:
        mine = labels == name
        if mine.any():
            out[name] = tuple(counted.column(c).to_numpy()[mine].astype(np.int64) for c in ("gram", "n"))
    return out


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's end; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[1:] - ends[0]


def chunks(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, at least a row each."""
    size = batch.column(name).fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def predict(docs: DataFrame, samples: dict[str, tuple[np.ndarray, np.ndarray]], keep: list[str]) -> DataFrame:
    """The kept columns of docs with lang_pred, score and bits_per_byte (least; null for ``und``)."""
    spark = docs.sparkSession
    tree = Tree(samples) if samples else None
    held = spark.sparkContext.broadcast(tree)  # bounded by the sample, not by the corpus
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = docs.select(*[f.name for f in fields]).schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    names = [f.name for f in fields]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for big in batches:
            for batch in chunks(big):
                n = batch.num_rows
                langs, score, least = ["und"] * n, np.zeros(n), np.full(n, np.nan)
                letters = np.array([bool(t and LETTER.search(t)) for t in batch.column("text").to_pylist()], bool)
                if trees is not None and letters.any():
                    data, ends = _binary(batch.column("text"))
                    bits = trees.bits(data, ends)
                    size = np.maximum(np.diff(np.concatenate([[0], ends])), 1)
                    best = bits.argmin(axis=1)
                    gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(size)[:, None]
                    post = 1 / np.exp2(-np.minimum(gap, 500)).sum(axis=1)
                    for i in np.flatnonzero(letters):
                        langs[i], score[i], least[i] = trees.langs[best[i]], post[i], bits[i, best[i]] / size[i]
                out = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*out, pa.array(langs), pa.array(score), pa.array(least, from_pandas=True)], [*names, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(score, schema)


def held_out(mod: int, which: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == which, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, sample(docs.filter(~held_out(4, 2))), ["doc_id"])
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
