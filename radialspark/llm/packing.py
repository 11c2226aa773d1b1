"""Pattern packing of token sequences by non-negative least squares.

All that decides a packing is the histogram of piece lengths (at most 1024 numbers). Patterns of two and three lengths
that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least squares
and rounded, and what is left is packed best-fit by counts, longest first. Each kind of sequence then takes intervals of
the pieces' ranks, so no task sees more than its rows.

A document's ids end with END. Only documents of more than SIZE ids are cut, into pieces of SIZE; the first may be
shorter. Null texts are empty texts (one piece of one id). Repeated rows each have pieces of their own. Extra columns are
not read. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_scratch, global_rank, materialize, table
from .langid import chunks

SIZE, END = 1024, 2
#: Bytes of text that are tokenized in one go.
CHUNK = 1 << 19
#: Ranks that meet the intervals under one join key.
BLOCK = 1024
_ENCODERS: dict = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def same_vocabulary(path: str, ranks: dict[bytes, int]) -> dict[str, int] | None:
    """The special tokens of the tokenizer in path, if it is byte-level BPE over just these ranks; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if not plain or any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    letters = _byte_letters()
    vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if vocab != ranks or any(vocab[bytes(letters[c] for c in t)] != 256 + i for i, t in enumerate(merged)):
        return None
    return special


def encoder(path: str):
    """The tokenizer in path as a function of a list of texts; one per process.

    The ids are those of ``tokenizers``' encode(text, add_special_tokens=False). Where ranks of the same vocabulary lie
    beside a ``.json`` path, tiktoken makes them, in a fifth of the time: special tokens are split off alike, the split
    into words is alike for every code point, and as each token of the vocabulary encodes to itself, merging any pair
    whose bytes are a token does what merging the listed pairs does (tests check all three).
    """
    if path not in _ENCODERS:
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        special = None
        try:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = same_vocabulary(path, ranks)
        except (ModuleNotFoundError, FileNotFoundError):
            pass
        if special is not None:
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            _ENCODERS[path] = lambda texts: [enc.encode_to_numpy(t, allowed_special="all") for t in texts]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                rows: list[list] = [[] for _ in range(6)]
                for i, toks in enumerate(encode(part.column("text").fill_null("").to_pylist())):
                    flat = np.append(np.asarray(toks, "<u4"), np.uint32(END))
                    first = len(flat) % size or size
                    starts = [0, *range(first, len(flat), size)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(flat)], strict=True)):
                        for column, value in zip(rows, (i, k, a, b - a, zlib.crc32(flat[a:b]), flat[a:b] if ids else None), strict=True):
                            column.append(value)
                out = [part.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
                if ids:
                    out.append(pa.array(rows[5], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names)

    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    names = schema.names
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def patterns(size: int, short: int) -> np.ndarray:
    """Rows of three lengths, the last of them 0 in pairs, that add up to size; lengths of short and more."""
    a = np.arange(max(1, short), size)
    pairs = np.stack([a, size - a, np.zeros_like(a)], axis=1)
    pairs = pairs[(pairs[:, 0] >= pairs[:, 1]) & (pairs[:, 1] >= short)]
    x, y = np.meshgrid(a, a, indexing="ij")
    triples = np.stack([x.ravel(), y.ravel(), size - x.ravel() - y.ravel()], axis=1)
    triples = triples[(triples[:, 2] >= short) & (triples[:, 0] >= triples[:, 1]) & (triples[:, 1] >= triples[:, 2])]
    return np.concatenate([pairs, triples])


def repeats(hist: np.ndarray, rows: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: how often to use each pattern so that the lengths used come near the histogram."""
    scale = max(float(hist.max(initial=0)), 1.0)
    goal = hist / scale
    heavy = 0.2 + np.arange(len(hist)) / len(hist)  # a long length that is left over costs a sequence
    heavy[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], x, len(hist)) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    top = np.ones(len(rows))
    norm = 1.0
    for _ in range(20):
        top = back(heavy * used(top))
        norm = np.linalg.norm(top)
        top /= norm
    x = np.zeros(len(rows))
    v, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(v - back(heavy * (used(v) - goal)) / norm, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, x, t = new + (t - 1) / s * (new - x), new, s
    return x * scale


def plan(hist: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences (lengths in order) and how many of each; they use up the histogram exactly."""
    left = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    there = np.flatnonzero(left)
    if len(there):
        rows = patterns(size, int(there[0]))
        ok = (left[rows[:, 0]] > 0) & (left[rows[:, 1]] > 0) & ((rows[:, 2] == 0) | (left[rows[:, 2]] > 0))
        rows = rows[ok]
        if len(rows):
            x = repeats(left.astype(float), rows)
            for i in np.argsort(-x, kind="stable"):
                n = int(round(float(x[i])))
                if n <= 0:
                    break
                parts = [int(p) for p in rows[i] if p]
                n = min(n, *(int(left[p]) // parts.count(p) for p in parts))
                if n > 0:
                    for p in parts:
                        left[p] -= n
                    out.append((tuple(parts), n))
    # Residuals: best fit by counts, longest first; bins of one kind share an entry.
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        for room in range(length, size):
            if n and bins.get(room):
                for kind in sorted(bins[room]):
                    have = bins[room].pop(kind)
                    while n and have:
                        fits = min(room // length, max(1, n // have))
                        some = min(have, n // fits)
                        bins[room - fits * length][kind + (length,) * fits] += some
                        have, n = have - some, n - some * fits
                    if have:
                        bins[room][kind] += have
                    if not n:
                        break
        per = size // length
        if n // per:
            bins[size - per * length][(length,) * per] += n // per
        if n % per:
            bins[size - (n % per) * length][(length,) * (n % per)] += 1
    out += [(kind, n) for room in sorted(bins) for kind, n in sorted(bins[room].items()) if n]
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = materialize(cut)  # ranking reads its input twice, and tokenizing is dear
    ranked = global_rank(cut, ["length", F.asc_nulls_first("doc_id"), "piece"], "rank")
    drop_scratch(cut)
    lengths = ranked.groupBy("length").agg(F.count("*").alias("n"), F.min("rank").alias("low")).collect()  # size rows at most
    hist = {r["length"]: r["n"] for r in lengths}
    at = {r["length"]: r["low"] for r in lengths}
    spans, base = [], 0
    for kind, n in plan(hist, size):
        offset = 0
        for length in kind:
            spans.append((length, at[length], at[length] + n, base - at[length], offset))
            at[length] += n
            offset += length
        base += n
    # The intervals cover the ranks; both sides meet in blocks of ranks, so that a frequent length is no hot key.
    found = spark.createDataFrame(spans, "len long, low long, high long, shift long, offset long")
    found = found.withColumn("block", F.explode(F.expr(f"sequence(low div {BLOCK}, (high - 1) div {BLOCK})"))).drop("len")
    both = ranked.withColumn("block", F.expr(f"rank div {BLOCK}")).join(found, "block").filter("rank >= low AND rank < high")
    return both.withColumn("sequence_id", F.col("rank") + F.col("shift")).drop("block", "low", "high", "shift", "rank")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(pieces(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
