"""A toxicity classifier with counterfactual regularisation.

A sparse logistic model over the words of a text (present or not) is fitted to a bounded sample of labelled rows, whose
texts are reduced to their distinct words on the executors, whole and whatever their length. Each sample text that names
a group is copied with the name swapped for others, and the squared difference of the two logits
is added to the loss, so that a group's name alone cannot move a score. Weights are kept sparse by an L1 penalty, so that
the many harmless words of a long text don't add up.

Null texts and empty texts get the score of the bias alone. With no labelled rows every score is 0.0. Repeated rows each
get the same score; rows with a null doc_id are scored. A doc_id with several labels is toxic if one of them says so.
Of several documents with a sampled doc_id, the one with the least text is learned from. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, table
from .langid import _binary, chunks, held_out
from .textbytes import PUNCT, Words

#: Bound of the labelled sample: rows per class.
SAMPLE_ROWS = 2000
#: Names of groups that are swapped for each other, in the languages of the corpus.
IDENTITY = tuple(
    "women men woman man girls boys muslims christians jews hindus buddhists atheists muslim christian jewish hindu "
    "immigrants refugees foreigners gays lesbians gay lesbian straight bisexual transgender trans queer black white asian "
    "latino african european american mexican chinese indian arab deaf blind disabled elderly young old poor rich "
    "frauen männer frau mann juden muslime christen ausländer flüchtlinge einwanderer schwule lesben schwarze weiße behinderte "
    "femmes hommes femme homme juifs musulmans chrétiens étrangers réfugiés immigrés noirs blancs arabes handicapés "
    "mujeres hombres mujer hombre judíos musulmanes cristianos extranjeros refugiados inmigrantes negros blancos árabes gitanos".split()
)
#: A word takes part from so many sample texts on, and if its split over the classes is no chance (log-likelihood ratio).
LEAST_TEXTS, LEAST_RATIO = 3, 14.0
L1, L2, SWAP = 0.0002, 1e-4, 1.0
#: Bytes of text that a task scores at once (a longer text alone).
CHUNK = 1 << 19


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) pairs of a batch, distinct, as two arrays."""
    data, ends = _binary(texts)
    words = Words(data, ends, PUNCT, fold=True)
    pairs = np.stack([words.text_of().astype(np.uint64), words.hash[0]], axis=1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[fresh, 0].astype(np.int64), pairs[fresh, 1]


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    return np.array([word_hashes(pa.array([w]))[1][0] for w in words], np.uint64)


def _ratio(toxic: np.ndarray, seen: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of each word's split over the classes against the sample's."""
    share = min(max(float(labels.mean()), 1e-6), 1 - 1e-6) if len(labels) else 0.5
    term = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(seen * p, 1e-12)), 0.0)
    return 2 * (term(toxic, share) + term(seen - toxic, 1 - share))


def fit(texts: list[str], labels: np.ndarray, prior: float, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """``fit_words`` over texts at hand."""
    return fit_words(*word_hashes(pa.array(texts, pa.string())), labels, prior, **how)


def fit_words(row: np.ndarray, word: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 500, seed: int = 7, swap: float = SWAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted word hashes with a weight, their weights, and the bias, at the base rate ``prior``.

    (row, word): the distinct words of each labelled row, rows ascending; swap: weight of the penalty on swapped names.
    """
    vocab, col, seen = np.unique(word, return_inverse=True, return_counts=True)
    names = _hash_of(IDENTITY)
    keep = (seen >= LEAST_TEXTS) & (_ratio(np.bincount(col, labels[row], len(vocab)), seen, labels) >= LEAST_RATIO) | np.isin(vocab, names)
    index = np.cumsum(keep) - 1
    used = keep[col]
    row, col, vocab = row[used], index[col[used]], vocab[keep]
    # Counterfactual pairs: the text's names go, and one other name comes, for a few names each.
    rng = np.random.default_rng(seed)
    place = {int(h): i for i, h in enumerate(vocab)}
    ids = np.array([place.get(int(h), -1) for h in names])
    swaps: list[tuple[int, int, int]] = []  # pair, column, +1 or -1
    pair = 0
    for r, c in zip(*(a[np.isin(vocab[col], names)] for a in (row, col)), strict=True):
        for other in rng.choice(ids, 4):
            if other != c:
                swaps.append((pair, int(c), 1))
                if other >= 0:
                    swaps.append((pair, int(other), -1))
                pair += 1
    sp, sc, sv = (np.array([s[k] for s in swaps], np.int64) for k in range(3)) if swaps else (np.zeros(0, np.int64),) * 3
    n, m = len(labels), len(vocab)
    y = labels.astype(float)
    share = y.mean() if n else 0.5
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / max(n, 1)  # both classes count alike
    w, b = np.zeros(m), 0.0
    v, vb, t = w.copy(), b, 1.0
    size = np.bincount(row, minlength=n)
    # A step for each word by its share of the curvature keeps frequent words from slowing down the rare ones.
    curve = np.bincount(col, (weight * 0.25 * np.maximum(1, np.sqrt(size)))[row], m) + L2 + 1e-4
    if pair:
        curve += np.bincount(sc, minlength=m) * 4 * swap / pair
    for _ in range(rounds):
        z = np.bincount(row, v[col], n) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.bincount(col, g[row], m) + L2 * v
        if pair:
            gap = np.bincount(sp, sv * v[sc], pair)
            grad += 2 * swap / pair * np.bincount(sc, sv * gap[sp], m)
        step = v - 0.5 * grad / curve
        new = np.sign(step) * np.maximum(np.abs(step) - 0.5 * L1 / curve, 0)
        nb = vb - 1.0 * g.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((v - new) * (new - w)).sum() > 0:  # restart the momentum where it points uphill
            s, v, vb = 1.0, new, nb
        else:
            v, vb = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    some = np.abs(w) > 1e-6
    return vocab[some], w[some], float(b + np.log(prior / (1 - prior)) * 0.25)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What ``fit_words`` takes, from the per_class learning rows of each class whose doc_ids have the least hashes.

    Words of fewer than LEAST_TEXTS of the sample's texts stay behind, unless they name a group.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    none = np.zeros(0, np.int64)
    if not sizes:
        return none, none.astype(np.uint64), none, 0.5
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = {k: min(1.0, 1.5 * per_class / n + 30 / n) for k, n in sizes.items()}
    some = known.filter(u < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    first = Window.partitionBy("toxic").orderBy(u, "doc_id")  # about 1.5 * per_class rows a class
    picked = some.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_class).select("doc_id", "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * per_class rows at most
    texts = materialize(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                row, word = word_hashes(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(word.view(np.int64))], ["doc_id", "word"])

    pairs = materialize(texts.mapInArrow(reduce, texts.select("doc_id").schema.add("word", "long")))
    names = [int(h) for h in _hash_of(IDENTITY).view(np.int64)]
    kept = pairs.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST_TEXTS) | F.col("word").isin(names))
    found = pairs.join(kept.select("word"), "word").toArrow()
    rows = sorted((r["doc_id"], r["toxic"]) for r in texts.select("doc_id", "toxic").collect())
    row = np.searchsorted(np.array([r[0] for r in rows]), found.column("doc_id").to_numpy())
    word = found.column("word").to_numpy().view(np.uint64)
    order = np.lexsort((word, row))
    drop_scratch(texts, pairs)
    return row[order].astype(np.int64), word[order], np.array([r[1] for r in rows], np.int64), sizes.get(1, 0) / sum(sizes.values())


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for big in batches:
            for batch in chunks(big, most=CHUNK):
                out = np.zeros(batch.num_rows)
                if found is not None:
                    vocab, weight, bias = found
                    z = np.full(batch.num_rows, bias)
                    if len(vocab):
                        data, ends = _binary(batch.column("text"))
                        words = Words(data, ends, PUNCT, fold=True)
                        at = np.searchsorted(vocab, words.hash[0])
                        at[at == len(vocab)] = 0
                        hit = np.flatnonzero(vocab[at] == words.hash[0])
                        pairs = np.unique(words.text_of()[hit] * len(vocab) + at[hit])
                        z += np.bincount(pairs // len(vocab), weight[pairs % len(vocab)], batch.num_rows)
                    out = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    schema = docs.select("doc_id").schema.add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(score, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sample(docs, table(spark, sf_dir, "labels"))
    out = predict(docs, fit_words(*found) if len(found[2]) else None)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
