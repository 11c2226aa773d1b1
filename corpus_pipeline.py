"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; docs has the columns of documents
(doc_id, text, lang, source, n_chars), and all stages but the last return them. ``run`` writes each stage's result as
Parquet and reads it again. SQL cannot express the models and the tokenizer, so ORACLE_SQL is None; tests compare the
stages with brute force.

Null and empty texts are rejected by the first stage. Extra columns are carried along until the last stage. Rows with
one doc_id and one text are repeats, of which the second stage keeps one; unlike texts with one doc_id, or with a null one,
are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radialspark.llm import decontaminate, langid, neardup, packing, suffix
from radialspark.llm.common import drop_scratch, materialize, merge_join, scratch_scope, table, text_key

#: Texts that no learned language codes in fewer bits a byte are rejected along with those without a letter.
MOST_BITS = 7.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: keeps texts that some learned language explains; ``lang`` becomes the predicted language."""
    found = langid.predict(docs, langid.sample(docs.filter(~langid.held_out(4, 2))), docs.columns)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS))
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each class the document with the least doc_id stays (of several, one with the head's text)."""
    heads = neardup.text_classes(docs).filter("k1 = h1 AND k2 = h2")
    heads = materialize(heads.select(F.col("class_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")))
    k1, k2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    names = ["__id", "__k1", "__k2"]
    # Rows of one doc_id and one text are repeats; they go before rows are dealt by these keys, so that none is hot.
    keyed = docs.select("*", low.alias("__id"), k1.alias("__k1"), k2.alias("__k2")).dropDuplicates(names)
    return merge_join(keyed, heads, names, "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated long strings are cut out; texts of which nothing is left go."""
    cut = suffix.dedup_bytes(docs, keep=True).filter(F.length("kept") > 0)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents and their places in sequences."""
    out = packing.pack(packing.pieces(docs))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", substrings),
    ("decontaminate", clean),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        with scratch_scope(spark):  # what a stage has written for itself goes with it
            docs = materialize(stage(spark, docs, sf_dir))
        drop_scratch(before)
    return docs
