"""Canonical exact digests of documents, with DataFrame functions only.

A text's canonical form is NFKC, case folded, NFKC again, with each run of white space made one space and the ends
trimmed. Its fingerprint is a 128-bit xxhash of that form and depends on nothing else. Rows whose fingerprints agree are
compared byte by byte: ``collides`` is true for those whose bucket holds unlike forms, so that equal fingerprints with
``collides`` false mean equal forms.

Null texts count as empty texts; empty texts have one fingerprint of their own. Repeated doc_ids and repeated rows each
keep their row. A null doc_id sorts first. ``fingerprint_groups`` passes all columns on and replaces those named
fingerprint or collides; ``edited_likeness`` reads doc_id and text alone. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import global_rank, materialize, table, text_key

#: Neighbouring documents that one window holds.
BLOCK = 64
#: Size of the bitmap of buckets with more than one row.
BITS = 1 << 22


def canonical(text: Column) -> Column:
    """NFKC + full case folding + white space folding; ICU, which Spark ships, does the Unicode work in the JVM."""

    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.btrim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """The fingerprint of a canonical form, as lowercase hex; the form is made once."""

    def hexed(c: Column) -> Column:
        return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in text_key(c)])

    return F.get(F.transform(F.array(canon), hexed), F.lit(0))


def colliding(prints: DataFrame, forms: DataFrame) -> DataFrame:
    """The fingerprints that unlike forms share, from prints(fingerprint) of all and forms(fingerprint, text).

    Bytes are compared inside each bucket of more than one row. A bitmap of BITS bits, a table of bounded size, holds where
    such buckets may be, so that most texts stay where they are. Grouping sends one smallest and one largest form per
    bucket and task, so copies meet before the shuffle.
    """
    at = F.pmod(F.xxhash64("fingerprint"), F.lit(BITS).cast("long"))
    word, bit = F.shiftright(at, 6), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(fingerprint), {BITS}L) & 63 AS INT))")
    again = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    mask = materialize(again.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask")))
    some = forms.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(mask), "word")  # BITS / 64 rows at most
    some = some.filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("fingerprint", canonical(F.col("text")).alias("canon"))
    buckets = some.groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return materialize(buckets.filter("low <> high").select("fingerprint"))


def _flag(df: DataFrame, odd: DataFrame, columns: list[str]) -> DataFrame:
    """df with ``collides``: whether one of its fingerprint columns is in odd."""
    if odd.isEmpty():
        return df.withColumn("collides", F.lit(False))
    out = df.drop("collides")
    for i, c in enumerate(columns):
        out = out.join(odd.select(F.col("fingerprint").alias(c), F.lit(True).alias(f"__odd{i}")), c, "left")
    found = F.coalesce(*[F.col(f"__odd{i}") for i in range(len(columns))], F.lit(False))
    return out.withColumn("collides", found).drop(*[f"__odd{i}" for i in range(len(columns))])


def fingerprint_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """General use: docs with ``fingerprint`` and ``collides``; rows with equal canonical forms share a fingerprint."""
    whole = F.coalesce(F.col(text), F.lit(""))
    forms = docs.select(digest(canonical(whole)).alias("fingerprint"), whole.alias("text"))
    odd = colliding(forms.select("fingerprint"), forms)
    return _flag(docs.withColumn("fingerprint", digest(canonical(whole))), odd, ["fingerprint"])


def with_next(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) with next_<c> for each of the columns: the values of the next row by (doc_id, text key).

    Also the rows without them, as written for the ranks.

    The last row gets the first one's. Rows are ranked over range partitions and dealt in blocks of BLOCK ranks; each
    block's first row goes to the block before it, too. No window holds more than a block, whatever the size of docs.
    """
    k1, k2 = text_key(F.col("text"))
    ranked = global_rank(docs.withColumn("__k1", k1).withColumn("__k2", k2), [F.asc_nulls_first("doc_id"), "__k1", "__k2"], "__r")
    n = ranked.count()
    own = F.struct(F.expr(f"__r div {BLOCK}").alias("block"), F.col("__r").alias("r"), F.lit(True).alias("own"))
    before = F.struct(
        F.when(F.col("__r") == 0, F.lit((max(n, 1) - 1) // BLOCK).cast("long")).otherwise(F.expr(f"__r div {BLOCK} - 1")).alias("block"),
        F.when(F.col("__r") == 0, F.lit(n).cast("long")).otherwise(F.col("__r")).alias("r"),
        F.lit(False).alias("own"),
    )
    place = F.when(F.col("__r") % BLOCK == 0, F.array(own, before)).otherwise(F.array(own))
    dealt = ranked.withColumn("__at", F.explode(place)).select(*docs.columns, *[F.col(f"__at.{c}").alias(f"__{c}") for c in ("block", "r", "own")])
    order = Window.partitionBy("__block").orderBy("__r")
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.filter("__own").drop("__block", "__r", "__own"), ranked.select(*docs.columns)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text), of each text with its last quarter replaced, and how alike they are.

    An exact digest knows only equal and different, so both likenesses are 1.0 or 0.0; bytes decide, not digests.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    near, ranked = with_next(base.withColumn("fingerprint", digest(canonical(F.col("text")))), ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    near = near.withColumn("cut", cut).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cut)"), F.expr("left(next_text, cut)")))
    near = near.withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))

    def same(other: str, print_: str) -> Column:
        alike = F.when(F.col("fingerprint") == F.col(print_), canonical(F.col("text")) == canonical(F.col(other)))
        return F.when(alike, 1.0).otherwise(0.0)

    rows = materialize(
        near.select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            same("edited", "edited_fingerprint").alias("near_edited"),
            same("next_text", "next_fingerprint").alias("near_next"),
            "edited",
        )
    )
    prints = rows.select("fingerprint").unionByName(rows.select(F.col("edited_fingerprint").alias("fingerprint")))
    edited = rows.select(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited").alias("text"))
    odd = colliding(prints, ranked.select("fingerprint", "text").unionByName(edited))
    return _flag(rows.drop("edited"), odd, ["fingerprint", "edited_fingerprint"])


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
