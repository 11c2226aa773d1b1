"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window (10 consecutive item words, or a whole shorter item) is contained in a document only if all its shingles are, so
one necessary shingle is enough as its prefix: the rarest by corpus counts. Documents join the prefixes on that shingle
alone; length and positional bounds drop what cannot hold a window; the words around the shingle are then compared one by
one, over no more than a window to either side. Each word of an item or a document becomes a row of fixed size, so the
work is linear in their lengths; equal texts are searched once after the first pass.

Null or empty texts and items have no words and never match. Repeated rows each get the same result; a null doc_id is a
doc_id like any other. A null item_id is named by the empty string. ``matches`` reads doc_id and text alone;
``decontaminate`` passes all columns on, of which none may be named __t or __u. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, merge_join, table, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: The benchmark's shingles are broadcast up to so many bytes, at ROW_BYTES each in memory; beyond, the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: Tasks that the copies of one text are dealt over.
COPIES = 32


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _shingles(df: DataFrame, keep: list[str], single: bool) -> DataFrame:
    """keep, pos, h, last: a row per pair of neighbouring words, one (last) for the last word, where h is no shingle.

    With single, each word has a row of its own, too.
    """
    pairs = F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, greatest(size(words), 1))").alias("b"))
    rows = df.select(*keep, F.posexplode(pairs).alias("pos", "p"))
    last = F.col("p.b").isNull()
    h = F.when(last, F.xxhash64(F.lit(-1), *keep)).otherwise(F.xxhash64("p.a", "p.b"))
    if not single:
        return rows.select(*keep, "pos", h.alias("h"), last.alias("last"))
    both = F.array(F.struct(h.alias("h"), last.alias("last")), F.struct(F.xxhash64("p.a").alias("h"), F.lit(False).alias("last")))
    rows = rows.withColumn("x", F.explode(both))
    return rows.select(*keep, "pos", F.col("x.h").alias("h"), F.col("x.last").alias("last"))


def _around(at: Column, words_: Column, window: int) -> list[Column]:
    """The words before place ``at`` (nearest first, a window without the place) and those from it on (a window)."""
    side = F.lit(window - 1)
    left = F.reverse(F.slice(words_, F.greatest(F.lit(1), at - side + 1), F.least(at, side)))
    return [left.alias("left"), F.slice(words_, at + 1, F.lit(window)).alias("right")]


def _contexts(df: DataFrame, keep: list[str], places: str, window: int) -> DataFrame:
    """df(keep, words, places) -> keep, pos, left, right for each of the places."""
    found = F.transform(places, lambda p: F.struct(p.alias("pos"), *_around(p, F.col("words"), window)))
    rows = df.select(*keep, found.alias("found")).select(*keep, F.explode("found").alias("x"))
    return rows.select(*keep, "x.pos", "x.left", "x.right")


def prefixes(spots: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """spots(b, n, pos, h) of items and counts(h, df) -> b, n, pos, h: of each window the rarest shingle.

    A window with a shingle that no document has cannot occur and has none.
    """
    rated = spots.join(counts, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    low, high = F.greatest(F.lit(0), F.col("pos") + 2 - window), F.least(F.col("pos"), F.greatest(F.col("n") - window, F.lit(0)))
    starts = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    best = rated.withColumn("start", F.explode(starts)).groupBy("b", "n", "start").agg(F.min(F.struct("df", "h", "pos")).alias("p"))
    return best.filter("p.df > 0").select("b", "n", F.col("p.pos").alias("pos"), F.col("p.h").alias("h")).distinct()


def _one_each(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows(t, u, text) whose (t, u) is in keys, one of each; copies of a text are dealt over COPIES tasks until they are one."""
    spread = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(COPIES)))
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    some = spread.join(keys, ["t", "u", "salt"], "left_semi")
    for by in (["t", "u", "salt"], ["t", "u"]):
        some = some.groupBy(*by).agg(F.any_value("text").alias("text"))
    return some


def text_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(text) -> a row per distinct text with words: t, u (its key), n_words, hits (word places), item_ids (sorted)."""
    t, u = text_key(F.col("text"))
    base = docs.filter(F.col("text").isNotNull()).select(t.alias("t"), u.alias("u"), "text")
    bench = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    bench = materialize(bench.filter("size(words) > 0").withColumn("n", F.size("words")).withColumn("b", F.monotonically_increasing_id()))
    single = not bench.filter("n = 1").isEmpty()
    alone = bench.filter("n = 1").select("b", "n", F.lit(0).alias("pos"), F.xxhash64(F.col("words")[0]).alias("h"))
    spots = materialize(_shingles(bench, ["b", "n"], False).filter("NOT last").select("b", "n", "pos", "h").unionByName(alone))
    needed = materialize(spots.select("h").distinct().withColumn("hit", F.lit(True)))
    if needed.count() * ROW_BYTES <= BROADCAST_BYTES:
        needed = F.broadcast(needed)

    # The one pass over all words: shingles that items have, and each text's last word, which tells its length.
    seen = _shingles(base.select("t", "u", words(F.col("text")).alias("words")), ["t", "u"], single)
    seen = seen.join(needed, "h", "left").filter("hit OR last")
    found = materialize(seen.groupBy("t", "u", "pos", "h", "last").agg(F.count("*").alias("c")))
    lengths = found.filter("last").select("t", "u", (F.col("pos") + 1).alias("n_words"))
    found = found.filter("NOT last")
    counts = found.groupBy("h").agg(F.sum("c").alias("df"))
    chosen = materialize(prefixes(spots, counts, window))
    places = chosen.groupBy("b").agg(F.collect_set("pos").alias("places"))  # no more than the item's words
    ours = _contexts(bench.join(places, "b"), ["b", "item", "n"], "places", window).withColumnsRenamed({"left": "item_left", "right": "item_right", "pos": "ip"})
    ours = materialize(ours.join(chosen.select("b", F.col("pos").alias("ip"), "h"), ["b", "ip"]).withColumn("need", F.least(F.lit(window), F.col("n"))).drop("b", "n"))

    # Length and position: the words to the left that both sides have, and those to the right of the item, must make a window.
    near = found.select("t", "u", "pos", "h").join(ours, "h")
    near = materialize(near.filter(F.least(F.col("pos"), F.size("item_left")) + F.size("item_right") >= F.col("need")).drop("h"))
    lists = materialize(near.groupBy("t", "u").agg(F.collect_set("pos").alias("places")))  # no more than the text's words
    # Words are made below the join; above it, filters that the optimizer infers would make them again for each place.
    met = _one_each(base, lists.select("t", "u")).select("t", "u", words(F.col("text")).alias("words"))
    theirs = _contexts(met.join(lists, ["t", "u"]), ["t", "u"], "places", window)

    def run(x: Column, y: Column) -> Column:
        """How many leading words of the two lists agree."""
        same = F.zip_with(x, y, lambda a, b: F.when(a == b, "1").otherwise("0"))
        return F.length(F.regexp_extract(F.array_join(same, ""), "^1*", 0))

    both = merge_join(near, theirs, ["t", "u", "pos"])
    low, high = F.col("pos") - run(F.col("left"), F.col("item_left")), F.col("pos") + run(F.col("right"), F.col("item_right"))
    spans = materialize(both.select("t", "u", "item", "need", low.alias("low"), high.alias("high")).filter("high - low >= need").distinct())
    ranges = F.collect_set(F.sequence(F.col("low"), F.col("high") - 1))  # at most WINDOW of each start
    hits = spans.groupBy("t", "u").agg(F.array_sort(F.array_distinct(F.flatten(ranges))).alias("hits"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    out = materialize(lengths.join(hits, ["t", "u"], "left"))
    drop_scratch(bench, spots, found, chosen, ours, near, lists, spans)
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, hits (array of hit word positions), item_ids (sorted strings)."""
    found = text_matches(docs, items, window)
    t, u = text_key(F.col("text"))
    out = merge_join(docs.select("doc_id", t.alias("t"), u.alias("u")), found, ["t", "u"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), empty("hits", "int"), empty("item_ids", "string"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """General use: the rows of docs, all columns kept, without a word inside a benchmark window."""
    bad = text_matches(docs, items).filter(F.size("hits") > 0).select(F.col("t").alias("__t"), F.col("u").alias("__u"))
    t, u = text_key(F.col("text"))
    return docs.withColumn("__t", t).withColumn("__u", u).join(bad, ["__t", "__u"], "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS win FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d WHERE len(w) > 0),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM dp, lens WHERE s + n <= len(w)),
m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
