"""Preference formatting of pairs of conversations, with DataFrame functions only.

The longest run of leading turns that the chosen and the rejected conversation share is the prompt and is rendered once;
what follows in either is its completion. ``pair_rows`` gives a row per pair with the prompt, both completions and, for
each, the spans of its characters that count in the loss: the contents of assistant turns, without their headers.

Turns are aligned by their number. Rows of one conversation with the same number are one turn, whose messages are told
apart by role and text; two turns agree if they have the same messages, each as often. Null roles and texts are the empty
string; null turns come first; rows without a conv_id are left out, as they belong to no pair. A side without turns has
only what the other has after an empty prompt. A pair whose turns have numbers of CHUNK and more goes on in further rows
(``chunk`` 1, 2, ...), so that no conversation, however long, must fit one row. Extra columns are not read. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, materialize, merge_join, table

#: Turn numbers that share a row.
CHUNK = 4096


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def preference_rows(turns: DataFrame) -> DataFrame:
    """turns(pair_id, side ('chosen' or 'rejected'), turn, role, text) -> the rows of each pair's parts.

    pair_id, part ('prompt', 'chosen', 'rejected'), turn, role, segment, loss, copies (equal messages of one turn).
    """
    clean = turns.filter(F.col("pair_id").isNotNull()).select(
        "pair_id",
        "side",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    both = materialize(clean.groupBy("pair_id", "turn", "role", "text").agg(count("chosen").alias("c"), count("rejected").alias("r")))
    # The first turn at which the sides differ; copies have met before the shuffle.
    cuts = materialize(both.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("cut")))
    rows = both.join(cuts, "pair_id")
    shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = F.struct(F.lit("prompt").alias("part"), F.col("c").alias("copies"))
    sides = F.array(F.struct(F.lit("chosen").alias("part"), F.col("c").alias("copies")), F.struct(F.lit("rejected").alias("part"), F.col("r").alias("copies")))
    parts = F.when(shared, F.array(part)).otherwise(F.filter(sides, lambda s: s["copies"] > 0))
    rows = rows.withColumn("p", F.explode(parts))
    return rows.select(
        "pair_id",
        F.col("p.part").alias("part"),
        "turn",
        "role",
        render(F.col("role"), F.col("text")).alias("segment"),
        ((F.col("p.part") != "prompt") & (F.col("role") == "assistant")).alias("loss"),
        F.col("p.copies").alias("copies"),
    )


def pair_rows(turns: DataFrame) -> DataFrame:
    """turns(pair_id, side, turn, role, text) -> a row per pair (and chunk of turns).

    pair_id, chunk, prompt_turns, prompt, chosen, rejected (texts), chosen_loss, rejected_loss (arrays of (low, high)).
    """
    rows = preference_rows(turns).withColumn("chunk", F.expr(f"greatest(turn, 0) div {CHUNK}"))
    sized = rows.withColumn("size", F.char_length("segment")).withColumn("head", F.char_length("role") + F.lit(len("<||>\n")))
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "segment", "loss", "copies", "size", "head")))
    parts = sized.groupBy("pair_id", "chunk", "part").agg(order.alias("m"), F.count_distinct("turn").alias("turns"))
    parts = parts.withColumn("m", F.flatten(F.transform("m", lambda m: F.array_repeat(m, m["copies"].cast("int")))))
    text = F.array_join(F.transform("m", lambda m: m["segment"]), "")
    # One pass over the messages: where the last one ended, and the spans so far.
    none = F.expr("CAST(array() AS array<struct<low: int, high: int>>)")

    def step(a: Column, m: Column) -> Column:
        span = F.struct((a["at"] + m["head"]).alias("low"), (a["at"] + m["size"] - 1).alias("high"))
        return F.struct((a["at"] + m["size"]).alias("at"), F.when(m["loss"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate("m", F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    parts = parts.select("pair_id", "chunk", "part", "turns", text.alias("text"), spans.alias("spans"))
    pick = lambda part, c: F.first(F.when(F.col("part") == part, F.col(c)), True)
    empty = F.lit("")
    return parts.groupBy("pair_id", "chunk").agg(
        F.coalesce(pick("prompt", "turns"), F.lit(0)).cast("long").alias("prompt_turns"),
        F.coalesce(pick("prompt", "text"), empty).alias("prompt"),
        F.coalesce(pick("chosen", "text"), empty).alias("chosen"),
        F.coalesce(pick("rejected", "text"), empty).alias("rejected"),
        F.coalesce(pick("chosen", "spans"), none).alias("chosen_loss"),
        F.coalesce(pick("rejected", "spans"), none).alias("rejected_loss"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations(conv_id, turn, role, text): the turns of both sides of each pair.

    Pair k has conversation k up to its last assistant turn as chosen; the rejected one has another answer in that turn's
    place, the last one of the next conversation (by conv_id, the last one takes the first) that has any. A conversation
    without an assistant turn is the same on both sides.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text")
    answered = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    ranked = materialize(global_rank(answered, ["conv_id"], "r"))
    n = ranked.count()
    givers = ranked.select(F.pmod(F.col("r") - 1, F.lit(max(n, 1))).alias("r"), F.col("conv_id").alias("giver"), F.col("last").alias("giver_last"))
    plan = materialize(merge_join(ranked, givers, "r").select("conv_id", "last", "giver", "giver_last"))
    # Written before they are grouped: a conversation that holds many rows is split by the join and spread by the grouping.
    own = materialize(merge_join(turns, plan.select("conv_id", "last"), "conv_id", "left").filter("last IS NULL OR turn <= last"))
    chosen = own.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = own.filter("last IS NULL OR turn < last OR role IS NULL OR role <> 'assistant'").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    answers = own.filter("turn = last AND role = 'assistant'").select(F.col("conv_id").alias("giver"), "role", "text")
    given = merge_join(answers, plan.select("giver", F.col("conv_id").alias("pair_id"), F.col("last").alias("turn")), "giver")
    return chosen.unionByName(kept).unionByName(given.select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of conversations as preference pairs; spans are written as low-high, joined by commas."""
    rows = pair_rows(swapped_answers(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["low"].cast("string"), s["high"].cast("string"))), ",")
    return rows.select("pair_id", "chunk", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_loss").alias("chosen_loss"), spans("rejected_loss").alias("rejected_loss"))


OP3_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
g AS (SELECT conv_id, last, coalesce(lead(conv_id) OVER (ORDER BY conv_id), (SELECT min(conv_id) FROM a)) AS giver FROM a),
own AS (SELECT t.*, last FROM t LEFT JOIN a USING (conv_id) WHERE last IS NULL OR turn <= last),
s AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM own
UNION ALL SELECT conv_id, 1, turn, role, text FROM own WHERE last IS NULL OR turn < last OR role IS NULL OR role <> 'assistant'
UNION ALL SELECT g.conv_id, 1, g.last, o.role, o.text FROM g JOIN own o ON o.conv_id = g.giver AND o.turn = o.last AND o.role = 'assistant'),
m AS (SELECT pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, count(*) FILTER (WHERE side = 0) AS c, count(*) FILTER (WHERE side = 1) AS r FROM s GROUP BY ALL),
k AS (SELECT pair_id, min(turn) FILTER (WHERE c <> r) AS cut FROM m GROUP BY pair_id),
j AS (SELECT m.*, cut IS NULL OR turn < cut AS shared FROM m JOIN k USING (pair_id)),
p AS (SELECT pair_id, 'prompt' AS part, turn, role, text, c AS copies FROM j WHERE shared
UNION ALL SELECT pair_id, 'chosen', turn, role, text, c FROM j WHERE NOT shared AND c > 0
UNION ALL SELECT pair_id, 'rejected', turn, role, text, r FROM j WHERE NOT shared AND r > 0),
e AS (SELECT pair_id, greatest(turn, 0) // 4096 AS chunk, part, turn, role, text, unnest(range(0, copies)) AS copy, '<|' || role || '|>' || chr(10) || text || chr(10) AS segment FROM p),
f AS (SELECT *, sum(length(segment)) OVER (PARTITION BY pair_id, chunk, part ORDER BY turn, role, segment, copy) AS upto FROM e),
x AS (SELECT pair_id, chunk, part, count(DISTINCT turn) AS turns, string_agg(segment, '' ORDER BY turn, role, segment, copy) AS text,
string_agg(CAST(upto - length(text) - 1 AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ',' ORDER BY turn, role, segment, copy) FILTER (WHERE part <> 'prompt' AND role = 'assistant') AS loss FROM f GROUP BY ALL)
SELECT pair_id, chunk, coalesce(max(turns) FILTER (WHERE part = 'prompt'), 0) AS prompt_turns, coalesce(max(text) FILTER (WHERE part = 'prompt'), '') AS prompt,
coalesce(max(text) FILTER (WHERE part = 'chosen'), '') AS chosen, coalesce(max(text) FILTER (WHERE part = 'rejected'), '') AS rejected,
coalesce(max(loss) FILTER (WHERE part = 'chosen'), '') AS chosen_loss, coalesce(max(loss) FILTER (WHERE part = 'rejected'), '') AS rejected_loss FROM x GROUP BY pair_id, chunk
"""
