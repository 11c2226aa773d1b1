"""Balanced label propagation over linked documents, with DataFrame functions only.

Links are rows (node, group): the members of a group are neighbours of each other, and an edge is a group of two. Every
node starts in a shard picked by its hash. In each round the nodes' shards are joined to their links, which gives the
neighbours' counts per group and shard; joined back and summed, these are a node's votes, and it asks to move to the
shard with most of them. Moves are summed per (from, to, hash bucket of a group), a table of fixed size, and granted as
far as others come the other way or there is room. Every second round, votes go to as few shards as have room for all
voters, so that a large group fills some shards instead of asking for one. Rounds end when nothing moves. Documents without links then fill the shards up, so that counts are at most one apart (law
``rows``).

Null texts are equal to each other and form a group; so do empty texts. Repeated rows are separate rows of one group. A
null doc_id sorts first. Extra columns are passed on, but for names that begin with two underscores. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, global_rank, materialize, merge_join, table, text_key, values

BUCKETS = 16
GROUP = ["g0", "g1", "g2"]


def _grant(asked: list, load: list[int], cap: list[int]) -> dict[tuple[int, int, int], float]:
    """Which share of each (from, to, bucket) may move: in order of gain, as many as come the other way and as have room."""
    flow: dict[tuple[int, int], int] = {}
    for r in asked:
        flow[r["s"], r["to"]] = flow.get((r["s"], r["to"]), 0) + r["n"]
    swaps = {(s, t): min(n, flow.get((t, s), 0)) for (s, t), n in flow.items()}
    free = [max(0, c - x) for c, x in zip(cap, load, strict=True)]
    taken: dict[tuple[int, int, int], int] = {}
    order = sorted(asked, key=lambda r: (-r["gain"], r["b"], r["s"], r["to"]))
    for _ in range(3):  # what leaves a shard makes room there for rows that came earlier in the order
        for r in order:
            s, to, key = r["s"], r["to"], (r["s"], r["to"], r["b"])
            left = r["n"] - taken.get(key, 0)
            swap = min(left, swaps[s, to])
            move = min(left - swap, free[to])
            swaps[s, to] -= swap
            free[to] -= move
            free[s] += move
            taken[key] = taken.get(key, 0) + swap + move
    return {(r["s"], r["to"], r["b"]): taken[r["s"], r["to"], r["b"]] / r["n"] for r in asked if taken[r["s"], r["to"], r["b"]]}


def edge_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(a, b) between doc_ids and nodes(node, doc_id) -> links: each edge is a group of its own."""
    named = materialize(edges.select("a", "b").filter("a <> b").distinct().withColumn("g1", F.monotonically_increasing_id()))
    ends = named.select(F.explode(F.array("a", "b")).alias("doc_id"), "g1")
    return merge_join(ends, nodes.select("node", "doc_id"), "doc_id").select("node", F.lit(1).alias("g0"), "g1", F.lit(0).cast("long").alias("g2"))


def counts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """How many members of each group are in each shard: g0, g1, g2, s, n. Members of one shard meet before the shuffle."""
    return merge_join(links, labels.select("node", "s"), "node").groupBy(*GROUP, "s").agg(F.count("*").alias("n"))


def cut(links: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """Pairs of neighbours in different shards, and groups that lie in several."""
    per = counts(links, labels).groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("k"))
    row = per.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.lit(0.0)).cast("long"), F.count_if(F.col("k") > 1)).first()
    return row[0], row[1]


def _round(links: DataFrame, labels: DataFrame, shards: int, cap: list[int], spread: bool) -> tuple[DataFrame, int]:
    """labels(node, s) after one round of moves, and how many nodes moved; spread: votes go where there is room."""
    spark = labels.sparkSession
    held = {r["s"]: r["n"] for r in labels.groupBy("s").agg(F.count("*").alias("n")).collect()}  # a row a shard
    load = [held.get(s, 0) for s in range(shards)]
    # Each group's counts are one row, which its members get by a join; a large group's members are many rows of one key.
    n_in = [F.sum(F.when(F.col("s") == k, F.col("n")).otherwise(0)).alias(f"v{k}") for k in range(shards)]
    votes = materialize(counts(links, labels).groupBy(*GROUP).agg(*n_in))
    heard = materialize(merge_join(links, votes, GROUP))
    sums = [F.sum(f"v{k}").alias(f"v{k}") for k in range(shards)]
    score = heard.groupBy("node").agg(*sums, F.min(F.struct(*GROUP)).alias("lead"), F.count("*").alias("degree"))
    # Ties go by the group's hash, so that the members of one group agree.
    room = [max(0, c - x) for c, x in zip(cap, load, strict=True)]
    option = [F.struct(F.col(f"v{k}").cast("long").alias("n"), F.xxhash64("lead", F.lit(k)).alias("h"), F.lit(k).alias("s"), F.lit(room[k]).cast("long").alias("room")) for k in range(shards)]
    # A node is in each of its groups but has one vote of its own.
    wish = merge_join(score, labels, "node")
    wish = wish.withColumns({f"v{k}": F.col(f"v{k}") - F.when(F.col("s") == k, F.col("degree") - 1).otherwise(0) for k in range(shards)})
    here = F.coalesce(*[F.when(F.col("s") == k, F.col(f"v{k}")) for k in range(shards)])
    if spread:
        # The best shards that together hold all voters: who is in one of them stays, the others are dealt over their room.
        size = sum((F.col(f"v{k}") for k in range(1, shards)), F.col("v0"))
        kind = "struct<sum: bigint, free: bigint, used: array<struct<n: bigint, h: bigint, s: int, room: bigint>>>"
        none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("free"), F.array().alias("used")).cast(kind)

        def take(a: Column, x: Column) -> Column:
            more = F.struct((a["sum"] + x["n"] + x["room"]).alias("sum"), (a["free"] + x["room"]).alias("free"), F.concat(a["used"], F.array(x)).alias("used"))
            return F.when(a["sum"] < F.col("size"), more).otherwise(a)

        wish = wish.withColumn("size", size).withColumn("best", F.aggregate(F.reverse(F.array_sort(F.array(*option))), none, take))
        part = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20) * F.col("best.free")
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("s"), F.lit(0).cast("long").alias("n"))

        def pick(a: Column, x: Column) -> Column:
            hit = (a["s"] < 0) & (a["sum"] + x["room"] > F.col("part"))
            return F.struct((a["sum"] + x["room"]).alias("sum"), F.when(hit, x["s"]).otherwise(a["s"]).alias("s"), F.when(hit, x["n"]).otherwise(a["n"]).alias("n"))

        wish = wish.withColumn("part", part).withColumn("to", F.aggregate("best.used", start, pick))
        stays = F.exists("best.used", lambda x: x["s"] == F.col("s")) | (F.col("to.s") < 0)
        wish = wish.withColumn("to", F.when(stays, F.struct(here.alias("n"), F.col("s"))).otherwise(F.struct(F.col("to.n").alias("n"), F.col("to.s").alias("s"))))
    else:
        wish = wish.withColumn("to", F.array_max(F.array(*option)))
    wish = wish.withColumn("here", here)
    wish = materialize(wish.select("node", "s", F.col("to.s").alias("to"), (F.col("to.n") - F.col("here")).alias("gain"), F.pmod(F.xxhash64("lead"), F.lit(BUCKETS)).cast("int").alias("b")))
    asked = wish.filter("s <> to").groupBy("s", "to", "b").agg(F.count("*").alias("n"), F.avg("gain").alias("gain")).collect()  # shards^2 * BUCKETS rows at most
    share = _grant(asked, load, cap)
    if not share:
        drop_scratch(votes, heard, wish)
        return labels, 0
    grants = F.broadcast(values(spark, [(*k, v) for k, v in share.items()], "s int, to int, b int, share double"))  # shards^2 * BUCKETS rows at most
    go = F.pmod(F.xxhash64("node", "to"), F.lit(1 << 20)) < F.coalesce("share", F.lit(0.0)) * (1 << 20)
    moved = wish.join(grants, ["s", "to", "b"], "left").withColumn("go", go)
    after = materialize(moved.select("node", F.when(F.col("go"), F.col("to")).otherwise(F.col("s")).alias("s"), "go"))
    went = after.filter("go").count()
    drop_scratch(votes, heard, wish, labels)
    return after.select("node", "s"), went


def propagate(links: DataFrame, shards: int, cap: list[int], rounds: int) -> DataFrame:
    """links(node, g0, g1, g2) -> node, s: the shard of each linked node, with no more than about cap[s] nodes in s."""
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    labels = materialize(links.select("node").distinct().withColumn("s", start))
    before = 1
    for k in range(rounds):
        labels, went = _round(links, labels, shards, cap, k % 2 == 0)
        if not went and not before:
            break
        before = went
    return labels


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 8, edges: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, g1, g2, ...) with shard (int) and slot (long, gapless from 0 in each shard).

    (g1, g2) is the 128-bit key of the group of a document; edges(a, b) are further links between doc_ids. Shard counts
    differ by at most one.
    """
    spark = docs.sparkSession
    base = global_rank(docs, ["g1", "g2", F.asc_nulls_first("doc_id")], "__r")
    total = base.count()
    cap = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialize(base.groupBy("g1", "g2").agg(F.count("*").alias("n")).filter("n >= 2"))
    links = merge_join(base, groups, ["g1", "g2"], "left_semi").select(F.col("__r").alias("node"), F.lit(0).alias("g0"), "g1", "g2")
    if edges is not None:
        links = links.unionByName(edge_links(edges, base.withColumnRenamed("__r", "node")))
    links = materialize(links)
    labels = propagate(links, shards, cap, rounds)

    placed = merge_join(base, labels.select(F.col("node").alias("__r"), F.col("s").alias("__s")), "__r", "left")
    placed = placed.withColumn("__s", F.coalesce("__s", F.lit(shards)))
    # In each shard by rank, so that a group's members are neighbours; what exceeds the capacity goes with the unlinked.
    ranked = global_rank(placed, ["__s", "__r"], "__q")
    held = {r["__s"]: r["n"] for r in ranked.groupBy("__s").agg(F.count("*").alias("n")).collect()}  # shards + 1 rows
    rows, start, spilt, free = [], 0, 0, []
    for s in range(shards + 1):
        n = held.get(s, 0)
        keep = min(n, cap[s]) if s < shards else 0
        rows.append((s, start, keep, spilt))
        spilt += n - keep
        start += n
        if s < shards:
            free.append((s, keep, cap[s] - keep))
    gaps, at = [], 0
    for s, keep, room in free:
        if room:
            gaps.append((s, keep, at, at + room))
            at += room
    lines = values(spark, rows, "__s int, __start long, __keep long, __spilt long")
    line = ranked.join(F.broadcast(lines), "__s").withColumn("__own", F.col("__q") - F.col("__start"))  # shards + 1 rows
    stays = F.col("__own") < F.col("__keep")
    filler = F.col("__spilt") + F.col("__own") - F.col("__keep")
    to, slot = F.col("__s").cast("int"), F.col("__own")
    for s, keep, low, high in gaps:
        fits = ~stays & (filler >= low) & (filler < high)
        to, slot = F.when(fits, F.lit(s)).otherwise(to), F.when(fits, filler - low + keep).otherwise(slot)
    line = line.withColumn("__to", to.cast("int")).withColumn("__slot", slot.cast("long"))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return line.select(*names, F.col("__to").alias("shard"), F.col("__slot").alias("slot"))


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    g1, g2 = text_key(F.col("text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), g1.alias("g1"), g2.alias("g2"))
    out = balanced_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
