"""Sort-tile-recursive (STR) tiling as window queries, and the level table of the tree it packs.

Leaves are ordered by y, cut into slabs, ordered by x in a slab, cut into chunks, ordered by z in a chunk, and packed by
FANOUT; ties follow reverse insertion. The slab cut takes ranks over range partitions; the rest runs per slab and chunk, of
which there are as many as the tree is wide. Levels above use the boxes' centres.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radialspark.sources.scratch import ranked

FANOUT = 10


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def level_counts(n: int, fanout: int = FANOUT) -> list[int]:
    """Number of nodes of each level, leaves' parents first, root last."""
    out = []
    while n > 1 or not out:
        n = ceil_div(n, fanout)
        out.append(n)
    return out


def node_count(n: int, fanout: int = FANOUT) -> int:
    """Nodes of the tree over n leaves, leaves included."""
    return n + sum(level_counts(n, fanout)) if n else 0


def widths(n: int, fanout: int = FANOUT) -> tuple[int, int]:
    """Rows in a slab and in a chunk."""
    p = ceil_div(n, fanout)
    return fanout * math.ceil(p ** (2 / 3)), fanout * math.ceil(p**0.5)


def tile(leaves: DataFrame, ordinal: str = "ordinal", n: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """leaves(ordinal, x, y, z) with pos (place in tile order) and node (pos div fanout)."""
    n = leaves.count() if n is None else n
    w1, w2 = widths(max(n, 1), fanout)
    last = F.desc(ordinal)
    out = ranked(leaves, [F.col("y"), last], "p1").withColumn("slab", F.expr(f"p1 div {w1}"))
    out = out.withColumn("p2", F.row_number().over(Window.partitionBy("slab").orderBy("x", "p1")) - 1).withColumn("chunk", F.expr(f"p2 div {w2}"))
    out = out.withColumn("p3", F.row_number().over(Window.partitionBy("slab", "chunk").orderBy("z", "p2")) - 1)
    out = out.withColumn("pos", (F.col("slab") * w1 + F.col("chunk") * w2 + F.col("p3")).cast("long"))
    return out.withColumn("node", F.expr(f"pos div {fanout}")).drop("p1", "p2", "p3", "slab", "chunk")


def pack_nodes(tiled: DataFrame) -> DataFrame:
    """node and its box from tiled points or boxes."""
    low = "low_" if "low_x" in tiled.columns else ""
    upp = "upp_" if "upp_x" in tiled.columns else ""
    aggs = [F.min(f"{low}{a}").alias(f"low_{a}") for a in "xyz"] + [F.max(f"{upp}{a}").alias(f"upp_{a}") for a in "xyz"]
    return tiled.groupBy("node").agg(*aggs, F.count("*").alias("entries"))


def build_levels(leaves: DataFrame, ordinal: str = "ordinal", fanout: int = FANOUT) -> list[DataFrame]:
    """The node table of each level, lowest first; the last one has a single row. The number of levels is logarithmic."""
    n = leaves.count()
    rows, out = leaves, []
    while n > 1 or (n and not out):
        nodes = pack_nodes(tile(rows, ordinal, n, fanout))
        out.append(nodes)
        n = ceil_div(n, fanout)
        centers = [((F.col(f"low_{a}") + F.col(f"upp_{a}")) / F.lit(2.0).cast("float")).cast("float").alias(a) for a in "xyz"]
        rows = nodes.select("*", F.col("node").alias("o"), *centers).drop("node", "entries").withColumnRenamed("o", "ordinal")
        ordinal = "ordinal"
    return out


def traverse(levels: list[DataFrame]) -> DataFrame:
    """All nodes, root level first."""
    out = None
    for depth, nodes in enumerate(reversed(levels)):
        rows = nodes.withColumn("level", F.lit(depth))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("level", "node")


def digit_histogram(df: DataFrame, column: str, shift: int = 0) -> DataFrame:
    """digit (8 bits of an integer column, from bit ``shift``) and n."""
    return df.groupBy(F.shiftright(F.col(column), shift).bitwiseAND(255).cast("int").alias("digit")).agg(F.count("*").alias("n"))


def prefix_sum(histogram: DataFrame) -> DataFrame:
    """histogram(digit, n) with the sum of the smaller digits; at most 256 rows."""
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
