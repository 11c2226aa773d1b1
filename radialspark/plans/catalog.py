"""Registered queries of the reference's operators, and their DuckDB SQL.

Halos and particles are derived from customer and lineitem with integer coordinates, so that both engines agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radialspark.functions import geometry as geo
from radialspark.functions import grid as ids
from radialspark.operators import shells, tiling
from radialspark.operators.search import search
from radialspark.sources import binary, text
from radialspark.sources.scratch import new_folder

RADII = [10.0, 20.0, 40.0]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HALOS = "(c_custkey * 7907) % 1000 AS x, (c_custkey * 6007 + c_nationkey * 41) % 1000 AS y, (c_custkey * 5003 + 17) % 1000 AS z"
PARTICLES = "(l_orderkey * 7919 + l_linenumber * 104729) % 1000 AS x, (l_partkey * 6151 + l_linenumber * 50021) % 1000 AS y, (l_suppkey * 3571 + l_orderkey * 13) % 1000 AS z"
H_SQL = f"h AS (SELECT c_custkey AS halo_row, c_custkey AS id, {HALOS} FROM customer)"
P_SQL = f"p AS (SELECT l_orderkey * 10 + l_linenumber AS pid, l_returnflag AS batch, {PARTICLES} FROM lineitem)"


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS halo_row", "c_custkey AS id", *HALOS.split(", "))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber AS pid", "l_returnflag AS batch", *PARTICLES.split(", "))


def filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 37 = 0").selectExpr("o_custkey AS id")


def query(name: str, sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return register


def _near_sql(radius: int, periodic: bool = True, halo: str = "h", where: str = "") -> str:
    """CTEs h, p, i (images) and j (pairs with d2)."""
    axis = lambda a: f"(s{a} = 0 OR (s{a} = 1000 AND {a} - {radius} < 0) OR (s{a} = -1000 AND {a} - {radius} >= 0 AND {a} + {radius} > 1000))"
    shifts = "(VALUES (0), (1000), (-1000))" if periodic else "(VALUES (0))"
    return (
        f"{H_SQL}, {P_SQL}{where}, i AS (SELECT halo_row, x + sx AS x, y + sy AS y, z + sz AS z FROM {halo}, {shifts} a(sx), {shifts} b(sy), {shifts} c(sz) WHERE {axis('x')} AND {axis('y')} AND {axis('z')}), "
        f"j AS (SELECT halo_row, pid, batch, (i.x - p.x) * (i.x - p.x) + (i.y - p.y) * (i.y - p.y) + (i.z - p.z) * (i.z - p.z) AS d2 FROM i JOIN p ON p.x BETWEEN i.x - {radius} AND i.x + {radius} AND p.y BETWEEN i.y - {radius} AND i.y + {radius} AND p.z BETWEEN i.z - {radius} AND i.z + {radius})"
    )


_EDGES = [(0, 100), (100, 400), (400, 1600)]
_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE d2 >= {a} AND d2 < {b}) AS BIGINT) AS n{i}" for i, (a, b) in enumerate(_EDGES))
_PER_HALO = f"c AS (SELECT halo_row, {_COUNTS} FROM j GROUP BY halo_row)"
_ZEROS = ", ".join(f"coalesce(n{i}, 0) AS n{i}" for i in range(3))


def _wide_sql(halo: str = "h", **how) -> str:
    return f"WITH {_near_sql(40, halo=halo, **how)}, {_PER_HALO}, w AS (SELECT halo_row, id, {_ZEROS} FROM {halo} LEFT JOIN c USING (halo_row))"


_WIDE = "SELECT halo_row, id, n0, n1, n2 FROM w"
_SUMS = ", ".join(f"CAST(coalesce(sum(n{i}), 0) AS BIGINT) AS n{i}" for i in range(3))


@query("shell_count_periodic", f"{_wide_sql()} {_WIDE}")
def shell_count_periodic(spark: SparkSession, d: str) -> DataFrame:
    return shells.shell_counts(halos(spark, d), particles(spark, d), RADII)


@query("shell_count_nonperiodic", f"{_wide_sql(periodic=False)} {_WIDE}")
def shell_count_nonperiodic(spark: SparkSession, d: str) -> DataFrame:
    return shells.shell_counts(halos(spark, d), particles(spark, d), RADII, periodic=False)


@query("shell_count_exclude_coincident", f"WITH {_near_sql(40)}, {_PER_HALO.replace('FROM j', 'FROM j WHERE d2 > 0')} SELECT halo_row, id, {_ZEROS} FROM h LEFT JOIN c USING (halo_row)")
def shell_count_exclude_coincident(spark: SparkSession, d: str) -> DataFrame:
    return shells.shell_counts(halos(spark, d), particles(spark, d), RADII, exclude_coincident=True)


@query("shell_count_long", f"WITH {_near_sql(40)} SELECT halo_row, CAST(CASE WHEN d2 < 100 THEN 0 WHEN d2 < 400 THEN 1 ELSE 2 END AS INTEGER) AS shell, count(*) AS n FROM j WHERE d2 < 1600 GROUP BY ALL")
def shell_count_long(spark: SparkSession, d: str) -> DataFrame:
    return shells.shell_counts_long(halos(spark, d), particles(spark, d), RADII)


@query("shell_count_total", f"{_wide_sql()} SELECT {_SUMS} FROM w")
def shell_count_total(spark: SparkSession, d: str) -> DataFrame:
    return shells.total(shell_count_periodic(spark, d))


_BY_BATCH = f"WITH {_near_sql(40)}, b AS (SELECT halo_row, batch, {_COUNTS} FROM j WHERE d2 < 1600 GROUP BY ALL)"


@query("shell_count_by_batch", f"{_BY_BATCH} SELECT halo_row, batch, n0, n1, n2 FROM b")
def shell_count_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return shells.shell_counts(halos(spark, d), particles(spark, d), RADII, by=["batch"])


@query("shell_count_total_rollup", f"{_BY_BATCH} SELECT coalesce(batch, 'Total') AS batch, {_SUMS} FROM b GROUP BY ROLLUP (batch)")
def shell_count_total_rollup(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.coalesce(F.sum(f"n{i}"), F.lit(0)).cast("long").alias(f"n{i}") for i in range(3)]
    return shell_count_by_batch(spark, d).rollup("batch").agg(*sums).withColumn("batch", F.coalesce("batch", F.lit("Total")))


@query("shell_count_cumulative", f"{_wide_sql()} SELECT halo_row, id, n0 AS c0, n0 + n1 AS c1, n0 + n1 + n2 AS c2 FROM w")
def shell_count_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return shells.cumulative(shell_count_periodic(spark, d))


_FILTERED = ", f AS (SELECT * FROM h WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 37 = 0))"


@query("shell_count_filtered", f"{_wide_sql('f', where=_FILTERED)} {_WIDE}")
def shell_count_filtered(spark: SparkSession, d: str) -> DataFrame:
    return shells.shell_counts(halos(spark, d), particles(spark, d), RADII, filter_ids=filter_ids(spark, d))


@query("halo_semi_filter", f"WITH {H_SQL}{_FILTERED} SELECT id, halo_row, x, y, z FROM f")
def halo_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    return shells.semi_filter(halos(spark, d), filter_ids(spark, d))


@query("range_search_pairs", f"WITH {_near_sql(20)} SELECT halo_row, pid FROM j WHERE d2 < 400")
def range_search_pairs(spark: SparkSession, d: str) -> DataFrame:
    return shells.range_search(halos(spark, d), particles(spark, d), 20.0)


@query("range_search_ids", f"WITH {_near_sql(20)} SELECT halo_row, string_agg(pid, ',' ORDER BY pid) AS pids, count(*) AS n FROM j WHERE d2 < 400 GROUP BY halo_row")
def range_search_ids(spark: SparkSession, d: str) -> DataFrame:
    return shells.range_lists(halos(spark, d), particles(spark, d), 20.0)


@query("halo_scan", f"WITH {H_SQL} SELECT id, printf('%d: %f {{%f %f %f}}', id, CAST(id AS DOUBLE), CAST(x AS DOUBLE), CAST(y AS DOUBLE), CAST(z AS DOUBLE)) AS line FROM h")
def halo_scan(spark: SparkSession, d: str) -> DataFrame:
    return halos(spark, d).withColumn("mass", F.col("id").cast("double")).select("id", text.halo_line().alias("line"))


@query("particle_scan", f"WITH {P_SQL} SELECT pid, printf('{{%f %f %f}}', CAST(x AS DOUBLE), CAST(y AS DOUBLE), CAST(z AS DOUBLE)) AS line FROM p")
def particle_scan(spark: SparkSession, d: str) -> DataFrame:
    return particles(spark, d).select("pid", text.particle_line().alias("line"))


@query("periodic_images", f"WITH {_near_sql(40)} SELECT halo_row, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM i")
def periodic_images(spark: SparkSession, d: str) -> DataFrame:
    return shells.images(halos(spark, d), 40.0).select("halo_row", *[F.col(f"i{a}").cast("double").alias(a) for a in "xyz"])


@query("oob_flags", f"WITH {H_SQL} SELECT id, x - 40 < 0 AS low_x, y - 40 < 0 AS low_y, z - 40 < 0 AS low_z, x + 40 > 1000 AS upp_x, y + 40 > 1000 AS upp_y, z + 40 > 1000 AS upp_z FROM h")
def oob_flags(spark: SparkSession, d: str) -> DataFrame:
    low, upp = geo.query_box(geo.point("x", "y", "z"), 40.0)
    flags = [c.alias(f"low_{a}") for a, c in zip("xyz", geo.below(low), strict=True)] + [c.alias(f"upp_{a}") for a, c in zip("xyz", geo.above(upp), strict=True)]
    return halos(spark, d).select("id", *flags)


@query("log_radii", "SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 10.0), (2, 100.0), (3, 1000.0)) t(i, radius)")
def log_radii(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, round(r, 3)) for i, r in enumerate(geo.log_radii(1.0, 1000.0, 4))], "i int, radius double")


_GRID = ids.Grid(2, 4)


@query("grid_id2pos", "WITH g AS (SELECT DISTINCT l_orderkey % 512 + 1 AS id FROM lineitem), t AS (SELECT id, (id - 1) // 64 AS t, (id - 1) % 64 AS k FROM g) SELECT id, t // 4 * 4 + k // 16 AS gx, t // 2 % 2 * 4 + k // 4 % 4 AS gy, t % 2 * 4 + k % 4 AS gz FROM t")
def grid_id2pos(spark: SparkSession, d: str) -> DataFrame:
    g = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey % 512 + 1 AS id").distinct()
    return g.select("id", *[c.alias(f"g{a}") for a, c in zip("xyz", ids.id2pos(_GRID, F.col("id")), strict=True)])


@query("grid_pos2id", f"WITH {H_SQL}, g AS (SELECT halo_row, x % 8 AS x, y % 8 AS y, z % 8 AS z FROM h) SELECT halo_row, (x // 4 * 4 + y // 4 * 2 + z // 4) * 64 + x % 4 * 16 + y % 4 * 4 + z % 4 + 1 AS id FROM g")
def grid_pos2id(spark: SparkSession, d: str) -> DataFrame:
    return halos(spark, d).select("halo_row", ids.pos2id(_GRID, [F.col(a) % 8 for a in "xyz"]).alias("id"))


@query("decode_positions", "SELECT DISTINCT p_partkey % 512 AS pid, CAST(125 * (p_partkey % 512 // 64) - 16 + p_partkey % 32 AS DOUBLE) AS x, CAST(125 * (p_partkey % 512 // 8 % 8) - 16 + p_partkey % 16 AS DOUBLE) AS y, CAST(125 * (p_partkey % 8) - 16 + p_partkey % 8 AS DOUBLE) AS z FROM part")
def decode_positions(spark: SparkSession, d: str) -> DataFrame:
    how = ids.Decoding.of({"npartTotal": [0, 512, 0, 0, 0, 0], "BoxSize": 1000.0, "disp_min": -16.0, "disp_max": 16.0, "pos_bits": 16, "id_start": 1})
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey % 512 AS pid", "p_partkey % 32 * 2048 AS ux", "p_partkey % 16 * 2048 AS uy", "p_partkey % 8 * 2048 AS uz")
    return ids.decode(rows, how).select("pid", *[F.col(a).cast("double").alias(a) for a in "xyz"]).distinct()


_BOX_SQL = f"{P_SQL}, b AS (SELECT pid // 10 AS node, min(x % 100) AS low_x, min(y % 100) AS low_y, min(z % 100) AS low_z, max(x % 100) AS upp_x, max(y % 100) AS upp_y, max(z % 100) AS upp_z, count(*) AS entries FROM p GROUP BY ALL)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return tiling.pack_nodes(particles(spark, d).select(F.expr("pid div 10").alias("node"), *[(F.col(a) % 100).alias(a) for a in "xyz"]))


@query("mbr_by_group", f"WITH {_BOX_SQL} SELECT node, low_x, low_y, low_z, upp_x, upp_y, upp_z, entries FROM b")
def mbr_by_group(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d)


@query("mbr_margin_area", f"WITH {_BOX_SQL} SELECT node, CAST(upp_x - low_x + upp_y - low_y + upp_z - low_z AS DOUBLE) AS margin, CAST((upp_x - low_x) * (upp_y - low_y) * (upp_z - low_z) AS DOUBLE) AS area FROM b")
def mbr_margin_area(spark: SparkSession, d: str) -> DataFrame:
    low, upp = geo.point("low_x", "low_y", "low_z"), geo.point("upp_x", "upp_y", "upp_z")
    return _boxes(spark, d).select("node", geo.margin(low, upp).cast("double").alias("margin"), geo.volume(low, upp).cast("double").alias("area"))


@query("mbr_overlap_join", f"WITH {H_SQL} SELECT a.id AS id1, b.id AS id2 FROM h a JOIN h b ON a.id < b.id AND abs(a.x - b.x) <= 40 AND abs(a.y - b.y) <= 40 AND abs(a.z - b.z) <= 40")
def mbr_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of half-width 20 meet through the grid cells that they cover, in a merge join: the cells are more than Catalyst takes them for."""
    low, upp = geo.query_box(geo.point("x", "y", "z"), 20.0)
    boxes = halos(spark, d).select("id", *[c.alias(f"low_{a}") for a, c in zip("xyz", low, strict=True)], *[c.alias(f"upp_{a}") for a, c in zip("xyz", upp, strict=True)])
    for a in "xyz":
        boxes = boxes.withColumn(f"g{a}", F.explode(F.sequence(F.floor(F.col(f"low_{a}") / 40), F.floor(F.col(f"upp_{a}") / 40))))
    one, two = boxes.alias("a"), boxes.alias("b")
    side = lambda t, e: [F.col(f"{t}.{e}_{a}") for a in "xyz"]
    same = [F.col(f"a.g{a}") == F.col(f"b.g{a}") for a in "xyz"]
    # A pair is counted in one cell alone: the lowest that both boxes cover.
    first = [F.col(f"a.g{a}") == F.floor(F.greatest(F.col(f"a.low_{a}"), F.col(f"b.low_{a}")) / 40) for a in "xyz"]
    meet = geo.overlaps(side("a", "low"), side("a", "upp"), side("b", "low"), side("b", "upp"))
    return one.join(two.hint("merge"), same).filter((F.col("a.id") < F.col("b.id")) & meet & first[0] & first[1] & first[2]).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, tuple]:
    """Neighbouring halos' boxes of half-width 40, coordinates modulo 100."""
    low, upp = geo.query_box([geo.f32(F.col(a) % 100) for a in "xyz"], 40.0)
    h = halos(spark, d).select("id", *[c.alias(f"l{a}") for a, c in zip("xyz", low, strict=True)], *[c.alias(f"u{a}") for a, c in zip("xyz", upp, strict=True)])
    two = h.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"{c}2") for c in h.columns[1:]])
    return h.join(two, "id"), ([F.col(f"l{a}") for a in "xyz"], [F.col(f"u{a}") for a in "xyz"], [F.col(f"l{a}2") for a in "xyz"], [F.col(f"u{a}2") for a in "xyz"])


_PAIR_SQL = f"{H_SQL}, q AS (SELECT a.id, a.x % 100 AS x, a.y % 100 AS y, a.z % 100 AS z, b.x % 100 AS x2, b.y % 100 AS y2, b.z % 100 AS z2 FROM h a JOIN h b ON a.id = b.id - 1)"


@query("mbr_overlap_area", f"WITH {_PAIR_SQL} SELECT id, CAST(greatest(0, 80 - abs(x - x2)) * greatest(0, 80 - abs(y - y2)) * greatest(0, 80 - abs(z - z2)) AS DOUBLE) AS area FROM q")
def mbr_overlap_area(spark: SparkSession, d: str) -> DataFrame:
    pairs, boxes = _pairs(spark, d)
    return pairs.select("id", geo.overlap_volume(*boxes).cast("double").alias("area"))


@query("mbr_center_distance", f"WITH {_PAIR_SQL} SELECT id, CAST((x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2) AS DOUBLE) AS d2 FROM q")
def mbr_center_distance(spark: SparkSession, d: str) -> DataFrame:
    pairs, boxes = _pairs(spark, d)
    return pairs.select("id", geo.center_distance(*boxes).cast("double").alias("d2"))


@query("mbr_enlarge", f"WITH {_PAIR_SQL} SELECT id, {', '.join(f'CAST(least({a}, {a}2) - 40 AS DOUBLE) AS low_{a}, CAST(greatest({a}, {a}2) + 40 AS DOUBLE) AS upp_{a}' for a in 'xyz')} FROM q")
def mbr_enlarge(spark: SparkSession, d: str) -> DataFrame:
    pairs, boxes = _pairs(spark, d)
    low, upp = geo.enlarge(*boxes)
    both = zip("xyz", low, upp, strict=True)
    return pairs.select("id", *[c for a, lo, up in both for c in (lo.cast("double").alias(f"low_{a}"), up.cast("double").alias(f"upp_{a}"))])


_TILE_SQL = (
    f"WITH {H_SQL}, k AS (SELECT CAST(10 * ceil(pow(ceil(count(*) / 10.0), 2.0 / 3)) AS BIGINT) AS w1, CAST(10 * ceil(sqrt(ceil(count(*) / 10.0))) AS BIGINT) AS w2 FROM h), "
    "a AS (SELECT h.*, w1, w2, row_number() OVER (ORDER BY y, id DESC) - 1 AS p1 FROM h, k), "
    "b AS (SELECT *, p1 // w1 AS slab, row_number() OVER (PARTITION BY p1 // w1 ORDER BY x, p1) - 1 AS p2 FROM a), "
    "c AS (SELECT *, p2 // w2 AS chunk, row_number() OVER (PARTITION BY slab, p2 // w2 ORDER BY z, p2) - 1 AS p3 FROM b) "
)


@query("str_leaf_tiles", f"{_TILE_SQL} SELECT id, CAST(slab * w1 + chunk * w2 + p3 AS BIGINT) AS pos, CAST((slab * w1 + chunk * w2 + p3) // 10 AS BIGINT) AS node FROM c")
def str_leaf_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile(halos(spark, d), "id").select("id", "pos", "node")


@query("str_level_counts", "WITH RECURSIVE t(level, nodes) AS (SELECT 0, (count(*) + 9) // 10 FROM customer UNION ALL SELECT level + 1, (nodes + 9) // 10 FROM t WHERE nodes > 1) SELECT CAST(level AS INTEGER) AS level, CAST(nodes AS BIGINT) AS nodes FROM t")
def str_level_counts(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    return spark.createDataFrame(list(enumerate(tiling.level_counts(n))), "level int, nodes long")


_HIST_SQL = f"WITH {H_SQL}, g AS (SELECT CAST(x & 255 AS INTEGER) AS digit, count(*) AS n FROM h GROUP BY ALL)"


@query("digit_histogram", f"{_HIST_SQL} SELECT digit, n FROM g")
def digit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tiling.digit_histogram(halos(spark, d), "x")


@query("histogram_prefix_sum", f'{_HIST_SQL} SELECT digit, n, CAST(coalesce(sum(n) OVER (ORDER BY digit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM g')
def histogram_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return tiling.prefix_sum(digit_histogram(spark, d))


@query("sorted_ids", "SELECT o_custkey AS id FROM orders WHERE o_orderkey % 37 = 0 ORDER BY 1")
def sorted_ids(spark: SparkSession, d: str) -> DataFrame:
    return filter_ids(spark, d).orderBy("id")


@query("union_batches", f"WITH {P_SQL} SELECT pid, batch, x, y, z FROM p")
def union_batches(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d)
    a, n, r = (p.filter(F.col("batch") == b) for b in ("A", "N", "R"))
    return a.unionByName(n).unionByName(r)


_READ_SQL = "SELECT id, CAST(id AS DOUBLE) AS mass, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM "


def _halo_files(spark: SparkSession, d: str, files: int = 3) -> str:
    """The halos as halo lists in a scratch folder, to be read again."""
    folder = new_folder(spark)
    text.write_halos(halos(spark, d).withColumn("mass", F.col("id").cast("double")), folder, files)
    return f"{folder}/*"


def _as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in ("mass", "x", "y", "z") else F.col(c) for c in names])


@query("scan_halo_files", f"WITH {H_SQL} {_READ_SQL} h")
def scan_halo_files(spark: SparkSession, d: str) -> DataFrame:
    """Halo lists behind headers, several files, written from customer and read through the text reader."""
    return _as_double(text.read_halos(spark, _halo_files(spark, d)), "id", "mass", "x", "y", "z")


@query("scan_halo_ordinals", "SELECT count(*) AS n, min(c_custkey) - min(c_custkey) AS low, count(*) - 1 AS high, count(*) AS different FROM customer")
def scan_halo_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """The ordinals of the data lines: gapless from 0 over all files."""
    rows = text.read_halos(spark, _halo_files(spark, d))
    return rows.agg(F.count("*").alias("n"), F.min("halo_row").alias("low"), F.max("halo_row").alias("high"), F.count_distinct("halo_row").alias("different"))


@query("scan_halos_by_id_list", f"WITH {H_SQL}{_FILTERED} {_READ_SQL} f")
def scan_halos_by_id_list(spark: SparkSession, d: str) -> DataFrame:
    """An id list written as text and read back, and the halo lists filtered by it."""
    ids_at = new_folder(spark)
    filter_ids(spark, d).select(F.col("id").cast("string")).write.text(ids_at)
    return _as_double(text.read_halos(spark, _halo_files(spark, d), text.read_ids(spark, ids_at)), "id", "mass", "x", "y", "z")


@query("scan_decoded_files", f"WITH {P_SQL} SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, count(*) AS n FROM p GROUP BY ALL")
def scan_decoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Decoded particle files, written in parallel from lineitem and read back."""
    folder = new_folder(spark)
    binary.write_particle_files(particles(spark, d), folder)
    return _as_double(binary.read_particles(spark, folder), "x", "y", "z").groupBy("x", "y", "z").agg(F.count("*").alias("n"))


_HEADER = {"npart": [0, 512, 0, 0, 0, 0], "npartTotal": [0, 512, 0, 0, 0, 0], "BoxSize": 1000.0, "disp_min": -16.0, "disp_max": 16.0, "pos_bits": 16, "id_start": 1}
_CODE_SQL = "c AS (SELECT DISTINCT r_regionkey AS part, CAST(unnest(range(512)) AS BIGINT) AS pid FROM region)"


def _compressed_files(spark: SparkSession, d: str) -> str:
    """A compressed file of 512 particles for each region, in a scratch folder."""
    folder = new_folder(spark)
    header = _HEADER

    def write(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for key in batch.column("r_regionkey").to_pylist():
                pid = np.arange(512)
                codes = np.stack([(pid + key) % 32 * 2048, (pid + key) % 16 * 2048, (pid + key) % 8 * 2048], axis=1)
                binary._write_file(f"{folder}/c{key}", binary.pack_compressed(header, codes))
            yield pa.RecordBatch.from_arrays([batch.column("r_regionkey")], ["r_regionkey"])

    regions = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("r_regionkey"))
    regions.mapInArrow(write, "r_regionkey long").count()
    return folder


@query("scan_compressed_files", f"WITH {_CODE_SQL} SELECT part, pid, CAST((pid + part) % 32 * 2048 AS INTEGER) AS ux, CAST((pid + part) % 16 * 2048 AS INTEGER) AS uy, CAST((pid + part) % 8 * 2048 AS INTEGER) AS uz FROM c")
def scan_compressed_files(spark: SparkSession, d: str) -> DataFrame:
    rows = binary.read_compressed(spark, _compressed_files(spark, d))
    return rows.select(F.regexp_extract("file", r"c(\d+)$", 1).cast("long").alias("part"), "pid", "ux", "uy", "uz")


@query("scan_and_decode_files", f"WITH {_CODE_SQL} SELECT part, pid, CAST(125 * (pid // 64) - 16 + (pid + part) % 32 AS DOUBLE) AS x, CAST(125 * (pid // 8 % 8) - 16 + (pid + part) % 16 AS DOUBLE) AS y, CAST(125 * (pid % 8) - 16 + (pid + part) % 8 AS DOUBLE) AS z FROM c")
def scan_and_decode_files(spark: SparkSession, d: str) -> DataFrame:
    rows = binary.decode_compressed(spark, _compressed_files(spark, d))
    return _as_double(rows.withColumn("part", F.regexp_extract("file", r"c(\d+)$", 1).cast("long")), "part", "pid", "x", "y", "z")


@query("scan_decoded_output", f"WITH {_CODE_SQL} SELECT part, count(*) * 12 AS bytes FROM c GROUP BY part")
def scan_decoded_output(spark: SparkSession, d: str) -> DataFrame:
    """Compressed files decoded to files, and the sizes of those."""
    out = new_folder(spark)
    binary.decode_files(spark, _compressed_files(spark, d), out)
    return binary.file_sizes(spark, out).select(F.regexp_extract("file", r"decoded_c(\d+)$", 1).cast("long").alias("part"), "bytes")


@query("scan_headers", "SELECT r_regionkey AS part, f.field, f.value FROM region, (VALUES ('BoxSize', '1000.0'), ('pos_bits', '16'), ('npart', '[0, 512, 0, 0, 0, 0]')) f(field, value)")
def scan_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = binary.header_rows(spark, _compressed_files(spark, d)).filter(F.col("field").isin("BoxSize", "pos_bits", "npart"))
    return rows.select(F.regexp_extract("file", r"c(\d+)$", 1).cast("long").alias("part"), "field", "value")


_EDGE_NAMES = ["0.000000", "10.000000", "20.000000", "40.000000"]
_SHELL_TEXT = " || ".join(f"chr(10) || '  [{_EDGE_NAMES[i]} ~ {_EDGE_NAMES[i + 1]}]: ' || n{i}" for i in range(3))


@query("report_text", f"{_wide_sql()}, t AS (SELECT 'id ' || id || {_SHELL_TEXT} AS text FROM w UNION ALL SELECT chr(10) || 'Total' || {_SHELL_TEXT} FROM (SELECT {_SUMS} FROM w)) SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM t) GROUP BY line")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The report of the shell counts as written files, by line."""
    folder = new_folder(spark)
    text.write_report_files(shell_count_periodic(spark, d), RADII, folder)
    return spark.read.text(folder).select(F.col("value").alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@query("accumulated_batches", f"{_wide_sql()} {_WIDE}")
def accumulated_batches(spark: SparkSession, d: str) -> DataFrame:
    """Counts of one particle batch after the other, added up."""
    p = particles(spark, d)
    return shells.accumulate([shells.shell_counts(halos(spark, d), p.filter(F.col("batch") == b), RADII) for b in "ANR"])


@query("incremental_files", f"{_wide_sql()} {_WIDE}")
def incremental_files(spark: SparkSession, d: str) -> DataFrame:
    """The same from files: halo lists and decoded files, a micro-batch per particle file. ids name the halos."""
    folder = new_folder(spark)
    binary.write_particle_files(particles(spark, d).repartition(3).select("pid", "x", "y", "z"), folder)
    counts = search(spark, _halo_files(spark, d), folder, RADII, mode="incremental")
    return counts.withColumn("halo_row", F.col("id"))


_NODE_SQL = _TILE_SQL + ", n1 AS (SELECT (slab * w1 + chunk * w2 + p3) // 10 AS node, min(x) AS low_x, min(y) AS low_y, min(z) AS low_z, max(x) AS upp_x, max(y) AS upp_y, max(z) AS upp_z, count(*) AS entries FROM c GROUP BY ALL)"
_LEVEL2_SQL = (
    ", k2 AS (SELECT CAST(10 * ceil(pow(ceil(count(*) / 10.0), 2.0 / 3)) AS BIGINT) AS v1, CAST(10 * ceil(sqrt(ceil(count(*) / 10.0))) AS BIGINT) AS v2 FROM n1), "
    "a2 AS (SELECT n1.*, v1, v2, row_number() OVER (ORDER BY low_y + upp_y, node DESC) - 1 AS p1 FROM n1, k2), "
    "b2 AS (SELECT *, p1 // v1 AS slab, row_number() OVER (PARTITION BY p1 // v1 ORDER BY low_x + upp_x, p1) - 1 AS p2 FROM a2), "
    "c2 AS (SELECT *, p2 // v2 AS chunk, row_number() OVER (PARTITION BY slab, p2 // v2 ORDER BY low_z + upp_z, p2) - 1 AS p3 FROM b2), "
    "n2 AS (SELECT (slab * v1 + chunk * v2 + p3) // 10 AS node, min(low_x) AS low_x, min(low_y) AS low_y, min(low_z) AS low_z, max(upp_x) AS upp_x, max(upp_y) AS upp_y, max(upp_z) AS upp_z, count(*) AS entries FROM c2 GROUP BY ALL)"
)
_BOX_COLUMNS = "CAST(node AS BIGINT) AS node, low_x, low_y, low_z, upp_x, upp_y, upp_z, entries"


@query("str_two_levels", f"{_NODE_SQL}{_LEVEL2_SQL} SELECT 1 AS depth, {_BOX_COLUMNS} FROM n1 UNION ALL SELECT 2, {_BOX_COLUMNS} FROM n2")
def str_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """The two lowest levels of the packed tree over the halos."""
    levels = tiling.build_levels(halos(spark, d), "id")
    rows = [nodes.withColumn("depth", F.lit(k + 1)) for k, nodes in enumerate(levels[:2])]
    out = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return out.select("depth", "node", *[f"{e}_{a}" for e in ("low", "upp") for a in "xyz"], "entries")


@query("str_traversal", f"{_NODE_SQL} SELECT min(low_x) AS low_x, min(low_y) AS low_y, min(low_z) AS low_z, max(upp_x) AS upp_x, max(upp_y) AS upp_y, max(upp_z) AS upp_z FROM n1")
def str_traversal(spark: SparkSession, d: str) -> DataFrame:
    """The root, with which the traversal of the tree begins."""
    rows = tiling.traverse(tiling.build_levels(halos(spark, d), "id"))
    return rows.filter("level = 0").select(*[f"{e}_{a}" for e in ("low", "upp") for a in "xyz"])
