"""The shell count: for each halo and each shell, how many particles lie in it, in a periodic box.

Plan: halos become at most eight periodic images each, images become the grid cells that their query box covers, and cells
meet particles in an equi-join on the cell; the exact float predicate then decides. Only the halo side is multiplied, by a
number that depends on radius and cell size alone. One pass counts all shells. The join is always a merge join: Catalyst
takes the cells for as small as the halos' file, and would broadcast them through the driver. AQE splits skewed cells.
Halos at one place are searched once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radialspark.functions.geometry import BOX_HIGH, BOX_LOW, check_radii, f32, float32, half_width, squared_distance

#: Cells that an image may cover before the cells are made larger.
MOST_CELLS = 512


def shell_of(d2: Column, radii: Sequence[float]) -> Column:
    """The first shell whose outer radius is beyond the distance; null beyond the last.

    Asked from the outside: most particles of a ball lie in its outermost shells.
    """
    last = len(radii) - 1
    out = F.when(d2 >= f32(float32(radii[last] * radii[last])), F.lit(None).cast("int"))
    for i in range(last, 0, -1):
        out = out.when(d2 >= f32(float32(radii[i - 1] * radii[i - 1])), F.lit(i))
    return out.otherwise(F.lit(0))


def images(halos: DataFrame, radius: float, periodic: bool = True, low: float = BOX_LOW, high: float = BOX_HIGH) -> DataFrame:
    """halos(halo_row, x, y, z) -> one row per image: halo_row, ix, iy, iz and the shifts sx, sy, sz.

    An axis is shifted up by the box length if the query box starts below the box, else down if it ends above; all
    combinations of shifted axes are images. Images are summed, so beyond half the box a particle may count twice.
    """
    r, size = half_width(radius), high - low
    out = halos
    for axis in "xyz":
        c = f32(F.col(axis))
        up, down = f32(c - f32(r)) < f32(low), f32(c + f32(r)) > f32(high)
        shifts = F.array(F.lit(0.0))
        if periodic:
            shifts = F.when(up, F.array(F.lit(0.0), F.lit(size))).when(down, F.array(F.lit(0.0), F.lit(-size))).otherwise(shifts)
        out = out.withColumn(f"s{axis}", F.explode(shifts.cast("array<float>")))
    return out.select("halo_row", *[f32(F.col(a) + F.col(f"s{a}")).alias(f"i{a}") for a in "xyz"], "sx", "sy", "sz")


def cell_size(radius: float, asked: float | None = None) -> float:
    """The edge of a grid cell: the radius unless asked otherwise, larger if an image would cover too many cells."""
    edge = asked or max(radius, 1e-6)
    while (2 * radius / edge + 2) ** 3 > MOST_CELLS:
        edge *= 2
    return edge


def _cell(value: Column, edge: float) -> Column:
    return F.floor(value.cast("double") / F.lit(float(edge))).cast("long")


def neighbours(halos: DataFrame, particles: DataFrame, radius: float, *, periodic: bool = True, exclude_coincident: bool = False, cell: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of a halo image and a particle nearer than radius: halo_row, d2 and the kept particle columns."""
    r = half_width(radius)
    edge = cell_size(r, cell)
    cells = images(halos.select("halo_row", "x", "y", "z"), radius, periodic)
    for axis in "xyz":
        c = F.col(f"i{axis}")
        reach = F.sequence(_cell(f32(c - f32(r)), edge), _cell(f32(c + f32(r)), edge))
        cells = cells.withColumn(f"g{axis}", F.explode(reach))
    p = particles.select(*keep, *[f32(F.col(a)).alias(f"p{a}") for a in "xyz"], *[_cell(f32(F.col(a)), edge).alias(f"g{a}") for a in "xyz"])
    d2 = squared_distance([F.col(f"i{a}") for a in "xyz"], [F.col(f"p{a}") for a in "xyz"])
    limit = float32(float32(radius) ** 2)
    joined = p.join(cells.hint("merge"), ["gx", "gy", "gz"]).withColumn("d2", d2).filter(F.col("d2") < f32(limit))
    if exclude_coincident:
        joined = joined.filter(F.col("d2") > f32(0.0))
    return joined.select("halo_row", "d2", *keep)


def sites(halos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(halo_row, site) and, to be searched in place of the halos, (halo_row, x, y, z) with the site as halo_row.

    A site is the list of the points of a halo_row, one as a rule, as text: halos at one place share it.
    """
    at = F.array_sort(F.collect_list(F.struct(*[f32(F.col(a)).alias(a) for a in "xyz"])))
    rows = halos.groupBy("halo_row").agg(at.alias("at")).select("halo_row", F.col("at").cast("string").alias("site"), "at")
    places = rows.groupBy("site").agg(F.first("at").alias("at")).select(F.col("site").alias("halo_row"), F.inline("at"))
    return rows.select("halo_row", "site"), places


def of_halos(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for sites, given to each halo; a merge join, since both sides grow with the halos."""
    names = found.columns[1:]
    return rows.hint("merge").join(found.withColumnRenamed("halo_row", "site"), "site").select("halo_row", *names)


def shell_counts_long(halos: DataFrame, particles: DataFrame, radii: Sequence[float], *, by: Sequence[str] = (), **options) -> DataFrame:
    """halo_row, by, shell, n for the shells that hold a particle; the form for many shells."""
    radii = check_radii(radii)
    rows, places = sites(halos)
    near = neighbours(places, particles, radii[-1], keep=list(by), **options)
    return of_halos(rows, near.withColumn("shell", shell_of(F.col("d2"), radii)).groupBy("halo_row", *by, "shell").agg(F.count("*").alias("n")))


def shell_counts(halos: DataFrame, particles: DataFrame, radii: Sequence[float], *, filter_ids: DataFrame | None = None, by: Sequence[str] = (), **options) -> DataFrame:
    """One row per halo with a count per shell, n0, n1, ...; halos without particles have zeros.

    With ``by``, particle columns such as the file become part of the key, and only halos with particles are listed.
    """
    radii = check_radii(radii)
    if filter_ids is not None:
        halos = semi_filter(halos, filter_ids)
    rows, places = sites(halos)
    near = neighbours(places, particles, radii[-1], keep=list(by), **options).withColumn("shell", shell_of(F.col("d2"), radii))
    counts = of_halos(rows, near.groupBy("halo_row", *by).agg(*[F.count(F.when(F.col("shell") == i, 1)).alias(f"n{i}") for i in range(len(radii))]))
    if by:
        return counts
    zero = [F.coalesce(f"n{i}", F.lit(0)).cast("long").alias(f"n{i}") for i in range(len(radii))]
    return halos.select("halo_row", "id").join(counts, "halo_row", "left").select("halo_row", "id", *zero)


def semi_filter(halos: DataFrame, ids: DataFrame) -> DataFrame:
    """The halos whose id is listed; repeated ids in the list repeat nothing, repeated halo ids all stay."""
    return halos.join(ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], "id"), "id", "left_semi")


def total(counts: DataFrame, legacy: bool = False) -> DataFrame:
    """The sum of each shell over all halos; legacy counts the first halo twice."""
    names = [c for c in counts.columns if c[:1] == "n" and c[1:].isdigit()]
    sums = []
    for c in names:
        s = F.sum(c)
        if legacy:
            s = s + F.coalesce(F.sum(F.when(F.col("halo_row") == 0, F.col(c))), F.lit(0))
        sums.append(F.coalesce(s, F.lit(0)).cast("long").alias(c))
    return counts.agg(*sums)


def cumulative(counts: DataFrame) -> DataFrame:
    """Counts of whole balls instead of shells: c0 = n0, c1 = n0 + n1, ..."""
    names = sorted((c for c in counts.columns if c[:1] == "n" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    out, run = [], F.lit(0).cast("long")
    for c in names:
        run = run + F.col(c)
        out.append(run.alias(f"c{c[1:]}"))
    return counts.select("halo_row", "id", *out)


def range_search(halos: DataFrame, particles: DataFrame, radius: float, **options) -> DataFrame:
    """halo_row, pid of the particles nearer than a true radius; a negative radius finds nothing."""
    if radius < 0:
        return halos.sparkSession.createDataFrame([], "halo_row long, pid long")
    rows, places = sites(halos)
    return of_halos(rows, neighbours(places, particles, radius, keep=["pid"], **options).select("halo_row", "pid"))


def range_lists(halos: DataFrame, particles: DataFrame, radius: float, **options) -> DataFrame:
    """halo_row, pids (ascending, joined by commas) and their number n, for halos that range_search finds particles for."""
    rows, places = sites(halos)
    near = neighbours(places, particles, radius, keep=["pid"], **options).filter(F.lit(radius >= 0))
    lists = near.groupBy("halo_row").agg(F.array_sort(F.collect_list("pid")).alias("pids"), F.count("*").alias("n"))
    text = F.concat_ws(",", F.transform("pids", lambda x: x.cast("string")))
    return of_halos(rows, lists.select("halo_row", text.alias("pids"), "n"))


def accumulate(parts: Sequence[DataFrame]) -> DataFrame:
    """Counts of several particle batches added up."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = [c for c in parts[0].columns if c[:1] == "n" and c[1:].isdigit()]
    return rows.groupBy("halo_row", "id").agg(*[F.sum(c).cast("long").alias(c) for c in names])
