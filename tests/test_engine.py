import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from radialspark.functions import geometry as geo
from radialspark.functions import grid
from radialspark.operators import shells, tiling
from radialspark.plans import catalog
from radialspark.sources import binary, generate, text
from radialspark.streaming import incremental

SF = "/root/testdata/sf0.001"
POINTS = [(0, 0, 0), (1, 0, 0), (999, 0, 0), (999, 999, 999), (0, 0, 995), (0, 0, 996), (0, 3, 997), (500, 500, 500)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer lineitem orders part region".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 150


def _halos(spark):
    return spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, 999.0, 999.0, 999.0)], "halo_row long, id long, x float, y float, z float")


def _particles(spark, rows=POINTS):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "pid long, x float, y float, z float")


@pytest.mark.parametrize(
    ("how", "want"),
    [({}, [(1, 3, 2), (1, 2, 4)]), ({"periodic": False}, [(1, 1, 0), (1, 0, 0)]), ({"exclude_coincident": True}, [(0, 3, 2), (0, 2, 4)]), ({"cell": 50.0}, [(1, 3, 2), (1, 2, 4)])],
)
def test_corner_case(spark, how, want):
    counts = shells.shell_counts(_halos(spark), _particles(spark), [1, 2, 5], **how)
    assert [tuple(r)[2:] for r in counts.orderBy("halo_row").collect()] == want


def test_totals_and_batches(spark):
    counts = shells.shell_counts(_halos(spark), _particles(spark), [1, 2, 5])
    assert tuple(shells.total(counts).first()) == (2, 5, 6)
    assert tuple(shells.total(counts, legacy=True).first()) == (3, 8, 8)
    parts = [shells.shell_counts(_halos(spark), _particles(spark, p), [1, 2, 5]) for p in (POINTS[:3], POINTS[3:])]
    assert sorted(map(tuple, shells.accumulate(parts).collect())) == sorted(map(tuple, counts.collect()))
    empty = shells.shell_counts(_halos(spark), _particles(spark).filter("false"), [1, 2, 5])
    assert tuple(shells.total(empty).first()) == (0, 0, 0)


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    h, p = (rng.uniform(0, 1000, (n, 3)).astype(np.float32) for n in (40, 3000))
    radii = geo.log_radii(5, 120, 6)
    halos = spark.createDataFrame([(i, i, *map(float, r)) for i, r in enumerate(h)], "halo_row long, id long, x float, y float, z float")
    got = shells.shell_counts(halos, _particles(spark, p.tolist()), radii).orderBy("halo_row").collect()
    R, f = np.float32(geo.half_width(radii[-1])), np.float32
    edges = np.array([f(f(r) * f(r)) for r in radii], f)
    for row, c in zip(got, h, strict=True):
        want = np.zeros(len(radii), int)
        shifts = [[f(0)] + ([f(1000)] if x - R < 0 else [f(-1000)] if x + R > 1000 else []) for x in c]
        for sx in shifts[0]:
            for sy in shifts[1]:
                for sz in shifts[2]:
                    d = np.stack([(c[k] + s) - p[:, k] for k, s in enumerate((sx, sy, sz))])
                    d2 = (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]
                    which = np.searchsorted(edges, d2, "right")
                    want += np.bincount(which, minlength=len(radii) + 1)[: len(radii)]
        assert list(row)[2:] == want.tolist()


def test_range_search(spark):
    got = shells.range_search(_halos(spark), _particles(spark), 2.0)
    assert {(r[0], r[1]) for r in got.collect()} == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (1, 0), (1, 2)}
    assert shells.range_search(_halos(spark), _particles(spark), -1.0).count() == 0


def test_radii():
    r = geo.log_radii(0.001, 5, 40)
    assert len(r) == 40 and r[-1] == 5.0 and math.isclose(r[1], 0.00124407, rel_tol=1e-4) and math.isclose(r[38], 4.019061, rel_tol=1e-6)
    assert geo.log_radii(1, 7, 1) == [7.0]
    for bad in ((0, 1, 3), (2, 2, 3), (1, 2, 0)):
        with pytest.raises(ValueError):
            geo.log_radii(*bad)
    with pytest.raises(ValueError):
        geo.check_radii([2, 1])


def test_ids_round_trip(spark):
    g = grid.Grid(3, 4)
    ids = spark.range(1, 12**3 + 1)
    pos = ids.select("id", *[c.alias(a) for a, c in zip("xyz", grid.id2pos(g, F.col("id")), strict=True)])
    assert pos.filter(grid.pos2id(g, [F.col(a) for a in "xyz"]) != F.col("id")).count() == 0
    assert pos.select("x", "y", "z").distinct().count() == 12**3


def test_compressed(spark, tmp_path):
    codes = np.zeros((8, 3), np.uint16)
    codes[1], codes[7] = (32768, 32768, 32768), (32768, 34816, 0)
    header = {"npart": [0, 8, 0, 0, 0, 0], "npartTotal": [0, 8, 0, 0, 0, 0], "BoxSize": 1000.0, "disp_min": -16.0, "disp_max": 16.0, "pos_bits": 16, "id_start": 1}
    path = tmp_path / "c.bin"
    path.write_bytes(binary.pack_compressed(header, codes))
    [(_, found)] = binary.read_headers(spark, str(path))
    assert found["BoxSize"] == 1000.0 and found["id_start"] == 1 and len(found["fill"]) == 56
    rows = {r["pid"]: (r["x"], r["y"], r["z"]) for r in binary.decode_compressed(spark, str(path)).collect()}
    assert rows[0] == (-16, -16, -16) and rows[1] == (0, 0, 500) and rows[7] == (500, 501, 484)
    out = tmp_path / "decoded.bin"
    binary.write_particles(binary.decode_compressed(spark, str(path)), str(out))
    assert [tuple(r)[2:] for r in binary.read_particles(spark, str(out)).orderBy("pid").collect()] == [rows[i] for i in range(8)]


def test_generators_and_text(spark, tmp_path):
    a, b = (str(tmp_path / n) for n in ("p0", "p1"))
    generate.write_uniform_particles([a, b], 2)
    with open(b, "ab") as f:
        f.write(b"123")
    rows = binary.read_particles(spark, [a, b]).orderBy("file", "pid")
    lines = [r[0] for r in rows.select(text.particle_line()).collect()]
    assert lines[:3] == ["{851.985474 123.192955 73.903595}", "{127.631561 894.931763 904.444397}", "{436.493561 242.660706 127.677734}"] and len(lines) == 4
    h = str(tmp_path / "h.list")
    generate.write_uniform_halos([h], 3)
    halos = text.read_halos(spark, h)
    assert halos.orderBy("halo_row").select(text.halo_line()).first()[0] == "0: 827952005120.000000 {418.681091 810.143127 415.767883}"
    ids = tmp_path / "ids"
    ids.write_text("2\n2\n 7x\n0")
    assert [r[0] for r in text.read_halos(spark, h, text.read_ids(spark, str(ids))).orderBy("id").select("id").collect()] == [0, 2]
    (tmp_path / "bad").write_text("#\n" * 16 + "1 2 3\n")
    with pytest.raises(Exception, match="malformed"):
        text.read_halos(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "short").write_text("#\n" * 9)
    with pytest.raises(ValueError, match="header"):
        text.read_halos(spark, str(tmp_path / "short"))
    generate.write_uniform_halos([f"{h}2"], 2)
    assert sorted(r[0] for r in text.read_halos(spark, [h, f"{h}2"]).select("halo_row").collect()) == [0, 1, 2, 3, 4]
    assert generate.uniform_particles(spark, 10).count() == generate.uniform_halos(spark, 10).count() == 10


def test_report(spark, tmp_path):
    counts = shells.shell_counts(_halos(spark), _particles(spark), [1, 2, 5])
    text.write_report(counts, [1, 2, 5], str(tmp_path / "r"))
    got = (tmp_path / "r").read_text().splitlines()
    assert got[:2] == ["id 0", "  [0.000000 ~ 1.000000]: 1"] and got[-4:] == ["Total", "  [0.000000 ~ 1.000000]: 2", "  [1.000000 ~ 2.000000]: 5", "  [2.000000 ~ 5.000000]: 6"]


def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    generate.write_uniform_particles([path], 5000)
    want = sorted(map(tuple, binary.read_particles(spark, path).collect()))
    monkeypatch.setattr(binary, "RANGE", 12 * 700)
    assert sorted(map(tuple, binary.read_particles(spark, path, whole=0).collect())) == want
    codes = np.random.default_rng(1).integers(0, 65536, (1000, 3))
    header = {"npart": [0, 990, 0, 0, 0, 0], "npartTotal": [0, 1000, 0, 0, 0, 0], "BoxSize": 1000.0, "disp_min": -16.0, "disp_max": 16.0, "pos_bits": 16, "id_start": 1}
    (tmp_path / "c").write_bytes(binary.pack_compressed(header, codes))
    whole, parts = (binary.decode_compressed(spark, str(tmp_path / "c"), whole=w) for w in (1 << 20, 0))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and parts.count() == 990
    plain = grid.decode(binary.read_compressed(spark, str(tmp_path / "c")), grid.Decoding.of(header))
    assert sorted(tuple(r) for r in plain.collect()) == sorted(tuple(r)[1:] for r in whole.collect())


def test_command_line(spark, tmp_path, capsys):
    from radialspark.__main__ import main

    p, h = str(tmp_path / "in" / "p0"), str(tmp_path / "h")
    (tmp_path / "in").mkdir()
    main(["generate-particles", "-f", p, "-n", "2000"])
    main(["generate-halos", "-f", h, "-n", "5"])
    out = [str(tmp_path / n) for n in ("a", "b", "c")]
    main(["count", "--particle-files", p, "--halo-file", h, "--radius", "200:50:3", "--output-file", out[0]])
    main(["count", "--particle-files", str(tmp_path / "in"), "--halo-file", h, "--radius", "50:200:3", "--mode", "incremental", "--output-file", out[1]])
    main(["count", "--particle-files", p, "--halo-file", h, "--radius", "50:200:3", "--output-folder", out[2]])
    report = (tmp_path / "a").read_text()
    assert report == (tmp_path / "b").read_text() and report.startswith("id 0\n  [0.000000 ~ 50.000000]: ") and "\nTotal\n" in report
    assert "".join(f.read_text() for f in sorted((tmp_path / "c").glob("part-*"))) == report
    assert "searching:" in capsys.readouterr().err
    main(["halos", "-f", h])
    assert capsys.readouterr().out.startswith("0: 827952005120.000000 {418.681091")
    for bad in (["--radius", "1:1:3"], ["--radius", "0:2:3"], ["--radius", "1:2"]):
        with pytest.raises(SystemExit):
            main(["count", "--particle-files", p, "--halo-file", h, *bad])


def test_streaming_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    generate.write_uniform_particles([str(folder / f"p{i}") for i in range(3)], 500)
    halos, radii = _halos(spark), [50, 100, 200]
    query = incremental.count_files(spark, halos, str(folder), radii, "running")
    query.awaitTermination(120)
    streamed = incremental.with_zeros(halos, spark.table("running"))
    batch = shells.shell_counts(halos, binary.read_particles(spark, str(folder)), radii)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_tree(spark):
    rng = np.random.default_rng(5)
    leaves = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.uniform(0, 1000, (437, 3)))], "ordinal long, x double, y double, z double")
    levels = tiling.build_levels(leaves)
    assert [n.count() for n in levels] == tiling.level_counts(437) == [44, 5, 1]
    root = levels[-1].first()
    low = leaves.agg(*[F.min(a) for a in "xyz"]).first()
    assert (root["low_x"], root["low_y"], root["low_z"]) == tuple(low)
    assert tiling.traverse(levels).count() == 50 and tiling.node_count(437) == 487


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["range_search_pairs", "shell_count_periodic", "accumulated_batches", "shell_count_by_batch", "shell_count_exclude_coincident", "shell_count_long", "shell_count_total_rollup", "mbr_overlap_join", "range_search_ids", "shell_count_cumulative", "shell_count_nonperiodic", "shell_count_total"])
def test_nothing_that_grows_is_broadcast(spark, name):
    """Catalyst takes cells for as small as the halos' file; at 60 times sf0.1 they did not fit into the driver."""
    assert "Broadcast" not in plan_of(catalog.QUERIES[name](spark, SF))


def test_report_of_counts_without_broadcast(spark, monkeypatch):
    seen, write = [], text.write_report_files
    monkeypatch.setattr(text, "write_report_files", lambda counts, *a: (seen.append(plan_of(counts)), write(counts, *a)))
    assert sum(r["n"] for r in catalog.QUERIES["report_text"](spark, SF).collect()) == 4 * 150 + 5
    assert len(seen) == 1 and "Broadcast" not in seen[0]


def test_halos_at_one_place(spark):
    halos = spark.createDataFrame([(1, 1, 5.0, 5.0, 5.0), (2, 2, 5.0, 5.0, 5.0), (3, 3, 1.0, 5.0, 5.0), (3, 4, 5.0, 5.0, 5.0)], "halo_row long, id long, x double, y double, z double")
    particles = spark.createDataFrame([(7, 999.0, 5.0, 5.0), (8, 6.0, 5.0, 5.0)], "pid long, x double, y double, z double")
    got = sorted(map(tuple, shells.range_search(halos, particles, 3.0).collect()))
    assert got == [(1, 8), (2, 8), (3, 7), (3, 8)]
    got = sorted(map(tuple, shells.range_search(halos, particles, 6.0).collect()))
    assert got == [(1, 8), (2, 8), (3, 7), (3, 8), (3, 8)]
    got = sorted(map(tuple, shells.range_lists(halos, particles, 6.0).collect()))
    assert got == [(1, "8", 1), (2, "8", 1), (3, "7,8,8", 3)]
    assert shells.range_lists(halos, particles, -6.0).count() == 0
    got = sorted(map(tuple, shells.shell_counts(halos, particles, [3.0, 6.0]).collect()))
    assert got == [(1, 1, 1, 0), (2, 2, 1, 0), (3, 3, 2, 1), (3, 4, 2, 1)]
