"""Operators against brute force on small inputs, and the missing-data rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldflux.functions import clock, nulls, projections, stability
from fieldflux.operators import composite, features, geometry, grid, metrics, quantiles, rasterize, splits, terrain, zonal


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


# --- missing data --------------------------------------------------------------------


def test_null_rules(spark):
    nan, inf, none = F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double")
    assert one(spark, nulls.finite(nan)) is None and one(spark, nulls.finite(inf)) is None
    assert one(spark, nulls.divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, nulls.log(F.lit(-1.0))) is None and one(spark, nulls.log(F.lit(0.0))) is None
    assert one(spark, nulls.power(F.lit(-2.0), 0.25)) is None
    assert one(spark, nulls.power(F.lit(-2.0), 3)) == -8.0
    assert one(spark, nulls.clip(none, 0.0, 1.0)) is None
    assert one(spark, nulls.clip(F.lit(0.5), 0.0, none)) is None
    assert one(spark, nulls.clip(F.lit(0.5), 0.0, F.lit(-3.0))) == -3.0
    assert one(spark, nulls.clip(F.lit(0.5), 2.0, 1.0)) == 1.0
    assert one(spark, nulls.clip(F.lit(0.5), 1.0)) == 1.0
    assert one(spark, nulls.clip(F.lit(1.5), hi=1.0)) == 1.0


def test_missing_length_means_no_correction(spark):
    df = spark.createDataFrame([(None,), (0.0,), (-5.0,), (5.0,)], "L double")
    rows = stability.add_stability(df).collect()
    assert rows[0]["psi_m200"] == rows[0]["psi_h2"] == rows[1]["psi_h01"] == 0.0
    x = (1 + 16 * 2 / 5.0) ** 0.25
    assert rows[2]["psi_h2"] == pytest.approx(2 * math.log((1 + x * x) / 2))
    assert rows[3]["psi_h2"] == pytest.approx(-5 * 2 / 5.0)


def test_missing_line_keeps_temperature_difference(spark):
    cols = {"LSTk_demcorr": 310.0, "rho": 1.1, "z0m": 0.01, "Uref": 3.5, "zref": 10.0, "ustar0": 0.3, "rah0": 50.0, "a1": 0.5, "b1": -150.0}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    df = df.withColumns({"a2": F.lit(None).cast("double"), "b2": F.lit(None).cast("double")})
    row = stability.run_passes(stability.start_state(df), [("a1", "b1"), ("a2", "b2")]).first()
    assert row["dT"] == pytest.approx(5.0)


# --- quantiles and composites --------------------------------------------------------


def nearest(values, q):
    v = sorted(values)
    return v[int(np.rint(q * (len(v) - 1)))]


@pytest.mark.parametrize("accuracy,step", [(10_000, None), (2000, None), (50, 1e-4), (20, 0.01)])
def test_order_statistics(spark, accuracy, step):
    """Coarse sketches with narrow brackets miss ranks: those groups are widened and right too."""
    rng = random.Random(3)
    rows = []
    for g, n in enumerate([1, 2, 20, 31, 400, 3000]):
        rows += [(g, rng.choice([rng.gauss(0, 1), 0.25])) for _ in range(n)] + [(g, None)]
    rows.append((99, None))
    df = spark.createDataFrame(rows, "g int, v double")
    ranks = [quantiles.Rank(f"q{int(q * 100)}", F.col("v"), q) for q in (0.05, 0.5, 0.8, 0.98)]
    got = {r["g"]: r for r in quantiles.order_statistics(df, ["g"], ranks, accuracy, step=step).collect()}
    assert got[99]["q50"] is None
    for g in range(6):
        values = [v for k, v in rows if k == g and v is not None]
        for r in ranks:
            assert got[g][r.name] == nearest(values, r.q)


def test_half_even_rank(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(11)], "g int, v double")
    got = quantiles.order_statistics(df, ["g"], [quantiles.Rank("q", F.col("v"), 0.05)]).first()
    assert got["q"] == 0.0  # 0.05 * 10 = 0.5 goes to the even rank 0


def test_split_groups_give_the_same_medians(spark):
    rng = random.Random(5)
    rows = [(0, d, 0, x, rng.choice([None, rng.random()]), rng.random()) for d in (1, 2) for x in range(6) for _ in range(60 if x == 2 else 4)]
    df = spark.createDataFrame(rows, "tile_id int, date int, y int, x int, red double, nir08 double")
    args = (df, ["tile_id", "date"], ["red", "nir08"])
    usual = {tuple(r) for r in composite.median_composite(*args).collect()}
    split = {tuple(r) for r in quantiles.medians(df, ["tile_id", "date", "y", "x"], ["red", "nir08"]).collect()}
    assert usual == split


def test_composite_keeps_one_list_for_a_pixel(spark):
    """Medians of any number of values, of none too, without a table of counts for each band."""
    rng = random.Random(7)
    rows = [(0, 1, 0, x, rng.choice([None, rng.random()]), rng.choice([float("nan"), -0.5, rng.random()])) for x in range(40) for _ in range(1 + x % 6)]
    df = spark.createDataFrame([*rows, (0, 1, 1, 0, None, None)], "tile_id int, date int, y int, x int, red double, nir08 double")
    keys = ["tile_id", "date", "y", "x"]
    got = composite.median_composite(df, ["tile_id", "date"], ["red", "nir08"])
    want = df.groupBy(*keys).agg(F.median("red").alias("red"), F.median("nir08").alias("nir08"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert "percentile" not in got._jdf.queryExecution().toString() and "median" not in got._jdf.queryExecution().toString()


def test_gradient_needs_the_next_cell(spark):
    cells = [(0, y, x, float(y * 10 + x * x)) for y in range(3) for x in range(5) if (y, x) != (1, 2)]
    df = spark.createDataFrame(cells, "tile_id int, y int, x int, dem double")
    g = {(r["y"], r["x"]): r for r in terrain.gradient(df, 1.0).collect()}
    assert g[(0, 0)]["dzdx"] == 1.0 and g[(0, 4)]["dzdx"] == 7.0 and g[(0, 2)]["dzdx"] == 4.0
    assert g[(1, 1)]["dzdx"] is None and g[(1, 3)]["dzdx"] is None and g[(1, 1)]["dzdy"] == 10.0


def test_missed_bracket_is_widened(spark):
    df = spark.createDataFrame([(g, float(i)) for g in range(3) for i in range(30_000)], "g int, v double").repartition(4)
    ranks = [quantiles.Rank("a", F.col("v"), 0.37), quantiles.Rank("b", F.col("v"), 0.999)]
    # An error of a tenth of the group against brackets of a ten-thousandth on each side.
    for r in quantiles.order_statistics(df, ["g"], ranks, accuracy=10, step=1e-4).collect():
        assert (r["a"], r["b"]) == (nearest(range(30_000), 0.37), nearest(range(30_000), 0.999))


def test_elevation_ends_with_the_tile(spark):
    """Cells of two pixels reach over the last line of an odd raster: its gradient is one-sided."""
    dem = spark.createDataFrame([(0, y, x, float((x + y) ** 2)) for y in range(4) for x in range(4)], "tile_id int, y int, x int, dem double")
    tiles = spark.createDataFrame([(0, 7, 7)], "tile_id int, nx int, ny int")
    cut = terrain.cut_to_tile(terrain.expand_cells(dem), tiles)
    got = {(r["y"], r["x"]): r for r in terrain.gradient(cut, 1.0).collect()}
    assert len(got) == 49 and max(got) == (6, 6)
    assert got[(0, 6)]["dzdx"] == 9.0 - 4.0 and got[(6, 0)]["dzdy"] == 9.0 - 4.0


def test_expand_cells_is_nearest(spark):
    dem = spark.createDataFrame([(0, y, x, float(y * 3 + x)) for y in range(2) for x in range(3)], "tile_id int, y int, x int, dem double")
    px = spark.createDataFrame([(0, y, x) for y in range(4) for x in range(6)], "tile_id int, y int, x int")
    a = {tuple(r) for r in terrain.expand_cells(dem).collect()}
    b = {tuple(r) for r in terrain.resample_nearest(px, dem).select("tile_id", "y", "x", "dem").collect()}
    assert a == b and len(a) == 24


# --- geometry ------------------------------------------------------------------------


def poly(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]


def inside(rings, px, py):
    hit = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > py) != (y2 > py) and (x2 - x1) * (py - y1) / (y2 - y1) + x1 > px:
                hit += 1
    return hit % 2 == 1


SHAPES = {
    1: [[(1, 1), (12, 2), (9, 13), (2, 11), (1, 1)], [(4, 4), (7, 4), (7, 8), (4, 8), (4, 4)]],
    2: [[(0.3, 0.2), (14.7, 6.1), (3.2, 14.4), (0.3, 0.2)]],
    3: [[(-5, 3.1), (30, 3.1), (30, 5.2), (-5, 5.2), (-5, 3.1)]],
    4: [[(8.2, 8.2), (8.4, 8.2), (8.4, 8.4), (8.2, 8.4), (8.2, 8.2)]],
}


def edges_of(spark, shapes):
    df = spark.createDataFrame([(k, poly(*v)) for k, v in shapes.items()], f"id int, geometry {geometry.GEOMETRY_TYPE}")
    return geometry.explode_edges(geometry.explode_parts(df, ["id"]), ["id"])


def test_scanline_against_point_in_polygon(spark):
    got = {tuple(r) for r in rasterize.pixels_of(edges_of(spark, SHAPES), ["id"], 16, 16).collect()}
    want = {(k, y, x) for k, rings in SHAPES.items() for y in range(16) for x in range(16) if inside(rings, x + 0.5, y + 0.5)}
    assert got == want


def test_all_touched_covers_dense_samples(spark):
    got = {tuple(r) for r in rasterize.pixels_of(edges_of(spark, SHAPES), ["id"], 16, 16, all_touched=True).collect()}
    for k, rings in SHAPES.items():
        for x1, y1, x2, y2 in [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:])]:
            for i in range(1, 400):
                px, py = x1 + (x2 - x1) * i / 400, y1 + (y2 - y1) * i / 400
                if 0 <= px < 16 and 0 <= py < 16:
                    assert (k, math.floor(py), math.floor(px)) in got
    assert (4, 8, 8) in got


def test_overlapping_parts_count_once(spark):
    a, b = SHAPES[1][:1], SHAPES[2]
    df = spark.createDataFrame([(1, poly(*a)), (1, poly(*b)), (1, poly(*b))], f"id int, geometry {geometry.GEOMETRY_TYPE}")
    parts = df.select("id", F.explode("geometry").alias("rings")).distinct().withColumn("part", F.xxhash64("rings"))
    got = [tuple(r) for r in rasterize.pixels_of(geometry.explode_edges(parts, ["id"]), ["id"], 16, 16).collect()]
    want = {(1, y, x) for y in range(16) for x in range(16) if inside(a, x + 0.5, y + 0.5) or inside(b, x + 0.5, y + 0.5)}
    assert len(got) == len(set(got)) and set(got) == want


def test_centroid_with_hole(spark):
    c = {r["id"]: r for r in geometry.centroid(edges_of(spark, {1: [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]]}), ["id"]).collect()}
    assert c[1]["area"] == pytest.approx(12.0)
    assert (c[1]["cx"], c[1]["cy"]) == pytest.approx((5 / 3, 5 / 3))


def test_projection_control_points(spark):
    rows = [(float(6 * z - 183 + dx), float(lat), z) for z in range(27, 33) for dx in (-3, 0, 2.9) for lat in (0, 28.5, 40, 63)]
    df = spark.createDataFrame(rows, "lon double, lat double, zone int")
    df = projections.from_utm(projections.to_utm(df, "lon", "lat", "zone", "x", "y"), "x", "y", "zone", "lo", "la")
    df = projections.from_laea(projections.to_laea(df, "lon", "lat", "ex", "ey"), "ex", "ey", "elo", "ela")
    for r in df.collect():
        assert (r["lo"], r["la"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)
        assert (r["elo"], r["ela"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-6)
        if r["lon"] == 6 * r["zone"] - 183:
            assert r["x"] == pytest.approx(500000.0)
            if r["lat"] == 40.0:
                assert r["y"] == pytest.approx(4427757.22, abs=0.01)
    p = spark.createDataFrame([(5.0, 50.0)], "lon double, lat double")
    e = projections.to_laea(p, "lon", "lat", "x", "y").first()
    assert (e["x"], e["y"]) == pytest.approx((3962799.45, 2999718.85), abs=0.01)


def test_zone_wrap_and_southern_failure(spark):
    df = spark.createDataFrame([(180.0,), (-180.0,), (190.0,), (-3.0,)], "lon double")
    got = [r["z"] for r in df.select(projections.utm_zone(F.col("lon")).alias("z")).collect()]
    assert got == [1, 1, 2, 30]
    assert one(spark, projections.utm_epsg(F.lit(-3.0), F.lit(40.0))) == 25830
    assert one(spark, projections.utm_epsg(F.lit(-120.0), F.lit(40.0))) == 32611
    with pytest.raises(Exception, match="southern hemisphere"):
        one(spark, projections.utm_epsg(F.lit(-3.0), F.lit(-1.0)))


def test_points_on_a_tile_edge_match_no_tile(spark):
    box = spark.createDataFrame([(25830, 30, 500000.0, 4400000.0, 600000.0, 4500000.0)], "epsg int, zone int, minx double, miny double, maxx double, maxy double")
    pts = spark.createDataFrame([(1, -3.0, 40.0), (2, -2.9, 40.0)], "parcel_uid int, lon double, lat double")
    got = grid.candidate_tiles(pts, box, ["parcel_uid"]).collect()
    assert [(r["parcel_uid"], r["tile_id"]) for r in got] == [(2, "25830_0")]


def test_midpoint_in_local_time_and_day_length(spark):
    text = F.lit("2025-07-01/2025-07-31")
    got = one(spark, clock.range_midpoint(text, F.lit("Europe/Madrid")))
    assert str(got) == "2025-07-15 22:00:00"
    equinox = one(spark, clock.day_length(F.lit("2025-03-21").cast("timestamp_ntz"), F.lit(40.0)))
    assert 43200 < equinox < 44400
    assert one(spark, clock.day_length(F.lit("2025-06-21").cast("timestamp_ntz"), F.lit(80.0))) == 86400.0


# --- statistics, splits, metrics -----------------------------------------------------


def test_zonal_keeps_more_than_the_minimum(spark):
    df = spark.createDataFrame([(1, 4, 9), (2, 3, 9), (3, 9, 4), (4, 9, 0)], "id int, a_pixcount int, b_pixcount int")
    assert sorted(r["id"] for r in df.where(zonal.enough_pixels(["a", "b"])).collect()) == [1, 3]


def test_single_date_parcel_is_dropped(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "uid int, LE_mean double")
    rows = features.complete_rows(features.trajectory(df, ["uid"])).collect()
    assert [(r["uid"], r["LE_mean_mean"], r["LE_mean_std"]) for r in rows] == [(1, 2.0, pytest.approx(math.sqrt(2)))]


def test_splits_are_exact_and_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1000)], "uid int, irrigated_label int")
    got = splits.holdout(df, "uid").groupBy("irrigated_label", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, "test"): 66, (1, "train"): 268, (0, "test"): 133, (0, "train"): 533}
    f = splits.folds(df, "uid").groupBy("irrigated_label", "fold").count().collect()
    assert all(abs(r["count"] - (334 if r["irrigated_label"] else 666) / 5) < 1 for r in f)


@pytest.mark.parametrize("buckets", [2, 7, 512])
def test_auc_counts_pairs(spark, buckets):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), round(rng.random(), 1 if i % 2 else 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "label int, proba double").withColumn("m", F.lit("x"))
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.auc(df, ["m"], buckets).first()["AUC"] == pytest.approx(want)


def test_sweep_recall_never_rises(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randint(0, 1), rng.random()) for _ in range(200)], "label int, proba double").withColumn("m", F.lit(1))
    recall = [r["recall_irrigated"] for r in metrics.threshold_sweep(df, ["m"]).orderBy("threshold").collect()]
    assert recall == sorted(recall, reverse=True)


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, proba double").withColumn("m", F.lit(1))
    r = metrics.all_metrics(df, ["m"]).first()
    assert r["accuracy"] == 1.0 and r["F1"] == 0.0 and r["AUC"] is None


def test_feature_csv_is_read_by_name(spark):
    """Columns in the run's order, a second batch in another order without parcel_uid."""
    from fieldflux.scratch import scratch_dir
    from fieldflux.sources import sinks, tables

    names = [f.split()[0] for f in tables.SCHEMAS["features"].split(", ")]
    types = dict(f.split() for f in tables.SCHEMAS["features"].split(", "))
    values = {n: {"int": i, "double": i + 0.5, "string": f"s{i}"}[types[n]] for i, n in enumerate(names)}
    df = spark.createDataFrame([tuple(values.values())], tables.SCHEMAS["features"])
    folder = f"{scratch_dir(spark)}/features-{random.randrange(1 << 60)}"
    one = sinks.write_table(df.select(F.lit("7_1").alias("parcel_uid"), *names), f"{folder}/a", "x")
    two = sinks.write_table(df.select(*reversed(names[1:])), f"{folder}/b")
    rows = {r["parcel_uid"]: r.asDict() for r in tables.feature_csv(spark, one, two).collect()}
    assert rows["7_1"] == {"parcel_uid": "7_1", **values}
    assert rows[None] == {"parcel_uid": None, **values, names[0]: None}


def test_status_keeps_parcels_of_tiles_without_scenes(spark):
    from fieldflux.operators.scenes import scene_status

    expected = spark.createDataFrame([("a", "d1"), ("b", None)], "tile_id string, date string")
    counts = spark.createDataFrame([("a", "d1", 5, 4), ("b", None, 7, None)], "tile_id string, date string, n_parcels long, n_kept long")
    scalars = spark.createDataFrame([("a", "d1", 0.5)], "tile_id string, date string, a_1 double")
    got = {r["tile_id"]: tuple(r)[2:] for r in scene_status(expected, counts, scalars, ["tile_id", "date"]).collect()}
    assert got == {"a": ("ok", 5, 4, 1), "b": ("no_scenes", 7, 0, 7)}
