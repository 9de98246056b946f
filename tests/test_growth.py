"""Plans on tables that grow: no step may gather what grows with the input in one place."""

import pytest
from pyspark.sql import functions as F

import checks
from fieldflux.operators import terrain

PATH = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark, n):
    """A tile of n x n cells, which Spark takes for a table of one row."""
    g = spark.range(1).select(F.col("id").cast("int").alias("tile_id"))
    for c in ("y", "x"):
        g = g.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return g.withColumn("dem", (F.col("y") * n + F.col("x")).cast("double"))


def test_generated_elevation_is_not_broadcast(spark):
    """F1."""
    out = terrain.resample_nearest(grid(spark, 8).drop("dem"), grid(spark, 4))
    assert "BroadcastExchange" not in plan(out)
    assert {(r.y, r.x): r.dem for r in out.collect()} == {(y, x): float(y // 2 * 4 + x // 2) for y in range(8) for x in range(8)}


def test_generated_item_cells_are_not_broadcast(spark):
    """F4."""
    out = checks.QUERIES["d09_elevation_on_any_grid"](spark, PATH)
    assert "SortMergeJoin [item_id" in plan(out)


def test_memberships_and_parcels_are_not_broadcast(spark):
    """F2, F3, F6, F7, F8: only the scenes, which are counted before, reach every task."""
    text = plan(checks.QUERIES["e07_zonal_statistics"](spark, PATH))
    assert "SortMergeJoin [tile_id" in text
    assert text.count("BroadcastExchange") == 1 and "BuildLeft" not in text


def boxes(spark, rows, columns):
    return spark.createDataFrame(rows, f"{columns}, lon_min double, lat_min double, lon_max double, lat_max double")


@pytest.fixture(scope="module")
def catalog(spark):
    """Tiles of three boxes, one tile with two of them and one with a missing side; scenes of three boxes."""
    a, b, far = (0.0, 0.0, 0.5, 0.5), (0.9, 0.9, 1.4, 1.4), (50.0, 0.0, 50.5, 0.5)
    tiles = [(1, *a), (2, *a), (3, *b), (4, *far), (5, *a), (5, *b), (6, None, 0.0, 0.5, 0.5)]
    wide, low, high = (-2.0, -2.0, 2.5, 2.5), (0.4, 0.4, 0.6, 0.6), (1.4, 1.4, 3.0, 3.0)
    items = [(10, "2024-01-01", *wide), (11, "2024-01-02", *wide), (12, "2024-01-02", *low), (13, "2024-01-03", *high), (14, "2024-01-03", *high)]
    return boxes(spark, tiles, "tile_id int"), boxes(spark, items, "item_id int, datetime string")


def test_boxes_that_recur_are_met_once(spark, catalog):
    """the same as pair by pair, also for a tile with two boxes."""
    from fieldflux.operators import scenes

    tiles, items = catalog
    at_a, at_b = {10, 11, 12}, {10, 11, 13, 14}
    got = scenes.match_tiles(tiles, items)
    assert got.columns == ["tile_id", *items.columns]
    pairs = sorted((r.tile_id, r.item_id) for r in got.collect())
    assert pairs == sorted([(t, i) for t in (1, 2, 5) for i in at_a] + [(t, i) for t in (3, 5) for i in at_b])
    days = {1: [1, 2], 2: [1, 2], 3: [1, 2, 3], 5: [1, 2, 3]}
    named = {t: ",".join(f"2024-01-0{n}" for n in d) for t, d in days.items()}
    assert sorted((r.tile_id, r.n_scenes) for r in scenes.scenes_of_tiles(tiles, items).collect()) == [(1, 3), (2, 3), (3, 4), (5, 7)]
    dated = sorted((r.tile_id, str(r.date)) for r in scenes.dates_of_tiles(tiles, items).collect())
    assert dated == [(t, day) for t, text in named.items() for day in text.split(",")]
    assert sorted((r.tile_id, r.dates) for r in scenes.date_lists(tiles, items).collect()) == sorted(named.items())
    # All pairs of boxes, once each: three boxes of tiles, three of scenes.
    assert scenes._by_box(tiles, items)[2].count() == 4


def test_gradient_deals_tiles_by_line(spark):
    """cells that lie by tile, as after a distinct, are not sorted in the tile's task."""
    one = grid(spark, 8).repartition(4, "tile_id")
    assert "hashpartitioning(tile_id" in plan(one)
    text = " ".join(plan(terrain.gradient(one)).replace("#", " ").split())
    assert "REPARTITION_BY_COL" in text
    got = {(r.y, r.x): (r.dzdx, r.dzdy) for r in terrain.gradient(one).collect()}
    assert len(got) == 64 and {v for v in got.values()} == {(1 / 30, 8 / 30)}


def test_declarations_of_repeated_keys_fill_every_partition(spark):
    """the tasks of the join are not sized by its inputs."""
    from fieldflux.constants import PARCEL_KEY
    from fieldflux.operators import parcels

    rows = spark.range(4000).select(*[(F.col("id") % 400).cast("int").alias(k) for k in PARCEL_KEY], F.lit(0).alias("source"), "id")
    out = parcels.join_declarations(rows, rows.select(*PARCEL_KEY, "source", F.col("id").alias("crop")))
    out = out.select("id", "crop").cache()
    assert out.count() == 400 * 100
    used = out.select(F.spark_partition_id().alias("p")).distinct().count()
    out.unpersist()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_groups_are_listed_in_one_pass(spark):
    """a scene of few pixels is neither sketched nor counted value by value; ranks are the same beside a large group."""
    from fieldflux.operators.quantiles import Rank, order_statistics

    rows = [(g, None if i % 7 == 0 else float((i * 37 + g) % 101)) for g in range(5) for i in range(1 + 9 * g)] + [(5, None), (None, 1.0)]
    small = spark.createDataFrame(rows, "g int, v double")
    v = F.col("v")
    ranks = [Rank("a", v, 0.05), Rank("b", v, 0.95), Rank("c", F.when(v > 50, v), 0.5)]

    def want(values, q):
        s = sorted(values)
        return s[round(q * (len(s) - 1))] if s else None

    def check(got):
        assert [r.g for r in got] == sorted({g for g, _ in rows if g is not None})
        for r in got:
            known = [x for g, x in rows if g == r.g and x is not None]
            assert (r.a, r.b, r.c) == (want(known, 0.05), want(known, 0.95), want([x for x in known if x > 50], 0.5))

    out = order_statistics(small, ["g"], ranks)
    assert "percentile_approx" not in plan(out) and "Window" not in plan(out)
    check(out.orderBy("g").collect())
    large = spark.range(6000).select(F.lit(9).alias("g"), F.col("id").cast("double").alias("v"))
    *few, many = order_statistics(small.unionByName(large), ["g"], ranks).orderBy("g").collect()
    check(few)
    assert (many.g, many.a, many.b, many.c) == (9, 300.0, 5699.0, 3025.0)


def test_composite_of_few_is_the_median(spark):
    """pixels seen once or twice on a date need no list; the others, also with missing keys, get the same medians."""
    from fieldflux.operators import composite
    from fieldflux.scratch import materialize

    bands, scene = ["red", "nir08"], ["tile_id", "date"]
    value = lambda i: None if i % 5 == 0 else float("nan") if i % 11 == 0 else i % 13 / 8 - 0.5
    rows = [(0, d, y, x, value(17 * i + x), value(23 * i + d)) for d in (1, 2) for y in (0, None) for x in range(12) for i in range(1 + (x + d) % 5)]
    obs = spark.createDataFrame(rows, "tile_id int, date int, y int, x int, red double, nir08 double")
    first = composite.composite_of_few(obs, scene, bands)
    assert "collect_list" not in plan(first)
    pixels = materialize(first.withColumn("dem", F.col("x") * 2), "pixels")
    got = composite.with_crowded(pixels, obs, scene, bands)
    want = composite.median_composite(obs, scene, bands).withColumn("dem", F.col("x") * 2)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    few = materialize(first.where("_seen <= 2"), "pixels")
    assert composite.with_crowded(few, obs, scene, bands).count() == few.count() > 0


def test_sweep_is_compiled_as_a_whole(spark):
    """no method of the balance is too large for whole-stage code, so that its projections are not run one by one."""
    from checks import energy as E
    from fieldflux.session import tune

    tune(spark)
    pixels = E.run(spark, PATH).pixels
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(pixels.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    largest = max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size()))
    assert 0 < largest <= int(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
