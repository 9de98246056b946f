"""Physical plans and the end-to-end runs on small inputs."""

import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

import checks
from checks import testbed as T
from checks.energy import national_declarations, national_inputs
from fieldflux.plans.areas_run import areas_run
from fieldflux.plans.classification import classify
from fieldflux.plans.national import national_run
from fieldflux.scratch import scratch_dir
from fieldflux.sources import tables

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_province_filter_reaches_the_scan(spark):
    text = plan(checks.QUERIES["a01_parcel_scan"](spark, SMALL))
    assert "PushedFilters: [In(c_nationkey" in text


@pytest.mark.parametrize(
    "name", ["e01_median_composite", "d08_pixels_in_parcels", "e07_zonal_statistics", "d02_parcel_to_tile", "d10_tile_scene_match", "m04_stratified_folds"]
)
def test_plans_stay_on_the_jvm(spark, name):
    text = plan(checks.QUERIES[name](spark, SMALL))
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_composite_shuffles_once(spark):
    text = plan(checks.QUERIES["e01_median_composite"](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 1


def test_geojson(spark):
    text = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    many = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}'
    df = spark.createDataFrame([(1, text), (2, many)], "id int, geojson string")
    got = {r["id"]: r["geometry"] for r in tables.parcels_from_geojson(df).collect()}
    assert len(got[1]) == 1 and got[1][0][0][1]["x"] == 1.0 and len(got[2]) == 2


@pytest.fixture(scope="module")
def national(spark):
    inputs = national_inputs(spark, SMALL)
    return inputs, national_run(*inputs, wind=T.wind(spark, SMALL))


def test_every_parcel_has_a_declaration(spark):
    base = T.parcels(spark, SMALL).drop("parcela").withColumn("parcela", F.col("row_no").cast("int"))
    dec = national_declarations(base)
    assert dec.count() == base.count()
    assert dec.where("provincia >= 1000").count() == base.where("row_no % 10 = 0").count() > 0


def test_every_parcel_is_accounted_for(national):
    (register, *_), run = national
    row = run.coverage.first()
    assert row["n_parcels"] == register.attributes.count() == row["n_assigned"] + row["n_unassigned"]
    status = run.status.collect()
    assert {r["status"] for r in status} <= {"ok", "no_scenes", "no_hot_pixels"}
    assert sum(r["n_kept"] for r in status) == run.dated.count()
    assert all(r["n_kept"] + r["n_dropped"] == r["n_parcels"] for r in status)


def test_dated_statistics_are_plausible(national):
    _, run = national
    assert run.dated.count() > 0
    bad = run.dated.where("EF_mean < 0 OR EF_mean > 1 OR LE_mean < 0 OR LE_pixcount <= 3 OR Uref IS NULL OR isnan(ET24h_mean)")
    assert bad.count() == 0
    assert run.parcels.where("irrigated_label IS NULL").count() == 0
    assert run.parcels.count() == run.dated.select("parcel_uid").distinct().count()


def test_areas_are_clipped_and_written(spark, national):
    register, catalog, obs, dem, dates = national[0]
    # Two of the tiles as free-standing areas: boxes a little smaller than the tile.
    boxes = register.tiles.join(obs.select("tile_id").distinct(), "tile_id").orderBy("tile_id").limit(2)
    ring = lambda *p: F.array(F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in p])))
    w, s, e, n = (F.col(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max"))
    areas = boxes.select("tile_id", ring((w, s), (e, s), (e, n), (w, n), (w, s)).alias("geometry"))
    out = f"{scratch_dir(spark)}/areas-test"
    run = areas_run(areas, catalog, obs, dem, dates, output=out)
    back = spark.read.parquet(out)
    assert back.count() == run.energy.pixels.count() > 0
    assert dict(back.dtypes)["LE"] == "float" and "epsg" in back.columns


def test_classifiers_beat_the_majority(spark):
    df = spark.range(400).select(
        F.col("id").alias("uid"),
        (F.col("id") % 2).cast("int").alias("irrigated_label"),
        F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("parc_producto"),
        ((F.col("id") % 2) + F.rand(1)).alias("LE_mean_mean"),
        F.rand(2).alias("LE_mean_std"),
    )
    small = {"n_estimators": 20, "max_depth": 4, "min_samples_leaf": 2, "max_features": "sqrt"}
    result, summary = classify(df, "uid", ("ET+crop",), small, force_cv=False)["ET+crop"]
    rows = {r["model"]: r for r in result.summary.collect()}
    assert set(rows) == {"LogisticRegression", "RandomForest", "GBDT"}
    assert all(r["balanced_accuracy"] > 0.8 for r in rows.values())
    assert result.predictions.where("proba < 0 OR proba > 1").count() == 0
    assert result.importances[0][0] == "LE_mean_mean"
    assert result.sweep.count() == 15 and result.confusion.count() == 6


@pytest.mark.parametrize("name", ["m09_fit_and_score", "a12_model_and_prediction_sink", "m10_random_search", "m16_cross_validation"])
def test_queries_fit_all_models(spark, monkeypatch, name):
    """The names and candidates that reach the library; fits are those of a fast model."""
    from checks import learning
    from fieldflux.operators import models

    rows = [(i, i % 2, DenseVector([float(i % 2) + i % 7, float(i % 5)]), "test" if i % 5 == 0 else "train") for i in range(60)]
    data = spark.createDataFrame(rows, ["l_partkey", "irrigated_label", "features", "split"])
    monkeypatch.setattr(learning, "encoded", lambda *a: data)
    fit, seen = models.fit_and_score, []
    monkeypatch.setattr(models, "fit_and_score", lambda n, *a, **b: (seen.append(n), fit("LogisticRegression", *a, **b))[1])
    monkeypatch.setattr(models, "search_forest", lambda d, u, c: (seen.extend(map(str, c)), d)[1])
    out = checks.QUERIES[name](spark, SMALL)
    if name.startswith("m10"):
        assert len(set(seen)) == len(seen) == 40
    else:
        assert set(seen) == set(models.MODELS) == {r["model"] for r in out.select("model").distinct().collect()}
