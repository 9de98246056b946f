"""Feature tables, splits, weights, metrics and models."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldflux.operators import features, metrics, models, splits
from fieldflux.scratch import materialize, scratch_dir
from fieldflux.sources import sinks, tables

from . import testbed as T
from .energy import materialize_path
from .registry import CTES, check, rnd, rounded

UID = "l_partkey"
LABEL = "irrigated_label"
FEATS = [f"{v}_mean_{s}" for v in T.STAT_VARS for s in ("mean", "std")]


# --- feature tables ------------------------------------------------------------------


@check("b06_columns_by_suffix", f"SELECT l_partkey, yr, {rounded([f'{v}_mean' for v in T.STAT_VARS])} FROM dated")
def b06(spark, d):
    df = T.dated(spark, d)
    return rnd(df, [UID, "yr"], features.columns_ending(df, "_mean"))


@check("e08_trajectory", f"SELECT l_partkey, {rounded(FEATS)} FROM traj")
def e08(spark, d):
    return rnd(features.trajectory(T.dated(spark, d), [UID]), [UID], FEATS)


_KEPT = "l_partkey % 3 <> 0 OR yr = 1997"
_SPARSE = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {_KEPT} THEN {v}_mean END AS {v}_mean" for v in T.STAT_VARS) + ") FROM dated"
_SOME = ", ".join(f"avg({v}_mean) AS {v}_mean_mean, stddev_samp({v}_mean) AS {v}_mean_std" for v in T.STAT_VARS)
CTES["sparse"] = f"SELECT l_partkey, {_SOME} FROM ({_SPARSE}) GROUP BY l_partkey"


@check(
    "b05_drop_incomplete",
    f"SELECT l_partkey, {rounded(FEATS)} FROM sparse WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATS),
)
def b05(spark, d):
    """Parts with a value in one year have no deviation and are dropped."""
    means = {f"{v}_mean": F.when(F.expr(_KEPT), F.col(f"{v}_mean")) for v in T.STAT_VARS}
    thin = T.dated(spark, d).withColumns(means)
    return rnd(features.complete_rows(features.trajectory(thin, [UID])), [UID], FEATS)


@check(
    "b14_feature_sets",
    f"""SELECT l_partkey, 'ET-only' AS feature_set, {rounded(FEATS)}, NULL AS parc_producto FROM feats
      UNION ALL SELECT l_partkey, 'ET+crop', {', '.join(f'round({c}, 6) + 0.0' for c in FEATS)}, parc_producto FROM feats""",
)
def b14(spark, d):
    df = T.features(spark, d)
    sets = features.feature_sets(df)
    out = None
    for name, cols in sets.items():
        crop = F.col("parc_producto") if "parc_producto" in cols else F.lit(None).cast("string")
        part = df.select(
            UID, F.lit(name).alias("feature_set"), *[F.round(c, 6).alias(c) for c in FEATS], crop.alias("parc_producto")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _csv(spark, df, label=""):
    path = f"{materialize_path(spark)}/table"
    return sinks.write_table(df, path, label)


@check("a09_dated_table_sink", f"SELECT l_partkey, yr, {rounded(['qty_mean', 'qty_std'])}, qty_pixcount FROM dated")
def a09(spark, d):
    df = rnd(T.dated(spark, d), [UID, "yr", "qty_pixcount"], ["qty_mean", "qty_std"])
    path = _csv(spark, df.where("qty_mean IS NOT NULL"), "batch_1")
    schema = "l_partkey bigint, yr int, qty_pixcount bigint, qty_mean double, qty_std double"
    return spark.read.schema(schema).csv(path, header=True)


@check("a10_parcel_table_sink", f"SELECT l_partkey, {rounded(FEATS)}, irrigated_label, parc_producto FROM feats")
def a10(spark, d):
    df = rnd(T.features(spark, d), [UID, LABEL, "parc_producto"], FEATS)
    path = _csv(spark, df)
    fields = ", ".join(f"{c} double" for c in FEATS)
    return spark.read.schema(f"l_partkey bigint, {LABEL} int, parc_producto string, {fields}").csv(path, header=True)


@check("a11_feature_table_scan", f"SELECT l_partkey, {rounded(FEATS[:2])} FROM traj")
def a11(spark, d):
    """The feature table read back with its declared schema."""
    names = {f: f.replace("qty", "NDVI") for f in FEATS[:2]}
    df = features.trajectory(T.dated(spark, d), [UID])
    full = df.select(
        *[
            (F.col(UID) if f == "provincia" else F.lit(None)).cast(t).alias(f)
            if f not in names.values()
            else F.col({v: k for k, v in names.items()}[f]).alias(f)
            for f, t in (p.split() for p in tables.SCHEMAS["features"].split(", "))
        ]
    )
    back = tables.feature_csv(spark, _csv(spark, full))
    return back.select(
        F.col("provincia").cast("bigint").alias(UID), *[F.round(v, 6).alias(k) for k, v in names.items()]
    )


@check("a13_merge_batches", f"SELECT l_partkey, yr, {rounded(['disc_mean', 'tax_mean'])} FROM dated")
def a13(spark, d):
    """Two labelled batches read back together as one table."""
    df = rnd(T.dated(spark, d), [UID, "yr"], ["disc_mean", "tax_mean"])
    base = f"{materialize_path(spark)}/table"
    paths = [sinks.write_table(df.where(f"l_partkey % 2 = {i}"), base, f"batch_{i}", "parquet") for i in (0, 1)]
    return spark.read.schema(df.schema).parquet(*paths)


# --- splits and weights --------------------------------------------------------------

CTES["ranked"] = """SELECT f.*, row_number() OVER (PARTITION BY irrigated_label ORDER BY md5(l_partkey || '|42'), l_partkey) - 1 AS hash_rank,
  count(*) OVER (PARTITION BY irrigated_label) AS n_class FROM feats f"""
CTES["splitted"] = "SELECT *, CASE WHEN hash_rank < floor(0.2 * n_class) THEN 'test' ELSE 'train' END AS split FROM ranked"


@check("m01_crop_one_hot", "SELECT l_partkey, 'crop_' || coalesce(parc_producto, 'None') AS level FROM feats")
def m01(spark, d):
    return features.crop_indicators(T.features(spark, d), UID, "parc_producto")


@check(
    "m02_balanced_weights",
    """SELECT irrigated_label, count(*) AS n_class, round((SELECT count(*) FROM feats) / (2.0 * count(*)), 6) AS weight FROM feats GROUP BY irrigated_label""",
)
def m02(spark, d):
    return rnd(splits.balanced_weights(T.features(spark, d)), [LABEL, "n_class"], ["weight"])


@check("m03_stratified_holdout", "SELECT l_partkey, irrigated_label, split FROM splitted")
def m03(spark, d):
    return splits.holdout(T.features(spark, d), UID).select(UID, LABEL, "split")


@check("m04_stratified_folds", "SELECT l_partkey, irrigated_label, CAST(hash_rank % 5 AS INTEGER) AS fold FROM ranked")
def m04(spark, d):
    return splits.folds(T.features(spark, d), UID).select(UID, LABEL, "fold")


_STD = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM splitted WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM splitted WHERE split = 'train'), 6) + 0.0 AS {c}"
    for c in FEATS
)


@check("m05_standard_scaling", f"SELECT l_partkey, {_STD} FROM splitted")
def m05(spark, d):
    df = splits.holdout(T.features(spark, d), UID)
    return rnd(splits.standardize(df, df.where("split = 'train'"), FEATS), [UID], FEATS)


# --- metrics -------------------------------------------------------------------------

_R = """tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r1, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS r0,
  (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS acc"""
CTES["auc"] = """SELECT model, sum(r) FILTER (label = 1) AS ranks, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM (
  SELECT *, avg(rn) OVER (PARTITION BY model, proba) AS r FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY proba) AS rn FROM scores))
  GROUP BY model"""


@check(
    "m11_metrics",
    f"""SELECT model, round(acc, 6) AS accuracy, round(1.0 - acc, 6) AS misclass_rate, round((r1 + r0) / 2, 6) AS balanced_accuracy,
      round(2.0 * tp / (2.0 * tp + fp + fn), 6) AS F1, round((ranks - p * (p + 1) / 2.0) / (p * n), 6) AS AUC
      FROM (SELECT *, {_R} FROM confm) JOIN auc USING (model)""",
)
def m11(spark, d):
    m = metrics.all_metrics(T.scores(spark, d), ["model"])
    return rnd(m, ["model"], ["accuracy", "misclass_rate", "balanced_accuracy", "F1", "AUC"])


@check("m12_auc", "SELECT model, round((ranks - p * (p + 1) / 2.0) / (p * n), 6) AS AUC FROM auc")
def m12(spark, d):
    return rnd(metrics.auc(T.scores(spark, d), ["model"]), ["model"], ["AUC"])


@check(
    "m13_confusion_matrix",
    "SELECT model, 0 AS label, tn AS pred_0, fp AS pred_1 FROM confm UNION ALL SELECT model, 1, fn, tp FROM confm",
)
def m13(spark, d):
    return metrics.confusion(T.scores(spark, d), ["model"])


CTES["cuts"] = "SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS threshold"
CTES["sweep"] = f"""SELECT *, {_R} FROM (SELECT model, threshold, count(*) FILTER (label = 1 AND proba >= threshold) AS tp,
  count(*) FILTER (label = 0 AND proba >= threshold) AS fp, count(*) FILTER (label = 1 AND proba < threshold) AS fn,
  count(*) FILTER (label = 0 AND proba < threshold) AS tn FROM scores CROSS JOIN cuts GROUP BY model, threshold)"""


@check(
    "m14_threshold_sweep",
    """SELECT model, threshold, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 3) AS precision_irrigated,
      round(r1, 3) AS recall_irrigated, round((r1 + r0) / 2, 3) AS balanced_accuracy, round(acc, 3) AS accuracy,
      round(1.0 - acc, 3) AS misclass_rate FROM sweep""",
)
def m14(spark, d):
    return metrics.threshold_sweep(T.scores(spark, d), ["model"])


@check(
    "g06_threshold_table",
    "SELECT model, uid, threshold, CAST(proba >= threshold AS INTEGER) AS prediction FROM scores CROSS JOIN cuts",
)
def g06(spark, d):
    from fieldflux.constants import THRESHOLDS

    t = F.explode(F.array(*[F.lit(x) for x in THRESHOLDS])).alias("threshold")
    wide = T.scores(spark, d).select("model", "uid", "proba", t)
    return wide.select("model", "uid", "threshold", (F.col("proba") >= F.col("threshold")).cast("int").alias("prediction"))


CTES["f1split"] = """SELECT model, CASE WHEN uid % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  2.0 * count(*) FILTER (label = 1 AND prediction = 1) / (2.0 * count(*) FILTER (label = 1 AND prediction = 1)
    + count(*) FILTER (label <> prediction)) AS f1 FROM scores GROUP BY ALL"""


@check(
    "m15_overfit_trigger",
    """SELECT model, round(a, 6) AS train_F1, round(b, 6) AS test_F1, round(a - b, 6) + 0.0 AS gap, a - b > 0.02 AS run_cv FROM (
      SELECT model, max(f1) FILTER (split = 'train') AS a, max(f1) FILTER (split = 'test') AS b FROM f1split GROUP BY model)""",
)
def m15(spark, d):
    s = T.scores(spark, d).withColumn("split", F.when(F.col("uid") % 5 == 0, "test").otherwise("train"))
    gap = metrics.overfit_gap(metrics.classification_metrics(s, ["model", "split"]), ["model"], 0.02)
    return rnd(gap, ["model", "run_cv"], ["train_F1", "test_F1", "gap"])


CTES["foldf1"] = """SELECT model, uid % 5 AS fold, 2.0 * count(*) FILTER (label = 1 AND prediction = 1)
  / (2.0 * count(*) FILTER (label = 1 AND prediction = 1) + count(*) FILTER (label <> prediction)) AS f1,
  count(*) FILTER (label = prediction) / CAST(count(*) AS DOUBLE) AS acc FROM scores GROUP BY ALL"""


@check(
    "m16_fold_summary",
    """SELECT model, printf('%.3f±%.3f', avg(f1), stddev_pop(f1)) AS F1, printf('%.3f±%.3f', avg(acc), stddev_pop(acc)) AS accuracy
      FROM foldf1 GROUP BY model""",
)
def m16_summary(spark, d):
    s = T.scores(spark, d).withColumn("fold", F.col("uid") % 5)
    return metrics.fold_summary(metrics.classification_metrics(s, ["model", "fold"]), ["model"], ["F1", "accuracy"])


@check(
    "f06_best_candidate",
    """SELECT candidate, depth, round(mean_score, 6) AS mean_score FROM (
      SELECT candidate, depth, avg(f1) AS mean_score FROM (
        SELECT l_suppkey % 40 AS candidate, 'd' || (l_suppkey % 4) AS depth, l_linenumber AS fold, round(avg(l_discount), 9) AS f1
        FROM lineitem GROUP BY ALL) GROUP BY candidate, depth) ORDER BY mean_score DESC, candidate LIMIT 1""",
)
def f06(spark, d):
    s = T.read(spark, d, "lineitem").groupBy(
        (F.col("l_suppkey") % 40).alias("candidate"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 4).cast("string")).alias("depth"),
        F.col("l_linenumber").alias("fold"),
    ).agg(F.round(F.avg("l_discount"), 9).alias("f1"))
    return rnd(metrics.best_candidate(s, ["depth"]), ["candidate", "depth"], ["mean_score"])


# --- models --------------------------------------------------------------------------


def encoded(spark, d, with_crop=True):
    df = features.complete_rows(T.features(spark, d))
    cols = features.feature_sets(df)["ET+crop" if with_crop else "ET-only"]
    enc = models.encoder(df, cols, "parc_producto")
    return splits.holdout(materialize(enc.transform(df).select(UID, LABEL, "features"), "encoded"), UID)


def _fit(name, spark, d, crop=True):
    data = materialize(encoded(spark, d, crop), "split")
    return models.fit_and_score(name, data.where("split = 'train'"), data, [UID, "split"])


def _scored(name, data):
    model, preds = models.fit_and_score(name, data.where("split = 'train'"), data, [UID, "split"])
    return model, preds.withColumn("model", F.lit(name))


@check("m06_logistic_regression")
def m06(spark, d):
    return _fit("LogisticRegression", spark, d)[1]


@check("m07_random_forest")
def m07(spark, d):
    return _fit("RandomForest", spark, d)[1]


@check("m08_gradient_boosting")
def m08(spark, d):
    return _fit("GBDT", spark, d)[1]


@check("m09_fit_and_score")
def m09(spark, d):
    """Train and test metrics of the three scored models on the satellite features."""
    data = materialize(encoded(spark, d, False), "split")
    parts = models.at_once(lambda name: _scored(name, data)[1], [(name,) for name in models.MODELS])
    return metrics.all_metrics(materialize(reduce(DataFrame.unionByName, parts), "scored"), ["model", "split"])


@check("m10_random_search")
def m10(spark, d):
    """Scores of all sampled forests on five folds."""
    data = encoded(spark, d, False).drop("split")
    return models.search_forest(data, UID, models.sample_candidates())


@check("m16_cross_validation")
def m16(spark, d):
    data = encoded(spark, d, False).drop("split")
    m = models.cross_validate(data, models.MODELS, UID)
    return metrics.fold_summary(m, ["model"], ["accuracy", "misclass_rate", "balanced_accuracy", "AUC", "F1"])


@check("m17_holdout_evaluation")
def m17(spark, d):
    from fieldflux.plans.classification import holdout_evaluation

    return holdout_evaluation(encoded(spark, d), UID, "ET+crop").summary


@check("f05_feature_importances")
def f05(spark, d):
    """Ten most important inputs of the boosted trees, as a report."""
    data = materialize(encoded(spark, d), "split")
    names = models.vector_names(data)
    model, _ = models.fit_and_score("GBDT", data.where("split = 'train'"), data, [UID])
    return spark.createDataFrame(models.importances(model, names), "feature string, importance double")


@check("a12_model_and_prediction_sink")
def a12(spark, d):
    """The three models and their predictions, written and read again."""
    data = materialize(encoded(spark, d), "split")
    # The result is read when it is collected, so each run has a folder of its own.
    folder = f"{scratch_dir(spark)}/models-{uuid.uuid4().hex}"

    def written(name):
        model, preds = _scored(name, data)
        path = sinks.write_model(model, preds.drop("model"), folder, "ET+crop", name)
        return spark.read.parquet(f"{path}/predictions").withColumn("model", F.lit(name))

    return reduce(DataFrame.unionByName, models.at_once(written, [(name,) for name in models.MODELS]))
