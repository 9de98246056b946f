"""Training and judging the irrigated-or-rainfed classifiers on a feature table."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import models
from ..operators.features import complete_rows, feature_sets
from ..operators.metrics import all_metrics, best_candidate, confusion, fold_summary, overfit_gap, threshold_sweep
from ..operators.splits import holdout
from ..scratch import materialize
from ..sources.sinks import write_model

METRICS = ["accuracy", "misclass_rate", "balanced_accuracy", "AUC", "F1"]


@dataclass
class Holdout:
    """predictions: model, split, uid, label, prediction, proba.  summary: rounded test metrics.
    search: parameters and mean score of the best candidate, where a search was made."""

    predictions: DataFrame
    summary: DataFrame
    gaps: DataFrame
    confusion: DataFrame
    sweep: DataFrame
    importances: list = field(default_factory=list)
    search: dict = field(default_factory=dict)


def holdout_evaluation(
    data: DataFrame,
    uid: str,
    feature_set: str,
    forest_params: dict | None = None,
    force_cv: bool = True,
    output: str | None = None,
) -> Holdout:
    """Fit the three models on the training rows and score both sides.

    data: uid, label, features and split.  With `output`, models and predictions are saved."""
    data = materialize(data, "holdout")
    train = data.where("split = 'train'")
    parts, top = [], []
    for name in models.MODELS:
        model, preds = models.fit_and_score(name, train, data, [uid, "split"], forest_params)
        stored = materialize(preds.withColumn("model", F.lit(name)), f"predictions-{name}")
        if output:
            write_model(model, stored.drop("model"), output, feature_set, name)
        if name == "GBDT":
            top = models.importances(model, models.vector_names(data))
        parts.append(stored)
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    both = materialize(all_metrics(preds, ["model", "split"]), "holdout-metrics")
    test = preds.where("split = 'test'")
    summary = both.where("split = 'test'").select("model", *[F.round(m, 3).alias(m) for m in METRICS])
    return Holdout(
        predictions=preds,
        summary=summary,
        gaps=overfit_gap(both, ["model"], K.OVERFIT_GAP, force_cv),
        confusion=confusion(test, ["model"]),
        sweep=threshold_sweep(test, ["model"]),
        importances=top,
    )


def classify(
    feature_table: DataFrame,
    uid: str,
    sets: tuple[str, ...] = ("ET+crop",),
    forest_params: dict | None = K.FOREST_PARAMS,
    force_cv: bool = True,
    crop: str = "parc_producto",
    output: str | None = None,
    candidates: int = K.SEARCH_CANDIDATES,
) -> dict[str, tuple[Holdout, DataFrame | None]]:
    """Per feature set: the holdout evaluation and the cross-validation summary of the models
    whose gap called for it.  forest_params=None searches for them first."""
    rows = complete_rows(feature_table)
    out = {}
    for name in sets:
        columns = feature_sets(rows, crop)[name]
        encoded = models.encoder(rows, columns, crop).transform(rows).select(uid, models.LABEL, "features")
        encoded = materialize(encoded, "features")
        params, found = forest_params, {}
        if params is None:
            scores = models.search_forest(encoded, uid, models.sample_candidates(candidates))
            best = best_candidate(scores, list(K.FOREST_SPACE)).first()
            found = best.asDict()
            params = models.parse_params(found)
        result = holdout_evaluation(holdout(encoded, uid), uid, name, params, force_cv, output)
        result.search = found
        # Three rows at most, one per model.
        chosen = [r["model"] for r in result.gaps.where("run_cv").collect()]
        summary = None
        if chosen:
            folds = models.cross_validate(encoded, [m for m in models.MODELS if m in chosen], uid, params)
            summary = fold_summary(folds, ["model"], METRICS)
        out[name] = (result, summary)
    return out
