"""From dated parcel statistics to one feature row per parcel."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F




def columns_ending(df: DataFrame, *suffixes: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def trajectory(date_level: DataFrame, keys: list[str], means: list[str] | None = None) -> DataFrame:
    """<col>_mean and <col>_std (sample) over the dates, for every *_mean column.  A parcel
    seen once has no standard deviation."""
    means = means or columns_ending(date_level, "_mean")
    aggs = []
    for c in means:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return date_level.groupBy(*keys).agg(*aggs)


def attach_labels(features: DataFrame, labels: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left join with the first label row per key, first by `order`."""
    others = [c for c in labels.columns if c not in {*keys, *order}]
    one = labels.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_l"))
    return features.join(one, keys, "left").select(*features.columns, "_l.*")


def feature_columns(df: DataFrame) -> list[str]:
    return columns_ending(df, "_mean_mean", "_mean_std")


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Parcels with every feature present."""
    return df.na.drop(subset=columns or feature_columns(df))


def feature_sets(df: DataFrame, crop: str = "parc_producto") -> dict[str, list[str]]:
    """Column lists of the two comparisons: satellite features alone, and with the crop."""
    base = feature_columns(df)
    return {"ET-only": base, "ET+crop": [*base, crop]}


def crop_indicators(df: DataFrame, uid: str, crop: str) -> DataFrame:
    """One-hot encoding in long form: (uid, level) of the non-zero entries.  A missing crop is
    a level of its own, and no level is left out."""
    return df.select(uid, F.concat(F.lit("crop_"), F.coalesce(crop, F.lit("None"))).alias("level"))


