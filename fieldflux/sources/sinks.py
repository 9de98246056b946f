"""Writing results: raster bands, dated and parcel-level tables, models and predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EXPORT_VARS


def label_suffix(name: str, label: str = "") -> str:
    return f"{name}_{label}" if label else name


def write_bands(pixels: DataFrame, path: str, by: list[str]) -> None:
    """LE, EF, ET_inst and ET24h as 4-byte floats with the epsg column, one folder per date.

    Rows are clustered by scene and raster rows first, so a large scene spreads over tasks, and
    sorted by tile within a file, so a reader of one tile skips the others' row groups.  Without
    a date among the keys there is one folder."""
    out = pixels.select(*by, "epsg", "y", "x", *[F.col(v).cast("float").alias(v) for v in EXPORT_VARS])
    out = out.repartition(*by, F.floor(F.col("y") / 256))
    folders = [k for k in by if k == "date"]
    out = out.sortWithinPartitions(*by, "y", "x")
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def write_table(df: DataFrame, path: str, label: str = "", fmt: str = "csv", by: list[str] | None = None) -> str:
    """A result table under the run's label: CSV with header and empty missing values, or Parquet."""
    target = label_suffix(path, label)
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").csv(target)
    else:
        writer.parquet(target)
    return target


def write_model(model, predictions: DataFrame, path: str, feature_set: str, name: str) -> str:
    """The fitted model, and its train and test labels, predictions and probabilities, in a
    folder for each feature set and model."""
    target = f"{path}/features={feature_set}/algorithm={name}"
    model.write().overwrite().save(f"{target}/model")
    predictions.write.mode("overwrite").partitionBy("split").parquet(f"{target}/predictions")
    return target
