"""Spectral indices from surface reflectance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nulls import clip, divide

# Broadband albedo weights per band and offset.
ALBEDO_WEIGHTS = {
    "blue": 0.4739,
    "green": -0.4372,
    "red": 0.1652,
    "nir08": 0.2831,
    "swir16": 0.1072,
    "swir22": 0.1029,
}
ALBEDO_OFFSET = 0.0366


def normalized_difference(a: str, b: str):
    return divide(F.col(a) - F.col(b), F.col(a) + F.col(b))


def ndmi():
    """Moisture index of near and short-wave infrared; deliberately not clipped."""
    return normalized_difference("nir08", "swir16")


def albedo():
    terms = [F.lit(w) * F.col(band) for band, w in ALBEDO_WEIGHTS.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total + F.lit(ALBEDO_OFFSET)


def leaf_area(savi):
    canopy = F.ln(clip(F.lit(0.69) - savi, lo=1e-6)) / F.lit(0.59)
    return clip(-canopy / F.lit(0.91), 0.0, 7.0)


def add_spectral(df: DataFrame) -> DataFrame:
    """NDVI, SAVI, NDWI, LAI, e_0 (emissivity) and albedo."""
    soil_adjusted = divide(
        F.lit(1.5) * (F.col("nir08") - F.col("red")), F.lit(0.5) + F.col("nir08") + F.col("red")
    )
    df = df.withColumns(
        {
            "NDVI": clip(normalized_difference("nir08", "red"), -1.0, 1.0),
            "SAVI": clip(soil_adjusted, -1.0, 1.0),
            "NDWI": clip(normalized_difference("green", "nir08"), -1.0, 1.0),
            "albedo": albedo(),
        }
    )
    df = df.withColumn("LAI", leaf_area(F.col("SAVI")))
    return df.withColumn("e_0", clip(F.lit(0.95) + F.lit(0.01) * F.col("LAI"), 0.95, 0.99))
