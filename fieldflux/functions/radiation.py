"""Net radiation from surface temperature, terrain and sun position.

Expects the spectral columns plus dem, slope, aspect, elv_ref, sun_elevation, sun_azimuth."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LAPSE_RATE, SOLAR_CONSTANT, STEFAN_BOLTZMANN
from .nulls import clip, finite


def corrected_temperature():
    """Surface temperature moved to the scene's reference elevation."""
    return F.col("lwir11") + F.lit(LAPSE_RATE) * (F.col("elv_ref") - F.col("dem"))


def add_sun(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "_zen": F.radians(F.lit(90.0) - F.col("sun_elevation")),
            "_dgam": F.radians(F.col("sun_azimuth")) - F.col("aspect"),
        }
    )
    return df.withColumn(
        "cos_i",
        F.cos("_zen") * F.cos("slope") + F.sin("_zen") * F.sin("slope") * F.cos("_dgam"),
    )


def add_shortwave(df: DataFrame) -> DataFrame:
    """Clear-sky and net short-wave radiation; slopes facing away may go negative."""
    df = df.withColumn("_tau", clip(F.lit(0.75) + F.lit(2.0e-5) * F.col("dem"), 0.55, 0.90))
    up = F.cos("_zen")
    df = df.withColumn(
        "Rs_cs",
        F.col("_tau")
        * (
            F.lit(SOLAR_CONSTANT)
            * F.greatest(up, F.lit(0.0))
            * (F.col("cos_i") / F.greatest(up, F.lit(1e-6)))
        ),
    )
    return df.withColumn("Rns", (F.lit(1.0) - F.col("albedo")) * F.col("Rs_cs"))


def add_longwave(df: DataFrame) -> DataFrame:
    """Long-wave terms and net radiation.  Air temperature is the corrected surface one."""
    df = df.withColumn("LSTk_demcorr", corrected_temperature()).withColumn("Ta", F.col("LSTk_demcorr"))
    t2 = F.col("Ta") * F.col("Ta")
    sky = clip(F.lit(0.72) + F.lit(1.6e-3) * (F.col("Ta") - F.lit(273.15)), 0.72, 0.95)
    df = df.withColumns(
        {
            "L_up": F.col("e_0") * F.lit(STEFAN_BOLTZMANN) * (t2 * t2),
            "L_down": sky * F.lit(STEFAN_BOLTZMANN) * (t2 * t2),
        }
    )
    df = df.withColumn("_rn", F.col("Rns") + (F.col("L_down") - F.col("L_up")))
    return df.withColumn("Rn", finite(F.col("_rn"))).drop("_rn", "_tau", "_zen", "_dgam")


def add_radiation(df: DataFrame) -> DataFrame:
    return add_longwave(add_shortwave(add_sun(df)))
