"""Soil heat flux, roughness, air density and the hot/cold pixel predicates.

Scene scalars (ndvi_p05, ndvi_p95, ndmi_p05, ndmi_p95, Uref, zref) are columns that were
joined onto the pixels beforehand."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..scratch import apart
from .indices import ndmi
from .nulls import clip, log


def scaled(value: Column, lo: Column, hi: Column) -> Column:
    """Position of a value inside the scene's own range, clipped to 0..1."""
    return clip((value - lo) / clip(hi - lo, lo=1e-6), 0.0, 1.0)


def add_cover_fraction(df: DataFrame) -> DataFrame:
    df = df.withColumn("fc", scaled(F.col("NDVI"), F.col("ndvi_p05"), F.col("ndvi_p95")))
    return df.withColumn("fc", F.col("fc") * F.col("fc"))


def add_soil_heat(df: DataFrame) -> DataFrame:
    """G from canopy-dependent models, clipped to 60 % of Rn, before moisture damping."""
    rn, cover, lai, alb = (F.col(c) for c in ("Rn", "fc", "LAI", "albedo"))
    ndvi2 = F.col("NDVI") * F.col("NDVI")
    warm = clip(F.col("LSTk_demcorr") - F.lit(273.15), 0.0, 30.0)
    df = df.withColumns(
        {
            "_g_sebs": rn
            * (
                warm
                * (F.lit(0.0038) + F.lit(0.006) * alb)
                * (F.lit(1.0) - F.lit(0.995) * (ndvi2 * ndvi2))
            ),
            "_g_lai": rn * clip(F.lit(0.05) + F.lit(0.18) * F.exp(F.lit(-0.521) * lai), 0.02, 0.35),
            "_g_bare": clip(F.lit(0.24) + F.lit(0.18) * alb, 0.20, 0.40) * rn,
            "_g_veg": clip(F.lit(0.05) + F.lit(0.02) * F.exp(F.lit(-0.7) * lai), 0.03, 0.12) * rn,
        }
    )
    mix = F.col("_g_bare") * (F.lit(1.0) - cover) + F.col("_g_veg") * cover
    df = df.withColumn(
        "_g0", F.when(cover >= 0.15, F.lit(0.5) * (F.col("_g_sebs") + F.col("_g_lai"))).otherwise(mix)
    )
    return df.withColumn("G0", clip(F.col("_g0"), 0.0, rn * F.lit(0.6))).drop(
        "_g_sebs", "_g_lai", "_g_bare", "_g_veg", "_g0"
    )


def add_moisture_damping(df: DataFrame) -> DataFrame:
    """Wet surfaces conduct less: G0 reduced by up to 35 % along the scene's NDMI range."""
    df = df.withColumn("NDMI", ndmi())
    df = df.withColumn("_m", scaled(F.col("NDMI"), F.col("ndmi_p05"), F.col("ndmi_p95")))
    damped = F.col("G0") * (F.lit(1.0) - F.lit(K.MOISTURE_DAMPING) * F.col("_m"))
    df = df.withColumn("_g", damped)
    return df.withColumn("G", clip(F.col("_g"), 0.0, F.col("Rn") * F.lit(0.6))).drop("_g", "_m")


def add_roughness(df: DataFrame) -> DataFrame:
    """Canopy height, displacement, momentum roughness and the neutral u* and r_ah."""
    df = df.withColumns(
        {
            "_disp": F.lit(0.67) * clip(F.lit(0.1) + F.lit(2.0) * F.col("fc"), 0.05, 3.0),
            "z0m": clip(F.exp(F.lit(5.62) * F.col("SAVI") - F.lit(5.809)), 0.005, 0.5),
        }
    )
    df = df.withColumns(
        {
            "_psi_u": log(clip(F.col("zref") - F.col("_disp"), lo=0.05) / clip(F.col("z0m"), lo=1e-6)),
            "_psi_h": log(
                clip(F.lit(2.0) - F.col("_disp"), lo=0.05) / clip(F.lit(0.1) - F.col("_disp"), lo=0.02)
            ),
        }
    )
    df = df.withColumn(
        "ustar0", clip(F.try_divide(F.lit(K.KARMAN) * F.col("Uref"), F.col("_psi_u")), 0.05, 2.0)
    )
    return df.withColumn(
        "rah0", clip(F.col("_psi_h") / (F.lit(K.KARMAN) * F.col("ustar0")), 20.0, 200.0)
    ).drop("_psi_u", "_psi_h", "_disp")


def add_air_density(df: DataFrame) -> DataFrame:
    lifted = clip(F.lit(1.0) - F.lit(2.25577e-5) * F.col("dem"), lo=1e-6)
    df = df.withColumn("p_air", F.lit(101325.0) * F.pow(lifted, F.lit(5.2559)))
    return df.withColumn("rho", F.try_divide(F.col("p_air"), F.lit(K.DRY_AIR_GAS) * F.col("Ta")))


def is_cold() -> Column:
    """Well-watered dense vegetation; false where an index is missing."""
    cold = (
        F.col("LSTk_demcorr").isNotNull()
        & (F.col("NDVI") >= K.COLD_NDVI)
        & (F.col("NDWI") < K.COLD_NDWI)
        & (F.col("albedo") >= K.COLD_ALBEDO_LO)
        & (F.col("albedo") <= K.COLD_ALBEDO_HI)
    )
    return F.coalesce(cold, F.lit(False))


def is_hot() -> Column:
    """Dry bare ground; false where an index is missing."""
    hot = (
        F.col("LSTk_demcorr").isNotNull()
        & (F.col("NDVI") <= K.HOT_NDVI)
        & (F.col("NDWI") < K.HOT_NDWI)
    )
    return F.coalesce(hot, F.lit(False))


def add_fluxes(df: DataFrame) -> DataFrame:
    df = apart(add_moisture_damping(apart(add_soil_heat(add_cover_fraction(df)), "G0")), "G")
    return apart(add_air_density(add_roughness(df)), "rho")
