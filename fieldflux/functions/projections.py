"""Map projections as Column expressions: UTM (transverse Mercator series in the third
flattening, Karney 2011) and EPSG:3035 (ellipsoidal Lambert azimuthal equal-area,
Snyder 1987).  GRS80 and WGS84 are treated as the same ellipsoid.

The DataFrame functions add output columns in a few stages, so that intermediate values
are computed once and stay in generated code."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoid and projection parameters.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257222101
UTM_SCALE, UTM_EASTING = 0.9996, 500000.0
LAEA_LAT0, LAEA_LON0, LAEA_EASTING, LAEA_NORTHING = 52.0, 10.0, 4321000.0, 3210000.0

_n = FLATTENING / (2 - FLATTENING)
_e2 = FLATTENING * (2 - FLATTENING)
_e = math.sqrt(_e2)
RECTIFYING = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ALPHA = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
]
BETA = [
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
]
DELTA = [
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
]


def _authalic_q(s: float) -> float:
    return (1 - _e2) * (s / (1 - _e2 * s * s) + math.atanh(_e * s) / _e)


_lat0 = math.radians(LAEA_LAT0)
Q_POLE = _authalic_q(1.0)
BETA0 = math.asin(_authalic_q(math.sin(_lat0)) / Q_POLE)
AUTHALIC_RADIUS = SEMI_MAJOR * math.sqrt(Q_POLE / 2)
LAEA_D = (
    SEMI_MAJOR
    * math.cos(_lat0)
    / math.sqrt(1 - _e2 * math.sin(_lat0) ** 2)
    / (AUTHALIC_RADIUS * math.cos(BETA0))
)
AUTHALIC_TO_GEODETIC = [
    _e2 / 3 + 31 * _e2**2 / 180 + 517 * _e2**3 / 5040,
    23 * _e2**2 / 360 + 251 * _e2**3 / 3780,
    761 * _e2**3 / 45360,
]


def wrapped_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def utm_zone(lon: Column) -> Column:
    zone = F.floor((wrapped_longitude(lon) + F.lit(180.0)) / F.lit(6.0)).cast("int") + F.lit(1)
    return F.least(F.greatest(zone, F.lit(1)), F.lit(60))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """ETRS89 code for zones 28-38, WGS84 code elsewhere; the southern hemisphere fails."""
    code = utm_epsg_or_null(lon, lat)
    south = F.raise_error(F.lit("latitude is in the southern hemisphere: no zone for it"))
    return F.when(lat < 0, south.cast("int")).otherwise(code)


def utm_epsg_or_null(lon: Column, lat: Column) -> Column:
    """The same code, missing in the southern hemisphere, so that one such place fails alone."""
    zone = utm_zone(lon)
    code = F.when(zone.between(28, 38), F.lit(25800) + zone).otherwise(F.lit(32600) + zone)
    return F.when(~(lat < 0), code)


def zone_of_epsg(epsg: Column) -> Column:
    """UTM zone number of a 258xx or 326xx code."""
    return F.pmod(epsg, F.lit(100)).cast("int")


def pad_bounds(minx, miny, maxx, maxy, pad) -> list[Column]:
    pad = F.lit(float(pad))
    return [minx - pad, miny - pad, maxx + pad, maxy + pad]


def _series(coef, trig, hyper, xi, eta):
    total = None
    for j, c in enumerate(coef, start=1):
        k = F.lit(2.0 * j)
        term = F.lit(c) * trig(k * xi) * hyper(k * eta)
        total = term if total is None else total + term
    return total


def to_utm(df: DataFrame, lon: str, lat: str, zone: str, x: str, y: str) -> DataFrame:
    """Append easting and northing of (lon, lat) in the given zone column."""
    phi = F.radians(F.col(lat))
    central = F.col(zone) * F.lit(6.0) - F.lit(183.0)
    df = df.withColumns(
        {
            "_lam": F.radians(wrapped_longitude(F.col(lon) - central)),
            "_t": F.sinh(
                F.atanh(F.sin(phi)) - F.lit(_e_conformal()) * F.atanh(F.lit(_e_conformal()) * F.sin(phi))
            ),
        }
    )
    df = df.withColumns(
        {
            "_xi": F.atan2(F.col("_t"), F.cos("_lam")),
            "_eta": F.atanh(F.sin("_lam") / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))),
        }
    )
    k = F.lit(UTM_SCALE * RECTIFYING)
    xi, eta = F.col("_xi"), F.col("_eta")
    return df.withColumns(
        {
            x: F.lit(UTM_EASTING) + k * (eta + _series(ALPHA, F.cos, F.sinh, xi, eta)),
            y: k * (xi + _series(ALPHA, F.sin, F.cosh, xi, eta)),
        }
    ).drop("_lam", "_t", "_xi", "_eta")


def _e_conformal() -> float:
    return 2 * math.sqrt(_n) / (1 + _n)


def from_utm(df: DataFrame, x: str, y: str, zone: str, lon: str, lat: str) -> DataFrame:
    """Append longitude and latitude of a northern-hemisphere UTM point."""
    k = F.lit(UTM_SCALE * RECTIFYING)
    df = df.withColumns({"_xi": F.col(y) / k, "_eta": (F.col(x) - F.lit(UTM_EASTING)) / k})
    xi, eta = F.col("_xi"), F.col("_eta")
    df = df.withColumns(
        {
            "_xp": xi - _series(BETA, F.sin, F.cosh, xi, eta),
            "_ep": eta - _series(BETA, F.cos, F.sinh, xi, eta),
        }
    )
    df = df.withColumn("_chi", F.asin(F.sin("_xp") / F.cosh("_ep")))
    chi = F.col("_chi")
    phi = chi
    for j, c in enumerate(DELTA, start=1):
        phi = phi + F.lit(c) * F.sin(F.lit(2.0 * j) * chi)
    central = F.col(zone) * F.lit(6.0) - F.lit(183.0)
    return df.withColumns(
        {
            lon: wrapped_longitude(F.degrees(F.atan2(F.sinh("_ep"), F.cos("_xp"))) + central),
            lat: F.degrees(phi),
        }
    ).drop("_xi", "_eta", "_xp", "_ep", "_chi")


def to_laea(df: DataFrame, lon: str, lat: str, x: str, y: str) -> DataFrame:
    """Append EPSG:3035 coordinates of (lon, lat)."""
    s = F.sin(F.radians(F.col(lat)))
    q = F.lit(1 - _e2) * (
        s / (F.lit(1.0) - F.lit(_e2) * s * s) + F.atanh(F.lit(_e) * s) / F.lit(_e)
    )
    df = df.withColumns(
        {
            "_b": F.asin(clip_unit(q / F.lit(Q_POLE))),
            "_dl": F.radians(F.col(lon) - F.lit(LAEA_LON0)),
        }
    )
    sin0, cos0 = F.lit(math.sin(BETA0)), F.lit(math.cos(BETA0))
    b, dl = F.col("_b"), F.col("_dl")
    df = df.withColumn(
        "_k",
        F.lit(AUTHALIC_RADIUS)
        * F.sqrt(F.lit(2.0) / (F.lit(1.0) + sin0 * F.sin(b) + cos0 * F.cos(b) * F.cos(dl))),
    )
    return df.withColumns(
        {
            x: F.lit(LAEA_EASTING) + F.col("_k") * F.lit(LAEA_D) * F.cos(b) * F.sin(dl),
            y: F.lit(LAEA_NORTHING)
            + F.col("_k") / F.lit(LAEA_D) * (cos0 * F.sin(b) - sin0 * F.cos(b) * F.cos(dl)),
        }
    ).drop("_b", "_dl", "_k")


def clip_unit(c: Column) -> Column:
    return F.when(c > 1.0, F.lit(1.0)).when(c < -1.0, F.lit(-1.0)).otherwise(c)


def from_laea(df: DataFrame, x: str, y: str, lon: str, lat: str) -> DataFrame:
    """Append longitude and latitude of an EPSG:3035 point."""
    df = df.withColumns(
        {
            "_u": (F.col(x) - F.lit(LAEA_EASTING)) / F.lit(LAEA_D),
            "_v": (F.col(y) - F.lit(LAEA_NORTHING)) * F.lit(LAEA_D),
        }
    )
    df = df.withColumn("_rho", F.hypot("_u", "_v"))
    df = df.withColumn("_c", F.lit(2.0) * F.asin(F.col("_rho") / F.lit(2.0 * AUTHALIC_RADIUS)))
    sin0, cos0 = F.lit(math.sin(BETA0)), F.lit(math.cos(BETA0))
    c = F.col("_c")
    df = df.withColumn(
        "_b",
        F.when(
            F.col("_rho") > 0,
            F.asin(F.cos(c) * sin0 + F.try_divide(F.col("_v") * F.sin(c) * cos0, F.col("_rho"))),
        ).otherwise(F.lit(BETA0)),
    )
    b = F.col("_b")
    phi = b
    for j, k in enumerate(AUTHALIC_TO_GEODETIC, start=1):
        phi = phi + F.lit(k) * F.sin(F.lit(2.0 * j) * b)
    turn = F.atan2(
        F.col("_u") * F.sin(c), F.col("_rho") * cos0 * F.cos(c) - F.col("_v") * sin0 * F.sin(c)
    )
    return df.withColumns(
        {
            lon: F.lit(LAEA_LON0) + F.when(F.col("_rho") > 0, F.degrees(turn)).otherwise(F.lit(0.0)),
            lat: F.degrees(phi),
        }
    ).drop("_u", "_v", "_rho", "_c", "_b")


def utm_bounds_to_wgs84(df: DataFrame, zone: str, names=("minx", "miny", "maxx", "maxy")) -> DataFrame:
    """Append lon_min, lat_min, lon_max, lat_max; only the two diagonal corners are converted."""
    minx, miny, maxx, maxy = names
    df = from_utm(df, minx, miny, zone, "lon_min", "lat_min")
    return from_utm(df, maxx, maxy, zone, "lon_max", "lat_max")
