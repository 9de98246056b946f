"""Scalar functions, evaluated on every row of a given table."""

import math

from pyspark.sql import functions as F

from fieldflux.functions import clock, evapotranspiration, fluxes, indices, nulls, projections, radiation, stability
from fieldflux.operators import geometry
from fieldflux.operators.metrics import mean_std_text
from fieldflux.operators.scenes import with_time_zone

from . import balance_sql as B
from .registry import CTES, check, rnd, rounded
from .testbed import geo_parcels, observations, read, scenes

LINE = ["l_orderkey", "l_linenumber"]
L = "l_orderkey, l_linenumber"


@check("c01_safe_divide", f"SELECT {L}, round(l_extendedprice / nullif(l_quantity - 25, 0), 6) + 0.0 AS ratio FROM lineitem")
def c01(spark, d):
    li = read(spark, d, "lineitem")
    return rnd(li.withColumn("ratio", nulls.divide(F.col("l_extendedprice"), F.col("l_quantity") - 25)), LINE, ["ratio"])


@check(
    "c02_safe_power",
    f"""SELECT {L}, round(CASE WHEN v >= 0 THEN pow(v, 0.25) END, 6) + 0.0 AS root, round(pow(v, 3.0), 6) + 0.0 AS cube
    FROM (SELECT *, l_discount - 0.05 AS v FROM lineitem)""",
)
def c02(spark, d):
    li = read(spark, d, "lineitem").withColumn("v", F.col("l_discount") - 0.05)
    return rnd(li.withColumns({"root": nulls.power(F.col("v"), 0.25), "cube": nulls.power(F.col("v"), 3)}), LINE, ["root", "cube"])


@check("c03_safe_log", f"SELECT {L}, round(CASE WHEN l_quantity > 25 THEN ln(l_quantity - 25) END, 6) + 0.0 AS lg FROM lineitem")
def c03(spark, d):
    li = read(spark, d, "lineitem")
    return rnd(li.withColumn("lg", nulls.log(F.col("l_quantity") - 25)), LINE, ["lg"])


@check(
    "c04_clip",
    f"""SELECT {L}, {rounded(['fixed_bounds', 'column_bounds'])} FROM (
      SELECT *, CASE WHEN v IS NULL THEN NULL ELSE least(greatest(v, 10.0), 40.0) END AS fixed_bounds,
        CASE WHEN v IS NULL OR hi IS NULL THEN NULL ELSE least(greatest(v, 0.0), hi) END AS column_bounds
      FROM (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS v,
        CASE WHEN l_linenumber <> 3 THEN 0.6 * (l_quantity - 20) END AS hi FROM lineitem))""",
)
def c04(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    v, hi = F.when(n != 2, q), F.when(n != 3, F.lit(0.6) * (q - 20))
    li = read(spark, d, "lineitem").withColumns(
        {"fixed_bounds": nulls.clip(v, 10.0, 40.0), "column_bounds": nulls.clip(v, 0.0, hi)}
    )
    return rnd(li, LINE, ["fixed_bounds", "column_bounds"])


CTES["idxrow"] = B.indices("obs")


@check("c05_ndvi_savi_ndwi", f"SELECT {L}, {rounded(['NDVI', 'SAVI', 'NDWI'])} FROM idxrow")
def c05(spark, d):
    return rnd(indices.add_spectral(observations(spark, d)), LINE, ["NDVI", "SAVI", "NDWI"])


@check("c06_lai_emissivity_albedo", f"SELECT {L}, {rounded(['LAI', 'e_0', 'albedo'])} FROM idxrow")
def c06(spark, d):
    return rnd(indices.add_spectral(observations(spark, d)), LINE, ["LAI", "e_0", "albedo"])


@check("c07_ndmi", f"SELECT {L}, {rounded(['NDMI'])} FROM idxrow")
def c07(spark, d):
    return rnd(observations(spark, d).withColumn("NDMI", indices.ndmi()), LINE, ["NDMI"])


CTES["lonlat"] = """
SELECT o_orderkey, (o_orderkey * 7 % 4000) / 10.0 - 190.0 AS lon, CAST(o_custkey % 80 AS DOUBLE) AS lat FROM orders"""


def _lonlat(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        "o_orderkey",
        ((k * 7 % 4000) / F.lit(10.0) - F.lit(190.0)).alias("lon"),
        (F.col("o_custkey") % 80).cast("double").alias("lat"),
    )


_WRAP = "CASE WHEN (lon + 180.0) % 360.0 < 0 THEN ((lon + 180.0) % 360.0 + 360.0) % 360.0 ELSE (lon + 180.0) % 360.0 END - 180.0"


@check(
    "c08_utm_zone",
    f"""SELECT o_orderkey, round(w, 6) + 0.0 AS lon_wrapped, z AS zone,
      CASE WHEN z BETWEEN 28 AND 38 THEN 25800 + z ELSE 32600 + z END AS epsg FROM (
      SELECT *, CAST(least(greatest(floor((w + 180.0) / 6.0) + 1, 1), 60) AS INTEGER) AS z
      FROM (SELECT *, {_WRAP} AS w FROM lonlat))""",
)
def c08(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    return _lonlat(spark, d).select(
        "o_orderkey",
        F.round(projections.wrapped_longitude(lon), 6).alias("lon_wrapped"),
        projections.utm_zone(lon).alias("zone"),
        projections.utm_epsg(lon, lat).alias("epsg"),
    )


@check(
    "c09_pad_bounds",
    """SELECT item_id, round(lon_min - 30.0, 6) AS a, round(lat_min - 30.0, 6) AS b, round(lon_max + 30.0, 6) AS c,
      round(lat_max + 30.0, 6) AS d FROM scenes""",
)
def c09(spark, d):
    cols = [F.col(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")]
    padded = projections.pad_bounds(*cols, 30)
    return scenes(spark, d).select("item_id", *[F.round(c, 6).alias(n) for c, n in zip(padded, "abcd")])


P = projections


def _ser(coef, trig, hyp, xi, eta):
    return " + ".join(f"{c!r} * {trig}({2.0 * j} * {xi}) * {hyp}({2.0 * j} * {eta})" for j, c in enumerate(coef, 1))


def utm_sql(src, lon, lat, zone, x, y):
    ec = P._e_conformal()
    a = f"""SELECT *, radians({lon} - ({zone} * 6.0 - 183.0)) AS lam,
      sinh(atanh(sin(radians({lat}))) - {ec!r} * atanh({ec!r} * sin(radians({lat})))) AS tt FROM {src}"""
    b = f"SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1.0 + tt * tt)) AS eta FROM ({a})"
    k = repr(P.UTM_SCALE * P.RECTIFYING)
    return f"""SELECT * EXCLUDE (lam, tt, xi, eta), 500000.0 + {k} * (eta + {_ser(P.ALPHA, 'cos', 'sinh', 'xi', 'eta')}) AS {x},
      {k} * (xi + {_ser(P.ALPHA, 'sin', 'cosh', 'xi', 'eta')}) AS {y} FROM ({b})"""


def utm_inverse_sql(src, x, y, zone, lon, lat):
    k = repr(P.UTM_SCALE * P.RECTIFYING)
    a = f"SELECT *, {y} / {k} AS xi, ({x} - 500000.0) / {k} AS eta FROM {src}"
    b = f"""SELECT *, xi - ({_ser(P.BETA, 'sin', 'cosh', 'xi', 'eta')}) AS xp,
      eta - ({_ser(P.BETA, 'cos', 'sinh', 'xi', 'eta')}) AS ep FROM ({a})"""
    c = f"SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM ({b})"
    phi = "chi + " + " + ".join(f"{v!r} * sin({2.0 * j} * chi)" for j, v in enumerate(P.DELTA, 1))
    return f"""SELECT * EXCLUDE (xi, eta, xp, ep, chi), degrees(atan2(sinh(ep), cos(xp))) + ({zone} * 6.0 - 183.0) AS {lon},
      degrees({phi}) AS {lat} FROM ({c})"""


_E2 = repr(P._e2)
_EE = repr(P._e)
_S0, _C0 = repr(math.sin(P.BETA0)), repr(math.cos(P.BETA0))


def laea_sql(src, lon, lat, x, y):
    s = f"sin(radians({lat}))"
    q = f"(1 - {_E2}) * ({s} / (1.0 - {_E2} * {s} * {s}) + atanh({_EE} * {s}) / {_EE})"
    a = f"SELECT *, asin(least(greatest({q} / {P.Q_POLE!r}, -1.0), 1.0)) AS bb, radians({lon} - 10.0) AS dl FROM {src}"
    b = f"SELECT *, {P.AUTHALIC_RADIUS!r} * sqrt(2.0 / (1.0 + {_S0} * sin(bb) + {_C0} * cos(bb) * cos(dl))) AS kk FROM ({a})"
    return f"""SELECT * EXCLUDE (bb, dl, kk), 4321000.0 + kk * {P.LAEA_D!r} * cos(bb) * sin(dl) AS {x},
      3210000.0 + kk / {P.LAEA_D!r} * ({_C0} * sin(bb) - {_S0} * cos(bb) * cos(dl)) AS {y} FROM ({b})"""


def laea_inverse_sql(src, x, y, lon, lat):
    a = f"SELECT *, ({x} - 4321000.0) / {P.LAEA_D!r} AS uu, ({y} - 3210000.0) * {P.LAEA_D!r} AS vv FROM {src}"
    b = f"SELECT *, sqrt(uu * uu + vv * vv) AS rr FROM ({a})"
    c = f"SELECT *, 2.0 * asin(rr / (2.0 * {P.AUTHALIC_RADIUS!r})) AS cc FROM ({b})"
    d = f"SELECT *, asin(cos(cc) * {_S0} + vv * sin(cc) * {_C0} / rr) AS bb FROM ({c})"
    phi = "bb + " + " + ".join(f"{v!r} * sin({2.0 * j} * bb)" for j, v in enumerate(P.AUTHALIC_TO_GEODETIC, 1))
    return f"""SELECT * EXCLUDE (uu, vv, rr, cc, bb),
      10.0 + degrees(atan2(uu * sin(cc), rr * {_C0} * cos(cc) - vv * {_S0} * sin(cc))) AS {lon}, degrees({phi}) AS {lat} FROM ({d})"""


CTES["geopoint"] = "SELECT parcel_uid, x0 AS lon, y0 AS lat, CAST(floor((x0 + 180.0) / 6.0) + 1 AS INTEGER) AS zone FROM geo"


@check(
    "c10_reproject",
    f"""SELECT parcel_uid, {rounded(['ux', 'uy', 'ex', 'ey'], 3)}, {rounded(['ulon', 'ulat', 'elon', 'elat'], 6)} FROM (
    {laea_inverse_sql('(' + laea_sql('(' + utm_inverse_sql('(' + utm_sql('geopoint', 'lon', 'lat', 'zone', 'ux', 'uy') + ')', 'ux', 'uy', 'zone', 'ulon', 'ulat') + ')', 'lon', 'lat', 'ex', 'ey') + ')', 'ex', 'ey', 'elon', 'elat')})""",
)
def c10(spark, d):
    first = F.col("geometry")[0][0][0]
    pts = geo_parcels(spark, d).select("parcel_uid", first["x"].alias("lon"), first["y"].alias("lat"))
    pts = pts.withColumn("zone", projections.utm_zone(F.col("lon")))
    df = projections.to_utm(pts, "lon", "lat", "zone", "ux", "uy")
    df = projections.from_utm(df, "ux", "uy", "zone", "ulon", "ulat")
    df = projections.from_laea(projections.to_laea(df, "lon", "lat", "ex", "ey"), "ex", "ey", "elon", "elat")
    return df.select(
        "parcel_uid",
        *[F.round(c, 3).alias(c) for c in ("ux", "uy", "ex", "ey")],
        *[F.round(c, 6).alias(c) for c in ("ulon", "ulat", "elon", "elat")],
    )


CTES["geoflat"] = laea_sql(
    "(" + laea_sql("(" + laea_sql("geoedges", "x1", "y1", "px1", "py1") + ")", "x2", "y2", "px2", "py2") + ")", "ox", "oy", "pox", "poy"
)
CTES["geocenter"] = (
    "SELECT * FROM ("
    + laea_inverse_sql(
        """(SELECT parcel_uid, sum(cr * (dx1 + dx2)) / (3.0 * sum(cr)) + any_value(pox) AS cx,
        sum(cr * (dy1 + dy2)) / (3.0 * sum(cr)) + any_value(poy) AS cy, abs(sum(cr)) / 2 AS area FROM (
          SELECT *, dx1 * dy2 - dx2 * dy1 AS cr FROM (
            SELECT *, px1 - pox AS dx1, py1 - poy AS dy1, px2 - pox AS dx2, py2 - poy AS dy2 FROM geoflat)) GROUP BY parcel_uid)""",
        "cx", "cy", "lon", "lat",
    )
    + ")"
)


@check("c11_polygon_centroid", f"SELECT parcel_uid, {rounded(['cx', 'cy', 'area'], 2)}, {rounded(['lon', 'lat'], 6)} FROM geocenter")
def c11(spark, d):
    edges = geometry.explode_edges(geometry.explode_parts(geo_parcels(spark, d), ["parcel_uid"]), ["parcel_uid"])
    c = geometry.geographic_centroid(edges, ["parcel_uid"])
    return c.select(
        "parcel_uid", *[F.round(n, 2).alias(n) for n in ("cx", "cy", "area")], *[F.round(n, 6).alias(n) for n in ("lon", "lat")]
    )


_OFFSET = "CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -8 END"


@check(
    "c13_date_range_midpoint",
    f"""SELECT o_orderkey, s AS start_utc, e AS end_utc, s + to_microseconds(CAST(date_diff('microsecond', s, e) // 2 AS BIGINT)) AS midpoint
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - to_hours({_OFFSET}) AS s,
      CAST(o_orderdate AS DATE) + to_days(CAST(o_orderkey % 32 AS INTEGER)) - to_hours({_OFFSET}) AS e FROM orders)""",
)
def c13(spark, d):
    o = read(spark, d, "orders")
    day = F.to_date("o_orderdate")
    text = F.concat_ws("/", day.cast("string"), F.date_add(day, (F.col("o_orderkey") % 32).cast("int")).cast("string"))
    zone = F.element_at(F.array(F.lit("UTC"), F.lit("+01:00"), F.lit("-08:00")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return o.select(
        "o_orderkey",
        clock.range_bound(text, 0, zone).alias("start_utc"),
        clock.range_bound(text, 1, zone).alias("end_utc"),
        clock.range_midpoint(text, zone).alias("midpoint"),
    )


@check(
    "c14_nearest_hour",
    """SELECT item_id, TIMESTAMP '1970-01-01' + to_hours(CAST(round_even(epoch_us(wind_ts) / 3.6e9, 0) AS BIGINT)) AS hour FROM scenes""",
)
def c14(spark, d):
    return scenes(spark, d).select("item_id", clock.nearest_hour(F.col("wind_ts")).alias("hour"))


_MOD = "CASE WHEN lon % 360.0 < 0 THEN (lon % 360.0 + 360.0) % 360.0 ELSE lon % 360.0 END"


@check(
    "c15_grid_keys",
    f"""SELECT o_orderkey, round_even({_MOD} / 0.25, 0) * 0.25 AS lon_key, round_even((lat + lon / 10) / 0.25, 0) * 0.25 + 0.0 AS lat_key FROM (
      SELECT o_orderkey, lat, lon + (o_orderkey % 16) * 0.125 AS lon FROM lonlat)""".replace(f"round_even({_MOD}", f"round_even(({_MOD})"),
)
def c15(spark, d):
    df = _lonlat(spark, d).withColumn("lon", F.col("lon") + (F.col("o_orderkey") % 16) * F.lit(0.125))
    return df.select(
        "o_orderkey",
        clock.longitude_key(F.col("lon")).alias("lon_key"),
        (clock.grid_key(F.col("lat") + F.col("lon") / 10) + F.lit(0.0)).alias("lat_key"),
    )


@check("c16_wind_speed", "SELECT event_id, round(sqrt(value * value + (event_id % 17) * (event_id % 17)), 6) AS speed FROM events")
def c16(spark, d):
    u, v = F.col("value"), (F.col("event_id") % 17).cast("double")
    return read(spark, d, "events").select("event_id", F.round(clock.wind_speed(u, v), 6).alias("speed"))


_G = f"{2 * math.pi / 365.0!r} * (dayofyear(datetime) - 1.0)"


@check(
    "c17_day_length",
    f"""SELECT item_id, round(degrees(acos(CASE WHEN ch > 1 THEN 1.0 WHEN ch < -1 THEN -1.0 ELSE ch END)) * 480.0, 4) AS seconds FROM (
      SELECT item_id, ({math.sin(math.radians(-0.833))!r} - sin(phi) * sin(dec)) / (cos(phi) * cos(dec)) AS ch FROM (
        SELECT item_id, radians(lat_min + (item_id % 7) * 8.0) AS phi, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2.0 * g)
          + 0.000907 * sin(2.0 * g) - 0.002697 * cos(3.0 * g) + 0.00148 * sin(3.0 * g) AS dec FROM (
            SELECT *, {_G} AS g FROM scenes)))""",
)
def c17(spark, d):
    lat = F.col("lat_min") + (F.col("item_id") % 7) * F.lit(8.0)
    return scenes(spark, d).select("item_id", F.round(clock.day_length(F.col("datetime"), lat), 4).alias("seconds"))


@check(
    "c18_time_zone_lookup",
    """SELECT item_id, coalesce(min(z.tz), 'UTC') AS tz FROM scenes s LEFT JOIN (
      SELECT 'zone_' || n_nationkey AS tz, -12.0 + (n_nationkey % 5) * 3.5 AS x0, 34.0 + (n_nationkey // 5) * 2.5 AS y0 FROM nation) z
      ON s.lon_min >= z.x0 AND s.lon_min < z.x0 + 2.5 AND s.lat_min >= z.y0 AND s.lat_min < z.y0 + 2.0 GROUP BY item_id""",
)
def c18(spark, d):
    from .testbed import _shape

    n = F.col("n_nationkey")
    x0, y0 = F.lit(-12.0) + (n % 5) * F.lit(3.5), F.lit(34.0) + F.floor(n / 5) * F.lit(2.5)
    zones = read(spark, d, "nation").select(
        F.concat(F.lit("zone_"), n.cast("string")).alias("tz"), _shape(x0, y0, F.lit(2.5), F.lit(2.0), F.lit(False)).alias("geometry")
    )
    pts = scenes(spark, d).select("item_id", F.col("lon_min").alias("lon"), F.col("lat_min").alias("lat"))
    return with_time_zone(pts, "item_id", zones).select("item_id", "tz")


# --- radiation and fluxes on every observation ---------------------------------------

_SITE = {
    "dem": "200 + 6 * y + 4 * x + 10 * ((y * 7 + x * 3) % 5)",
    "slope": "0.01 * (y % 20)",
    "aspect": "0.15 * x",
    "elv_ref": "200",
    "sun_elevation": "60 + tile_id",
    "sun_azimuth": "135 + tile_id",
    "Uref": "3.5",
    "zref": "10",
    "daylength": "53000",
    "ndvi_p05": "0.2",
    "ndvi_p95": "0.7",
    "ndmi_p05": "0.05",
    "ndmi_p95": "0.6",
}
CTES["site"] = "SELECT *, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _SITE.items()) + " FROM idxrow"
CTES["radrow"] = B.radiation("site")
CTES["fluxrow"] = B.fluxes("radrow")


def site(spark, d):
    obs = indices.add_spectral(observations(spark, d))
    return obs.withColumns({k: F.expr(f"CAST({v} AS DOUBLE)") for k, v in _SITE.items()})


@check("c19_corrected_temperature", f"SELECT {L}, {rounded(['LSTk_demcorr'])} FROM radrow")
def c19(spark, d):
    return rnd(site(spark, d).withColumn("LSTk_demcorr", radiation.corrected_temperature()), LINE, ["LSTk_demcorr"])


@check("c21_shortwave", f"SELECT {L}, {rounded(['cos_i', 'Rs_cs', 'Rns'], 4)} FROM radrow")
def c21(spark, d):
    return rnd(radiation.add_shortwave(radiation.add_sun(site(spark, d))), LINE, ["cos_i", "Rs_cs", "Rns"], 4)


@check("c22_longwave_net_radiation", f"SELECT {L}, {rounded(['L_up', 'L_down', 'Rn'], 4)} FROM radrow")
def c22(spark, d):
    return rnd(radiation.add_radiation(site(spark, d)), LINE, ["L_up", "L_down", "Rn"], 4)


def _flux(spark, d):
    return fluxes.add_fluxes(radiation.add_radiation(site(spark, d)))


@check("c23_cover_fraction", f"SELECT {L}, {rounded(['fc'])} FROM fluxrow")
def c23(spark, d):
    return rnd(fluxes.add_cover_fraction(site(spark, d)), LINE, ["fc"])


@check("c24_soil_heat", f"SELECT {L}, {rounded(['G0'], 4)} FROM fluxrow")
def c24(spark, d):
    return rnd(_flux(spark, d), LINE, ["G0"], 4)


@check("c25_moisture_damping", f"SELECT {L}, {rounded(['NDMI', 'G'], 4)} FROM fluxrow")
def c25(spark, d):
    return rnd(_flux(spark, d), LINE, ["NDMI", "G"], 4)


@check("c26_roughness", f"SELECT {L}, {rounded(['z0m', 'ustar0', 'rah0'])} FROM fluxrow")
def c26(spark, d):
    return rnd(_flux(spark, d), LINE, ["z0m", "ustar0", "rah0"])


@check("c27_air_density", f"SELECT {L}, {rounded(['p_air', 'rho'], 4)} FROM fluxrow")
def c27(spark, d):
    return rnd(_flux(spark, d), LINE, ["p_air", "rho"], 4)


CTES["lengths"] = f"SELECT {L}, CASE WHEN l_linenumber <> 2 THEN (l_quantity - 25) * (l_tax * 100 + 0.5) / 10.0 END AS L0 FROM lineitem"


@check("c28_stability", f"SELECT {L}, {rounded(['L', 'psi_m200', 'psi_h2', 'psi_h01'])} FROM ({B.psi('(' + B.floored('lengths') + ')')})")
def c28(spark, d):
    raw = F.when(
        F.col("l_linenumber") != 2, (F.col("l_quantity") - 25) * (F.col("l_tax") * 100 + F.lit(0.5)) / F.lit(10.0)
    )
    li = read(spark, d, "lineitem").withColumn("L", stability.floor_length(raw))
    return rnd(stability.add_stability(li), LINE, ["L", "psi_m200", "psi_h2", "psi_h01"])


_STATE = {"dT": "CASE WHEN l_linenumber <> 2 THEN 0.5 + 0.2 * y END", "rah": "10 + x * 2"}
CTES["staterow"] = "SELECT *, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _STATE.items()) + " FROM fluxrow"
CTES["hrow"] = B.sensible("staterow")
CTES["etrow"] = B.et("hrow")


def _heat(spark, d):
    df = _flux(spark, d).withColumns({k: F.expr(f"CAST({v.replace('0.5', '0.5D').replace('0.2', '0.2D')} AS DOUBLE)") for k, v in _STATE.items()})
    return evapotranspiration.add_sensible_heat(df)


@check("c29_sensible_heat", f"SELECT {L}, {rounded(['H'], 4)} FROM hrow")
def c29(spark, d):
    return rnd(_heat(spark, d), LINE, ["H"], 4)


@check("c30_latent_heat_et", f"SELECT {L}, {rounded(['LE', 'ET_inst', 'EF', 'ET24h'], 4)} FROM etrow")
def c30(spark, d):
    return rnd(evapotranspiration.add_et(_heat(spark, d)), LINE, ["LE", "ET_inst", "EF", "ET24h"], 4)


@check(
    "c31_mean_std_text",
    "SELECT l_partkey, printf('%.3f±%.3f', avg(l_quantity), stddev_pop(l_quantity)) AS txt FROM lineitem GROUP BY l_partkey",
)
def c31(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(
        mean_std_text(F.avg("l_quantity"), F.stddev_pop("l_quantity")).alias("txt")
    )
