"""Pixel operators: composites, elevation, terrain, quantiles, rasterizing, zonal statistics."""

from pyspark.sql import functions as F

from fieldflux.constants import BANDS
from fieldflux.functions import fluxes, indices, nulls
from fieldflux.operators import composite, elevation, geometry, quantiles, rasterize, terrain, zonal
from fieldflux.scratch import attach, spread
from fieldflux.sources import tables

from . import balance_sql as B
from . import testbed as T
from .registry import CTES, check, rnd, rounded


def composed(spark, d, scene):
    return rnd(composite.median_composite(T.observations(spark, d), scene), [*scene, "y", "x"], BANDS)


@check("a04_observation_scan", f"SELECT tile_id, y, x, {rounded(BANDS)} FROM obs WHERE yr = 1997 AND y < 20 AND x >= 10")
def a04(spark, d):
    obs = tables.nan_to_null(T.observations(spark, d)).where("yr = 1997 AND y < 20 AND x >= 10")
    return rnd(obs, ["tile_id", "y", "x"], BANDS)


@check(
    "a05_dem_nodata",
    "SELECT tile_id, y, x, CASE WHEN dem <> 216 THEN dem END AS dem FROM dems",
)
def a05(spark, d):
    return T.dem(spark, d, None).withColumn("dem", F.nullif(F.col("dem"), F.lit(216.0)))


@check("b11_finite_mask", "SELECT event_id, CASE WHEN event_id % 5 NOT IN (0, 1) THEN value END AS v FROM events")
def b11(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return T.read(spark, d, "events").select("event_id", nulls.finite(raw).alias("v"))


@check("e01_median_composite", f"SELECT tile_id, yr, y, x, {', '.join(BANDS)} FROM yearly")
def e01(spark, d):
    return composed(spark, d, ["tile_id", "yr"])


@check("e01_median_composite_all_dates", f"SELECT tile_id, y, x, {', '.join(BANDS)} FROM composite")
def e01_all(spark, d):
    return composed(spark, d, ["tile_id"])


_LONG = " UNION ALL ".join(f"SELECT tile_id, yr, y, x, '{b}' AS band, {b} AS value FROM yearly" for b in BANDS)


@check("b13_bands_to_rows", _LONG)
def b13_rows(spark, d):
    return composite.bands_to_rows(composed(spark, d, ["tile_id", "yr"]), ["tile_id", "yr", "y", "x"])


@check("b13_rows_to_bands", f"SELECT tile_id, yr, y, x, {', '.join(BANDS)} FROM yearly")
def b13_bands(spark, d):
    keys = ["tile_id", "yr", "y", "x"]
    return composite.rows_to_bands(composite.bands_to_rows(composed(spark, d, ["tile_id", "yr"]), keys), keys)


@check(
    "e03_dem_mosaic",
    """SELECT tile_id, y, x, max(CASE WHEN v <> 500 THEN v END) AS dem FROM (
      SELECT tile_id, y, x, CAST(l_orderkey % 997 + tile_id AS DOUBLE) AS v FROM obs) GROUP BY tile_id, y, x""",
)
def e03(spark, d):
    items = T.observations(spark, d).select(
        "tile_id", "y", "x", (F.col("l_orderkey") % 997 + F.col("tile_id")).cast("double").alias("dem")
    )
    return composite.dem_mosaic(items, 500.0)


@check(
    "d09_dem_on_pixel_grid",
    """SELECT g.tile_id, g.y, g.x, s.dem FROM dems g LEFT JOIN (SELECT * FROM dems WHERE y < 20 AND x < 20) s
      ON s.tile_id = g.tile_id AND s.y = g.y // 2 AND s.x = g.x // 2""",
)
def d09(spark, d):
    dem = T.dem(spark, d, None)
    coarse = dem.where("y < 20 AND x < 20")
    return terrain.resample_nearest(dem.drop("dem"), coarse).select("tile_id", "y", "x", "dem")


# Elevation of any grid: tiles of 24 x 24 pixels in zone 30, and for each supplier an item of 47 m cells in
# that zone and one in degrees, none on the tiles' corners.
_ROW, _COL = "CAST(s_suppkey % 40 AS DOUBLE)", "CAST(floor(s_suppkey / 40.0) AS DOUBLE)"
CTES["etiles"] = f"SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS tile_id, 400015.0 + 1730.0 * {_ROW} AS west, 4400005.0 + 1990.0 * {_COL} AS north FROM supplier"
CTES["egrids"] = """SELECT 'u' || tile_id AS item_id, 25830 AS epsg, west - 131.0 AS x0, north + 77.0 AS y0, 47.0 AS dx, 47.0 AS dy, 20 AS nx, 20 AS ny FROM etiles
UNION ALL SELECT DISTINCT 'g' || CAST(s_suppkey AS VARCHAR), 4326, -4.1711 + 0.0203 * """ + _ROW + """, 39.7507 + 0.0179 * """ + _COL + """, 0.0004, 0.0003, 40, 40 FROM supplier"""
CTES["ecells"] = """SELECT item_id, CAST(r.v AS INTEGER) AS row, CAST(c.v AS INTEGER) AS col, CAST(200 + (r.v * 13 + c.v * 7 + nx) % 97 AS DOUBLE) AS dem
FROM egrids CROSS JOIN (SELECT unnest(range(40)) AS v) r CROSS JOIN (SELECT unnest(range(40)) AS v) c WHERE r.v < ny AND c.v < nx"""
# GRS80, and the third-flattening series of the inverse transverse Mercator projection.
_E, _E2 = 0.08181919104281579, 0.006694380022900788
_BETA = [0.000837732168164144, 5.90586962608273e-08, 1.6734889049883462e-10, 2.167737805596757e-13]
_SUMS = [
    f"xi - ({' + '.join(f'{b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, b in enumerate(_BETA, 1))})",
    f"eta - ({' + '.join(f'{b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, b in enumerate(_BETA, 1))})",
]
CTES["ecoarse"] = f"""SELECT tile_id, gx, gy, (gx + 0.5) * 60.0 AS cx, (gy + 0.5) * 60.0 AS cy,
  (gy + 0.5) * 60.0 / (0.9996 * 6367449.145771047) AS xi, ((gx + 0.5) * 60.0 - 500000.0) / (0.9996 * 6367449.145771047) AS eta
  FROM (SELECT *, unnest(range(CAST(floor((north - 750.0) / 60.0) AS BIGINT), CAST(ceil((north + 30.0) / 60.0) AS BIGINT))) AS gy FROM
    (SELECT *, unnest(range(CAST(floor((west - 30.0) / 60.0) AS BIGINT), CAST(ceil((west + 750.0) / 60.0) AS BIGINT))) AS gx FROM etiles))"""
CTES["eplane"] = f"SELECT *, {_SUMS[0]} AS xp, {_SUMS[1]} AS ep FROM ecoarse"
CTES["etau0"] = "SELECT *, -3.0 + degrees(atan2(sinh(ep), cos(xp))) AS lon, tan(asin(sin(xp) / cosh(ep))) AS taup, tan(asin(sin(xp) / cosh(ep))) AS tau FROM eplane"
for _i in range(1, 5):
    # Newton's steps from the conformal latitude to the latitude.
    _S = f"sinh({_E!r} * atanh({_E!r} * tau / sqrt(1.0 + tau * tau)))"
    CTES[f"etau{_i}"] = f"""SELECT * EXCLUDE (t), tau + (taup - t) / sqrt(1.0 + t * t) * (1.0 + (1.0 - {_E2!r}) * tau * tau) / ((1.0 - {_E2!r}) * sqrt(1.0 + tau * tau)) AS tau2
      FROM (SELECT *, tau * sqrt(1.0 + {_S} * {_S}) - {_S} * sqrt(1.0 + tau * tau) AS t FROM {'etau0' if _i == 1 else f'(SELECT * EXCLUDE (tau, tau2), tau2 AS tau FROM etau{_i - 1})'})"""
CTES["eplaced"] = """SELECT tile_id, gx, gy, g.item_id, CAST(floor((CASE WHEN epsg = 4326 THEN lon ELSE cx END - x0) / dx) AS INTEGER) AS col,
  CAST(floor((y0 - CASE WHEN epsg = 4326 THEN degrees(atan(tau2)) ELSE cy END) / dy) AS INTEGER) AS row
  FROM etau4 e JOIN egrids g ON CASE WHEN epsg = 4326 THEN lon ELSE cx END >= x0 AND CASE WHEN epsg = 4326 THEN lon ELSE cx END < x0 + nx * dx
    AND CASE WHEN epsg = 4326 THEN degrees(atan(tau2)) ELSE cy END <= y0 AND CASE WHEN epsg = 4326 THEN degrees(atan(tau2)) ELSE cy END > y0 - ny * dy"""
CTES["ecoarsedem"] = "SELECT tile_id, gx, gy, max(CASE WHEN dem <> 216 THEN dem END) AS dem FROM eplaced JOIN ecells USING (item_id, row, col) GROUP BY ALL"


@check(
    "d09_elevation_on_any_grid",
    """SELECT t.tile_id, t.y, t.x, d.dem FROM (SELECT tile_id, west, north, CAST(gy.v AS INTEGER) AS y, CAST(gx.v AS INTEGER) AS x
      FROM etiles CROSS JOIN (SELECT unnest(range(24)) AS v) gy CROSS JOIN (SELECT unnest(range(24)) AS v) gx) t
      JOIN ecoarsedem d ON d.tile_id = t.tile_id AND d.gx = floor((t.west + (t.x + 0.5) * 30.0) / 60.0)
      AND d.gy = ceil((t.north - (t.y + 0.5) * 30.0) / 60.0) - 1""",
)
def d09_any(spark, d):
    """Elevation of items in another grid and in degrees, nearest by two steps, on every tile."""
    tiles, grids, cells = elevation_inputs(spark, d)
    return elevation.elevation_on_pixels(tiles, grids, cells, nodata=216.0)


def elevation_inputs(spark, d):
    """(tiles, grids, cells): for each supplier a tile and two elevation items on grids of their own."""
    s = spread(T.read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).distinct(), "k")
    row, col = (F.col("k") % 40).cast("double"), F.floor(F.col("k") / 40).cast("double")
    tiles = s.select(
        F.col("k").cast("string").alias("tile_id"), F.lit(30).alias("zone"), (400015.0 + 1730.0 * row).alias("west"),
        (4400005.0 + 1990.0 * col).alias("north"), F.lit(24).alias("nx"), F.lit(24).alias("ny"),
    )
    made = lambda item, epsg, x0, y0, dx, dy, n: [
        item.alias("item_id"), F.lit(epsg).alias("epsg"), x0.alias("x0"), y0.alias("y0"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"),
        F.lit(n).alias("nx"), F.lit(n).alias("ny"),
    ]
    plane = tiles.select(*made(F.concat(F.lit("u"), "tile_id"), 25830, F.col("west") - 131.0, F.col("north") + 77.0, 47.0, 47.0, 20))
    degrees = s.select(*made(F.concat(F.lit("g"), F.col("k").cast("string")), 4326, -4.1711 + 0.0203 * row, 39.7507 + 0.0179 * col, 0.0004, 0.0003, 40))
    grids = plane.unionByName(degrees)
    cells = grids.select("item_id", "nx", "ny", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("row"))
    cells = cells.select("item_id", "nx", "row", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("col"))
    value = (200 + (F.col("row") * 13 + F.col("col") * 7 + F.col("nx")) % 97).cast("double")
    return tiles, grids, cells.select("item_id", "row", "col", value.alias("dem"))


_GRAD = """SELECT c.tile_id, c.y, c.x, c.dem,
  CASE WHEN c.x = e.x0 THEN (r.dem - c.dem) / 30 WHEN c.x = e.x1 THEN (c.dem - l.dem) / 30 ELSE (r.dem - l.dem) / 60 END AS dzdx,
  CASE WHEN c.y = e.y0 THEN (b.dem - c.dem) / 30 WHEN c.y = e.y1 THEN (c.dem - t.dem) / 30 ELSE (b.dem - t.dem) / 60 END AS dzdy
FROM {src} c JOIN (SELECT tile_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {src} GROUP BY tile_id) e USING (tile_id)
LEFT JOIN {src} l ON l.tile_id = c.tile_id AND l.y = c.y AND l.x = c.x - 1
LEFT JOIN {src} r ON r.tile_id = c.tile_id AND r.y = c.y AND r.x = c.x + 1
LEFT JOIN {src} t ON t.tile_id = c.tile_id AND t.y = c.y - 1 AND t.x = c.x
LEFT JOIN {src} b ON b.tile_id = c.tile_id AND b.y = c.y + 1 AND b.x = c.x"""


@check("f01_gradient", f"SELECT tile_id, y, x, {rounded(['dzdx', 'dzdy'])} FROM ({_GRAD.format(src='demholes')})")
def f01(spark, d):
    return rnd(terrain.gradient(T.dem_with_holes(spark, d)), ["tile_id", "y", "x"], ["dzdx", "dzdy"])


_ASPECT = "(atan2(-dzdy, -dzdx) + 2 * pi()) % (2 * pi())"
CTES["terrain4"] = f"SELECT tile_id, y, x, dem, atan(sqrt(dzdx * dzdx + dzdy * dzdy)) AS slope, {_ASPECT} AS aspect FROM ({_GRAD.format(src='dem4')})"


@check(
    "c20_slope_aspect_incidence",
    f"""SELECT tile_id, y, x, round(slope, 6) + 0.0 AS slope, round(aspect, 6) + 0.0 AS aspect,
      round(cos(radians(30.0)) * cos(slope) + sin(radians(30.0)) * sin(slope) * cos(radians(135.0) - aspect), 6) + 0.0 AS cos_i FROM (
      SELECT *, atan(sqrt(dzdx * dzdx + dzdy * dzdy)) AS slope, {_ASPECT} AS aspect FROM ({_GRAD.format(src='demholes')}))""",
)
def c20(spark, d):
    from fieldflux.functions.radiation import add_sun

    df = terrain.terrain_table(T.dem_with_holes(spark, d)).withColumns({"sun_elevation": F.lit(60.0), "sun_azimuth": F.lit(135.0)})
    return rnd(add_sun(df), ["tile_id", "y", "x"], ["slope", "aspect", "cos_i"])


@check(
    "e06_strided_mean",
    """SELECT tile_id, round(avg(dem) FILTER ((y - y0) % 64 = 0 AND (x - x0) % 64 = 0), 6) AS elv_ref,
      round(avg(dem) FILTER ((y - y0) % 7 = 0 AND (x - x0) % 7 = 0), 6) AS elv_ref7
      FROM demholes JOIN (SELECT tile_id, min(y) AS y0, min(x) AS x0 FROM demholes GROUP BY tile_id) USING (tile_id) GROUP BY tile_id""",
)
def e06(spark, d):
    dem = T.dem_with_holes(spark, d)
    a = terrain.reference_elevation(dem)
    b = terrain.reference_elevation(dem, 7).withColumnRenamed("elv_ref", "elv_ref7")
    return rnd(a.join(b, "tile_id"), ["tile_id"], ["elv_ref", "elv_ref7"])


# --- quantiles -----------------------------------------------------------------------

CTES["yearidx"] = B.indices("yearly")
_K = ["tile_id", "yr"]
_RANGES = [("ndvi_p05", "NDVI", 0.05), ("ndvi_p95", "NDVI", 0.95), ("ndmi_p05", "NDMI", 0.05), ("ndmi_p95", "NDMI", 0.95)]
CTES["yearranges"] = B.joined_scalars(_K, [B.nearest(_K, n, e, q, "yearidx") for n, e, q in _RANGES], "yearidx")


@check("e04_nearest_quantiles", f"SELECT tile_id, yr, {rounded([r[0] for r in _RANGES])} FROM yearranges")
def e04(spark, d):
    from fieldflux.operators.energy import vegetation_ranges

    return rnd(vegetation_ranges(composed(spark, d, _K), _K), _K, [r[0] for r in _RANGES])


_COND = [("Ts_hot", "lwir11", 0.98, "NDVI <= 0.2"), ("Ts_cold", "lwir11", 0.05, "NDVI >= 0.7 AND NDWI < 0.1"), ("none", "lwir11", 0.5, "NDVI > 2")]


CTES["suppidx"] = B.indices(
    "(SELECT l_suppkey, " + CTES["obs"].split("AS x,")[1].split("FROM lineitem")[0].strip() + " FROM lineitem)"
)


@check(
    "e05_conditional_quantiles",
    f"SELECT l_suppkey, {rounded([c[0] for c in _COND])} FROM ("
    + B.joined_scalars(["l_suppkey"], [B.nearest(["l_suppkey"], n, e, q, "suppidx", w) for n, e, q, w in _COND], "suppidx")
    + ")",
)
def e05(spark, d):
    obs = T.read(spark, d, "lineitem").select("l_suppkey", *[c.alias(n) for n, c in T.band_columns().items()])
    df = indices.add_spectral(obs)
    ranks = [quantiles.Rank(n, F.when(F.expr(w), F.col(e)), q) for n, e, q, w in _COND]
    return rnd(quantiles.order_statistics(df, ["l_suppkey"], ranks), ["l_suppkey"], [c[0] for c in _COND])


@check(
    "f03_rank_in_sorted_group",
    f"""SELECT l_returnflag, {rounded(['q10', 'q50', 'q99'])} FROM ("""
    + B.joined_scalars(
        ["l_returnflag"],
        [B.nearest(["l_returnflag"], n, "l_extendedprice", q, "lineitem") for n, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99))],
        "lineitem",
    )
    + ")",
)
def f03(spark, d):
    v = F.col("l_extendedprice")
    ranks = [quantiles.Rank("q10", v, 0.1), quantiles.Rank("q50", v, 0.5), quantiles.Rank("q99", v, 0.99)]
    li = T.read(spark, d, "lineitem")
    return rnd(quantiles.order_statistics(li, ["l_returnflag"], ranks), ["l_returnflag"], ["q10", "q50", "q99"])


@check(
    "d11_scene_scalars_on_pixels",
    f"SELECT tile_id, yr, y, x, {rounded(['NDVI', 'ndvi_p05', 'ndvi_p95', 'fc'])} FROM ({B.cover('(SELECT * FROM yearidx JOIN yearranges USING (tile_id, yr))')})",
)
def d11(spark, d):
    from fieldflux.operators.energy import vegetation_ranges

    px = composed(spark, d, _K)
    both = attach(indices.add_spectral(px), vegetation_ranges(px, _K), _K)
    return rnd(fluxes.add_cover_fraction(both), ["tile_id", "yr", "y", "x"], ["NDVI", "ndvi_p05", "ndvi_p95", "fc"])


# --- polygons and pixels -------------------------------------------------------------


def parcel_edges(spark, d):
    return geometry.explode_edges(geometry.explode_parts(T.parcels(spark, d), ["row_no", "tile_id"]), ["row_no", "tile_id"])


def members(spark, d):
    return rasterize.pixels_of(parcel_edges(spark, d), ["row_no", "tile_id"], 40, 40)


@check("d08_pixels_in_parcels", "SELECT row_no, tile_id, y, x FROM members")
def d08(spark, d):
    return members(spark, d)


@check(
    "b10_clip_to_area",
    f"""SELECT tile_id, yr, y, x, {rounded(['red', 'lwir11'])} FROM yearly JOIN (
      SELECT row_no, 3.0 + tile_id AS xa, 20.5 AS xb, 4.25 AS ya, 30.0 - tile_id AS yb, tile_id FROM cust WHERE row_no < 4) USING (tile_id)
      WHERE x >= floor(xa) AND x <= floor(xb) AND y >= floor(ya) AND y <= floor(yb)""",
)
def b10(spark, d):
    tile = F.col("s_suppkey") % 4
    areas = T.read(spark, d, "supplier").select(tile.cast("int").alias("tile_id")).distinct()
    t = F.col("tile_id")
    xa, xb, ya, yb = F.lit(3.0) + t, F.lit(20.5), F.lit(4.25), F.lit(30.0) - t
    geom = T._shape(xa, ya, xb - xa, yb - ya, F.lit(False))
    edges = geometry.explode_edges(geometry.explode_parts(areas.withColumn("geometry", geom), ["tile_id"]), ["tile_id"])
    px = rasterize.clip_to_area(composed(spark, d, ["tile_id", "yr"]), edges, 40, 40)
    return rnd(px, ["tile_id", "yr", "y", "x"], ["red", "lwir11"])


_ZV = ["NDVI", "NDWI", "lwir11"]
_ZAGG = ", ".join(
    f"round(avg({v}), 6) + 0.0 AS {v}_mean, round(stddev_pop({v}), 6) + 0.0 AS {v}_std, count({v}) AS {v}_pixcount" for v in _ZV
)
CTES["zstats"] = f"""SELECT m.row_no, p.tile_id, p.yr, {_ZAGG} FROM members m JOIN yearidx p
  ON p.tile_id = m.tile_id AND p.y = m.y AND p.x = m.x GROUP BY m.row_no, p.tile_id, p.yr"""
_ZOUT = ", ".join(f"z.{v}_mean, z.{v}_std, coalesce(z.{v}_pixcount, 0) AS {v}_pixcount" for v in _ZV)
CTES["zfull"] = f"""SELECT c.row_no, c.tile_id, s.yr, {_ZOUT} FROM cust c JOIN (SELECT DISTINCT tile_id, yr FROM yearly) s USING (tile_id)
  LEFT JOIN zstats z ON z.row_no = c.row_no AND z.tile_id = c.tile_id AND z.yr = s.yr"""


def zonal_table(spark, d):
    px = indices.add_spectral(composed(spark, d, _K))
    stats = zonal.zonal_statistics(px, members(spark, d), _K, ["row_no"], _ZV)
    dates = T.observations(spark, d).select(*_K).distinct()
    expected = attach(T.parcels(spark, d).select("row_no", "tile_id"), dates, ["tile_id"], "inner")
    full = zonal.with_empty_parcels(stats, expected, _ZV)
    cols = [f"{v}_{s}" for v in _ZV for s in ("mean", "std")]
    return full.withColumns({c: F.round(c, 6) for c in cols})


@check("e07_zonal_statistics", "SELECT * FROM zfull")
def e07(spark, d):
    return zonal_table(spark, d)


_MINC = "least(" + ", ".join(f"{v}_pixcount" for v in _ZV) + ")"


@check("b04_minimum_pixels", f"SELECT row_no, tile_id, yr, {_MINC} AS n FROM zfull WHERE {_MINC} > 3")
def b04(spark, d):
    z = zonal_table(spark, d).where(zonal.enough_pixels(_ZV))
    return z.select("row_no", "tile_id", "yr", zonal.smallest_count(_ZV).alias("n"))


@check(
    "b12_drop_accounting",
    f"""SELECT tile_id, yr, count(*) AS n_parcels, count(*) FILTER ({_MINC} > 3) AS n_kept,
      count(*) FILTER ({_MINC} <= 3) AS n_dropped FROM zfull GROUP BY GROUPING SETS ((tile_id, yr), ())""",
)
def b12(spark, d):
    from fieldflux.operators.scenes import drop_accounting

    return drop_accounting(zonal_table(spark, d), _K, zonal.enough_pixels(_ZV))
