"""Stand-in pixel, scene, wind and parcel tables derived from the given tables, in Spark and
(as named sub-queries) in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldflux.constants import BANDS, PARCEL_KEY

from fieldflux.scratch import spread

from .registry import CTES


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- observations --------------------------------------------------------------------


def band_columns() -> dict[str, Column]:
    q, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    rest = F.lit(1) - q / F.lit(50)
    return {
        "red": F.lit(0.03) + F.lit(0.25) * rest + F.lit(0.1) * tax,
        "green": F.lit(0.05) + F.lit(0.10) * rest + F.lit(0.05) * tax,
        "blue": F.lit(0.03) + F.lit(0.08) * rest,
        "nir08": F.lit(0.26) + F.lit(0.26) * (q / F.lit(50)) + F.lit(0.2) * disc,
        "swir16": F.lit(0.12) + F.lit(0.20) * rest + F.lit(0.1) * disc,
        "swir22": F.lit(0.08) + F.lit(0.18) * rest,
        "lwir11": F.lit(318) - F.lit(20) * (q / F.lit(50)) + F.lit(40) * disc,
    }


def observations(spark, d) -> DataFrame:
    """tile_id, yr, y, x and seven bands, one row per line item (plus its own key)."""
    li = read(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_suppkey") % 4).cast("int").alias("tile_id"),
        F.year("l_shipdate").alias("yr"),
        (F.col("l_orderkey") % 40).cast("int").alias("y"),
        (F.col("l_partkey") % 40).cast("int").alias("x"),
        *[c.alias(n) for n, c in band_columns().items()],
    )


CTES["obs"] = """
SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 4 AS INTEGER) AS tile_id,
  CAST(year(l_shipdate) AS INTEGER) AS yr,
  CAST(l_orderkey % 40 AS INTEGER) AS y, CAST(l_partkey % 40 AS INTEGER) AS x,
  0.03 + 0.25 * (1 - l_quantity / 50) + 0.1 * l_tax AS red,
  0.05 + 0.10 * (1 - l_quantity / 50) + 0.05 * l_tax AS green,
  0.03 + 0.08 * (1 - l_quantity / 50) AS blue,
  0.26 + 0.26 * (l_quantity / 50) + 0.2 * l_discount AS nir08,
  0.12 + 0.20 * (1 - l_quantity / 50) + 0.1 * l_discount AS swir16,
  0.08 + 0.18 * (1 - l_quantity / 50) AS swir22,
  318 - 20 * (l_quantity / 50) + 40 * l_discount AS lwir11
FROM lineitem"""

_MED = ", ".join(f"round(median({b}), 6) AS {b}" for b in BANDS)
CTES["composite"] = f"SELECT tile_id, y, x, {_MED} FROM obs GROUP BY tile_id, y, x"
CTES["yearly"] = f"SELECT tile_id, yr, y, x, {_MED} FROM obs GROUP BY tile_id, yr, y, x"


# --- elevation -----------------------------------------------------------------------


def dem(spark, d, tiles: int | None = 4) -> DataFrame:
    """A dense 40 x 40 grid per tile; tiles=None takes every supplier as a tile."""
    s = F.col("s_suppkey")
    tile = (s % tiles).cast("int") if tiles else s.cast("int")
    t = read(spark, d, "supplier").select(tile.alias("tile_id")).distinct()
    g = spread(t, "tile_id").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39))))
    g = g.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39))))
    y, x = F.col("y"), F.col("x")
    return g.withColumn("dem", (200 + 6 * y + 4 * x + 10 * ((y * 7 + x * 3) % 5)).cast("double"))


_DEM = "CAST(200 + 6 * y + 4 * x + 10 * ((y * 7 + x * 3) % 5) AS DOUBLE) AS dem"
_GRID = """CAST(gy.v AS INTEGER) AS y, CAST(gx.v AS INTEGER) AS x
FROM tiles CROSS JOIN (SELECT unnest(range(40)) AS v) gy CROSS JOIN (SELECT unnest(range(40)) AS v) gx"""
CTES["dem4"] = f"""SELECT *, {_DEM} FROM (SELECT tile_id, {_GRID.replace('tiles', '(SELECT DISTINCT CAST(s_suppkey % 4 AS INTEGER) AS tile_id FROM supplier) t')})"""
CTES["dems"] = f"""SELECT *, {_DEM} FROM (SELECT tile_id, {_GRID.replace('tiles', '(SELECT DISTINCT CAST(s_suppkey AS INTEGER) AS tile_id FROM supplier) t')})"""
CTES["demholes"] = "SELECT * FROM dems WHERE (y * 31 + x * 17 + tile_id) % 23 <> 0"


def dem_with_holes(spark, d) -> DataFrame:
    return dem(spark, d, None).where("(y * 31 + x * 17 + tile_id) % 23 <> 0")


# --- parcels in pixel units ----------------------------------------------------------


def _ring(*points) -> Column:
    return F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in points])


def _shape(x0, y0, w, h, triangle) -> Column:
    tri = _ring((x0, y0), (x0 + w, y0), (x0, y0 + h), (x0, y0))
    rect = _ring((x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h), (x0, y0))
    return F.array(F.array(F.when(triangle, tri).otherwise(rect)))


def parcels(spark, d) -> DataFrame:
    """Keys, label, crop and a polygon in the pixel units of tile_id, one per customer."""
    i = F.col("c_custkey")
    x0, y0 = ((i * 7) % 34).cast("double"), ((i * 11) % 34).cast("double")
    w, h = (1 + i % 6).cast("double"), (1 + F.floor(i / 6) % 5).cast("double")
    keys = {
        "provincia": F.col("c_nationkey").cast("int"),
        "municipio": (i % 50).cast("int"),
        **{k: F.lit(0) for k in PARCEL_KEY[2:]},
    }
    label = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "R").when(
        F.col("c_mktsegment") != "HOUSEHOLD", "S"
    )
    return read(spark, d, "customer").select(
        i.alias("row_no"),
        *[c.alias(k) for k, c in keys.items()],
        (i % 3).cast("int").alias("source"),
        (i % 4).cast("int").alias("tile_id"),
        F.col("c_acctbal").alias("coef_regadio"),
        F.col("c_mktsegment").alias("parc_producto"),
        label.alias("parc_sistexp"),
        _shape(x0, y0, w, h, i % 5 == 0).alias("geometry"),
    )


CTES["cust"] = """
SELECT c_custkey AS row_no, CAST(c_nationkey AS INTEGER) AS provincia, CAST(c_custkey % 50 AS INTEGER) AS municipio,
  0 AS agregado, 0 AS zona, 0 AS poligono, 0 AS parcela, 0 AS recinto,
  CAST(c_custkey % 3 AS INTEGER) AS source, CAST(c_custkey % 4 AS INTEGER) AS tile_id,
  c_acctbal AS coef_regadio, c_mktsegment AS parc_producto,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'R' WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'S' END AS parc_sistexp,
  CAST((c_custkey * 7) % 34 AS DOUBLE) AS x0, CAST((c_custkey * 11) % 34 AS DOUBLE) AS y0,
  CAST(1 + c_custkey % 6 AS DOUBLE) AS w, CAST(1 + (c_custkey // 6) % 5 AS DOUBLE) AS h, c_custkey % 5 = 0 AS tri
FROM customer"""


def _edges_sql(src: str, keep: str) -> str:
    return f"""
SELECT {keep}, x0 AS x1, y0 AS y1, x0 + w AS x2, y0 AS y2 FROM {src}
UNION ALL SELECT {keep}, x0 + w, y0, x0 + w, y0 + h FROM {src} WHERE NOT tri
UNION ALL SELECT {keep}, x0 + w, y0 + h, x0, y0 + h FROM {src} WHERE NOT tri
UNION ALL SELECT {keep}, x0 + w, y0, x0, y0 + h FROM {src} WHERE tri
UNION ALL SELECT {keep}, x0, y0 + h, x0, y0 FROM {src}"""


CTES["edges"] = _edges_sql("cust", "row_no, tile_id")
CTES["cells"] = """
SELECT row_no, tile_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (
  SELECT row_no, tile_id, y, unnest(range(CAST(x0 AS BIGINT), CAST(x0 + w AS BIGINT))) AS x FROM (
    SELECT *, unnest(range(CAST(y0 AS BIGINT), CAST(y0 + h AS BIGINT))) AS y FROM cust))"""
CTES["members"] = """
SELECT c.row_no, c.tile_id, c.y, c.x FROM cells c JOIN edges e ON c.row_no = e.row_no
WHERE (e.y1 > c.y + 0.5) <> (e.y2 > c.y + 0.5)
  AND (e.x2 - e.x1) * (c.y + 0.5 - e.y1) / (e.y2 - e.y1) + e.x1 > c.x + 0.5
GROUP BY c.row_no, c.tile_id, c.y, c.x HAVING count(*) % 2 = 1"""


# --- parcels in degrees --------------------------------------------------------------


def geo_parcels(spark, d) -> DataFrame:
    """parcel_uid and a lon/lat polygon, over three UTM zones."""
    i = F.col("c_custkey")
    lon, lat = F.lit(-9.0) + (i * 37 % 1300) / F.lit(100.0), F.lit(36.0) + (i * 53 % 750) / F.lit(100.0)
    w, h = F.lit(0.002) + F.lit(0.001) * (i % 6), F.lit(0.002) + F.lit(0.001) * (i % 4)
    return read(spark, d, "customer").select(
        i.alias("parcel_uid"), _shape(lon, lat, w, h, i % 5 == 0).alias("geometry")
    )


CTES["geo"] = """
SELECT c_custkey AS parcel_uid, -9.0 + (c_custkey * 37 % 1300) / 100.0 AS x0, 36.0 + (c_custkey * 53 % 750) / 100.0 AS y0,
  0.002 + 0.001 * (c_custkey % 6) AS w, 0.002 + 0.001 * (c_custkey % 4) AS h, c_custkey % 5 = 0 AS tri
FROM customer"""
CTES["geoedges"] = _edges_sql("geo", "parcel_uid, x0 AS ox, y0 AS oy")


# --- scenes --------------------------------------------------------------------------


def scenes(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lon, lat = F.lit(-12.0) + (k * 13 % 1800) / F.lit(100.0), F.lit(34.0) + (k * 29 % 1100) / F.lit(100.0)
    platform = F.when(F.col("o_orderstatus") == "F", "landsat-8").when(F.col("o_orderstatus") == "O", "landsat-9")
    hours = (k % 700).cast("bigint") * 60 + k % 60
    return read(spark, d, "orders").select(
        k.alias("item_id"),
        (c % 4).cast("int").alias("tile_id"),
        F.col("o_orderdate").alias("datetime"),
        platform.otherwise("landsat-7").alias("platform"),
        ((k % 20) * F.lit(0.5)).alias("cloud"),
        (F.lit(50) + c % 20).cast("double").alias("sun_elevation"),
        (F.lit(120) + k % 40).cast("double").alias("sun_azimuth"),
        lon.alias("lon_min"),
        lat.alias("lat_min"),
        (lon + F.lit(2.0)).alias("lon_max"),
        (lat + F.lit(1.75)).alias("lat_max"),
        F.timestamp_add("MINUTE", hours, F.lit("2024-01-01").cast("timestamp_ntz")).alias("wind_ts"),
    )


CTES["scenes"] = """
SELECT o_orderkey AS item_id, CAST(o_custkey % 4 AS INTEGER) AS tile_id, o_orderdate AS datetime,
  CASE o_orderstatus WHEN 'F' THEN 'landsat-8' WHEN 'O' THEN 'landsat-9' ELSE 'landsat-7' END AS platform,
  (o_orderkey % 20) * 0.5 AS cloud, CAST(50 + o_custkey % 20 AS DOUBLE) AS sun_elevation,
  CAST(120 + o_orderkey % 40 AS DOUBLE) AS sun_azimuth,
  -12.0 + (o_orderkey * 13 % 1800) / 100.0 AS lon_min, 34.0 + (o_orderkey * 29 % 1100) / 100.0 AS lat_min,
  -12.0 + (o_orderkey * 13 % 1800) / 100.0 + 2.0 AS lon_max, 34.0 + (o_orderkey * 29 % 1100) / 100.0 + 1.75 AS lat_max,
  TIMESTAMP '2024-01-01' + to_minutes(CAST((o_orderkey % 700) * 60 + o_orderkey % 60 AS INTEGER)) AS wind_ts
FROM orders"""


def tile_boxes(spark, d) -> DataFrame:
    """Geographic boxes of about half a degree, one per customer."""
    i = F.col("c_custkey")
    lon, lat = F.lit(-9.0) + (i * 37 % 1300) / F.lit(100.0), F.lit(36.0) + (i * 53 % 750) / F.lit(100.0)
    return read(spark, d, "customer").select(
        i.alias("tile_id"),
        lon.alias("lon_min"),
        lat.alias("lat_min"),
        (lon + F.lit(0.5)).alias("lon_max"),
        (lat + F.lit(0.5)).alias("lat_max"),
    )


CTES["boxes"] = "SELECT parcel_uid AS tile_id, x0 AS lon_min, y0 AS lat_min, x0 + 0.5 AS lon_max, y0 + 0.5 AS lat_max FROM geo"


# --- wind ----------------------------------------------------------------------------


def wind(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        ((F.col("user_id") % 8) * F.lit(0.25)).alias("lon_key"),
        (F.lit(42) + (F.col("event_id") % 4) * F.lit(0.25)).alias("lat_key"),
    ).agg(
        (F.avg("value") / F.lit(20)).alias("u10"), (F.avg(F.col("event_id") % 17) / F.lit(4)).alias("v10")
    )


CTES["wind"] = """
SELECT date_trunc('hour', ts) AS hour, (user_id % 8) * 0.25 AS lon_key, 42 + (event_id % 4) * 0.25 AS lat_key,
  avg(value) / 20 AS u10, avg(event_id % 17) / 4 AS v10
FROM events GROUP BY ALL"""


# --- dated statistics, features, scores ----------------------------------------------

STAT_VARS = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}


def dated(spark, d) -> DataFrame:
    """Statistics per part and year in the shape of dated parcel statistics."""
    li = read(spark, d, "lineitem")
    aggs = []
    for n, c in STAT_VARS.items():
        aggs += [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"), F.count(c).alias(f"{n}_pixcount")]
    return li.groupBy("l_partkey", F.year("l_shipdate").alias("yr")).agg(*aggs)


_STATS = ", ".join(
    f"avg({c}) AS {n}_mean, stddev_pop({c}) AS {n}_std, count({c}) AS {n}_pixcount" for n, c in STAT_VARS.items()
)
CTES["dated"] = f"SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS yr, {_STATS} FROM lineitem GROUP BY ALL"
_TRAJ = ", ".join(f"avg({n}_mean) AS {n}_mean_mean, stddev_samp({n}_mean) AS {n}_mean_std" for n in STAT_VARS)
CTES["traj"] = f"SELECT l_partkey, {_TRAJ} FROM dated GROUP BY l_partkey"
CTES["labels3"] = """
SELECT l_partkey, CAST(round(avg(l_discount) + 0.3 * avg(l_tax), 9) > 0.0625 AS INTEGER) AS irrigated_label
FROM lineitem GROUP BY l_partkey"""


def part_labels(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem")
    mark = F.round(F.avg("l_discount") + F.lit(0.3) * F.avg("l_tax"), 9) > 0.0625
    return li.groupBy("l_partkey").agg(mark.cast("int").alias("irrigated_label"))


def features(spark, d) -> DataFrame:
    """Trajectory features, crop and label per part."""
    from fieldflux.operators.features import trajectory

    t = trajectory(dated(spark, d), ["l_partkey"])
    crop = read(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("parc_producto")
    )
    return t.join(part_labels(spark, d), "l_partkey").join(crop, "l_partkey", "left")


CTES["feats"] = """
SELECT t.*, l.irrigated_label, p.p_type AS parc_producto
FROM traj t JOIN labels3 l USING (l_partkey) LEFT JOIN part p ON p.p_partkey = t.l_partkey"""


def scores(spark, d) -> DataFrame:
    """A fixed score table with ties and exact threshold hits: uid, model, label, prediction, proba."""
    p = F.round((F.col("l_partkey") * 37 % 101) / F.lit(100), 2)
    base = part_labels(spark, d).select(
        F.col("l_partkey").alias("uid"),
        F.when(F.col("l_partkey") % 2 == 0, "even").otherwise("odd").alias("model"),
        F.col("irrigated_label").alias("label"),
        p.alias("proba"),
    )
    return base.withColumn("prediction", (F.col("proba") >= 0.5).cast("int"))


CTES["scores"] = """
SELECT *, CAST(proba >= 0.5 AS INTEGER) AS prediction FROM (
  SELECT l_partkey AS uid, CASE WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS model,
    irrigated_label AS label, round((l_partkey * 37 % 101) / 100, 2) AS proba FROM labels3)"""
CTES["confm"] = """
SELECT model, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn
FROM scores GROUP BY model"""
