"""The parcel register, tile grids and the assignment of parcels to tiles."""

from pyspark.sql import functions as F

from fieldflux.constants import PARCEL_KEY
from fieldflux.operators import features, geometry, grid, parcels
from fieldflux.sources import tables

from . import testbed as T
from .registry import CTES, check, rnd, rounded
from .scalars import laea_inverse_sql, utm_sql  # noqa: F401

KEY = ", ".join(PARCEL_KEY)
SCOPE = [1, 2, 3, 5, 8, 13, 21]


def recintos(spark, d):
    return T.parcels(spark, d).drop("parc_producto", "parc_sistexp", "tile_id")


def declared(spark, d):
    """Every row; one in ten under a province that no parcel has."""
    p = T.parcels(spark, d)
    away = F.when(F.col("row_no") % 10 == 0, F.col("provincia") + 1000).otherwise(F.col("provincia"))
    return p.withColumn("provincia", away.cast(p.schema["provincia"].dataType)).select(*PARCEL_KEY, "source", "parc_producto", "parc_sistexp")


CTES["declared"] = f"""SELECT {KEY}, source, parc_producto, parc_sistexp FROM (SELECT * REPLACE (
  CAST(CASE WHEN row_no % 10 = 0 THEN provincia + 1000 ELSE provincia END AS INTEGER) AS provincia) FROM cust)"""
_IN = ", ".join(str(s) for s in SCOPE)


@check("a01_parcel_scan", f"SELECT {KEY}, source, coef_regadio FROM cust WHERE provincia IN ({_IN})")
def a01(spark, d):
    return tables.in_provinces(recintos(spark, d), SCOPE).select(*PARCEL_KEY, "source", "coef_regadio")


@check(
    "a02_declaration_scan",
    f"SELECT {KEY}, parc_producto, parc_sistexp FROM declared WHERE provincia IN ({_IN})",
)
def a02(spark, d):
    return tables.in_provinces(declared(spark, d), SCOPE).select(*PARCEL_KEY, "parc_producto", "parc_sistexp")


CTES["joined"] = f"""SELECT r.* EXCLUDE (parc_producto, parc_sistexp), c.parc_producto, c.parc_sistexp
FROM cust r JOIN declared c USING ({KEY}, source)"""


def joined(spark, d):
    return parcels.join_declarations(recintos(spark, d), declared(spark, d))


@check("d01_parcels_with_declarations", f"SELECT {KEY}, source, row_no, coef_regadio, parc_producto, parc_sistexp FROM joined")
def d01(spark, d):
    return joined(spark, d).drop("geometry")


@check(
    "g01_union_of_sources",
    f"SELECT {KEY}, row_no, parc_producto, parc_sistexp FROM joined",
)
def g01(spark, d):
    rec, dec = recintos(spark, d), declared(spark, d)
    per = [
        parcels.join_declarations(rec.where(F.col("source") == s), dec.where(F.col("source") == s)) for s in range(3)
    ]
    return parcels.union_sources(per).select(*PARCEL_KEY, "row_no", "parc_producto", "parc_sistexp")


@check("b01_drop_unlabeled", f"SELECT {KEY}, row_no, parc_sistexp FROM cust WHERE parc_sistexp IS NOT NULL")
def b01(spark, d):
    return parcels.drop_unlabeled(T.parcels(spark, d)).select(*PARCEL_KEY, "row_no", "parc_sistexp")


@check(
    "b02_binary_label",
    "SELECT row_no, CAST(parc_sistexp = 'R' AS INTEGER) AS irrigated_label FROM cust WHERE parc_sistexp IS NOT NULL",
)
def b02(spark, d):
    return parcels.add_label(parcels.drop_unlabeled(T.parcels(spark, d))).select("row_no", "irrigated_label")


@check("b03_parcel_uid", f"SELECT row_no, concat_ws('_', {KEY}) AS parcel_uid FROM cust")
def b03(spark, d):
    return T.parcels(spark, d).select("row_no", parcels.parcel_uid().alias("parcel_uid"))


CTES["labeled"] = "SELECT *, CAST(parc_sistexp = 'R' AS INTEGER) AS irrigated_label FROM cust WHERE parc_sistexp IS NOT NULL"


@check("e10_duplicate_keys", f"SELECT {KEY}, count(*) AS n_rows FROM labeled GROUP BY {KEY} HAVING count(*) > 1")
def e10(spark, d):
    return parcels.duplicate_groups(parcels.drop_unlabeled(T.parcels(spark, d)))


CTES["conflicts"] = f"SELECT {KEY} FROM labeled GROUP BY {KEY} HAVING count(DISTINCT parc_sistexp) > 1"


@check("e11_label_conflicts", f"SELECT {KEY} FROM conflicts")
def e11(spark, d):
    return parcels.conflicting_keys(parcels.drop_unlabeled(T.parcels(spark, d)))


CTES["agreed"] = f"SELECT l.* FROM labeled l LEFT JOIN (SELECT *, 1 AS bad FROM conflicts) c USING ({KEY}) WHERE bad IS NULL"


@check("d06_conflict_exclusion", f"SELECT {KEY}, row_no, parc_sistexp FROM agreed")
def d06(spark, d):
    return parcels.drop_conflicts(parcels.drop_unlabeled(T.parcels(spark, d))).select(*PARCEL_KEY, "row_no", "parc_sistexp")


def usable(spark, d):
    """Labelled, agreeing rows; a crop is missing for some so that the first present one counts."""
    df = parcels.drop_conflicts(parcels.add_label(parcels.drop_unlabeled(T.parcels(spark, d))))
    return df.withColumn("parc_producto", F.when(F.col("row_no") % 4 != 1, F.col("parc_producto")))


_FIRST = """arg_min({c}, source * 1000000000 + row_no) FILTER ({c} IS NOT NULL) AS {c}"""
_DISSOLVED = ", ".join(_FIRST.format(c=c) for c in ("coef_regadio", "crop", "parc_sistexp", "irrigated_label"))
CTES["dissolved"] = f"""SELECT {KEY}, {_DISSOLVED} FROM (
  SELECT *, CASE WHEN row_no % 4 <> 1 THEN parc_producto END AS crop FROM agreed) GROUP BY {KEY}"""


@check(
    "e12_dissolve_attributes",
    f"SELECT {KEY}, coef_regadio, crop AS parc_producto, parc_sistexp, irrigated_label FROM dissolved",
)
def e12(spark, d):
    return parcels.dissolve_attributes(usable(spark, d).drop("tile_id"), ["source", "row_no"])


@check(
    "e12_dissolve_geometry",
    f"""SELECT {KEY}, y, x FROM agreed a JOIN members m USING (row_no) GROUP BY {KEY}, y, x""",
)
def e12_geometry(spark, d):
    """A dissolved parcel covers the union of its rows' pixels, each once."""
    from fieldflux.operators.rasterize import pixels_of

    parts = parcels.dissolve_parts(usable(spark, d))
    return pixels_of(geometry.explode_edges(parts, PARCEL_KEY), PARCEL_KEY, 40, 40)


@check("g02_unique_and_dissolved", f"SELECT concat_ws('_', {KEY}) AS parcel_uid, parc_sistexp, irrigated_label FROM dissolved")
def g02(spark, d):
    attributes, _ = parcels.clean_parcels(T.parcels(spark, d).drop("tile_id"), ["source", "row_no"])
    return attributes.select("parcel_uid", "parc_sistexp", "irrigated_label")


@check(
    "e14_class_balance",
    """SELECT count(*) AS n_parcels, count(*) FILTER (irrigated_label = 1) AS n_irrigated,
      count(*) FILTER (irrigated_label = 0) AS n_rainfed, round(avg(irrigated_label), 6) AS share_irrigated FROM dissolved""",
)
def e14(spark, d):
    attributes, _ = parcels.clean_parcels(T.parcels(spark, d).drop("tile_id"), ["source", "row_no"])
    return parcels.class_balance(attributes).withColumn("share_irrigated", F.round("share_irrigated", 6))


# Shapes with defects: bow-ties, open rings, zero area.
_BROKEN = """CASE WHEN row_no % 7 = 0 THEN 'bow' WHEN row_no % 11 = 0 THEN 'flat' WHEN row_no % 13 = 0 THEN 'open' ELSE 'fine' END"""


def broken(spark, d):
    i = F.col("row_no")
    x0, y0 = ((i * 7) % 34).cast("double"), ((i * 11) % 34).cast("double")
    w, h = (1 + i % 6).cast("double"), (1 + F.floor(i / 6) % 5).cast("double")
    one = lambda *pts: F.array(F.array(T._ring(*pts)))
    bow = one((x0, y0), (x0 + w, y0 + h), (x0 + w, y0), (x0, y0 + h), (x0, y0))
    flat = one((x0, y0), (x0 + w, y0), (x0 + w * 2, y0), (x0, y0))
    opened = one((x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h))
    kind = F.expr(_BROKEN)
    shape = F.when(kind == "bow", bow).when(kind == "flat", flat).when(kind == "open", opened).otherwise(F.col("geometry"))
    return T.parcels(spark, d).withColumn("geometry", shape)


CTES["broken"] = f"SELECT row_no, {_BROKEN} AS kind, parc_sistexp FROM cust"
# A bow-tie through the corners of a rectangle has lobes of equal and opposite area.


@check(
    "c12_geometry_validity",
    """SELECT row_no, kind <> 'open' AS closed, true AS long_enough, kind NOT IN ('bow', 'flat') AS has_area,
      kind = 'bow' AS crossing, kind = 'fine' AS is_valid FROM broken""",
)
def c12(spark, d):
    return geometry.validity(broken(spark, d), ["row_no"])


@check(
    "c12_even_odd_repair",
    """SELECT c.row_no, count(*) AS n_pixels FROM cells c JOIN cust k USING (row_no) WHERE row_no % 7 = 0 AND (
      CASE WHEN (c.x + 0.5 - k.x0) / k.w < 0.5 THEN (c.y + 0.5 - k.y0) / k.h >= (c.x + 0.5 - k.x0) / k.w AND (c.y + 0.5 - k.y0) / k.h < 1 - (c.x + 0.5 - k.x0) / k.w
      ELSE (c.y + 0.5 - k.y0) / k.h < (c.x + 0.5 - k.x0) / k.w AND (c.y + 0.5 - k.y0) / k.h >= 1 - (c.x + 0.5 - k.x0) / k.w END)
      AND abs((c.y + 0.5 - k.y0) / k.h - (c.x + 0.5 - k.x0) / k.w) > 1e-9
      AND abs((c.y + 0.5 - k.y0) / k.h - 1 + (c.x + 0.5 - k.x0) / k.w) > 1e-9 GROUP BY c.row_no""",
)
def c12_repair(spark, d):
    """Even-odd filling gives the two lobes of a bow-tie (centers on an outline left aside)."""
    from fieldflux.operators.rasterize import pixels_of

    bows = broken(spark, d).where("row_no % 7 = 0")
    edges = geometry.explode_edges(geometry.explode_parts(bows, ["row_no"]), ["row_no"])
    i = F.col("row_no")
    fx = (F.col("x") + 0.5 - (i * 7) % 34) / (1 + i % 6)
    fy = (F.col("y") + 0.5 - (i * 11) % 34) / (1 + F.floor(i / 6) % 5)
    off = (F.abs(fy - fx) > 1e-9) & (F.abs(fy - 1 + fx) > 1e-9)
    return pixels_of(edges, ["row_no"], 40, 40).where(off).groupBy("row_no").agg(F.count(F.lit(1)).alias("n_pixels"))


@check(
    "c12_even_odd_repair_all",
    """SELECT row_no, count(*) AS n_pixels FROM (
      SELECT row_no FROM members JOIN broken USING (row_no) WHERE kind = 'fine' UNION ALL
      SELECT c.row_no FROM cells c JOIN cust k USING (row_no) JOIN broken b USING (row_no) WHERE b.kind = 'bow' AND (
      CASE WHEN (c.x + 0.5 - k.x0) / k.w < 0.5 THEN (c.y + 0.5 - k.y0) / k.h >= (c.x + 0.5 - k.x0) / k.w AND (c.y + 0.5 - k.y0) / k.h < 1 - (c.x + 0.5 - k.x0) / k.w
      ELSE (c.y + 0.5 - k.y0) / k.h < (c.x + 0.5 - k.x0) / k.w AND (c.y + 0.5 - k.y0) / k.h >= 1 - (c.x + 0.5 - k.x0) / k.w END)
      AND abs((c.y + 0.5 - k.y0) / k.h - (c.x + 0.5 - k.x0) / k.w) > 1e-9
      AND abs((c.y + 0.5 - k.y0) / k.h - 1 + (c.x + 0.5 - k.x0) / k.w) > 1e-9) GROUP BY row_no""",
)
def c12_repair_all(spark, d):
    """Even-odd filling of every closed shape: lobes of bow-ties, nothing of flat ones, others as they are."""
    from fieldflux.operators.rasterize import pixels_of

    shapes = broken(spark, d)
    # An open ring has no inside; validity reports it.
    closed = geometry.validity(shapes, ["row_no"]).where("closed").select("row_no")
    edges = geometry.explode_edges(geometry.explode_parts(shapes.join(closed, "row_no"), ["row_no"]), ["row_no"])
    i = F.col("row_no")
    fx = (F.col("x") + 0.5 - (i * 7) % 34) / (1 + i % 6)
    fy = (F.col("y") + 0.5 - (i * 11) % 34) / (1 + F.floor(i / 6) % 5)
    on_outline = (F.expr(_BROKEN) == "bow") & ((F.abs(fy - fx) <= 1e-9) | (F.abs(fy - 1 + fx) <= 1e-9))
    return pixels_of(edges, ["row_no"], 40, 40).where(~on_outline).groupBy("row_no").agg(F.count(F.lit(1)).alias("n_pixels"))


@check(
    "e16_defect_accounting",
    """SELECT count(*) AS n_before, count(*) FILTER (parc_sistexp IS NULL) AS n_null_label,
      count(*) FILTER (parc_sistexp IS NOT NULL) AS n_kept, count(*) FILTER (kind <> 'fine') AS n_invalid FROM broken""",
)
def e16(spark, d):
    df = broken(spark, d)
    invalid = geometry.validity(df, ["row_no"]).agg(F.count_if(~F.col("is_valid")).alias("n_invalid"))
    return parcels.label_accounting(df).select("*", invalid.scalar().alias("n_invalid"))


# --- grids ---------------------------------------------------------------------------

CTES["geozone"] = """SELECT parcel_uid, CASE WHEN z BETWEEN 28 AND 38 THEN 25800 + z ELSE 32600 + z END AS epsg, z AS zone FROM (
  SELECT parcel_uid, CAST(floor(((CASE WHEN tri THEN x0 + w / 3 ELSE x0 + w / 2 END) + 180.0) / 6.0) + 1 AS INTEGER) AS z FROM geo)"""
CTES["zonebox"] = f"""SELECT epsg, zone, min(ux) AS minx, min(uy) AS miny, max(ux) AS maxx, max(uy) AS maxy FROM (
  {utm_sql('(SELECT * FROM geoedges JOIN geozone USING (parcel_uid))', 'x1', 'y1', 'zone', 'ux', 'uy')}) GROUP BY epsg, zone"""
CTES["cellbox"] = "SELECT *, CAST(ceil((maxx - minx) / 50000.0) AS INTEGER) AS nx, CAST(ceil((maxy - miny) / 50000.0) AS INTEGER) AS ny FROM zonebox"
CTES["tiles"] = """SELECT epsg || '_' || (ix * ny + iy) AS tile_id, epsg, zone, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy,
  minx + ix * 50000.0 AS minx, miny + iy * 50000.0 AS miny FROM (
  SELECT *, unnest(range(ny)) AS iy FROM (SELECT *, unnest(range(nx)) AS ix FROM cellbox))"""
_CAND = utm_sql("(SELECT c.parcel_uid, c.lon, c.lat, b.* FROM geocenter c CROSS JOIN cellbox b)", "lon", "lat", "zone", "ux", "uy")
CTES["candidates"] = f"""SELECT parcel_uid, epsg || '_' || (ix * ny + iy) AS tile_id, epsg, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM (
  SELECT *, floor((ux - minx) / 50000.0)::BIGINT AS ix, floor((uy - miny) / 50000.0)::BIGINT AS iy FROM ({_CAND}))
  WHERE ix >= 0 AND ix < nx AND iy >= 0 AND iy < ny AND ux > minx + ix * 50000.0 AND uy > miny + iy * 50000.0"""


def geo_edges(spark, d):
    return geometry.explode_edges(geometry.explode_parts(T.geo_parcels(spark, d), ["parcel_uid"]), ["parcel_uid"])


def boxes(spark, d):
    zones = grid.parcel_zones(geo_edges(spark, d), ["parcel_uid"]).select("parcel_uid", "epsg")
    ids = ["parcel_uid", "epsg"]
    parts = geometry.explode_parts(T.geo_parcels(spark, d).join(zones, "parcel_uid"), ids)
    return grid.zone_bounds(geometry.explode_edges(parts, ids))


def candidates(spark, d):
    points = geometry.geographic_centroid(geo_edges(spark, d), ["parcel_uid"])
    return grid.candidate_tiles(points, boxes(spark, d), ["parcel_uid"])


@check("e13_zone_bounds", f"SELECT epsg, {rounded(['minx', 'miny', 'maxx', 'maxy'], 3)} FROM zonebox")
def e13(spark, d):
    return rnd(boxes(spark, d), ["epsg"], ["minx", "miny", "maxx", "maxy"], 3)


@check(
    "g04_square_grid",
    """SELECT ix * ny + iy AS tile_no, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, x0 + ix * 10000.0 AS minx, y0 + iy * 10000.0 AS miny FROM (
      SELECT *, unnest(range(ny)) AS iy FROM (SELECT *, unnest(range(nx)) AS ix FROM (
        SELECT x0, y0, CAST(ceil((x1 - x0) / 10000.0) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / 10000.0) AS BIGINT) AS ny FROM (
          SELECT min(o_totalprice) AS x0, max(o_totalprice) AS x1, min(o_orderkey * 31.0) AS y0, max(o_orderkey * 31.0) AS y1 FROM orders))))""",
)
def g04(spark, d):
    o = T.read(spark, d, "orders")
    y = F.col("o_orderkey") * F.lit(31.0)
    box = o.agg(
        F.min("o_totalprice").alias("minx"), F.min(y).alias("miny"), F.max("o_totalprice").alias("maxx"), F.max(y).alias("maxy")
    ).withColumns({"epsg": F.lit(25830), "zone": F.lit(30)})
    g = grid.square_grid(box, 10000.0)
    no = F.element_at(F.split("tile_id", "_"), 2).cast("bigint")
    return g.select(no.alias("tile_no"), "ix", "iy", "minx", "miny")


@check("g05_national_grid", f"SELECT tile_id, epsg, ix, iy, {rounded(['minx', 'miny'], 3)} FROM tiles")
def g05(spark, d):
    return rnd(grid.square_grid(boxes(spark, d)), ["tile_id", "epsg", "ix", "iy"], ["minx", "miny"], 3)


@check("d02_parcel_to_tile", "SELECT parcel_uid, tile_id, epsg, ix, iy FROM candidates")
def d02(spark, d):
    return candidates(spark, d)


CTES["firsttile"] = """SELECT parcel_uid, tile_id, epsg FROM (
  SELECT *, row_number() OVER (PARTITION BY parcel_uid ORDER BY epsg, ix, iy) AS rn FROM candidates) WHERE rn = 1"""


@check("f02_keep_first_tile", "SELECT parcel_uid, tile_id, epsg FROM firsttile")
def f02(spark, d):
    return grid.first_tile(candidates(spark, d), ["parcel_uid"])


@check(
    "d03_attach_tile",
    f"""SELECT g.parcel_uid, f.tile_id, f.epsg, {rounded(['t.minx', 't.miny'], 3).replace('AS t.', 'AS ')} FROM geo g JOIN firsttile f USING (parcel_uid)
      JOIN tiles t ON t.tile_id = f.tile_id""",
)
def d03(spark, d):
    from fieldflux.scratch import attach

    first = grid.first_tile(candidates(spark, d), ["parcel_uid"])
    tiles = grid.square_grid(boxes(spark, d)).select("tile_id", "minx", "miny")
    out = attach(T.geo_parcels(spark, d).select("parcel_uid").join(first, "parcel_uid"), tiles, ["tile_id"], "inner")
    return rnd(out, ["parcel_uid", "tile_id", "epsg"], ["minx", "miny"], 3)


@check(
    "e15_coverage",
    """SELECT (SELECT count(*) FROM geo) AS n_parcels, count(DISTINCT parcel_uid) AS n_assigned,
      (SELECT count(*) FROM geo) - count(DISTINCT parcel_uid) AS n_unassigned,
      (SELECT count(*) FROM (SELECT parcel_uid FROM candidates GROUP BY parcel_uid HAVING count(*) > 1)) AS n_several,
      (SELECT count(DISTINCT tile_id) FROM firsttile) AS n_tiles FROM candidates""",
)
def e15(spark, d):
    return grid.coverage(T.geo_parcels(spark, d), candidates(spark, d))


@check(
    "e15_parcels_per_zone",
    """SELECT z.epsg, z.n_parcels, t.n_tiles FROM (SELECT epsg, count(*) AS n_parcels FROM geozone GROUP BY epsg) z
      JOIN (SELECT epsg, count(*) AS n_tiles FROM tiles GROUP BY epsg) t USING (epsg)""",
)
def e15_zone(spark, d):
    zones = grid.parcel_zones(geo_edges(spark, d), ["parcel_uid"]).groupBy("epsg").agg(F.count(F.lit(1)).alias("n_parcels"))
    tiles = grid.square_grid(boxes(spark, d)).groupBy("epsg").agg(F.count(F.lit(1)).alias("n_tiles"))
    return zones.join(tiles, "epsg")


@check(
    "d05_tiles_of_municipalities",
    """SELECT DISTINCT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM (
      SELECT *, unnest(range(0, 12)) AS iy FROM (SELECT *, unnest(range(0, 12)) AS ix FROM cust WHERE municipio IN (3, 7)))
      WHERE ix * 3.3 - 0.35 <= x0 + w AND ix * 3.3 + 2.95 >= x0 AND iy * 3.3 - 0.35 <= y0 + h AND iy * 3.3 + 2.95 >= y0
        AND (NOT tri OR (greatest(ix * 3.3 - 0.35, x0) - x0) / w + (greatest(iy * 3.3 - 0.35, y0) - y0) / h <= 1)""",
)
def d05(spark, d):
    sub = T.parcels(spark, d).where(F.col("municipio").isin(3, 7))
    edges = geometry.explode_edges(geometry.explode_parts(sub, ["row_no"]), ["row_no"])
    return grid.tiles_touching(edges, ["row_no"], -0.35, -0.35, 12, 12, 3.3)


@check(
    "d04_label_enrichment",
    f"""SELECT {KEY}, {rounded(['n_rows'])}, s AS parc_sistexp, p AS parc_producto FROM (
      SELECT {KEY}, CAST(count(*) AS DOUBLE) AS n_rows FROM cust GROUP BY {KEY}) LEFT JOIN (
      SELECT {KEY}, arg_min(coalesce(parc_sistexp, 'none'), row_no) AS s, arg_min(parc_producto, row_no) AS p FROM (
        SELECT * REPLACE (CAST(CASE WHEN row_no % 3 <> 0 THEN provincia + 1000 ELSE provincia END AS INTEGER) AS provincia) FROM cust)
        GROUP BY {KEY}) USING ({KEY})""",
)
def d04(spark, d):
    p = T.parcels(spark, d)
    feats = p.groupBy(*PARCEL_KEY).agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
    # All rows; two in three under a province that no feature has.
    away = F.when(F.col("row_no") % 3 != 0, F.col("provincia") + 1000).otherwise(F.col("provincia"))
    labels = p.withColumn("provincia", away.cast(p.schema["provincia"].dataType)).select(
        *PARCEL_KEY, "row_no", F.coalesce("parc_sistexp", F.lit("none")).alias("parc_sistexp"), "parc_producto"
    )
    return features.attach_labels(feats, labels, PARCEL_KEY, ["row_no"])
