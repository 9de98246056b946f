"""Polygons as relations.  A geometry is parts -> rings -> closed points,
array<array<array<struct<x,y>>>>; every measure is an aggregation over its exploded edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projections import from_laea, to_laea

GEOMETRY_TYPE = "array<array<array<struct<x:double,y:double>>>>"


def explode_parts(df: DataFrame, ids: list[str], geometry: str = "geometry") -> DataFrame:
    """One row per part.  `part` is a hash of the part, so equal copies get the same name."""
    parts = df.select(*ids, F.explode(geometry).alias("rings"))
    return parts.withColumn("part", F.xxhash64("rings"))


def explode_rings(parts: DataFrame, ids: list[str]) -> DataFrame:
    return parts.select(*ids, "part", F.posexplode("rings").alias("ring", "points"))


def explode_edges(parts: DataFrame, ids: list[str]) -> DataFrame:
    """ids, part, ring, side (+1 shell, -1 hole, times the ring's orientation), seq and the
    edge (x1,y1)-(x2,y2), plus the ring's first point (ox, oy) as a local origin."""
    rings = explode_rings(parts, ids)
    n = F.size("points")
    pairs = F.zip_with(
        F.slice("points", F.lit(1), n - 1),
        F.slice("points", F.lit(2), n - 1),
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
    )
    origin = F.col("points")[0]
    rings = rings.where(n > 1).withColumns({"pairs": pairs, "ox": origin["x"], "oy": origin["y"]})
    twice_area = F.aggregate(
        "pairs",
        F.lit(0.0),
        lambda acc, e: acc
        + (e["x1"] - F.col("ox")) * (e["y2"] - F.col("oy"))
        - (e["x2"] - F.col("ox")) * (e["y1"] - F.col("oy")),
    )
    side = F.signum(twice_area) * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    rings = rings.withColumn("side", side)
    return rings.select(
        *ids, "part", "ring", "side", "ox", "oy", F.posexplode("pairs").alias("seq", "e")
    ).select(*ids, "part", "ring", "side", "ox", "oy", "seq", "e.*")


def bounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """minx, miny, maxx, maxy per group of closed-ring edges."""
    return edges.groupBy(*keys).agg(
        F.min("x1").alias("minx"), F.min("y1").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy")
    )


def centroid(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Area centroid (cx, cy) and area.  Sums run on coordinates relative to the ring's first
    point, which keeps small parcels accurate at large map coordinates."""
    dx1, dy1 = F.col("x1") - F.col("ox"), F.col("y1") - F.col("oy")
    dx2, dy2 = F.col("x2") - F.col("ox"), F.col("y2") - F.col("oy")
    df = edges.withColumn("_c", F.col("side") * (dx1 * dy2 - dx2 * dy1))
    # Moments about one origin per parcel would need a join: shift each ring's moment by its own origin.
    df = df.withColumns(
        {
            "_mx": F.col("_c") * (dx1 + dx2) / F.lit(3.0) + F.col("_c") * F.col("ox"),
            "_my": F.col("_c") * (dy1 + dy2) / F.lit(3.0) + F.col("_c") * F.col("oy"),
        }
    )
    sums = df.groupBy(*ids).agg(F.sum("_c").alias("_a"), F.sum("_mx").alias("_sx"), F.sum("_my").alias("_sy"))
    return sums.select(
        *ids,
        F.try_divide("_sx", "_a").alias("cx"),
        F.try_divide("_sy", "_a").alias("cy"),
        (F.col("_a") / 2).alias("area"),
    )


def geographic_centroid(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Centroid longitude and latitude of lon/lat polygons, taken in the equal-area projection."""
    df = edges
    for i, (lon, lat) in enumerate((("x1", "y1"), ("x2", "y2"), ("ox", "oy"))):
        df = to_laea(df, lon, lat, f"_px{i}", f"_py{i}")
    flat = df.select(
        *ids,
        "side",
        F.col("_px0").alias("x1"),
        F.col("_py0").alias("y1"),
        F.col("_px1").alias("x2"),
        F.col("_py1").alias("y2"),
        F.col("_px2").alias("ox"),
        F.col("_py2").alias("oy"),
    )
    return from_laea(centroid(flat, ids), "cx", "cy", "lon", "lat")


def crossing_ids(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Ids of geometries in which two edges of a part properly cross.

    Edges meet through a lattice over the part's own box, about one cell per edge, so only
    edges in the same cell are compared."""
    key = [*ids, "part"]
    box = edges.groupBy(*key).agg(
        F.min("x1").alias("_bx"),
        F.min("y1").alias("_by"),
        F.max("x1").alias("_tx"),
        F.max("y1").alias("_ty"),
        F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_k"),
    )
    df = edges.join(box, key)

    def cells(a, b, lo, hi):
        step = (F.col(hi) - F.col(lo)) / F.col("_k")

        def at(v):
            return F.coalesce(F.floor(F.try_divide(v - F.col(lo), step)), F.lit(0))

        return F.explode(F.sequence(at(F.least(a, b)), at(F.greatest(a, b))))

    df = df.select(*key, "ring", "seq", "x1", "y1", "x2", "y2", "_k", "_bx", "_by", "_tx", "_ty")
    df = df.withColumn("_i", cells(F.col("x1"), F.col("x2"), "_bx", "_tx"))
    df = df.withColumn("_j", cells(F.col("y1"), F.col("y2"), "_by", "_ty"))
    df = df.withColumn("_n", F.struct("ring", "seq")).select(*key, "_i", "_j", "_n", "x1", "y1", "x2", "y2")
    other = df.select(*key, "_i", "_j", *[F.col(c).alias(f"o{c}") for c in ("_n", "x1", "y1", "x2", "y2")])
    both = df.join(other, [*key, "_i", "_j"]).where(F.col("_n") < F.col("o_n"))

    def turn(ax, ay, bx, by, px, py):
        return F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))

    first = turn("x1", "y1", "x2", "y2", "ox1", "oy1") * turn("x1", "y1", "x2", "y2", "ox2", "oy2")
    second = turn("ox1", "oy1", "ox2", "oy2", "x1", "y1") * turn("ox1", "oy1", "ox2", "oy2", "x2", "y2")
    return both.where((first < 0) & (second < 0)).select(*ids).distinct()


def validity(df: DataFrame, ids: list[str], geometry: str = "geometry") -> DataFrame:
    """Per id: is every ring closed, long enough and of non-zero area, and free of crossings."""
    parts = explode_parts(df, ids, geometry)
    edges = explode_edges(parts, ids)
    p = F.col("points")
    first, last = p[0], F.element_at("points", -1)
    rings = explode_rings(parts, ids).select(
        *ids,
        (first == last).alias("closed"),
        (F.size("points") >= 4).alias("long_enough"),
    )
    shape = rings.groupBy(*ids).agg(
        F.bool_and("closed").alias("closed"), F.bool_and("long_enough").alias("long_enough")
    )
    cross = (F.col("x1") - F.col("ox")) * (F.col("y2") - F.col("oy")) - (F.col("x2") - F.col("ox")) * (
        F.col("y1") - F.col("oy")
    )
    area = edges.groupBy(*ids, "part", "ring").agg((F.abs(F.sum(cross)) / 2).alias("_area"))
    area = area.groupBy(*ids).agg((F.min("_area") > 0).alias("has_area"))
    crossing = crossing_ids(edges, ids).withColumn("crossing", F.lit(True))
    out = shape.join(area, ids, "left").join(crossing, ids, "left")
    out = out.withColumns(
        {
            "has_area": F.coalesce("has_area", F.lit(False)),
            "crossing": F.coalesce("crossing", F.lit(False)),
        }
    )
    return out.withColumn(
        "is_valid", F.col("closed") & F.col("long_enough") & F.col("has_area") & ~F.col("crossing")
    )


def points_in_polygons(
    points: DataFrame, point_id: str, polygons: DataFrame, poly_id: str, cell: float = 1.0
) -> DataFrame:
    """(point_id, poly_id) pairs with the point (lon, lat) inside the polygon.

    Points meet an edge through the edge's latitude strip and the polygon's box; a ray to
    the east then counts crossings, odd means inside."""
    parts = explode_parts(polygons, [poly_id])
    edges = explode_edges(parts, [poly_id]).where(F.col("y1") != F.col("y2"))
    size = F.lit(float(cell))

    def strip(v):
        return F.floor(v / size)

    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    box = bounds(edges, [poly_id, "part"]).withColumn(
        "_cell", F.explode(F.sequence(strip(F.col("minx")), strip(F.col("maxx"))))
    )
    box = box.withColumn("_strip", F.explode(F.sequence(strip(F.col("miny")), strip(F.col("maxy")))))
    pts = points.select(point_id, "lon", "lat").withColumns(
        {"_cell": strip(F.col("lon")), "_strip": strip(F.col("lat"))}
    )
    candidate = pts.join(box, ["_cell", "_strip"]).where(
        F.col("lon").between(F.col("minx"), F.col("maxx")) & F.col("lat").between(F.col("miny"), F.col("maxy"))
    )
    edges = edges.withColumn("_strip", F.explode(F.sequence(strip(low), strip(high))))
    hit = candidate.join(edges.select(poly_id, "part", "_strip", "x1", "y1", "x2", "y2"), [poly_id, "part", "_strip"])
    at = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hit = hit.where(((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (at > F.col("lon")))
    odd = hit.groupBy(point_id, poly_id, "part").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    return odd.select(point_id, poly_id).distinct()
