"""Areas of interest as tiles: own projection, pixel grid, box and outline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PIXEL_SIZE_M
from ..functions.projections import to_utm, utm_epsg_or_null, zone_of_epsg
from .geometry import explode_edges, explode_parts, geographic_centroid
from .rasterize import to_pixel_units


def area_tiles(areas: DataFrame, pixel: float = PIXEL_SIZE_M) -> tuple[DataFrame, DataFrame]:
    """(tiles, outline edges in pixel units) of lon/lat areas (tile_id, geometry).

    The centroid gives the UTM zone, and the area's bounds in that zone the pixel grid.  An area
    without a zone (in the southern hemisphere) keeps its row, without epsg and raster."""
    ids = ["tile_id"]
    edges = explode_edges(explode_parts(areas, ids), ids)
    center = geographic_centroid(edges, ids).select("tile_id", "lon", "lat")
    center = center.withColumn("epsg", utm_epsg_or_null(F.col("lon"), F.col("lat")))
    center = center.withColumn("zone", zone_of_epsg(F.col("epsg")))
    flat = edges.join(center.select("tile_id", "zone"), ids)
    flat = to_utm(to_utm(flat, "x1", "y1", "zone", "_ax", "_ay"), "x2", "y2", "zone", "_bx", "_by")
    size = F.lit(float(pixel))
    box = flat.groupBy(*ids).agg(
        F.min("_ax").alias("west"),
        F.max("_ay").alias("north"),
        F.max("_ax").alias("_e"),
        F.min("_ay").alias("_s"),
        F.min("x1").alias("lon_min"),
        F.min("y1").alias("lat_min"),
        F.max("x1").alias("lon_max"),
        F.max("y1").alias("lat_max"),
    )
    box = box.withColumns(
        {
            "nx": F.ceil((F.col("_e") - F.col("west")) / size).cast("int"),
            "ny": F.ceil((F.col("north") - F.col("_s")) / size).cast("int"),
        }
    ).drop("_e", "_s")
    tiles = center.join(box, ids)
    outline = flat.drop("x1", "y1", "x2", "y2", "zone").withColumnsRenamed(
        {"_ax": "x1", "_ay": "y1", "_bx": "x2", "_by": "y2"}
    )
    outline = to_pixel_units(outline.join(box.select("tile_id", "west", "north", "nx", "ny"), ids), pixel)
    return tiles, outline
