"""Evapotranspiration rasters for a table of areas of interest over a date range."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.areas import area_tiles
from ..operators.scenes import without_zone
from ..scratch import attach, materialize
from ..sources.sinks import write_bands
from .scenes_run import ScenesRun, run_scenes


def area_status(every: DataFrame, run: ScenesRun, problems: DataFrame) -> DataFrame:
    """tile_id and status: 'ok', or why an area has no result."""
    line = run.energy.scalars.select("tile_id", F.col("a_1").isNotNull().alias("_line"))
    rows = every.join(problems, "tile_id", "left").join(run.meta.select("tile_id", "n_items"), "tile_id", "left")
    status = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("n_items").isNull(), "no_scenes")
        .when(F.col("_line").isNull(), "no_observations")
        .when(~F.col("_line"), "no_hot_pixels")
        .otherwise("ok")
    )
    return rows.join(line, "tile_id", "left").select("tile_id", status.alias("status"))


def areas_run(
    areas: DataFrame,
    catalog: DataFrame,
    observations: DataFrame,
    dem_items: DataFrame,
    dates: tuple[str, str],
    output: str | None = None,
    **options,
) -> ScenesRun:
    """One composite per area (tile_id, geometry) over the whole range, clipped to the area's
    outline.  With `output`, LE, EF, ET_inst and ET24h are written per area; an area without a zone,
    scenes or hot pixels does not affect the others, and `status` of the run tells it."""
    tiles, outline = area_tiles(areas)
    tiles, outline = materialize(tiles, "areas"), materialize(outline, "outlines")
    (tiles, problems), every = without_zone(tiles), tiles.select("tile_id")
    outline = outline.join(tiles.select("tile_id"), "tile_id", "left_semi")
    run = run_scenes(
        tiles, catalog, observations, dem_items, dates, per_date=False, area_edges=outline, **options
    )
    run.status = area_status(every, run, problems)
    if output:
        pixels = attach(run.energy.pixels, tiles.select("tile_id", "epsg"), ["tile_id"])
        write_bands(pixels, output, ["tile_id"])
    return run
