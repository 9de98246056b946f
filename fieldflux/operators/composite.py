"""Per-pixel median composite, elevation mosaic and band reshaping."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BANDS
from ..scratch import is_small, materialize, shuffled

PIXEL = ["tile_id", "y", "x"]
#: The least and the greatest of so many values tell their median.
FEW = 2


def median_composite(obs: DataFrame, scene: list[str], bands: list[str] = BANDS) -> DataFrame:
    """Median of every band over the observations of a pixel in a scene, missing skipped.

    Rows are hash-partitioned by pixel without the date, so the grouping by scene and pixel
    and a later join on the pixel (terrain, parcels) need no second shuffle.  A pixel of a scene
    has as many values as there are satellite passes, one as a rule, so a group is kept as one list instead of
    a table of counts for each band.  For groups without such a bound there is
    quantiles.medians, which splits every group."""
    keys = [*scene, "y", "x"]
    rows = obs.select(*keys, *bands).repartition(*PIXEL)
    seen = rows.groupBy(*keys).agg(F.collect_list(F.struct(*bands)).alias("_seen"))
    return seen.select(*keys, *[_median(F.col("_seen"), b).alias(b) for b in bands])


def _median(seen: Column, band: str) -> Column:
    values = F.sort_array(F.array_compact(seen[band]))
    n = F.size(values)
    middle = F.when(n > 0, values[F.floor((n - 1) / 2).cast("int")] / 2 + values[F.floor(n / 2).cast("int")] / 2)
    return F.when(F.size(seen) == 1, seen[0][band].cast("double")).otherwise(middle)


def composite_of_few(obs: DataFrame, scene: list[str], bands: list[str] = BANDS) -> DataFrame:
    """median_composite of the pixels of a scene that have FEW observations, as nearly all do in a scene of one date; `_seen`
    tells how many a pixel has.  The others get their bands from `with_crowded`.

    The state of a group is a count and two numbers for each band, which a hash table holds; lists would be sorted."""
    keys = [*scene, "y", "x"]
    rows = obs.select(*keys, *bands).repartition(*PIXEL)
    ends = [f(b).alias(f"_{side}_{b}") for b in bands for side, f in (("lo", F.min), ("hi", F.max))]
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"), *ends)

    def middle(b):
        lo, hi = F.col(f"_lo_{b}"), F.col(f"_hi_{b}")
        return F.when(lo == hi, lo.cast("double")).otherwise(lo / 2 + hi / 2)

    return seen.select(*keys, *[middle(b).alias(b) for b in bands], "_seen")


def with_crowded(pixels: DataFrame, obs: DataFrame, scene: list[str], bands: list[str] = BANDS) -> DataFrame:
    """`pixels` (stored rows of composite_of_few with further columns) with the medians of those with more than FEW observations."""
    keys = [*scene, "y", "x"]
    crowded = pixels.where(F.col("_seen") > FEW).drop("_seen", *bands)
    if crowded.isEmpty():
        return pixels.drop("_seen")

    def same(other):
        return [F.col(k).eqNullSafe(other[f"_{k}"]) for k in keys]

    named = crowded.select(*[F.col(k).alias(f"_{k}") for k in keys])
    named = F.broadcast(named) if is_small(named) else shuffled(named)
    medians = median_composite(obs.join(named, same(named), "left_semi"), scene, bands)
    medians = medians.select(*[F.col(k).alias(f"_{k}") for k in keys], *bands)
    whole = crowded.join(shuffled(medians), same(medians), "left").select(*[c for c in pixels.columns if c != "_seen"])
    return pixels.where(F.col("_seen") <= FEW).drop("_seen").unionByName(materialize(cluster_by_scene(whole, scene), "pixels"))


def cluster_by_scene(pixels: DataFrame, scene: list[str], rows: int = 64) -> DataFrame:
    """Bring the pixels of a scene together, in strips of raster rows.

    A strip is at most `rows` raster lines, so no task grows with the data, and a task sees
    few scenes, so per-scene sketches and counts combine well before they are shuffled."""
    return pixels.repartition(*scene, F.floor(F.col("y") / rows))


def dem_mosaic(dem_items: DataFrame, nodata: float | None = None) -> DataFrame:
    """Highest elevation where elevation items overlap; the declared nodata value is missing."""
    dem = F.nullif(F.col("dem"), F.lit(float(nodata))) if nodata is not None else F.col("dem")
    return dem_items.groupBy("tile_id", "y", "x").agg(F.max(dem).alias("dem"))


def bands_to_rows(pixels: DataFrame, keys: list[str], bands: list[str] = BANDS) -> DataFrame:
    return pixels.unpivot(keys, bands, "band", "value")


def rows_to_bands(rows: DataFrame, keys: list[str], bands: list[str] = BANDS) -> DataFrame:
    return rows.groupBy(*keys).pivot("band", bands).agg(F.max("value"))
