"""Owner masks: which object each cell shows, and how much of every object is left to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import ratio, round_to
from ..functions.ordering import beside, exact_quantiles
from ..session import checkpointed, spread

MIN_VISIBLE = 0.35
FULLY_VISIBLE = 0.999
BINS = 40
WIDTH = 62  # cells of a row in one number, its sign left out
BAND = 32  # rows of an image that are dealt together


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def cell_masks(cells: DataFrame) -> DataFrame:
    """(image_id, z, obj, y, tile, mask) of (image_id, z, obj, x, y): WIDTH cells of a row are the bits of a number."""
    tile = F.floor(F.col("x") / WIDTH)
    keys = ["image_id", "z", "obj", "y", "tile"]
    return cells.withColumn("tile", tile).groupBy(*keys).agg(F.bit_or(_bit(F.col("x") - F.col("tile") * WIDTH)).alias("mask"))


def run_masks(runs: DataFrame) -> DataFrame:
    """The same of row runs (image_id, z, obj, y, x0, x1), x1 exclusive; runs of one object do not overlap.

    No cell is listed: a run is one row for every WIDTH cells that it reaches. A column `band` is kept.
    """
    band = [c for c in runs.columns if c == "band"]
    tiles = F.sequence(F.floor(F.col("x0") / WIDTH), F.floor((F.col("x1") - 1) / WIDTH))
    cut = runs.filter("x1 > x0").withColumn("tile", F.explode(tiles))
    inside = lambda c: F.least(F.greatest(F.col(c) - F.col("tile") * WIDTH, F.lit(0)), F.lit(WIDTH))
    return cut.select(*band, "image_id", "z", "obj", "y", "tile", (_bit(inside("x1")) - _bit(inside("x0"))).alias("mask"))


def _highest(mask: Column) -> Column:
    """Place of the highest bit: all bits below it are set, then counted."""
    for by in (1, 2, 4, 8, 16, 32):
        mask = mask.bitwiseOR(F.shiftright(mask, by))
    return F.bit_count(mask) - 1


def mask_visibility(
    masks: DataFrame, min_side: int = 8, min_visible: float = MIN_VISIBLE, min_cells: int = 1
) -> DataFrame:
    """(image_id, obj, n_cells, n_visible, phi, labelled, x0, y0, x1, y1) of every placed object.

    masks: (image_id, z, obj, y, tile, mask) with a numeric layer z of its own for every object of an
    image; the highest layer owns a cell, and a layer with a null obj only hides others. Objects
    smaller than min_cells are not placed at all. The box is the tight bound of the visible cells;
    it is null unless enough is visible and both sides reach min_side.

    Layers of a stretch of a row go from the top: what a mask shows is itself without all masks
    above it, one running bitwise or. The stack on a stretch is a sorted stream that spills, so a
    crowded image is spread over its bands of rows, and sums are combined before they are shuffled. Rows that
    come dealt by image and `band`, the number of their BAND rows, are not shuffled again.
    """
    if "band" not in masks.columns:
        masks = spread(masks.withColumn("band", F.floor(F.col("y") / BAND)), "image_id", "band")
    if min_cells > 1:
        placed = (
            masks.filter("obj is not null").groupBy("image_id", "z").agg(F.sum(F.bit_count("mask")).alias("_n"))
            .filter(F.col("_n") >= min_cells).select("image_id", "z")
        )
        masks = masks.filter("obj is null").unionByName(
            masks.filter("obj is not null").join(placed, ["image_id", "z"], "left_semi").select(*masks.columns)
        )
    above = (
        Window.partitionBy("image_id", "band", "y", "tile").orderBy(F.desc("z"), "obj").rowsBetween(Window.unboundedPreceding, -1)
    )
    hidden = F.coalesce(F.bit_or("mask").over(above), F.lit(0).cast("bigint"))
    seen = F.col("seen")
    lowest = F.bit_count(seen.bitwiseAND(-seen) - 1)
    shown = lambda c: F.when(seen != 0, c)
    rows = (
        masks.withColumn("seen", F.col("mask").bitwiseAND(F.bitwise_not(hidden)))
        .filter("obj is not null")
        .groupBy("image_id", "z", "obj")
        .agg(
            F.sum(F.bit_count("mask")).alias("n_cells"), F.sum(F.bit_count("seen")).alias("n_visible"),
            F.min(shown(F.col("tile") * WIDTH + lowest)).alias("x0"), F.min(shown(F.col("y"))).alias("y0"),
            F.max(shown(F.col("tile") * WIDTH + _highest(seen))).alias("x1"), F.max(shown(F.col("y"))).alias("y1"),
        )
        .withColumn("phi", ratio("n_visible", F.greatest(F.col("n_cells"), F.lit(1))))
    )
    labelled = (
        (F.col("n_visible") > 0) & (F.col("phi") >= F.lit(min_visible))
        & (F.col("x1") - F.col("x0") >= min_side) & (F.col("y1") - F.col("y0") >= min_side)
    )
    rows = rows.withColumn("labelled", F.coalesce(labelled, F.lit(False)))
    box = lambda c, plus: F.when(F.col("labelled"), F.col(c) + plus).alias(c)
    return rows.select(
        "image_id", "obj", "n_cells", "n_visible", "phi", "labelled",
        box("x0", 0), box("y0", 0), box("x1", 1), box("y1", 1),
    )


def object_visibility(cells: DataFrame, **limits) -> DataFrame:
    """`mask_visibility` of objects of any shape, given as cells (image_id, z, obj, x, y)."""
    return mask_visibility(cell_masks(cells), **limits)


def run_visibility(runs: DataFrame, **limits) -> DataFrame:
    """`mask_visibility` of row runs (image_id, z, obj, y, x0, x1): work grows with heights, not with areas."""
    return mask_visibility(run_masks(runs), **limits)


def visibility_summary(objects: DataFrame) -> DataFrame:
    """One row: median, mean, p10, p90, shares retained and fully visible, images without a label."""
    objects = checkpointed(objects.select("image_id", "phi", "labelled"))
    sums = objects.agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.avg("phi").alias("mean"),
        F.count(F.when(F.col("phi") >= MIN_VISIBLE, 1)).alias("n_retained"),
        F.count(F.when(F.col("phi") >= FULLY_VISIBLE, 1)).alias("n_full"),
    )
    images = objects.groupBy("image_id").agg(F.bool_or("labelled").alias("any")).agg(
        F.count(F.lit(1)).alias("n_images"), F.count(F.when(~F.col("any"), 1)).alias("n_empty")
    )
    q = exact_quantiles(objects, [], "phi", [0.1, 0.5, 0.9]).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for p, name in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))
        ]
    )
    return beside(beside(sums, images), q).select(
        "n_objects", "n_retained", "n_full", "n_images", "n_empty",
        *[round_to(c, 9).alias(c) for c in ("mean", "p10", "median", "p90")],
        round_to(ratio("n_retained", "n_objects"), 9).alias("retained"),
        round_to(ratio("n_empty", "n_images"), 9).alias("empty"),
    )


def unit_histogram(rows: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """(bin, n) over [0, 1] in equal bins, the last one closed; empty bins are shown.

    A value belongs to bin i when it is at least i * width, compared as doubles.
    """
    v, width, last = F.col(value), F.lit(1.0 / bins), F.lit(bins - 1)
    guess = F.least(F.floor(v * bins), last)
    edge = lambda i: i.cast("double") * width
    at = (
        F.when(v < edge(guess), guess - 1)
        .when((guess < last) & (v >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
        .cast("int")
    )
    counts = rows.filter(v.between(0, 1)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
