"""Box overlap, greedy matching, box-level F1 and saliency localisation.

Overlap candidates come from an equi-join on grid cells of an image, so boxes far apart in a
crowded image never meet. Greedy matching takes the certain pairs in a round and walks what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.expressions import iou, ratio, round_to
from ..functions.ordering import beside, exact_quantiles
from ..session import checkpointed
from .fusion import crowds
from .thresholds import FINE_POINTS, fine_index, fine_threshold

CELL = 128
MATCH_IOU = 0.5
ROUNDS = 1  # of certain pairs, before the rest is walked
XYXY = ["x0", "y0", "x1", "y1"]


def _cells(df: DataFrame, cell: int) -> DataFrame:
    """One row per grid cell that a box touches.

    Never empty, so the outer form is the same and adds no filter that evaluates the range twice.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(cell))
    return df.withColumn("_cx", F.explode_outer(F.sequence(at("x0"), at("x1")))).withColumn(
        "_cy", F.explode_outer(F.sequence(at("y0"), at("y1")))
    )


def overlapping_pairs(
    a: DataFrame, b: DataFrame, keys: list[str], keep_a: list[str], keep_b: list[str],
    cell: int = CELL, extent: bool = False,
) -> DataFrame:
    """(keys, keep_a, keep_b, iou) of every pair with IoU above 0: the matrix without its zeros.

    With `extent` also (x0, x1), where the two boxes begin and end.

    A pair is reported only in the cell that holds the upper left corner of its intersection, so
    no deduplication is needed.
    """
    left = _cells(a.select(*keys, *keep_a, *[F.col(c).alias(f"_a{c}") for c in XYXY], *XYXY), cell)
    right = _cells(b.select(*keys, *keep_b, *[F.col(c).alias(f"_b{c}") for c in XYXY], *XYXY), cell)
    pair = left.drop(*XYXY).join(right.drop(*XYXY), [*keys, "_cx", "_cy"])
    corner = lambda c: F.floor(F.greatest(F.col(f"_a{c}"), F.col(f"_b{c}")) / F.lit(cell))
    value = iou(tuple(f"_a{c}" for c in XYXY), tuple(f"_b{c}" for c in XYXY))
    return (
        pair.filter((F.col("_cx") == corner("x0")) & (F.col("_cy") == corner("y0")))
        .withColumn("iou", value)
        .filter("iou > 0")
        .select(
            *keys, *keep_a, *keep_b, "iou",
            *([F.least("_ax0", "_bx0").alias("x0"), F.greatest("_ax1", "_bx1").alias("x1")] if extent else []),
        )
    )


# ------------------------------------------------------------------ matching
def greedy_match(
    preds: DataFrame, truths: DataFrame, keys: list[str], iou_thr: float = MATCH_IOU
) -> DataFrame:
    """(keys, pred_id, truth_id, iou) of the greedy pairing, highest confidence first.

    preds: (keys, pred_id, conf, box); truths: (keys, truth_id, box). Each prediction takes its
    best free truth (larger index on ties) when their IoU reaches the threshold. Equal
    confidences go by falling pred_id.

    Only pairs at the threshold can be accepted, and a pair is certain once the prediction is the
    first one left for its truth and the truth the best one left for its prediction: earlier
    predictions do not reach that truth and better truths are gone. All certain pairs are taken
    in ROUNDS rounds, which settles all but crowded images, and their boxes removed. What is left
    is cut into crowds that share no box and walked once in order, as a stream.
    """
    order = F.struct("conf", "pred_id")
    edges = overlapping_pairs(preds, truths, keys, ["pred_id", "conf"], ["truth_id"], extent=True).filter(
        F.col("iou") >= F.lit(iou_thr)
    )
    edges = checkpointed(edges)
    done = []
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        first = edges.groupBy(*keys, "truth_id").agg(F.max(order).alias("o")).select(
            *keys, "truth_id", F.col("o.pred_id").alias("pred_id")
        )
        best = edges.groupBy(*keys, "pred_id").agg(
            F.max(F.struct("iou", "truth_id")).alias("t")
        ).select(*keys, "pred_id", F.col("t.truth_id").alias("truth_id"), F.col("t.iou").alias("iou"))
        sure = checkpointed(best.join(first, [*keys, "pred_id", "truth_id"]))
        done.append(sure.select(*keys, "pred_id", "truth_id", "iou"))
        edges = checkpointed(
            edges.join(sure.select(*keys, "truth_id"), [*keys, "truth_id"], "left_anti").join(
                sure.select(*keys, "pred_id"), [*keys, "pred_id"], "left_anti"
            )
        )
    out = _walked(edges, keys)
    for rows in done:
        out = out.unionByName(rows)
    return out


def _walked(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pred_id, truth_id, iou) of the pairs that a walk over the predictions in order takes.

    What is held is the truths taken in one crowd.
    """
    kinds = {f.name: f.dataType for f in edges.schema}
    names = [*keys, "pred_id", "truth_id", "iou"]
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        crowds(edges, keys=keys).repartition(n, *keys, "crowd")
        .sortWithinPartitions(*keys, "crowd", F.desc("conf"), F.desc("pred_id"), F.desc("iou"), F.desc("truth_id"))
        .select(*keys, "crowd", "pred_id", "truth_id", "iou")
    )

    def walk(batches):
        group, done, taken = None, None, set()  # the crowd, the last prediction with a truth, truths taken
        for batch in batches:
            keep = []
            for row in batch.itertuples(index=False, name=None):
                now, pred, truth = row[:-3], row[-3], row[-2]
                if now != group:
                    group, done, taken = now, None, set()
                free = pred != done and truth not in taken
                if free:
                    done = pred
                    taken.add(truth)
                keep.append(free)
            yield batch[keep][names]

    return ordered.mapInPandas(walk, T.StructType([T.StructField(c, kinds[c]) for c in names]))


def flag_matches(preds: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with a `tp` flag."""
    hit = matches.select(*keys, "pred_id", F.lit(True).alias("_hit"))
    return preds.join(hit, [*keys, "pred_id"], "left").withColumn(
        "tp", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def box_counts(flagged: DataFrame, truths: DataFrame, keys: list[str], conf: float) -> DataFrame:
    """(keys, tp, fp, fn) at one confidence, for every group with a box or a truth.

    Greedy order is by confidence, so boxes below the threshold never change the ones above it
    and the matching is done once for all thresholds.
    """
    kept = F.col("conf") >= F.lit(conf)
    p = flagged.groupBy(*keys).agg(
        F.count(F.when(kept & F.col("tp"), 1)).alias("tp"),
        F.count(F.when(kept & ~F.col("tp"), 1)).alias("fp"),
    )
    t = truths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth"))
    zero = F.lit(0).cast("bigint")
    return p.join(t, keys, "full_outer").select(
        *keys, F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp"),
        (F.coalesce("n_truth", zero) - F.coalesce("tp", zero)).alias("fn"),
    )


def best_box_f1(flagged: DataFrame, n_truth: DataFrame, by: list[str]) -> DataFrame:
    """(by, confidence, f1): fine-grid threshold with the highest box-level F1, first on ties.

    flagged: (by, conf, tp); n_truth: (by, n_truth), one row per group.
    """
    hist = flagged.groupBy(*by, fine_index(F.col("conf")).alias("i")).agg(
        F.count(F.when(F.col("tp"), 1)).alias("tp"), F.count(F.when(~F.col("tp"), 1)).alias("fp")
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(FINE_POINTS - 1).cast("bigint"))
    frame = n_truth.withColumn("i", F.explode(every)).join(hist, [*by, "i"], "left")
    above = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    rows = frame.select(
        *by, "n_truth", fine_threshold(F.col("i")).alias("confidence"),
        F.sum(F.coalesce("tp", zero)).over(above).alias("tp"),
        F.sum(F.coalesce("fp", zero)).over(above).alias("fp"),
    )
    prec, rec = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", "n_truth")
    rows = rows.withColumn("_p", prec).withColumn("_r", rec).withColumn(
        "f1",
        F.when(F.col("_p") + F.col("_r") == 0, F.lit(0.0)).otherwise(
            2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))
        ),
    )
    return rows.groupBy(*by).agg(
        F.min(F.struct((-F.col("f1")).alias("m"), "confidence")).alias("b")
    ).select(*by, F.col("b.confidence").alias("confidence"), (-F.col("b.m")).alias("f1"))


# ------------------------------------------------------------------ localisation
def gathered(cells: DataFrame) -> DataFrame:
    """(image_id, grid) of cells (image_id, y, x, v): the cells of an image in one array."""
    return cells.groupBy("image_id").agg(F.collect_list(F.struct("y", "x", "v")).alias("grid"))


def localisation(grids: DataFrame, boxes: DataFrame, tops: DataFrame, size: int, step: float = 1.0) -> DataFrame:
    """(image_id, area, energy, peak_in, top_in) for every image that has a box.

    grids: (image_id, grid) with the saliency cells (y, x, v) of an image in one array, or in several; a grid has
    size x size cells that are `step` pixels wide. boxes: pixel boxes; tops: (image_id, cy, cx) the top location
    in pixels.

    Boxes and tops go to their image's row, where each cell is compared with the boxes: no cell is shuffled or
    sorted, and grids that were dealt by image_id stay where they are.
    """
    lo = lambda c: F.floor(F.col(c) / F.lit(step)).alias(f"c{c}")
    hi = lambda c: F.ceil(F.col(c) / F.lit(step)).alias(f"c{c}")
    clip = lambda c: F.least(F.floor(F.col(c) / F.lit(step)), F.lit(size - 1))
    images = boxes.groupBy("image_id").agg(F.collect_list(F.struct(lo("x0"), hi("x1"), lo("y0"), hi("y1"))).alias("ranges"))
    at = tops.groupBy("image_id").agg(F.collect_list(F.struct(clip("cy").alias("y"), clip("cx").alias("x"))).alias("tops"))

    def inside(cell: Column) -> Column:
        reached = F.exists(
            "ranges",
            lambda r: (cell["x"] >= r["cx0"]) & (cell["x"] < r["cx1"]) & (cell["y"] >= r["cy0"]) & (cell["y"] < r["cy1"]),
        )
        return F.coalesce(reached, F.lit(False))

    total = lambda cells: F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["v"], F.lit(0.0)))
    peak = F.array_max(F.transform("grid", lambda c: F.struct(c["v"].alias("v"), (-c["y"]).alias("ny"), (-c["x"]).alias("nx"))))
    rows = (
        grids.join(images.join(at, "image_id", "left").hint("shuffle_hash"), "image_id")
        .select("image_id", "ranges", "tops", "grid", F.filter("grid", inside).alias("inner"))
        .select(
            "image_id", "ranges", "tops", peak.alias("peak"), F.size("grid").alias("all_n"), F.size("inner").alias("in_n"),
            total(F.col("grid")).alias("all_v"), total(F.col("inner")).alias("in_v"),
        )
        .groupBy("image_id").agg(
            F.sum("all_n").alias("all_n"), F.sum("in_n").alias("in_n"), F.sum("all_v").alias("all_v"), F.sum("in_v").alias("in_v"),
            F.max("peak").alias("peak"), F.first("ranges").alias("ranges"), F.first("tops").alias("tops"),
        )
    )
    lit = F.col("all_v") > 0
    peak_in = inside(F.struct((-F.col("peak.ny")).alias("y"), (-F.col("peak.nx")).alias("x")))
    return rows.select(
        "image_id",
        ratio("in_n", "all_n").alias("area"),
        F.when(lit, F.col("in_v") / F.col("all_v")).otherwise(0.0).alias("energy"),
        (lit & peak_in).alias("peak_in"),
        F.coalesce(F.exists("tops", inside), F.lit(False)).alias("top_in"),
    )


def localisation_summary(rows: DataFrame) -> DataFrame:
    """One row: counts, means and median overall, and means where the top location is in a box."""
    rows = checkpointed(rows)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    top = F.col("top_in")
    one = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("area").alias("box_area_mean"),
        share(top).alias("top_location_in_box"),
        F.count(F.when(top, 1)).alias("n_top_in_box"),
        F.avg("energy").alias("energy_mean"),
        share(F.col("peak_in")).alias("pointing"),
        F.avg(F.when(top, F.col("energy"))).alias("energy_mean_top_in_box"),
        F.avg(F.when(top, F.when(F.col("peak_in"), 1.0).otherwise(0.0))).alias("pointing_top_in_box"),
    )
    med = exact_quantiles(rows, [], "energy", [0.5]).agg(F.max("quantile").alias("energy_median"))
    return beside(one, med).select(
        "n", "n_top_in_box",
        *[
            round_to(c, 9).alias(c)
            for c in ("box_area_mean", "top_location_in_box", "energy_mean", "energy_median", "pointing",
                      "energy_mean_top_in_box", "pointing_top_in_box")
        ],
    )
