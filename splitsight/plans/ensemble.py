"""Fuse the members' boxes and place the ensemble's operating point on validation boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import round_to
from ..operators import boxes as X, fusion as W, thresholds as T
from ..session import checkpointed

NAME = "ensemble"


def evaluate_ensemble(
    photos: DataFrame, boxes: DataFrame, weights: DataFrame, truths: DataFrame
) -> dict[str, DataFrame]:
    """photos: (image_id, role, category); boxes: (image_id, arm, box_id, conf, box); weights:
    (arm, ord, weight); truths: (image_id, truth_id, box) of the labelled photographs.

    The threshold is the box-level F1 peak of the fused boxes on the labelled photographs, and
    the reported point the sweep row nearest to it.
    """
    keys = ["arm", "image_id"]
    fused = W.fuse_detections(photos.select("image_id", "role"), boxes, weights)
    fused = checkpointed(fused.filter("conf is not null").withColumn("arm", F.lit(NAME)))
    truth = truths.withColumn("arm", F.lit(NAME))
    labelled = fused.join(truths.select("image_id").distinct(), "image_id", "left_semi").select(
        *keys, F.concat_ws("-", "crowd", "cluster").alias("pred_id"), "conf", *X.XYXY
    )
    flags = X.flag_matches(labelled, X.greedy_match(labelled, truth, keys), keys)
    n = truth.groupBy("arm").agg(F.count(F.lit(1)).alias("n_truth"))
    peak = X.best_box_f1(flags.select("arm", "conf", "tp"), n, ["arm"])
    dets = fused.select(*keys, "role", "conf")
    images = T.per_image(photos, dets, [NAME])
    rows = T.sweep(T.fired_counts(images, dets, ["arm"]), ["arm"])
    point = T.carried_point(rows, peak.select("arm", F.col("confidence").alias("threshold")), ["arm"])
    return {
        "fused": fused,
        "per_image": images.drop("top"),
        "fine_sweep": rows,
        "headline": point.join(peak.select("arm", round_to("f1", 9).alias("box_f1")), "arm"),
    }
