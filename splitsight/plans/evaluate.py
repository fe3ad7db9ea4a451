"""Evaluate arms: rollup, both sweeps, operating points, worst false alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import thresholds as T
from ..session import checkpointed


def evaluate_arms(
    photos: DataFrame, boxes: DataFrame, thresholds: DataFrame, arms: list[str], worst_at: float = 0.25
) -> dict[str, DataFrame]:
    """photos: (image_id, role, category); boxes: (image_id, arm, role, conf); thresholds: (arm,
    threshold). The rollup is stored once; everything after it reads at most one grid per arm.
    """
    images = checkpointed(T.per_image(photos, boxes, arms))
    fine = T.sweep(T.fired_counts(images, boxes, ["arm"], T.FINE), ["arm"])
    coarse = T.sweep(T.fired_counts(images, boxes, ["arm"], T.COARSE), ["arm"])
    fine = checkpointed(fine)
    return {
        "per_image": images.drop("top"),
        "coarse_sweep": coarse,
        "fine_sweep": fine,
        "oracle_point": T.oracle_point(fine, ["arm"]),
        "headline": T.headline(fine, thresholds, ["arm"]),
        "worst_false_alarms": T.worst_false_alarms(boxes, worst_at),
    }
