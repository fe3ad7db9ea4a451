"""Compare arms: matched budgets, curves, intervals, paired tests, contrasts and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import mcnemar_exact
from ..operators import counted as C, resample as B, stats as S, thresholds as T
from ..session import checkpointed


def compare_arms(
    images: DataFrame, arms: list[str], contrasts: DataFrame, budget: float = 0.10,
    bootstrap_reps: int = 2000, calibration_reps: int = 1000,
) -> dict[str, DataFrame]:
    """images: (arm, image_id, role, category, max_conf), stored per-image scores of every arm."""
    images = checkpointed(images)
    levels = S.arm_levels(images)
    hits = checkpointed(T.image_hits(images, budget))
    pos = hits.filter(F.col("role") == T.POS)
    counts = checkpointed(S.pair_counts(pos, arms))
    n_pos = pos.agg(F.countDistinct("image_id").alias("n_pos"))
    matched = T.detection_at_budgets(images)
    tests = S.holm(counts.withColumn("p", mcnemar_exact("a_only", "b_only")), [], ["arm_a", "arm_b"])
    return {
        "misaligned": T.misaligned_images(images, len(arms)),
        "matched": matched,
        "roc": S.roc_curve(levels, ["arm"]),
        "area": S.partial_area(levels, ["arm"]),
        "area_interval": C.area_bootstrap(images, bootstrap_reps),
        "pairs": tests,
        "matrix": S.difference_matrix(tests, matched.filter(F.col("budget") == F.lit(budget))),
        "ablation": S.ablation(counts, contrasts, n_pos),
        "categories": S.category_hits(hits),
        "conformal": B.conformal_summary(C.conformal_rates(images, calibration_reps)),
    }
