"""Per-image rollups, threshold sweeps and operating points.

Scores are stored with six decimals, so one arm has at most 1,000,001 distinct per-image scores.
Every window below runs over distinct scores or grid points of one arm, never over images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import ratio, round_to, wilson
from ..functions.ordering import running_totals
from ..session import checkpointed, spread_rows, task_parts

# Reporting thresholds, fine grid start, step and end (all in thousandths for the
# grid), matched false-alarm budgets, and the gap above which a tuned point is flagged.
COARSE_GRID = [0.10, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80]
FINE_START, FINE_STEP, FINE_POINTS = 10, 5, 159
BUDGETS = [0.05, 0.10, 0.15]
OPTIMISM_LIMIT = 0.03
WORST = 12

POS, NEG = "pos_test", "neg_test"


# ------------------------------------------------------------------ rollup
STORED_DECIMALS = 6


def per_image(photos: DataFrame, boxes: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, image_id, role, category, n_boxes, top, max_conf) for every photograph and arm.

    `top` is the raw best confidence and `max_conf` the stored one (six decimals); both are null
    when the arm never fired. Boxes are reduced to one row per photograph before the join, so
    the join and the rollup share one partitioning on image_id.
    """
    one = F.col("arm")
    wide = boxes.groupBy("image_id").agg(
        *[F.count(F.when(one == a, 1)).alias(f"n_{i}") for i, a in enumerate(arms)],
        *[F.max(F.when(one == a, F.col("conf"))).alias(f"t_{i}") for i, a in enumerate(arms)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("arm"),
                F.coalesce(F.col(f"n_{i}"), F.lit(0).cast("bigint")).alias("n_boxes"),
                F.col(f"t_{i}").alias("top"),
            )
            for i, a in enumerate(arms)
        ]
    )
    return (
        photos.join(wide, "image_id", "left")
        .select("image_id", "role", "category", F.explode_outer(cells).alias("c"))
        .select(
            "c.arm", "image_id", "role", "category", "c.n_boxes", "c.top",
            stored("c.top").alias("max_conf"),
        )
    )


def misaligned_images(runs: DataFrame, n_arms: int) -> DataFrame:
    """Photographs that some arm's run lacks, from (arm, image_id) rows; empty when aligned."""
    return (
        runs.groupBy("image_id")
        .agg(F.size(F.collect_set("arm")).alias("n_arms"))
        .filter(F.col("n_arms") != n_arms)
    )


# ------------------------------------------------------------------ sweeps
def fine_threshold(i: Column) -> Column:
    """The i-th fine threshold; one division gives the same double as the rounded literal."""
    return (F.lit(FINE_START) + F.lit(FINE_STEP) * i).cast("double") / F.lit(1000.0)


def fine_index(conf: Column) -> Column:
    """Last fine grid point at or below conf, -1 when it is under the whole grid."""
    guess = F.floor((conf * 1000 - FINE_START) / FINE_STEP)
    exact = (
        F.when(conf >= fine_threshold(guess + 1), guess + 1)
        .when(conf >= fine_threshold(guess), guess)
        .otherwise(guess - 1)
    )
    # greatest and least skip nulls, so a photograph that never fired needs its own branch
    return F.when(
        conf.isNotNull(), F.greatest(F.least(exact, F.lit(FINE_POINTS - 1)), F.lit(-1))
    )


def coarse_index(conf: Column) -> Column:
    total = F.lit(-1).cast("bigint")
    for t in COARSE_GRID:
        total = total + (conf >= F.lit(t)).cast("bigint")
    return total


def coarse_threshold(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in COARSE_GRID]), (i + 1).cast("int"))


FINE = (FINE_POINTS, fine_index, fine_threshold)
COARSE = (len(COARSE_GRID), coarse_index, coarse_threshold)


def fired_counts(
    images: DataFrame,
    boxes: DataFrame,
    by: list[str],
    grid: tuple[int, Callable, Callable] = FINE,
) -> DataFrame:
    """Photographs and boxes at or above every grid threshold, per `by` group.

    images: (by, role, top); boxes: (by, role, conf). Scores are bucketed by grid index, counted,
    and summed from the top of the grid: no threshold ever meets a detection.
    """
    points, index, threshold = grid
    pos, neg = F.col("role") == POS, F.col("role") == NEG
    one = F.lit(1)
    zero = F.lit(0).cast("bigint")
    img = images.groupBy(*by, index(F.col("top")).alias("i")).agg(
        F.count(F.when(pos, one)).alias("pos_images"),
        F.count(F.when(neg, one)).alias("neg_images"),
        zero.alias("neg_boxes"),
        zero.alias("pos_boxes"),
    )
    box = boxes.groupBy(*by, index(F.col("conf")).alias("i")).agg(
        zero.alias("pos_images"),
        zero.alias("neg_images"),
        F.count(F.when(neg, one)).alias("neg_boxes"),
        F.count(F.when(pos, one)).alias("pos_boxes"),
    )
    counts = ["pos_images", "neg_images", "neg_boxes", "pos_boxes"]
    both = img.unionByName(box).groupBy(*by, "i").agg(*[F.sum(c).alias(c) for c in counts])
    # A null or -1 index never fires but still counts as a photograph. One group's counts are at
    # most one row per grid point, so they fit an array and the sweep needs no join.
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))
    rows = both.groupBy(*by).agg(
        F.sum("pos_images").alias("n_pos"), F.sum("neg_images").alias("n_neg"),
        F.collect_list(F.struct("i", *counts)).alias("_points"),
    ).withColumn("i", F.explode(every))

    def from_top(c: str) -> Column:
        above = F.filter("_points", lambda x: x["i"] >= F.col("i"))
        return F.aggregate(above, zero, lambda acc, x: acc + x[c]).alias(c)

    return rows.select(
        *by, "i", threshold(F.col("i")).alias("confidence"), "n_pos", "n_neg", *[from_top(c) for c in counts]
    )


def sweep(counts: DataFrame, by: list[str]) -> DataFrame:
    """The fourteen image-level figures of every threshold, rounded as they are stored."""
    precision = ratio("pos_images", F.col("pos_images") + F.col("neg_images"))
    recall = ratio("pos_images", "n_pos")
    out = counts.withColumn("_p", precision).withColumn("_r", recall)
    f1 = F.when(F.col("_p") + F.col("_r") == 0, F.lit(0.0)).otherwise(
        2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))
    )
    d_lo, d_hi = wilson("pos_images", "n_pos")
    f_lo, f_hi = wilson("neg_images", "n_neg")
    return out.select(
        *by,
        "confidence",
        F.col("neg_images").alias("neg_images_fired"),
        "neg_boxes",
        round_to(ratio("neg_images", "n_neg"), 4).alias("fa_rate"),
        round_to(ratio("neg_boxes", "n_neg"), 3).alias("fa_boxes_per_image"),
        F.col("pos_images").alias("pos_images_fired"),
        round_to("_r", 4).alias("detection_rate"),
        round_to("_p", 4).alias("precision"),
        round_to("_r", 4).alias("recall"),
        round_to(f1, 4).alias("f1"),
        round_to(d_lo, 4).alias("detect_low"),
        round_to(d_hi, 4).alias("detect_high"),
        round_to(f_lo, 4).alias("fa_low"),
        round_to(f_hi, 4).alias("fa_high"),
    )


# ------------------------------------------------------------------ operating points
def first_best(rows: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group that sorts first; groups are sweeps, so at most one grid long."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*by, *keep)
    )


POINT = ["confidence", "detection_rate", "fa_rate", "f1"]


def oracle_point(rows: DataFrame, by: list[str]) -> DataFrame:
    """Highest stored F1, lowest threshold on ties."""
    return first_best(rows, by, [F.desc("f1"), F.asc("confidence")], POINT)


def carried_point(rows: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Grid row nearest the external threshold of each group, lowest on ties."""
    near = rows.join(thresholds.filter("threshold is not null"), by)
    gap = F.abs(F.col("confidence") - F.col("threshold"))
    return first_best(near, by, [gap.asc(), F.asc("confidence")], POINT)


def headline(rows: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Reported point: the carried-over one if there is one, else the tuned one, and its source."""
    best = oracle_point(rows, by).select(
        *by, *[F.col(c).alias(f"best_{c}") for c in POINT]
    )
    out = best.join(carried_point(rows, thresholds, by), by, "left")
    gap = F.col("best_f1") - F.coalesce("f1", "best_f1")
    return out.select(
        *by,
        *[F.coalesce(c, f"best_{c}").alias(c) for c in POINT],
        F.when(F.col("f1").isNotNull(), "synthetic validation").otherwise("test set").alias("source"),
        round_to(gap, 4).alias("optimism"),
        (round_to(gap, 4) > OPTIMISM_LIMIT).alias("flagged"),
    )


def best_curve_point(curve: DataFrame, by: list[str]) -> DataFrame:
    """Confidence and value at the peak of a mean F1 curve, first on ties.

    curve: (by, cls, confidence, f1), cls under any one other name. Both are null when a class misses a
    confidence that another class of the group has, or a value.
    """
    (cls,) = [c for c in curve.columns if c not in {*by, "confidence", "f1"}]
    mean = curve.groupBy(*by, "confidence").agg(
        F.avg("f1").alias("f1"), F.count(F.when(F.col("f1").isNull(), 1)).alias("gaps"),
        F.collect_set(cls).alias("classes"),
    )
    every = F.size(F.array_distinct(F.flatten(F.collect_set("classes"))))  # as many as a group has classes
    whole = mean.groupBy(*by).agg(
        (
            (F.sum("gaps") + F.count(F.when(F.col("confidence").isNull(), 1)) == 0)
            & (F.min(F.size("classes")) == every)
        ).alias("whole"),
        F.min(
            F.struct((-round_to("f1", 9)).alias("neg"), "confidence")
        ).alias("top"),
    )
    return whole.select(
        *by,
        F.when(F.col("whole"), F.col("top.confidence")).alias("confidence"),
        F.when(F.col("whole"), -F.col("top.neg")).alias("f1"),
    )


def worst_false_alarms(boxes: DataFrame, threshold: float, k: int = WORST) -> DataFrame:
    """Per arm, the k negatives that fire hardest, and how many fire at all."""
    hit = (
        boxes.filter((F.col("role") == NEG) & (F.col("conf") >= threshold))
        .groupBy("arm", "image_id")
        .agg(F.max("conf").alias("top"), F.count(F.lit(1)).alias("n_boxes"))
    )
    total = hit.groupBy("arm").agg(F.count(F.lit(1)).alias("n_fired"))
    w = Window.partitionBy("arm").orderBy(F.desc("top"), F.desc("n_boxes"), "image_id")
    worst = hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return worst.join(total, "arm").select(
        "arm", "rank", "image_id", round_to("top", 6).alias("max_conf"), "n_boxes", "n_fired"
    )


# ------------------------------------------------------------------ matched budgets
def stored(score) -> Column:
    """A score as it is stored, in six decimals: at most 1,000,001 values whatever the table."""
    return round_to(score, STORED_DECIMALS)


def score_of(raw: bool) -> Column:
    """The stored score, or the score as it came (`top`)."""
    return F.col("top") if raw else stored("max_conf")


SALTS = 64  # parts of the photographs that share a raw score


def score_levels(
    images: DataFrame, by: list[str] | None = None, raw: bool = False, rows: int | None = None
) -> DataFrame:
    """(by, score, pos, neg): photographs at every distinct stored score, or at every raw one.

    The row with a null score holds the photographs that never fired. Raw scores, of which there may be as many
    as photographs, are counted in parts of bounded size; `rows` says about how many rows `images` has, which
    are counted otherwise. They are salted first, so that a score that many share fills no part of its own.
    """
    by = by or ["arm"]
    level = [*by, score_of(raw).alias("score")]
    counts = [
        F.count(F.when(F.col("role") == POS, 1)).alias("pos"),
        F.count(F.when(F.col("role") == NEG, 1)).alias("neg"),
    ]
    if raw:
        rows = images.count() if rows is None else rows
    if not raw or task_parts(rows) <= images.sparkSession.sparkContext.defaultParallelism:
        return images.groupBy(*level).agg(*counts)
    salted = images.select(*level, "role", F.pmod(F.xxhash64("image_id"), F.lit(SALTS)).alias("_salt"))
    parts = spread_rows(salted, rows, *by, "score", "_salt").groupBy(*by, "score", "_salt").agg(*counts)
    return spread_rows(parts, rows, *by, "score").groupBy(*by, "score").agg(*[F.sum(c).alias(c) for c in ("pos", "neg")])


def falling(by: list[str]):
    """The order of every curve: highest score first, the never-fired row last."""
    return Window.partitionBy(*by).orderBy(F.col("score").desc_nulls_last())


def cumulative_curve(levels: DataFrame, by: list[str] | None = None, ranged: bool = False) -> DataFrame:
    """(by, score, hits, alarms, n_pos, n_neg, det, fa): cumulative from the highest score down.

    Totals and running sums share one sort, in one task an arm; stored scores are few enough for that.
    With `ranged`, levels are summed in ranges (for raw scores, of which there may be as many as
    photographs) and there is also `vertex`, the level's number. The never-fired row stays, with a null
    det and fa.
    """
    by = by or ["arm"]
    fired = F.col("score").isNotNull()
    if ranged:
        sums = {"hits": "pos", "alarms": "neg", "vertex": "_one"}
        ones = checkpointed(levels.withColumn("_one", F.lit(1)))
        rows = running_totals(ones, by, [F.col("score").desc_nulls_last()], sums, ones.count())
        curve = rows.withColumnsRenamed({"hits_total": "n_pos", "alarms_total": "n_neg"}).drop("_one", "vertex_total")
    else:
        upto = falling(by).rowsBetween(Window.unboundedPreceding, 0)
        whole = falling(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        curve = (
            levels.withColumn("hits", F.sum("pos").over(upto))
            .withColumn("alarms", F.sum("neg").over(upto))
            .withColumn("n_pos", F.sum("pos").over(whole))
            .withColumn("n_neg", F.sum("neg").over(whole))
        )
    return curve.withColumn("det", F.when(fired, ratio("hits", "n_pos"))).withColumn("fa", F.when(fired, ratio("alarms", "n_neg")))


def detection_at_budgets(
    images: DataFrame, budgets: list[float] = BUDGETS, by: list[str] | None = None, raw: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """(by, budget, detection, threshold, censored): exact best detection within each budget.

    Threshold is the lowest one that meets the budget, infinity when only firing nowhere does.
    Censored means that even the lowest score stays within the budget. Scores are the stored ones, or with
    `raw` those of `top`, however many (`rows`: see score_levels).
    """
    by = by or ["arm"]
    curve = cumulative_curve(score_levels(images, by, raw, rows), by, ranged=raw)
    cols = []
    for i, b in enumerate(budgets):
        ok = F.col("fa") <= F.lit(b)
        cols += [
            F.max(F.when(ok, F.col("det"))).alias(f"d{i}"),
            F.min(F.when(ok, F.col("score"))).alias(f"t{i}"),
        ]
    best = curve.groupBy(*by).agg(*cols, F.max("fa").alias("lowest_fa"))
    cells = F.array(
        *[
            F.struct(
                F.lit(b).alias("budget"),
                F.coalesce(F.col(f"d{i}"), F.lit(0.0)).alias("detection"),
                F.coalesce(F.col(f"t{i}"), F.lit(float("inf"))).alias("threshold"),
                F.coalesce(F.col("lowest_fa") <= F.lit(b), F.lit(False)).alias("censored"),
            )
            for i, b in enumerate(budgets)
        ]
    )
    return best.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def image_hits(images: DataFrame, budget: float, raw: bool = False, rows: int | None = None) -> DataFrame:
    """Every photograph with its hit flag at the matched budget; never-fired is never a hit."""
    points = detection_at_budgets(images, [budget], raw=raw, rows=rows).select("arm", "threshold")
    return images.join(F.broadcast(points), "arm").select(  # one row per arm
        "arm", "image_id", "role", "category",
        F.coalesce(score_of(raw) >= F.col("threshold"), F.lit(False)).alias("hit"),
    )
