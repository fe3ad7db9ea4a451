"""Exact paired tests, corrections, ROC areas, category breakdowns and series summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import (
    mcnemar_exact, paired_difference, ratio, round_to, stars,
)
from ..functions.ordering import FEW_ROWS, beside, exact_quantiles, linear_bucket, meet, rows_at
from ..session import checkpointed
from .thresholds import NEG, POS, cumulative_curve, falling, score_levels

AREA_LIMIT = 0.15
UNSTABLE_SPREAD = 10.0


# ------------------------------------------------------------------ paired comparisons
def pair_counts(hits: DataFrame, arms: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, arm_a, arm_b, a_only, b_only) for every pair of arms, a before b.

    hits: (by, image_id, arm, hit). Each photograph becomes the sorted set of the arms that hit it;
    photographs with the same set are counted together, so pairs are formed per set and not per
    photograph. Any number of arms will do.
    """
    by = by or []
    hit_by = F.sort_array(F.collect_set(F.when(F.col("hit") & F.col("arm").isin(arms), F.col("arm"))))
    sets = (
        hits.groupBy(*by, "image_id")
        .agg(hit_by.alias("hit_by"))
        .groupBy(*by, "hit_by")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(a) for a in arms])
    pairs = F.flatten(
        F.transform(
            names,
            lambda a, i: F.transform(
                F.slice(names, i + 2, len(arms)), lambda b: F.struct(a.alias("arm_a"), b.alias("arm_b"))
            ),
        )
    )
    has = lambda k: F.array_contains(F.col("hit_by"), F.col(f"pair.arm_{k}"))
    return (
        sets.withColumn("pair", F.explode(pairs))
        .groupBy(*by, "pair.arm_a", "pair.arm_b")
        .agg(
            F.sum(F.when(has("a") & ~has("b"), F.col("n")).otherwise(0)).alias("a_only"),
            F.sum(F.when(has("b") & ~has("a"), F.col("n")).otherwise(0)).alias("b_only"),
        )
    )


def holm(tests: DataFrame, family: list[str], key: list[str], p: str = "p") -> DataFrame:
    """Add `holm`: step-down adjusted p-values within each family."""
    tests = tests if family else tests.withColumn("_fam", F.lit(0))
    fam = family or ["_fam"]
    order = Window.partitionBy(*fam).orderBy(p, *key)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("_rank", F.row_number().over(order)).withColumn(
        "_m", F.count(F.lit(1)).over(Window.partitionBy(*fam))
    )
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_rank") + 1) * F.col(p))
    return ranked.withColumn("holm", F.max(step).over(upto)).drop("_rank", "_m", "_fam")


def ablation(
    pairs: DataFrame, contrasts: DataFrame, n_pos: DataFrame
) -> DataFrame:
    """Named contrasts (family, ref, variant): effect, paired interval, p and own Holm family.

    pairs holds each pair once; a contrast in the other direction swaps the two counts. `n_pos`
    is a one-row table with the number of positives, keyed by nothing.
    """
    both = pairs.select(
        F.col("arm_a").alias("ref"), F.col("arm_b").alias("variant"),
        F.col("b_only").alias("gain"), F.col("a_only").alias("loss"),
    ).unionByName(
        pairs.select(
            F.col("arm_b").alias("ref"), F.col("arm_a").alias("variant"),
            F.col("a_only").alias("gain"), F.col("b_only").alias("loss"),
        )
    )
    rows = beside(contrasts.join(both, ["ref", "variant"]), n_pos)
    d, lo, hi = paired_difference("gain", "loss", "n_pos")
    rows = rows.select(
        "family", "ref", "variant", "gain", "loss", d.alias("effect"), lo.alias("low"),
        hi.alias("high"), mcnemar_exact("gain", "loss").alias("p"),
    )
    out = holm(rows, [], ["ref", "variant"])
    return out.withColumn("mark", stars("holm"))


def difference_matrix(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """Lower triangle of pairwise differences, arms in falling order of detection.

    pairs: (arm_a, arm_b, holm); rates: (arm, detection), one row per arm.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("detection"), "arm")
    ranked = rates.select("arm", "detection", F.row_number().over(order).alias("rank"))
    a = ranked.select(
        F.col("arm").alias("arm_a"), F.col("detection").alias("da"), F.col("rank").alias("ra")
    )
    b = ranked.select(
        F.col("arm").alias("arm_b"), F.col("detection").alias("db"), F.col("rank").alias("rb")
    )
    m = pairs.join(a, "arm_a").join(b, "arm_b")
    lower = F.col("ra") > F.col("rb")
    pick = lambda x, y: F.when(lower, F.col(x)).otherwise(F.col(y))
    return m.select(
        pick("arm_a", "arm_b").alias("row_arm"),
        pick("arm_b", "arm_a").alias("col_arm"),
        round_to((pick("da", "db") - pick("db", "da")) * 100, 6).alias("points"),
        round_to("holm", 9).alias("holm"),
        (F.col("holm") < 0.05).alias("significant"),
        stars("holm").alias("mark"),
    )


# ------------------------------------------------------------------ ROC
def roc_curve(levels: DataFrame, by: list[str], ranged: bool = False) -> DataFrame:
    """(by, vertex, fa, det) from the origin through every distinct score, highest first."""
    number = F.col("vertex").cast("int") if ranged else F.row_number().over(falling(by))
    curve = cumulative_curve(levels, by, ranged).select(*by, number.alias("vertex"), "score", "fa", "det")
    vertex = lambda k, fa, det: F.struct(k.alias("vertex"), fa.alias("fa"), det.alias("det"))
    here = vertex(F.col("vertex"), F.col("fa"), F.col("det"))
    origin = vertex(F.lit(0), F.lit(0.0), F.lit(0.0))
    fired = F.col("score").isNotNull()
    # the origin rides along with each group's first row
    rows = F.when(F.col("vertex") == 1, F.when(fired, F.array(origin, here)).otherwise(F.array(origin))).when(
        fired, F.array(here)
    )
    return curve.select(*by, F.explode(rows).alias("v")).select(*by, "v.*")


def partial_area(levels: DataFrame, by: list[str], limit: float = AREA_LIMIT, ranged: bool = False) -> DataFrame:
    """(by, area): trapezoid area for false alarms up to `limit`, closed there, over `limit`."""
    steps = cumulative_curve(levels, by, ranged).withColumn(
        "fa0", ratio(F.col("alarms") - F.col("neg"), "n_neg")
    ).withColumn("det0", ratio(F.col("hits") - F.col("pos"), "n_pos"))
    kept = F.col("fa") <= F.lit(limit)
    strip = (F.col("fa") - F.col("fa0")) * (F.col("det") + F.col("det0")) / 2
    area = steps.groupBy(*by).agg(
        F.sum(F.when(kept, strip)).alias("body"),
        F.max(F.when(kept, F.col("fa"))).alias("fa"),
        F.max(F.when(kept, F.col("det"))).alias("det"),
    )
    closing = F.coalesce((F.lit(limit) - F.col("fa")) * F.col("det"), F.lit(0.0))
    return area.select(*by, ((F.coalesce("body", F.lit(0.0)) + closing) / F.lit(limit)).alias("area"))


def arm_levels(images: DataFrame, raw: bool = False, rows: int | None = None) -> DataFrame:
    return score_levels(images, ["arm"], raw, rows)


# ------------------------------------------------------------------ categories and examples
def category_hits(hits: DataFrame) -> DataFrame:
    """(arm, role, category, k, n)."""
    return hits.groupBy("arm", "role", "category").agg(
        F.count(F.when(F.col("hit"), 1)).alias("k"), F.count(F.lit(1)).alias("n")
    )


def category_rates(counts: DataFrame, arms: list[str]) -> DataFrame:
    """One row per role and category, one rate column per arm."""
    return counts.groupBy("role", "category").pivot("arm", arms).agg(
        round_to(F.first(ratio("k", "n")), 9)
    )


def typical_examples(images: DataFrame, points: DataFrame, n_alarms: int = 6) -> DataFrame:
    """Per arm: two hits nearest their category's median, each category's lowest miss, top alarms.

    images: (arm, image_id, role, category, max_conf); points: (arm, threshold), one row per arm.
    A photograph that never fired counts as 0 here. Every task keeps only the first rows of each list before they
    are shuffled, so no list is sorted whole.
    """
    kind = (
        F.when(F.col("role") == NEG, F.lit("alarm"))
        .when(F.col("role") == POS, F.when(F.col("c") >= F.col("threshold"), F.lit("hit")).otherwise(F.lit("miss")))
    )
    scored = checkpointed(
        images.select("arm", "image_id", "role", "category", F.coalesce("max_conf", F.lit(0.0)).alias("c"))
        .join(F.broadcast(points), "arm").select("arm", "image_id", "category", "c", kind.alias("kind")).filter("kind is not null")
    )
    med = checkpointed(
        exact_quantiles(scored.filter("kind = 'hit'"), ["arm", "category"], "c", [0.5])
        .select("arm", "category", F.col("quantile").alias("med"))
    )
    few = med.count() <= FEW_ROWS  # one row for each arm and category
    keys = ["arm", "category"]
    placed = scored.join(F.broadcast(med), keys, "left") if few else meet(scored, med, keys, ["image_id"])
    # the order within its list: hits by their distance from the median, misses from below, alarms from above
    order = (
        F.when(F.col("kind") == "hit", round_to(F.abs(F.col("c") - F.col("med")), 9))
        .when(F.col("kind") == "miss", F.col("c")).otherwise(-F.col("c"))
    )
    most = F.when(F.col("kind") == "hit", 2).when(F.col("kind") == "miss", 1).otherwise(n_alarms)
    of = F.when(F.col("kind") != "alarm", F.col("category"))
    ranked = placed.select(
        "kind", "arm", "category", "image_id", "c",
        F.row_number().over(Window.partitionBy("arm", "kind", of).orderBy(order, "image_id")).alias("rank"),
    )
    longest = max(2, n_alarms)  # a number, by which Spark cuts the lists in every task before it shuffles them
    return ranked.filter(F.col("rank") <= longest).filter(F.col("rank") <= most).select("kind", "arm", "category", "rank", "image_id", "c")


def evenly_spaced(rows: DataFrame, by: list[str], value: str, key: str, points: int = 6) -> DataFrame:
    """Rows at the middle of `points` equal shares of the order by value."""
    shares = [(2 * i + 1) / (2 * points) for i in range(points)]
    return rows_at(linear_bucket(rows, by, value), by, [value, key], shares)


# ------------------------------------------------------------------ series
def running_mean(curve: DataFrame, width: int = 7) -> DataFrame:
    """Centred running mean of each arm's curve; the ends repeat the first and last value."""
    half = width // 2
    order = Window.partitionBy("arm").orderBy("epoch")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = order.rowsBetween(-half, half)
    pos = F.row_number().over(order)
    n = F.count(F.lit(1)).over(whole)
    before = F.greatest(F.lit(0), half - (pos - 1))
    after = F.greatest(F.lit(0), half - (n - pos))
    total = (
        F.sum("metric").over(near)
        + before * F.first("metric").over(whole)
        + after * F.last("metric").over(whole)
    )
    return curve.select("arm", "epoch", round_to(total / width, 9).alias("smooth"))


def convergence(curve: DataFrame) -> DataFrame:
    """(arm, epochs_run, best_epoch, best_index): last epoch, epoch of the first maximum, and its
    1-based place in the curve."""
    order = Window.partitionBy("arm").orderBy("epoch")
    rows = curve.withColumn("index", F.row_number().over(order))
    return rows.groupBy("arm").agg(
        F.max("epoch").alias("epochs_run"),
        F.min(F.struct((-F.col("metric")).alias("m"), "epoch", "index")).alias("b"),
    ).select("arm", "epochs_run", F.col("b.epoch").alias("best_epoch"),
             F.col("b.index").alias("best_index"))


def latency_summary(rounds: DataFrame, discard: int = 1) -> DataFrame:
    """Per arm over its rounds (a benchmark's few dozen), without the first `discard` ones."""
    order = Window.partitionBy("arm").orderBy("round")
    kept = rounds.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") > discard)
    s = kept.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.min("ms").alias("lo"),
        F.max("ms").alias("hi"),
        F.percentile("ms", F.lit(0.5)).alias("med"),
    )
    spread = (F.col("hi") - F.col("lo")) / F.col("lo") * 100
    return s.select(
        "arm",
        "n_rounds",
        round_to("lo", 2).alias("latency_ms"),
        round_to("med", 2).alias("median_ms"),
        round_to(F.lit(1000.0) / F.col("lo"), 1).alias("fps"),
        round_to((F.col("med") - F.col("lo")) / F.col("lo") * 100, 1).alias("contention_pct"),
        round_to(spread, 1).alias("spread_pct"),
        (spread > UNSTABLE_SPREAD).alias("unstable"),
    )


def call_time_median(calls: DataFrame, warmup: int = 20) -> DataFrame:
    """(arm, n_calls, median_ms, fps) of timed calls after each arm's first `warmup` calls.

    calls: (arm, call_id, seq, ms). The warm-up rows are a bounded top-k per arm, which Spark
    limits before the shuffle; the median comes from bucket counts.
    """
    order = Window.partitionBy("arm").orderBy("seq", "call_id")
    warm = (
        calls.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= warmup)
        .select("call_id")
    )
    timed = calls.join(F.broadcast(warm), "call_id", "left_anti")
    med = exact_quantiles(timed, ["arm"], "ms", [0.5], count="n_calls")
    return med.select(
        "arm", "n_calls", round_to("quantile", 2).alias("median_ms"),
        round_to(F.lit(1000.0) / F.col("quantile"), 1).alias("fps"),
    )
