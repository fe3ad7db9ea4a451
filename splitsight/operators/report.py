"""The comparison table: collecting summaries, display cells, leaders and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import fixed, round_to, run_name

# Column -> decimals shown, and column -> whether higher is better (ranked ones).
SHOWN = {
    "det_fa05": 1, "det_fa10": 1, "det_fa15": 1, "detect_rate": 1, "fa_rate": 1, "f1": 3,
    "map50": 3, "latency_ms": 1, "fps": 1, "params_m": 2, "size_mb": 1, "train_min": 1,
}
RANKED = {
    "det_fa05": True, "det_fa10": True, "det_fa15": True, "latency_ms": False, "fps": True,
    "params_m": False, "size_mb": False,
}
BUDGET_COLUMN = {0.05: "det_fa05", 0.10: "det_fa10", 0.15: "det_fa15"}


def collect_table(
    catalogue: DataFrame, summaries: DataFrame, matched: DataFrame, headline: DataFrame,
    epochs: DataFrame, timed: DataFrame,
) -> DataFrame:
    """One row per catalogued arm that has a summary. Every input has at most one row per arm
    (matched: per arm and budget). The interleaved latency replaces the run's own figure."""
    wide = matched.groupBy("arm").agg(
        *[
            F.max(F.when(F.col("budget") == F.lit(b), F.col("detection") * 100)).alias(c)
            for b, c in BUDGET_COLUMN.items()
        ],
        F.array_sort(
            F.collect_set(
                F.when(
                    F.col("censored"),
                    F.element_at(
                        F.create_map(*[F.lit(x) for kv in BUDGET_COLUMN.items() for x in kv]),
                        F.col("budget"),
                    ),
                )
            )
        ).alias("censored"),
    )
    timed = timed.select(
        "arm", F.col("latency_ms").alias("t_ms"), F.col("fps").alias("t_fps")
    )
    points = headline.select("arm", "detection_rate", F.col("fa_rate").alias("h_fa"), "f1")
    return (
        catalogue.join(summaries, "arm")
        .join(wide, "arm", "left")
        .join(points, "arm", "left")
        .join(epochs, "arm", "left")
        .join(timed, "arm", "left")
        .select(
            "ord", "arm", "label", *BUDGET_COLUMN.values(),
            (F.col("detection_rate") * 100).alias("detect_rate"),
            (F.col("h_fa") * 100).alias("fa_rate"),
            "f1",
            F.col("synthetic.map50").alias("map50"),
            F.when(F.col("t_ms").isNotNull(), F.col("t_ms"))
            .otherwise(F.col("capacity.latency_ms")).alias("latency_ms"),
            F.when(F.col("t_ms").isNotNull(), F.col("t_fps"))
            .otherwise(F.col("capacity.fps")).alias("fps"),
            (F.col("capacity.n_params") / F.lit(1e6)).alias("params_m"),
            F.col("capacity.model_size_mb").alias("size_mb"),
            "epochs_run",
            "best_epoch",
            (F.col("synthetic.train_seconds") / F.lit(60.0)).alias("train_min"),
            F.coalesce("censored", F.array().cast("array<string>")).alias("censored"),
        )
    )


def missing_arms(catalogue: DataFrame, summaries: DataFrame) -> DataFrame:
    return catalogue.join(summaries, "arm", "left_anti").select("ord", "arm", "label")


def unpivot_metrics(table: DataFrame, metrics: list[str]) -> DataFrame:
    """(arm, metric, value, censored) from the wide table."""
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return table.select("arm", "censored", F.explode(cells).alias("c")).select(
        "arm", "c.metric", "c.value", F.array_contains("censored", F.col("c.metric")).alias("bound")
    )


def display_cells(table: DataFrame) -> DataFrame:
    """(arm, metric, text): '-' for null, '>=' before a lower bound, fixed decimals."""
    long = unpivot_metrics(table, list(SHOWN))
    text = F.lit(None).cast("string")
    for m, digits in SHOWN.items():
        text = F.when(F.col("metric") == m, fixed("value", digits)).otherwise(text)
    return long.select(
        "arm",
        "metric",
        F.when(F.col("value").isNull(), "-")
        .otherwise(F.concat(F.when(F.col("bound"), ">=").otherwise(""), text))
        .alias("text"),
    )


def column_leaders(table: DataFrame) -> DataFrame:
    """(metric, arm, value) of every arm that ties for best in a ranked column."""
    long = unpivot_metrics(table, list(RANKED)).filter("value is not null")
    higher = F.col("metric").isin([m for m, up in RANKED.items() if up])
    group = Window.partitionBy("metric")  # one row per arm in each column
    best = F.when(higher, F.max("value").over(group)).otherwise(F.min("value").over(group))
    return (
        long.withColumn("best", best)
        .filter("value = best")
        .select("metric", "arm", round_to("value", 6).alias("value"))
    )


def best_per_budget(matched: DataFrame, groups: DataFrame) -> DataFrame:
    """Matched detection with a flag on the best of each budget and the arm's display group."""
    best = F.max("detection").over(Window.partitionBy("budget"))
    return matched.join(groups, "arm").select(
        "grp", "arm", "budget", round_to("detection", 9).alias("detection"),
        (F.abs(F.col("detection") - best) < 1e-12).alias("is_best"),
    )


def arm_coverage(catalogue: DataFrame, listing: DataFrame, pool: int) -> DataFrame:
    """(arm, label, run, trained, evaluated, pending) from the paths of stored artefacts."""
    run = run_name(F.lit(pool), "tag", F.lit(0))
    files = listing.select("path").distinct()
    arms = catalogue.withColumn("run", run)
    flags = (
        arms.select(
            "arm",
            F.explode(
                F.array(
                    F.struct(
                        F.lit("trained").alias("what"),
                        F.concat(F.lit("runs/detect/"), "run", F.lit("/weights/best.pt")).alias("path"),
                    ),
                    F.struct(
                        F.lit("evaluated").alias("what"),
                        F.concat(F.lit("evaluation/"), "run", F.lit("/summary.json")).alias("path"),
                    ),
                )
            ).alias("w"),
        )
        .select("arm", "w.*")
        .join(files.withColumn("there", F.lit(True)), "path", "left")
        .groupBy("arm")
        .agg(
            F.max(F.when(F.col("what") == "trained", F.coalesce("there", F.lit(False)))).alias("trained"),
            F.max(F.when(F.col("what") == "evaluated", F.coalesce("there", F.lit(False)))).alias("evaluated"),
        )
    )
    return arms.join(flags, "arm").select(
        "arm", "label", "run", "trained", "evaluated", (~F.col("trained")).alias("pending")
    )
