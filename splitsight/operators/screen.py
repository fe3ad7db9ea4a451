"""Screening rules, row-level logs with reject reasons, and calibration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import exact_quantiles, linear_bucket, positions

# Screening limits, quantile levels and candidate thresholds of the report.
MIN_SOLID = 0.25
MAX_DEVICES = 3
PERSON_CONF = 0.50
SOLID_LEVELS = [0.02, 0.05, 0.10, 0.25, 0.50, 0.75, 0.95]
HAZE_LEVELS = [0.05, 0.25, 0.50, 0.75, 0.95]
REJECT_AT = [0.20, 0.30, 0.35, 0.40, 0.50, 0.60]
MIN_COVERAGE, MAX_COVERAGE, MIN_SIDE = 0.02, 0.97, 40


def alpha_metrics(values: DataFrame) -> DataFrame:
    """(item, solid, haze): shares of the foreground (above 0.05) that are above 0.9 and below it."""
    v = F.col("value")
    n = F.greatest(F.count(F.when(v > 0.05, 1)), F.lit(1))
    return values.groupBy("item").agg(
        (F.count(F.when(v > 0.9, 1)) / n).alias("solid"),
        (F.count(F.when((v > 0.05) & (v < 0.9), 1)) / n).alias("haze"),
    )


def content_summary(
    boxes: DataFrame, person: str, devices: list[str], person_conf: float = PERSON_CONF
) -> DataFrame:
    """(item, person, n_devices, dominant, dominant_conf) over each item's detections.

    The dominant class is that of the largest box, the first one on ties. One map-side combined
    aggregate, so an item with very many boxes needs no sort.
    """
    largest = F.min(F.struct((-F.col("area")).alias("a"), "seq", "cls", "conf"))
    return boxes.groupBy("item").agg(
        F.bool_or((F.col("cls") == person) & (F.col("conf") >= F.lit(person_conf))).alias("person"),
        F.count(F.when(F.col("cls").isin(devices), 1)).alias("n_devices"),
        largest.alias("top"),
    ).select(
        "item", "person", "n_devices", F.col("top.cls").alias("dominant"), F.col("top.conf").alias("dominant_conf")
    )


def reject_reason(solid: Column, person: Column, n_devices: Column, max_devices: int = MAX_DEVICES) -> Column:
    """Ordered rules; '' keeps the item."""
    return (
        F.when(solid < MIN_SOLID, "matting failure")
        .when(person, "contains a person")
        .when(n_devices >= max_devices, "multi-device collage")
        .otherwise("")
    )


def screening_log(items: DataFrame, content: DataFrame, max_devices: int = MAX_DEVICES) -> DataFrame:
    """(item, category, solid, haze, person, n_devices, dominant, verdict, reason) of every item.

    An item without a detection row counts as showing nothing.
    """
    rows = items.join(content, "item", "left").select(
        "item", F.coalesce("category", F.lit("")).alias("category"), "solid", "haze",
        F.coalesce("person", F.lit(False)).alias("person"),
        F.coalesce("n_devices", F.lit(0).cast("bigint")).alias("n_devices"),
        F.coalesce("dominant", F.lit("")).alias("dominant"),
    )
    reason = reject_reason(F.col("solid"), F.col("person"), F.col("n_devices"), max_devices)
    return rows.withColumn("reason", reason).withColumn(
        "verdict", F.when(F.col("reason") == "", "keep").otherwise("reject")
    )


def category_from_log(items: DataFrame, log: DataFrame) -> DataFrame:
    """Add `category` from the extraction log's successful rows; '' when it has none."""
    made = log.filter(F.coalesce("output", F.lit("")) != "").select(
        F.col("output").alias("item"), F.col("category").alias("_cat")
    )
    return items.join(made, "item", "left").withColumn("category", F.coalesce("_cat", F.lit(""))).drop("_cat")


def screening_report(log: DataFrame, selected: DataFrame) -> DataFrame:
    """(line, n): candidates, each reject reason, passed and selected."""
    totals = log.agg(
        F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("verdict") == "keep", 1)).alias("passed")
    ).select(F.explode(F.array(
        F.struct(F.lit("candidates").alias("line"), F.col("candidates").alias("n")),
        F.struct(F.lit("passed").alias("line"), F.col("passed").alias("n")),
    )).alias("c")).select("c.*")
    return (
        totals.unionByName(reject_histogram(log).select(F.concat(F.lit("rejected: "), "reason").alias("line"), "n"))
        .unionByName(selected.agg(F.lit("selected").alias("line"), F.count(F.lit(1)).alias("n")))
    )


def reject_histogram(log: DataFrame) -> DataFrame:
    """(reason, n) of rejected rows, most common first."""
    return (
        log.filter("verdict = 'reject'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


# ------------------------------------------------------------------ calibration report
def calibration_quantiles(items: DataFrame) -> DataFrame:
    """(measure, prob, quantile) of the solid and haze shares, both from the same scans."""
    measures = {"solid": SOLID_LEVELS, "haze": HAZE_LEVELS}
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in measures])
    both = exact_quantiles(items.select(F.explode(cells).alias("c")).select("c.*"), ["measure"], "v", sorted({*SOLID_LEVELS, *HAZE_LEVELS}))
    asked = F.lit(False)
    for c, levels in measures.items():
        asked = asked | ((F.col("measure") == c) & F.col("prob").isin(*levels))
    return both.filter(asked)


def calibration_rejects(items: DataFrame) -> DataFrame:
    """(threshold, n, share) that each candidate threshold on solid would reject."""
    sums = items.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col("solid") < t, 1)).alias(f"r{i}") for i, t in enumerate(REJECT_AT)],
    )
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.col(f"r{i}").alias("n"),
                     (F.col(f"r{i}") / F.greatest(F.col("total"), F.lit(1))).alias("share"))
            for i, t in enumerate(REJECT_AT)
        ]
    )
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def lowest(items: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest solid shares."""
    return items.select("item", "solid", "haze").orderBy("solid", "item").limit(k)


# ------------------------------------------------------------------ extraction
def passes_quality(coverage: Column, width: Column, height: Column) -> Column:
    """Coverage strictly between 2 % and 97 %, shortest side at least 40."""
    return (
        (coverage > MIN_COVERAGE) & (coverage < MAX_COVERAGE) & (F.least(width, height) >= MIN_SIDE)
    )


def extraction_log(rows: DataFrame, order: str) -> DataFrame:
    """(role, category, source_path, output, kept, reason) with successes numbered per role.

    rows: (role, category, source_path, reason, order); a null or '' reason is a success. Its
    output is '<role>_<number>.png', numbered densely in `order`.
    """
    ok = F.coalesce("reason", F.lit("")) == ""
    good = positions(linear_bucket(rows.filter(ok), ["role"], order), ["role"], [order]).select(
        "role", "category", "source_path",
        F.concat("role", F.lit("_"), F.format_string("%04d", F.col("pos") + 1), F.lit(".png")).alias("output"),
        F.lit(1).alias("kept"), F.lit("").alias("reason"),
    )
    bad = rows.filter(~ok).select(
        "role", "category", "source_path", F.lit(None).cast("string").alias("output"),
        F.lit(0).alias("kept"), "reason",
    )
    return good.unionByName(bad)
