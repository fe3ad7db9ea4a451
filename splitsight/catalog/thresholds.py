"""Queries for rollups, sweeps and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import round_to, wilson
from ..operators import thresholds as T
from ..sources import testdata as td
from .views import ARM, BOX, IMAGES, PHOTO, rnd, wilson as wilson_sql, with_


def images(spark, d) -> DataFrame:
    return T.per_image(td.photos(spark, d), td.scored(spark, d), td.ARMS)


def image_rows(spark, d) -> int:
    """About how many rows `images` has."""
    return len(td.ARMS) * td.table(spark, d, "orders").count()


def external_thresholds(spark, d) -> DataFrame:
    """A validation threshold per arm, from its number of detections; the last arm has none."""
    n = td.table(spark, d, "lineitem").groupBy(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("arm")
    ).agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        "arm",
        F.when(F.col("arm") != "m3", 0.2 + (F.col("n") % 97).cast("double") / 200.0).alias("threshold"),
    )


EXTERNAL = """ext AS (
  SELECT arm, CASE WHEN arm <> 'm3' THEN 0.2::DOUBLE + (n % 97)::DOUBLE / 200.0::DOUBLE END AS threshold
  FROM (SELECT 'm' || (l_suppkey % 4)::VARCHAR AS arm, count(*) AS n FROM lineitem GROUP BY 1))"""


def grid_counts(spark, d, grid=T.FINE, by=("arm",)) -> DataFrame:
    img = images(spark, d)
    boxes = td.scored(spark, d)
    if "category" in by:
        boxes = boxes.join(td.photos(spark, d).select("image_id", "category"), "image_id")
    return T.fired_counts(img, boxes, list(by), grid)


def fine_sweep(spark, d) -> DataFrame:
    return T.sweep(grid_counts(spark, d), ["arm"])


def coarse_sweep(spark, d) -> DataFrame:
    return T.sweep(grid_counts(spark, d, T.COARSE), ["arm"])


# ------------------------------------------------------------------ SQL building blocks
FINE_GRID = "grid AS (SELECT i, (10 + 5 * i)::DOUBLE / 1000.0::DOUBLE AS confidence FROM range(0, 159) t(i))"
COARSE_GRID = (
    "grid AS (SELECT i - 1 AS i, ([0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[])[i]"
    " AS confidence FROM range(1, 10) t(i))"
)


def counts_sql(by: str = "arm") -> str:
    """Brute force: every threshold against every image and box."""
    box = "box" if by == "arm" else "(SELECT b.*, p.category FROM box b JOIN photo p USING (image_id))"
    keys = "arm" if by == "arm" else "arm, category"
    return f"""ic AS (
  SELECT {keys}, i, confidence,
         count(*) FILTER (role = 'pos_test' AND top >= confidence) AS pos_images,
         count(*) FILTER (role = 'neg_test' AND top >= confidence) AS neg_images,
         count(*) FILTER (role = 'pos_test') AS n_pos,
         count(*) FILTER (role = 'neg_test') AS n_neg
  FROM img CROSS JOIN grid GROUP BY ALL),
bc AS (
  SELECT {keys}, i, count(*) FILTER (role = 'neg_test' AND conf >= confidence) AS neg_boxes,
         count(*) FILTER (role = 'pos_test' AND conf >= confidence) AS pos_boxes
  FROM {box} CROSS JOIN grid GROUP BY ALL),
counts AS (SELECT * FROM ic JOIN bc USING ({keys}, i))"""


def sweep_sql(keys: str = "arm") -> str:
    dl, dh = wilson_sql("pos_images", "n_pos")
    fl, fh = wilson_sql("neg_images", "n_neg")
    return f"""pr AS (
  SELECT *, CASE WHEN pos_images + neg_images = 0 THEN 0.0::DOUBLE
              ELSE pos_images::DOUBLE / (pos_images + neg_images)::DOUBLE END AS p,
         CASE WHEN n_pos = 0 THEN 0.0::DOUBLE ELSE pos_images::DOUBLE / n_pos::DOUBLE END AS r
  FROM counts),
sweep AS (
  SELECT {keys}, confidence, neg_images AS neg_images_fired, neg_boxes,
         {rnd('neg_images::DOUBLE / n_neg::DOUBLE', 4)} AS fa_rate,
         {rnd('neg_boxes::DOUBLE / n_neg::DOUBLE', 3)} AS fa_boxes_per_image,
         pos_images AS pos_images_fired, {rnd('r', 4)} AS detection_rate,
         {rnd('p', 4)} AS precision, {rnd('r', 4)} AS recall,
         {rnd('CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END', 4)} AS f1,
         {rnd(f'greatest(0.0::DOUBLE, {dl})', 4)} AS detect_low,
         {rnd(f'least(1.0::DOUBLE, {dh})', 4)} AS detect_high,
         {rnd(f'greatest(0.0::DOUBLE, {fl})', 4)} AS fa_low,
         {rnd(f'least(1.0::DOUBLE, {fh})', 4)} AS fa_high
  FROM pr)"""


POINTS = """best AS (
  SELECT arm, confidence, detection_rate, fa_rate, f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY arm ORDER BY f1 DESC, confidence) AS rn FROM sweep)
  WHERE rn = 1)"""
CARRIED = """carried AS (
  SELECT arm, confidence, detection_rate, fa_rate, f1 FROM (
    SELECT s.*, row_number() OVER (PARTITION BY arm ORDER BY abs(confidence - threshold), confidence) AS rn
    FROM sweep s JOIN ext USING (arm) WHERE threshold IS NOT NULL)
  WHERE rn = 1)"""

# distinct scores against all images by self-join: slow but independent of the window form
LEVELS = """lv AS (
  SELECT arm, max_conf AS score, count(*) FILTER (role = 'pos_test') AS pos,
         count(*) FILTER (role = 'neg_test') AS neg
  FROM img WHERE max_conf IS NOT NULL GROUP BY ALL),
tot AS (
  SELECT arm, count(*) FILTER (role = 'pos_test') AS n_pos,
         count(*) FILTER (role = 'neg_test') AS n_neg FROM img GROUP BY ALL),
roc AS (
  SELECT arm, score, n_pos, n_neg,
         (sum(pos) OVER w)::BIGINT AS hits, (sum(neg) OVER w)::BIGINT AS alarms,
         (sum(pos) OVER w)::DOUBLE / n_pos::DOUBLE AS det,
         (sum(neg) OVER w)::DOUBLE / n_neg::DOUBLE AS fa
  FROM lv JOIN tot USING (arm)
  WINDOW w AS (PARTITION BY arm ORDER BY score DESC RANGE UNBOUNDED PRECEDING))"""
BUDGET = """budgets AS (SELECT unnest([0.05, 0.1, 0.15]::DOUBLE[]) AS budget),
matched AS (
  SELECT arm, budget, coalesce(max(det) FILTER (fa <= budget), 0.0::DOUBLE) AS detection,
         coalesce(min(score) FILTER (fa <= budget), 'inf'::DOUBLE) AS threshold,
         coalesce(max(fa) <= budget, false) AS censored
  FROM tot CROSS JOIN budgets LEFT JOIN roc USING (arm) GROUP BY arm, budget)"""

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


register(
    "T1_per_image",
    lambda s, d: images(s, d).drop("top"),
    with_(IMAGES) + "SELECT arm, image_id, role, category, n_boxes, max_conf FROM img",
)
register(
    "T2_fine_grid_occupancy",
    lambda s, d: td.scored(s, d)
    .withColumn("i", T.fine_index(F.col("conf")))
    .filter("i >= 0")
    .groupBy(round_to(T.fine_threshold(F.col("i")), 4).alias("confidence"))
    .agg(F.count(F.lit(1)).alias("n_boxes")),
    with_(BOX, FINE_GRID)
    + """SELECT t AS confidence, count(*) AS n_boxes FROM (
  SELECT max(confidence) AS t FROM (SELECT row_number() OVER () AS k, conf FROM box)
  JOIN grid ON conf >= confidence GROUP BY k) GROUP BY 1""",
)
register(
    "T3_fired_counts",
    lambda s, d: grid_counts(s, d).drop("i"),
    with_(IMAGES, FINE_GRID, counts_sql())
    + "SELECT arm, confidence, n_pos, n_neg, pos_images, neg_images, neg_boxes, pos_boxes FROM counts",
)


def wilson_rates(s, d):
    n = images(s, d).groupBy("arm", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count("max_conf").alias("k")
    )
    lo, hi = wilson("k", "n")
    ulo, uhi = wilson("k", "n", clamp=False)
    return n.select(
        "arm", "category", "k", "n", round_to(lo, 9).alias("low"), round_to(hi, 9).alias("high"),
        round_to(ulo, 9).alias("open_low"), round_to(uhi, 9).alias("open_high"),
    )


_lo, _hi = wilson_sql("k", "n")
register(
    "T4_wilson_intervals",
    wilson_rates,
    with_(IMAGES)
    + f"""SELECT arm, category, k, n, {rnd(f'greatest(0.0::DOUBLE, {_lo})', 9)} AS low,
  {rnd(f'least(1.0::DOUBLE, {_hi})', 9)} AS high, {rnd(_lo, 9)} AS open_low, {rnd(_hi, 9)} AS open_high
FROM (SELECT arm, category, count(max_conf) AS k, count(*) AS n FROM img GROUP BY ALL)""",
)
register(
    "T5_fine_sweep",
    fine_sweep,
    with_(IMAGES, FINE_GRID, counts_sql(), sweep_sql()) + "SELECT * FROM sweep",
)
register(
    "T5_coarse_sweep",
    coarse_sweep,
    with_(IMAGES, COARSE_GRID, counts_sql(), sweep_sql()) + "SELECT * FROM sweep",
)
register(
    "T6_oracle_point",
    lambda s, d: T.oracle_point(fine_sweep(s, d), ["arm"]),
    with_(IMAGES, FINE_GRID, counts_sql(), sweep_sql(), POINTS) + "SELECT * FROM best",
)
register(
    "T6_oracle_point_coarse",
    lambda s, d: T.oracle_point(coarse_sweep(s, d), ["arm"]),
    with_(IMAGES, COARSE_GRID, counts_sql(), sweep_sql(), POINTS) + "SELECT * FROM best",
)
register(
    "T7_carried_point",
    lambda s, d: T.carried_point(fine_sweep(s, d), external_thresholds(s, d), ["arm"]),
    with_(IMAGES, FINE_GRID, counts_sql(), sweep_sql(), EXTERNAL, CARRIED) + "SELECT * FROM carried",
)
register(
    "T8_headline",
    lambda s, d: T.headline(fine_sweep(s, d), external_thresholds(s, d), ["arm"]),
    with_(IMAGES, FINE_GRID, counts_sql(), sweep_sql(), POINTS, EXTERNAL, CARRIED)
    + f"""SELECT arm, coalesce(c.confidence, b.confidence) AS confidence,
  coalesce(c.detection_rate, b.detection_rate) AS detection_rate,
  coalesce(c.fa_rate, b.fa_rate) AS fa_rate, coalesce(c.f1, b.f1) AS f1,
  CASE WHEN c.f1 IS NOT NULL THEN 'synthetic validation' ELSE 'test set' END AS source,
  {rnd('b.f1 - coalesce(c.f1, b.f1)', 4)} AS optimism,
  {rnd('b.f1 - coalesce(c.f1, b.f1)', 4)} > 0.03::DOUBLE AS flagged
FROM best b LEFT JOIN carried c USING (arm)""",
)
register(
    "T9_worst_false_alarms",
    lambda s, d: T.worst_false_alarms(td.scored(s, d), 0.25),
    with_(BOX)
    + f"""SELECT arm, rank, image_id, {rnd('top', 6)} AS max_conf, n_boxes, n_fired FROM (
  SELECT *, row_number() OVER (PARTITION BY arm ORDER BY top DESC, n_boxes DESC, image_id) AS rank,
         count(*) OVER (PARTITION BY arm) AS n_fired
  FROM (SELECT arm, image_id, max(conf) AS top, count(*) AS n_boxes FROM box
        WHERE role = 'neg_test' AND conf >= 0.25::DOUBLE GROUP BY ALL)) WHERE rank <= 12""",
)
register(
    "T10_detection_at_budgets",
    lambda s, d: T.detection_at_budgets(images(s, d)).drop("threshold"),
    with_(IMAGES, LEVELS, BUDGET) + "SELECT arm, budget, detection, censored FROM matched",
)
register(
    "T11_operating_points",
    lambda s, d: T.detection_at_budgets(images(s, d)).select("arm", "budget", "threshold"),
    with_(IMAGES, LEVELS, BUDGET) + "SELECT arm, budget, threshold FROM matched",
)
register(
    "T11_image_hits",
    lambda s, d: T.image_hits(images(s, d), 0.10),
    with_(IMAGES, LEVELS, BUDGET)
    + """SELECT arm, image_id, role, category, coalesce(max_conf >= threshold, false) AS hit
FROM img JOIN matched USING (arm) WHERE budget = 0.1::DOUBLE""",
)


# the same on scores as they came, of which there may be as many as photographs
RAW_LEVELS = LEVELS.replace("max_conf", "top")
register(
    "T10_detection_at_budgets_raw",
    lambda s, d: T.detection_at_budgets(images(s, d), raw=True, rows=image_rows(s, d)),
    with_(IMAGES, RAW_LEVELS, BUDGET) + "SELECT * FROM matched",
)
register(
    "T11_image_hits_raw",
    lambda s, d: T.image_hits(images(s, d), 0.10, raw=True, rows=image_rows(s, d)),
    with_(IMAGES, RAW_LEVELS, BUDGET)
    + """SELECT arm, image_id, role, category, coalesce(top >= threshold, false) AS hit
FROM img JOIN matched USING (arm) WHERE budget = 0.1::DOUBLE""",
)


def curve_peak(s, d):
    rows = T.sweep(grid_counts(s, d, T.FINE, ("arm", "category")), ["arm", "category"])
    return T.best_curve_point(rows.select("arm", "category", "confidence", "f1"), ["arm"])


register(
    "T12_f1_curve_peak",
    curve_peak,
    with_(IMAGES, FINE_GRID, counts_sql("arm, category"), sweep_sql("arm, category"))
    + f"""SELECT arm, confidence, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY arm ORDER BY f1 DESC, confidence) AS rn FROM (
    SELECT arm, confidence, {rnd('avg(f1)', 9)} AS f1 FROM sweep GROUP BY ALL)) WHERE rn = 1""",
)


def curve_peak_with_hole(s, d):
    """The curve of arm m1 lacks low confidences of one class, so that arm has no peak."""
    rows = T.sweep(grid_counts(s, d, T.FINE, ("arm", "category")), ["arm", "category"])
    hole = (F.col("arm") == "m1") & (F.col("category") == "BUILDING") & (F.col("confidence") < 0.2)
    return T.best_curve_point(rows.filter(~hole).select("arm", "category", "confidence", "f1"), ["arm"])


register(
    "T12_f1_curve_with_hole",
    curve_peak_with_hole,
    with_(IMAGES, FINE_GRID, counts_sql("arm, category"), sweep_sql("arm, category"))
    + f"""SELECT arm, CASE WHEN whole THEN confidence END AS confidence, CASE WHEN whole THEN f1 END AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY arm ORDER BY f1 DESC, confidence) AS rn,
         min(n) OVER (PARTITION BY arm) = max(n) OVER (PARTITION BY arm) AS whole FROM (
    SELECT arm, confidence, count(DISTINCT category) AS n, {rnd('avg(f1)', 9)} AS f1 FROM sweep
    WHERE NOT (arm = 'm1' AND category = 'BUILDING' AND confidence < 0.2::DOUBLE) GROUP BY ALL)) WHERE rn = 1""",
)
register(
    "T13_misaligned_images",
    lambda s, d: T.misaligned_images(td.scored(s, d).select("arm", "image_id"), len(td.ARMS)),
    with_(BOX)
    + """SELECT image_id, count(DISTINCT arm)::INT AS n_arms FROM box GROUP BY 1
HAVING count(DISTINCT arm) <> 4""",
)
