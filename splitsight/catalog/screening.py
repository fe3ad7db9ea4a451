"""Queries for screening, extraction logs and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import round_to
from ..operators import draws as D, screen as C, visibility as V
from ..sources import testdata as td
from .splits import alloc_sql
from .views import BOX, LINE_KEY, SCREEN, rnd, unit, with_

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


COLLAGE = 10
KEEP = 120


def alpha_values(s, d) -> DataFrame:
    return td.screening_boxes(s, d).select("item", F.col("conf").alias("value"))


register(
    "V1_alpha_metrics",
    lambda s, d: C.alpha_metrics(alpha_values(s, d)).select(
        "item", round_to("solid", 9).alias("solid"), round_to("haze", 9).alias("haze")
    ),
    with_(SCREEN)
    + f"""SELECT item, {rnd('count(*) FILTER (conf > 0.9::DOUBLE) / greatest(count(*) FILTER (conf > 0.05::DOUBLE), 1)', 9)} AS solid,
  {rnd('count(*) FILTER (conf > 0.05::DOUBLE AND conf < 0.9::DOUBLE) / greatest(count(*) FILTER (conf > 0.05::DOUBLE), 1)', 9)} AS haze
FROM ibox GROUP BY item""",
)


def content(s, d) -> DataFrame:
    return C.content_summary(td.screening_boxes(s, d), "RF", ["NO"], 0.98)


CONTENT = """content AS (
  SELECT item, bool_or(cls = 'RF' AND conf >= 0.98::DOUBLE) AS person, count(*) FILTER (cls = 'NO') AS n_devices,
         max(cls) FILTER (rn = 1) AS dominant, max(conf) FILTER (rn = 1) AS dominant_conf
  FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY area DESC, seq) AS rn FROM ibox) GROUP BY item)"""
register(
    "V2_content_summary",
    lambda s, d: content(s, d).withColumn("dominant_conf", round_to("dominant_conf", 9)),
    with_(SCREEN, CONTENT)
    + f"SELECT item, person, n_devices, dominant, {rnd('dominant_conf', 9)} AS dominant_conf FROM content",
)


def log(s, d) -> DataFrame:
    return C.screening_log(td.screening_items(s, d), content(s, d), COLLAGE)


SLOG = f"""slog AS (
  SELECT item, coalesce(category, '') AS category, solid, haze, coalesce(person, false) AS person,
         coalesce(n_devices, 0) AS n_devices, coalesce(dominant, '') AS dominant,
         CASE WHEN solid < 0.25::DOUBLE THEN 'matting failure' WHEN person THEN 'contains a person'
              WHEN n_devices >= {COLLAGE} THEN 'multi-device collage' ELSE '' END AS reason
  FROM item LEFT JOIN content USING (item)),
vlog AS (SELECT *, CASE WHEN reason = '' THEN 'keep' ELSE 'reject' END AS verdict FROM slog)"""
register(
    "V3_screening_verdict",
    lambda s, d: log(s, d).select(
        "item", "category", round_to("solid", 4).alias("solid"), round_to("haze", 4).alias("haze"), "person",
        "n_devices", "dominant", "verdict", "reason",
    ),
    with_(SCREEN, CONTENT, SLOG)
    + f"""SELECT item, category, {rnd('solid', 4)} AS solid, {rnd('haze', 4)} AS haze, person, n_devices, dominant,
  verdict, reason FROM vlog""",
)


# ------------------------------------------------------------------ extraction
def attempts(s, d) -> DataFrame:
    """One extraction attempt per page: a page number that does not parse is an error, a page
    without html is empty, and the number also stands for size and coverage."""
    p = td.table(s, d, "pages")
    number = F.regexp_extract("url", r"/([0-9]+)", 1).try_cast("int")
    cover = number / F.lit(1000.0)
    reason = (
        F.when(number.isNull(), "ValueError: no page number")
        .when(F.length("html") == 0, "empty alpha")
        .when(~C.passes_quality(cover, number, number + 5), "failed quality gate")
    )
    return p.select(
        F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("role"),
        F.regexp_extract("url", r"example\.[a-z]+/([a-z]+)/", 1).alias("category"),
        F.col("url").alias("source_path"), reason.alias("reason"), "page_id", number.alias("number"),
    )


ATTEMPTS = """att AS (
  SELECT regexp_extract(url, 'example\\.([a-z]+)', 1) AS role,
         regexp_extract(url, 'example\\.[a-z]+/([a-z]+)/', 1) AS category, url AS source_path, page_id, num,
         CASE WHEN num IS NULL THEN 'ValueError: no page number' WHEN length(html) = 0 THEN 'empty alpha'
              WHEN NOT (num / 1000.0::DOUBLE > 0.02::DOUBLE AND num / 1000.0::DOUBLE < 0.97::DOUBLE AND num >= 40)
              THEN 'failed quality gate' ELSE '' END AS reason
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS INT) AS num FROM pages)),
elog AS (
  SELECT role, category, source_path,
         CASE WHEN reason = '' THEN role || '_' || printf('%04d', row_number() OVER (PARTITION BY role, reason = '' ORDER BY page_id)) || '.png' END AS output,
         (reason = '')::INT AS kept, reason FROM att)"""


def extraction(s, d) -> DataFrame:
    return C.extraction_log(attempts(s, d), "page_id")


def items_of_pages(s, d) -> DataFrame:
    """Cut-out names to look up: one per page and role, some of which were never made."""
    roles = attempts(s, d).select("role", "page_id")
    return roles.select(
        "page_id", F.concat("role", F.lit("_"), F.format_string("%04d", F.col("page_id") + 1), F.lit(".png")).alias("item")
    )


register(
    "V4_category_from_log",
    lambda s, d: C.category_from_log(items_of_pages(s, d), extraction(s, d)),
    with_(ATTEMPTS)
    + """SELECT page_id, item, coalesce(e.category, '') AS category
FROM (SELECT page_id, role || '_' || printf('%04d', page_id + 1) || '.png' AS item FROM att) i
LEFT JOIN elog e ON e.output = i.item""",
)
register(
    "V5_reject_histogram",
    lambda s, d: C.reject_histogram(log(s, d)),
    with_(SCREEN, CONTENT, SLOG)
    + "SELECT reason, count(*) AS n FROM vlog WHERE verdict = 'reject' GROUP BY 1 ORDER BY n DESC, reason",
)


def report(s, d) -> DataFrame:
    rows = log(s, d)
    kept = rows.filter("verdict = 'keep'").select("item", "category")
    return C.screening_report(rows, D.stratified_select(kept, KEEP, "item"))


register(
    "V5_screening_report",
    report,
    with_(SCREEN, CONTENT, SLOG)
    + f"""SELECT 'candidates' AS line, count(*) AS n FROM vlog UNION ALL
SELECT 'passed', count(*) FROM vlog WHERE verdict = 'keep' UNION ALL
SELECT 'rejected: ' || reason, count(*) FROM vlog WHERE verdict = 'reject' GROUP BY reason UNION ALL
SELECT 'selected', least({KEEP}, (SELECT count(*) FROM vlog WHERE verdict = 'keep'))""",
)
register(
    "V6_calibration_quantiles",
    lambda s, d: C.calibration_quantiles(td.screening_items(s, d)).withColumn("quantile", round_to("quantile", 9)),
    with_(SCREEN)
    + " UNION ALL ".join(
        f"SELECT '{m}' AS measure, {q}::DOUBLE AS prob, {rnd(f'quantile_cont({m}, {q})', 9)} AS quantile FROM item"
        for m, levels in (("solid", C.SOLID_LEVELS), ("haze", C.HAZE_LEVELS))
        for q in levels
    ),
)
register(
    "V6_calibration_rejects",
    lambda s, d: C.calibration_rejects(td.screening_items(s, d)).withColumn("share", round_to("share", 9)),
    with_(SCREEN)
    + f"""SELECT t AS threshold, count(*) FILTER (solid < t) AS n,
  {rnd('count(*) FILTER (solid < t)::DOUBLE / count(*)::DOUBLE', 9)} AS share
FROM item CROSS JOIN (SELECT unnest([0.2, 0.3, 0.35, 0.4, 0.5, 0.6]::DOUBLE[]) AS t) GROUP BY t""",
)
register(
    "V6_lowest_solid",
    lambda s, d: C.lowest(td.screening_items(s, d)),
    with_(SCREEN) + "SELECT item, solid, haze FROM item ORDER BY solid, item LIMIT 10",
)
register(
    "V7_extraction_log",
    extraction,
    with_(ATTEMPTS) + "SELECT * FROM elog",
)
register(
    "V8_quality_gate",
    lambda s, d: attempts(s, d).select(
        "page_id",
        F.coalesce(C.passes_quality(F.col("number") / F.lit(1000.0), F.col("number"), F.col("number") + 5), F.lit(False)).alias("passes"),
    ),
    with_(ATTEMPTS)
    + """SELECT page_id, coalesce(num / 1000.0::DOUBLE > 0.02::DOUBLE AND num / 1000.0::DOUBLE < 0.97::DOUBLE
  AND least(num, num + 5) >= 40, false) AS passes FROM att""",
)


# ------------------------------------------------------------------ visibility
def objects(s, d) -> DataFrame:
    return V.run_visibility(td.layer_runs(s, d), min_side=2)


VISIBLE = f"""cells AS (
  SELECT image_id, box_id AS obj, ('0x' || substr(md5(concat_ws('|', 'z', image_id, box_id)), 1, 15))::BIGINT AS z, x, y FROM box
  CROSS JOIN LATERAL (SELECT unnest(range(x0 // 25, (x1 - 1) // 25 + 1)) AS x)
  CROSS JOIN LATERAL (SELECT unnest(range(y0 // 25, (y1 - 1) // 25 + 1)) AS y)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY z DESC) AS rk FROM cells),
vis AS (
  SELECT image_id, obj, count(*) AS n_cells, count(*) FILTER (rk = 1) AS n_visible,
         min(x) FILTER (rk = 1) AS x0, min(y) FILTER (rk = 1) AS y0,
         max(x) FILTER (rk = 1) AS x1, max(y) FILTER (rk = 1) AS y1
  FROM ranked GROUP BY ALL),
phi AS (
  SELECT *, n_visible::DOUBLE / n_cells::DOUBLE AS phi,
         coalesce(n_visible::DOUBLE / n_cells::DOUBLE >= 0.35::DOUBLE AND x1 - x0 >= 2 AND y1 - y0 >= 2, false) AS labelled
  FROM vis)"""
register(
    "V9_object_visibility",
    lambda s, d: objects(s, d).withColumn("phi", round_to("phi", 9)),
    with_(BOX, VISIBLE)
    + f"""SELECT image_id, obj, n_cells, n_visible, {rnd('phi', 9)} AS phi, labelled,
  CASE WHEN labelled THEN x0 END AS x0, CASE WHEN labelled THEN y0 END AS y0,
  CASE WHEN labelled THEN x1 + 1 END AS x1, CASE WHEN labelled THEN y1 + 1 END AS y1 FROM phi""",
)
register(
    "V10_visibility_summary",
    lambda s, d: V.visibility_summary(objects(s, d)),
    with_(BOX, VISIBLE, "img AS (SELECT image_id, bool_or(labelled) AS any_label FROM phi GROUP BY 1)")
    + f"""SELECT count(*) AS n_objects, count(*) FILTER (phi >= 0.35::DOUBLE) AS n_retained,
  count(*) FILTER (phi >= 0.999::DOUBLE) AS n_full, (SELECT count(*) FROM img) AS n_images,
  (SELECT count(*) FROM img WHERE NOT any_label) AS n_empty, {rnd('avg(phi)', 9)} AS mean,
  {rnd('quantile_cont(phi, 0.1)', 9)} AS p10, {rnd('quantile_cont(phi, 0.5)', 9)} AS median,
  {rnd('quantile_cont(phi, 0.9)', 9)} AS p90,
  {rnd('count(*) FILTER (phi >= 0.35::DOUBLE)::DOUBLE / count(*)::DOUBLE', 9)} AS retained,
  {rnd('(SELECT count(*) FROM img WHERE NOT any_label)::DOUBLE / (SELECT count(*) FROM img)::DOUBLE', 9)} AS empty
FROM phi""",
)
register(
    "V11_visibility_histogram",
    lambda s, d: V.unit_histogram(objects(s, d), "phi"),
    with_(BOX, VISIBLE)
    + """SELECT b AS bin, count(phi) AS n FROM (SELECT i::INT AS b FROM range(0, 40) t(i))
LEFT JOIN phi ON phi >= b * 0.025::DOUBLE AND (phi < (b + 1) * 0.025::DOUBLE OR b = 39) GROUP BY b""",
)
