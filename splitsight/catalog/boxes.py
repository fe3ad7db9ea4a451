"""Queries for box overlap, matching, fusion and localisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import iou, round_to
from ..operators import boxes as X, fusion as W, thresholds as T
from ..plans.ensemble import evaluate_ensemble
from ..sources import testdata as td
from .stats import CAT_SQL, arm_totals, catalogue
from .thresholds import CARRIED, FINE_GRID, POINTS, counts_sql, fine_sweep, sweep_sql
from .views import ARM, BOX, IMAGES, TRUTH, h, rnd, unit, with_

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def iou_sql(a: str, b: str) -> str:
    inter = (f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))::DOUBLE"
             f" * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))::DOUBLE)")
    area = lambda t: f"(({t}.x1 - {t}.x0)::DOUBLE * ({t}.y1 - {t}.y0)::DOUBLE)"
    return f"({inter} / ({area(a)} + {area(b)} - {inter}))"


def preds(s, d) -> DataFrame:
    return td.detections(s, d).filter(F.col("role") == T.POS).withColumnRenamed("box_id", "pred_id")


def arm_truths(s, d) -> DataFrame:
    return td.truths(s, d).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in td.ARMS])))


KEYS = ["arm", "image_id"]


def matches(s, d) -> DataFrame:
    return X.greedy_match(preds(s, d), arm_truths(s, d), KEYS)


def flagged(s, d) -> DataFrame:
    p = preds(s, d)
    return X.flag_matches(p, X.greedy_match(p, arm_truths(s, d), KEYS), KEYS)


def truth_counts(s, d) -> DataFrame:
    return arm_truths(s, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n_truth"))


# every photograph has one truth, so the match is the first box in order that reaches it
MATCH = f"""hit AS (
  SELECT b.arm, b.image_id, b.box_id AS pred_id, t.truth_id, {iou_sql('b', 't')} AS iou,
         row_number() OVER (PARTITION BY b.arm, b.image_id ORDER BY conf DESC, box_id DESC) AS rn
  FROM box b JOIN truth t USING (image_id) WHERE {iou_sql('b', 't')} >= 0.5::DOUBLE),
matched AS (SELECT arm, image_id, pred_id, truth_id, iou FROM hit WHERE rn = 1),
flagged AS (
  SELECT b.*, m.pred_id IS NOT NULL AS tp FROM box b
  LEFT JOIN matched m ON m.arm = b.arm AND m.image_id = b.image_id AND m.pred_id = b.box_id
  WHERE role = 'pos_test')"""

register(
    "B1_iou_with_truth",
    lambda s, d: preds(s, d).alias("p").join(td.truths(s, d).alias("t"), "image_id").select(
        "image_id", "p.arm", "p.pred_id",
        round_to(iou(tuple(f"p.{c}" for c in X.XYXY), tuple(f"t.{c}" for c in X.XYXY)), 9).alias("iou"),
    ),
    with_(BOX, TRUTH)
    + f"SELECT image_id, arm, box_id AS pred_id, {rnd(iou_sql('b', 't'), 9)} AS iou FROM box b JOIN truth t USING (image_id)",
)


def iou_pairs(s, d):
    b = td.raw_boxes(s, d)
    left = b.select("image_id", F.col("arm").alias("arm_a"), F.col("box_id").alias("box_a"), *X.XYXY)
    right = b.select("image_id", F.col("arm").alias("arm_b"), F.col("box_id").alias("box_b"), *X.XYXY)
    return X.overlapping_pairs(
        left, right, ["image_id"], ["arm_a", "box_a"], ["arm_b", "box_b"]
    ).filter("arm_a < arm_b")


register(
    "B2_iou_matrix",
    lambda s, d: iou_pairs(s, d).withColumn("iou", round_to("iou", 9)),
    with_(BOX)
    + f"""SELECT a.image_id, a.arm AS arm_a, a.box_id AS box_a, b.arm AS arm_b, b.box_id AS box_b,
  {rnd(iou_sql('a', 'b'), 9)} AS iou
FROM box a JOIN box b ON a.image_id = b.image_id AND a.arm < b.arm WHERE {iou_sql('a', 'b')} > 0""",
)
register(
    "B3_greedy_match",
    lambda s, d: matches(s, d).withColumn("iou", round_to("iou", 9)),
    with_(BOX, TRUTH, MATCH)
    + f"SELECT arm, image_id, pred_id, truth_id, {rnd('iou', 9)} AS iou FROM matched",
)


def crowded(s, d) -> DataFrame:
    """The boxes of two arms against those of the other two: several truths a photograph."""
    p = preds(s, d)
    truth = p.filter("arm in ('m0', 'm1')").select("image_id", F.concat_ws("/", "arm", "pred_id").alias("truth_id"), *X.XYXY)
    other = p.filter("arm in ('m2', 'm3')")
    return X.greedy_match(other, truth.withColumn("arm", F.explode(F.array(F.lit("m2"), F.lit("m3")))), KEYS)


# a walk over the predictions of each photograph and arm in order, all photographs at once
CROWDED = f"""option AS (
  SELECT b.arm, image_id, b.box_id AS pred_id, b.conf, t.arm || '/' || t.box_id AS truth_id, {iou_sql('b', 't')} AS iou
  FROM box b JOIN box t USING (image_id)
  WHERE b.role = 'pos_test' AND b.arm IN ('m2', 'm3') AND t.arm IN ('m0', 'm1') AND {iou_sql('b', 't')} >= 0.5::DOUBLE),
turn AS (
  SELECT arm, image_id, pred_id, list(struct_pack(iou := iou, truth_id := truth_id) ORDER BY iou DESC, truth_id DESC) AS options,
         row_number() OVER (PARTITION BY arm, image_id ORDER BY conf DESC, pred_id DESC) AS nth
  FROM option GROUP BY arm, image_id, pred_id, conf),
walk AS (
  SELECT arm, image_id, pred_id, nth, options[1] AS took, [options[1].truth_id] AS taken FROM turn WHERE nth = 1
  UNION ALL
  SELECT arm, image_id, pred_id, nth, free[1],
         CASE WHEN len(free) = 0 THEN taken ELSE list_append(taken, free[1].truth_id) END
  FROM (SELECT t.*, taken, list_filter(options, lambda o: NOT list_contains(taken, o.truth_id)) AS free
        FROM walk w JOIN turn t ON t.arm = w.arm AND t.image_id = w.image_id AND t.nth = w.nth + 1))"""
register(
    "B3_greedy_match_crowded",
    lambda s, d: crowded(s, d).withColumn("iou", round_to("iou", 9)),
    with_(BOX, CROWDED).replace("WITH", "WITH RECURSIVE", 1)
    + f"SELECT arm, image_id, pred_id, took.truth_id AS truth_id, {rnd('took.iou', 9)} AS iou FROM walk WHERE took IS NOT NULL",
)
register(
    "B4_box_counts",
    lambda s, d: X.box_counts(flagged(s, d), arm_truths(s, d), KEYS, 0.25),
    with_(BOX, TRUTH, MATCH, ARM)
    + """SELECT a.arm, t.image_id, count(f.box_id) FILTER (f.tp AND f.conf >= 0.25::DOUBLE) AS tp,
  count(f.box_id) FILTER (NOT f.tp AND f.conf >= 0.25::DOUBLE) AS fp,
  1 - count(f.box_id) FILTER (f.tp AND f.conf >= 0.25::DOUBLE) AS fn
FROM truth t CROSS JOIN arms a LEFT JOIN flagged f ON f.arm = a.arm AND f.image_id = t.image_id
GROUP BY a.arm, t.image_id""",
)
register(
    "B5_best_box_f1",
    lambda s, d: X.best_box_f1(flagged(s, d).select("arm", "conf", "tp"), truth_counts(s, d), ["arm"])
    .withColumn("f1", round_to("f1", 9)),
    with_(BOX, TRUTH, MATCH, FINE_GRID)
    + f"""SELECT arm, confidence, {rnd('f1', 9)} AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY arm ORDER BY f1 DESC, confidence) AS rn FROM (
    SELECT arm, confidence, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1 FROM (
      SELECT arm, confidence,
        CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n::DOUBLE END AS p,
        tp::DOUBLE / (SELECT count(*) FROM truth)::DOUBLE AS r
      FROM (SELECT arm, confidence, count(*) FILTER (tp AND conf >= confidence) AS tp,
              count(*) FILTER (conf >= confidence) AS n
            FROM flagged CROSS JOIN grid GROUP BY ALL)))) WHERE rn = 1""",
)


def members(s, d) -> DataFrame:
    return T.oracle_point(fine_sweep(s, d), ["arm"]).select("arm", "f1")


def weights(s, d) -> DataFrame:
    return W.member_weights(members(s, d), 2.0).select(
        "arm", F.substring("arm", 2, 1).cast("int").alias("ord"), "weight"
    )


MEMBERS = (
    IMAGES, FINE_GRID, counts_sql(), sweep_sql(), POINTS,
    "raw AS (SELECT arm, f1, pow(f1 / avg(f1) OVER (), 2.0::DOUBLE) AS raw FROM best)",
    "wt AS (SELECT arm, f1, raw * count(*) OVER () / sum(raw) OVER () AS weight FROM raw)",
)
register(
    "B6_member_weights",
    lambda s, d: W.member_weights(members(s, d), 2.0).select(
        "arm", "f1", round_to("weight", 9).alias("weight"), round_to("spread", 9).alias("spread")
    ),
    with_(*MEMBERS)
    + f"SELECT arm, f1, {rnd('weight', 9)} AS weight, {rnd('max(weight) OVER () / min(weight) OVER ()', 9)} AS spread FROM wt",
)


def artefacts(s, d) -> DataFrame:
    return arm_totals(s, d).filter("n % 2 = 0")


register(
    "B6_missing_members",
    lambda s, d: W.missing_members(catalogue(s), artefacts(s, d)),
    with_(CAT_SQL)
    + """SELECT arm FROM cat WHERE arm NOT IN (
  SELECT 'm' || (l_suppkey % 4)::VARCHAR FROM lineitem GROUP BY 1 HAVING count(*) % 2 = 0)""",
)


def fusion_boxes(s, d) -> DataFrame:
    return td.detections(s, d).select("image_id", "arm", "box_id", "conf", *X.XYXY)


def rounded(df: DataFrame, cols) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in cols], *[round_to(c, 6).alias(c) for c in cols])


def fused_sql(floor: float) -> str:
    """Fusion as a recursion over the boxes of each crowd in order, all crowds at once.

    A row carries the crowd's clusters with all their boxes, so every step weighs them anew.
    """
    inter = "greatest(0, least(c.box[3], b[3]) - greatest(c.box[1], b[1])) * greatest(0, least(c.box[4], b[4]) - greatest(c.box[2], b[2]))"
    area = lambda x: f"({x}[3] - {x}[1]) * ({x}[4] - {x}[2])"
    say = "r.w / len(list_filter(rows, lambda q: q.ord = r.ord)) * r.c"
    return f"""fb AS (
  SELECT image_id, arm, substr(arm, 2, 1)::INT AS ord, box_id, conf, [x0, y0, x1, y1]::DOUBLE[] AS b, weight
  FROM box JOIN wt USING (arm) WHERE conf >= {floor}::DOUBLE),
strips AS (
  SELECT DISTINCT image_id, unnest(range(floor(b[1] / 32)::BIGINT, floor(b[3] / 32)::BIGINT + 1)) AS strip FROM fb),
islands AS (
  SELECT image_id, strip, max(CASE WHEN gap THEN strip END) OVER (PARTITION BY image_id ORDER BY strip) AS crowd
  FROM (SELECT *, strip - coalesce(lag(strip) OVER (PARTITION BY image_id ORDER BY strip), -2) > 1 AS gap FROM strips)),
placed AS (
  SELECT fb.*, crowd, struct_pack(ord := ord, w := weight, c := conf, b := b) AS me,
         row_number() OVER (PARTITION BY fb.image_id, crowd ORDER BY conf DESC, ord, box_id) AS nth
  FROM fb JOIN islands i ON i.image_id = fb.image_id AND i.strip = floor(b[1] / 32)::BIGINT),
walk AS (
  SELECT image_id, crowd, nth, 1::BIGINT AS k, [struct_pack(box := b, rows := [me])] AS clusters FROM placed WHERE nth = 1
  UNION ALL
  SELECT image_id, crowd, nth, k,
         CASE WHEN k > len(clusters) THEN list_append(clusters, struct_pack(box := b, rows := rows))
              ELSE list_transform(clusters, lambda c, i: CASE WHEN i = k THEN struct_pack(
                box := list_transform([1, 2, 3, 4], lambda j: list_sum(list_transform(rows, lambda r: {say} * r.b[j]))
                                                   / list_sum(list_transform(rows, lambda r: {say}))),
                rows := rows) ELSE c END) END
  FROM (
    SELECT *, CASE WHEN k > len(clusters) THEN [me] ELSE list_append(clusters[k].rows, me) END AS rows FROM (
      SELECT *, CASE WHEN list_max(likes) >= {W.FUSE_IOU}::DOUBLE
                  THEN list_max(list_transform(likes, lambda x, i: CASE WHEN x = list_max(likes) THEN i END))
                  ELSE len(clusters) + 1 END AS k FROM (
        SELECT p.image_id, p.crowd, p.nth, b, me, clusters,
               list_transform(clusters, lambda c: {inter} / ({area('c.box')} + {area('b')} - {inter})) AS likes
        FROM walk w JOIN placed p ON p.image_id = w.image_id AND p.crowd = w.crowd AND p.nth = w.nth + 1)))),
opinion AS (
  SELECT image_id, crowd, k - 1 AS cluster, arm, any_value(weight) AS w, count(*) AS n, avg(conf) AS c,
         {", ".join(f"sum(conf * b[{j}]) / sum(conf) AS v{j}" for j in (1, 2, 3, 4))}
  FROM walk JOIN placed USING (image_id, crowd, nth) GROUP BY ALL),
fused AS (
  SELECT image_id, crowd, cluster, sum(w * c) / (SELECT sum(weight) FROM wt) AS conf,
         {", ".join(f"sum(w * c * v{j}) / sum(w * c) AS {x}" for j, x in zip((1, 2, 3, 4), X.XYXY))},
         count(*) AS n_members, sum(n)::BIGINT AS n_boxes
  FROM opinion GROUP BY ALL)"""


def recursive(*ctes: str) -> str:
    return with_(*ctes).replace("WITH", "WITH RECURSIVE", 1)


register(
    "B7_weighted_box_fusion",
    lambda s, d: rounded(W.fuse(fusion_boxes(s, d), weights(s, d)), ["conf", *X.XYXY]),
    recursive(*MEMBERS, fused_sql(0.0))
    + f"SELECT image_id, crowd, cluster, n_members, n_boxes, {', '.join(f'{rnd(c, 6)} AS {c}' for c in ('conf', *X.XYXY))} FROM fused",
)


def fused_photos(s, d) -> DataFrame:
    return W.fuse_detections(td.photo_roles(s, d), fusion_boxes(s, d), weights(s, d))


register(
    "B8_fused_rollup",
    lambda s, d: fused_photos(s, d).groupBy("image_id", "role").agg(
        F.count("conf").alias("n_fused"), F.coalesce(F.sum("n_boxes"), F.lit(0)).alias("n_boxes"),
        round_to(F.max("conf"), 6).alias("max_conf"),
    ),
    recursive(*MEMBERS, fused_sql(W.FUSE_FLOOR))
    + f"""SELECT image_id, role, count(conf) AS n_fused, coalesce(sum(n_boxes), 0)::BIGINT AS n_boxes, {rnd('max(conf)', 6)} AS max_conf
FROM photo LEFT JOIN fused USING (image_id) GROUP BY ALL""",
)


def ensemble_threshold(s, d) -> DataFrame:
    return evaluate_ensemble(td.photos(s, d), fusion_boxes(s, d), weights(s, d), td.truths(s, d))["headline"]


# fused boxes of the labelled photographs against their one truth, then the sweep of all photographs
ENSEMBLE = f"""ens AS (SELECT 'ensemble' AS arm, f.*, role FROM fused f JOIN photo USING (image_id)),
reach AS (
  SELECT b.image_id, crowd, cluster,
         row_number() OVER (PARTITION BY b.image_id ORDER BY conf DESC, crowd::VARCHAR || '-' || cluster::VARCHAR DESC) = 1 AS tp
  FROM ens b JOIN truth t USING (image_id) WHERE {iou_sql('b', 't')} >= 0.5::DOUBLE),
judged AS (
  SELECT e.conf, coalesce(tp, false) AS tp FROM ens e JOIN truth USING (image_id) LEFT JOIN reach USING (image_id, crowd, cluster)),
peak AS (
  SELECT confidence AS threshold, f1 AS box_f1 FROM (
    SELECT confidence, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1 FROM (
      SELECT confidence, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / n::DOUBLE END AS p,
             hits::DOUBLE / (SELECT count(*) FROM truth)::DOUBLE AS r
      FROM (SELECT confidence, count(*) FILTER (tp AND conf >= confidence) AS hits, count(*) FILTER (conf >= confidence) AS n
            FROM judged CROSS JOIN grid GROUP BY ALL)))
  ORDER BY f1 DESC, confidence LIMIT 1)"""
OF_ENSEMBLE = with_(
    "box AS (SELECT arm, image_id, role, conf FROM ens)",
    """img AS (
  SELECT 'ensemble' AS arm, p.image_id, role, max(conf) AS top FROM photo p
  LEFT JOIN (SELECT image_id, conf FROM ens) USING (image_id) GROUP BY ALL)""",
    counts_sql(), sweep_sql(), "ext AS (SELECT 'ensemble' AS arm, threshold FROM peak)", CARRIED,
)
register(
    "B9_ensemble_threshold",
    ensemble_threshold,
    recursive(*MEMBERS, TRUTH, fused_sql(W.FUSE_FLOOR), ENSEMBLE)
    + f"SELECT * FROM ({OF_ENSEMBLE} SELECT carried.*, {rnd('box_f1', 9)} AS box_f1 FROM carried CROSS JOIN peak)",
)
register(
    "B10_ensemble_cost",
    lambda s, d: W.ensemble_cost(
        arm_totals(s, d).select(
            (F.col("q") * 10).alias("n_params"), (F.col("n") / F.lit(1000.0)).alias("model_size_mb")
        )
    ).withColumn("model_size_mb", round_to("model_size_mb", 6)),
    f"""SELECT count(*) AS n_members, sum(q * 10)::BIGINT AS n_params, {rnd('sum(n::DOUBLE / 1000.0::DOUBLE)', 6)} AS model_size_mb
FROM (SELECT l_suppkey % 4 AS arm, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1)""",
)


def located(s, d) -> DataFrame:
    tops = td.detections(s, d).filter(F.col("role") == T.POS).groupBy("image_id").agg(
        F.max(F.struct("conf", "arm", "box_id", "x0", "x1", "y0", "y1")).alias("b")
    ).select(
        "image_id", ((F.col("b.y0") + F.col("b.y1")) / 2).alias("cy"),
        ((F.col("b.x0") + F.col("b.x1")) / 2).alias("cx"),
    )
    return X.localisation(td.saliency(s, d), td.truths(s, d), tops, 10, 64.0)


LOCATED = f"""cell AS (
  SELECT o_orderkey AS image_id, y, x, {unit('sal', 'o_orderkey, x, y')} AS v
  FROM orders CROSS JOIN range(0, 10) a(y) CROSS JOIN range(0, 10) b(x) WHERE o_orderstatus = 'F'),
mask AS (
  SELECT c.*, x >= x0 // 64 AND x < ceil(x1 / 64.0::DOUBLE) AND y >= y0 // 64
              AND y < ceil(y1 / 64.0::DOUBLE) AS inside
  FROM cell c JOIN truth t USING (image_id)),
top AS (
  SELECT image_id, arg_max((y0 + y1) / 2.0::DOUBLE, (conf, arm, box_id)) AS cy,
         arg_max((x0 + x1) / 2.0::DOUBLE, (conf, arm, box_id)) AS cx
  FROM box WHERE role = 'pos_test' GROUP BY 1),
loc AS (
  SELECT m.image_id, avg(inside::INT) AS area, sum(v) FILTER (inside) / sum(v) AS energy,
         arg_max(inside, (v, -y, -x)) AS peak_in,
         coalesce(bool_or(inside) FILTER (y = least(floor(cy / 64), 9) AND x = least(floor(cx / 64), 9)), false) AS top_in
  FROM mask m LEFT JOIN top USING (image_id) GROUP BY 1)"""
register(
    "B11_localisation",
    lambda s, d: located(s, d).select(
        "image_id", round_to("area", 9).alias("area"), round_to("energy", 9).alias("energy"), "peak_in", "top_in"
    ),
    with_(BOX, TRUTH, LOCATED)
    + f"SELECT image_id, {rnd('area', 9)} AS area, {rnd('energy', 9)} AS energy, peak_in, top_in FROM loc",
)
register(
    "B11_localisation_summary",
    lambda s, d: X.localisation_summary(located(s, d)),
    with_(BOX, TRUTH, LOCATED)
    + f"""SELECT count(*) AS n, count(*) FILTER (top_in) AS n_top_in_box, {rnd('avg(area)', 9)} AS box_area_mean,
  {rnd('avg(top_in::INT)', 9)} AS top_location_in_box, {rnd('avg(energy)', 9)} AS energy_mean,
  {rnd('quantile_cont(energy, 0.5)', 9)} AS energy_median, {rnd('avg(peak_in::INT)', 9)} AS pointing,
  {rnd('avg(energy) FILTER (top_in)', 9)} AS energy_mean_top_in_box,
  {rnd('avg(peak_in::INT) FILTER (top_in)', 9)} AS pointing_top_in_box FROM loc""",
)
