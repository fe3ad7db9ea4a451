"""Queries for paired tests, ROC areas, resampling, series summaries and the comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import mcnemar_exact, paired_difference, round_to, stars
from ..operators import counted as C, report as R, resample as B, stats as S, thresholds as T
from ..sources import testdata as td
from .thresholds import (
    BUDGET, CARRIED, EXTERNAL, FINE_GRID, LEVELS, POINTS, RAW_LEVELS, counts_sql, external_thresholds,
    fine_sweep, image_rows, images, sweep_sql,
)
from .views import CURVE, IMAGES, PHOTO, ROUNDS, mcnemar, rnd, with_

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


REPS = 2000  # bootstrap
HALVES = 1000
CONTRASTS = [("first", "m0", "m1"), ("first", "m2", "m0"), ("second", "m3", "m2")]
CATALOGUE = [(i, f"m{i}", f"Arm {i}", f"tag{i}" if i else "") for i in range(5)]
CURVE_OF = {"m0": "click", "m1": "error", "m2": "view"}


def pos_hits(s, d) -> DataFrame:
    return T.image_hits(images(s, d), 0.10).filter(F.col("role") == T.POS)


def category_pairs(s, d) -> DataFrame:
    return S.pair_counts(pos_hits(s, d), td.ARMS, ["category"])


HITS = """hits AS (
  SELECT arm, image_id, role, category, coalesce(max_conf >= threshold, false) AS hit
  FROM img JOIN matched USING (arm) WHERE budget = 0.1::DOUBLE)"""
PAIRS = """cpairs AS (
  SELECT a.category, a.arm AS arm_a, b.arm AS arm_b,
         count(*) FILTER (a.hit AND NOT b.hit) AS a_only,
         count(*) FILTER (b.hit AND NOT a.hit) AS b_only
  FROM hits a JOIN hits b ON a.image_id = b.image_id AND a.arm < b.arm
  WHERE a.role = 'pos_test' GROUP BY ALL),
pairs AS (
  SELECT arm_a, arm_b, sum(a_only)::BIGINT AS a_only, sum(b_only)::BIGINT AS b_only
  FROM cpairs GROUP BY ALL)"""
TO_HITS = (IMAGES, LEVELS, BUDGET, HITS, PAIRS)


def holm_sql(src: str, family: str, keys: str, p: str = "p") -> str:
    part = f"PARTITION BY {family} " if family else ""
    fam = f"PARTITION BY {family}" if family else ""
    return f"""(SELECT *, max(step) OVER ({part}ORDER BY {p}, {keys} ROWS UNBOUNDED PRECEDING) AS holm
  FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER ({fam}) - row_number() OVER ({part}ORDER BY {p}, {keys}) + 1) * {p})
        AS step FROM {src}))"""


MARK = ("CASE WHEN holm < 0.001::DOUBLE THEN '***' WHEN holm < 0.01::DOUBLE THEN '**'"
        " WHEN holm < 0.05::DOUBLE THEN '*' ELSE 'n.s.' END")

register(
    "A1_mcnemar_exact",
    lambda s, d: category_pairs(s, d).withColumn("p", round_to(mcnemar_exact("a_only", "b_only"), 9)),
    with_(*TO_HITS)
    + f"SELECT *, {rnd(mcnemar('a_only', 'b_only'), 9)} AS p FROM cpairs",
)
register(
    "A2_discordant_pairs",
    lambda s, d: S.pair_counts(pos_hits(s, d), td.ARMS),
    with_(*TO_HITS) + "SELECT * FROM pairs",
)


def holm_query(s, d):
    tests = category_pairs(s, d).withColumn("p", mcnemar_exact("a_only", "b_only"))
    out = S.holm(tests, ["category"], ["arm_a", "arm_b"])
    return out.select("category", "arm_a", "arm_b", round_to("p", 9).alias("p"),
                      round_to("holm", 9).alias("holm"))


register(
    "A3_holm",
    holm_query,
    with_(*TO_HITS, f"t AS (SELECT *, {mcnemar('a_only', 'b_only')} AS p FROM cpairs)")
    + f"SELECT category, arm_a, arm_b, {rnd('p', 9)} AS p, {rnd('holm', 9)} AS holm FROM "
    + holm_sql("t", "category", "arm_a, arm_b"),
)


def diff_query(s, d):
    n = T.image_hits(images(s, d), 0.10).filter(F.col("role") == T.POS).groupBy("category").agg(
        F.countDistinct("image_id").alias("n")
    )
    pairs = category_pairs(s, d).join(n, "category")
    eff, lo, hi = paired_difference("b_only", "a_only", "n")
    return pairs.select("category", "arm_a", "arm_b", "n", round_to(eff, 9).alias("effect"),
                        round_to(lo, 9).alias("low"), round_to(hi, 9).alias("high"))


def diff_sql(g: str, l: str, n: str) -> tuple[str, str, str]:
    g, l, n = f"({g})::DOUBLE", f"({l})::DOUBLE", f"({n})::DOUBLE"
    e = f"(({g} - {l}) / {n})"
    se = f"(sqrt(greatest({g} + {l} - ({g} - {l}) * ({g} - {l}) / {n}, 0.0::DOUBLE)) / {n})"
    return e, f"({e} - 1.96::DOUBLE * {se})", f"({e} + 1.96::DOUBLE * {se})"


_e, _l, _h = diff_sql("b_only", "a_only", "n")
register(
    "A4_paired_difference",
    diff_query,
    with_(*TO_HITS)
    + f"""SELECT category, arm_a, arm_b, n, {rnd(_e, 9)} AS effect, {rnd(_l, 9)} AS low, {rnd(_h, 9)} AS high
FROM cpairs JOIN (SELECT category, count(*) AS n FROM photo WHERE role = 'pos_test' GROUP BY 1)
USING (category)""",
)


def ablation_query(s, d):
    hits = pos_hits(s, d)
    contrasts = s.createDataFrame(CONTRASTS, "family string, ref string, variant string")
    n_pos = td.photo_roles(s, d).filter(F.col("role") == T.POS).agg(F.count(F.lit(1)).alias("n_pos"))
    out = S.ablation(S.pair_counts(hits, td.ARMS), contrasts, n_pos)
    return out.select(
        "family", "ref", "variant", "gain", "loss",
        *[round_to(c, 9).alias(c) for c in ("effect", "low", "high", "p", "holm")], "mark",
    )


_e, _l, _h = diff_sql("gain", "loss", "n_pos")
register(
    "A5_ablation_contrasts",
    ablation_query,
    with_(
        *TO_HITS,
        "con AS (SELECT * FROM (VALUES "
        + ", ".join(f"('{f}', '{r}', '{v}')" for f, r, v in CONTRASTS) + ") t(family, ref, variant))",
        """gl AS (
  SELECT family, ref, variant, CASE WHEN ref = arm_a THEN b_only ELSE a_only END AS gain,
         CASE WHEN ref = arm_a THEN a_only ELSE b_only END AS loss,
         (SELECT count(*) FROM photo WHERE role = 'pos_test') AS n_pos
  FROM con JOIN pairs ON (ref = arm_a AND variant = arm_b) OR (ref = arm_b AND variant = arm_a))""",
        f"""t AS (SELECT *, {_e} AS effect, {_l} AS low, {_h} AS high, {mcnemar('gain', 'loss')} AS p FROM gl)""",
    )
    + f"""SELECT family, ref, variant, gain, loss, {rnd('effect', 9)} AS effect, {rnd('low', 9)} AS low,
  {rnd('high', 9)} AS high, {rnd('p', 9)} AS p, {rnd('holm', 9)} AS holm, {MARK} AS mark
FROM {holm_sql('t', '', 'ref, variant')}""",
)
register(
    "A6_roc_curve",
    lambda s, d: S.roc_curve(S.arm_levels(images(s, d)), ["arm"]),
    with_(IMAGES, LEVELS)
    + """SELECT arm, 0 AS vertex, 0.0::DOUBLE AS fa, 0.0::DOUBLE AS det FROM tot UNION ALL
SELECT arm, (row_number() OVER (PARTITION BY arm ORDER BY score DESC))::INT, fa, det FROM roc""",
)

AREA = """steps AS (
  SELECT {keys}, fa, det, coalesce(lag(fa) OVER w, 0.0::DOUBLE) AS fa0,
         coalesce(lag(det) OVER w, 0.0::DOUBLE) AS det0
  FROM roc WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
area AS (
  SELECT {keys}, (coalesce(sum((fa - fa0) * (det + det0) / 2) FILTER (fa <= 0.15::DOUBLE), 0.0::DOUBLE)
      + coalesce((0.15::DOUBLE - max(fa) FILTER (fa <= 0.15::DOUBLE))
                 * max(det) FILTER (fa <= 0.15::DOUBLE), 0.0::DOUBLE)) / 0.15::DOUBLE AS area
  FROM steps GROUP BY {keys})"""
register(
    "A7_partial_area",
    lambda s, d: S.partial_area(S.arm_levels(images(s, d)), ["arm"]).select(
        "arm", round_to("area", 9).alias("area")
    ),
    with_(IMAGES, LEVELS, AREA.format(keys="arm")) + f"SELECT arm, {rnd('area', 9)} AS area FROM area",
)

register(
    "A6_roc_curve_raw",
    lambda s, d: S.roc_curve(S.arm_levels(images(s, d), raw=True, rows=image_rows(s, d)), ["arm"], ranged=True),
    with_(IMAGES, RAW_LEVELS)
    + """SELECT arm, 0 AS vertex, 0.0::DOUBLE AS fa, 0.0::DOUBLE AS det FROM tot UNION ALL
SELECT arm, (row_number() OVER (PARTITION BY arm ORDER BY score DESC))::INT, fa, det FROM roc""",
)
register(
    "A7_partial_area_raw",
    lambda s, d: S.partial_area(S.arm_levels(images(s, d), raw=True, rows=image_rows(s, d)), ["arm"], ranged=True).select(
        "arm", round_to("area", 9).alias("area")
    ),
    with_(IMAGES, RAW_LEVELS, AREA.format(keys="arm")) + f"SELECT arm, {rnd('area', 9)} AS area FROM area",
)

BOOT = f"""place AS (
  SELECT image_id, role, row_number() OVER (PARTITION BY role
           ORDER BY md5(concat_ws('|', 'boot', image_id)), image_id) - 1 AS pos,
         count(*) OVER (PARTITION BY role) AS n_role FROM photo),
drawn AS (
  SELECT rep, role, ('0x' || substr(md5(concat_ws('|', 'draw', rep, role, pos)), 1, 15))::BIGINT % n_role AS pos
  FROM place CROSS JOIN (SELECT i AS rep FROM range(0, {REPS}) t(i))),
sample AS (
  SELECT rep, i.arm, i.role, i.max_conf AS score
  FROM drawn JOIN place p USING (role, pos) JOIN img i USING (image_id)),
lv AS (
  SELECT arm, rep, score, count(*) FILTER (role = 'pos_test') AS pos,
         count(*) FILTER (role = 'neg_test') AS neg
  FROM sample WHERE score IS NOT NULL GROUP BY ALL),
tot AS (
  SELECT arm, rep, count(*) FILTER (role = 'pos_test') AS n_pos,
         count(*) FILTER (role = 'neg_test') AS n_neg FROM sample GROUP BY ALL),
roc AS (
  SELECT arm, rep, score, (sum(pos) OVER w)::DOUBLE / n_pos::DOUBLE AS det,
         (sum(neg) OVER w)::DOUBLE / n_neg::DOUBLE AS fa
  FROM lv JOIN tot USING (arm, rep)
  WINDOW w AS (PARTITION BY arm, rep ORDER BY score DESC RANGE UNBOUNDED PRECEDING))"""
register(
    "A8_area_bootstrap",
    lambda s, d: B.area_bootstrap(images(s, d), REPS).select(
        "arm", "reps", round_to("low", 9).alias("low"), round_to("high", 9).alias("high")
    ),
    with_(IMAGES, BOOT, AREA.format(keys="arm, rep"))
    + f"""SELECT arm, count(*) AS reps, {rnd('quantile_cont(area, 0.025)', 9)} AS low,
  {rnd('quantile_cont(area, 0.975)', 9)} AS high FROM area GROUP BY arm""",
)

# the same interval from counts at score levels: no photograph is drawn, so no other engine can follow
register(
    "A8_counted_bootstrap",
    lambda s, d: C.area_bootstrap(images(s, d), REPS).select(
        "arm", "reps", round_to("low", 9).alias("low"), round_to("high", 9).alias("high")
    ),
)


def halves_sql(reps: int) -> str:
    return f"""half AS (
  SELECT rep, image_id, rn <= n // 2 AS cal FROM (
    SELECT rep, image_id, row_number() OVER (PARTITION BY rep
             ORDER BY md5(concat_ws('|', 'half', rep, image_id)), image_id) AS rn,
           count(*) OVER (PARTITION BY rep) AS n
    FROM photo CROSS JOIN (SELECT i AS rep FROM range(0, {reps}) t(i)) WHERE role = 'neg_test')),
ranked AS (
  SELECT arm, rep, coalesce(max_conf, -1.0::DOUBLE) AS score,
         row_number() OVER (PARTITION BY arm, rep ORDER BY coalesce(max_conf, -1.0::DOUBLE) DESC) AS rk,
         count(*) OVER (PARTITION BY arm, rep) AS n_cal
  FROM half JOIN img USING (image_id) WHERE cal),
cuts AS (
  SELECT arm, rep, target,
         coalesce(max(score) FILTER (rk = floor(target * (n_cal + 1)::DOUBLE)), 'inf'::DOUBLE) AS cut
  FROM ranked CROSS JOIN (SELECT unnest([0.05, 0.1, 0.15]::DOUBLE[]) AS target)
  GROUP BY arm, rep, target)"""


def alerts_query(s, d):
    img = images(s, d)
    return B.conformal_alerts(img, B.calibration_halves(img, 1), 0.10)


register(
    "A9_conformal_alerts",
    alerts_query,
    with_(IMAGES, halves_sql(1))
    + """SELECT arm, image_id, role, coalesce(max_conf, -1.0::DOUBLE) > cut AS alert
FROM (SELECT img.* FROM img WHERE role = 'pos_test'
      UNION ALL SELECT img.* FROM img JOIN half USING (image_id) WHERE NOT cal) seen
JOIN cuts USING (arm) WHERE target = 0.1::DOUBLE""",
)


def conformal_query(s, d):
    out = B.conformal_summary(B.conformal_rates(images(s, d), HALVES))
    return out.select("arm", "target", *[round_to(c, 9).alias(c) for c in out.columns[2:]])


def conformal_beside_query(s, d):
    img = images(s, d)
    out = B.conformal_beside_matched(B.conformal_rates(img, HALVES), img)
    return out.select("arm", "target", *[round_to(c, 9).alias(c) for c in out.columns[2:]])


def conformal_counted(s, d, beside: bool):
    img = images(s, d)
    rates = C.conformal_rates(img, HALVES)
    out = B.conformal_beside_matched(rates, img) if beside else B.conformal_summary(rates)
    return out.select("arm", "target", *[round_to(c, 9).alias(c) for c in out.columns[2:]])


register("A10_counted_repeats", lambda s, d: conformal_counted(s, d, False))
register("A10_counted_beside_matched", lambda s, d: conformal_counted(s, d, True))

# alerts of every split counted once for each cut: held-out scores and positives by score level, not by photograph
JUDGED = """poslv AS (
  SELECT arm, coalesce(max_conf, -1.0::DOUBLE) AS score, count(*) AS n FROM img WHERE role = 'pos_test' GROUP BY ALL),
posdet AS (
  SELECT arm, rep, target, coalesce(sum(n) FILTER (score > cut), 0)::DOUBLE / sum(n)::DOUBLE AS det
  FROM cuts JOIN poslv USING (arm) GROUP BY ALL),
heldfa AS (
  SELECT c.arm, c.rep, c.target,
         count(*) FILTER (coalesce(max_conf, -1.0::DOUBLE) > cut)::DOUBLE / count(*)::DOUBLE AS fa
  FROM half h JOIN img i USING (image_id) JOIN cuts c ON c.rep = h.rep AND c.arm = i.arm
  WHERE NOT cal GROUP BY ALL),
judged AS (SELECT * FROM posdet JOIN heldfa USING (arm, rep, target))"""
_Q = ", ".join(
    f"{rnd(f'avg({c})', 9)} AS {c}, {rnd(f'quantile_cont({c}, 0.025)', 9)} AS {c}_low, "
    f"{rnd(f'quantile_cont({c}, 0.975)', 9)} AS {c}_high"
    for c in ("det", "fa")
)
register(
    "A10_conformal_repeats",
    conformal_query,
    with_(
        IMAGES, halves_sql(HALVES), JUDGED,
    )
    + f"SELECT arm, target, {_Q} FROM judged GROUP BY arm, target",
)
register(
    "A10_conformal_beside_matched",
    conformal_beside_query,
    with_(IMAGES, LEVELS, BUDGET, halves_sql(HALVES), JUDGED)
    + f"""SELECT arm, target, {rnd('det', 9)} AS conformal, {rnd('detection', 9)} AS matched,
  {rnd('detection - det', 9)} AS shortfall
FROM (SELECT arm, target, avg(det) AS det FROM judged GROUP BY arm, target)
JOIN matched USING (arm) WHERE budget = target""",
)
register(
    "A11_category_hits",
    lambda s, d: S.category_hits(T.image_hits(images(s, d), 0.10)),
    with_(*TO_HITS)
    + "SELECT arm, role, category, count(*) FILTER (hit) AS k, count(*) AS n FROM hits GROUP BY ALL",
)
register(
    "A11_category_rates",
    lambda s, d: S.category_rates(S.category_hits(T.image_hits(images(s, d), 0.10)), td.ARMS),
    with_(*TO_HITS)
    + "SELECT role, category, "
    + ", ".join(
        rnd(f"count(*) FILTER (hit AND arm = '{a}')::DOUBLE / count(*) FILTER (arm = '{a}')::DOUBLE", 9)
        + f" AS {a}"
        for a in td.ARMS
    )
    + " FROM hits GROUP BY role, category",
)


def matrix_query(s, d):
    img = images(s, d)
    tests = S.pair_counts(pos_hits(s, d), td.ARMS).withColumn("p", mcnemar_exact("a_only", "b_only"))
    rates = T.detection_at_budgets(img, [0.10]).select("arm", "detection")
    return S.difference_matrix(S.holm(tests, [], ["arm_a", "arm_b"]), rates)


register(
    "A12_difference_matrix",
    matrix_query,
    with_(
        *TO_HITS, f"t AS (SELECT *, {mcnemar('a_only', 'b_only')} AS p FROM pairs)",
        f"hp AS (SELECT * FROM {holm_sql('t', '', 'arm_a, arm_b')})",
        """rk AS (SELECT arm, detection, row_number() OVER (ORDER BY detection DESC, arm) AS rank
  FROM matched WHERE budget = 0.1::DOUBLE)""",
    )
    + f"""SELECT x.arm AS row_arm, y.arm AS col_arm, {rnd('(x.detection - y.detection) * 100', 6)} AS points,
  {rnd('holm', 9)} AS holm, holm < 0.05::DOUBLE AS significant, {MARK} AS mark
FROM rk x JOIN rk y ON x.rank > y.rank
JOIN hp ON arm_a = least(x.arm, y.arm) AND arm_b = greatest(x.arm, y.arm)""",
)
register(
    "A13_running_mean",
    lambda s, d: S.running_mean(td.curve(s, d)),
    with_(CURVE, "n AS (SELECT arm, epoch, metric, row_number() OVER (PARTITION BY arm ORDER BY epoch) AS k, count(*) OVER (PARTITION BY arm) AS m FROM curve)")
    + f"""SELECT a.arm, a.epoch, {rnd('sum(b.metric) / 7', 9)} AS smooth
FROM n a CROSS JOIN range(-3, 4) o(off)
JOIN n b ON b.arm = a.arm AND b.k = least(greatest(a.k + off, 1), a.m) GROUP BY a.arm, a.epoch""",
)
register(
    "A14_convergence",
    lambda s, d: S.convergence(td.curve(s, d)),
    with_(CURVE)
    + """SELECT arm, epochs_run, epoch AS best_epoch, idx AS best_index FROM (
  SELECT arm, epoch, max(epoch) OVER (PARTITION BY arm) AS epochs_run,
         (row_number() OVER (PARTITION BY arm ORDER BY epoch))::INT AS idx,
         row_number() OVER (PARTITION BY arm ORDER BY metric DESC, epoch) AS rn FROM curve) WHERE rn = 1""",
)
register(
    "A15_latency_summary",
    lambda s, d: S.latency_summary(td.rounds(s, d)),
    with_(ROUNDS)
    + f"""SELECT arm, n_rounds, {rnd('lo', 2)} AS latency_ms, {rnd('med', 2)} AS median_ms,
  {rnd('1000.0::DOUBLE / lo', 1)} AS fps, {rnd('(med - lo) / lo * 100', 1)} AS contention_pct,
  {rnd('(hi - lo) / lo * 100', 1)} AS spread_pct, (hi - lo) / lo * 100 > 10 AS unstable
FROM (SELECT arm, count(*) AS n_rounds, min(ms) AS lo, max(ms) AS hi, quantile_cont(ms, 0.5) AS med
  FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY round) AS rn FROM rnds)
  WHERE rn > 1 GROUP BY arm)""",
)
register(
    "A16_call_time_median",
    lambda s, d: S.call_time_median(
        td.table(s, d, "events").select(
            F.col("event_type").alias("arm"), F.col("event_id").alias("call_id"),
            F.col("ts").alias("seq"), F.col("value").alias("ms"),
        )
    ),
    f"""SELECT arm, n_calls, {rnd('med', 2)} AS median_ms, {rnd('1000.0::DOUBLE / med', 1)} AS fps
FROM (SELECT event_type AS arm, count(*) AS n_calls, quantile_cont(value, 0.5) AS med
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
  WHERE rn > 20 GROUP BY 1)""",
)


# ------------------------------------------------------------------ comparison table
def catalogue(s) -> DataFrame:
    return s.createDataFrame(CATALOGUE, "ord int, arm string, label string, tag string")


def arm_totals(s, d) -> DataFrame:
    return td.table(s, d, "lineitem").groupBy(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("arm")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))


def summaries(s, d) -> DataFrame:
    """Nested run summaries; m4 has no data, so none, and m2 did not record its training time."""
    n, q = F.col("n").cast("double"), F.col("q").cast("double")
    return arm_totals(s, d).select(
        "arm",
        F.struct(
            (n / (n + 1000.0)).alias("map50"),
            F.when(F.col("arm") != "m2", n * 1.5).alias("train_seconds"),
        ).alias("synthetic"),
        F.struct(
            (q * 10.0).alias("n_params"), (n / 1000.0).alias("model_size_mb"),
            (F.col("n") % 10 + 5).cast("double").alias("latency_ms"),
            (1000.0 / (F.col("n") % 10 + 5).cast("double")).alias("fps"),
        ).alias("capacity"),
    )


def timed(s, d) -> DataFrame:
    ms = (F.col("n") % 7 + 8).cast("double")
    return arm_totals(s, d).filter("arm in ('m0', 'm1')").select(
        "arm", ms.alias("latency_ms"), round_to(1000.0 / ms, 1).alias("fps")
    )


def epochs(s, d) -> DataFrame:
    names = F.create_map(*[F.lit(x) for a, c in CURVE_OF.items() for x in (c, a)])
    return S.convergence(td.curve(s, d)).select(
        F.element_at(names, F.col("arm")).alias("arm"), "epochs_run", "best_epoch"
    ).filter("arm is not null")


def collected(s, d) -> DataFrame:
    return R.collect_table(
        catalogue(s), summaries(s, d), T.detection_at_budgets(images(s, d)),
        T.headline(fine_sweep(s, d), external_thresholds(s, d), ["arm"]), epochs(s, d), timed(s, d),
    )


CAT_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({o}, '{a}', '{l}', '{t}')" for o, a, l, t in CATALOGUE
) + ") t(ord, arm, label, tag))"
COLLECT = f"""st AS (
  SELECT 'm' || (l_suppkey % 4)::VARCHAR AS arm, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q
  FROM lineitem GROUP BY 1),
hd AS (
  SELECT arm, coalesce(c.detection_rate, b.detection_rate) AS dr, coalesce(c.fa_rate, b.fa_rate) AS fr,
         coalesce(c.f1, b.f1) AS f1 FROM best b LEFT JOIN carried c USING (arm)),
cv AS (
  SELECT CASE event_type WHEN 'click' THEN 'm0' WHEN 'error' THEN 'm1' WHEN 'view' THEN 'm2' END AS arm,
         max(epoch) AS epochs_run, arg_max(epoch, (metric, -epoch)) AS best_epoch
  FROM (SELECT arm AS event_type, epoch, metric FROM curve) GROUP BY 1),
tbl AS (
  SELECT cat.ord, cat.arm, cat.label,
    max(detection * 100) FILTER (budget = 0.05::DOUBLE) AS det_fa05,
    max(detection * 100) FILTER (budget = 0.1::DOUBLE) AS det_fa10,
    max(detection * 100) FILTER (budget = 0.15::DOUBLE) AS det_fa15,
    max(dr * 100) AS detect_rate, max(fr * 100) AS fa_rate, max(f1) AS f1,
    max(n::DOUBLE / (n::DOUBLE + 1000.0::DOUBLE)) AS map50,
    max(CASE WHEN cat.arm IN ('m0', 'm1') THEN (n % 7 + 8)::DOUBLE ELSE (n % 10 + 5)::DOUBLE END) AS latency_ms,
    max(CASE WHEN cat.arm IN ('m0', 'm1') THEN {rnd('1000.0::DOUBLE / (n % 7 + 8)::DOUBLE', 1)}
        ELSE 1000.0::DOUBLE / (n % 10 + 5)::DOUBLE END) AS fps,
    max(q::DOUBLE * 10.0::DOUBLE / 1e6::DOUBLE) AS params_m, max(n::DOUBLE / 1000.0::DOUBLE) AS size_mb,
    max(epochs_run) AS epochs_run, max(best_epoch) AS best_epoch,
    max(CASE WHEN cat.arm <> 'm2' THEN n::DOUBLE * 1.5::DOUBLE / 60.0::DOUBLE END) AS train_min,
    coalesce(list_sort(list(CASE budget WHEN 0.05::DOUBLE THEN 'det_fa05' WHEN 0.1::DOUBLE THEN 'det_fa10'
        ELSE 'det_fa15' END) FILTER (censored)), []::VARCHAR[]) AS censored
  FROM cat JOIN st USING (arm) LEFT JOIN matched USING (arm) LEFT JOIN hd USING (arm)
  LEFT JOIN cv USING (arm) GROUP BY cat.ord, cat.arm, cat.label)"""
TO_TABLE = (IMAGES, LEVELS, BUDGET, FINE_GRID, counts_sql(), sweep_sql(), POINTS, EXTERNAL, CARRIED,
            CURVE, CAT_SQL, COLLECT)
_DOUBLES = ["det_fa05", "det_fa10", "det_fa15", "detect_rate", "fa_rate", "f1", "map50", "latency_ms",
            "fps", "params_m", "size_mb", "train_min"]


def collect_query(s, d):
    t = collected(s, d)
    return t.select(
        "ord", "arm", "label", *[round_to(c, 9).alias(c) for c in _DOUBLES], "epochs_run", "best_epoch",
        F.concat_ws(",", "censored").alias("censored"),
    )


register(
    "A17_collect_table",
    collect_query,
    with_(*TO_TABLE)
    + "SELECT ord, arm, label, " + ", ".join(f"{rnd(c, 9)} AS {c}" for c in _DOUBLES)
    + ", epochs_run, best_epoch, array_to_string(censored, ',') AS censored FROM tbl",
)
register(
    "A17_missing_arms",
    lambda s, d: R.missing_arms(catalogue(s), summaries(s, d)),
    with_(CAT_SQL)
    + """SELECT ord, arm, label FROM cat WHERE arm NOT IN (
  SELECT 'm' || (l_suppkey % 4)::VARCHAR FROM lineitem)""",
)
register(
    "A18_display_cells",
    lambda s, d: R.display_cells(collected(s, d)),
    with_(*TO_TABLE)
    + " UNION ALL ".join(
        f"""SELECT arm, '{m}' AS metric, CASE WHEN {m} IS NULL THEN '-' ELSE
  (CASE WHEN list_contains(censored, '{m}') THEN '>=' ELSE '' END) || printf('%.{k}f', {rnd(m, k)}) END AS text FROM tbl"""
        for m, k in R.SHOWN.items()
    ),
)
register(
    "A19_column_leaders",
    lambda s, d: R.column_leaders(collected(s, d)),
    with_(*TO_TABLE)
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, arm, {rnd(m, 6)} AS value FROM tbl
WHERE {m} = (SELECT {'max' if up else 'min'}({m}) FROM tbl)"""
        for m, up in R.RANKED.items()
    ),
)


def examples_query(s, d):
    img = images(s, d)
    points = T.detection_at_budgets(img, [0.10]).select("arm", "threshold")
    return S.typical_examples(img, points)


register(
    "A20_typical_examples",
    examples_query,
    with_(
        IMAGES, LEVELS, BUDGET,
        """sc AS (SELECT arm, image_id, role, category, coalesce(max_conf, 0.0::DOUBLE) AS c, threshold
  FROM img JOIN matched USING (arm) WHERE budget = 0.1::DOUBLE)""",
        """med AS (SELECT arm, category, quantile_cont(c, 0.5) AS med FROM sc
  WHERE role = 'pos_test' AND c >= threshold GROUP BY ALL)""",
        f"""h AS (SELECT 'hit' AS kind, arm, category, (row_number() OVER (PARTITION BY arm, category
    ORDER BY {rnd('abs(c - med)', 9)}, image_id))::INT AS rank, image_id, c
  FROM sc JOIN med USING (arm, category) WHERE role = 'pos_test' AND c >= threshold)""",
        """m AS (SELECT 'miss' AS kind, arm, category, (row_number() OVER (PARTITION BY arm, category
    ORDER BY c, image_id))::INT AS rank, image_id, c FROM sc WHERE role = 'pos_test' AND c < threshold)""",
        """f AS (SELECT 'alarm' AS kind, arm, category, (row_number() OVER (PARTITION BY arm
    ORDER BY c DESC, image_id))::INT AS rank, image_id, c FROM sc WHERE role = 'neg_test')""",
    )
    + """SELECT * FROM h WHERE rank <= 2 UNION ALL SELECT * FROM m WHERE rank <= 1
UNION ALL SELECT * FROM f WHERE rank <= 6""",
)
register(
    "A21_evenly_spaced_rows",
    lambda s, d: S.evenly_spaced(
        images(s, d).filter("max_conf is not null").select("arm", "image_id", "max_conf"),
        ["arm"], "max_conf", "image_id",
    ).select("arm", "point", "pos", "image_id", "max_conf"),
    with_(IMAGES)
    + """SELECT arm, point, pos, image_id, max_conf FROM (
  SELECT arm, image_id, max_conf, row_number() OVER (PARTITION BY arm ORDER BY max_conf, image_id) - 1 AS pos,
         count(*) OVER (PARTITION BY arm) AS n FROM img WHERE max_conf IS NOT NULL)
JOIN (SELECT i::INT AS point, (2 * i + 1)::DOUBLE / 12.0::DOUBLE AS q FROM range(0, 6) t(i))
  ON pos = floor(q * (n - 1)::DOUBLE)::BIGINT""",
)


def listing(s, d) -> DataFrame:
    """Stored artefact paths: every arm with data has weights; arms with an even count a summary."""
    t = arm_totals(s, d).join(catalogue(s), "arm")
    run = F.concat(F.lit("pool54"), F.when(F.col("tag") != "", F.concat(F.lit("_"), "tag")).otherwise(""))
    return t.select(
        F.concat(F.lit("runs/detect/"), run, F.lit("/weights/best.pt")).alias("path")
    ).unionByName(
        t.filter("n % 2 = 0").select(
            F.concat(F.lit("evaluation/"), run, F.lit("/summary.json")).alias("path")
        )
    )


register(
    "A22_arm_coverage",
    lambda s, d: R.arm_coverage(catalogue(s), listing(s, d), 54),
    with_(CAT_SQL)
    + """SELECT cat.arm, label, 'pool54' || CASE WHEN tag <> '' THEN '_' || tag ELSE '' END AS run,
  (n IS NOT NULL) AS trained, coalesce(n % 2 = 0, false) AS evaluated,
  NOT (n IS NOT NULL) AS pending
FROM cat LEFT JOIN (SELECT 'm' || (l_suppkey % 4)::VARCHAR AS arm, count(*) AS n FROM lineitem GROUP BY 1) USING (arm)""",
)


def best_query(s, d):
    groups = catalogue(s).select("arm", F.when(F.col("ord") < 2, "base").otherwise("added").alias("grp"))
    return R.best_per_budget(T.detection_at_budgets(images(s, d)), groups)


register(
    "A23_best_per_budget",
    best_query,
    with_(IMAGES, LEVELS, BUDGET, CAT_SQL)
    + f"""SELECT CASE WHEN ord < 2 THEN 'base' ELSE 'added' END AS grp, arm, budget,
  {rnd('detection', 9)} AS detection,
  abs(detection - max(detection) OVER (PARTITION BY budget)) < 1e-12::DOUBLE AS is_best
FROM matched JOIN cat USING (arm)""",
)
