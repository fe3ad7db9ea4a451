"""Published figures and hand-worked cases."""

import inspect
import math

import pytest
from pyspark.sql import functions as F

from splitsight.catalog import stats as catalog
from splitsight.functions.expressions import (
    fixed, ln_gamma, mcnemar_exact, name_category, round_to, run_name, wilson,
)
from splitsight.operators import counted as C, resample as B, stats as S, thresholds as T


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


# Published hits of 387 and their 95 % intervals.
WILSON = [
    (319, 0.7832368832007989, 0.8589670173051861),
    (328, 0.8083283000044184, 0.8799300634860596),
    (273, 0.658168369916695, 0.7486460531129927),
    (335, 0.8280369563616671, 0.8960415450056388),
]
# Published discordant counts and p-values.
PAIRED = [
    (15, 24, 0.19959086691960692), (79, 17, 9.941513465364027e-11), (58, 27, 0.001016220951347889),
    (37, 61, 0.019690184799846844), (58, 50, 0.5007663934164361), (42, 48, 0.5984117182335187),
]
# Published contrasts as gain, loss, effect, low, high, p, adjusted p.
CONTRASTS = [
    (14, 60, -0.11886304909560723, -0.16078994972846034, -0.07693614846275411, 6.22176141634788e-08, 5.599585274713092e-07),
    (19, 82, -0.16279069767441862, -0.21103594210674698, -0.11454545324209026, 1.6587715917767932e-10, 1.6587715917767932e-09),
    (22, 53, -0.08010335917312661, -0.12323186472752912, -0.0369748536187241, 0.0004496479716438124, 0.003147535801506687),
    (36, 60, -0.06201550387596899, -0.11125206678103719, -0.012778940970900793, 0.018433352931462543, 0.09216676465731272),
    (45, 44, 0.002583979328165375, -0.04519466303267916, 0.050362621689009915, 1.0, 1.0),
    (50, 58, -0.020671834625323, -0.07326438398066065, 0.03192071473001466, 0.5007663934164361, 1.0),
    (72, 43, 0.07493540051679587, 0.021139227336829464, 0.12873157369676227, 0.008735108684333213, 0.05241065210599928),
    (64, 53, 0.028423772609819122, -0.026285000245282897, 0.08313254546492115, 0.35527968165224755, 1.0),
    (77, 37, 0.10335917312661498, 0.05027365779909494, 0.156444688454135, 0.0002268110323326416, 0.0018144882586611328),
    (22, 15, 0.01808785529715762, -0.012666144728116939, 0.04884185532243218, 0.3240086000878364, 1.0),
]


@pytest.mark.parametrize("k,lo,hi", WILSON)
def test_published_wilson(spark, k, lo, hi):
    a, b = wilson(F.lit(k), F.lit(387))
    r = one(spark, lo=a, hi=b)
    assert math.isclose(r.lo, lo, rel_tol=1e-12) and math.isclose(r.hi, hi, rel_tol=1e-12)


@pytest.mark.parametrize("a_only,b_only,p", PAIRED)
def test_published_mcnemar(spark, a_only, b_only, p):
    assert math.isclose(one(spark, p=mcnemar_exact(F.lit(a_only), F.lit(b_only))).p, p, rel_tol=1e-9)


def test_published_contrasts(spark):
    """The whole contrast table, through the operator that builds it."""
    name = lambda i: f"v{i:02d}"
    pairs = spark.createDataFrame(
        [("ref" + name(i), "var" + name(i), c[1], c[0]) for i, c in enumerate(CONTRASTS)],
        "arm_a string, arm_b string, a_only bigint, b_only bigint",
    )
    contrasts = spark.createDataFrame(
        [("f", "ref" + name(i), "var" + name(i)) for i in range(len(CONTRASTS))], "family string, ref string, variant string"
    )
    n = spark.createDataFrame([(387,)], "n_pos bigint")
    got = sorted(S.ablation(pairs, contrasts, n).collect(), key=lambda r: r.ref)
    for r, want in zip(got, CONTRASTS):
        assert (r.gain, r.loss) == want[:2]
        assert (r.effect, r.low, r.high, r.p, r.holm) == pytest.approx(want[2:], rel=1e-9)


def test_wilson_edges(spark):
    a, b = wilson(F.lit(0), F.lit(0))
    c, d = wilson(F.lit(5), F.lit(5))
    r = one(spark, a=a, b=b, c=c, d=d)
    assert (r.a, r.b, r.d) == (0.0, 0.0, 1.0) and 0.5 < r.c < 1


@pytest.mark.parametrize("b,c", [(0, 0), (1, 0), (3, 9), (41, 22), (10, 10), (250, 240), (7, 400)])
def test_mcnemar(spark, b, c):
    n = b + c
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert math.isclose(one(spark, p=mcnemar_exact(F.lit(b), F.lit(c))).p, want, rel_tol=1e-9)


def test_mcnemar_large_counts(spark):
    """z = 2 for n of four billion: close to the normal tail, and quick."""
    n = 4_000_000_000
    b = n // 2 - int(math.sqrt(n))
    p = one(spark, p=mcnemar_exact(F.lit(b), F.lit(n - b))).p
    assert abs(p - math.erfc(2 / math.sqrt(2))) < 1e-4


def test_ln_gamma(spark):
    for x in (0.5, 1, 2, 7.25, 100, 12345.5):
        assert math.isclose(one(spark, g=ln_gamma(F.lit(float(x)))).g, math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12)


def test_holm(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.9]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "k int, p double")
    got = {r.k: r.holm for r in S.holm(df, [], ["k"]).collect()}
    # By hand: 5 * 0.005, 4 * 0.01, 3 * 0.03, then 2 * 0.04 is less than what came before, 1 * 0.9.
    assert got == pytest.approx({3: 0.025, 0: 0.04, 2: 0.09, 1: 0.09, 4: 0.9})


def test_mcnemar_keeps_its_digits(spark):
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    n, k = 100_000, 49_500
    term = Decimal(math.comb(n, k)) / Decimal(2) ** n
    tail, j = Decimal(0), k
    while term > Decimal(10) ** -40:
        tail, term, j = tail + term, term * j / (n - j + 1), j - 1
    p = one(spark, p=mcnemar_exact(F.lit(k), F.lit(n - k))).p
    assert math.isclose(p, float(2 * tail), rel_tol=1e-12)


def test_many_arms(spark):
    arms = [f"m{i:03d}" for i in range(80)]
    hits = spark.createDataFrame([(i, a, (i + j) % 3 == 0) for i in range(6) for j, a in enumerate(arms)], "image_id int, arm string, hit boolean")
    got = {(r.arm_a, r.arm_b): (r.a_only, r.b_only) for r in S.pair_counts(hits, arms).collect()}
    assert len(got) == 80 * 79 // 2 and got["m000", "m079"] == (2, 2) and got["m000", "m078"] == (0, 0)


def test_curve_with_a_hole_has_no_peak(spark):
    rows = [("x", "A", 0.1, 0.5), ("x", "A", 0.2, 0.9), ("x", "B", 0.1, 0.4), ("y", "A", 0.1, 0.5), ("y", "B", 0.1, 0.7)]
    curve = spark.createDataFrame(rows, "arm string, cls string, confidence double, f1 double")
    got = {r.arm: (r.confidence, r.f1) for r in T.best_curve_point(curve, ["arm"]).collect()}
    assert got["x"] == (None, None) and got["y"] == pytest.approx((0.1, 0.6))


def images(spark, neg, pos):
    rows = [("m", i, T.NEG, "x", c) for i, c in enumerate(neg)]
    rows += [("m", 1000 + i, T.POS, "x", c) for i, c in enumerate(pos)]
    return spark.createDataFrame(rows, "arm string, image_id bigint, role string, category string, max_conf double")


def test_matched_budgets_hand_case(spark):
    img = images(spark, [0.9, 0.5, 0.3] + [None] * 7, [0.95, 0.8, 0.6, 0.4, 0.2, None])
    got = {r.budget: (r.detection, r.censored) for r in T.detection_at_budgets(img, [0.0, 0.1, 0.2, 0.3]).collect()}
    assert {b: v[0] for b, v in got.items()} == {0.0: 1 / 6, 0.1: 3 / 6, 0.2: 4 / 6, 0.3: 5 / 6}
    assert [b for b, v in got.items() if v[1]] == [0.3]
    point = T.image_hits(img, 0.1).filter("hit and role = 'pos_test'").count()
    assert point == 3


def test_budget_that_nothing_meets(spark):
    img = images(spark, [0.9, 0.9], [0.5])
    r = T.detection_at_budgets(img, [0.05]).first()
    assert (r.detection, r.threshold, r.censored) == (0.0, float("inf"), False)


def test_arm_that_never_fires(spark):
    r = T.detection_at_budgets(images(spark, [None, None], [None]), [0.05]).first()
    assert (r.detection, r.threshold, r.censored) == (0.0, float("inf"), False)


def test_conformal_rule(spark):
    """11 calibration scores at 25 %: floor(0.25 * 12) - 1 = 2 may lie above, the third is the cut."""
    neg = [i / 100 for i in range(22)]
    img = images(spark, neg, [0.5])
    halves = B.calibration_halves(img, 3).select("rep", "image_id", "scores", "slot")
    rows = halves.collect()
    cuts = {r.rep: r.cut for r in B.conformal_cuts(halves, [0.25]).collect()}
    for rep in range(3):
        cal = sorted((r.scores[0].score for r in rows if r.rep == rep and r.slot == 0), reverse=True)
        assert len(cal) == 11 and cuts[rep] == cal[2]
    assert all(r.cut == float("inf") for r in B.conformal_cuts(halves, [0.05]).collect())


def test_bootstrap_keeps_role_sizes(spark):
    img = images(spark, [0.1, 0.2, None, 0.4], [0.5, None, 0.7])
    tot = B.bootstrap_levels(img, 5).groupBy("arm", "rep").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n")
    ).collect()
    assert len(tot) == 5 and all((r.p, r.n) == (3, 4) for r in tot)


def test_registered_repetitions_are_the_operators():
    for m in (B, C):
        reps = {f.__name__: inspect.signature(f).parameters["reps"].default for f in (m.area_bootstrap, m.conformal_rates)}
        assert reps == {"area_bootstrap": catalog.REPS, "conformal_rates": catalog.HALVES} == {"area_bootstrap": 2000, "conformal_rates": 1000}


def test_published_latency(spark):
    # Eight kept rounds of one arm and the summary published for them.
    ms = [14.08, 10.83, 10.08, 10.96, 13.26, 11.23, 12.0, 13.31]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([99.0] + ms)], "arm string, round int, ms double")
    r = S.latency_summary(rows).first()
    assert (r.n_rounds, r.latency_ms, r.fps, r.median_ms) == (8, 10.08, 99.2, 11.62)
    assert (r.contention_pct, r.spread_pct, r.unstable) == (15.2, 39.7, True)


def test_convergence_takes_first_peak(spark):
    rows = spark.createDataFrame([("a", e, m) for e, m in ((1, 0.1), (2, 0.4), (3, 0.4), (4, 0.2))], "arm string, epoch int, metric double")
    r = S.convergence(rows).first()
    assert (r.epochs_run, r.best_epoch, r.best_index) == (4, 2, 2)


def test_names(spark):
    run = lambda p, t, s: one(spark, r=run_name(F.lit(p), F.lit(t), F.lit(s))).r
    assert run(60, "", 0) == "pool60" and run(60, "tag_x", 3) == "pool60_tag_x_s3" and run(60, "", 3) == "pool60_s3"
    cat = lambda n: one(spark, r=name_category(F.lit(n))).r
    assert cat("old phones 23.jpg") == "old phones"
    assert cat("Mixed items_315.jpg") == "Mixed items"
    assert cat("images (3).jpg") == "images (3)" and cat("a_b 7_9.jpg") == "a b 7"


def test_fixed_text_ties_to_even(spark):
    r = one(spark, a=fixed(F.lit(0.125), 2), b=fixed(F.lit(0.375), 2), c=round_to(F.lit(2.5), 0), d=fixed(F.lit(1e7), 1))
    assert (r.a, r.b, r.c, r.d) == ("0.12", "0.38", 2.0, "10000000.0")


def test_typical_examples_cut_their_lists_in_every_task(spark, monkeypatch):
    """The first rows of each list as by a plain walk; only those are shuffled, and medians may be too many to broadcast."""
    rows = [
        (arm, i, ["pos_test", "neg_test"][i % 2], [None, "A", "B"][i % 3], None if i % 7 == 0 else (i * 37 % 101) / 100)
        for arm in ("m0", "m1") for i in range(300)
    ]
    images = spark.createDataFrame(rows, "arm string, image_id bigint, role string, category string, max_conf double")
    points = spark.createDataFrame([("m0", 0.5), ("m1", 0.9)], "arm string, threshold double")
    want = set()
    for arm, limit in (("m0", 0.5), ("m1", 0.9)):
        mine = [(i, role, cat, c or 0.0) for a, i, role, cat, c in rows if a == arm]
        alarms = sorted((-c, i, cat) for i, role, cat, c in mine if role == "neg_test")[:4]
        want |= {("alarm", arm, cat, k + 1, i, -c) for k, (c, i, cat) in enumerate(alarms)}
        for cat in (None, "A", "B"):
            pos = [(i, c) for i, role, ct, c in mine if role == "pos_test" and ct == cat]
            fired = sorted(c for _, c in pos if c >= limit)
            mid = (fired[(len(fired) - 1) // 2] + fired[len(fired) // 2]) / 2
            by = (lambda i, c: (0.0, i)) if cat is None else (lambda i, c: (round(abs(c - mid), 9), i))
            hits = sorted((*by(i, c), c) for i, c in pos if c >= limit)[:2]
            want |= {("hit", arm, cat, k + 1, i, c) for k, (_, i, c) in enumerate(hits)}
            _, c, i = min((0, c, i) for i, c in pos if c < limit)
            want.add(("miss", arm, cat, 1, i, c))
    got = S.typical_examples(images, points, 4)
    assert {tuple(r) for r in got.collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "FEW_ROWS", 0)
    assert {tuple(r) for r in S.typical_examples(images, points, 4).collect()} == want


def test_raw_levels_come_in_parts_of_bounded_size(spark, monkeypatch):
    """However few partitions the session has; a score that most share, or none, is one level and fills no part."""
    from splitsight import session

    n = 12000
    top = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, 0.5).otherwise(F.col("id") / (2 * n))
    images = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, "a").otherwise("b").alias("arm"), F.col("id").alias("image_id"),
        F.when(F.hash("id") % 2 == 0, T.POS).otherwise(T.NEG).alias("role"), top.cast("double").alias("top"),
    )
    curve = lambda raw: {tuple(r) for r in T.cumulative_curve(T.score_levels(images, raw=True), ranged=raw).drop("vertex").select(
        "arm", "score", "pos", "neg", "hits", "alarms", "n_pos", "n_neg", "det", "fa").collect()}
    budgets = lambda: sorted(T.detection_at_budgets(images, raw=True).collect())
    plain, points = curve(False), budgets()
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    levels = T.score_levels(images, raw=True)
    assert most(levels) <= 300 and most(T.score_levels(images, raw=True, rows=n)) <= 300
    assert most(T.cumulative_curve(levels, ranged=True)) <= 600
    assert curve(True) == plain == curve(False) and len(plain) == levels.count()
    assert budgets() == points
