"""Resampling by counts: exact laws by enumeration, agreement with replayed draws, odd tables."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitsight.catalog.thresholds import images
from splitsight.operators import counted as C, resample as B

SF = "/root/testdata/sf0.001"
POS, NEG = np.array([1, 2, 1]), np.array([2, 1, 2])  # two score levels and the photographs that never fired
SCHEMA = "arm string, image_id long, role string, category string, max_conf double"


def area_plainly(pos, neg, limit):
    hits = alarms = body = 0.0
    fa0 = det0 = 0.0
    last = None
    for p, n in zip(pos[:-1], neg[:-1], strict=True):
        hits, alarms = hits + p, alarms + n
        fa, det = alarms / sum(neg), hits / sum(pos)
        if fa <= limit:
            body += (fa - fa0) * (det + det0) / 2
            last = fa, det
        fa0, det0 = fa, det
    return (body + ((limit - last[0]) * last[1] if last else 0.0)) / limit


def with_replacement(counts):
    n = int(sum(counts))
    for k in itertools.product(range(n + 1), repeat=len(counts)):
        if sum(k) == n:
            yield k, math.factorial(n) / math.prod(map(math.factorial, k)) * math.prod((c / n) ** x for c, x in zip(counts, k, strict=True))


def follows(got, law, n):
    """Every outcome is possible and no frequency is further off than five standard deviations."""
    assert set(got) <= set(law)
    assert all(abs(got[k] / n - v) <= 5 * math.sqrt(max(0.0, v * (1 - v)) / n) + 1e-9 for k, v in law.items())


@pytest.mark.parametrize("head", [None, 0, 1])
def test_law_of_resampled_areas(monkeypatch, head):
    if head is not None:
        monkeypatch.setattr(C, "_head", lambda neg, alarms: head)
    law = defaultdict(float)
    for (p, a), (n, b) in itertools.product(with_replacement(POS), with_replacement(NEG)):
        law[round(area_plainly(p, n, 0.5), 9)] += a * b
    reps = 100_000
    got = Counter(np.round(C.resampled_areas(POS, NEG, reps, np.random.default_rng(1), 0.5), 9).tolist())
    follows(got, law, reps)


def halves_plainly(pos, cal, held, target):
    """The rule on photographs: levels stand for scores, 0 the highest."""
    m = math.floor(target * (len(cal) + 1)) - 1
    if m < 0:
        return 0.0, 0.0
    cut = sorted(cal)[m]
    return sum(p for level, p in enumerate(pos) if level < cut) / sum(pos), sum(h < cut for h in held) / len(held)


@pytest.mark.parametrize("head", [None, 0, 1, 2])
def test_law_of_halves(monkeypatch, head):
    if head is not None:
        monkeypatch.setattr(C, "_head", lambda neg, alarms: head)
    neg, targets = np.array([2, 1, 3, 1]), [0.1, 0.3, 0.6]
    pos = np.array([2, 1, 1, 3])
    photos = [level for level, c in enumerate(neg) for _ in range(c)]
    laws = [defaultdict(float) for _ in targets]
    subsets = list(itertools.combinations(range(7), 3))
    for chosen in subsets:
        cal = [photos[i] for i in chosen]
        held = [photos[i] for i in range(7) if i not in chosen]
        for law, t in zip(laws, targets, strict=True):
            law[tuple(round(x, 9) for x in halves_plainly(pos, cal, held, t))] += 1 / len(subsets)
    reps = 60_000
    det, fa = C.halved_rates(pos, neg, reps, np.random.default_rng(2), targets)
    for k, law in enumerate(laws):
        follows(Counter(zip(np.round(det[:, k], 9).tolist(), np.round(fa[:, k], 9).tolist(), strict=True)), law, reps)


def test_roles_keep_their_sizes():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300)
    for draw, n in ((C._multinomial, counts.sum()), (C._halves, counts.sum() // 2)):
        head, rest = C._drawn(draw, rng, n, 40, counts, 20)
        whole = np.concatenate((head, rest(np.arange(40))), axis=1)
        assert (whole.sum(axis=1) == n).all() and whole.shape == (40, 300)
    assert (C._halves(rng, np.array([counts.sum()]), counts) == counts).all()


def test_levels_and_replay(spark):
    """Levels add up to the photographs; the same seed gives the same interval however the table is cut."""
    img = images(spark, SF).cache()
    levels = C.level_arrays(img).collect()
    assert all(list(r.scores[:-1]) == sorted(r.scores[:-1], reverse=True) and r.scores[-1] is None for r in levels)
    n = {(r.arm, r.role): r["count"] for r in img.groupBy("arm", "role").count().collect()}
    assert all(sum(r.pos) == n[r.arm, "pos_test"] and sum(r.neg) == n[r.arm, "neg_test"] for r in levels)
    one, other = (C.area_bootstrap(img.repartition(k), 120).orderBy("arm").collect() for k in (1, 7))
    assert one == other and all(r.reps == 120 for r in one)
    one, other = (C.conformal_rates(img.repartition(k), 70).orderBy("arm", "rep", "target").collect() for k in (1, 7))
    assert one == other and len(one) == 4 * 70 * 3


def test_counts_agree_with_drawn_photographs(spark):
    img = images(spark, SF).cache()
    reps = 300
    by_count, by_photo = ({r.arm: r for r in m.area_bootstrap(img, reps).collect()} for m in (C, B))
    assert set(by_count) == set(by_photo)
    for arm, r in by_count.items():
        wide = r.high - r.low
        assert abs(r.low - by_photo[arm].low) < 0.3 * wide and abs(r.high - by_photo[arm].high) < 0.3 * wide
    one, other = ({(r.arm, r.target): r for r in B.conformal_summary(m.conformal_rates(img, reps)).collect()} for m in (C, B))
    for key, r in one.items():
        assert abs(r.det - other[key].det) < 0.02 and abs(r.fa - other[key].fa) < 0.02


def test_odd_tables(spark):
    rows = [("quiet", i, "neg_test" if i % 2 else "pos_test", "c", None) for i in range(9)]
    rows += [("noneg", i, "pos_test", "c", 0.5) for i in range(3)] + [("nopos", i, "neg_test", "c", 0.5) for i in range(3)]
    rows += [("one", 1, "neg_test", None, 0.25), ("same", 1, "pos_test", "c", 0.5)] + [("same", i, "neg_test", "c", 0.5) for i in range(20)]
    img = spark.createDataFrame(rows, SCHEMA)
    areas = {r.arm: (r.low, r.high) for r in C.area_bootstrap(img, 20).collect()}
    assert areas["quiet"] == areas["nopos"] == areas["one"] == areas["same"] == (0.0, 0.0)
    assert areas["noneg"] == (1.0, 1.0)
    rates = C.conformal_rates(img, 20, [0.1, 0.5])
    assert rates.count() == 5 * 20 * 2 and rates.filter("arm in ('quiet', 'same') and (det > 0 or fa > 0)").count() == 0
    assert C.area_bootstrap(img.limit(0), 20).count() == C.conformal_rates(img.limit(0), 20).count() == 0
    assert C.area_bootstrap(img, 0).count() == 0


def test_beyond_the_generator_photographs_are_drawn(spark, monkeypatch):
    img = images(spark, SF)
    monkeypatch.setattr(C, "MOST_HALVED", 10)
    assert C.conformal_rates(img, 2).count() == 4 * 2 * 3


def test_no_photograph_meets_a_repetition(spark):
    """Photographs are aggregated to levels before anything is repeated, and few exchanges follow."""
    for df in (C.area_bootstrap(images(spark, SF), 2000), B.conformal_summary(C.conformal_rates(images(spark, SF), 1000))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("MapInPandas") if "MapInPandas" in plan else plan.index("MapInArrow")]
        assert "image_id" not in above and df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 15
        repeated = plan.index("Generate explode(")
        assert "collect_list" in plan[repeated:] and "Join" not in plan[:repeated]
