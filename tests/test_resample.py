"""Draws by md5 on arrays: the same draws, cuts and areas as photograph by photograph."""

import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitsight.functions.digests import Tails, of_numbers
from splitsight.operators import resample as B
from splitsight.operators.stats import partial_area

SCHEMA = "arm string, image_id bigint, role string, category string, max_conf double"
TARGETS = [0.01, 0.1, 0.15, 0.6]


def photographs(spark, n, seed=0):
    """Few scores and many, never-fired and repeated photographs, and one without a name."""
    rng = random.Random(seed)
    rows = []
    for i in [*range(n), *range(0, n, 7), None]:
        for arm in "ab":
            score = rng.choice([None, 0.5, rng.random(), rng.random()])
            rows.append((arm, i, "pos_test" if (i or 1) % 3 == 0 else "neg_test", "c", score))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_digests_are_md5():
    rng = random.Random(3)
    tails = [b"|" + rng.randbytes(rng.choice([0, 1, 8, 19, 40, 47, 48, 49, 120])) for _ in range(300)] + [b""]
    for head in (b"", b"half|0", b"draw|1234567", b"x" * 55, b"x" * 60):
        want = [int.from_bytes(md5(head + t).digest()[:8], "big") for t in tails]
        assert Tails(tails).heads(head).tolist() == want


@pytest.mark.parametrize("n, reach", [(5, 7.0), (1200, 7.0), (1200, 2.5), (1200, 1e-6)])
def test_cuts_of_counted_halves(spark, monkeypatch, n, reach):
    """Also with ranges of few photographs, and with ranges that miss."""
    img = photographs(spark, n)
    key = lambda df: {(r.arm, r.rep, r.target): (r.cut, r.held_alerts, r.n_held) for r in df.collect()}
    want = key(B.conformal_cuts(B.calibration_halves(img, 6), TARGETS))
    monkeypatch.setattr(B, "REACH", reach)
    assert key(B.split_cuts(img, 6, TARGETS)) == want and len(want) == 2 * 6 * len(TARGETS)


def test_cuts_of_nothing(spark):
    img = photographs(spark, 9)
    assert B.split_cuts(img.filter("role = 'pos_test'"), 3, TARGETS).count() == 0
    assert all(r.cut == float("inf") for r in B.split_cuts(img.filter("image_id = 1"), 3, TARGETS).collect())


@pytest.mark.parametrize("n, limit, reach", [(4, 0.15, 7.0), (900, 0.15, 7.0), (900, 0.15, -6.0), (900, 0.9, 7.0)])
def test_areas_of_compact_draws(spark, monkeypatch, n, limit, reach):
    """In small slices, chunks and blocks; a floor that is too high (reach below 0) is given up."""
    img = photographs(spark, n, 1)
    for name, value in (("SLICE", 100), ("CHUNK", 64), ("BLOCK", 4), ("COLUMNS", 100), ("REACH", reach)):
        monkeypatch.setattr(B, name, value)
    areas = partial_area(B.bootstrap_levels(img, 10), ["arm", "rep"], limit).collect()
    got = {r.arm: r for r in B.area_bootstrap(img, 10, limit).collect()}
    assert set(got) == {"a", "b"}
    for arm, r in got.items():
        each = [x.area for x in areas if x.arm == arm]
        assert r.reps == len(each) == 10
        np.testing.assert_allclose((r.low, r.high), np.quantile(each, (0.025, 0.975)), rtol=0, atol=1e-12)


def test_no_row_for_each_photograph_and_repetition(spark):
    """Draws are counts and places in binary columns; nothing explodes photographs by repetitions."""
    img = photographs(spark, 300)
    for df in (B.area_bootstrap(img, 40), B.conformal_rates(img, 40)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode([0,1,2,3" not in plan


@pytest.mark.parametrize("n", [0, 1, 24_999, 100_003])
def test_digests_of_numbers(n):
    got = [int(x) for some in of_numbers(b"draw|7|neg_test|", n) for x in some]
    assert got == [int.from_bytes(md5(b"draw|7|neg_test|%d" % i).digest()[:8], "big") for i in range(n)]


def test_counts_beyond_a_byte(monkeypatch):
    """All draws of a role on one photograph; slices of places have their own share of them."""
    monkeypatch.setattr(B, "of_numbers", lambda head, n: iter([np.full(n, (n - 1) << 4, np.uint64)]))
    sizes = {"neg_test": 300, "pos_test": 40}
    whole = B._weights(range(2), sizes, 0, 340)
    assert whole.tolist() == 2 * [299 * [0] + [300] + 39 * [0] + [40]]
    parts = [B._weights(range(2), sizes, a, min(340, a + 110)) for a in range(0, 340, 110)]
    assert np.concatenate(parts, axis=1).tolist() == whole.tolist()


def odd_photographs(spark, n):
    """Scores that many share, arms that photographs lack or have twice, an arm without a name and a third role."""
    rng, rows = random.Random(5), []
    for i in range(n):
        for arm in ["a", "b", None, *(["b"] if i % 5 == 0 else [])]:
            if not (arm == "a" and i % 3 == 0):
                score = rng.choice([None, 0.9, 0.5, 0.5, round(rng.random(), 2), float("nan")])
                rows.append((arm, i, ("pos_test", "neg_test", "neg_test", "train")[i % 4], "c", score))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("chunk, slice_", [(7, 1 << 28), (50, 1 << 28), (50, 90)])
def test_areas_of_odd_photographs(spark, monkeypatch, chunk, slice_):
    """Rows end inside a score; totals follow an arm's own photographs."""
    monkeypatch.setattr(B, "CHUNK", chunk)
    monkeypatch.setattr(B, "SLICE", slice_)
    img = odd_photographs(spark, 400)
    levels = B.bootstrap_levels(img, 6).withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    levels = levels.groupBy("arm", "rep", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    got = {r.arm: r for r in B.area_bootstrap(img, 6).collect()}
    assert set(got) == {"a", "b", None}
    for arm, r in got.items():
        each = []
        for rep in range(6):
            own = sorted((x for x in levels if x.arm == arm and x.rep == rep), key=lambda x: -1 if x.score is None else x.score, reverse=True)
            n_pos, n_neg = (sum(getattr(x, c) for x in own) for c in ("pos", "neg"))
            fa = det = area = 0.0
            for x in own:
                if x.score is None or fa + x.neg / n_neg > 0.15 + 1e-12:
                    break
                area, fa, det = area + x.neg / n_neg * (2 * det + x.pos / n_pos) / 2, fa + x.neg / n_neg, det + x.pos / n_pos
            each.append((area + (0.15 - fa) * det) / 0.15)
        assert r.reps == 6
        np.testing.assert_allclose((r.low, r.high), np.quantile(each, (0.025, 0.975)), rtol=0, atol=1e-9)


def test_draws_are_not_shuffled(spark):
    """What the bootstrap writes to disk does not grow with photographs times repetitions."""
    img = photographs(spark, 3000)
    files = lambda: {f.getPath(): f.length() for f in (of.apply(i) for of in [disk.getAllFiles()] for i in range(of.size()))}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written(reps: int) -> int:
        before = files()
        assert {r.reps for r in B.area_bootstrap(img, reps).collect()} == {reps}
        return sum(size for path, size in files().items() if path not in before)

    assert written(400) - written(40) < 3000 * (400 - 40) / 10  # bytes; a draw took more than one
