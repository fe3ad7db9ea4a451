"""Whole flows on the smallest test tables."""

from pyspark.sql import functions as F

from splitsight.catalog.boxes import fusion_boxes, weights
from splitsight.catalog.thresholds import external_thresholds, images
from splitsight.plans.compare import compare_arms
from splitsight.plans.ensemble import evaluate_ensemble
from splitsight.plans.evaluate import evaluate_arms
from splitsight.plans.splits import audit_roles, build_roles
from splitsight.sources import testdata as td

SF = "/root/testdata/sf0.001"


def test_evaluate_arms(spark):
    out = evaluate_arms(td.photos(spark, SF), td.scored(spark, SF), external_thresholds(spark, SF), td.ARMS)
    assert out["per_image"].count() == 6000
    assert out["fine_sweep"].count() == 4 * 159 and out["coarse_sweep"].count() == 36
    fine = {(r.arm, r.confidence): r for r in out["fine_sweep"].collect()}
    for arm in td.ARMS:  # both rates fall as the threshold rises
        rows = [fine[k] for k in sorted(k for k in fine if k[0] == arm)]
        assert all(a.fa_rate >= b.fa_rate and a.detection_rate >= b.detection_rate for a, b in zip(rows, rows[1:]))
    assert {r.arm: r.source for r in out["headline"].collect()}["m3"] == "test set"


def test_compare_arms(spark):
    contrasts = spark.createDataFrame([("f", "m0", "m1")], "family string, ref string, variant string")
    out = compare_arms(images(spark, SF), td.ARMS, contrasts, bootstrap_reps=5, calibration_reps=5)
    assert out["misaligned"].count() == 0
    assert out["pairs"].count() == out["matrix"].count() == 6
    matched = {(r.arm, r.budget): r.detection for r in out["matched"].collect()}
    hits = out["categories"].filter("role = 'pos_test'").groupBy("arm").agg((F.sum("k") / F.sum("n")).alias("d"))
    for r in hits.collect():  # two ways to the same rate
        assert abs(matched[(r.arm, 0.1)] - r.d) < 1e-12
    assert out["conformal"].count() == 12 and out["area_interval"].filter("low <= high").count() == 4


def test_ensemble(spark):
    out = evaluate_ensemble(td.photos(spark, SF), fusion_boxes(spark, SF), weights(spark, SF), td.truths(spark, SF))
    r = out["headline"].first()
    assert r.arm == "ensemble" and 0 < r.box_f1 <= 1 and 0.01 <= r.confidence <= 0.8
    assert out["fine_sweep"].count() == 159


def test_built_roles_pass_their_audit(spark):
    base = td.fingerprints(spark, SF).select(
        F.col("item_id").alias("ord"), "hash",
        F.concat(F.lit("src/"), F.col("item_id").cast("string"), F.lit(".png")).alias("path"),
        F.concat(F.col("item_id").cast("string"), F.lit(".png")).alias("name"),
        (F.col("item_id") % 3).cast("string").alias("category"),
    )
    third = lambda k: base.filter(F.col("ord") % 1000000 % 3 == k)
    roles = build_roles(third(0), third(1).unionByName(third(0).limit(20)), third(2), 120, [("bg", 30), ("clutter", 20)])
    rows = roles.groupBy("role").count().collect()
    n = {r.role: r["count"] for r in rows}
    assert n["bg"] == 30 and n["clutter"] == 20 and n["pos_test"] <= 120
    assert roles.select("path").distinct().count() == roles.count()
    man = roles.select("role", "category", "path", F.col("path").alias("content"))
    fp = roles.select(F.col("ord").alias("item_id"), "role", "hash")
    out = audit_roles(man, fp, td.MANIFEST_ROLES, td.TRAIN_ROLES)
    report = {(r["check"], r.a, r.b): r.status for r in out["report"].collect()}
    assert report[("1 paths by pair", "pool", "pos_test")] == "ok"
    assert report[("6 near copies by pair", "pool", "pos_test")] == "ok"
    assert report[("6 near copies within", "pool", "")] == report[("6 near copies within", "neg_test", "")] == "ok"
    assert report[("3 lineage", "", "")] == "skipped"
