import json

from splitsight.sources import readers as I, sinks as K


def test_missing_inputs_are_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert I.read_manifest(spark, gone).count() == 0
    assert I.list_images(spark, gone).count() == 0
    assert I.read_json(spark, gone, "a int").count() == 0
    assert I.read_per_image(spark, gone).count() == 0


def test_malformed_json_is_dropped(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"a": 1, "b": {"c": 2}}, indent=2))
    (tmp_path / "bad.json").write_text('{"a": 1,')
    rows = I.read_json(spark, str(tmp_path), "a int, b struct<c: int>").collect()
    assert [(r.a, r.b.c) for r in rows] == [(1, 2)]


def test_list_images(spark, tmp_path):
    for n in ("a.JPG", "b.png", "c.txt", "d.webp", "e"):
        (tmp_path / n).write_bytes(b"x")
    names = sorted(r.path.rsplit("/", 1)[1] for r in I.list_images(spark, str(tmp_path)).collect())
    assert names == ["a.JPG", "b.png", "d.webp"]


def test_manifest_roles(spark, tmp_path):
    df = spark.createDataFrame([("bg", "c", "x/1"), ("pool", "c", "x/2"), ("bg", "d", "x/0")], "role string, category string, path string")
    K.write_manifest(df, str(tmp_path / "m"))
    assert I.read_manifest(spark, str(tmp_path / "m")).count() == 3
    got = I.read_manifest(spark, str(tmp_path / "m"), role="bg", limit=1).collect()
    assert [(r.role, r.category, r.path) for r in got] == [("bg", "d", "x/0")]
    plan = I.read_manifest(spark, str(tmp_path / "m"), role="bg")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_labels_from_files(spark, tmp_path):
    (tmp_path / "i1.txt").write_text("0 0.5 0.5 0.25 0.5\nbroken line\n")
    (tmp_path / "i2.txt").write_text("")
    size = spark.createDataFrame([("i1", 640.0, 320.0), ("i2", 10.0, 10.0), ("i3", 10.0, 10.0)], "image_id string, width double, height double")
    got = {r.image_id: (r.x0, r.y0, r.x1, r.y1) for r in I.read_labels(spark, str(tmp_path), size).collect()}
    assert got["i1"] == (240.0, 80.0, 400.0, 240.0)
    assert got["i2"] == got["i3"] == (None,) * 4 and len(got) == 3


def test_padded_curve_header(spark, tmp_path):
    (tmp_path / "results.csv").write_text("  epoch,   metrics/mAP50-95(B)\n  1,  0.25\n 2, 0.5\n")
    rows = I.read_training_curve(spark, str(tmp_path / "results.csv"), "metrics/mAP50-95(B)").collect()
    assert [(r.epoch, r.metric) for r in rows] == [(1, 0.25), (2, 0.5)]


def test_latency_rounds(spark, tmp_path):
    doc = {"imgsz": 640, "arms": {"": {"label": "A", "round_ms": [1.0, 2.0]}, "t": {"label": "B", "round_ms": [3.0]}}}
    (tmp_path / "l.json").write_text(json.dumps(doc))
    rows = sorted(tuple(r) for r in I.read_latency_rounds(spark, str(tmp_path / "l.json")).collect())
    assert rows == [("", "A", 0, 1.0), ("", "A", 1, 2.0), ("t", "B", 0, 3.0)]


def test_split_summary(spark):
    df = spark.createDataFrame([("bg", "a", "1"), ("bg", "b", "2"), ("pool", "a", "3")], "role string, category string, path string")
    r = K.split_summary(df, 0).first()
    assert r.counts == {"bg": 2, "pool": 1} and r.categories == ["a", "b"]


def test_scored_rows_come_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """However few partitions the session has; the rollup to photographs keeps the parts, and the rows are the same."""
    from pyspark.sql import functions as F

    from splitsight import session
    from splitsight.operators import thresholds as T
    from splitsight.sources import testdata as td

    n = 4000
    lines = spark.range(n).select(
        F.floor(F.col("id") / 2).alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"),
        (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 2).cast("int").alias("l_linenumber"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n // 2).select(
        F.col("id").alias("o_orderkey"), F.lit(1).cast("bigint").alias("o_custkey"),
        F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "A")], "c_custkey bigint, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    rolled = lambda: T.per_image(td.photos(spark, str(tmp_path)), td.scored(spark, str(tmp_path)), td.ARMS)
    plain = sorted(map(str, rolled().collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    part = F.spark_partition_id()
    assert td.scored(spark, str(tmp_path)).groupBy(part).count().agg(F.max("count")).first()[0] <= 200
    assert rolled().groupBy(part).count().agg(F.max("count")).first()[0] <= 200 // 2 * len(td.ARMS)
    assert sorted(map(str, rolled().collect())) == plain and len(plain) == n // 2 * len(td.ARMS)
