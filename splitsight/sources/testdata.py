"""Views of the TPC-H-ish test tables as the inputs the operators expect.

Each view has the same definition in SQL in `splitsight.catalog.views`. All of them are row-wise
expressions, equi-joins or map-side combined aggregates over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import HASH_SIDE, difference_hash, hash32, hash60
from ..operators.visibility import BAND
from ..session import spread, spread_rows

ARMS = ["m0", "m1", "m2", "m3"]
ROLES = ["pos_test", "neg_test"]
MANIFEST_ROLES = ["pool", "bg", "clutter", "pos_test", "neg_test"]
TRAIN_ROLES = ["pool", "bg", "clutter"]
TEST_ROLES = ["pos_test", "neg_test"]
TWO32 = 4294967296.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*parts) -> Column:
    """Pseudo-random double in [0, 1) from a hash of the parts."""
    return hash32(*parts).cast("double") / F.lit(TWO32)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, role, category): orders, by status, with the customer's market segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("image_id"),
        F.when(F.col("o_orderstatus") == "F", "pos_test").otherwise("neg_test").alias("role"),
        F.col("c_mktsegment").alias("category"),
    )


def photo_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, role) without the customer join."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.when(F.col("o_orderstatus") == "F", "pos_test").otherwise("neg_test").alias("role"),
    )


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, arm, box_id, u, x0, y0, x1, y1) straight from lineitem, before roles are known."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    key = [F.col(c) for c in LINE_KEY]
    order = F.col("l_orderkey")
    x0 = hash32(F.lit("cx"), order) % 400 + hash32(F.lit("jx"), *key) % 30
    y0 = hash32(F.lit("cy"), order) % 400 + hash32(F.lit("jy"), *key) % 30
    return (
        li.withColumn("x0", x0)
        .withColumn("y0", y0)
        .withColumn("w", 100 + hash32(F.lit("w"), *key) % 20)
        .withColumn("h", 100 + hash32(F.lit("h"), *key) % 20)
        .select(
            order.alias("image_id"),
            F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("arm"),
            F.concat_ws("-", *key[1:]).alias("box_id"),
            unit(F.lit("conf"), *key).alias("u"),
            "x0",
            "y0",
            (F.col("x0") + F.col("w")).alias("x1"),
            (F.col("y0") + F.col("h")).alias("y1"),
        )
    )


def confidence_of(u: Column, role: Column) -> Column:
    return F.when(role == "pos_test", 1 - (1 - u) * (1 - u)).otherwise(u * u)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, arm, role, conf) only: the columns the threshold operators read.

    Dealt by image_id in parts of bounded size, which the rollup to photographs keeps.
    """
    li = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    u = unit(F.lit("conf"), *LINE_KEY)
    rows = li.select(
        F.col("l_orderkey").alias("image_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("arm"),
        u.alias("u"),
    )
    return spread_rows(rows, li.count(), "image_id").join(photo_roles(spark, sf_dir), "image_id").select(
        "image_id", "arm", "role", confidence_of(F.col("u"), F.col("role")).alias("conf")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, arm, role, box_id, conf, x0, y0, x1, y1)."""
    return raw_boxes(spark, sf_dir).join(photo_roles(spark, sf_dir), "image_id").select(
        "image_id", "arm", "role", "box_id",
        confidence_of(F.col("u"), F.col("role")).alias("conf"), "x0", "y0", "x1", "y1",
    )


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, truth_id, x0, y0, x1, y1): one box per positive photograph."""
    x0 = hash32(F.lit("cx"), F.col("image_id")) % 400
    y0 = hash32(F.lit("cy"), F.col("image_id")) % 400
    return (
        photo_roles(spark, sf_dir)
        .filter("role = 'pos_test'")
        .select(
            "image_id", F.lit(0).alias("truth_id"), x0.alias("x0"), y0.alias("y0"),
            (x0 + 100).alias("x1"), (y0 + 100).alias("y1"),
        )
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, role, category, path, content) over documents, whole texts."""
    k = hash32(F.lit("role"), F.col("doc_id")) % 20
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(k < 2, "pool").when(k < 4, "bg").when(k < 6, "clutter").when(k < 12, "pos_test")
        .otherwise("neg_test").alias("role"),
        F.col("lang").alias("category"),
        F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, role, hash): a 256-bit difference hash of every vector and of one planted copy.

    Row r of the 16 x 17 grid walks the 64 values in steps of 2r + 1. A copy of vector v differs
    from it in the low v % 13 bits of the last word, so both sides of the 10-bit limit occur.
    """
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(HASH_SIDE - 1)),
        lambda r: F.transform(
            F.sequence(F.lit(0), F.lit(HASH_SIDE)),
            lambda c: F.element_at("embedding", ((2 * r + 1) * c % 64 + 1).cast("int")),
        ),
    )
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")  # few bytes, much to compute
    base = vectors.select("vec_id", difference_hash(grid).alias("hash"))
    flip = F.expr("shiftleft(1L, cast(vec_id % 13 as int)) - 1L")
    copy = F.array(
        *[F.element_at("hash", k) for k in (1, 2, 3)], F.element_at("hash", 4).bitwiseXOR(flip)
    )
    both = base.select(
        F.explode(
            F.array(
                F.struct((2 * F.col("vec_id")).alias("item_id"), F.col("hash").alias("hash")),
                F.struct((2 * F.col("vec_id") + 1).alias("item_id"), copy.alias("hash")),
            )
        ).alias("r")
    ).select("r.*")
    k = hash32(F.lit("role"), F.col("item_id")) % 20
    role = (
        F.when(k < 2, "pool").when(k < 4, "bg").when(k < 6, "clutter").when(k < 12, "pos_test")
        .otherwise("neg_test")
    )
    return both.select("item_id", role.alias("role"), "hash")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, round, ms): mean event value per type and day, from whole cents."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("arm"), F.to_date("ts").alias("round"))
        .agg((cents.cast("double") / F.count(F.lit(1)).cast("double") / 100).alias("ms"))
    )


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, epoch, metric): mean event value per type and day of month, from whole cents."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("arm"), F.dayofmonth("ts").alias("epoch"))
        .agg((cents.cast("double") / F.count(F.lit(1)).cast("double") / 100).alias("metric"))
    )


def screening_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, category, solid, haze): parts with two hashed shares."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.col("p_type").alias("category"),
        unit(F.lit("solid"), F.col("p_partkey")).alias("solid"),
        unit(F.lit("haze"), F.col("p_partkey")).alias("haze"),
    )


def screening_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, seq, cls, conf, area): a part's line items as detections on it."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"),
        F.concat_ws("-", "l_orderkey", "l_suppkey", "l_linenumber").alias("seq"),
        F.concat("l_returnflag", "l_linestatus").alias("cls"),
        unit(F.lit("conf"), *LINE_KEY).alias("conf"),
        F.col("l_quantity").alias("area"),
    )


def layer_runs(spark: SparkSession, sf_dir: str, cell: int = 25) -> DataFrame:
    """(image_id, band, z, obj, y, x0, x1): every box snapped to a cell grid, a run for each row; layers in hashed order.

    Boxes are dealt by image and band of rows, once for each band that they reach, before their runs are listed.
    """
    # the outer form keeps Spark from adding a "not empty" filter that would hash every box again
    b = raw_boxes(spark, sf_dir)
    first = lambda c: F.floor(F.col(c) / cell)
    last = lambda c: F.floor((F.col(c) - 1) / cell)
    snapped = b.select(
        "image_id", F.col("box_id").alias("obj"), first("x0").alias("x0"), (last("x1") + 1).alias("x1"),
        first("y0").alias("y0"), last("y1").alias("y1"),
    )
    bands = F.sequence(F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND))
    ys = F.sequence(F.greatest("y0", F.col("band") * BAND), F.least("y1", F.col("band") * BAND + (BAND - 1)))
    return (
        spread(snapped.withColumn("band", F.explode_outer(bands)), "image_id", "band")
        .select("image_id", "band", hash60(F.lit("z"), "image_id", "obj").alias("z"), "obj", "x0", "x1", ys.alias("ys"))
        .select("image_id", "band", "z", "obj", F.explode_outer("ys").alias("y"), "x0", "x1")
    )


def saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, grid): a 10 x 10 grid of (y, x, v) per positive photograph, one cell is 64 pixels.

    Photographs are dealt before their cells are made, so that no cell is shuffled.
    """
    photos = spread(photo_roles(spark, sf_dir).filter("role = 'pos_test'").select("image_id"), "image_id")
    cells = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in range(10) for x in range(10)])
    value = lambda c: unit(F.lit("sal"), F.col("image_id"), c["x"], c["y"])
    return photos.select(
        "image_id", F.transform(cells, lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), value(c).alias("v"))).alias("grid")
    )
