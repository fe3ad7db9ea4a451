"""Proportional draws, chained splits and identity assignment by md5 order.

The md5 of (seed, stage, key) replaces a random generator: it gives the same order in any engine
and does not depend on partitioning. Ranks are only computed inside the one hash bucket where a
draw ends, so no category is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import keyed_hash
from ..functions.ordering import beside, cut_slots, hash_bucket, linear_bucket, running_totals
from ..session import checkpointed

FEW_CATEGORIES = 10_000  # ranked in one window; counted before they are
VAL_SHARE = 0.2
GENERATED_VAL_SHARE = 0.15


def category_sizes(items: DataFrame, category: str = "category") -> DataFrame:
    return items.groupBy(category).agg(F.count(F.lit(1)).alias("size"))


def largest_remainder(
    sizes: DataFrame, n: int, tie: str = "category", size: str = "size", out: str = "alloc"
) -> DataFrame:
    """Add `alloc`: n spread over the categories in proportion to their sizes.

    Floors first; what is left goes one each to the largest remainders, ties by `tie`. Remainders
    are exact integers. Asking for more than there is stops the job. Sums are one row beside the table;
    the few categories that there mostly are get their rank in one window, more than FEW_CATEGORIES in
    ranges of the remainder.
    """
    sizes = checkpointed(sizes)
    wide = lambda c: c.cast("decimal(19,0)")
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    checked = F.when(
        F.lit(n) > F.col("_total"),
        F.raise_error(F.concat(F.lit(f"asked for {n} items, only "), F.col("_total").cast("string"), F.lit(" remain"))).cast("bigint"),
    ).otherwise(F.col("_total"))
    rows = beside(sizes, total.select(checked.alias("_total"))).withColumn("_exact", wide(F.lit(n)) * wide(F.col(size)))
    rows = rows.withColumn("_floor", F.expr("_exact div cast(_total as decimal(19,0))")).withColumn(
        "_rem", F.expr("_exact % cast(_total as decimal(19,0))")
    )
    left = rows.agg((F.lit(n).cast("bigint") - F.coalesce(F.sum("_floor"), F.lit(0))).alias("_left"))
    order = [F.desc("_rem"), F.asc(tie)]
    if sizes.count() <= FEW_CATEGORIES:
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    else:
        ranked = running_totals(rows.withColumn("_one", F.lit(1)), [], order, {"_rank": "_one"}).drop("_one", "_rank_total")
    return (
        beside(ranked, left)
        .withColumn(out, F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("bigint"))
        .drop("_total", "_exact", "_floor", "_rem", "_rank", "_left")
    )


def _keyed(items: DataFrame, key: str, seed: int, stage: str) -> DataFrame:
    rows = items.withColumn("_key", keyed_hash(F.lit(seed), F.lit(stage), key))
    return rows.withColumn("_bkt", hash_bucket(F.col("_key")))


def stratified_take(items: DataFrame, n: int, key: str, seed: int = 0, stage: str = "take") -> DataFrame:
    """n rows spread over `category` in proportion, the first of each category's md5 order."""
    cuts = largest_remainder(category_sizes(items), n)
    rows = cut_slots(_keyed(items, key, seed, stage), ["category"], ["_key", key], cuts, ["alloc"])
    return rows.filter("slot = 0").drop("slot", "_key")


def chained_draws(
    items: DataFrame, draws: list[tuple[str, int]], rest: str, key: str, seed: int = 0, stage: str = "chain"
) -> DataFrame:
    """Add `role`: each draw takes its share of what the earlier ones left, `rest` the remainder.

    One md5 order per category serves all draws; a draw is the next stretch of that order.
    """
    cuts = category_sizes(items).withColumn("_done", F.lit(0).cast("bigint"))
    names = []
    for i, (_, n) in enumerate(draws):
        cuts = cuts.withColumn("_open", F.col("size") - F.col("_done"))
        cuts = largest_remainder(cuts, n, size="_open", out="_take")
        cuts = cuts.withColumn("_done", F.col("_done") + F.col("_take")).withColumn(f"cut{i}", F.col("_done"))
        names.append(f"cut{i}")
    rows = cut_slots(_keyed(items, key, seed, stage), ["category"], ["_key", key], cuts, names)
    role = F.lit(rest)
    for i, (name, _) in enumerate(draws):
        role = F.when(F.col("slot") == i, name).otherwise(role)
    return rows.withColumn("role", role).drop("slot", "_key")


def exclude_by_name(items: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Rows whose name is not listed."""
    return items.join(names.select(name).distinct(), name, "left_anti")


def excluded_count(items: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(category, n_excluded, n_kept)."""
    listed = names.select(name).distinct().withColumn("_out", F.lit(True))
    return items.join(listed, name, "left").groupBy("category").agg(
        F.count("_out").alias("n_excluded"), F.count(F.when(F.col("_out").isNull(), 1)).alias("n_kept")
    )


def stratified_select(kept: DataFrame, n: int, order: str) -> DataFrame:
    """n rows in proportion to category, the earliest of each; all rows when there are not more.

    A null category counts as ''. Remainder ties go to the category that appears first.
    """
    rows = kept.withColumn("category", F.coalesce("category", F.lit("")))
    sizes = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("size"), F.min(order).alias("first")
    )
    sizes = checkpointed(sizes)
    # asked for more than there are, all are taken
    enough = (sizes.agg(F.sum("size")).first()[0] or 0) <= n
    cuts = sizes.select("category", F.col("size").alias("alloc")) if enough else largest_remainder(sizes, n, tie="first").select("category", "alloc")
    placed = linear_bucket(rows, ["category"], order)
    return cut_slots(placed, ["category"], [order], cuts, ["alloc"]).filter("slot = 0").drop("slot")


def nested_subsets(items: DataFrame, sizes: list[int], key: str, seed: int = 0, stage: str = "subset") -> DataFrame:
    """Add `slot`: 0 for the smallest subset, 1 for what the next one adds, and so on.

    Subset k is every row with slot <= k, so smaller subsets lie inside larger ones.
    """
    spark = items.sparkSession
    names = [f"cut{i}" for i in range(len(sizes))]
    cuts = spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for n, c in zip(sorted(sizes), names)])
    rows = cut_slots(_keyed(items, key, seed, stage), [], ["_key", key], cuts, names)
    return rows.drop("_key")


def split_identities(
    items: DataFrame, key: str, by: list[str], stage: Column | str, seed: int = 0
) -> DataFrame:
    """Add `split`: per group, max(1, round(0.2 n)) rows to val, none when there is only one.

    `stage` enters the md5, so kinds draw from independent streams.
    """
    n = F.col("size")
    k = F.when(n >= 2, F.greatest(F.lit(1), F.rint(n * F.lit(VAL_SHARE)).cast("bigint"))).otherwise(0)
    cuts = items.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).withColumn("n_val", k.cast("bigint"))
    stage = F.lit(stage) if isinstance(stage, str) else stage
    rows = items.withColumn("_key", keyed_hash(F.lit(seed), stage, key))
    rows = rows.withColumn("_bkt", hash_bucket(F.col("_key")))
    return (
        cut_slots(rows, by, ["_key", key], cuts, ["n_val"])
        .withColumn("split", F.when(F.col("slot") == 0, "val").otherwise("train"))
        .drop("slot", "_key")
    )


def identities_in_both(assigned: DataFrame) -> DataFrame:
    """(kind, name, n_splits) of identities on both sides; empty when the assignment is sound."""
    return assigned.groupBy("kind", "name").agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def positional_split(rows: DataFrame, order: str, share: float = GENERATED_VAL_SHARE) -> DataFrame:
    """Add `split`: the first floor(share * n) rows by `order` to val, the others to train."""
    cuts = rows.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("n_val"))
    placed = linear_bucket(rows, [], order)
    return (
        cut_slots(placed, [], [order], cuts, ["n_val"])
        .withColumn("split", F.when(F.col("slot") == 0, "val").otherwise("train"))
        .drop("slot")
    )
