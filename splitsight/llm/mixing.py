"""Mixing sources to target weights by pivotal rounding over a reduction tree."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed
from .common import fresh, word_count

WEIGHTS = (3, 1, 2)  # by order of the source, repeating
SHARE = 1.5  # words of the mix for each word of the input
MOST = 2.0  # copies of a document at most
LEAF = 8192  # documents rounded together in a leaf of the tree
FAN_IN = 256  # groups whose left-over documents meet on the next level
_ROUND = "row long, source string, leaf long, size long, p double, seed long"


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target): words that each source gives to the mix.

    Sources by code point, null last, weigh `weights` in turn. Targets are in proportion to weight, but
    at most `most` times the source; what that cuts off goes to the others by weight. The table has a row
    for each source, so its windows read counts and not documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1)
    )
    ranked = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    ratio = F.col("cap") / F.col("weight")
    full = Window.partitionBy()
    before = full.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(full) * F.lit(share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    capped = ranked.withColumn("total", total).withColumn(
        "capped", F.col("cap") * heavy <= F.col("weight") * left
    )
    open_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(full), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(full)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), open_words * F.col("weight") / open_weight)
    )
    return capped.select("source", "source_size", target.alias("target"))


def pivot(sizes: list[int], probabilities: list[float], rng: random.Random) -> list[float]:
    """Pivotal rounding in words: one probability at most stays between 0 and 1.

    Two open documents meet; words move from one to the other, in a random direction with the odds that
    keep both expectations, until one of them is wholly in or out. The sum of words stays the same.
    """
    p = list(probabilities)
    held = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * sizes[i], p[j] * sizes[j])
        down = min(p[i] * sizes[i], (1 - p[j]) * sizes[j])
        moved = up if rng.random() * (up + down) < down else -down
        to_i, to_j = p[i] + moved / sizes[i], p[j] - moved / sizes[j]
        p[i] = 0.0 if to_i < 1e-9 else 1.0 if to_i > 1 - 1e-9 else to_i
        p[j] = 0.0 if to_j < 1e-9 else 1.0 if to_j > 1 - 1e-9 else to_j
        held = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return p


def _rounding(last: bool):
    """The function of a group: round it; on the last level the document left open goes to the nearer end."""

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable")
        rng = random.Random(int(rows["seed"].iloc[0]) ^ len(rows))
        p = pivot(rows["size"].tolist(), rows["p"].tolist(), rng)
        if last:
            p = [float(x >= 0.5) for x in p]
        return rows.assign(p=p)

    return of_group


def _row(docs: DataFrame) -> Column:
    """One number for all that decides on a row: what is null counts too, since the hash passes over it."""
    read = [docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"].cast("string")]
    return F.xxhash64(*[x for c in read for x in (c.isNull(), c)])


def mix(
    docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, leaf: int = LEAF, seed: int = 42
) -> DataFrame:
    """(row, nth, doc_id, source, size, source_size, target, copies, taken) of every row of `docs`.

    A document's expected number of copies is target / source_size; the whole part is taken and the rest
    is rounded: leaves of about `leaf` documents of one source round by themselves and leave one open
    document each, those meet `FAN_IN` at a time on the next level, and so on to one group a source. So a
    source with a third of all rows is many leaves, and its words differ from the target by less than one
    document. Leaves and seeds come from hashes of the document, so reruns agree.

    Reads doc_id, source and text only. Null text has no words; such documents are drawn by their hash and
    add nothing. Null sources are one source. Rows equal in the three columns are rounded each for itself;
    they get equal `row` numbers and are told apart by `nth` (from 1). Empty input gives no rows.
    """
    spark = docs.sparkSession
    sized = checkpointed(
        docs.select(
            _row(docs).alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
        )
    )
    targets = source_targets(sized, weights, share, most)
    named = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sized.join(named, sized["source"].eqNullSafe(named["_source"]))
        .drop("_source")
        .withColumn("rate", F.least(rate, F.lit(float(most))))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("p", F.col("rate") - F.col("whole"))
    )
    leaves = max(1, -(-sized.count() // leaf))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit("drawn"), "row"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn(
        "p", F.when(F.col("size") > 0, F.col("p")).otherwise((drawn < F.col("p")).cast("double"))
    )
    settled = rows.filter((F.col("p") <= 0) | (F.col("p") >= 1)).select("row", "source", "size", "p")
    level = rows.filter((F.col("p") > 0) & (F.col("p") < 1)).select(
        "row", "source", F.pmod(F.xxhash64(F.lit(seed), F.lit("leaf"), "row"), F.lit(leaves)).alias("leaf"), "size", "p"
    )
    while True:
        last = leaves == 1
        seeded = level.withColumn("seed", F.xxhash64(F.lit(seed), F.lit(leaves), "source", "leaf"))
        done = checkpointed(seeded.groupBy("source", "leaf").applyInPandas(_rounding(last), _ROUND))
        is_settled = (F.col("p") <= 0) | (F.col("p") >= 1)
        settled = settled.unionByName(done.filter(is_settled).select("row", "source", "size", "p"))
        if last:
            break
        leaves = -(-leaves // FAN_IN)
        level = done.filter(~is_settled).select(
            "row", "source", F.floor(F.col("leaf") / FAN_IN).cast("long").alias("leaf"), "size", "p"
        )
    # Equal rows share a number: their rounded parts are added up and dealt out again, first come first.
    share_out = settled.groupBy("row").agg(F.sum("p").cast("long").alias("extra"))
    nth = F.row_number().over(Window.partitionBy("row").orderBy("doc_id"))
    return (
        rows.drop("p")
        .join(share_out, "row", "left")
        .withColumn("nth", nth)
        .withColumn("copies", F.col("whole") + (F.col("nth") <= F.coalesce("extra", F.lit(0))).cast("long"))
        .select(
            "row", "nth", "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, all its columns, whatever their names.

    Rows equal in doc_id, source and text share their copies evenly, in the order of a hash of all their
    columns, so it does not depend on partitioning which of them goes in once more. Texts are shuffled once.
    """
    row, nth, order, total, rows, times, copy = fresh(docs.columns, "row", "nth", "order", "total", "rows", "times", "copy")
    shares = mix(docs, **options).groupBy(F.col("row").alias(row)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    whole = F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns if c != "text"])))
    tagged = docs.withColumns({row: _row(docs), order: whole})
    tagged = tagged.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(order)))
    own = F.floor(F.col(total) / F.col(rows)) + (F.col(nth) <= F.col(total) % F.col(rows)).cast("long")
    every = [F.col(f"`{c}`") for c in docs.columns]
    return (
        tagged.join(shares, row)
        .withColumn(times, own.cast("int"))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times))))
        .select(*every)
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
