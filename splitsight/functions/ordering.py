"""Ranks, cuts and quantiles that never sort a whole group in one task.

Every helper works in two levels. Rows get an order-preserving bucket; bucket counts (a map-side
combined aggregate with a bounded number of rows per group) give each bucket its offset; only rows
inside one bucket are ever sorted together. A group that holds a third of the table is therefore
spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed, task_parts

HASH_DIGITS = 3  # 4,096 buckets per group
LINEAR_BUCKETS = 1024  # per level, two levels
ACCURACY = 10_000  # of the sketch that brackets quantiles
SMALL = 4 * ACCURACY  # groups with fewer values are counted whole
FEW_ROWS = 100_000  # small tables of up to this many rows may be broadcast; counted before they are


def hash_bucket(key: Column, digits: int = HASH_DIGITS) -> Column:
    """Bucket of an md5 key: its leading hex digits, which keep the key's order."""
    return F.substring(key, 1, digits)


def _group(by: list[str]) -> list[str]:
    return list(by) if by else ["_all"]


def _with_group(df: DataFrame, by: list[str]) -> DataFrame:
    return df if by else df.withColumn("_all", F.lit(0))


def few_rows(df: DataFrame, keys: list[str], most: int = FEW_ROWS) -> bool:
    """Whether `df` has at most `most` rows; only `keys` are computed and counting stops there."""
    return df.select(*keys).limit(most + 1).count() <= most


def meet(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], salts: int = 64) -> DataFrame:
    """`many` left-joined with `one`, which has one row for each value of `keys`; a key may hold most of `many`.

    The rows of a key are dealt over `salts` parts by a hash of the columns `by`; `one` is copied only to the
    parts that ask for it. `many` is read twice, so it should be cheap or written down. Null keys find nothing.
    """
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    asked = dealt.filter(F.col(keys[0]).isNotNull()).groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return dealt.join(asked.join(one, keys), [*keys, "_salt"], "left").drop("_salt")


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """`df` with the columns of a table of exactly one row, such as a global aggregate."""
    return df.crossJoin(F.broadcast(one))  # one row


def linear_bucket(
    df: DataFrame, by: list[str], value: str, buckets: int = LINEAR_BUCKETS, out: str = "_bkt"
) -> DataFrame:
    """Add an order-preserving bucket of a number: equal widths, twice.

    The first level cuts each group's range into `buckets` equal parts, the second cuts what each
    part really holds again. A few far-off values squeeze all others into one part of the first
    level; the second spreads them out.
    """
    v = F.col(value).cast("double")
    few = not by or few_rows(df.select(*by).distinct(), by, FEW_ROWS // buckets)
    hint = F.broadcast if few else (lambda side: side)  # at most `buckets` rows for each group

    def level(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        ends = rows.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        share = (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        part = F.when(F.col("_hi") > F.col("_lo"), F.floor(share * (buckets - 1))).otherwise(
            F.lit(0).cast("bigint")
        )
        ended = rows.join(hint(ends), keys) if keys else beside(rows, ends)
        return ended.withColumn(name, part).drop("_lo", "_hi")

    rows = level(level(df, list(by), "_b1"), [*by, "_b1"], "_b2")
    return rows.withColumn(out, F.col("_b1") * buckets + F.col("_b2")).drop("_b1", "_b2")


def bucket_offsets(df: DataFrame, by: list[str], bucket: str = "_bkt", weight=None) -> DataFrame:
    """(by, bucket, _n, _before): rows in each bucket and rows in all earlier buckets."""
    earlier = (
        Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        df.groupBy(*by, bucket)
        .agg(n.alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
    )


def positions(
    df: DataFrame, by: list[str], order: list, out: str = "pos", bucket: str = "_bkt"
) -> DataFrame:
    """Dense 0-based position of each row in its group's total order.

    `df` must carry `bucket`, an order-preserving bucket of the first order column.
    """
    g = _group(by)
    df = _with_group(df, by)
    inside = Window.partitionBy(*g, bucket).orderBy(*order)
    return (
        df.join(bucket_offsets(df, g, bucket).drop("_n"), [*g, bucket])
        .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before", bucket, *([] if by else ["_all"]))
    )


def running_totals(
    rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], count: int = 0
) -> DataFrame:
    """Add running sums `out` of columns (`sums` maps out to column) in each group's order, and the group's
    whole sums `out`_total, without a window over a whole group.

    Two passes: rows are written down in ranges of (by, order); each range sums for itself, and the sums of
    the ranges before it, one row a range and group, are its offset. Equal rows in `order` must not matter.
    Where `count`, the number of rows, asks for more ranges than the session has partitions, so many are made.
    """
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(session, task_parts(count))
    part = [*by, "_part"]
    placed = checkpointed(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    ranges = placed.groupBy(*part).agg(*[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = F.lit(0).cast("bigint")
    offsets = ranges.select(
        *part, *[F.coalesce(F.sum(f"_{out}").over(before), zero).alias(f"_{out}") for out in sums],
        *[F.sum(f"_{out}").over(whole).alias(f"{out}_total") for out in sums],
    )
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = placed.repartition(n, *part) if n > session else placed
    summed = dealt.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()})
    met = summed.join(offsets, part)
    return met.withColumns({out: F.col(out) + F.col(f"_{out}") for out in sums}).drop("_part", *[f"_{out}" for out in sums])


def cut_slots(
    df: DataFrame,
    by: list[str],
    order: list[str],
    cuts: DataFrame,
    cut_cols: list[str],
    out: str = "slot",
    bucket: str = "_bkt",
    few: bool | None = None,
) -> DataFrame:
    """Slot of each row when its group's total order is cut after the given row counts.

    `cuts` has one row per group with ascending cumulative counts; slot 0 is the first
    `cut_cols[0]` rows, and the last slot is everything after the last cut. Bucket counts tell in
    which bucket each cut falls; only those buckets are sorted, to find the last row before the
    cut. Every row is then compared with its group's cut rows, so the table itself is scanned and
    never shuffled while there are at most FEW_ROWS groups; with more, it meets them in a
    shuffled join. `few` says so where the caller knows. Groups absent from `cuts` are dropped.
    """
    edges = [f"_last{i}" for i in range(len(cut_cols))]
    cuts = cuts.select(*by, *cut_cols)
    counted = bucket_offsets(df, by, bucket)
    counted = counted.join(cuts, by) if by else beside(counted, cuts)
    holds = F.lit(False)
    for c in cut_cols:
        holds = holds | ((F.col(c) > F.col("_before")) & (F.col(c) <= F.col("_before") + F.col("_n")))
    if few is None:
        few = not by or few_rows(cuts, by)
    hint = F.broadcast if few else (lambda side: side)  # at most one row for each group and cut
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    ranked = (
        df.select(*dict.fromkeys([*by, bucket, *order]))
        .join(hint(counted.filter(holds).drop("_n")), [*by, bucket])
        .withColumn("_upto", F.col("_before") + F.row_number().over(inside))
    )
    row = F.struct(*order)
    found = ranked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_upto") == F.col(c), row)).alias(e) for c, e in zip(cut_cols, edges)]
    )
    lasts = cuts.join(found, by, "left") if by else beside(cuts, found)
    slot = F.lit(0)
    for c, e in zip(cut_cols, edges):
        beyond = F.when(F.col(c) <= 0, True).when(F.col(e).isNull(), False).otherwise(row > F.col(e))
        slot = slot + beyond.cast("int")
    placed = df.join(hint(lasts), by) if by else beside(df, lasts)
    return placed.withColumn(out, slot).drop(*edges, *cut_cols, bucket)


def rows_at(
    df: DataFrame, by: list[str], order: list, shares: list[float], bucket: str = "_bkt"
) -> DataFrame:
    """Rows at position int(q * (n - 1)) of each group's total order, with `point` = index of q.

    Only the buckets that hold a wanted position are sorted.
    """
    g = _group(by)
    df = _with_group(df, by)
    offsets = bucket_offsets(df, g, bucket).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*g))
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("point"),
                F.floor(F.lit(float(q)) * (F.col("_total") - 1).cast("double")).alias("rank"),
            )
            for i, q in enumerate(shares)
        ]
    )
    offsets = offsets.withColumn(
        "_want",
        F.filter(
            wanted,
            lambda t: (t["rank"] >= F.col("_before"))
            & (t["rank"] < F.col("_before") + F.col("_n")),
        ),
    ).filter(F.size("_want") > 0)
    inside = Window.partitionBy(*g, bucket).orderBy(*order)
    return (
        df.join(offsets.drop("_n", "_total"), [*g, bucket])
        .withColumn("pos", F.col("_before") + F.row_number().over(inside) - 1)
        .withColumn("_hit", F.explode(F.filter("_want", lambda t: t["rank"] == F.col("pos"))))
        .withColumn("point", F.col("_hit.point"))
        .drop("_hit", "_want", "_before", bucket, *([] if by else ["_all"]))
    )


def _brackets(vals: DataFrame, g: list[str], probs: list[float]) -> DataFrame:
    """(g, _total, _want, _bounds): wanted ranks of each group and value ranges that hold them, from one mergeable sketch.

    The sketch is off by one rank in ACCURACY at most, so ranges reach two ranks in ACCURACY to either side.
    Groups of fewer than SMALL values are one range for all ranks.
    """
    reach = 2.0 / ACCURACY
    points = [max(0.0, p - reach) for p in probs] + [min(1.0, p + reach) for p in probs]
    sketch = vals.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", points, ACCURACY).alias("_at"))
    small = F.col("_n") < SMALL
    of = lambda i: F.when(small, F.lit(0)).otherwise(F.lit(i))

    def want(i: int, p: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(float(p))
        return F.struct(
            F.lit(float(p)).alias("prob"), of(i).alias("id"), F.floor(at).alias("lo"), F.ceil(at).alias("hi"), (at - F.floor(at)).alias("frac")
        )

    def bounds(i: int, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(i).alias("id"), lo.alias("from"), hi.alias("to"))

    whole = F.array(bounds(0, F.lit(float("-inf")), F.lit(float("inf"))))
    each = F.array(*[bounds(i, F.get("_at", F.lit(i)), F.get("_at", F.lit(len(probs) + i))) for i in range(len(probs))])
    return sketch.select(
        *g, F.col("_n").alias("_total"), F.array(*[want(i, p) for i, p in enumerate(probs)]).alias("_want"), F.when(small, whole).otherwise(each).alias("_bounds")
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], count: str | None = None) -> DataFrame:
    """(by, prob, quantile): exact, linearly interpolated quantiles of the non-null values, in two scans.

    `count` names a column for the number of values, which the first scan has anyway.

    The first scan sketches every group and brackets the wanted ranks; the second counts what lies below
    each bracket and the distinct values inside it. Only those are shuffled and sorted, a few in ACCURACY of
    a large group. A bracket that missed its rank would stop the job, not pass a wrong value.
    """
    g = _group(by)
    vals = _with_group(df, by).filter(F.col(value).isNotNull()).select(*g, F.col(value).cast("double").alias("_v"))
    found = checkpointed(_brackets(vals, g, probs))
    few = not by or found.count() <= FEW_ROWS // len(probs)  # one row for each group
    held = found.select(*g, "_bounds")
    beside_its_bounds = vals.join(F.broadcast(held), g) if few else meet(vals, held, g, ["_v"])
    v = F.col("_v")
    place = lambda b: F.struct(
        b["id"].alias("id"), (v < b["from"]).alias("below"), F.when(v >= b["from"], v).alias("v")
    )
    counted = (
        beside_its_bounds.select(*g, F.explode(F.transform(F.filter("_bounds", lambda b: v <= b["to"]), place)).alias("_c"))
        .groupBy(*g, "_c.id", "_c.below", "_c.v").agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = Window.partitionBy(*g, "id").orderBy(F.desc("below"), "v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_n").over(upto)).filter(~F.col("below"))
    wanted = found.select(*g, "_total", F.explode("_want").alias("_w")).select(*g, "_total", F.col("_w.id").alias("id"), "_w")
    first = F.col("_end") - F.col("_n")
    lo = F.max(F.when((F.col("_w.lo") >= first) & (F.col("_w.lo") < F.col("_end")), F.col("v")))
    hi = F.max(F.when((F.col("_w.hi") >= first) & (F.col("_w.hi") < F.col("_end")), F.col("v")))
    met = ranked.join(F.broadcast(wanted) if few else wanted, [*g, "id"])
    quantile = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    missed = F.raise_error(F.lit("a bracket missed its rank")).cast("double")
    return (
        met.groupBy(*g, F.col("_w.prob").alias("prob"))
        .agg(lo.alias("_lo"), hi.alias("_hi"), F.max("_w.frac").alias("_frac"), F.max("_total").alias("_total"))
        .select(
            *by, "prob", F.when(quantile.isNull(), missed).otherwise(quantile).alias("quantile"),
            *([F.col("_total").alias(count)] if count else []),
        )
    )
