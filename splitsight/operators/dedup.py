"""Exact and near duplicates of 256-bit hashes, and the keep-first walk over them.

Two hashes within 10 bits agree on at least two of 12 disjoint bands, so an equi-join on bands
finds every pair. Identical hashes are collapsed before any join, so a group of copies costs one
row however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import HASH_WORDS, NEAR_DUPLICATE_BITS, hamming
from ..functions.ordering import meet
from ..session import checkpointed, spread
from .graph import components

# Three bands of 21, 21 and 22 bits in each 64-bit word, as (shift, width).
BAND_LAYOUT = [(43, 21), (22, 21), (0, 22)]
N_BANDS = HASH_WORDS * len(BAND_LAYOUT)
HOT_BUCKET = 512
BLOCK = 512  # rows of a key that are compared with as many others in one cell


def content_hash(content) -> Column:
    return F.md5(F.col(content) if isinstance(content, str) else content)


def duplicate_groups(items: DataFrame) -> DataFrame:
    """(role, content_hash, n_paths, first_path) of contents a role holds more than once."""
    return (
        items.groupBy("role", content_hash("content").alias("content_hash"))
        .agg(F.countDistinct("path").alias("n_paths"), F.min("path").alias("first_path"))
        .filter("n_paths > 1")
    )


def band_values(hash_col: str = "hash") -> Column:
    """Array of (band, value) structs."""
    out = []
    for w in range(HASH_WORDS):
        for k, (shift, width) in enumerate(BAND_LAYOUT):
            v = F.shiftrightunsigned(F.element_at(hash_col, w + 1), shift).bitwiseAND(
                F.lit((1 << width) - 1)
            )
            out.append(
                F.struct(F.lit(w * len(BAND_LAYOUT) + k).alias("band"), v.alias("value"))
            )
    return F.array(*out)


def _banded(df: DataFrame) -> DataFrame:
    return df.withColumn("_bands", band_values()).withColumn("_b", F.explode_outer("_bands"))


def _split(rows: DataFrame, bucket: list[str], name: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the other buckets, rows of hot buckets once for each other band that lengthens their key)."""
    flagged = meet(rows, hot, bucket, [name])
    # a pair counts at the first two bands on which it agrees, so only later bands need to follow
    longer = F.filter("_bands", lambda x: x["band"] > F.col("_band"))
    hash_of = F.col("hash").alias(f"_{name}_hash")
    return (
        flagged.filter("_hot is null").select(*bucket, F.lit(None).cast("struct<band:int,value:bigint>").alias("_second"), name, hash_of),
        flagged.filter("_hot").withColumn("_second", F.explode(longer)).select(*bucket, "_second", name, hash_of),
    )


def _parts(n) -> Column:
    """Parts of a key of n rows, of BLOCK rows at most (three quarters of it on average)."""
    return F.ceil(n / F.lit(0.75 * BLOCK)).cast("int")


def _part(name: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(name), F.coalesce(F.col(parts), F.lit(1))).cast("int")


def _cells(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str) -> DataFrame:
    """All pairs of rows with the same key, large keys cut into cells of at most BLOCK by BLOCK rows."""
    count = lambda df, out: df.groupBy(*key).agg(_parts(F.count(F.lit(1))).alias(out))
    sizes = count(left, "_lp").join(count(right, "_rp"), key).filter("_lp > 1 or _rp > 1")
    last = lambda c: F.coalesce(F.col(c), F.lit(1)) - 1
    lefts = meet(left, sizes, key, [left_id]).select(
        *left.columns, _part(left_id, "_lp").alias("_i"), F.explode(F.sequence(F.lit(0), last("_rp"))).alias("_j")
    )
    rights = meet(right, sizes, key, [right_id]).select(
        *right.columns, F.explode(F.sequence(F.lit(0), last("_lp"))).alias("_i"), _part(right_id, "_rp").alias("_j")
    )
    return lefts.join(rights, [*key, "_i", "_j"])


def _triangle(rows: DataFrame, key: list[str]) -> DataFrame:
    """All unordered pairs of rows (a, b) with the same key: part i of a large key meets part j >= i."""
    sizes = rows.groupBy(*key).agg(_parts(F.count(F.lit(1))).alias("_p")).filter("_p > 1")
    dealt = meet(rows, sizes, key, ["a"]).withColumn("_at", _part("a", "_p")).withColumn("_p", F.coalesce("_p", F.lit(1)))
    lefts = dealt.select(*rows.columns, F.col("_at").alias("_i"), F.explode(F.sequence("_at", F.col("_p") - 1)).alias("_j"))
    rights = dealt.select(
        *key, F.col("a").alias("b"), F.col("_a_hash").alias("_b_hash"),
        F.explode(F.sequence(F.lit(0), "_at")).alias("_i"), F.col("_at").alias("_j"),
    )
    return lefts.join(rights, [*key, "_i", "_j"]).filter("_i < _j or a < b")


def _near(met: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs within the limit, kept where they first meet: at the first bands on which they agree."""
    near = met.withColumn("bits", hamming(f"_{left_id}_hash", f"_{right_id}_hash")).filter(
        F.col("bits") <= NEAR_DUPLICATE_BITS
    )
    differing = F.zip_with(f"_{left_id}_hash", f"_{right_id}_hash", lambda x, y: x.bitwiseXOR(y))
    agreed = F.transform(F.filter(band_values(differing), lambda x: x["value"] == 0), lambda x: x["band"])
    first = (F.col("_band") == F.get("_agreed", F.lit(0))) & (
        F.col("_second").isNull() | (F.col("_second.band") == F.get("_agreed", F.lit(1)))
    )
    return near.withColumn("_agreed", agreed).filter(first).select(*keys, left_id, right_id, "bits")


def _buckets(df: DataFrame) -> DataFrame:
    return _banded(df).withColumn("_band", F.col("_b.band")).withColumn("_value", F.col("_b.value"))


def _hot(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """Buckets of more than HOT_BUCKET rows, written down: mostly there are none."""
    return checkpointed(
        rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_BUCKET)
        .select(*bucket, F.lit(True).alias("_hot"))
    )


def near_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(keys, left_id, right_id, bits) of pairs within the limit, each once.

    left: (keys, left_id, hash); right: (keys, right_id, hash). Where more than HOT_BUCKET right
    rows share a band value, the key is lengthened by each later band in turn: a near pair agrees
    on two bands or more, so it still meets, and rows that share only the one value no longer do.
    Rows that share two bands are still compared with one another, in cells of BLOCK by BLOCK rows.
    """
    lb, rb = (_buckets(side.select(*keys, name, F.col("hash").alias("hash"))) for side, name in ((left, left_id), (right, right_id)))
    bucket = [*keys, "_band", "_value"]
    hot = _hot(rb, bucket)
    if hot.isEmpty():
        plain = lambda df, name: df.select(*bucket, name, F.col("hash").alias(f"_{name}_hash"))
        met = plain(lb, left_id).join(plain(rb, right_id), bucket)
        return _near(met.withColumn("_second", F.lit(None).cast("struct<band:int,value:bigint>")), keys, left_id, right_id)
    (lc, lh), (rc, rh) = _split(lb, bucket, left_id, hot), _split(rb, bucket, right_id, hot)
    cold = _near(lc.join(rc.drop("_second"), bucket), keys, left_id, right_id)
    lh, rh = checkpointed(lh), checkpointed(rh)
    return cold.unionByName(_near(_cells(lh, rh, [*bucket, "_second"], left_id, right_id), keys, left_id, right_id))


def near_pairs(items: DataFrame, keys: list[str], item_id: str) -> DataFrame:
    """(keys, a, b, bits) with a < b, each pair once, over rows with distinct hashes.

    As near_join of the items with themselves, but hot keys meet in a triangle of cells, so no pair is
    compared twice.
    """
    rows = _buckets(items.select(*keys, F.col(item_id).alias("a"), "hash"))
    bucket = [*keys, "_band", "_value"]
    hot = _hot(rows, bucket)
    hashed = lambda df, name: df.select(*bucket, F.col("a").alias(name), F.col("hash").alias(f"_{name}_hash"))
    none = F.lit(None).cast("struct<band:int,value:bigint>")
    if hot.isEmpty():
        met = hashed(rows, "a").join(hashed(rows, "b"), bucket).filter("a < b")
        return _near(met.withColumn("_second", none), keys, "a", "b")
    cold, long = _split(rows, bucket, "a", hot)
    second = cold.drop("_second").withColumnsRenamed({"a": "b", "_a_hash": "_b_hash"})
    met = cold.join(second, bucket).filter("a < b")
    pairs = _near(met, keys, "a", "b").unionByName(_near(_triangle(checkpointed(long), [*bucket, "_second"]), keys, "a", "b"))
    return pairs.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")


def near_duplicate_table(items: DataFrame, roles: list[str]) -> DataFrame:
    """(role_a, role_b, n_pairs) for every role with itself and with every later role.

    items: (item_id, role, hash). Pairs are found between distinct hashes and weighted by how
    many items of each role carry them; copies of one hash are counted, never listed. Distinct hashes
    are written down: they are read six times, and hashing is the longest part.
    """
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    uniq = items.groupBy("hash").agg(
        F.min("item_id").alias("first"),
        *[F.count(F.when(F.col("role") == r, 1)).alias(f"n{i}") for i, r in enumerate(roles)],
    )
    uniq = checkpointed(spread(uniq, "first"))  # a row becomes twelve, and these become pairs
    pairs = near_pairs(uniq, [], "first")
    counts = uniq.drop("hash")
    side = lambda s: counts.select(
        F.col("first").alias(s), *[F.col(f"n{i}").alias(f"{s}{i}") for i in range(len(roles))]
    )
    across = pairs.join(side("a"), "a").join(side("b"), "b")
    grid = [(i, j) for i in range(len(roles)) for j in range(i, len(roles))]

    def cells(value) -> Column:
        return F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(roles[i]).alias("role_a"), F.lit(roles[j]).alias("role_b"),
                        value(i, j).cast("decimal(38,0)").alias("n"),
                    )
                    for i, j in grid
                ]
            )
        ).alias("c")

    def between(i: int, j: int) -> Column:
        if i == j:
            return wide(f"a{i}") * wide(f"b{i}")
        return wide(f"a{i}") * wide(f"b{j}") + wide(f"a{j}") * wide(f"b{i}")

    def within(i: int, j: int) -> Column:
        if i == j:
            return wide(f"n{i}") * (wide(f"n{i}") - 1) / 2
        return wide(f"n{i}") * wide(f"n{j}")

    rows = across.select(cells(between)).unionByName(counts.select(cells(within))).select("c.*")
    return rows.groupBy("role_a", "role_b").agg(F.sum("n").cast("bigint").alias("n_pairs"))


# ------------------------------------------------------------------ keep the first
PIVOT_ROUNDS = 2
ROUNDS = 2  # rounds on the pair graph before its components are walked
WALK = 1_000_000  # pairs of a component that one walk may take; larger ones go on by rounds


def _pivot_round(todo: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pivots, dropped): rows that come first in all their band buckets, and rows near them.

    A pivot shares no band with an earlier undecided row, so nothing can drop it. Each bucket has
    at most one pivot, so rows meet 12 pivots at most: a family of near copies is thinned in time
    linear in its size, without listing its pairs.
    """
    bands = _banded(todo).select(
        *keys, "ord", "hash", F.col("_b.band").alias("band"), F.col("_b.value").alias("value")
    )
    firsts = bands.groupBy(*keys, "band", "value").agg(F.min("ord").alias("ord"))
    pivots = checkpointed(
        firsts.groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == N_BANDS).drop("_n").join(todo, [*keys, "ord"])
    )
    lead = _banded(pivots).select(
        *keys, F.col("ord").alias("_p"), F.col("hash").alias("_ph"),
        F.col("_b.band").alias("band"), F.col("_b.value").alias("value"),
    )
    dropped = (
        bands.join(lead, [*keys, "band", "value"])
        .filter((F.col("ord") > F.col("_p")) & (hamming("hash", "_ph") <= NEAR_DUPLICATE_BITS))
        .select(*keys, "ord").distinct()
    )
    return pivots, dropped


def keep_first(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, hash) of the rows a walk in `ord` order would keep.

    The walk keeps a row unless an earlier kept row is near it, so with A~B, B~C and A!~C both A
    and C stay. Only the first of identical hashes can stay. Pivot rounds settle most rows; the
    rest is settled on its pair graph: rows without an undecided earlier neighbour stay, their
    later neighbours go, and the remainder is tried again until nothing is undecided.
    """
    todo = checkpointed(items.groupBy(*keys, "hash").agg(F.min("ord").alias("ord")))
    kept = None
    add = lambda rows: rows if kept is None else kept.unionByName(rows)
    for _ in range(PIVOT_ROUNDS):
        pivots, dropped = _pivot_round(todo, keys)
        kept = add(pivots.select(*keys, "ord", "hash"))
        todo = checkpointed(
            todo.join(pivots.select(*keys, "ord"), [*keys, "ord"], "left_anti").join(
                dropped, [*keys, "ord"], "left_anti"
            )
        )
        if todo.isEmpty():
            return kept
    edges = checkpointed(near_pairs(todo, keys, "ord").select(*keys, "a", "b"))
    rounds = 0
    while not todo.isEmpty():
        if rounds == ROUNDS:
            settled, whole = _walked(edges, keys)
            kept = add(todo.join(settled.filter("stays").select(*keys, "ord"), [*keys, "ord"], "left_semi"))
            todo = checkpointed(todo.join(settled.select(*keys, "ord"), [*keys, "ord"], "left_anti"))
            edges = whole
            if todo.isEmpty():
                break
        rounds += 1
        blocked = edges.select(*keys, F.col("b").alias("ord")).distinct()
        sure = checkpointed(todo.join(blocked, [*keys, "ord"], "left_anti"))
        kept = add(sure.select(*keys, "ord", "hash"))
        gone = (
            edges.join(sure.select(*keys, F.col("ord").alias("a")), [*keys, "a"], "left_semi")
            .select(*keys, F.col("b").alias("ord")).distinct()
        )
        todo = checkpointed(
            todo.join(sure.select(*keys, "ord"), [*keys, "ord"], "left_anti").join(
                gone, [*keys, "ord"], "left_anti"
            )
        )
        left = todo.select(*keys, "ord")
        edges = checkpointed(
            edges.join(left.withColumnRenamed("ord", "a"), [*keys, "a"], "left_semi").join(
                left.withColumnRenamed("ord", "b"), [*keys, "b"], "left_semi"
            )
        )
    return kept


def _walked(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """((keys, ord, stays) of the rows of all components of up to WALK pairs, the pairs of larger ones).

    A component is walked once in order, as a stream of its pairs sorted by the later row: a row stays if
    none of its earlier neighbours does. What is held is which rows of the component stay. So a chain of
    near rows takes one walk and not one round a link. Rows of one key set are numbered apart from others.
    """
    from pyspark.sql import types as T

    name = lambda c: F.xxhash64(*keys, c) if keys else F.col(c)
    found = components(edges.select(name("a").alias("a"), name("b").alias("b")))
    tagged = checkpointed(edges.withColumn("node", name("a")).join(found, "node").drop("node"))
    size = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    sized = checkpointed(tagged.join(size, "component"))
    small = sized.filter(F.col("_n") <= WALK)
    kinds = {f.name: f.dataType for f in edges.schema}
    out = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("ord", kinds["a"]), T.StructField("stays", T.BooleanType())])
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = small.select("component", *keys, "a", "b").repartition(n, "component").sortWithinPartitions("component", *keys, "b", "a")
    settled = checkpointed(ordered.mapInPandas(_walk_components(keys), out))
    return settled, sized.filter(F.col("_n") > WALK).select(*keys, "a", "b")


def _walk_components(keys: list[str]):
    def run(batches):
        import pandas as pd

        now, stays = None, {}  # rows of the component that were met so far, and whether they stay
        out = []

        def close():
            out.extend((*now[1:], row, s) for row, s in stays.items())

        def rows():
            return pd.DataFrame(out, columns=[*keys, "ord", "stays"])

        for batch in batches:
            for component, *key, a, b in batch.itertuples(index=False, name=None):
                if (component, *key) != now:
                    if now is not None:
                        close()
                    now, stays = (component, *key), {}
                # pairs come by the later row, so a row met only as an earlier one has no earlier neighbour
                first = stays.setdefault(a, True)
                stays[b] = stays.get(b, True) and not first
            if len(out) > 50_000:
                yield rows()
                out.clear()
        if now is not None:
            close()
        if out:
            yield rows()

    return run


def drop_repeats(items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (keys, ord, hash, ...) that survive the keep-first walk."""
    return items.join(keep_first(items, keys).select(*keys, "ord"), [*keys, "ord"], "left_semi")


def _first_match(rows: DataFrame, against: DataFrame) -> DataFrame:
    """(hash, match): smallest `ord` of `against` near each distinct hash of `rows`."""
    left = rows.select("hash").distinct().withColumn("_h", F.col("hash"))
    right = against.groupBy("hash").agg(F.min("ord").alias("match"))
    return (
        near_join(left, right, [], "_h", "match").groupBy(F.col("_h").alias("hash"))
        .agg(F.min("match").alias("match"))
    )


def drop_across(pool: DataFrame, test: DataFrame) -> DataFrame:
    """(ord, outcome, match) of every pool row against the test set and then the pool itself.

    pool, test: (ord, hash). A pool row near any test row is dropped with the first such test
    row as match; the others go through the keep-first walk, and a dropped one names the first
    kept pool row near it.
    """
    hit = checkpointed(_first_match(pool, test))
    leaked = pool.join(hit, "hash").select("ord", F.lit("same as test").alias("outcome"), "match")
    rest = pool.join(hit, "hash", "left_anti")
    kept = keep_first(rest, [])
    stay = kept.select("ord", F.lit("kept").alias("outcome"), F.lit(None).cast("bigint").alias("match"))
    twins = rest.join(kept.select("ord"), "ord", "left_anti")
    again = twins.join(_first_match(twins, kept), "hash").select(
        "ord", F.lit("same as pool").alias("outcome"), "match"
    )
    return leaked.unionByName(stay).unionByName(again)
