"""Near hashes in deep chains and hot buckets, and remainders of many categories, against plain recomputation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitsight.operators import dedup, draws as D


def near_hashes(n, step):
    """Hashes of which each is within the limit of the next ones but not of those further on."""
    rng = random.Random(1)
    value, out, recent = rng.getrandbits(256), [], []
    for _ in range(n):
        out.append(value)
        for bit in rng.sample(sorted(set(range(256)) - set(recent)), step):
            value ^= 1 << bit
            recent = [*recent[-100:], bit]
    return out


def words(value):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(value >> (64 * k) & (2**64 - 1)) for k in (3, 2, 1, 0)]


def kept_plainly(values):
    kept = []
    for i, v in enumerate(values):
        if not any(bin(v ^ values[j]).count("1") <= 10 for j in kept[-40:]):
            kept.append(i)
    return kept


def test_a_chain_of_ten_thousand_near_hashes(spark, monkeypatch):
    """Each hash is near the two after it: one walk settles the chain, in a fixed number of jobs."""
    values = near_hashes(10_000, 5)
    items = spark.createDataFrame([(i, words(v)) for i, v in enumerate(values)], "ord bigint, hash array<bigint>")
    written = []
    real = dedup.checkpointed
    monkeypatch.setattr(dedup, "checkpointed", lambda df: written.append(1) or real(df))
    got = sorted(r.ord for r in dedup.keep_first(items, []).select("ord").collect())
    assert got == kept_plainly(values)
    assert len(written) < 40


@pytest.mark.parametrize("bound", [10, 10**6])
def test_components_beyond_the_walk_go_on_by_rounds(spark, monkeypatch, bound):
    monkeypatch.setattr(dedup, "WALK", bound)
    values = near_hashes(16, 5)
    rows = [(k, i, words(v)) for k in ("a", "b") for i, v in enumerate(values)]
    items = spark.createDataFrame(rows, "role string, ord bigint, hash array<bigint>")
    got = {k: sorted(r.ord for r in dedup.keep_first(items, ["role"]).filter(F.col("role") == k).collect()) for k in "ab"}
    assert got["a"] == got["b"] == kept_plainly(values)


def test_hashes_that_share_two_bands_meet_in_cells(spark, monkeypatch):
    """4,000 hashes with two bands in common: every pair once, and no cell above BLOCK by BLOCK rows."""
    rng = random.Random(7)
    same = rng.getrandbits(42)  # the two upper bands of the first word
    values = []
    for i in range(4_000):
        low = rng.getrandbits(214)
        values.append(same << 214 | low)
        if i % 100 == 0:
            values.append(values[-1] ^ rng.getrandbits(3))
    values = list(dict.fromkeys(values))[:4_000]
    rows = spark.createDataFrame([(i, words(v)) for i, v in enumerate(values)], "item bigint, hash array<bigint>")
    cells = []
    real = dedup._triangle
    monkeypatch.setattr(dedup, "_triangle", lambda r, key: cells.append((r, key)) or real(r, key))
    got = {(r.a, r.b) for r in dedup.near_pairs(rows, [], "item").collect()}
    order = np.array([[v >> (64 * k) & (2**64 - 1) for k in (3, 2, 1, 0)] for v in values], np.uint64)
    want = set()
    for i in range(len(values)):
        bits = np.bitwise_count(order[i + 1 :] ^ order[i]).sum(axis=1)
        want |= {(i, i + 1 + int(j)) for j in np.flatnonzero(bits <= 10)}
    assert got == want and len(want) >= 20
    (long, key), = cells
    parts = long.groupBy(*key).agg(dedup._parts(F.count(F.lit(1))).alias("_p")).filter("_p > 1")
    sizes = long.join(parts, key).groupBy(*key, dedup._part("a", "_p")).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= dedup.BLOCK and sizes[1] >= len(values) // dedup.BLOCK


@pytest.mark.parametrize("hot", [1, 10**9])
def test_two_tables_meet_in_cells(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT_BUCKET", hot)
    monkeypatch.setattr(dedup, "BLOCK", 4)
    rng = random.Random(3)
    base = [rng.getrandbits(256) for _ in range(3)]
    make = lambda n: list(dict.fromkeys(rng.choice(base) ^ sum(1 << rng.randrange(256) for _ in range(rng.randrange(9))) for _ in range(n)))
    left, right = make(60), make(50)
    side = lambda v, name: spark.createDataFrame([("k", i, words(x)) for i, x in enumerate(v)], f"role string, {name} bigint, hash array<bigint>")
    got = sorted((r.x, r.y, r.bits) for r in dedup.near_join(side(left, "x"), side(right, "y"), ["role"], "x", "y").collect())
    dist = lambda a, b: bin(a ^ b).count("1")
    assert got == sorted((i, j, dist(a, b)) for i, a in enumerate(left) for j, b in enumerate(right) if dist(a, b) <= 10) and got


@pytest.mark.parametrize("few", [10_000, 3])
def test_remainders_of_many_categories(spark, monkeypatch, few):
    """Ranked in one window or in ranges, with many equal remainders."""
    monkeypatch.setattr(D, "FEW_CATEGORIES", few)
    rng = random.Random(2)
    sizes = [(f"c{i:03d}", rng.choice([1, 1, 1, 2, 7, 30])) for i in range(300)]
    total, n = sum(s for _, s in sizes), 211
    floors = {c: n * s // total for c, s in sizes}
    first = sorted(sizes, key=lambda x: (-(n * x[1] % total), x[0]))[: n - sum(floors.values())]
    want = {c: floors[c] + (c in dict(first)) for c, _ in sizes}
    df = spark.createDataFrame(sizes, "category string, size bigint").repartition(5)
    assert {r.category: r.alloc for r in D.largest_remainder(df, n).collect()} == want
