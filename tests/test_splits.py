"""Draws, the keep-first walk and the audit."""

import random

import pytest
from pyspark.sql import functions as F

from splitsight.operators import audit as U, dedup as Q, draws as D, visibility as V
from splitsight.sources import testdata as td


def items(spark, sizes):
    rows = [(c, f"{c}{i:04d}") for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "category string, id string")


def largest_remainder(sizes, n):
    total = sum(sizes.values())
    alloc = {c: n * s // total for c, s in sizes.items()}
    for c in sorted(sizes, key=lambda c: (-(n * sizes[c] % total), c))[: n - sum(alloc.values())]:
        alloc[c] += 1
    return alloc


@pytest.mark.parametrize("sizes,n", [({"a": 5, "b": 3, "c": 2}, 4), ({"a": 1, "b": 1, "c": 1}, 2), ({"x": 900, "y": 7}, 100)])
def test_stratified_take(spark, sizes, n):
    got = D.stratified_take(items(spark, sizes), n, "id")
    assert {r.category: r["count"] for r in got.groupBy("category").count().collect()} == {
        c: k for c, k in largest_remainder(sizes, n).items() if k
    }


def test_asking_for_too_many_fails(spark):
    with pytest.raises(Exception, match="only 3 remain"):
        D.stratified_take(items(spark, {"a": 3}), 4, "id").collect()


def test_chained_draws_are_disjoint_and_whole(spark):
    sizes = {"a": 120, "b": 45, "c": 8}
    got = D.chained_draws(items(spark, sizes), [("bg", 50), ("clutter", 50)], "rest", "id").collect()
    assert len(got) == len({r.id for r in got}) == 173
    first = largest_remainder(sizes, 50)
    second = largest_remainder({c: n - first[c] for c, n in sizes.items()}, 50)
    count = lambda role, c: sum(r.role == role and r.category == c for r in got)
    assert all(count("bg", c) == first[c] and count("clutter", c) == second[c] for c in sizes)


def test_nested_subsets(spark):
    got = D.nested_subsets(items(spark, {"a": 300}), [25, 200], "id")
    assert {r.slot: r["count"] for r in got.groupBy("slot").count().collect()} == {0: 25, 1: 175, 2: 100}
    small = D.nested_subsets(items(spark, {"a": 300}), [25], "id").filter("slot = 0").select("id")
    assert small.join(got.filter("slot = 0"), "id").count() == 25


def test_identity_split_published_sizes(spark):
    sizes = {"c1": 27, "c2": 17, "c3": 7, "c4": 3, "single": 1}
    got = D.split_identities(items(spark, sizes), "id", ["category"], "object")
    val = {r.category: r["count"] for r in got.filter("split = 'val'").groupBy("category").count().collect()}
    assert val == {"c1": 5, "c2": 3, "c3": 1, "c4": 1}


def test_validation_share_is_rounded(spark):
    """A fifth of 13 is 2.6 and of 12 is 2.4."""
    got = D.split_identities(items(spark, {"a": 13, "b": 12}), "id", ["category"], "s")
    val = {r.category: r["count"] for r in got.filter("split = 'val'").groupBy("category").count().collect()}
    assert val == {"a": 3, "b": 2}


def words(*ones):
    """A 256-bit hash with the given bits set, as four signed words."""
    out = [0, 0, 0, 0]
    for b in ones:
        out[b // 64] |= 1 << (b % 64)
    return [w - (1 << 64) if w >= 1 << 63 else w for w in out]


HASHED = "ord bigint, hash array<bigint>"


def test_keep_first_chain(spark):
    """A~B, B~C, A!~C: the walk keeps A and C."""
    a, b, c = words(), words(*range(8)), words(*range(16))
    df = spark.createDataFrame([(1, a), (2, b), (3, c)], HASHED)
    assert sorted(r.ord for r in Q.keep_first(df, []).collect()) == [1, 3]


def distance(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))


def family(seed, n):
    r = random.Random(seed)
    seeds = [set(r.sample(range(256), 100)) for _ in range(4)]
    rows = []
    for i in range(n):
        base = set(seeds[0] if i % 3 == 0 else r.choice(seeds))
        rows.append((i, words(*(base ^ set(r.sample(range(256), r.randint(0, 9)))))))
    r.shuffle(rows)
    return [(i, h) for i, (_, h) in enumerate(rows)]


@pytest.mark.parametrize("seed,hot", [(0, 512), (1, 2)])
def test_keep_first_is_the_sequential_walk(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(Q, "HOT_BUCKET", hot)
    rows, kept = family(seed, 160), []
    for i, h in rows:
        if all(distance(h, k) > 10 for _, k in kept):
            kept.append((i, h))
    got = sorted(r.ord for r in Q.keep_first(spark.createDataFrame(rows, HASHED), []).collect())
    assert got == [i for i, _ in kept]


@pytest.mark.parametrize("hot", [512, 2])
def test_near_pairs_are_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(Q, "HOT_BUCKET", hot)
    rows = family(5, 120)
    df = spark.createDataFrame(rows, HASHED).dropDuplicates(["hash"])
    mine = {(r.ord, tuple(r.hash)) for r in df.collect()}
    pairs = [(r.a, r.b, r.bits) for r in Q.near_pairs(df, [], "ord").collect()]
    got = set(pairs)
    assert len(pairs) == len(got)  # each pair once, without a distinct
    want = {(i, j, distance(h, k)) for i, h in mine for j, k in mine if i < j and distance(h, k) <= 10}
    assert got == want and want


def test_audit_of_clean_roles_passes_and_skips(spark):
    rows = [(r, "x", f"{r}/{i}.txt", f"{r} {i}") for r in ("pool", "pos_test") for i in range(3)]
    man = spark.createDataFrame(rows, "role string, category string, path string, content string")
    fp = spark.createDataFrame([(i, r, words(*range(40 * i, 40 * i + 40))) for i, r in enumerate(["pool", "pos_test", "pos_test"])], "item_id int, role string, hash array<bigint>")
    report = U.audit_report(man, fp, ["pool", "pos_test"], ["pool"])
    v = U.audit_verdict(report).first()
    assert (v.verdict, v.n_failed, v.n_skipped) == ("PASSED", 0, 2)


def test_owner_mask(spark):
    """A 10 x 10 object under an occluder that hides its left four columns, beside a tiny one."""
    cells = [(1, 1, "a", x, y) for x in range(10) for y in range(10)]
    cells += [(1, 2, None, x, y) for x in range(4) for y in range(10)]
    cells += [(1, 3, "b", 20 + x, y) for x in range(3) for y in range(3)]
    df = spark.createDataFrame(cells, "image_id int, z int, obj string, x int, y int")
    got = {r.obj: r for r in V.object_visibility(df, min_side=5).collect()}
    assert (got["a"].phi, got["a"].labelled) == (0.6, True)
    assert (got["a"].x0, got["a"].y0, got["a"].x1, got["a"].y1) == (4, 0, 10, 10)
    assert (got["b"].phi, got["b"].labelled, got["b"].x0) == (1.0, False, None)
    assert set(r.obj for r in V.object_visibility(df, min_side=5, min_cells=10).collect()) == {"a"}


def test_owner_mask_by_runs_and_by_cells(spark):
    """Random boxes on a wide grid that starts left of zero, some of them only hiding: every cell by hand."""
    rng = random.Random(5)
    runs, shown = [], {}
    for image in range(6):
        own = {}
        layers = rng.sample(range(100), 25)
        for z in layers:
            x, y, w, h = rng.randrange(-70, 200), rng.randrange(12), rng.choice([1, 5, 61, 62, 63, 150]), rng.randrange(1, 8)
            obj = f"o{z}" if rng.random() < 0.8 else None
            runs += [(image, z, obj, r, x, x + w) for r in range(y, y + h)]
            shown[image, z] = [obj, w * h, []]
            for cell in [(c, r) for c in range(x, x + w) for r in range(y, y + h)]:
                own[cell] = max(own.get(cell, -1), z)
        for cell, z in own.items():
            shown[image, z][2].append(cell)
    want = {}
    for (image, _), (obj, n, cells) in shown.items():
        if obj is None:
            continue
        box = (None,) * 4
        if cells and len(cells) / n >= 0.35:
            xs, ys = [c[0] for c in cells], [c[1] for c in cells]
            if max(xs) - min(xs) >= 2 and max(ys) - min(ys) >= 2:
                box = (min(xs), min(ys), max(xs) + 1, max(ys) + 1)
        want[image, obj] = (n, len(cells), *box)
    df = spark.createDataFrame(runs, "image_id int, z int, obj string, y int, x0 int, x1 int").repartition(5)
    cells = df.selectExpr("image_id", "z", "obj", "y", "explode(sequence(x0, x1 - 1)) as x")
    for got in (V.run_visibility(df, min_side=2), V.object_visibility(cells, min_side=2)):
        assert {(r.image_id, r.obj): (r.n_cells, r.n_visible, r.x0, r.y0, r.x1, r.y1) for r in got.collect()} == want
    assert any(v[2] is not None for v in want.values()) and any(v[1] == 0 for v in want.values())
    assert V.run_visibility(df.limit(0)).count() == 0


def test_unit_histogram_edges(spark):
    import numpy as np

    vals = [0.0, 0.025, 0.6, 0.575, 1.0, 0.9999, 0.3, 0.7, 0.35]
    df = spark.createDataFrame([(v,) for v in vals], "phi double")
    got = [r.n for r in V.unit_histogram(df, "phi").orderBy("bin").collect()]
    assert got == list(np.histogram(vals, bins=np.linspace(0, 1, 41))[0])


def test_runs_are_dealt_once_and_bands_change_nothing(spark, monkeypatch):
    """Boxes are shuffled before their runs are listed; what is shuffled after is one row for each object and band."""
    sf = "/root/testdata/sf0.001"
    objects = V.run_visibility(td.layer_runs(spark, sf), min_side=2)
    assert objects._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    want = sorted(map(str, objects.collect()))
    for module in (V, td):
        monkeypatch.setattr(module, "BAND", 2)
    for runs in (td.layer_runs(spark, sf), td.layer_runs(spark, sf).drop("band")):
        assert sorted(map(str, V.run_visibility(runs, min_side=2).collect())) == want


def test_audit_report_makes_its_tables_once(spark):
    """Hashes are made once, and documents read once for their paths and once for their contents."""
    made = {"items": spark.sparkContext.accumulator(0), "hashes": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        def each(batches):
            for batch in batches:
                made[name].add(len(batch))
                yield batch

        return df.mapInPandas(each, df.schema)

    # each text under two paths of a role, or twice under one, or in both roles, or null
    texts = [("a", "p1", "x"), ("a", "p2", "x"), ("a", "p3", "y"), ("a", "p3", "y"), ("b", "q1", "y"), ("b", "P1", "z"), ("b", "q2", None), ("b", "q3", None)]
    items = spark.createDataFrame(texts, "role string, path string, content string")
    hashes = spark.createDataFrame(
        [(0, "a", [0, 0, 0, 0]), (1, "a", [0, 0, 0, 7]), (2, "b", [0, 0, 0, 0]), (3, "b", [-1, -1, -1, -1])], "item_id bigint, role string, hash array<bigint>"
    )
    rows = U.audit_report(counted(items, "items"), counted(hashes, "hashes"), ["a", "b"], ["a"]).collect()
    got = {(r.check, r.a, r.b): (r.n, r.status) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        ("1 paths by pair", "a", "b"): (1, "FAIL"), ("2 train and eval unions", "", ""): (1, "FAIL"),
        ("3 lineage", "", ""): (None, "skipped"), ("4 copies", "", ""): (None, "skipped"),
        ("5 content within", "a", ""): (1, "FAIL"), ("5 content within", "b", ""): (1, "FAIL"),
        ("5 content by pair", "a", "b"): (1, "FAIL"),
        ("6 near copies within", "a", ""): (1, "FAIL"), ("6 near copies within", "b", ""): (0, "ok"),
        ("6 near copies by pair", "a", "b"): (2, "FAIL"),
    }
    assert {k: v.value for k, v in made.items()} == {"items": 2 * len(texts), "hashes": 4}
