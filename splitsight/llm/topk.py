"""Exact top-k inner products by branch and bound over ball trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed
from .common import partitions, table

SCALE = 64
EVERY = 20  # rows whose id this divides are queries
K = 20
SHARD = 8192  # rows of a tree
QUERIES = 1024  # queries that walk a tree together, at least
LEAF = 64
_NONE = -(2**62)


def quantized(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with null, infinite or undefined components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column, `width` wide: zeros behind shorter ones, longer ones cut."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width), np.int64)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


class BallTree:
    """Balls around halves of the rows, split between two far rows; leaves hold rows in order of id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.rows, self.ids, self.leaf = rows, ids, leaf
        self.nodes: list[tuple] = []  # centre, radius, least id, rows or None, left, right
        self._grow(np.argsort(ids, kind="stable"))

    def _grow(self, at: np.ndarray) -> int:
        x = self.rows[at].astype(np.float64)
        centre = x.mean(axis=0)
        distance = np.sqrt(((x - centre) ** 2).sum(axis=1))
        radius, name = float(distance.max(initial=0.0)), len(self.nodes)
        self.nodes.append(())
        if len(at) <= self.leaf:
            self.nodes[name] = (centre, radius, self.ids[at].min(), at, -1, -1)
            return name
        one = x[distance.argmax()]
        two = x[((x - one) ** 2).sum(axis=1).argmax()]
        side = x @ (two - one)
        half = np.sort(np.argsort(side, kind="stable")[: len(at) // 2])
        lower = np.zeros(len(at), bool)
        lower[half] = True
        left, right = self._grow(at[lower]), self._grow(at[~lower])
        self.nodes[name] = (centre, radius, self.ids[at].min(), None, left, right)
        return name

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray):
        """(scores, ids) of the best k rows of each query that beat its floor; unused places hold _NONE.

        A node is left when the bound centre * query + radius * |query| is below the k-th score so far, or
        equal to it with no smaller id inside. Nodes of the higher bound come first.
        """
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))
        top = max(np.abs(queries).max(initial=0), 1) * max(np.abs(self.rows).max(initial=0), 1) * max(queries.shape[1], 1)
        exact = np.float64 if top < 2**52 else np.int64
        q_exact, rows_exact = queries.astype(exact), self.rows.astype(exact)
        scores = np.full((len(q), k), _NONE, np.int64)
        found = np.full((len(q), k), 2**63 - 1, np.int64)
        kth, kth_id = floor_score.copy(), floor_id.copy()

        def bounds(node: int, active: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            reach = q[active] @ centre + radius * length[active]
            return np.floor(reach + 1e-9 * (np.abs(reach) + radius * length[active]) + 1e-6)

        stack = [(0, np.arange(len(q)))]
        while stack:
            node, active = stack.pop()
            bound = bounds(node, active)
            active = active[(bound > kth[active]) | ((bound == kth[active]) & (self.nodes[node][2] < kth_id[active]))]
            if not len(active):
                continue
            _, _, _, at, left, right = self.nodes[node]
            if at is None:
                order = sorted((left, right), key=lambda n: bounds(n, active).sum())
                stack += [(n, active) for n in order]
                continue
            got = (q_exact[active] @ rows_exact[at].T).astype(np.int64)
            ids = self.ids[at]
            better = (got > kth[active, None]) | ((got == kth[active, None]) & (ids < kth_id[active, None]))
            better &= ids != names[active, None]
            hit = better.any(axis=1)
            if not hit.any():
                continue
            active, got = active[hit], np.where(better[hit], got[hit], _NONE)
            every = np.concatenate((scores[active], got), axis=1)
            every_id = np.concatenate((found[active], np.broadcast_to(ids, got.shape)), axis=1)
            every_id = np.where(every == _NONE, 2**63 - 1, every_id)
            best = np.lexsort((every_id, -every), axis=1)[:, :k]
            scores[active], found[active] = np.take_along_axis(every, best, 1), np.take_along_axis(every_id, best, 1)
            last, last_id = scores[active, k - 1], found[active, k - 1]
            raised = (last > kth[active]) | ((last == kth[active]) & (last_id < kth_id[active]))
            kth[active[raised]], kth_id[active[raised]] = last[raised], last_id[raised]
        return scores, found


def _walks(k: int):
    """Rows sorted by shard and kind: a shard's rows grow one tree, its queries then stream through it."""
    import pyarrow as pa

    kinds = [pa.int64()] * 4

    def walk(tree: BallTree, part) -> pa.RecordBatch:
        names = part["vec_id"].to_numpy()
        floors = (part[c].to_numpy().copy() for c in ("floor", "floor_id"))
        scores, ids = tree.search(_matrix(part["v"], tree.rows.shape[1]), names, k, *floors)
        row, place = np.nonzero(scores != _NONE)
        columns = (part["number"].to_numpy()[row], names[row], ids[row, place], scores[row, place])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["number", "query_id", "vec_id", "score"])

    def run(batches):
        shard, rows, tree, waiting, waits = None, [], None, [], 0

        for batch in batches:
            at, kind = batch["shard"].to_numpy(), batch["kind"].to_numpy()
            turn = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *turn], [*turn, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if at[a] != shard:
                    if waiting:
                        yield walk(tree, pa.Table.from_batches(waiting).combine_chunks())
                    shard, rows, tree, waiting, waits = at[a], [], None, [], 0
                if kind[a] == 0:
                    rows.append(part.select(["vec_id", "v"]))
                    continue
                if tree is None and rows:
                    held = pa.Table.from_batches(rows).combine_chunks()
                    tree, rows = BallTree(_matrix(held["v"]), held["vec_id"].to_numpy()), []
                if tree is not None:
                    waiting.append(part)
                    waits += part.num_rows
                    if waits >= QUERIES:
                        yield walk(tree, pa.Table.from_batches(waiting).combine_chunks())
                        waiting, waits = [], 0
        if waiting:
            yield walk(tree, pa.Table.from_batches(waiting).combine_chunks())

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of whole-number vectors, ties to small ids.

    `rows` (vec_id, v array<long>) are dealt to shards of about `shard` rows, which grow a ball tree each;
    `queries` (the same columns) stream through the trees. In a first wave every query walks one tree; the
    k-th score that it finds there is the floor with which it walks all others in the second. So rows are
    shuffled twice, whatever the number of queries, and a query goes once to every shard, which is the work of
    an exact search over a stated query set; floors and bounds cut what is done there.

    A query does not find rows of its own id. Several queries of one id get a list each (equal ones, so their
    rows repeat). Rows that repeat are found as often. A null id or a null vector takes no part on either side.
    Vectors of unequal length meet as if the shorter ended in zeros. No rows or no queries, no result.
    """
    known = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    number = F.monotonically_increasing_id()  # written down at once, so it stays
    base = checkpointed(rows.filter(known).select(F.col("vec_id").cast("long").alias("vec_id"), "v", number.alias("number")))
    asked = checkpointed(queries.filter(known).select(F.col("vec_id").cast("long").alias("vec_id"), "v", number.alias("number")))
    shards = max(1, -(-base.count() // shard))
    n = partitions(rows.sparkSession)
    none, last = F.lit(_NONE).cast("long"), F.lit(2**63 - 1).cast("long")
    dealt = base.select(
        F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "number", "vec_id", "v",
        none.alias("floor"), last.alias("floor_id"),
    )
    home = F.pmod(F.xxhash64(F.lit("home"), "number"), F.lit(shards))

    def wave(part: DataFrame) -> DataFrame:
        both = dealt.unionByName(part.withColumn("kind", F.lit(1)).select(*dealt.columns))
        return both.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(
            _walks(k), "number long, query_id long, vec_id long, score long"
        )

    first = checkpointed(wave(asked.select("number", "vec_id", "v", home.alias("shard"), none.alias("floor"), last.alias("floor_id"))))
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    floors = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(
        "number", F.col("score").alias("floor"), F.col("vec_id").alias("floor_id")
    )
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: s != home)
    second = wave(
        asked.join(floors, "number", "left").select(
            "number", "vec_id", "v", F.coalesce("floor", none).alias("floor"), F.coalesce("floor_id", last).alias("floor_id"),
            F.explode(others).alias("shard"),
        )
    )
    return (
        (first.unionByName(second) if shards > 1 else first)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def topk_report(spark, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by EVERY. Vectors that are not usable take no part."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.filter(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("v")
    )
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
