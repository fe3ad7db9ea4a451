"""Near duplicates of word shingles: sketched registers, bands, likelihood, then full sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.ordering import meet
from ..operators.graph import components
from ..session import checkpointed
from .common import fresh, mix64, partitions, row_chunks, shingle_sets, text_buffer

BASE = 1.01  # registers hold exponents of minima to this base
RATE = 20.0  # rate of the exponential variates
BANDS, ROWS = 24, 3
REGISTERS = BANDS * ROWS
PERCENT = 75  # 100 * intersection >= PERCENT * union
SURE = 14.0  # log likelihood by which a pair must fall short to be left out before the full sets decide
BLOCK = 2048  # members of a bucket that one task compares with as many others
SET_BLOCK = 2_000_000  # shingles of a family that one task holds
HUB_PART = 512  # members of a family that are confirmed beside one copy of its hub's set
CHUNK = 2_000_000  # bytes of text hashed at a time

_numbers = np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64)
_FACTORS = mix64(_numbers[:REGISTERS]) | np.uint64(1)
_SHIFTS = mix64(_numbers[REGISTERS:])


def registers(shingles: np.ndarray) -> np.ndarray:
    """Sketch of a set: for each register the exponent of its least exponential variate.

    The variate falls as a uniform hash falls, so the least one is that of the least hash: registers of a
    union are the greater of two registers. Exponents are truncated to whole numbers, 0 at least.
    """
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 2048):
        hashes = shingles[i : i + 2048, None] * _FACTORS + _SHIFTS
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, hashes.min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    exponent = np.floor(1.0 - np.log(np.maximum(variate, 1e-300)) / math.log(BASE))
    return np.clip(exponent, 0, 65535).astype("<u2")


_GRID = np.concatenate((np.linspace(0.0, 0.75, 31), np.linspace(0.75 + 0.0125, 1.0, 20)))


def _ahead(share: np.ndarray) -> np.ndarray:
    """Chance that one register is ahead: -log_b(1 - x (b - 1) / b)."""
    return -np.log1p(-np.maximum(share, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)


def plausible(a: np.ndarray, b: np.ndarray, size_a, size_b) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, whether PERCENT may be reached) of pairs of sketches.

    The likelihood is joint: registers ahead on one side, on the other, and equal, at the known set sizes.
    A pair stays in unless the likeliest similarity lies below the threshold and beats it by SURE. Sizes
    that rule the threshold out do so exactly. Either side may be a single sketch.
    """
    up, down = (a > b).sum(axis=-1)[:, None], (a < b).sum(axis=-1)[:, None]
    even = a.shape[-1] - up - down
    size_a, size_b = np.asarray(size_a, float), np.asarray(size_b, float)
    u = np.broadcast_to(size_a / (size_a + size_b), up.shape[:1])[:, None]
    v = 1.0 - u
    j = np.minimum(_GRID, np.minimum(u / v, v / u))
    p, q = _ahead(u - v * j), _ahead(v - u * j)
    like = up * np.log(p) + down * np.log(q) + even * np.log(np.maximum(1 - p - q, 1e-12))
    best = like.argmax(axis=1)
    row = np.arange(len(like))
    met = like[:, _GRID >= PERCENT / 100].max(axis=1)
    fits = 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
    return j[row, best], (like[row, best] - met <= SURE) & fits


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_hash, registers) of whole texts; sets without shingles have null set hashes."""
    import pyarrow as pa

    def sketch(batches):
        from hashlib import blake2b

        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for first, last in row_chunks(offsets, CHUNK):
                part = offsets[first : last + 1]
                sets = shingle_sets(raw[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "set_hash", "registers"],
                )

    return _texts(docs).mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, set_hash binary, registers binary")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash); an id and a hash name a text, also where an id has several."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )


@F.pandas_udf(T.ArrayType(T.LongType()))
def _full_set(texts: pd.Series) -> pd.Series:
    import pyarrow as pa

    out = []
    for t in texts:
        raw, offsets = text_buffer(pa.array([t], pa.string()))
        out.append(shingle_sets(raw, offsets)[0].view(np.int64))
    return pd.Series(out)


def _clusters(regs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of the cluster of each sketch: connected through plausible pairs, found breadth first."""
    cluster = np.full(len(regs), -1)
    for seed in range(len(regs)):
        if cluster[seed] >= 0:
            continue
        cluster[seed], queue = seed, [seed]
        while queue:
            open_rows = np.flatnonzero(cluster < 0)
            if not len(open_rows):
                return cluster
            x = queue.pop()
            _, keep = plausible(regs[open_rows], regs[x], sizes[open_rows], sizes[x])
            cluster[open_rows[keep]] = seed
            queue.extend(open_rows[keep].tolist())
    return cluster


def _groups(batches, keys: int):
    """Rows of sorted Arrow batches as one table for each value of the first `keys` columns."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *turn.tolist(), batch.num_rows]
        now = tuple(c[0] for c in columns)
        if held and held[0][0] != now:
            yield pa.Table.from_batches([x for _, x in held])
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches([x for _, x in held])
                held = []
            held.append((tuple(c[a] for c in columns), batch.slice(a, b - a)))
    if held:
        yield pa.Table.from_batches([x for _, x in held])


def _bucket_edges(batches):
    """Links from every member of a bucket to the least of its plausible cluster: no more than members."""
    import pyarrow as pa

    a, b = [], []
    for rows in _groups(batches, 3):
        reps = rows["rep"].to_numpy()
        if len(reps) > 1:
            order = np.argsort(reps, kind="stable")
            reps = reps[order]
            regs = np.frombuffer(b"".join(rows["registers"].to_pylist()), "<u2").reshape(-1, REGISTERS)[order]
            cluster = _clusters(regs, rows["n_shingles"].to_numpy().astype(float)[order])
            apart = cluster != np.arange(len(reps))
            a.append(reps[cluster[apart]])
            b.append(reps[apart])
        if len(a) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])


def _exact_links(batches):
    """Links of the loners of a family block, confirmed on full sets: one for each component they touch."""
    import pyarrow as pa

    for rows in _groups(batches, 3):
        reps, root, loner = (rows[c].to_numpy(zero_copy_only=False) for c in ("rep", "root", "loner"))
        sets = rows["shingles"].combine_chunks()
        bounds = sets.offsets.to_numpy().astype(np.int64)
        flat = sets.flatten().to_numpy()
        _, number = np.unique(flat, return_inverse=True)
        bounds = bounds - bounds[0]
        size = np.diff(bounds)
        marked = np.zeros(int(number.max(initial=0)) + 1, np.int32)
        known = {r: r for r in root.tolist()}

        def find(x, known=known):
            while known[x] != x:
                known[x] = known[known[x]]
                x = known[x]
            return x

        out_a, out_b = [], []
        members = np.flatnonzero(~loner.astype(bool) | (rows["own"].to_numpy(zero_copy_only=False).astype(bool)))
        for x in np.flatnonzero(rows["asks"].to_numpy(zero_copy_only=False).astype(bool)):
            own = number[bounds[x] : bounds[x + 1]]
            marked[own] = 1
            common = np.add.reduceat(marked[number], bounds[:-1])
            marked[own] = 0
            linked = 100 * common >= PERCENT * (size + size[x] - common)
            linked[x] = False
            for y in members[linked[members]]:
                i, j = find(root[x]), find(root[y])
                if i != j:
                    known[max(i, j)] = min(i, j)
                    out_a.append(reps[x])
                    out_b.append(reps[y])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Documents with equal sets are one class, however many. Classes share buckets by bands of registers;
    within a bucket (blocks of it, if it is large) the joint likelihood of registers joins those that may be
    similar, and each sends one link to the least of its cluster. Clusters over all buckets are families.
    Each family has a hub, the class with the most company in its buckets. Every member is confirmed against
    the hub on full sets; only those that fail it, the loners, are then held against all members of the
    family, blocks of loners by blocks of members, on full sets again. So a family of near copies takes one
    confirmation a member besides its loners, and no link that the likelihood lets through is lost.

    Reads doc_id and text. Null and empty texts have no shingles and stay alone; a null doc_id stays alone
    with a null component and is kept. Rows with equal doc_id and text are one node. Rows of one doc_id with
    different texts are nodes of their own: each is linked, named and kept by its own text.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame) -> DataFrame:
    """What near_components gives, with text_hash."""
    spark = docs.sparkSession
    rows = checkpointed(sketches(docs))
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = checkpointed(
        rows.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_hash")
        .agg(least, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        .select("set_hash", "least.*", "n_shingles", "registers", F.monotonically_increasing_id().alias("rep"))
    )
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    banded = classes.select("rep", F.explode(keys).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = checkpointed(banded.join(shared, "bucket"))

    # Block i meets every block: the pair is named by the lower and the higher number.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (
        members.withColumn("at", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("at", "with").alias("low"), F.greatest("at", "with").alias("high"), "rep")
        .join(classes.select("rep", "n_shingles", "registers"), "rep")
    )
    n = partitions(spark)
    edges = (
        dealt.select("bucket", "low", "high", "rep", "n_shingles", "registers")
        .repartition(n, "bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(_bucket_edges, "a long, b long")
    )
    company = members.groupBy("rep").agg(F.sum(F.col("members") - 1).alias("company"))
    family = checkpointed(
        components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "family")
        .join(company, "rep").join(classes.select("rep", "n_shingles"), "rep")
    )
    hubs = family.groupBy("family").agg(
        F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub"), F.sum("n_shingles").alias("shingles_of_family"),
        F.ceil(F.count(F.lit(1)) / HUB_PART).cast("int").alias("hub_parts"),
    )
    named = classes.select("rep", "doc_id", "text_hash")
    # a large family is confirmed in parts, each beside its own copy of the hub's set
    part = F.pmod(F.xxhash64("rep"), F.col("hub_parts")).cast("int").alias("hub_part")
    family = checkpointed(meet(family.select("rep", "family"), hubs, ["family"], ["rep"]).select("*", part).join(named, "rep"))
    sets = (
        _texts(docs).join(family, ["doc_id", "text_hash"])
        .select("family", "rep", "hub", "shingles_of_family", "hub_parts", "hub_part", _full_set("text").alias("shingles"))
        .persist(StorageLevel.DISK_ONLY)
    )
    hub_sets = sets.filter("rep = hub").select(
        "family", F.explode(F.sequence(F.lit(0), F.col("hub_parts") - 1)).alias("hub_part"), F.col("shingles").alias("hub_shingles")
    )
    common = F.size(F.array_intersect("shingles", "hub_shingles"))
    reach = 100 * common >= PERCENT * (F.size("shingles") + F.size("hub_shingles") - common)
    judged = checkpointed(sets.join(hub_sets, ["family", "hub_part"]).select("family", "rep", "hub", (~reach).alias("loner")))
    to_hub = judged.filter("not loner and rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))

    lonely = judged.groupBy("family").agg(F.count_if("loner").alias("loners")).filter("loners > 0")
    parts = F.ceil(F.col("shingles_of_family") / SET_BLOCK).cast("int")
    chunks = F.greatest(F.lit(1), F.least(parts, F.col("loners").cast("int")))
    laid = (
        sets.join(judged.select("rep", "loner"), "rep").join(lonely, "family")
        .select(
            "family", "rep", "loner", "shingles", F.when(F.col("loner"), F.col("rep")).otherwise(F.col("hub")).alias("root"),
            parts.alias("parts"), chunks.alias("chunks"),
        )
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "rep"), F.col("chunks")).cast("int"))
    )
    # Members go to each chunk of loners with their part; loners of a chunk go to each part as well.
    own = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("part").alias("part"), c.alias("chunk")))
    sent = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("part"), F.col("chunk").alias("chunk")))
    places = F.when(F.col("loner"), F.array_union(own, sent)).otherwise(own)
    tasks = laid.withColumn("to", F.explode(places)).select(
        "family", "to.part", "to.chunk", "rep", "root", "loner", (F.col("to.part") == F.col("part")).alias("own"),
        (F.col("loner") & (F.col("to.chunk") == F.col("chunk"))).alias("asks"), "shingles",
    )
    by_loners = (
        tasks.repartition(n, "family", "part", "chunk").sortWithinPartitions("family", "part", "chunk")
        .mapInArrow(_exact_links, "a long, b long")
    )
    found = components(to_hub.unionByName(by_loners))
    sets.unpersist()

    of_class = checkpointed(
        classes.select("set_hash", "rep", F.col("doc_id").alias("own")).join(found, F.col("rep") == F.col("node"), "left")
        .select("set_hash", "rep", "own", "component")
    )
    first = of_class.filter("component is not null").groupBy("component").agg(F.min("own").alias("first"))
    by_set = meet(of_class, first, ["component"], ["rep"]).select("set_hash", F.coalesce("first", "own").alias("named"))
    joined = meet(rows.drop("registers"), by_set, ["set_hash"], ["doc_id", "text_hash"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("named", "doc_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose document is kept: one document of every component, and all loners."""
    doc, text = fresh(docs.columns, "doc", "text")
    gone = _judged(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[doc]) & (F.xxhash64(docs["text"].cast("string")) == gone[text]), "left_anti")
