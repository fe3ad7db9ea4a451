"""Document fingerprints that keep the order of what they sample."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ordering import linear_bucket
from .common import mix64, partitions

GRAM = 6  # code points of a k-mer
BINS = 64  # parts of the hash range, each with a signature of its own
PICK = 2  # least k-mers of a part whose text order is kept
PART_BYTES = 32 << 20
SPLIT = 64  # buckets of ids for each stretch
MOST = 1024  # buckets a level, two levels


def order_minhash(text: str, gram: int = GRAM, bins: int = BINS, pick: int = PICK) -> np.ndarray:
    """Order MinHash of a whole text: one 32-bit signature for each part of the hash range, 0 where empty.

    The n-th occurrence of a k-mer is an item of its own. Items fall to parts by their hash; in each part
    the `pick` items of least hash are put in text order and hashed as a tuple. A text shorter than a k-mer
    is one k-mer; an empty text has no items.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = np.zeros(bins, np.uint32)
    if not len(code):
        return out
    gram = min(gram, len(code))
    count = len(code) - gram + 1
    state = np.full(count, np.uint64(gram))
    for j in range(gram):
        state = (state ^ code[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
    state = mix64(state)
    places = max(20, int(count).bit_length())
    low = np.uint64((1 << places) - 1)
    # Sorted by k-mer and place, the number within a run of equal k-mers is the occurrence.
    tagged = np.sort((state & ~low) | np.arange(count, dtype=np.uint64))
    place = (tagged & low).astype(np.int64)
    same = tagged >> np.uint64(places)
    index = np.arange(count)
    start = np.maximum.accumulate(np.where(np.concatenate(([True], same[1:] != same[:-1])), index, 0))
    item = np.empty(count, np.uint64)
    item[place] = mix64(state[place] + (index - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    ordered = np.sort((item & ~low) | np.arange(count, dtype=np.uint64))
    part = ((ordered >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    heads = np.searchsorted(part, np.arange(bins + 1, dtype=np.uint64))
    first, last = heads[:-1], heads[1:]
    picks = np.full((bins, pick), count, np.int64)
    for i in range(pick):
        there = first + i < last
        picks[there, i] = (ordered[(first + i)[there]] & low).astype(np.int64)
    picks.sort(axis=1)
    value = np.append(item, np.uint64(0))
    signature = np.zeros(bins, np.uint64)
    for i in range(pick):
        signature = mix64(signature * np.uint64(0xA0761D6478BD642F) ^ value[picks[:, i]])
    filled = last > first
    out[filled] = (signature[filled] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signatures among parts that either text fills; 1 for two empty texts."""
    used = (a != 0) | (b != 0)
    n = int(used.sum())
    return float((a[used] == b[used]).sum() / n) if n else 1.0


def to_text(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def with_follower(docs: DataFrame) -> DataFrame:
    """Rows in stretches of ascending doc_id, each stretch followed by the first row of the next one.

    (part, follower, doc_id, text): within `part`, sorted, rows with `follower` only show what comes next;
    the last stretch is followed by the first row of all. Ids are counted in order-preserving buckets, some
    SPLIT a stretch and MOST * MOST at most, and a stretch is the buckets whose rows begin within its share.
    Nothing but the size comes to the driver; what is broadcast has a row a bucket or a stretch. Null ids come
    last, equal ids go by the hash of their text.
    """
    spark = docs.sparkSession
    own_id = F.col("doc_id").cast("long")
    size, rows, high = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1)), F.max(own_id)).first()
    parts = max(partitions(spark), -(-(size or 0) // PART_BYTES))
    buckets = min(MOST, math.ceil(math.sqrt(SPLIT * parts)))
    placed = docs.select(
        own_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(own_id, F.lit(2**63 - 1)).alias("key"),
        F.coalesce(own_id, F.lit(high or 0)).alias("at"),
    )
    placed = linear_bucket(placed, [], "at", buckets, "bucket")
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    # A row a bucket, so these windows are bounded as the broadcasts are.
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n").over(before), F.lit(0))
    dealt = counts.withColumn("part", F.floor(begin * F.lit(parts) / F.lit(max(rows, 1))).cast("long"))
    every = Window.partitionBy(F.lit(0))
    heads = dealt.groupBy("part").agg(F.min("least").alias("least")).select(
        "part", "least", F.coalesce(F.lag("part").over(every.orderBy("part")), F.max("part").over(every)).alias("before")
    )
    to_part = F.broadcast(dealt.select("bucket", "part").join(heads, "part"))
    own = F.struct("part", F.lit(False).alias("follower"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(True).alias("follower"))
    out = placed.join(to_part, "bucket").select(
        "doc_id", "text", "key", F.explode(F.when(F.col("key") == F.col("least"), F.array(own, ahead)).otherwise(F.array(own))).alias("to")
    )
    return (
        out.select("to.part", "to.follower", "doc_id", "text", "key")
        .repartition(partitions(spark), "part")
        .sortWithinPartitions("part", "follower", "key", F.xxhash64("text"))
        .select("part", "follower", "doc_id", "text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, and how near they are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edited
    text has its last n_chars // 2 code points replaced by the first as many (or all) of the next document.
    Reads doc_id and text. Null text is empty. A single document is its own next. Every row of the input
    gives a row; texts stream, two at a time, so no stretch is held in memory.
    """
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def edit(batches):
        held, out = None, []
        for batch in batches:
            for part, follower, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if held is None and follower:
                    continue
                own = order_minhash(text)
                if held is not None:
                    before, print_before, id_before = held
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    changed = order_minhash(edited)
                    out.append(
                        (
                            id_before, len(before), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            to_text(print_before), to_text(changed), likeness(print_before, changed), likeness(print_before, own),
                        )
                    )
                held = None if follower else (text, own, doc_id)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_follower(docs).mapInArrow(
        edit,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
