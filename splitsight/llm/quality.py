"""A quality classifier that compares compressed sizes under two dictionaries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

PER_CLASS = 1500  # labelled rows of each class that the fit may read
PIECES = 16  # stretches of a labelled text that a dictionary may learn from, spread over the whole text
DICTIONARY = 112 * 1024
PIECE = 1024  # bytes compressed at a time, so that a text's own history does not replace the dictionary
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Raw dictionaries of either class and the logistic curve over what they make of a text."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def measure(self):
        import zstandard as zstd

        def coder(content: bytes):
            d = zstd.ZstdCompressionDict(content) if len(content) >= 8 else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(
                **({"dict_data": d} if d is not None else {"level": LEVEL}),
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )

        good, bad = coder(self.good), coder(self.bad)

        def sizes(text: str | None) -> tuple[float, float]:
            """(bad size - good size) / (their sum) and their mean share of the text; (0, 1) if empty.

            The whole text counts, in pieces.
            """
            raw = (text or "").encode("utf-8", "surrogatepass")
            a = b = 0
            for i in range(0, len(raw), PIECE):
                piece = raw[i : i + PIECE]
                a += len(good.compress(piece))
                b += len(bad.compress(piece))
            return ((b - a) / (a + b), (a + b) / (2 * len(raw))) if raw else (0.0, 1.0)

        return sizes

    def score(self, difference: float, share: float) -> float:
        z = self.weights[0] * difference + self.weights[1] * share + self.weights[2]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on.

    Of more than DICTIONARY bytes that cannot be trained on, evenly spaced pieces are the dictionary.
    """
    import zstandard as zstd

    pieces = [
        raw[i : i + PIECE]
        for raw in (t.encode("utf-8", "surrogatepass") for t in texts)
        for i in range(0, len(raw), PIECE)
    ]
    try:
        return zstd.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(pieces[:: max(1, math.ceil(sum(map(len, pieces)) / DICTIONARY))])


def _logistic(x: np.ndarray, y: np.ndarray, share: dict[int, float]) -> tuple[float, float, float]:
    """Weights of a logistic curve; each class weighs its share of all labelled rows."""
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    a = np.column_stack((x, np.ones(len(x))))
    theta = np.zeros(3)
    ridge = np.diag([1e-7, 1e-5, 1e-5])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -40, 40)))
        slope = a.T @ (weight * (p - y)) + ridge @ theta
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(curve, slope)
        theta -= step * min(1.0, 20 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(t) for t in theta)


def training_rows(labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learnt from: crc32(doc_id) mod 3 is not 1."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return labels.filter(F.col("quality").isin(0, 1) & (fold != 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )


def _spread_pieces(text, most: int):
    """The whole text if it has at most `most` * PIECE characters, else that many in evenly spaced stretches."""
    whole = F.coalesce(F.col(text), F.lit(""))
    last = F.char_length(whole) - PIECE
    stretch = lambda i: F.substring(whole, F.floor(i * last / max(most - 1, 1)).cast("int") + 1, F.lit(PIECE))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), stretch)
    return F.when(F.char_length(whole) <= most * PIECE, F.array(whole)).otherwise(spread)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, pieces: int = PIECES) -> CompressionModel:
    """Fit on at most `per_class` labelled rows of each class.

    The sample is the first rows in hash order, so it does not depend on partitioning. Every other row
    of it builds the dictionaries, from whole texts or, where they are longer, `pieces` stretches spread over
    them. A doc_id with several labels has the least of them, one with several texts the least text. The rest
    calibrates: the executors measure those texts whole, as they will be scored, and send two numbers a
    row. What comes to the driver or is broadcast is bounded by 2 * per_class rows. With no row of a
    class the score is 0.5 throughout. Class shares are counted over all rows.
    """
    rows = training_rows(labels).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.lit("quality"), "doc_id")
    counts = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return CompressionModel(b"", b"", (0.0, 0.0, 0.0))
    picked = None
    for quality in (0, 1):
        some = rows.filter(F.col("quality") == quality).orderBy(order, "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = (
        texts.join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min(_spread_pieces("text", pieces)).alias("pieces"))
        .withColumn("order", order)
        .collect()
    )
    found = sorted(found, key=lambda r: (r.order, r.doc_id))
    of = {q: [r for r in found if r.quality == q] for q in (0, 1)}
    if not of[0] or not of[1]:
        return CompressionModel(b"", b"", (0.0, 0.0, 0.0))
    learnt = {q: [piece for r in of[q][::2] for piece in r.pieces] for q in of}
    raw = CompressionModel(_dictionary(learnt[1]), _dictionary(learnt[0]), (0.0, 0.0, 0.0))
    check = [(r.doc_id, q) for q in (0, 1) for r in of[q][1::2] or of[q]]
    ids = docs.sparkSession.createDataFrame(check, "doc_id long, quality int")
    measured = (
        texts.join(F.broadcast(ids), "doc_id")
        .select("doc_id", "quality", _measured(docs.sparkSession, raw)("text").alias("size"))
        .groupBy("doc_id", "quality")
        .agg(F.min("size").alias("size"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([tuple(r.size) for r in measured])
    y = np.array([r.quality for r in measured])
    total = sum(counts.values())
    return CompressionModel(raw.good, raw.bad, _logistic(x, y, {q: n / total for q, n in counts.items()}))


def _measured(spark, model: CompressionModel):
    """Column function: (difference, share) of each whole text under the model's dictionaries."""
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.pandas_udf("difference double, share double")
    def sizes(parts: pd.Series) -> pd.DataFrame:
        of = sent.value.measure()
        return pd.DataFrame([of(t) for t in parts], columns=["difference", "share"], dtype="float64")

    return sizes


def score(docs: DataFrame, model: CompressionModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; null and empty texts get what the curve says for no difference."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.pandas_udf("double")
    def scores(parts: pd.Series) -> pd.Series:
        m = sent.value
        sizes = m.measure()
        return pd.Series([m.score(*sizes(t)) for t in parts], dtype="float64")

    return docs.withColumn(out, scores(F.col(text)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    return scored.select(
        "doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
