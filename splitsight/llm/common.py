"""Small helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_SPACE_BYTES = np.zeros(256, bool)
_SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names behind so many underscores that no column has one of them."""
    taken, bar = {c.lower() for c in columns}, "_"
    while any((bar + n).lower() in taken for n in names):
        bar += "_"
    return [bar + n for n in names]


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but the six ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array: one buffer, row i at offsets[i]:offsets[i + 1].

    Null rows are empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) and the word offsets of every row.

    A word's hash folds its bytes, eight at a time, into one state; words never cross rows.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    solid = ~_SPACE_BYTES[raw]
    starts_row = np.zeros(n + 1, bool)
    starts_row[offsets] = True
    before = np.concatenate(([False], solid[:-1])) & ~starts_row[:n]
    begin = np.flatnonzero(solid & ~before)
    after = np.concatenate((solid[1:], [False])) & ~starts_row[1:]
    end = np.flatnonzero(solid & ~after) + 1
    length = end - begin
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    state = mix64(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(begin)), begin
    while len(live):
        left = end[live] - at
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(keep >= 64, np.uint64(2**64 - 1), (np.uint64(1) << (keep % np.uint64(64))) - np.uint64(1))
        state[live] = mix64(state[live] * np.uint64(0xA0761D6478BD642F) ^ (eight[at] & mask))
        more = left > 8
        live, at = live[more], at[more] + 8
    return state, np.searchsorted(begin, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row.

    A row with fewer words than `size` has its whole sequence as one shingle; without words, none.
    """
    words, bounds = word_hashes(raw, offsets)
    if len(words) == 0:
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    rolled = np.zeros(len(words), np.uint64)
    for j in range(size):
        part = np.zeros(len(words), np.uint64)
        part[: len(words) - j] = words[j:]
        rolled = mix64(rolled * np.uint64(0xE7037ED1A0B428DB) ^ part)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            state = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                state = mix64(state * np.uint64(0x8EBC6AF09C88C6E3) ^ w)
            out.append(state)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def row_chunks(offsets: np.ndarray, limit: int):
    """Consecutive row ranges of about `limit` bytes; one long row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)
