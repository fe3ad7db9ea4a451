"""Packing of token sequences into fixed windows, best fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

WINDOW = 2048
END = 1  # id behind every document
SHARD = 50_000  # pieces packed together, about
VOCABULARY = "byte_bpe_50k.json"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """text -> ids of a byte-level BPE file, as its tokenizer gives them without adding any of its own.

    The merges of such a file are in the order of their ids, so the quicker ranked encoder gives the same
    ids; it is used if it does so on a probe. It knows no added tokens: texts that hold the string of one,
    such as <|endoftext|>, and texts that it refuses go to the slower one.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(vocabulary)
    slow = Tokenizer.from_file(path)

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec["added_tokens"]}
    added = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    quick = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "It's 1,024 naïve   tests:\n\n\tÜber 東京 🙂 don't \r\n x=3.14; <|endof aaaaaaaaaaaa  "
    if quick.encode_ordinary(probe) != plain(probe):
        return plain

    def encode(text: str) -> list[int]:
        if added.search(text):
            return plain(text)
        try:
            return quick.encode_ordinary(text)
        except BaseException as stopped:  # the ranked encoder panics on runs that its pattern cannot match
            if isinstance(stopped, (KeyboardInterrupt, SystemExit)):
                raise
            return plain(text)

    return encode


def token_pieces(
    docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False
) -> DataFrame:
    """Tokenize whole texts and cut them: full windows first, then the rest as one piece.

    (doc_id, start, length, ids_crc32, doc_tokens[, ids]). Null text is empty and has the end id alone.
    Rows with equal doc_id are cut each for itself. Tokens leave the task only if `with_ids`.
    """
    import pyarrow as pa

    def cut(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for doc_id, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end], "<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        for k, v in (
                            ("doc_id", doc_id), ("start", start), ("length", len(piece)),
                            ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(ids)),
                        ):
                            out[k].append(v)
                        if with_ids:
                            out["ids"].append(piece.astype(np.int32))
                if not with_ids:
                    out.pop("ids")
                kinds = {k: pa.int64() for k in out} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, _PIECE + (", ids array<int>" if with_ids else "")
    )


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities marks which have one."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.marks = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.marks[node] += by
            node //= 2

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out (capacity, window) of the least capacity that holds `need`."""
        node = self.leaves + need
        if not self.marks[node]:
            while node > 1 and (node & 1 or not self.marks[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.marks[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window number, offset) of each length; longest first, ties in order. Full ones need no search."""
    size = np.asarray(lengths, np.int64)
    where, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    full = np.flatnonzero(size == window)
    where[full] = np.arange(len(full))
    free = OpenWindows(window)
    opened = len(full)
    order = np.argsort(-size, kind="stable")[len(full) :]
    for i, need in zip(order.tolist(), size[order].tolist(), strict=True):
        found = free.tightest(need)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, name = found
        where[i], offset[i] = name, window - capacity
        if capacity > need:
            free.add(capacity - need, name)
    return where.tolist(), offset.tolist()


def most_pieces(docs: DataFrame, window: int = WINDOW) -> int:
    """No fewer pieces than `token_pieces` can give: an id stands for a byte at least, and one ends each document."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()
    return rows + ((size or 0) + rows) // window


def pack(pieces: DataFrame, count: int, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """`pieces` with sequence_id and offset: each sequence holds pieces without gaps, `window` at most.

    `count` is a bound on the number of pieces. They are dealt by hash of all that tells them apart to shards
    of `shard` pieces at most on average, however long the documents are or how many share an id; each is
    packed by best fit decreasing. A shard leaves a few windows partly open, so padding stays small at any
    size. Windows of different shards have different ids. Columns besides length are carried along.
    """
    import pyarrow as pa

    shards = max(1, -(-count // shard))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def place(table: "pa.Table") -> "pa.Table":
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        base = table["_shard"][0].as_py() << 40
        where, offset = best_fit_decreasing(table["length"].to_pylist(), window)
        return (
            table.drop_columns(["_shard"])
            .append_column("sequence_id", pa.array([base + w for w in where], pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64()))
        )

    place.__annotations__ = {}
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(place, schema + ", sequence_id long, offset long")


def packing_report(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs), most_pieces(docs))
