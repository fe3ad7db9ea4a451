"""Exact removal of repeated byte strings across documents by sorting suffixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import mix64, partitions, text_buffer

MIN_BYTES = 50
REACH = 26  # starts on either side of an anchor; every string of MIN_BYTES has an anchor near its start
BLOCK_BYTES = 8 << 20  # text of the documents that are handled together
SHALLOW = 2  # words of eight bytes that quicksort compares before the rest goes to tries
_ALL = np.uint64(2**64 - 1)


# --- deep-shallow sorting -------------------------------------------------------------------------------


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, start flags) of rows sorted by their first `depth` words.

    One key at a time: all rows are sorted by the first word, and only runs that are equal in it are
    sorted by the next. A flag marks the first row of each run that is equal in all of them.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    key = words[order, 0]
    starts = np.concatenate(([True], key[1:] != key[:-1]))[:n]
    for d in range(1, depth):
        group = np.cumsum(starts) - 1
        tied = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(tied):
            break
        rows = order[tied]
        inner = np.lexsort((words[rows, d], group[tied]))
        order[tied] = rows[inner]
        key = words[order[tied], d]
        same = (group[tied][1:] == group[tied][:-1]) & (key[1:] == key[:-1])
        starts[tied] = np.concatenate(([True], ~same))
    return order, starts


def blind_tries(words: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the rows of every tied run by a blind trie, and flag the runs of wholly equal rows.

    A trie node keeps the position of the first byte in which its strings differ and skips all before it;
    the strings branch there by that byte alone. All tries grow together, one level of nodes at a time.
    """
    order, starts = order.copy(), starts.copy()
    width = words.shape[1]
    live = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    while len(live):
        rows = order[live]
        head = starts[live]
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        lead = rows[first][group]
        # Skip value of each node: the least position where any of its strings leaves the leading one.
        skip = np.full(len(rows), width * 8, np.int64)
        open_rows = np.arange(len(rows))
        for w in range(width):
            differ = words[rows[open_rows], w] ^ words[lead[open_rows], w]
            hit = differ != 0
            if hit.any():
                d = differ[hit]
                zeros = np.zeros(len(d), np.int64)
                for step in (32, 16, 8):
                    top = (d >> np.uint64(64 - step)) == 0
                    zeros += top * (step // 8)
                    d = np.where(top, d << np.uint64(step), d)
                skip[open_rows[hit]] = w * 8 + zeros
                open_rows = open_rows[~hit]
            if not len(open_rows):
                break
        node = np.minimum.reduceat(skip, first)[group]
        branching = node < width * 8
        if not branching.any():
            break
        live, rows, group, node = live[branching], rows[branching], group[branching], node[branching]
        shift = (np.uint64(56) - np.uint64(8) * (node % 8).astype(np.uint64))
        char = (words[rows, node // 8] >> shift) & np.uint64(255)
        inner = np.lexsort((char, group))
        order[live] = rows[inner]
        group, char = group[inner], char[inner]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (char[1:] != char[:-1])))
        starts[live] = fresh
        live = live[~(fresh & np.append(fresh[1:], True))]
    return order, starts


def deep_shallow_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run number of every sorted row) of byte strings given as rows of big-endian words."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, starts = multikey_quicksort(words, min(SHALLOW, words.shape[1]))
    order, starts = blind_tries(words, order, starts)
    return order, np.cumsum(starts) - 1


# --- anchors and their surroundings ---------------------------------------------------------------------


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, zeros behind."""
    n, width = rows.shape
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = rows
    return out.view(">u8").astype(np.uint64)


def anchors(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(key, position, first start, last start, row) of every run of strings of `size` bytes with one anchor.

    The anchor of a string is its substring of least hash (the leftmost of equals), so equal strings have it
    at the same distance wherever they stand. Neighbouring strings mostly share it: a run.
    """
    n, span = len(raw), size - REACH
    windows = n - size + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return np.zeros(0, np.uint64), none, none, none, none
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    row_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found = []
    step = 1 << 19
    for base in range(0, windows, step):
        count = min(step, windows - base)
        grams = count + REACH
        state = np.zeros(grams, np.uint64)
        for at in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
            state = (state ^ eight[base + at : base + at + grams]) * np.uint64(0x9FB21C651E98DF25)
            state ^= state >> np.uint64(32)
        state *= np.uint64(0xD6E8FEB86659FD93)
        state ^= state >> np.uint64(32)
        # The place rides in the low bits, so the least value tells where it is.
        low = (state & ~np.uint64((1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
        reach = 1
        while 2 * reach <= REACH + 1:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = REACH + 1 - reach
        least = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        place = (least[:count] & np.uint64((1 << 20) - 1)).astype(np.int64)
        whole = row_of[base : base + count] == row_of[base + size - 1 : base + size - 1 + count]
        turn = np.concatenate(([True], (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])))
        first = np.flatnonzero(turn)
        last = np.append(first[1:], count) - 1
        good = whole[first]
        first, last = first[good], last[good]
        found.append((state[place[first]], place[first] + base, first + base, last + base, row_of[first + base]))
    key, pos, first, last, row = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run cut by the step or by nothing but a row's start is joined again.
    if len(pos) > 1:
        fresh = np.concatenate(([True], (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])))
        ends = np.append(np.flatnonzero(fresh)[1:], len(pos)) - 1
        key, pos, first, last, row = key[fresh], pos[fresh], first[fresh], last[ends], row[fresh]
    return key, pos, first, last, row


def surroundings(raw, pos, first, last, size) -> np.ndarray:
    """Rows of bytes: the strings of each run joined, laid out around the anchor, zeros elsewhere.

    Two more bytes tell which starts the run has, so equal rows are equal runs.
    """
    padded = np.concatenate((np.zeros(REACH, np.uint8), raw, np.zeros(size, np.uint8)))
    width = REACH + size
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[pos]
    column = np.arange(width)
    inside = (column >= (first - pos + REACH)[:, None]) & (column < (last - pos + REACH + size)[:, None])
    rows = np.where(inside, rows, 0).astype(np.uint8)
    return np.column_stack((rows, (first - pos + REACH).astype(np.uint8), (last - pos + REACH).astype(np.uint8)))


class _Block:
    """All documents of one block with their anchors, in an order that does not depend on the task."""

    def __init__(self, table, size: int):
        import pyarrow.compute as pc

        table = table.sort_by([("doc_id", "ascending"), ("_nth", "ascending")])
        self.raw, self.offsets = text_buffer(table["text"])
        ids = pc.fill_null(table["doc_id"], 2**63 - 1).to_numpy()
        self.table, self.ids, self.size = table, ids, size
        self.key, self.pos, self.first, self.last, self.row = anchors(self.raw, self.offsets, size)
        self.doc = ids[self.row] if len(self.row) else np.zeros(0, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor keys, and whether documents of different ids in the block have them."""
        order = np.argsort(self.key, kind="stable")
        key, doc = self.key[order], self.doc[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return key[starts], np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)

    def runs(self, shared: np.ndarray):
        """Distinct surroundings of the anchors with shared keys.

        (anchor index, run number of it, words, key and least document of each number), numbers in order.
        """
        at = np.flatnonzero(np.isin(self.key, shared))
        words = _packed(surroundings(self.raw, self.pos[at], self.first[at], self.last[at], self.size))
        order, number = deep_shallow_sort(words)
        of = np.empty(len(at), np.int64)
        of[order] = number
        heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(at) else np.zeros(0, np.int64)
        if not len(at):
            return at, of, words, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        least = np.minimum.reduceat(self.doc[at][order], heads)
        return at, of, words[order[heads]], self.key[at][order[heads]], least


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def earlier_starts(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Masks of the starts whose string also stands in a document of a smaller id among these rows.

    Bit s is the start at distance s from the left end of the surroundings. Each start takes part in one
    deep-shallow sort of the strings of `size` bytes that begin there.
    """
    raw = words.astype(">u8").view(np.uint8).reshape(len(words), -1)
    lo, hi = raw[:, REACH + size], raw[:, REACH + size + 1]
    masks = np.zeros(len(words), np.uint64)
    for s in range(REACH + 1):
        at = np.flatnonzero((lo <= s) & (s <= hi))
        if len(at) < 2:
            continue
        order, number = deep_shallow_sort(_packed(raw[at, s : s + size]))
        heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        least = np.minimum.reduceat(doc[at][order], heads)[number]
        rows = at[order]
        masks[rows] |= (least < doc[rows]).astype(np.uint64) << np.uint64(s)
    return masks


# --- the Spark side -------------------------------------------------------------------------------------


def _compress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: byte ranges that stand in a document of smaller doc_id.

    `spans` are the maximal runs [start, end) of bytes covered by a string of `min_bytes` that also starts in
    a document with a smaller id; `kept` is the text's remaining bytes.

    Documents are dealt to blocks of about `block_bytes` by hash. A block sends each of its anchor keys once
    to the key's bucket; buckets answer which keys other blocks have, too. Only around such anchors, and
    each distinct surrounding once a block, bytes are sent (compressed) to the buckets, which sort the
    strings around them deep-shallow and answer with a mask of 27 starts. So a string that stands in a third
    of all documents is one entry a block, nothing meets in pairs, and every string is compared in full.

    Reads doc_id and text. Null and empty texts have no bytes. Texts of equal id do not remove from each
    other; null ids come last, as one id. Texts shorter than `min_bytes` stay whole. `min_bytes` is 34 at
    least.
    """
    import pyarrow as pa

    size = min_bytes
    if size < REACH + 8:
        raise ValueError(f"min_bytes must be {REACH + 8} at least")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(partitions(spark), -(-total // (16 * block_bytes)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("_nth"),
        F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).alias("block"),
    ).repartition(partitions(spark), "block")
    sent = "block long, bucket long, data binary"

    def deal(block: int, key: np.ndarray, columns: list[np.ndarray], last: bytes = b"") -> "pa.Table":
        """One row a bucket: the columns' bytes of the entries that belong there, in their order."""
        to = _bucket(key, buckets)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1]))) if len(to) else []
        ends = np.append(cut[1:], len(to)) if len(to) else []
        names, data = [], []
        for a, b in zip(cut, ends, strict=True):
            part = order[a:b]
            names.append(int(to[part[0]]))
            data.append(b"".join(c[part].tobytes() for c in columns))
        return pa.table({"block": pa.array([block] * len(names), pa.int64()), "bucket": pa.array(names, pa.int64()), "data": pa.array(data, pa.binary())})

    def send_keys(group):
        block = _Block(group, size)
        key, _ = block.distinct()
        short = key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]  # the two bytes that are left out only cost a comparison
        return deal(group["block"][0].as_py(), key, [short])

    def answer_keys(group):
        group = group.sort_by("block")
        parts = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in group["data"].to_pylist()]
        wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
        wide[:, 2:] = np.concatenate(parts)
        key = wide.view(">u8").ravel().astype(np.uint64)
        order = np.argsort(key, kind="stable")
        near = key[order][1:] == key[order][:-1]
        met = np.zeros(len(key), bool)
        met[order[1:]] |= near
        met[order[:-1]] |= near
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        data = [np.packbits(x).tobytes() for x in np.split(met, cuts)]
        return pa.table({"block": group["block"], "bucket": group["bucket"], "data": pa.array(data, pa.binary())})

    def returned(answers, key: np.ndarray, unpack) -> np.ndarray:
        """Answers of all buckets, brought back to the order of the entries that were sent."""
        to = _bucket(key, buckets)
        order = np.argsort(to, kind="stable")
        got = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True))
        out, at = [], 0
        names, counts = np.unique(to, return_counts=True)
        for name, count in zip(names.tolist(), counts.tolist(), strict=True):
            out.append(unpack(got[name], count))
            at += count
        back = np.concatenate(out) if out else unpack(b"", 0)
        values = np.empty(len(key), back.dtype)
        values[order] = back
        return values

    def bits(data: bytes, count: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)

    def shared_keys(block: _Block, answers) -> np.ndarray:
        key, here = block.distinct()
        return key[here | returned(answers, key, bits)]

    width = -(-(REACH + size + 2) // 8)

    def send_runs(group, answers):
        block = _Block(group, size)
        shared = shared_keys(block, answers)
        _, _, words, key, least = block.runs(shared)
        out = deal(group["block"][0].as_py(), key, [key, least, words])
        packed = [_compress(x) for x in out["data"].to_pylist()]
        # The bit map of shared keys goes along, so that the last pass need not ask again.
        every, _ = block.distinct()
        mark = np.packbits(np.isin(every, shared)).tobytes()
        out = out.set_column(2, "data", pa.array(packed, pa.binary()))
        extra = pa.table({"block": [group["block"][0].as_py()], "bucket": pa.array([-1], pa.int64()), "data": pa.array([_compress(mark)], pa.binary())})
        return pa.concat_tables([out.cast(extra.schema), extra])

    def answer_runs(group):
        if group["bucket"][0].as_py() < 0:
            return group.select(["block", "bucket", "data"])
        group = group.sort_by("block")
        keys, docs_, words, counts = [], [], [], []
        for x in group["data"].to_pylist():
            raw = _expand(x)
            n = len(raw) // (16 + 8 * width)
            keys.append(np.frombuffer(raw, np.uint64, n))
            docs_.append(np.frombuffer(raw, np.int64, n, 8 * n))
            words.append(np.frombuffer(raw, np.uint64, n * width, 16 * n).reshape(n, width))
            counts.append(n)
        words, doc = np.concatenate(words), np.concatenate(docs_)
        # Equal surroundings of several blocks are one row with the least document.
        order, number = deep_shallow_sort(words)
        heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        one, least = words[order[heads]], np.minimum.reduceat(doc[order], heads)
        lower = earlier_starts(one, least, size)
        of = np.empty(len(words), np.int64)
        of[order] = number
        raw = words.astype(">u8").view(np.uint8).reshape(len(words), -1)
        lo, hi = (raw[:, REACH + size + i].astype(np.uint64) for i in (0, 1))
        every = (np.uint64(2) << hi) - (np.uint64(1) << lo)
        masks = np.where(doc > least[of], every, lower[of])
        cuts = np.cumsum(counts)[:-1]
        data = [_compress(x.astype(np.uint32).tobytes()) for x in np.split(masks, cuts)]
        return pa.table({"block": group["block"], "bucket": group["bucket"], "data": pa.array(data, pa.binary())})

    def numbers(data: bytes, count: int) -> np.ndarray:
        return np.frombuffer(_expand(data), np.uint32) if count else np.zeros(0, np.uint32)

    def finish(group, answers):
        block = _Block(group, size)
        n = len(block.raw)
        covered = np.zeros(n, bool)
        if len(block.key):
            got = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True))
            every, _ = block.distinct()
            shared = every[bits(_expand(got[-1]), len(every))]
            at, of, words, key, least = block.runs(shared)
            masks = returned(answers, key, numbers).astype(np.uint64)[of]
            # Within the block, all but the least document of a surrounding lose every start of it.
            lo, hi = block.first[at] - block.pos[at] + REACH, block.last[at] - block.pos[at] + REACH
            every_start = (np.uint64(2) << hi.astype(np.uint64)) - (np.uint64(1) << lo.astype(np.uint64))
            masks = np.where(block.doc[at] > least[of], every_start, masks)
            change = np.zeros(n + 1, np.int32)
            for s in range(REACH + 1):
                hit = (masks >> np.uint64(s)) & np.uint64(1) == 1
                start = block.pos[at][hit] - REACH + s
                np.add.at(change, start, 1)
                np.add.at(change, start + size, -1)
            covered = np.cumsum(change[:-1], dtype=np.int32) > 0
        edge = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Spans end at the document's end even where the next document begins with one.
        spans, kept = [], []
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
            spans.append([{"start": max(int(x), a) - a, "end": min(int(y), b) - a} for x, y in zip(start[i:j], end[i:j], strict=True)])
            part = block.raw[a:b]
            kept.append(part[~covered[a:b]].tobytes() if spans[-1] else part.tobytes())
        return pa.table(
            {
                "doc_id": block.table["doc_id"],
                "n_bytes": pa.array(np.diff(block.offsets), pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    asked = rows.groupBy("block").applyInArrow(send_keys, sent)
    known = asked.groupBy("bucket").applyInArrow(answer_keys, sent)
    runs = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send_runs, sent)
    # Bit maps of blocks are no bucket's: each of them is a group of its own and comes back as it is.
    apart = runs.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("block")).alias("_own"))
    masks = apart.applyInArrow(answer_runs, sent)
    return rows.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(
        finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def suffix_dedup_report(docs: DataFrame) -> DataFrame:
    lengths = F.transform("spans", lambda x: x["end"] - x["start"])
    return repeated_spans(docs).select(
        "doc_id", "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
