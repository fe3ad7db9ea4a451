"""Prefix trie of all conversations, from vertical bitmaps of shards."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ordering import meet
from ..session import checkpointed
from .common import mix64, partitions, table

SHARD_CONVS = 2048  # bits of a bitmap
SHARD_TURNS = 1 << 16
NO_ENDS = sha256(b"").hexdigest()
BASE, HEAD = 100, 6  # the query's rebuilding: bases are multiples of BASE, heads shorter than HEAD

_LOCAL = "a long, b long, up_a long, up_b long, depth long, n long, least long, chars long, ends array<long>"
_NODE = "a long, b long, up_a long, up_b long, depth long, n_convs long, conv_id long, chars long, n_ends long, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars): turns in order as 128-bit hashes of role and text, from 1, with a row at
    pos 0 and null hashes for each conversation.

    Turns go by `turn`, null first; equal ones by role, then text. Null role and null text are empty. Rows
    without conv_id belong to no conversation. Further columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text("role").alias("role"), text("text").alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = checkpointed(rows.select(
        "conv_id", F.row_number().over(order).cast("long").alias("pos"),
        F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "role", "text").alias("b"),
        F.char_length("text").cast("long").alias("chars"),
    ))
    return turns.unionByName(_members(turns.filter("pos = 1")))


def _members(rows: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("long")
    return rows.select("conv_id", F.lit(0).cast("long").alias("pos"), nothing.alias("a"), nothing.alias("b"), nothing.alias("chars"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Numbered turns with the head of every conversation c taken from conversation c - c % BASE.

    The head has h = crc32(decimal c) % HEAD turns (all of the base's if it has fewer, none without a base);
    the conversation's own turns follow from its turn h + 1 on.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD
    convs = turns.filter("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), h.alias("h"))
    # a base lends at most HEAD - 1 rows to each of at most BASE conversations
    heads = turns.filter((F.col("pos") > 0) & (F.col("pos") < HEAD) & (F.col("conv_id") % BASE == 0))
    lent = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").filter(F.col("pos") <= F.col("h"))
    own = turns.filter(F.col("pos") > h).withColumn("pos", F.col("pos") + HEAD)
    return lent.select(*turns.columns).unionByName(own).unionByName(turns.filter("pos = 0"))


def _bits(x: int) -> list[int]:
    """Positions of the set bits, lowest first."""
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


class _Shard:
    """Consecutive conversations (ascending ids) or the stretch of one that is too long for a shard.

    Vertical: for each (position, turn) the set of the conversations that have it, as the bits of an integer.
    A conversation may come in at a depth (its earlier turns were in the shard before) and may go on in the
    next shard; `carry` is (depth, a, b) of its prefix so far.
    """

    def __init__(self, ids, counts, a, b, chars, carry, goes_on):
        self.ids = ids
        self.chars = chars
        self.top = carry
        self.goes_on = len(ids) - 1 if goes_on else -1
        self.first = np.concatenate(([0], np.cumsum(counts)))
        depth = np.arange(len(a)) - np.repeat(self.first[:-1], counts)
        if carry:
            depth[: counts[0]] += carry[0]
        self.turn = list(zip(a.tolist(), b.tolist(), strict=True))
        # a prefix is the xor of the hashes of its (position, turn) pairs
        self.prefix = []
        for half, start in ((a, 1), (b, 2)):
            each = mix64(half.view(np.uint64) ^ mix64(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)))
            run = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(each))) if len(each) else np.zeros(1, np.uint64)
            seed = np.repeat(run[self.first[:-1]], counts + 1)
            at = np.concatenate([np.arange(s, e + 1) for s, e in zip(self.first[:-1], self.first[1:], strict=True)])
            keys = run[at] ^ seed  # one more than turns for each conversation: its prefixes of every length
            if carry:
                keys[: counts[0] + 1] ^= np.uint64(carry[start] & (2**64 - 1))
            self.prefix.append(keys.view(np.int64))
        self.place = self.first[:-1] + np.arange(len(ids))
        self.depths = counts + np.array([carry[0] if carry and i == 0 else 0 for i in range(len(ids))])

    def carried(self) -> tuple:
        last = len(self.ids) - 1
        at = self.place[last] + self.first[last + 1] - self.first[last]
        return int(self.depths[last]), int(self.prefix[0][at]), int(self.prefix[1][at])

    def _at(self, c: int) -> int:
        """Depth at which conversation c comes in."""
        return self.top[0] if self.top and c == 0 else 0

    def nodes(self):
        """(a, b, up_a, up_b, depth, n, least, chars, ends) of every node, depth first."""
        n = len(self.ids)
        postings: dict[tuple, int] = {}
        ended: dict[int, int] = {}
        for c in range(n):
            bit, at = 1 << c, self._at(c)
            for d, row in enumerate(range(self.first[c], self.first[c + 1]), at + 1):
                key = (d, *self.turn[row])
                postings[key] = postings.get(key, 0) | bit
            if c != self.goes_on:
                ended[int(self.depths[c])] = ended.get(int(self.depths[c]), 0) | bit
        every = (1 << n) - 1
        stack = [(0, every & ~1, True)] if self.top else [(0, every, True)]
        stack = [s for s in stack if s[1]]
        if self.top:
            stack.append((self.top[0], 1, False))  # its node was given by the shard before
        while stack:
            depth, members, given = stack.pop()
            c = (members & -members).bit_length() - 1
            if members.bit_count() == 1:
                yield from self._alone(c, depth, given)
                continue
            ends = members & ended.get(depth, 0)
            if given:
                yield self._row(c, depth, members.bit_count(), [self.ids[k] for k in _bits(ends)])
            rest = members & ~ends
            if self.goes_on >= 0 and depth == self.depths[self.goes_on]:
                rest &= ~(1 << self.goes_on)
            while rest:
                c = (rest & -rest).bit_length() - 1
                child = rest & postings[(depth + 1, *self.turn[self.first[c] + depth - self._at(c)])]
                stack.append((depth + 1, child, True))
                rest ^= child

    def _row(self, c: int, depth: int, n: int, ends: list) -> tuple:
        at = self.place[c] + depth - self._at(c)
        a, b = self.prefix
        if depth == 0:
            return int(a[at]), int(b[at]), None, None, 0, n, self.ids[c], 0, ends
        chars = self.chars[self.first[c] + depth - self._at(c) - 1]
        return int(a[at]), int(b[at]), int(a[at - 1]), int(b[at - 1]), depth, n, self.ids[c], int(chars), ends

    def _alone(self, c: int, depth: int, given: bool):
        """A conversation on its own path from here down."""
        last = int(self.depths[c])
        for d in range(depth if given else depth + 1, last + 1):
            yield self._row(c, d, 1, [self.ids[c]] if d == last and c != self.goes_on else [])


def _shards(convs: int, turns: int):
    import pyarrow as pa

    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
    names = [x.split()[0] for x in _LOCAL.split(", ")]

    def packed(shard: _Shard):
        out = []
        for row in shard.nodes():
            out.append(row)
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches):
        ids: list[int] = []
        counts: list[int] = []
        held: list[list] = [[], [], []]
        carry = None

        def shard(goes_on: bool) -> _Shard:
            return _Shard(ids, np.array(counts, np.int64), *(np.array(x, np.int64) for x in held), carry, goes_on)

        for batch in batches:
            for conv, a, b, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = a is None
                full = len(held[0]) >= turns or (new and len(ids) >= convs)
                if full and ids:
                    now = shard(goes_on=not new)
                    yield from packed(now)
                    carry = None if new else now.carried()
                    ids, counts, held = ([] if new else [conv]), ([] if new else [0]), [[], [], []]
                if new:
                    ids.append(conv)
                    counts.append(0)
                else:
                    for column, value in zip(held, (a, b, chars), strict=True):
                        column.append(value)
                    counts[-1] += 1
        if ids:
            yield from packed(shard(goes_on=False))

    return run


def _merged(batches):
    """One row for each node from the sorted rows of all shards: counts add up, end lists follow one another."""
    import pyarrow as pa

    names = [x.split()[0] for x in _NODE.split(", ")]
    kinds = [pa.int64()] * 9 + [pa.string()]
    now, state, out = None, None, []

    def close():
        out.append((*state[0][:2], *state[0][2:4], state[0][4], state[1], state[2], state[3], state[4], state[5].hexdigest() if state[4] else NO_ENDS))

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for a, b, up_a, up_b, depth, n, least, chars, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b, depth) != now:
                if state:
                    close()
                now, state = (a, b, depth), [(a, b, up_a, up_b, depth), 0, least, chars, 0, sha256()]
            state[1] += n
            if ends:
                said = ",".join(map(str, ends))
                state[5].update(("," + said if state[4] else said).encode())
                state[4] += len(ends)
            if len(out) >= 4096:
                yield rows()
                out = []
    if state:
        close()
    if out:
        yield rows()


def prefix_nodes(turns: DataFrame, shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(a, b, up_a, up_b, depth, n_convs, conv_id, chars, n_ends, ends_sha256) of every distinct prefix.

    `turns` as from `numbered`: ascending `pos` is the order, and the row with null hashes opens a
    conversation. Shards of consecutive ids index their turns by (position, turn) and walk depth first:
    a child is the parent's bitset cut with a posting, its size the popcount. Every shard gives one row a
    node; shards have disjoint, ascending ids, so sorted by smallest member their end lists follow one another
    and are digested as a stream. A conversation longer than a shard goes on in the next.
    """
    spark = turns.sparkSession
    n = partitions(spark)
    local = (
        turns.repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id", "pos")
        .select("conv_id", "a", "b", "chars").mapInArrow(_shards(shard_convs, shard_turns), _LOCAL)
    )
    return local.repartition(n, "a", "b", "depth").sortWithinPartitions("a", "b", "depth", "least").mapInArrow(_merged, _NODE)


def prefix_trie(turns: DataFrame, **options) -> DataFrame:
    """Every node of the prefix trie of `turns` (see `numbered`); no conversations, no rows.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Nodes of one
    conversation alone (the tails) need nothing from others but their parent's name. Sums over subtrees run
    over shared nodes only, by pointer jumping: each round doubles the distance that a node has gathered from,
    so rounds grow with the logarithm of the depth at which conversations still share a prefix.
    """
    nodes = checkpointed(prefix_nodes(turns, **options))
    shared = nodes.filter("n_convs > 1")
    parents = shared.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    below = checkpointed(meet(nodes.filter("depth > 0"), parents, ["up_a", "up_b"], ["a", "b"]))
    single = (F.col("n_convs") == 1).cast("long")
    children = below.filter("parent_conv_id is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum(single).alias("tails")
    )
    none = F.lit(0).cast("long")
    held = shared.join(children, ["a", "b"], "left").select(
        "a", "b", "up_a", "up_b", F.coalesce("n_children", none).alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1).cast("long")).otherwise(F.col("tails")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    held, deepest, reach = checkpointed(held), shared.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        under = held.filter("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        above = held.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("far_a"), F.col("up_b").alias("far_b"))
        held = checkpointed(
            meet(held, above, ["up_a", "up_b"], ["a", "b"]).join(under, ["a", "b"], "left").select(
                "a", "b", F.col("far_a").alias("up_a"), F.col("far_b").alias("up_b"), "n_children",
                (F.col("leaves") + F.coalesce("more_leaves", none)).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", none)).alias("saved"),
            )
        )
        reach *= 2
    root = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    named = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id")).unionByName(root)
    return named.join(held.select("a", "b", "n_children", "leaves", "saved"), ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.when(F.col("n_ends") > 0, none).otherwise(F.lit(1).cast("long"))).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", none).alias("saved_tokens"), "ends_sha256",
    )


def trie_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations as the query rebuilds them."""
    return prefix_trie(rebuilt(numbered(table(spark, sf_dir, "conversations"))))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, c: list_reduce(list_prepend(xor(acc, c), range(8)), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))) AS r
  FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(r, 4294967295::BIGINT) % 6 AS h FROM crc),
r AS (
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT c.conv_id, t.pos + 6, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM r),
m AS (
  SELECT conv_id, depth, length(text) AS chars,
         md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
p AS (
  SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (
  SELECT node, depth, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM p GROUP BY node, depth),
kids AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
under AS (SELECT DISTINCT x.node, y.node AS below FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
sums AS (
  SELECT u.node, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.chars) AS BIGINT) AS saved_tokens
  FROM under u JOIN f ON f.node = u.below GROUP BY u.node)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN sums USING (node) LEFT JOIN f g ON g.node = f.up
"""
