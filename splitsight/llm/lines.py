"""Line deduplication over a whole corpus with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed
from .common import SPACE, fresh, partitions

MIN_CHARS = 20
MIN_DOCS = 3
SLICES = 64  # a very frequent line is ranged in so many slices of documents
HOT_SHARE = 10_000  # a line with more than one in so many of all rows is hot, so at most so many are
HOT_ROWS = 1_000  # fewer rows are never hot
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _UPPER.lower())


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of lines long enough to be dropped."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(split_lines(F.col("text"))).alias("pos", "line"),
    ).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return lines.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "text_hash", "pos",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), "key").alias("h2"),
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep): which lines of a document stay, as a sparse bitmap.

    `keep` maps a word number to 64 bits, one for each line; words that keep all their lines are left
    out, and so are documents that keep everything. Texts are split once: the hashes of their long lines (two
    of 64 bits) are written down, range-partitioned with a slice of the documents, sorted by document and
    position, and the first row of every document is streamed to a map-side combined count; so a line that
    stands in a third of all documents is neither sorted nor counted in one task. Nor are its rows joined in
    one: lines with more than a HOT_SHARE-th of all rows, of which there are HOT_SHARE at most, are broadcast.

    Only `doc_id` and `text` are read. Null or empty text is one empty line. A null doc_id counts as one
    document that comes before all others. Rows with the same doc_id count as one document.
    """
    spark = docs.sparkSession
    lines = checkpointed(_long_lines(docs, min_chars))
    ranged = (
        lines.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("slice"), "doc_id", "pos")
        .repartitionByRange(partitions(spark), "h1", "h2", "slice")
        .sortWithinPartitions("h1", "h2", "slice", "doc_id", "pos")
    )
    inside = Window.partitionBy("h1", "h2", "slice").orderBy("doc_id", "pos")
    streamed = ranged.select(
        "h1", "h2", "doc_id",
        ((F.row_number().over(inside) == 1) | ~F.lag("doc_id").over(inside).eqNullSafe(F.col("doc_id"))).alias("first"),
    )
    frequent = checkpointed(
        streamed.groupBy("h1", "h2")
        .agg(F.count_if("first").alias("n"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "last", "rows")
    )
    hot = F.col("rows") > max(HOT_ROWS, lines.count() // HOT_SHARE)  # so many rows have at most HOT_SHARE lines
    few = F.broadcast(frequent.filter(hot).select("h1", "h2", F.col("last").alias("hot_last")))
    dealt = lines.join(few, ["h1", "h2"], "left")
    gone = lambda last: F.col("doc_id").isNull() | (F.col("doc_id") < F.col(last))
    dropped = dealt.filter(F.col("hot_last").isNotNull() & gone("hot_last")).select(*lines.columns).unionByName(
        dealt.filter("hot_last is null").join(frequent.filter(~hot), ["h1", "h2"]).filter(gone("last")).select(*lines.columns)
    )
    words = dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep"),
    )


def drop_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = None
) -> DataFrame:
    """All columns of `docs` with the kept lines as `text`; `counts` names columns for the numbers of lines and
    of dropped lines, if they are wanted.

    A document whose text loses nothing keeps it as it is (null stays null). A document that loses all
    its lines has an empty text. Names of further columns do not matter.
    """
    other, mark, lost, keep = fresh(docs.columns, "id", "hash", "dropped", "keep")
    maps = keep_bitmaps(docs, min_chars, min_docs)
    maps = maps.select(
        F.col("doc_id").alias(other), F.col("text_hash").alias(mark), F.col("n_dropped").alias(lost), F.col("keep").alias(keep)
    )
    same = docs["doc_id"].cast("long").eqNullSafe(maps[other]) & (F.xxhash64(docs["text"]) == maps[mark])
    both = docs.join(maps, same, "left")
    lines = split_lines(docs["text"])

    def stays(_: Column, i: Column) -> Column:
        bits = F.try_element_at(maps[keep], F.floor(i / 64).cast("int"))
        return F.coalesce(F.getbit(bits, F.pmod(i, F.lit(64))), F.lit(1).cast("byte")) == 1

    kept = F.when(maps[keep].isNull(), docs["text"]).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    numbers = (F.size(lines).cast("long"), F.coalesce(maps[lost], F.lit(0)).cast("long"))
    return both.select(
        *[kept.alias(c) if c.lower() == "text" else docs[c] for c in docs.columns],
        *[n.alias(c) for n, c in zip(numbers, counts or (), strict=False)],
    )


def line_dedup_report(docs: DataFrame) -> DataFrame:
    kept = drop_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id < f.last AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
