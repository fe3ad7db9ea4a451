"""WARC archives: written by Spark's text sink, read back by verifying the chain of record boundaries."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.ordering import meet
from ..session import checkpointed, scratch_path
from .common import table

# Fixed values of the format.
MAGIC = "WARC/1."
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "<urn:page:{}>"

MIN_BYTES = 100  # shorter payloads are always written whole
DATE = "2024-01-01T00:00:00Z"
SALTS = 64
FEW_SPANS = 10_000  # so many spans of records in several pieces may be broadcast; counted before they are

_RECORD = (
    "type string, record string, refers_to string, uri string, digest string, payload_bytes long, "
    "payload_digest string, payload binary"
)
_RECORD_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def _name(page_id: Column) -> Column:
    before, after = NAME.split("{}")
    return F.concat(F.lit(before), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(after))


def archive_records(pages: DataFrame, min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """(record): the text of one WARC record for each row of `pages`, without the blank lines behind it.

    The payload is the html as an HTTP response. Of rows with equal payloads of at least `min_bytes` bytes,
    that with the smallest page_id is the response and the others are revisits without a body that refer to
    it. Rows that share that smallest page_id are all responses, and so are rows of a group without any id;
    a row without an id revisits a group that has one. Null html is an empty payload, a null url an empty
    one. Only page_id, url and html are read. A payload that a third of all pages share is met in SALTS parts.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "+").alias("url"),
        body.alias("body"), F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("n"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt"),
    )
    # groups are counted by part first; a part of a group is one row from there on
    parts = rows.filter(F.col("n") >= min_bytes).groupBy("sha", "salt").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    groups = parts.groupBy("sha").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    shared = parts.select("sha", "salt").join(groups.filter("copies > 1 and first is not null"), "sha")
    met = rows.join(shared.select("sha", "salt", "first"), ["sha", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"),
        F.lit(BLANK),
    )
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    lines = [
        F.concat(F.lit(MAGIC + "1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("sha")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(BLANK), http, F.when(revisit, F.lit("")).otherwise(F.col("body").cast("string")))
    return met.select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """Write the records of `pages` as archives under `path`, one a partition.

    The text sink ends each value with the two blank lines that end a record, so its files are archives.
    """
    archive_records(pages, **options).write.option("lineSep", BLANK).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between one magic and the next, in the order of the file.

    Files are cut at the magic by the text source, so plain archives of any size are dealt out by block.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _fields(head: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip().decode("utf-8", "replace"))
    return out


def _record(fields: dict, content: bytes, payload: bool) -> tuple:
    """The columns of _RECORD. What follows the header of an HTTP message is the payload, else all is."""
    if fields.get(b"content-type", "").startswith("application/http"):
        content = content.partition(BLANK.encode())[2]
    whole = fields.get(b"warc-type") != "revisit"
    return (
        fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), fields.get(b"warc-target-uri"),
        fields.get(b"warc-payload-digest"), len(content) if whole else None, sha256(content).hexdigest() if whole else None,
        content if whole and payload else None,
    )


def _header(piece: bytes) -> tuple[dict, int, int] | None:
    """(fields, where the content starts, its length) if the piece after a magic starts like a record."""
    head, blank, _ = piece.partition(BLANK.encode())
    if not blank or not head[:1].isdigit() or head[1:3] != b"\r\n":
        return None
    fields = _fields(head)
    length = fields.get(b"content-length", "")
    return (fields, len(head) + len(blank), int(length)) if length.isascii() and length.isdigit() else None


def _candidates(pieces: DataFrame, payload: bool) -> DataFrame:
    """(file, block, at, next, whole, bytes, record): every place where a record might start, and its successor.

    Places count from the block's first piece. `whole` says that the record ends where the piece does; `record`
    is read only then. One row a block has no `at` and carries the bytes of the block.
    """
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["file", "block", "at", "next", "whole", "bytes", *_RECORD_NAMES]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *kinds]
    nothing = (None,) * len(_RECORD_NAMES)

    def read(batches):
        now, done, out, held = None, 0, [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for file, block, value in zip(*batch.columns, strict=True):
                where = (file.as_py(), block.as_py())
                if where != now:
                    if now is not None:
                        out.append((*now, None, None, None, done, *nothing))
                    now, done = where, 0
                piece = value.as_py()
                after = done + len(piece)
                # a block's first piece has its magic in the block before; a file's has none
                found = _header(piece) if done or where[1] else None
                if found:
                    fields, start, length = found
                    end = done + start + length + len(BLANK)
                    whole = end == after and piece.endswith(BLANK.encode())
                    record = _record(fields, piece[start : start + length], payload) if whole else nothing
                    held += len(record[-1] or b"")
                    out.append((*now, done - len(MAGIC), end, whole, None, *record))
                done = after + len(MAGIC)
                if len(out) >= 4096 or held > 16 << 20:
                    yield rows()
                    out, held = [], 0
        if now is not None:
            out.append((*now, None, None, None, done, *nothing))
            yield rows()

    return pieces.mapInArrow(read, f"file string, block long, at long, next long, whole boolean, bytes long, {_RECORD}")


def _jump(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Index of each record's successor within the block; its own index where the chain leaves the block."""
    k = np.searchsorted(at, following)
    inside = (k < len(at)) & (at[np.minimum(k, len(at) - 1)] == following)
    return np.where(inside, k, np.arange(len(at)))


def _exits(group):
    """Adds `leaves`: where the chain that starts at each place leaves its block, by pointer jumping."""
    import pyarrow as pa

    group = group.sort_by("at")
    at, following = (group.column(c).to_numpy() for c in ("at", "next"))
    jump = _jump(at, following)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return group.select(["file", "at"]).append_column("leaves", pa.array(following[jump], pa.int64()))


def _reached(group):
    """The places that the chain of the block's entry passes, by pointer jumping from there."""
    group = group.sort_by("at")
    at, following = (group.column(c).to_numpy() for c in ("at", "next"))
    seen, jump = group.column("entry").to_numpy(zero_copy_only=False).astype(bool), _jump(at, following)
    while True:
        seen[jump[seen]] = True
        if np.array_equal(further := jump[jump], jump):
            break
        jump = further
    return group.select(["file", "block", "at", "next"]).filter(seen)


def _entries(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(file, at): where the true chain of each file enters each of its blocks.

    Only files of several blocks need it: the chain leaves a block at one place, and these jumps from block
    to block are doubled until every file's chain is known, so rounds grow with the logarithm of the blocks.
    """
    first = ends.select("file", F.lit(0).cast("long").alias("at")).distinct()
    blocks = ends.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if blocks <= 1:
        return first
    jumps = checkpointed(found.select("file", "block", "at", "next").groupBy("file", "block").applyInArrow(
        _exits, "file string, at long, leaves long"
    ))
    known, reach = checkpointed(first), 1
    while reach < blocks:
        step = known.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        known = checkpointed(known.union(step).distinct())
        onward = jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("beyond"))
        jumps = checkpointed(jumps.join(onward, ["file", "leaves"]).select("file", "at", F.col("beyond").alias("leaves")))
        reach *= 2
    return known


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(file, at, next, type, record, refers_to, uri, digest, payload_bytes, payload_digest, payload).

    Every task names the places where a record might start (a magic and a header with a length) and where
    its successor would be. From the start of each file, pointer jumping keeps the places that the chain
    reaches; a magic inside a payload is no link of it, not even if a whole record stands there. Payloads that
    hold a magic are put together from their pieces. Revisits have no payload. With `payload` false the
    bytes stay where they are read; length and digest of the payload are there in both cases.

    A chain that does not end with its file stops the job and names the file: a cut or damaged archive is
    not read in part. Files without records give no rows. Memory: one piece (a record, mostly) and, by block,
    three numbers for each place.
    """
    kept = checkpointed(_candidates(_pieces(spark, path), payload))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = checkpointed(kept.filter("at is null").select(
        "file", "block", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("long")).alias("base")
    ))
    found = kept.filter("at is not null").drop("bytes").join(ends.select("file", "block", "base"), ["file", "block"])
    found = found.withColumn("at", F.col("at") + F.col("base")).withColumn("next", F.col("next") + F.col("base")).drop("base")
    entries = _entries(found, ends).withColumn("entry", F.lit(True))
    entered = found.select("file", "block", "at", "next").join(entries, ["file", "at"], "left")
    chain = checkpointed(
        entered.withColumn("entry", F.coalesce("entry", F.lit(False))).groupBy("file", "block").applyInArrow(
            _reached, "file string, block long, at long, next long"
        )
    )
    # the last piece of a file has no magic behind it
    size = ends.groupBy("file").agg((F.sum("bytes") - len(MAGIC)).alias("size"))
    got = chain.groupBy("file").agg(F.max("next").alias("last"))
    broken = size.join(got, "file", "left").filter((F.col("size") > 0) & ~F.col("last").eqNullSafe(F.col("size"))).limit(3).collect()
    if broken:
        raise ValueError(f"no chain of records to the end of {[r.file for r in broken]}")
    links = chain.select("file", "at")
    whole = found.filter("whole").join(links, ["file", "at"]).select("file", "at", "next", *_RECORD_NAMES)
    parted = found.filter("not whole").select("file", "at", "next").join(links, ["file", "at"])
    return whole.unionByName(_joined(spark, path, parted, ends, payload))


def _joined(spark: SparkSession, path: str, parted: DataFrame, ends: DataFrame, payload: bool) -> DataFrame:
    """The records in several pieces (their payload holds a magic), from a second reading of the archives."""
    import pyarrow as pa

    out = f"file string, at long, next long, {_RECORD}"
    parted = checkpointed(parted)
    wanted = parted.join(ends, "file").filter(
        (F.col("at") < F.col("base") + F.col("bytes")) & (F.col("next") > F.col("base"))
    ).select("file", "block", "base", "at", "next")
    few = wanted.limit(FEW_SPANS + 1).count()
    if not few:
        return spark.createDataFrame([], out)

    def placed(batches):
        now, done = None, 0
        for batch in batches:
            starts = []
            for file, block, n in zip(batch.column(0), batch.column(1), (len(x.as_buffer()) for x in batch.column(2)), strict=True):
                where = (file.as_py(), block.as_py())
                now, done = where, (done if where == now else 0)
                starts.append(done)
                done += n + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], ["file", "block", "value", "start"])

    pieces = _pieces(spark, path).mapInArrow(placed, "file string, block long, value binary, start long")
    spans = F.broadcast(wanted) if few <= FEW_SPANS else wanted
    inside = pieces.join(spans, ["file", "block"]).withColumn("start", F.col("start") + F.col("base")).filter(
        (F.col("start") > F.col("at")) & (F.col("start") < F.col("next"))
    )
    rows = inside.groupBy("file", "at", "next").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))

    def join(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                file, at, end, parts = (c[i].as_py() for c in batch.columns)
                piece = MAGIC.encode().join(p["value"] for p in parts)
                fields, start, length = _header(piece)
                record = _record(fields, piece[start : start + length], payload)
                columns = [pa.array([v], k) for v, k in zip((file, at, end, *record), [pa.string(), pa.int64(), pa.int64(), *kinds], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "at", "next", *_RECORD_NAMES])

    return rows.select("file", "at", "next", "parts").mapInArrow(join, out)


def resolved(records: DataFrame) -> DataFrame:
    """Records with (page_id, refers_id); length and digest of a revisit's payload are those of the response
    it refers to, found by name and digest. A revisit of what is not there keeps nulls."""
    before, after = (len(x) for x in NAME.split("{}"))
    number = lambda c: F.expr(f"try_cast(substring({c}, {before + 1}, length({c}) - {before + after}) as long)")
    rows = records.drop("payload").withColumns({"page_id": number("record"), "refers_id": number("refers_to")})
    rows = checkpointed(rows)
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    held = rows.filter("type = 'response'").groupBy(F.col("record").alias("refers_to"), digest.alias("digest")).agg(
        F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")
    )
    revisits = rows.filter("type = 'revisit'").drop("payload_bytes", "payload_digest")
    return rows.filter("type <> 'revisit'").unionByName(meet(revisits, held, ["refers_to", "digest"], ["record", "at"], SALTS))


def warc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back: one row a page as the archives have it."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = resolved(read_archives(spark, path, payload=False))
    return rows.select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_id").alias("refers_to")
    )


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
