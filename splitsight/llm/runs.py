"""Periodic runs of words within a text: found, reported and collapsed to their first period."""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import row_chunks, text_buffer

MIN_WORDS = 6
MIN_PERIODS = 4
CHUNK = 1 << 20  # bytes of text that are worked on together
PLANT, PLANT_PERIODS = 10, (3, 8)  # the query's planting: one text in PLANT gets a periodic end

_RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of every run, by row, start and period; row i is words[bounds[i]:bounds[i + 1]].

    A diagonal of lag q holds the words that equal the word q before. Its match length grows by one with every
    such word, and where it ends a run of period q ends with it. All earlier occurrences of a word would touch
    as many diagonals as its count squared; but a run has four periods, so for lags in (k/2, k] only diagonals
    on which the next k words match too can matter, and of the earlier occurrences of these k words only the
    nearest: within a run of smallest period q <= k it is q words back (a nearer one would give the run a
    smaller period), and it is never a multiple of the period. So each word touches one diagonal for each
    doubling of the lag, stretches of equal lag are its match length, and they are runs with their smallest
    period as they end. Words whose k words occur once in a text are left out of the next doubling, which makes
    the rounds after the first few small. Time n log n at most, whatever the counts; memory a few numbers a word.
    """
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(bounds[1:], counts)
    name = words.astype(np.int64)
    live = np.flatnonzero(counts[row] >= MIN_WORDS)
    found = [np.zeros((0, 4), np.int64)]
    k = 1
    while len(live):
        order = np.argsort(name[live], kind="stable")
        at, names = live[order], name[live][order]
        new = names[1:] != names[:-1]
        again = ~new & (row[at[1:]] == row[at[:-1]])
        here, before = at[1:][again], at[:-1][again]
        lag = here - before
        near = (lag > k // 2) & (lag <= k)
        here_near, lag = here[near], lag[near]
        order = np.argsort(here_near)
        here_near, lag = here_near[order], lag[order]
        if len(lag):
            cut = np.flatnonzero((np.diff(here_near) != 1) | (np.diff(lag) != 0))
            first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(lag) - 1]))
            period = lag[first]
            start = here_near[first] - period
            length = here_near[last] + k - start
            enough = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
            r = row[start[enough]]
            found.append(np.stack((r, start[enough] - bounds[r], length[enough], period[enough]), 1))
        # the next doubling: both halves of the 2k words are repeated in their text
        repeated = np.zeros(len(name), bool)
        repeated[here] = repeated[before] = True
        ranks = np.concatenate(([0], np.cumsum(new)))
        name[at] = ranks
        live = live[repeated[live] & (live + 2 * k <= stop[live]) & (counts[row[live]] >= MIN_PERIODS * (k + 1))]
        live = live[repeated[live + k]]
        name[live] = name[live] * (ranks[-1] + 1) + name[live + k]
        k *= 2
    every = np.concatenate(found)
    return tuple(every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))].T)


def _kept(n: int, start, length, period) -> np.ndarray:
    """Words that no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): the periodic runs of every text and its words without their repetitions.

    A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no
    neighbouring word extends; `runs` go by start, then period. `collapsed` joins by one space the words that
    no run holds behind its first q words. Words are what stands between the six ASCII spaces, compared byte
    by byte. Null and empty texts have no words. Each row is worked on by itself, with no shuffle: repeated
    ids stay rows of their own, and a null id stays null. Only doc_id and text are read.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            data = memoryview(raw)
            for lo, hi in row_chunks(offsets, CHUNK):
                texts = [bytes(data[a:b]).split() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
                numbers: dict[bytes, int] = {}
                words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(texts)), np.int64, bounds[-1])
                row, start, length, period = find_runs(words, bounds)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                collapsed = []
                for i, text in enumerate(texts):
                    a, b = ends[i], ends[i + 1]
                    if a < b:
                        keep = _kept(len(text), start[a:b], length[a:b], period[a:b])
                        text = [text[j] for j in np.flatnonzero(keep)]
                    collapsed.append(b" ".join(text))
                each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(collapsed, pa.binary())],
                    ["doc_id", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of which one in PLANT gets a periodic end.

    With h = crc32(decimal doc_id) and g = h div 10, a text of n > 0 words with h % 10 = 0 has word i >= a
    replaced by its word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). Other texts, and
    those without an id, stay as they are.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(*batch.columns, strict=True):
                h = crc32(str(doc.as_py()).encode()) if doc.is_valid else 1
                text = text.as_py()
                if h % PLANT == 0 and text and (words := text.split()):
                    g, n = h // PLANT, len(words)
                    a = g % n
                    p = 1 + (n - a) // (PLANT_PERIODS[0] + g % PLANT_PERIODS[1])
                    text = b" ".join(words[: a + p] + [words[a + (i - a) % p] for i in range(a + p, n)])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, text binary")


def runs_report(docs: DataFrame) -> DataFrame:
    found = periodic_runs(planted(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * -best.shorter div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
