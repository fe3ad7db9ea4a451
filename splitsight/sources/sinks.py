"""Writers for manifests, logs, sweeps and summaries. Every one writes from the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.expressions import fixed, hash32
from ..functions.ordering import beside

DECIMALS = 6  # of a number in a row's digest; no table is stored with more


def row_digest(rows: DataFrame) -> list[Column]:
    """(n, digest) as aggregates: the number of rows and the sum of their hashes, whatever their order.

    A row's hash is that of its values as text: numbers with DECIMALS decimals, maps and arrays as JSON, a
    null as a blank, since that is how it is written.
    """
    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(c.isNotNull(), fixed(c, DECIMALS))
        elif kind.startswith(("map", "array", "struct")):
            c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit(""))

    hashed = hash32(F.lit("row"), *[text(*c) for c in rows.dtypes])
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).cast("bigint").alias("digest")]


def read_back(rows: DataFrame, write: Callable[[DataFrame], None], read: Callable[[], DataFrame]) -> DataFrame:
    """(n, digest, same): write `rows`, read them again, and say whether both have the same digest.

    The digest of what is written is taken by the job that writes it, so the rows are computed once.
    """
    seen = Observation()
    write(rows.observe(seen, *row_digest(rows)))
    got = read().select(*rows.columns)
    same = (F.col("n") == F.lit(seen.get["n"])) & (F.col("digest") == F.lit(seen.get["digest"]))
    return got.agg(*row_digest(got)).withColumn("same", same)


def write_manifest(items: DataFrame, path: str) -> None:
    """One manifest folder, partitioned by role so that a role is read alone."""
    rows = items.select("role", "category", "path", F.col("role").alias("part"))
    rows.write.mode("overwrite").partitionBy("part").csv(path, header=True)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header and blanks for nulls: logs, sweeps and per-image rollups."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_f1_curve(curve: DataFrame, path: str) -> None:
    """(confidence, f1) with four and six decimals."""
    rows = curve.select(
        F.format_string("%.4f", "confidence").alias("confidence"), F.format_string("%.6f", "f1").alias("f1")
    )
    rows.write.mode("overwrite").csv(path, header=True)


def write_summary(summary: DataFrame, path: str) -> None:
    """Summaries as JSON, one object per row."""
    summary.write.mode("overwrite").json(path)


def split_summary(items: DataFrame, seed: int) -> DataFrame:
    """One row: seed, item count per role, and the categories seen."""
    counts = items.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    cats = items.select("category").distinct()
    counted = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("counts"))
    seen = cats.agg(F.array_sort(F.collect_list("category")).alias("categories"))
    return beside(counted, seen).select(F.lit(seed).alias("seed"), "counts", "categories")
