"""Role overlap, lineage, reconciliation and the audit report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import normalised_path
from ..functions.ordering import beside
from ..session import checkpointed
from .dedup import content_hash, near_duplicate_table


# ------------------------------------------------------------------ overlap
def role_masks(items: DataFrame, key: Column, roles: list[str]) -> DataFrame:
    """(mask, n): how many distinct keys occur in exactly each set of roles.

    Each key becomes a bit mask of its roles, so keys are never joined with one another and a
    key that fills a third of the table is combined before the shuffle.
    """
    bit = F.lit(0)
    for i, r in enumerate(roles):
        bit = F.when(F.col("role") == r, F.lit(1 << i)).otherwise(bit)
    return (
        items.groupBy(key.alias("_key")).agg(F.bit_or(bit).alias("mask"))
        .groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    )


def pair_overlap(masks: DataFrame, roles: list[str]) -> DataFrame:
    """(role_a, role_b, n_shared) for every pair of roles, pairs that share nothing included."""
    grid = F.array(
        *[
            F.struct(
                F.lit(a).alias("role_a"), F.lit(b).alias("role_b"),
                F.lit((1 << i) | (1 << (i + 1 + j))).alias("both"),
            )
            for i, a in enumerate(roles)
            for j, b in enumerate(roles[i + 1:])
        ]
    )
    return (
        masks.withColumn("p", F.explode(grid))
        .groupBy("p.role_a", "p.role_b")
        .agg(
            F.sum(
                F.when(F.col("mask").bitwiseAND(F.col("p.both")) == F.col("p.both"), F.col("n"))
                .otherwise(0)
            ).alias("n_shared")
        )
    )


def content_overlap(items: DataFrame, roles: list[str]) -> DataFrame:
    return pair_overlap(role_masks(items, content_hash("content"), roles), roles)


def path_overlap(items: DataFrame, roles: list[str]) -> DataFrame:
    return pair_overlap(role_masks(items, normalised_path("path"), roles), roles)


def union_overlap(masks: DataFrame, roles: list[str], train: list[str]) -> DataFrame:
    """One row: distinct keys in any training role, in any other role, and in both."""
    train_bits = sum(1 << i for i, r in enumerate(roles) if r in train)
    test_bits = sum(1 << i for i, r in enumerate(roles) if r not in train)
    inside = lambda bits: F.col("mask").bitwiseAND(F.lit(bits)) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("bigint"))
    return masks.agg(
        total(inside(train_bits)).alias("n_train"),
        total(inside(test_bits)).alias("n_test"),
        total(inside(train_bits) & inside(test_bits)).alias("n_shared"),
    )


def role_sizes(items: DataFrame, train: list[str]) -> DataFrame:
    """(role, category, kind, n)."""
    kind = F.when(F.col("role").isin(train), "train").otherwise("eval")
    return items.groupBy("role", "category", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ lineage and copies
def consumed_paths(log: DataFrame, items: DataFrame, train: list[str]) -> DataFrame:
    """(path, authorised, leaked) of every distinct path the log consumed."""
    known = items.groupBy(normalised_path("path").alias("path")).agg(
        F.max(F.col("role").isin(train)).alias("_train"),
        F.max(~F.col("role").isin(train)).alias("_test"),
    )
    used = log.select(normalised_path("source_path").alias("path")).distinct()
    return used.join(known, "path", "left").select(
        "path", F.coalesce("_train", F.lit(False)).alias("authorised"),
        F.coalesce("_test", F.lit(False)).alias("leaked"),
    )


def lineage_counts(consumed: DataFrame) -> DataFrame:
    return consumed.agg(
        F.count(F.lit(1)).alias("n_consumed"),
        F.count(F.when(~F.col("authorised"), 1)).alias("n_unauthorised"),
        F.count(F.when(F.col("leaked"), 1)).alias("n_leaked"),
    )


def leaked_examples(consumed: DataFrame, k: int = 5) -> DataFrame:
    """First k leaked paths in path order."""
    return consumed.filter("leaked").select("path").orderBy("path").limit(k)


def reconcile_copies(copies: DataFrame, items: DataFrame, role: str) -> DataFrame:
    """One row: copies on disk, rows in the manifest, whether they agree, and contents that both
    sides (train and val) of the copies hold. copies: (side, content)."""
    listed = items.filter(F.col("role") == role).agg(
        F.countDistinct(normalised_path("path")).alias("n_manifest")
    )
    per = copies.groupBy(content_hash("content").alias("_h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("side") == "train").alias("t"), F.max(F.col("side") == "val").alias("v"),
    )
    disk = per.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_disk"),
        F.count(F.when(F.col("t") & F.col("v"), 1)).alias("n_shared"),
    )
    return beside(disk, listed).select(
        "n_disk", "n_manifest", (F.col("n_disk") == F.col("n_manifest")).alias("counts_match"), "n_shared"
    )


# ------------------------------------------------------------------ report
def _each(one: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(a, n): a row for each named count of a table of one row."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), n.alias("n")) for a, n in counts.items()])).alias("c")).select("c.*")


def _rows(df: DataFrame, check: str | Column, a, b, n) -> DataFrame:
    n = F.col(n) if isinstance(n, str) else n
    text = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(
        (F.lit(check) if isinstance(check, str) else check).alias("check"), text(a).alias("a"), text(b).alias("b"), n.cast("bigint").alias("n"),
        F.when(n == 0, "ok").otherwise("FAIL").alias("status"),
    )


def audit_report(
    items: DataFrame, hashes: DataFrame, roles: list[str], train: list[str],
    log: DataFrame | None = None, copies: DataFrame | None = None, copy_role: str = "bg",
) -> DataFrame:
    """(check, a, b, n, status) of every check. A missing log or copy folder is skipped, not passed.

    What two checks need is made once: tables of a few rows, and one row for each role and content.
    """
    blank = F.lit("")
    paths = checkpointed(role_masks(items, normalised_path("path"), roles))
    near = near_duplicate_table(hashes, roles)
    within_role = F.col("role_a") == F.col("role_b")
    spark = items.sparkSession
    skipped = lambda check: spark.createDataFrame(
        [(check, "", "", None, "skipped")], "check string, a string, b string, n bigint, status string"
    )
    contents = checkpointed(items.groupBy("role", content_hash("content").alias("_h")).agg(
        (F.min("path") < F.max("path")).alias("_more")  # under two paths or more
    ))
    within = contents.groupBy("role").agg(F.count(F.when(F.col("_more"), 1)).alias("n"))
    by_pair = pair_overlap(role_masks(contents, F.col("_h"), roles), roles)
    parts = [
        _rows(pair_overlap(paths, roles), "1 paths by pair", "role_a", "role_b", "n_shared"),
        _rows(union_overlap(paths, roles, train), "2 train and eval unions", blank, blank, "n_shared"),
    ]
    if log is None:
        parts.append(skipped("3 lineage"))
    else:
        counts = lineage_counts(consumed_paths(log, items, train))
        parts.append(_rows(
            _each(counts, {"unauthorised": F.col("n_unauthorised"), "leaked": F.col("n_leaked")}), "3 lineage", "a", blank, "n"
        ))
    if copies is None:
        parts.append(skipped("4 copies"))
    else:
        copied = reconcile_copies(copies, items, copy_role)
        difference = F.abs(F.col("n_disk") - F.col("n_manifest"))
        parts.append(_rows(
            _each(copied, {"count difference": difference, "train and val": F.col("n_shared")}), "4 copies", "a", blank, "n"
        ))
    parts += [
        _rows(within, "5 content within", "role", blank, "n"),
        _rows(by_pair, "5 content by pair", "role_a", "role_b", "n_shared"),
        _rows(
            near, F.when(within_role, "6 near copies within").otherwise("6 near copies by pair"), "role_a",
            F.when(within_role, "").otherwise(F.col("role_b")), "n_pairs",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_verdict(report: DataFrame) -> DataFrame:
    """One row: failed, passed and skipped checks, and the overall verdict."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return report.agg(
        n("FAIL").alias("n_failed"), n("ok").alias("n_passed"), n("skipped").alias("n_skipped"),
    ).withColumn("verdict", F.when(F.col("n_failed") > 0, "FAILED").otherwise("PASSED"))
