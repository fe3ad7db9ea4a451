"""Build the role manifest from a positive and a negative collection, then audit it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import audit as U, dedup as Q, draws as D
from ..session import checkpointed


def build_roles(
    curated: DataFrame, positives: DataFrame, negatives: DataFrame, n_test: int,
    draws: list[tuple[str, int]], seed: int = 0,
) -> DataFrame:
    """(role, category, path, ord, hash): the pool, both test roles and the drawn roles.

    Inputs: (path, name, category, ord, hash). Positives that share a curated name are withheld;
    the positive test set is drawn in proportion and then loses repeats, so it may end smaller
    than asked. Curated rows near a test row or an earlier curated row are dropped. The negative
    collection is cut into the named draws and the negative test set, which also loses repeats.
    """
    open_pos = D.exclude_by_name(positives, curated, "name")
    drawn = checkpointed(D.stratified_take(open_pos, n_test, "path", seed, "pos_test"))
    pos_test = checkpointed(Q.drop_repeats(drawn.select("path", "category", "ord", "hash"), []))
    outcome = Q.drop_across(curated.select("ord", "hash"), pos_test.select("ord", "hash"))
    pool = curated.join(outcome.filter("outcome = 'kept'").select("ord"), "ord", "left_semi")
    parts = checkpointed(D.chained_draws(negatives, draws, "neg_test", "path", seed, "negatives"))
    neg_test = Q.drop_repeats(parts.filter("role = 'neg_test'").select("path", "category", "ord", "hash"), [])
    cols = ["role", "category", "path", "ord", "hash"]
    tag = lambda df, role: df.withColumn("role", F.lit(role)).select(*cols)
    return (
        tag(pool, "pool").unionByName(tag(pos_test, "pos_test"))
        .unionByName(parts.filter("role <> 'neg_test'").select(*cols))
        .unionByName(tag(neg_test, "neg_test"))
    )


def audit_roles(items: DataFrame, hashes: DataFrame, roles: list[str], train: list[str], **optional) -> dict[str, DataFrame]:
    """The audit report and its verdict over a written manifest."""
    report = checkpointed(U.audit_report(items, hashes, roles, train, **optional))
    return {"report": report, "verdict": U.audit_verdict(report)}
