"""Bootstrap and split-conformal repeats by counts at score levels.

A resample of photographs matters only through how many of them it has at each stored score. These
counts have known laws (multinomial with replacement, multivariate hypergeometric for a half), so they
are drawn directly: one draw for each level and repetition instead of one for each photograph, and no
photograph is moved. `resample` has the same estimates from draws that any engine can replay row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from . import resample
from .stats import AREA_LIMIT
from .thresholds import BUDGETS, score_levels

BLOCK = 50  # repetitions that share a generator
CELLS = 1 << 21  # counts held at once
HEAD = 2.0  # levels are drawn one by one down to this multiple of the false alarms in question, then as one rest
MOST_HALVED = 10**9 - 1  # photographs of a role that the hypergeometric generator takes


def level_arrays(images: DataFrame) -> DataFrame:
    """(arm, scores, pos, neg): the levels of each arm from the highest score down, the never-fired one last.

    Scores are stored in six decimals, so an arm has at most 1,000,002 levels however many photographs.
    """
    level = F.struct((-F.col("score")).alias("down"), "pos", "neg")
    arms = score_levels(images).groupBy("arm").agg(
        F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), level))).alias("fired"),
        F.coalesce(F.sum(F.when(F.col("score").isNull(), F.col("pos"))), F.lit(0)).alias("pos0"),
        F.coalesce(F.sum(F.when(F.col("score").isNull(), F.col("neg"))), F.lit(0)).alias("neg0"),
    )
    last = lambda c: F.array(F.col(c).cast("bigint"))
    return arms.select(
        "arm", F.concat(F.transform("fired", lambda x: -x["down"]), F.array(F.lit(None).cast("double"))).alias("scores"),
        F.concat("fired.pos", last("pos0")).alias("pos"), F.concat("fired.neg", last("neg0")).alias("neg"),
    )


def _by_block(
    levels: DataFrame, reps: int, seed: int, schema: str, kernel: Callable[..., Iterator[pd.DataFrame]]
) -> DataFrame:
    """Run `kernel(pos, neg, scores, reps of the block, generator)` for every arm and block of repetitions.

    A generator is seeded with (seed, arm, block), so a lost task draws the same counts again.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-reps // BLOCK) - 1))))
    dealt = spread(levels.withColumn("block", blocks), "arm", "block") if reps > 0 else levels.limit(0).withColumn("block", F.lit(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for arm, scores, pos, neg, block in batch[["arm", "scores", "pos", "neg", "block"]].itertuples(index=False):
                rng = np.random.default_rng([seed, crc32(str(arm).encode()), block])
                todo = np.arange(block * BLOCK, min(reps, (block + 1) * BLOCK))
                step = max(1, CELLS // max(1, len(pos)))
                for first in range(0, len(todo), step):
                    out = kernel(np.asarray(pos, np.int64), np.asarray(neg, np.int64), np.asarray(scores, float), todo[first : first + step], rng)
                    out.insert(0, "arm", arm)
                    yield out

    return dealt.mapInPandas(run, schema)


def _multinomial(rng, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of draws with replacement from the levels, row i of n[i] draws."""
    total = counts.sum()
    if total == 0:
        return np.zeros((len(n), len(counts)), np.int64)
    return rng.multinomial(n, counts / total)


def _halves(rng, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of draws without replacement from the levels, row i of n[i] draws."""
    if len(n) and (n == n[0]).all():
        return rng.multivariate_hypergeometric(counts, int(n[0]), len(n), method="marginals")
    return np.array([rng.multivariate_hypergeometric(counts, int(k), method="marginals") for k in n]).reshape(len(n), len(counts))


def _drawn(draw, rng, n: int, rows: int, counts: np.ndarray, head: int) -> tuple[np.ndarray, Callable]:
    """(counts of the first `head` levels, a function that draws the rest of given rows).

    The rest is drawn as one level first; split later, given its size, it has the law of one draw of all.
    """
    lumped = np.append(counts[:head], counts[head:].sum())
    got = draw(rng, np.full(rows, n, np.int64), lumped)
    return got[:, :head], lambda which: draw(rng, got[which, head], counts[head:])


def _head(neg: np.ndarray, alarms: float) -> int:
    """Levels down to HEAD times `alarms` false alarms and five standard deviations more."""
    enough = HEAD * alarms + 5 * np.sqrt(max(1.0, alarms))
    return min(len(neg) - 1, int(np.searchsorted(np.cumsum(neg[:-1]), enough)) + 1)


def resampled_areas(pos: np.ndarray, neg: np.ndarray, reps: int, rng, limit: float) -> np.ndarray:
    """Partial area of `reps` resamples of each role at its own size; the last level never fired."""
    n_pos, n_neg = pos.sum(), neg.sum()
    head = _head(neg, limit * n_neg)
    p, p_rest = _drawn(_multinomial, rng, n_pos, reps, pos, head)
    n, n_rest = _drawn(_multinomial, rng, n_neg, reps, neg, head)
    alarms = n.sum(axis=1)
    out = np.zeros(reps)
    short = alarms <= limit * n_neg  # the curve goes on below the head
    for which in (np.flatnonzero(~short), np.flatnonzero(short)):
        if not len(which):
            continue
        hits, false = p[which], n[which]
        if short[which[0]]:
            hits = np.concatenate((hits, p_rest(which)[:, :-1]), axis=1)
            false = np.concatenate((false, n_rest(which)[:, :-1]), axis=1)
        det, fa = (np.cumsum(x, axis=1) / max(1, total) for x, total in ((hits, n_pos), (false, n_neg)))
        before = [np.concatenate((np.zeros((len(which), 1)), x[:, :-1]), axis=1) for x in (fa, det)]
        kept = fa <= limit
        body = ((fa - before[0]) * (det + before[1]) / 2 * kept).sum(axis=1)
        some = kept.any(axis=1)
        out[which] = (body + np.where(some, (limit - (fa * kept).max(axis=1, initial=0)) * (det * kept).max(axis=1, initial=0), 0.0)) / limit
    return out


def area_bootstrap(images: DataFrame, reps: int = 2000, limit: float = AREA_LIMIT, seed: int = 0) -> DataFrame:
    """(arm, reps, low, high): 95 % percentile interval of the partial area; roles keep their sizes.

    images: (arm, image_id, role, category, max_conf). Work is levels times repetitions.
    """

    def kernel(pos, neg, scores, todo, rng):
        return pd.DataFrame({"rep": todo, "area": resampled_areas(pos, neg, len(todo), rng, limit)})

    areas = _by_block(level_arrays(images), reps, seed, "arm string, rep bigint, area double", kernel)
    return areas.groupBy("arm").agg(
        F.count(F.lit(1)).alias("reps"),
        F.percentile("area", F.lit(0.025)).alias("low"),
        F.percentile("area", F.lit(0.975)).alias("high"),
    )


def halved_rates(pos: np.ndarray, neg: np.ndarray, reps: int, rng, targets: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(detection, held-out false alarms), repetitions by targets, of the split-conformal rule.

    Half of the negatives calibrate (n div 2): floor(target * (n + 1)) - 1 of their scores may lie above an
    alert, the next largest is the cut and an alert must exceed it; a negative allowance means no alert.
    """
    n_pos, n_neg = pos.sum(), neg.sum()
    half = int(n_neg // 2)
    held = n_neg - half
    allowed = [int(np.floor(t * (half + 1))) - 1 for t in targets]
    head = _head(neg, 2.0 * max([0, *allowed]) + 1)
    cal, rest = _drawn(_halves, rng, half, reps, neg, head)
    hits = np.concatenate(([0], np.cumsum(pos)))
    det, fa = np.zeros((reps, len(targets))), np.zeros((reps, len(targets)))
    short = cal.sum(axis=1) <= max([0, *allowed])
    for which in (np.flatnonzero(~short), np.flatnonzero(short)):
        if not len(which):
            continue
        got, every = cal[which], neg[:head]
        if short[which[0]]:
            got, every = np.concatenate((got, rest(which)), axis=1), neg
        upto = np.cumsum(got, axis=1)
        over = np.cumsum(every - got, axis=1) - (every - got)  # held-out ones above each level
        for k, m in enumerate(allowed):
            if m < 0 or half == 0:
                continue
            cut = (upto <= m).sum(axis=1)  # the level of the next largest score
            det[which, k] = hits[cut] / max(1, n_pos)
            fa[which, k] = over[np.arange(len(which)), cut] / max(1, held)
    return det, fa


def conformal_rates(images: DataFrame, reps: int = 1000, targets: list[float] = BUDGETS, seed: int = 0) -> DataFrame:
    """(arm, rep, target, det, fa) over repeated random halves of the negatives.

    images: (arm, image_id, role, category, max_conf). Every arm draws its own halves. Where an arm has more than
    MOST_HALVED negatives the generator gives up, and the halves are drawn photograph by photograph.
    """
    levels = level_arrays(images)
    most = levels.agg(F.max(F.aggregate("neg", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0]
    if (most or 0) > MOST_HALVED:
        return resample.conformal_rates(images, reps, targets)

    def kernel(pos, neg, scores, todo, rng):
        det, fa = halved_rates(pos, neg, len(todo), rng, targets)
        k = len(targets)
        return pd.DataFrame({"rep": np.repeat(todo, k), "target": np.tile(np.array(targets, float), len(todo)), "det": det.ravel(), "fa": fa.ravel()})

    return _by_block(levels, reps, seed, "arm string, rep bigint, target double, det double, fa double", kernel)
