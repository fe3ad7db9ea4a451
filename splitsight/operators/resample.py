"""Bootstrap intervals and repeated split-conformal calibration with draws that can be replayed.

`counted` has the same estimates at a fraction of the work; here every photograph is dealt with, so that
another engine can follow draw by draw, and single splits name their photographs. Draws come from md5 of (stage, repetition, slot), so they replay in any engine. A resample is
built from rows, never from an index array: every photograph is one draw slot per repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.digests import in_blocks, of_numbers
from ..functions.expressions import hash60, keyed_hash, ratio
from ..functions.ordering import FEW_ROWS, cut_slots, hash_bucket, positions
from ..session import checkpointed, spread, spread_rows, task_parts
from .stats import AREA_LIMIT
from .thresholds import BUDGETS, NEG, POS, detection_at_budgets, stored

SCORE_BUCKETS = 128  # for each unit of score
REACH = 7.0  # standard deviations that a range reaches to either side of what it is to hold
BLOCK = 25  # repetitions whose draws a task counts together, at most
COLUMNS = 1 << 26  # photographs times repetitions that a task counts together, a byte each; one repetition at least
SLICE = 1 << 28  # photographs whose draws are counted at once; draws are hashed anew for every slice
CHUNK = 32_768  # scores of an arm that go in one row


def arm_scores(images: DataFrame, dealt: bool = True) -> DataFrame:
    """(image_id, role, scores): one row per photograph with the few arms' scores as an array.

    If not `dealt`, a rollup that lies by photographs is left as it lies.
    """
    return (spread(images, "image_id") if dealt else images).groupBy("image_id", "role").agg(
        F.collect_list(F.struct("arm", stored("max_conf").alias("score"))).alias("scores")
    )


def bootstrap_levels(images: DataFrame, reps: int) -> DataFrame:
    """Score levels of every (arm, rep): each role resampled with replacement at its own size."""
    keyed = arm_scores(images).withColumn("_key", keyed_hash(F.lit("boot"), "image_id"))
    placed = positions(
        keyed.withColumn("_bkt", hash_bucket(F.col("_key"))), ["role"], ["_key", "image_id"]
    )
    sizes = placed.groupBy("role").agg(F.count(F.lit(1)).alias("n_role"))
    every = F.sequence(F.lit(0), F.lit(reps - 1))
    draws = (
        spread(placed.select("role", "pos"), "pos")
        .join(F.broadcast(sizes), "role")  # one row per role
        .withColumn("rep", F.explode(every))
        .withColumn("pos", hash60(F.lit("draw"), "rep", "role", "pos") % F.col("n_role"))
    )
    # dealt once by photograph, for the count of its draws and for its scores
    drawn = spread(draws.select("rep", "role", "pos"), "role", "pos").groupBy("rep", "role", "pos").agg(
        F.count(F.lit(1)).alias("w")
    )
    pos, neg = F.col("role") == POS, F.col("role") == NEG
    return (
        drawn.join(placed.select("role", "pos", "scores"), ["role", "pos"])
        .select("rep", "role", "w", F.explode("scores").alias("s"))
        .groupBy(F.col("s.arm").alias("arm"), "rep", F.col("s.score").alias("score"))
        .agg(
            F.sum(F.when(pos, F.col("w")).otherwise(0)).alias("pos"),
            F.sum(F.when(neg, F.col("w")).otherwise(0)).alias("neg"),
        )
    )


def _tail(*parts) -> Column:
    """What follows the repetition in the text of a `keyed_hash`, which leaves nulls out."""
    text = [F.concat(F.lit("|"), p.cast("string")) for p in parts]
    return F.concat(*[F.coalesce(t, F.lit("")) for t in text]).cast("binary")


def _weights(todo: range, sizes: dict[str, int], first: int, last: int, kind=np.uint8) -> np.ndarray:
    """How often the photographs from place `first` to `last` are drawn in each of some repetitions.

    Roles lie one behind the other, in the order of `sizes`; all draws of all of them are made.
    """
    out = np.zeros((len(todo), last - first), kind)
    one = kind(1)
    for k, rep in enumerate(todo):
        begin, met = 0, 0
        for role, n in sizes.items():
            if begin < last and begin + n > first:
                for heads in of_numbers(b"draw|%d|%s|" % (rep, role.encode()), n):
                    place = ((heads >> np.uint64(4)) % np.uint64(n)).astype(np.int64) + (begin - first)
                    if begin < first or begin + n > last:
                        place = place[(place >= 0) & (place < last - first)]
                    np.add.at(out[k], place, one)
                    met += len(place)
            begin += n
        if out[k].sum(dtype=np.int64) != met:  # a count too large for a byte
            return _weights(todo, sizes, first, last, np.uint32)
    return out


PACKED = "slice int, arm int, kind int, part int, nth int, places binary, values binary, ends binary"
REPEATED, FIRST, SCORED = range(3)


def _pack(chunk: int):
    """Rows (slice, arm, kind, value, place), sorted by the first three and falling values, as a row for each `chunk`.

    What is packed is every place, and every value with the number of places up to its last one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, key, held, columns = TaskContext.get().partitionId(), 0, None, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal nth, held, columns
            value, place = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero(np.append(value[1:] != value[:-1], True))
            cols = [*key, part, nth, *(x.tobytes() for x in (place.astype("<u4"), value[last].astype("<f8"), (last + 1).astype("<u4")))]
            nth, held, columns = nth + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32() if i < 5 else pa.binary()) for i, c in enumerate(cols)],
                names=["slice", "arm", "kind", "part", "nth", "places", "values", "ends"],
            )

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("slice", "arm", "kind")])
            value, place = (batch.column(c).to_numpy() for c in ("value", "place"))
            begins = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))[: len(value)])
            for x, y in zip(begins, [*begins[1:], len(value)]):
                if held and key != tuple(keys[:, x].tolist()):
                    yield packed()
                key = tuple(keys[:, x].tolist())
                while x < y:
                    z = min(y, x + chunk - columns)
                    held.append((value[x:z], place[x:z]))
                    x, columns = z, columns + z - x
                    if columns == chunk:
                        yield packed()
        if held:
            yield packed()

    return run


def _merged(score: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores from the highest down, and the sums of the weights (kinds, repetitions, columns) of equal ones."""
    order = np.argsort(-score, kind="stable")
    score = score[order]
    first = np.flatnonzero(np.append(True, score[1:] != score[:-1])[: len(score)])
    if not len(first):
        return score, weights
    return score[first], np.add.reduceat(weights[:, :, order], first, axis=2)


def _upto(weights: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2 and so on."""
    return np.append(0, np.cumsum(weights, dtype=np.int64))


class _Curve:
    """The partial areas of an arm in some repetitions, from its levels as they come from the highest score down.

    What is held are a few numbers for each repetition: hits and alarms down to the last complete level, and those at
    the score that the next rows may add to. Levels that were not drawn add nothing.
    """

    def __init__(self, drawn: np.ndarray, limit: float):
        (self.n_pos, self.n_neg), self.limit, n = np.maximum(1, drawn[:2]), limit, drawn.shape[1]
        self.hits, self.alarms, self.body, self.passed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        self.open, self.score = np.zeros((2, n), np.int64), None

    def follow(self, hits_upto: np.ndarray, alarms_upto: np.ndarray, weigh) -> None:
        """Complete levels, given by how many positives and negatives there are up to each; `weigh` has their weights.

        A step of the curve is the negatives of a level, its height half the hits before and after that level.
        """
        if not len(hits_upto):
            return
        level = np.repeat(np.arange(len(hits_upto)), np.diff(alarms_upto, prepend=0))
        after, before = hits_upto[level], np.append(0, hits_upto)[level]
        for k in np.flatnonzero(~self.passed):
            positives, negatives = weigh(k)
            hits, n, last = _upto(positives), len(negatives), -1
            if (self.alarms[k] + negatives.sum(dtype=np.int64)) / self.n_neg[k] > self.limit:
                fa = (self.alarms[k] + _upto(negatives)[alarms_upto]) / self.n_neg[k]
                top = int(np.searchsorted(fa, self.limit, side="right"))
                n, last = (alarms_upto[top - 1], hits_upto[top - 1]) if top else (0, 0)
                self.passed[k] = True
            steps = negatives[:n].astype(float)
            total = steps.sum()
            self.body[k] += 2 * self.hits[k] * total + steps @ (hits[before[:n]] + hits[after[:n]]).astype(float)
            self.hits[k] += hits[last]
            self.alarms[k] += int(total)

    def close(self) -> None:
        if self.score is not None:
            self.follow(np.ones(1, np.int64), np.ones(1, np.int64), lambda k: (self.open[0, k : k + 1], self.open[1, k : k + 1]))
        self.open, self.score = np.zeros_like(self.open), None

    def add(self, score: np.ndarray, upto: np.ndarray, place: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> None:
        """Falling scores, none above those before, the number of places up to the last of each, and all weights."""
        begin, first = 0, 0
        if self.score == score[0]:
            begin, first = upto[0], 1
            self._add_open(place[:begin], positive[:begin], weights)
            if len(score) == 1:
                return
        self.close()
        end = upto[-2] if len(score) > 1 else 0
        whole, some = place[begin:end], positive[begin:end]
        ends = upto[first:-1] - begin
        hits_upto = _upto(some)[ends]
        high, low = whole[some], whole[~some]
        self.follow(hits_upto, ends - hits_upto, lambda k: (weights[k].take(high), weights[k].take(low)))
        self.score = score[-1]
        self._add_open(place[end:], positive[end:], weights)

    def _add_open(self, place: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> None:
        for kind, of in enumerate((place[positive], place[~positive])):
            self.open[kind] += weights[:, of].sum(axis=1, dtype=np.int64)

    def areas(self) -> tuple[np.ndarray, np.ndarray]:
        """(area, short) of the repetitions; `short`: the curve goes on within the limit below the lowest score."""
        self.close()
        det, fa = self.hits / self.n_pos, self.alarms / self.n_neg
        return (self.body / (2.0 * self.n_pos * self.n_neg) + (self.limit - fa) * det) / self.limit, ~self.passed


AREAS = "arm string, rep bigint, area double, short boolean"


def _areas(reps: int, block: int, limit: float, sizes: dict[str, int], arms: list, floors: dict):
    """(arm, rep, area, short) of `block` repetitions from the rows of `_pack`, sorted: one curve for each.

    A slice's draws are counted when its first row comes. With a single slice a curve follows the rows; with more of
    them an arm's counts by level are held until the last slice.
    """
    ends = np.cumsum(list(sizes.values()))
    kinds = np.array([{POS: 0, NEG: 1}.get(role, 2) for role in sizes])
    n = int(ends[-1])
    slices = -(-n // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, todo, before = None, None, range(0), None
        levels, drawn, curve, ready = {}, {}, None, None

        def by_level(place: np.ndarray, positive: np.ndarray, upto: np.ndarray) -> np.ndarray:
            """Weights (positives and negatives, repetitions, levels)."""
            out = np.empty((2, len(todo), len(upto)), np.int32)
            for kind, of in enumerate((positive, ~positive)):
                some, ends = place[of], _upto(of)[upto]
                for k in range(len(todo)):
                    out[kind, k] = np.diff(_upto(weights[k].take(some))[ends], prepend=0)
            return out

        def finish() -> pa.RecordBatch:
            """The curves of the arm whose rows of the last slice have come."""
            if levels.get(ready):
                _, sums = _merged(*(np.concatenate(x, axis=-1) for x in zip(*levels.pop(ready))))
                every = np.arange(1, sums.shape[2] + 1)
                curve.follow(every, every, lambda k: sums[:, k])
            area, short = curve.areas()
            some = np.flatnonzero(drawn[ready].sum(axis=0))
            arm = arms[ready]
            return pa.RecordBatch.from_arrays([
                pa.array([arm] * len(some), pa.string()), pa.array(todo.start + some, pa.int64()), pa.array(area[some]),
                pa.array(short[some] & (arm in floors)),
            ], names=["arm", "rep", "area", "short"])

        for batch in batches:
            for *here, places, values, upto, group in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if before and not (before[0] == group and before[1] < here):
                    raise RuntimeError("rows do not come in order")
                before, (slice_, arm, kind, _, _) = (group, here), here
                if at != slice_:
                    at, weights, todo = slice_, None, range(group * block, min(reps, (group + 1) * block))
                    weights = _weights(todo, sizes, at * SLICE, min(n, (at + 1) * SLICE))
                if arm not in drawn:
                    drawn[arm] = np.repeat([[sum(m for m, j in zip(sizes.values(), kinds) if j == k)] for k in range(3)], len(todo), axis=1)
                place, value, upto = (np.frombuffer(x, t) for x, t in ((places, "<u4"), (values, "<f8"), (upto, "<u4")))
                place, upto = place.astype(np.int64), upto.astype(np.int64)
                of = kinds[np.searchsorted(ends, place + at * SLICE, side="right")]
                if kind == REPEATED:
                    times = np.repeat(value.astype(np.int64), np.diff(upto, prepend=0))
                    for k in range(3):
                        drawn[arm][k] += weights[:, place[of == k]].astype(np.int64) @ times[of == k]
                    continue
                if at == slices - 1 and arm != ready:
                    if ready is not None:
                        yield finish()
                    ready, curve = arm, _Curve(drawn[arm], limit)
                if kind == SCORED:
                    if slices > 1:
                        levels.setdefault(arm, []).append((value, by_level(place, of == 0, upto)))
                    elif not curve.passed.all():
                        curve.add(value, upto, place, of == 0, weights)
        if ready is not None:
            yield finish()

    return run


def _score_levels(photos: DataFrame) -> DataFrame:
    """(arm, score, n, n_arm, upto): negatives at each score, of the arm, and from the highest score down to here."""
    levels = photos.select(F.explode("scores").alias("s")).groupBy("s.arm", "s.score").agg(F.count(F.lit(1)).alias("n"))
    whole = levels.groupBy("arm").agg(F.sum("n").alias("n_arm"))
    down = Window.partitionBy("arm").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    met = F.col("arm").eqNullSafe(F.col("_arm"))
    return levels.withColumn("upto", F.sum("n").over(down)).join(
        F.broadcast(whole.withColumnRenamed("arm", "_arm")), met  # one row per arm
    ).drop("_arm")


def _lowest_scores(photos: DataFrame, limit: float) -> dict:
    """The score of each arm down to which its negatives outnumber, in any resample, the false alarms in question.

    Arms whose negatives do not have that many scores are left out.
    """
    neg = photos.filter(F.col("role") == NEG)
    most = neg.agg(F.max(_repeats("scores"))).first()[0] or 1
    alarms = F.lit(limit) * F.col("n_arm")
    wanted = alarms + F.lit(REACH) * F.sqrt(alarms * F.lit(most)) + 10 * most
    enough = _score_levels(neg).filter((F.col("upto") >= wanted) & F.col("score").isNotNull())
    return {r.arm: r.score for r in enough.groupBy("arm").agg(F.max("score").alias("score")).collect()}


def _entries(lists: pa.Array) -> tuple[np.ndarray, dict, np.ndarray]:
    """(row, rows of each arm, score) of the single scores of a column of photographs' scores."""
    flat = pc.list_flatten(lists)
    row = pc.list_parent_indices(lists).to_numpy()
    score = flat.field("score").to_numpy(zero_copy_only=False).astype(float)
    codes = pc.dictionary_encode(flat.field("arm"), null_encoding="encode")
    of = codes.indices.to_numpy()
    return row, {arm: np.flatnonzero(of == k) for k, arm in enumerate(codes.dictionary.to_pylist())}, score


def _marked(placed: DataFrame, arms: list, lowest: dict) -> DataFrame:
    """Rows for `_pack`: every score of an arm from `lowest` up and, as REPEATED, how many scores a photograph has
    of an arm beyond one (-1 if it has none)."""
    spark = placed.sparkSession
    each = spark.createDataFrame([(i, arm, lowest.get(arm)) for i, arm in enumerate(arms)], "_nth int, _arm string, floor double")
    met = F.col("s.arm").eqNullSafe(F.col("_arm"))
    above = F.col("s.score").isNotNull() & ~F.isnan("s.score") & (F.col("floor").isNull() | (F.col("s.score") >= F.col("floor")))
    slice_, place = F.floor(F.col("place") / SLICE).cast("int").alias("slice"), F.col("place") % SLICE
    scored = (
        placed.filter(F.col("role").isin(POS, NEG)).select("place", F.explode("scores").alias("s"))
        .join(F.broadcast(each), met).filter(above)  # one row per arm
        .select(slice_, F.col("_nth").alias("arm"), F.lit(SCORED).alias("kind"), F.col("s.score").alias("value"), place.alias("place"))
    )
    odd = placed.filter((F.size("scores") != len(arms)) | (_repeats("scores") != 1)).select("place", F.transform("scores", lambda s: s["arm"]).alias("arms"))
    n = F.size(F.filter("arms", lambda a: a.eqNullSafe(F.col("_arm"))))
    repeated = odd.crossJoin(F.broadcast(each)).filter(n != 1).select(  # one row per arm
        slice_, F.col("_nth").alias("arm"), F.lit(REPEATED).alias("kind"), (n - 1).cast("double").alias("value"), place.alias("place")
    )
    return scored.unionByName(repeated)


def _stream(rows: DataFrame, n: int, slices: int, arms: int) -> DataFrame:
    """The rows of `_marked` packed, in one partition and in order. FIRST comes for every slice and arm."""
    spark = rows.sparkSession
    order = ["slice", "arm", "kind", F.desc("value")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), task_parts(n))
    packed = rows.repartitionByRange(parts, *order, "place").sortWithinPartitions(*order).mapInArrow(_pack(CHUNK), PACKED)
    none = spark.range(slices * arms).select(
        F.floor(F.col("id") / arms).cast("int").alias("slice"), (F.col("id") % arms).cast("int").alias("arm"), F.lit(FIRST).alias("kind"),
        *[F.lit(0).alias(c) for c in ("part", "nth")], *[F.lit(b"").alias(c) for c in ("places", "values", "ends")],
    )
    return checkpointed(none.unionByName(packed).repartition(1).sortWithinPartitions("slice", "arm", "kind", "part", "nth"))


def area_bootstrap(images: DataFrame, reps: int = 2000, limit: float = AREA_LIMIT) -> DataFrame:
    """(arm, reps, low, high): percentile interval of the partial area.

    The draws of `bootstrap_levels`, hashed on arrays by tasks that count all draws of a few repetitions, a byte for
    each photograph; no draw is shuffled. Each task then reads the places of the photographs in the order of every
    arm's scores, written down once. Only scores are read down to which the curve matters; if a curve goes on
    below, all of them are read.
    """
    spark = images.sparkSession
    key = keyed_hash(F.lit("boot"), "image_id")
    # made once for the counts of its buckets and for its places; the key is made again where rows are sorted by it
    keyed = checkpointed(arm_scores(images, dealt=False)).withColumn("_bkt", hash_bucket(key))
    placed = checkpointed(
        positions(spread_rows(keyed, keyed.count(), "role", "_bkt"), ["role"], [key, "image_id"])
        .filter(F.col("role").isNotNull()).select("role", "pos", "scores")
    )
    sizes = {r.role: r.n for r in placed.groupBy("role").agg(F.count(F.lit(1)).alias("n")).orderBy("role").collect()}  # one row per role
    arms = [r.arm for r in placed.select(F.explode("scores").alias("s")).select("s.arm").distinct().collect()]
    if reps < 1 or not arms:
        return spark.createDataFrame([], "arm string, reps bigint, low double, high double")
    n, begin, before = sum(sizes.values()), F.lit(0).cast("bigint"), 0
    for role, size in sizes.items():
        begin, before = F.when(F.col("role") == role, F.lit(before).cast("bigint")).otherwise(begin), before + size
    placed = placed.select("role", "scores", (F.col("pos") + begin).alias("place"))
    block = max(1, min(BLOCK, COLUMNS // n))
    groups = spark.range(0, -(-reps // block), 1, -(-reps // block)).withColumnRenamed("id", "group")
    floors = _lowest_scores(placed, limit)
    for lowest in (floors, {}):
        stream = _stream(_marked(placed, arms, lowest), n, -(-n // SLICE), len(arms))
        # a task for each row of `groups`, which reads the stream from the checkpoint
        curves = stream.crossJoin(groups.hint("shuffle_replicate_nl"))
        areas = checkpointed(curves.mapInArrow(_areas(reps, block, limit, sizes, arms, lowest), AREAS))
        if areas.filter("short").isEmpty():
            break
    return areas.groupBy("arm").agg(
        F.count(F.lit(1)).alias("reps"),
        F.percentile("area", F.lit(0.025)).alias("low"),
        F.percentile("area", F.lit(0.975)).alias("high"),
    )


def _repeats(scores: str) -> Column:
    """At most so many of a photograph's scores are of one arm."""
    arms = F.transform(scores, lambda s: s["arm"])
    return F.size(arms) - F.size(F.array_distinct(arms)) + 1


def calibration_halves(images: DataFrame, reps: int) -> DataFrame:
    """(rep, image_id, scores, slot): negatives in a random order per repetition, cut in half.

    Slot 0 is the calibration half (n div 2 photographs), slot 1 the held-out half.
    """
    neg = arm_scores(images.filter(F.col("role") == NEG)).drop("role")
    every = F.sequence(F.lit(0), F.lit(reps - 1))
    halves = neg.agg(F.floor(F.count(F.lit(1)) / 2).alias("half")).select(
        F.explode(every).alias("rep"), "half"
    )
    rows = neg.withColumn("rep", F.explode(every)).withColumn(
        "_key", keyed_hash(F.lit("half"), "rep", "image_id")
    )
    rows = rows.withColumn("_bkt", hash_bucket(F.col("_key"), 2))  # 256 counts for each repetition
    return cut_slots(rows, ["rep"], ["_key", "image_id"], halves, ["half"], few=reps <= FEW_ROWS).drop("_key")


def conformal_cuts(halves: DataFrame, targets: list[float], few: bool = False) -> DataFrame:
    """(arm, rep, target, cut, held_alerts, n_held) of the split-conformal rule.

    With n calibration scores, floor(target * (n + 1)) - 1 of them may lie at or above an alert;
    the cut is the next largest score and an alert must exceed it. A negative allowance means no
    alert, shown as an infinite cut. Never-fired photographs score -1.

    Rows are counted map-side by score bucket; only the buckets that hold a cut are read again by
    score, so what is shuffled grows with the repetitions and not with photographs times
    repetitions. `few` says that one row for each arm, repetition and target may be broadcast.
    """
    scored = halves.select("rep", "slot", F.explode("scores").alias("s")).select(
        "rep", "slot", F.col("s.arm").alias("arm"), F.coalesce("s.score", F.lit(-1.0)).alias("score")
    )
    # falling scores give rising buckets; what lies outside [-1, 1] joins the outermost ones
    scored = scored.withColumn(
        "bkt", F.greatest(F.least(F.floor((1 - F.col("score")) * SCORE_BUCKETS), F.lit(2 * SCORE_BUCKETS)), F.lit(0))
    )
    halves_of = [
        F.count(F.when(F.col("slot") == 0, 1)).alias("cal"), F.count(F.when(F.col("slot") == 1, 1)).alias("held")
    ]
    order = Window.partitionBy("arm", "rep").orderBy("bkt")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("arm", "rep")
    counted = (
        scored.groupBy("arm", "rep", "bkt").agg(*halves_of)
        .withColumn("n_cal", F.sum("cal").over(whole))
        .withColumn("n_held", F.sum("held").over(whole))
        .withColumn("cal_before", F.coalesce(F.sum("cal").over(before), F.lit(0)))
        .withColumn("held_before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    )
    cells = []
    for t in targets:
        allowed = F.floor(F.lit(t) * (F.col("n_cal") + 1).cast("double")) - 1
        cells.append(F.struct(F.lit(t).alias("target"), allowed.alias("m")))
    asked = counted.withColumn("t", F.explode(F.array(*cells))).select("*", "t.target", "t.m").drop("t")
    holds = (F.col("m") >= F.col("cal_before")) & (F.col("m") < F.col("cal_before") + F.col("cal"))
    edges = asked.filter(holds).select("arm", "rep", "bkt", "target", "m", "cal_before", "held_before")
    if few:
        edges = F.broadcast(edges)  # one row for each arm, repetition and target
    within = Window.partitionBy("arm", "rep", "target").orderBy(F.desc("score"))
    down = within.rowsBetween(Window.unboundedPreceding, 0)
    found = (
        scored.join(edges, ["arm", "rep", "bkt"])
        .groupBy("arm", "rep", "target", "score", "m", "cal_before", "held_before").agg(*halves_of)
        .withColumn("cal_to", F.col("cal_before") + F.sum("cal").over(down))
        .withColumn("held_above", F.col("held_before") + F.sum("held").over(down) - F.col("held"))
        .filter((F.col("m") >= F.col("cal_to") - F.col("cal")) & (F.col("m") < F.col("cal_to")))
        .select("arm", "rep", "target", "score", "held_above")
    )
    totals = asked.groupBy("arm", "rep", "target").agg(F.max("n_held").alias("n_held"))
    return totals.join(found, ["arm", "rep", "target"], "left").select(
        "arm", "rep", "target", F.coalesce("score", F.lit(float("inf"))).alias("cut"),
        F.coalesce("held_above", F.lit(0)).alias("held_alerts"), "n_held",
    )


MARKED = "kind int, arm string, k int, score double, rep int, counts binary"
BELOW, UNSURE, CALIBRATES, LEVEL = range(4)


def _mark(reps: int, n_targets: int, low: int, high: int, ranges: dict):
    """One hash a photograph and repetition: which calibrate, counted by arm and, where a cut can lie, by score.

    A key below `low` is in the calibration half for certain, one above `high` is held out; photographs with a key
    in between go on as rows. Scores above the range of a target are counted as one infinite score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, unsure = np.zeros(reps, np.int64), np.zeros(reps, np.int64)
        sums, kinds = {}, None
        whole = lambda x: x.astype("<i8").tobytes()

        def table(rows: list[tuple], photos: tuple | None = None) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            more = [pa.nulls(len(rows), t) for t in kinds] if photos is None else list(photos)
            return pa.RecordBatch.from_arrays([*arrays, *more], names=["kind", "arm", "k", "score", "rep", "counts", "image_id", "scores"])

        for batch in batches:
            photo, lists = batch.column("image_id"), batch.column("scores")
            kinds = photo.type, lists.type
            for first, tails in in_blocks(batch.column("tail").to_pylist()):
                mark = np.empty((reps, tails.n), bool)
                for rep in range(reps):
                    key = tails.heads(b"half|%d" % rep)
                    mark[rep] = key < low
                    open_ = np.flatnonzero((key >= low) & (key <= high))
                    unsure[rep] += len(open_)
                    if len(open_):
                        at = pa.array(first + open_)
                        yield table([(UNSURE, None, None, None, rep, None)] * len(open_), (photo.take(at), lists.take(at)))
                below += mark.sum(axis=1)
                row, arms, score = _entries(lists.slice(first, tails.n))
                count = lambda of: mark @ np.bincount(row[of], minlength=tails.n).astype(np.float32)
                levels = []
                for arm, of in arms.items():
                    sums[arm, None] = sums.get((arm, None), 0) + count(of)
                    for k in range(n_targets):
                        top, bottom = ranges[arm][k]
                        sums[arm, k] = sums.get((arm, k), 0) + count(of[score[of] > top])
                        inside = of[(score[of] <= top) & (score[of] >= bottom)]
                        inside = inside[np.argsort(-score[inside], kind="stable")]
                        held = score[inside]
                        starts = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
                        if len(starts):
                            each = np.add.reduceat(mark[:, row[inside]], starts, axis=1, dtype=np.int64)
                            levels += [(LEVEL, arm, k, float(held[x]), None, whole(each[:, i])) for i, x in enumerate(starts)]
                for at in range(0, len(levels), 1000):
                    yield table(levels[at : at + 1000])
        if kinds:
            rows = [(BELOW, None, None, None, None, whole(below)), (UNSURE, None, None, None, None, whole(unsure))]
            for (arm, k), counts in sums.items():
                kind = (CALIBRATES, arm, None, None) if k is None else (LEVEL, arm, k, float("inf"))
                rows.append((*kind, None, whole(counts)))
            yield table(rows)

    return run


def _find_cuts(reps: int, targets: list[float], arms: dict):
    """(arm, rep, target, cut, held_alerts, n_held): a walk down the levels of every arm and target.

    What is held is a few numbers for each repetition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None

        def begin():
            nonlocal cal, cuts, alerts, upto, every, found, now, here, total
            cal, cuts, alerts = np.zeros(reps, np.int64), np.full(reps, np.inf), np.zeros(reps, np.int64)
            upto, every, found = np.zeros(reps, np.int64), 0, np.zeros(reps, bool)
            now, here, total = None, np.zeros(reps, np.int64), 0

        def wanted():
            m = np.floor(targets[key[1]] * (cal + 1).astype(float)) - 1
            return m, (m >= 0) & (m < cal)

        def level():
            """Close the level that was being read."""
            nonlocal upto, every, here, total
            m, exists = wanted()
            hit = exists & ~found & (m >= upto) & (m < upto + here)
            if hit.any() and now == np.inf:
                raise RuntimeError("a range of scores misses its cut")
            cuts[hit], alerts[hit], found[hit] = now, every - upto[hit], True
            upto, every = upto + here, every + total
            here, total = np.zeros(reps, np.int64), 0

        def done() -> pd.DataFrame:
            level()
            if (wanted()[1] & ~found).any():
                raise RuntimeError("a range of scores misses its cut")
            return pd.DataFrame({
                "arm": pd.Series([key[0]] * reps, dtype=object), "rep": np.arange(reps), "target": targets[key[1]], "cut": cuts,
                "held_alerts": alerts, "n_held": arms[key[0]] - cal,
            })

        cal = cuts = alerts = upto = every = found = now = here = total = None
        for batch in batches:
            for arm, k, kind, score, n, counts, which, many in batch.itertuples(index=False, name=None):
                if key != (arm, k):
                    if key is not None:
                        yield done()
                    key = arm, k
                    begin()
                got = np.zeros(reps, np.int64) if counts is None else np.frombuffer(counts, "<i8").copy()
                if which is not None and len(which):
                    got[which] += many
                if kind == CALIBRATES:
                    cal += got
                    continue
                if now is not None and score != now:
                    level()
                now, here, total = score, here + got, total + n
        if key is not None:
            yield done()

    return run


def split_cuts(images: DataFrame, reps: int, targets: list[float]) -> DataFrame:
    """`conformal_cuts(calibration_halves(images, reps), targets)` by one hash for each negative and repetition.

    With n negatives the key that ends the calibration half lies near the half of all keys, and a cut near its
    rank among all scores, both by a few square roots of n. So keys and scores are compared with ranges, counted,
    and only the few in a range are looked at one by one. A range that misses is seen by its counts, and the
    halves are then sorted after all.
    """
    spark = images.sparkSession
    photos = arm_scores(images.filter(F.col("role") == NEG)).select(
        "image_id", _tail(F.col("image_id")).alias("tail"),
        F.transform("scores", lambda s: F.struct(s["arm"].alias("arm"), F.coalesce(s["score"], F.lit(-1.0)).alias("score"))).alias("scores"),
    )
    photos = checkpointed(photos)
    n, most = photos.agg(F.count(F.lit(1)), F.max(_repeats("scores"))).first()
    schema = "arm string, rep bigint, target double, cut double, held_alerts bigint, n_held bigint"
    if not n:
        return spark.createDataFrame([], schema)
    levels = checkpointed(_score_levels(photos))
    ends = []
    for k, t in enumerate(targets):
        at = F.lit(float(t)) * F.col("n_arm")
        margin = F.lit(REACH) * F.sqrt(F.greatest(at, F.lit(0.0)) * F.lit(most)) + 10 * most
        ends += [
            F.max(F.when(F.col("upto") > at - margin, F.col("score"))).alias(f"top{k}"),
            F.min(F.when(F.col("upto") - F.col("n") < at + margin, F.col("score"))).alias(f"bottom{k}"),
        ]
    inf = float("inf")
    known = levels.groupBy("arm").agg(F.max("n_arm").alias("n_arm"), *ends).collect()  # one row per arm
    ranges = {
        r.arm: [tuple(x if x is not None else inf for x in (r[f"top{k}"], r[f"bottom{k}"])) for k in range(len(targets))] for r in known
    }
    half = n // 2
    width = REACH / 2 / n**0.5 + 4 / n
    low, high = (int(max(0.0, min(1.0, half / n + side)) * 2**64) for side in (-width, width))
    low, high = min(low, 2**64 - 1), min(high, 2**64 - 1)
    kinds = {f.name: f.dataType.simpleString() for f in photos.schema}
    made = checkpointed(spread(photos, "image_id").mapInArrow(
        _mark(reps, len(targets), low, high, ranges), f"{MARKED}, image_id {kinds['image_id']}, scores {kinds['scores']}"
    ))
    # one row a task, with a number for each repetition
    counted = made.filter(F.col("counts").isNotNull() & F.col("kind").isin(BELOW, UNSURE)).select("kind", "counts").collect()
    below, unsure = (sum((np.frombuffer(r.counts, "<i8") for r in counted if r.kind == kind), np.zeros(reps, np.int64)) for kind in (BELOW, UNSURE))
    need = half - below
    if (need < 0).any() or (need > unsure).any():
        return conformal_cuts(calibration_halves(images, reps), targets)
    needs = F.broadcast(spark.createDataFrame([(rep, int(x)) for rep, x in enumerate(need)], "rep int, need bigint"))  # one row per repetition
    order = Window.partitionBy("rep").orderBy(keyed_hash(F.lit("half"), "rep", "image_id"), "image_id")
    between = (
        made.filter((F.col("kind") == UNSURE) & F.col("counts").isNull()).select("rep", "image_id", "scores")
        .withColumn("_nth", F.row_number().over(order)).join(needs, "rep").filter("_nth <= need")
        .select("rep", F.explode("scores").alias("s")).select("s.arm", "rep", "s.score")
    )
    spans = spark.createDataFrame(
        [(arm, k, *span) for arm, of in ranges.items() for k, span in enumerate(of)], "_arm string, k int, top double, bottom double"
    )

    def in_range(rows: DataFrame) -> DataFrame:
        met = F.col("arm").eqNullSafe(F.col("_arm"))
        asked = rows.join(F.broadcast(spans), met).filter("score >= least(bottom, top)")  # one row per arm and target
        return asked.withColumn("score", F.when(F.col("score") > F.col("top"), F.lit(inf)).otherwise(F.col("score"))).drop("_arm", "top", "bottom")

    def listed(rows: DataFrame, keys: list[str]) -> DataFrame:
        each = rows.groupBy(*keys, "rep").agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy(*keys).agg(F.collect_list(F.struct("rep", "n")).alias("got"))

    empty = {"score": "double", "n": "bigint", "counts": "binary", "which": "array<int>", "many": "array<bigint>"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        missing = [F.lit(0 if c == "n" else None).cast(t).alias(c) for c, t in empty.items() if c not in df.columns]
        return df.select("*", F.lit(kind).alias("kind"), *missing).select("arm", "k", "kind", *empty)

    unlisted = lambda df: df.withColumns({"which": F.col("got.rep"), "many": F.col("got.n")}).drop("got")
    each_target = F.explode(F.sequence(F.lit(0), F.lit(len(targets) - 1))).alias("k")
    certain = made.filter(F.col("kind") == CALIBRATES).select("arm", each_target, "counts")
    parts = [
        rows(certain, CALIBRATES),
        rows(unlisted(listed(between, ["arm"])).select("arm", each_target, "which", "many"), CALIBRATES),
        rows(made.filter(F.col("kind") == LEVEL).select("arm", "k", "score", "counts"), LEVEL),
        rows(unlisted(listed(in_range(between), ["arm", "k", "score"])), LEVEL),
        rows(in_range(levels.select("arm", "score", "n")).groupBy("arm", "k", "score").agg(F.sum("n").alias("n")), LEVEL),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    walked = spread(every, "arm", "k").sortWithinPartitions("arm", "k", "kind", F.desc("score"))
    return walked.mapInPandas(_find_cuts(reps, list(targets), {r.arm: r.n_arm for r in known}), schema)


def conformal_alerts(images: DataFrame, halves: DataFrame, target: float) -> DataFrame:
    """(arm, image_id, role, alert) for every positive and every held-out negative, one split."""
    cuts = conformal_cuts(halves, [target]).select("arm", "cut")
    held = halves.filter("slot = 1").select("image_id", F.lit(True).alias("held"))
    judged = images.join(held, "image_id", "left").filter(
        (F.col("role") == POS) | F.col("held")
    )
    return judged.join(F.broadcast(cuts), "arm").select(  # one row per arm
        "arm", "image_id", "role",
        (F.coalesce(stored("max_conf"), F.lit(-1.0)) > F.col("cut")).alias("alert"),
    )


def conformal_rates(
    images: DataFrame, reps: int = 1000, targets: list[float] = BUDGETS
) -> DataFrame:
    """(arm, rep, target, det, fa) over repeated random halves.

    Positives above each cut are counted by merging the cuts into the arm's distinct positive
    scores and summing once from the top, so no cut is compared with a photograph.
    """
    cuts = split_cuts(images, reps, targets)
    zero = F.lit(0).cast("bigint")
    pos = (
        images.filter(F.col("role") == POS)
        .groupBy("arm", F.coalesce(stored("max_conf"), F.lit(-1.0)).alias("score"))
        .agg(F.count(F.lit(1)).alias("pos"))
    )
    n_pos = pos.groupBy("arm").agg(F.sum("pos").alias("n_pos"))
    events = pos.select(
        "arm", "score", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("rep"),
        F.lit(None).cast("double").alias("target"), zero.alias("held_alerts"), zero.alias("n_held"),
    ).unionByName(
        cuts.select(
            "arm", F.col("cut").alias("score"), zero.alias("pos"), F.lit(0).alias("kind"), "rep",
            "target", "held_alerts", "n_held",
        )
    )
    down = Window.partitionBy("arm").orderBy(F.desc("score"), "kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        events.withColumn("above", F.sum("pos").over(down))
        .filter("kind = 0")
        .join(F.broadcast(n_pos), "arm")  # one row per arm
        .select(
            "arm", "rep", "target", ratio("above", "n_pos").alias("det"),
            ratio("held_alerts", "n_held").alias("fa"),
        )
    )


def conformal_summary(rates: DataFrame) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of detection and held-out false alarms."""
    cols = []
    for c in ("det", "fa"):
        cols += [
            F.avg(c).alias(c),
            F.percentile(c, F.lit(0.025)).alias(f"{c}_low"),
            F.percentile(c, F.lit(0.975)).alias(f"{c}_high"),
        ]
    return rates.groupBy("arm", "target").agg(*cols)


def conformal_beside_matched(rates: DataFrame, images: DataFrame) -> DataFrame:
    """(arm, target, conformal, matched, shortfall): mean split-conformal detection beside the exact
    detection at the same budget, and how far it falls short."""
    mean = rates.groupBy("arm", "target").agg(F.avg("det").alias("conformal"))
    exact = detection_at_budgets(images).select("arm", F.col("budget").alias("target"), F.col("detection").alias("matched"))
    return mean.join(exact, ["arm", "target"]).select(
        "arm", "target", "conformal", "matched", (F.col("matched") - F.col("conformal")).alias("shortfall")
    )
