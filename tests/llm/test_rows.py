"""Rows that are odd in themselves: clashing column names, ids with several texts, labels or sources, null and
repeated ids, hot keys, and texts too long to map character by character."""

import base64
import itertools
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splitsight.llm import common, lines, mixing, near_dedup, quality, secret_scan, topk

NAMES = ["row", "nth", "order", "times", "copy", "_row", "_nth", "_copies", "_copy", "__row", "_m_keep", "_m_id", "_keep", "_id",
         "_n_lines", "_n_dropped", "_score", "score", "_gone", "_doc", "_text", "_hash", "_rep", "_salt", "rep", "bucket", "slice"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
LINE = "a line that stands in many documents"


@pytest.fixture(scope="module")
def clash(spark):
    """Every name that operators use inside is a column, with another value in each row."""
    words = [f"w{i % 37}" for i in range(60)]
    texts = [None, "", " ".join(words), " ".join([*words, "end"]), f"{LINE}\nown a", f"{LINE}\nown b", f"own c\n{LINE}", "one two three"]
    rows = [(i, t, s) for i, (t, s) in enumerate(itertools.product(texts, ["a", "b", None]))]
    rows += [(2, "another text under an id that is taken by then", "a"), (500, " ".join(words), "a"), (500, " ".join(words), "b"), (500, " ".join(words), "b")]
    rows += [(None, "no id", "a"), (None, "no id", "a")]
    return spark.createDataFrame([(*r, *[f"{n}{k}" for n in NAMES]) for k, r in enumerate(rows)], SCHEMA).repartition(3).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_mixing_takes_whole_rows_however_they_are_dealt(clash):
    want = rows_of(mixing.take(clash, leaf=4))
    assert want and set(want) <= set(rows_of(clash)) and max(Counter(want).values()) <= 2
    for n in (1, 7):
        assert rows_of(mixing.take(clash.repartition(n), leaf=4)) == want
    copies = Counter()
    for r in mixing.mix(clash, leaf=4).collect():
        copies[r.doc_id, r.source, r.size] += r.copies
    assert copies == Counter((r[0], r[2], len((r[1] or "").split())) for r in want) + Counter()


def test_line_dedup_keeps_other_columns(clash):
    kept = lines.drop_lines(clash)
    assert kept.columns == clash.columns
    before = {r["row"]: r for r in clash.collect()}
    for r in kept.collect():
        was = before[r["row"]]
        assert r[0] == was[0] and r[2:] == was[2:] and set((r.text or "").split("\n")) <= {"", *(was.text or "").split("\n")}
    holds = [r.doc_id for r in kept.collect() if LINE in (r.text or "")]
    assert holds == [max(r.doc_id for r in clash.collect() if LINE in (r.text or ""))]


def test_hot_lines_are_dropped_alike(spark, monkeypatch):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(LINE + "\n" + LINE + "\n"), F.col("id") % 5, F.lit(" of the five lines in turn\nown "), "id").alias("text")
    )
    want = rows_of(lines.line_dedup_report(docs))
    monkeypatch.setattr(lines, "HOT_ROWS", 50)
    assert rows_of(lines.line_dedup_report(docs)) == want
    assert {r.n_dropped for r in lines.line_dedup_report(docs).collect()} == {0, 2, 3}


def test_one_id_with_two_texts(spark):
    """A and B are alike, C and D are alike; an id that stands on A and on C does not join them."""
    a = [f"a{i}" for i in range(50)]
    c = [f"c{i}" for i in range(50)]
    rows = [(1, " ".join(a)), (1, " ".join(c)), (5, " ".join([*a, "x"])), (7, " ".join([*c, "y"])), (9, "quite another text of few words")]
    docs = spark.createDataFrame([(*r, "n", "m") for r in rows], "doc_id long, text string, _doc string, _text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_components(docs).collect()}
    assert got == {(1, 1, True), (5, 1, False), (7, 1, False), (9, 9, True)}
    docs = docs.union(spark.createDataFrame([(7, "a text that nothing else is like at all", "n", "m")], docs.schema))
    assert sorted(r.text for r in near_dedup.keep_one(docs).collect()) == sorted([" ".join(a), " ".join(c), rows[4][1], "a text that nothing else is like at all"])
    three = [(2, " ".join(a)), (3, " ".join(c)), (3, " ".join([*a, "x"])), (4, " ".join([*c, "y"]))]
    got = near_dedup.near_components(spark.createDataFrame(three, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(2, 2), (3, 2), (3, 3), (4, 3)])


def test_families_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB_PART", 3)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        words = list(base)
        words[rng.integers(80)] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_null_and_repeated_ids_in_searches(spark):
    big = 2**53 + 1
    vectors = [(big, [1, 2, 3]), (None, [9, 9, 9]), (0, [1, 1, 1]), (0, [-1, 0, 0]), (7, [2, 2, 2]), (7, [2, 2, 2]), (8, None), (9, [1])]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    got = topk.top_k(rows, rows.filter("vec_id = 0 or vec_id is null"), k=3, shard=2).collect()
    want = [(0, 1, 7, 6), (0, 2, 7, 6), (0, 3, big, 6), (0, 1, 9, -1), (0, 2, big, -1), (0, 3, 7, -2)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert topk.top_k(rows, rows.filter("vec_id = 5")).count() == topk.top_k(rows.filter("vec_id = 5"), rows).count() == 0


@pytest.mark.parametrize("shard", [3, 16, 1000])
def test_searches_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(shard)
    vectors = [(int(i), rng.integers(-4, 5, rng.integers(1, 6)).tolist()) for i in rng.permutation(120)]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    want = []
    for q, x in vectors:
        if q % 6 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in vectors if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:9], 1)]
    got = topk.top_k(rows, rows.filter("vec_id % 6 = 0"), k=9, shard=shard).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_two_labels_of_one_id(spark):
    """The least label counts, so the fit does not depend on the order of the rows."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zxqj 0101 ") * 20) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(i, 1, 0) for i in range(0, 60, 4)], "doc_id long, quality int, toxic int")
    fits = [quality.fit(docs, labels.orderBy(F.desc(c) if d else c).coalesce(1)) for c in ("doc_id", "quality") for d in (0, 1)]
    assert all(f == fits[0] for f in fits)
    assert quality.score(docs, fits[0]).filter("(doc_id % 2 = 1) != (score >= 0.5)").count() == 0


def test_untrainable_texts_are_spread_over():
    texts = [f"{i:04d}" + "x" * 1020 for i in range(400)]
    raw = quality._dictionary.__globals__["math"] and b"".join(t.encode() for t in texts)
    import zstandard

    def fails(*_, **__):
        raise zstandard.ZstdError("cannot train")

    keep, zstandard.train_dictionary = zstandard.train_dictionary, fails
    try:
        got = quality._dictionary(texts)
    finally:
        zstandard.train_dictionary = keep
    assert len(got) <= quality.DICTIONARY and got.startswith(raw[:1024]) and b"0396" in got


def test_pipeline_stages_keep_clashing_columns(spark, clash, tmp_path):
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    docs = clash.withColumnRenamed("source", "src").withColumn("source", F.col("src")).withColumn("n_chars", F.length("text").cast("int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "sf"))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_fresh_names():
    assert common.fresh(["a", "_ROW", "__nth"], "row", "nth") == ["___row", "___nth"]


LONG = {
    "one escape": "text = 'plain words, no secrets here. ' * 1_200_000 + '%41KIAABCDEFGHIJKLMNOP'; spot = 'access'",
    "base64": "text = base64.b64encode(b'plain words, no secret. ' * 1_250_000 + b'password=abcdefghijkl').decode(); spot = 'assign'",
    "wrapped base64": "text = base64.encodebytes(b'plain words, no secret. ' * 1_250_000 + b'password=abcdefghijkl').decode(); spot = 'assign'",
}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts_take_bounded_memory(kind):
    """40 MB of text under 500 MB, in a process of its own."""
    code = f"""
import base64, resource, sys, time
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from splitsight.llm import secret_scan
{LONG[kind]}
assert len(text) > 35e6
start = time.process_time()
every = secret_scan.scan(text)[1]
assert any(k == spot and b > len(text) - 60 for _, b, k in every), every
print(time.process_time() - start, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    seconds, megabytes = map(float, out.stdout.split())
    assert megabytes < 500 and seconds < 120, (seconds, megabytes)  # 17 to 53 s when this was written


def test_places_of_layers_lead_back():
    """Spans through three layers are those of the characters that they were decoded from."""
    inner = "x" * 7 + "password=abcdefghijkl" + "y" * 5
    for how in itertools.product(("url", "unicode", "base64"), repeat=2):
        wrapped = secret_scan.wrapped(inner, *how)
        text = "é%41 before " + wrapped + " after"
        spans = [s for s in secret_scan.scan(text)[1] if s[2] == "assign"]
        assert spans
        for a, b, _ in spans:
            assert text.index(wrapped) <= a < b <= text.index(wrapped) + len(wrapped)
    flat = base64.b64encode(b"," * 30 + b"token=abcdefghijklmnop" + b"," * 30).decode()
    a, b, _ = next(s for s in secret_scan.scan(flat)[1] if s[2] == "assign")
    assert (a, b) == (30 // 3 * 4, -(-52 // 3) * 4)
