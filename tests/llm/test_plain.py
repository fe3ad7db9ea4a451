"""Fingerprints, scores and the whole pipeline recomputed plainly, one text at a time."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from splitsight.llm import common, fingerprint, mixing, packing, quality
from test_operators import SF, linked_plainly

ALL = 2**64 - 1


def mixed(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & ALL
    return x ^ x >> 32


def signatures_plainly(text, gram=6, bins=64, pick=2):
    """Order MinHash with dicts and lists: number each k-mer's occurrences, keep the least of each part in text order."""
    if not text:
        return [0] * bins
    gram = min(gram, len(text))
    low = (1 << max(20, (len(text) - gram + 1).bit_length())) - 1
    seen, parts = {}, {}
    for place in range(len(text) - gram + 1):
        state = gram
        for c in text[place : place + gram]:
            state = (state ^ ord(c)) * 0x9E3779B97F4A7C15 & ALL
            state ^= state >> 29
        state = mixed(state)
        nth = seen[text[place : place + gram]] = seen.get(text[place : place + gram], -1) + 1
        item = mixed((state + nth * 0xD1B54A32D192ED03) & ALL)
        parts.setdefault((item >> 32) * bins >> 32, []).append((item | low, place, item))
    out = []
    for part in range(bins):
        least = sorted(parts.get(part, []))[:pick]
        in_order = [item for _, _, item in sorted(least, key=lambda x: x[1])]
        signature = 0
        for item in in_order + [0] * (pick - len(in_order)):
            signature = mixed(signature * 0xA0761D6478BD642F & ALL ^ item)
        out.append(signature >> 32 | 1 if least else 0)
    return out


def likeness_plainly(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


@pytest.mark.parametrize("part_bytes, most", [(32 << 20, 1024), (300, 1024), (300, 2)])
def test_fingerprints_and_likeness(spark, monkeypatch, part_bytes, most):
    """Ids far apart, negative and null; empty and repeating texts; one stretch and many."""
    monkeypatch.setattr(fingerprint, "PART_BYTES", part_bytes)
    monkeypatch.setattr(fingerprint, "MOST", most)
    rng = random.Random(11)
    texts = ["", "ab", "abcdef", "aaaaaaaaaaaaaaaaaaaa", "é東🙂" * 9] + [
        " ".join(rng.choice(["red", "green", "blue", "東京", "x"]) for _ in range(rng.randrange(80))) for _ in range(40)
    ]
    ids = [-(2**62), -5, 2**62, *range(0, 30), *range(10**9, 10**9 + len(texts) - 34), None]
    rows = list(zip(ids, [None, *texts[1:]], strict=True))
    want = sorted(((i, t or "") for i, t in rows), key=lambda r: 2**63 if r[0] is None else r[0])
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(want)
    for (i, t), (_, after) in zip(want, want[1:] + want[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, other = (signatures_plainly(x) for x in (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in own)
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in changed)
        assert (r.near_edited, r.near_next) == (likeness_plainly(own, changed), likeness_plainly(own, other))


def test_every_stretch_is_followed_by_the_next(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "PART_BYTES", 100)
    rows = [(i, f"text number {i} of many") for i in range(400)]
    got = fingerprint.with_follower(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append((r.doc_id, r.follower))
    assert len(parts) > 50 and max(map(len, parts.values())) < 40
    for p in parts.values():
        p.sort(key=lambda x: (x[1], x[0]))
        own = [i for i, ahead in p if not ahead]
        assert own == list(range(own[0], own[-1] + 1)) and p[len(own) :] == [((own[-1] + 1) % 400, True)]


def scores_plainly(model, texts):
    """Both sizes of each whole text from coders of their own, then the curve."""

    def size(content, raw):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=quality.LEVEL)
        coder = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(coder.compress(raw[i : i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE))

    out = []
    for t in texts:
        raw = (t or "").encode()
        good, bad = size(model.good, raw), size(model.bad, raw)
        x = ((bad - good) / (good + bad), (good + bad) / 2 / len(raw), 1.0) if raw else (0.0, 1.0, 1.0)
        out.append(1 / (1 + np.exp(-np.dot(model.weights, x))))
    return out


def test_scores(spark):
    docs, labels = (common.table(spark, SF, t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    some = docs.orderBy("doc_id").limit(50).select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "x")], "doc_id long, text string")
    )
    rows = quality.score(some, model).collect()
    assert [r.score for r in rows] == pytest.approx(scores_plainly(model, [r.text for r in rows]), abs=1e-12)
    fold = {r.doc_id for r in quality.training_rows(labels).collect()}
    assert fold == {r.doc_id for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}


def lines_plainly(rows):
    key = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in rows}


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows equal what plain code makes of the rows that the stage before it kept."""
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, SF, "documents")

    def after(name, docs):
        out = stages[name](spark, docs, SF)
        return spark.createDataFrame(out.toPandas(), out.schema).cache()

    given = docs.collect()
    model = quality.fit(docs, common.table(spark, SF, "labels"))
    good = [r for r, x in zip(given, scores_plainly(model, [r.text for r in given]), strict=True) if x >= 0.5]
    docs = after("quality classifier", docs)
    assert sorted(docs.collect()) == sorted(good) and 0 < len(good) < len(given)

    kept = lines_plainly([(r.doc_id, r.text or "") for r in good])
    docs = after("line dedup", docs)
    rows = docs.collect()
    assert {r.doc_id: (r.text or "", r.n_chars, r.source) for r in rows} == {r.doc_id: (kept[r.doc_id], len(kept[r.doc_id]), r.source) for r in good}

    label = linked_plainly([(r.doc_id, r.text or "") for r in rows])
    docs = after("near dedup", docs)
    least = [r for r in rows if label[r.doc_id][1] == r.doc_id]
    assert sorted(docs.collect()) == sorted(least) and len(least) < len(rows)

    plan = {r.doc_id: (r.size, r.taken) for r in mixing.mixing_report(docs).collect()}
    docs = after("mixing", docs)
    taken = {}
    for r in docs.collect():
        taken.setdefault(r.doc_id, []).append(r)
    for r in least:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert plan[r.doc_id][0] == words and len(taken.get(r.doc_id, [])) * words == plan[r.doc_id][1] <= 2 * words
        assert all(x == r for x in taken.get(r.doc_id, []))

    plain = Tokenizer.from_file(path(packing.VOCABULARY))
    want, windows = [], {}
    for copies in taken.values():
        ids = [*plain.encode(copies[0].text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            piece = np.array(ids[start : start + 2048], "<u4")
            want += [(copies[0].doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] * len(copies)
    got = stages["packing"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048


@pytest.mark.parametrize("shard", [50_000, 10])
def test_shards_hold_pieces_however_long_texts_are(spark, shard):
    """One long document, many rows of one id, null ids: shards stay near their size and lose nothing."""
    texts = [("word " * 50_000, 1)] + [(f"text {i} " * (i % 40), 7) for i in range(60)] + [(f"none {i}", None) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    pieces = packing.token_pieces(docs).cache()
    bound = packing.most_pieces(docs)
    assert pieces.count() <= bound
    rows = packing.pack(pieces, bound, shard=shard).collect()
    columns = pieces.columns
    assert sorted((str([r[c] for c in columns]) for r in rows)) == sorted(str([r[c] for c in columns]) for r in pieces.collect())
    shards = {}
    for r in rows:
        shards[r.sequence_id >> 40] = shards.get(r.sequence_id >> 40, 0) + 1
    assert max(shards.values()) <= 4 * shard and (len(shards) > 10 or shard > 1000)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    full = [r for r in rows if r.length == 2048]
    assert len({r.sequence_id for r in full}) == len(full) and all(r.offset == 0 for r in full)
