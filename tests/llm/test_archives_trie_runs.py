"""Archives, the prefix trie and periodic runs against plain recomputation, odd rows included."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from oracle_check import compare, connect
from splitsight.llm import runs, trie, warc
from splitsight.session import scratch_path

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, salt string, record string, first long, body string"
TURNS = "conv_id long, turn long, role string, text string, a long, pos long, least string"


def fake(payload, length=None):
    n = len(payload) if length is None else length
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {n}\r\n\r\n{payload}\r\n\r\n"


@pytest.fixture(scope="module")
def pages(spark):
    """Payloads with magics, whole records and headers with false lengths inside; copies, ties, nulls."""
    rng = random.Random(3)
    hostile = [
        fake("inner"), fake(""), "x" * 50 + fake("in " * 40) + "tail", fake(fake("deep")), fake("long", 10**9), fake("short", 1),
        "WWARC/1.", "WARC/1.", "WARC/1.1\r\n", "WARC/1.1\r\n\r\n", fake("a") * 30, "\r\n\r\n" + fake("b") + "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n",
    ]
    html = [None, "", "é" * 49, "é" * 50, "z" * 99, "z" * 100, *hostile] + ["same page " * 20] * 40
    html += ["".join(rng.choice(["WARC/1.", "1\r\n", "Content-Length: 7", "\r\n\r\n", "<p>", fake("q")]) for _ in range(rng.randrange(40))) for _ in range(60)]
    html += [rng.choice(html) for _ in range(60)]
    ids = [*range(100, 100 + len(html))]
    rng.shuffle(ids)
    rows = [(i, rng.choice([None, "", f"http://x/{i}", "http://y/\r\nWARC-Type: warcinfo"]), h, "s", "r", 1, "b") for i, h in zip(ids, html, strict=True)]
    rows += [rows[10], rows[30], (None, None, None, "", "", 0, ""), (None, "u", "same page " * 20, "", "", 0, "")]
    return spark.createDataFrame(rows, PAGES).repartition(3).cache()


def pages_plainly(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in rows:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in rows:
        revisit = len(p) >= warc.MIN_BYTES and p in first and i != first[p]
        out.append((i, len(p), sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression, split", [("gzip", "128m"), ("none", "128m"), ("none", "300")])
def test_archives_read_back(spark, pages, compression, split):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path, compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = warc.read_archives(spark, path)
        got = warc.resolved(read).select("page_id", "payload_bytes", "payload_digest", "type", "refers_id")
        assert sorted(map(tuple, got.collect()), key=str) == pages_plainly(pages)
        texts = sorted(r.payload for r in read.select("payload").collect() if r.payload is not None)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = pages_plainly(pages)
    assert sorted(sha256(t).hexdigest() for t in texts) == sorted(r[2] for r in rows if r[3] == "response")


def test_a_cut_archive_is_refused(spark, tmp_path):
    good = fake("payload one") + fake("payload two").replace("999", "7")
    for name, text in (("cut", good[:-30]), ("late", "junk" + good), ("gap", good + "x" + good)):
        path = tmp_path / name / "a.warc"
        path.parent.mkdir()
        path.write_bytes(text.encode())
        with pytest.raises(ValueError, match="no chain of records"):
            warc.read_archives(spark, str(path.parent))
    path = tmp_path / "good"
    path.mkdir()
    (path / "a.warc").write_bytes(good.encode())
    rows = warc.read_archives(spark, str(path)).orderBy("at").collect()
    assert [bytes(r.payload) for r in rows] == [b"payload one", b"payload two"] and rows[0].next == rows[1].at


def test_no_pages_and_the_query(spark, pages):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0
    assert compare(warc.warc_report(spark, SF), connect(SF), warc.SQL)[0] is None


def trie_plainly(sequences):
    """Every node of {conv: [(role, text), ...]} by plain walking."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    kids, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, convs in members.items():
        saved = (len(convs) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += kids[node] == 0
            below[node[:d]][1] += saved
    return sorted(
        [
            (convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), kids[node], *below[node],
             sha256(",".join(map(str, ends[node])).encode()).hexdigest())
            for node, convs in members.items()
        ],
        key=str,
    )


def sequences_of(turns):
    rows = defaultdict(list)
    for r in turns.collect():
        if r.conv_id is not None:
            rows[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    return {c: [t[2:] for t in sorted(x)] for c, x in rows.items()}


def rebuilt_plainly(sequences):
    out = {}
    for c, own in sequences.items():
        h = crc32(str(c).encode()) % 6
        out[c] = sequences.get(c - c % 100, [])[:h] + own[h:]
    return out


@pytest.fixture(scope="module")
def turns(spark):
    """Few different turns, so prefixes are shared deeply; null and equal turn numbers, null roles and texts,
    repeated rows, one long conversation, copies."""
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(400), 120):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, t, 3, None]), rng.choice(["u", "v", None]), rng.choice(["", "é", "é", "yy", None])))
    rows += [(700, t, "u", "loop") for t in range(60)] + [(701, t, "u", "loop") for t in range(45)]
    rows += [(c, t, "u", "same") for c in range(900, 960) for t in range(4)] + [rows[0], rows[1], (None, 1, "u", "nobody")]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS).repartition(3).cache()


def nodes_of(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("convs, limit", [(2048, 1 << 16), (7, 1 << 16), (64, 10), (1, 1)])
def test_trie(turns, convs, limit):
    plain = sequences_of(turns)
    kept = trie.numbered(turns)
    assert nodes_of(trie.prefix_trie(kept, shard_convs=convs, shard_turns=limit)) == trie_plainly(plain)
    assert nodes_of(trie.prefix_trie(trie.rebuilt(kept), shard_convs=convs, shard_turns=limit)) == trie_plainly(rebuilt_plainly(plain))


def test_trie_of_nothing_of_one_and_the_query(spark, turns):
    assert trie.prefix_trie(trie.numbered(turns.limit(0))).count() == 0
    one = turns.filter("conv_id = 701")
    assert nodes_of(trie.prefix_trie(trie.numbered(one))) == trie_plainly(sequences_of(one))
    assert compare(trie.trie_report(spark, SF), connect(SF), trie.SQL)[0] is None


def runs_plainly(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(words[x] == words[x - d] for x in range(start + d, start + length)) for d in range(1, q))
            if j > i and length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(400):
        rows = []
        for _ in range(rng.randrange(1, 4)):
            words = []
            while len(words) < rng.choice([0, 5, 20, 80]):
                part = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 9))]
                words += (part * rng.randrange(1, 9))[: rng.randrange(1, 60)]
            rows.append(words)
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        got = zip(*(x.tolist() for x in runs.find_runs(np.array(sum(rows, []), np.int64), bounds)), strict=True)
        assert list(got) == [(i, *r) for i, w in enumerate(rows) for r in runs_plainly(w)]


def report_plainly(doc, text):
    words = (text or "").encode().split()
    h = crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_plainly(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc, len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
        sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_runs_report(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a b a b a b a b", "la " * 500, "A a A a A a A a", "x x " * 8, "é é\n" * 9]
    texts += [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(200))) for _ in range(150)]
    rows = [(i, t, None, "x") for i, t in enumerate(texts)] + [(4, "la " * 500, None, "x"), (None, "b c " * 9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string").repartition(3)
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, runs.runs_report(docs).select(*cols).collect()), key=str)
    assert got == sorted((report_plainly(r[0], r[1]) for r in rows), key=str)
    assert runs.runs_report(docs.limit(0)).count() == 0
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, runs.runs_report(whole).select(*cols).collect()), key=str)
    few = [report_plainly(r.doc_id, r.text) for r in whole.collect() if len((r.text or "").split()) < 400]
    assert few and set(few) <= set(got) and len(got) == whole.count()


def test_long_texts_stay_linear():
    """A text of one phrase and a text of one very frequent word: no pairs of occurrences are listed."""
    phrase = np.tile(np.arange(7), 60_000)
    assert [x.tolist() for x in runs.find_runs(phrase, np.array([0, len(phrase)]))] == [[0], [0], [len(phrase)], [7]]
    frequent = np.where(np.arange(300_000) % 2 == 0, 0, np.arange(300_000))
    assert len(runs.find_runs(frequent, np.array([0, len(frequent)]))[0]) == 0
