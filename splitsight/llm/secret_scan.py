"""Secret scans that unwrap nested encodings until nothing new appears."""

from __future__ import annotations

import base64
import binascii
import bz2
import gzip
import mmap
import re
import tempfile
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from hashlib import blake2b, sha256
from io import StringIO
from itertools import chain

from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex")
# What counts as a secret.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

_ONE_ESCAPE = (
    r"\\u\{(?P<brace>[0-9A-Fa-f]{1,6})\}|(?P<pair>\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})"
    r"|\\u(?P<four>[0-9A-Fa-f]{4})|\\U(?P<eight>[0-9A-Fa-f]{8})|\\x(?P<two>[0-9A-Fa-f]{2})|&#x(?P<hex>[0-9A-Fa-f]{1,6});|&#(?P<dec>[0-9]{1,7});"
)
_ESCAPES = re.compile(r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|" + _ONE_ESCAPE)
_ESCAPED_BYTES = re.compile((r"(?P<url>(?:%[0-9A-Fa-f]{2}){1,4096})|" + _ONE_ESCAPE).encode())
LEAST_RUN = 22  # the shortest secret, 16 bytes, takes 22 characters
# Runs on one line, and runs that go on over line breaks (with blanks around them) without a gap.
_RUNS = (
    r"[A-Za-z0-9+/_-]{22,}+={0,2}",
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}",
)
_BASE64 = [re.compile(r) for r in _RUNS]
_STRETCH = re.compile(rb"[A-Za-z0-9+/_-]+")
_BASE64_BYTES = [re.compile(r.encode()) for r in _RUNS]
_PLAIN_BYTES = {"assign": re.compile(ASSIGN.pattern.encode(), re.I), "access": re.compile(ACCESS.pattern.encode()), "hex": re.compile(HEX.pattern.encode())}
_LEAST = {"assign": LEAST_ASSIGN, "access": LEAST_ACCESS, "hex": 0}
_PACKED = re.compile(
    rb"(?P<gzip>\x1f\x8b\x08[\x00-\x1f])|(?P<bzip2>BZh[1-9](?:1AY&SY|\x17rE8P\x90))|(?P<zstd>\x28\xb5\x2f\xfd)|(?P<zlib>x[\x01\x5e\x9c\xda])",
    re.S,
)
SHORT = 4096  # shorter bytes are looked at once, for anything at all
_SOLID = re.compile(rb"[A-Za-z0-9+/_-]{16}")  # stands in every access key, hex secret and one-line run
_STANDARD = bytes.maketrans(b"-_", b"+/")
IN_MEMORY = 32 << 20  # bytes of one layer that are held in memory; longer ones lie in an unnamed file
STEP = 1 << 20  # bytes that are read or unpacked at a time


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of secrets that stand in the text as it is, leftmost and apart within a kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class _Escapes:
    """Where the characters of unescaped text stood: `size` of them from `at` on came from [start, end) each.

    Between two such pieces characters stand as they stood, so the map grows with the escapes alone.
    """

    __slots__ = ("at", "ends", "sizes", "starts")

    def __init__(self):
        self.at, self.sizes, self.starts, self.ends = array("q"), array("b"), array("q"), array("q")

    def put(self, at: int, size: int, start: int, end: int) -> None:
        for column, value in zip((self.at, self.sizes, self.starts, self.ends), (at, size, start, end), strict=True):
            column.append(value)

    def _one(self, x: int) -> tuple[int, int]:
        k = bisect_right(self.at, x) - 1
        if k < 0:
            return x, x + 1
        past = x - self.at[k] - self.sizes[k]
        return (self.starts[k], self.ends[k]) if past < 0 else (self.ends[k] + past, self.ends[k] + past + 1)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self._one(start)[0], self._one(end - 1)[1]


class _Run:
    """Where the bytes of a base64 run stood: three of them in four characters, those in unbroken stretches."""

    __slots__ = ("before", "end", "n", "skip", "starts")

    def __init__(self, before, starts, n: int, end: int, skip: int):
        self.before, self.starts, self.n, self.end, self.skip = before, starts, n, end, skip

    def _place(self, i: int) -> int:
        k = bisect_right(self.before, i) - 1
        return self.starts[k] + i - self.before[k]

    def span(self, start: int, end: int) -> tuple[int, int]:
        stop = self.skip + (end - 1) // 3 * 4 + 4
        return self._place(self.skip + start // 3 * 4), self._place(stop - 1) + 1 if stop <= self.n else self.end


class Layer:
    """A decoded text and how its characters lead back to the document: a chain of maps, without their texts."""

    __slots__ = ("maps", "text")

    def __init__(self, text: str, maps: tuple = ()):
        self.text, self.maps = text, maps

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the document that a stretch of the layer came from."""
        for step in reversed(self.maps):
            start, end = step.span(start, end)
        return start, end


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with URL and Unicode escapes decoded; None if it has none that decode."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    out, places, size, at = StringIO(), _Escapes(), 0, 0
    for m in _ESCAPES.finditer(text):
        kind, value = m.lastgroup, m[m.lastgroup]
        pieces = []  # decoded character, place
        if kind == "url":
            raw, i = bytes.fromhex(value.replace("%", "")), 0
            while i < len(raw):
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                try:
                    pieces.append((raw[i : i + n].decode(), m.start() + 3 * i, m.start() + 3 * min(i + n, len(raw))))
                except UnicodeDecodeError:
                    n = 1
                    pieces.append((text[m.start() + 3 * i : m.start() + 3 * i + 3], m.start() + 3 * i, m.start() + 3 * i + 3))
                i += n
        elif kind == "pair":
            pieces.append((bytes.fromhex(value[2:6] + value[8:12]).decode("utf-16-be"), m.start(), m.end()))
        else:
            code = int(value, 10 if kind == "dec" else 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            pieces.append((chr(code), m.start(), m.end()))
        size += out.write(text[at : m.start()])
        for s, a, b in pieces:
            places.put(size, len(s), a, b)
            size += out.write(s)
        at = m.end()
    if not places.at:
        return None
    out.write(text[at:])
    return Layer(out.getvalue(), (*layer.maps, places))


class Spool:
    """Bytes of any length, written piece by piece: short ones in memory, longer ones in an unnamed file."""

    def __init__(self):
        self.parts, self.size, self.file = [], 0, None

    def write(self, part: bytes) -> None:
        self.size += len(part)
        if self.file is None:
            self.parts.append(part)
            if self.size <= IN_MEMORY:
                return
            self.file, part, self.parts = tempfile.TemporaryFile(), b"".join(self.parts), []
        self.file.write(part)

    def done(self):
        if self.file is None:
            return b"".join(self.parts)
        self.file.flush()
        with self.file as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _unpacked(kind: str, data, at: int, write) -> tuple[int, bool, bool]:
    """Write what the member, stream or frame at `at` holds: (its end, whether it ended, whether it broke)."""
    if kind == "zstd":
        import zstandard

        unpacker, errors, step = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj(), zstandard.ZstdError, 1 << 10
    elif kind == "bzip2":
        unpacker, errors, step = bz2.BZ2Decompressor(), (OSError, ValueError), 1 << 16
    else:
        unpacker, errors, step = zlib.decompressobj(31 if kind == "gzip" else 15), zlib.error, 1 << 16
    while at < len(data) and not unpacker.eof:
        part, more = data[at : at + step], True
        at += len(part)
        while more:
            try:
                got = unpacker.decompress(part) if kind == "zstd" else unpacker.decompress(part, STEP)
            except errors:
                return at, False, True
            write(got)
            part = getattr(unpacker, "unconsumed_tail", b"")
            more = kind != "zstd" and not unpacker.eof and (bool(got) or bool(part))
            if kind == "bzip2" and unpacker.needs_input:
                more = False
    return at - len(unpacker.unused_data), unpacker.eof, False


def _packed(data):
    """(start, end, content) of compressed stretches of `data`, wherever they begin.

    Members, streams or frames that follow one another are one content, so nothing is lost where one ends
    (skippable frames and zero bytes between them are passed over). What came out before data ends or breaks
    off counts. Only the two bytes of zlib's head are too weak a sign for that: away from the start of `data`,
    such a stream counts if it is whole and its checksum right.
    """
    at = 0
    if not _may_pack(data):
        return
    while (m := _PACKED.search(data, at)) is not None:
        kind, end = m.lastgroup, m.start()
        spool = Spool()
        while True:
            begin = end
            part = Spool() if kind == "zlib" else spool
            end, whole, broke = _unpacked(kind, data, begin, part.write)
            if kind == "zlib" and (whole or begin == 0 and not broke):
                content = part.done()
                for i in range(0, len(content), STEP):
                    spool.write(content[i : i + STEP])
            if not whole:
                break
            after = end
            while kind == "gzip" and data[after : after + 1] == b"\0":
                after += 1
            while kind == "zstd" and data[after + 1 : after + 4] == b"\x2a\x4d\x18" and data[after] >> 4 == 5:
                after += 8 + int.from_bytes(data[after + 4 : after + 8], "little")
            follows = _PACKED.match(data, after)
            if follows is None or follows.lastgroup != kind:
                break
            end = after
        at = max(begin + 1, m.end()) if broke or kind == "zlib" and not whole else max(end, m.end())
        if spool.size:
            yield m.start(), end, spool.done()


def _decoded(data, start: int, end: int, skip: int):
    """Bytes of a base64 run, without its first `skip` characters, in pieces."""
    left = b""
    for at in range(start, end, STEP):
        part = data[at : min(at + STEP, end)].translate(_STANDARD, b" \t\r\n=")
        part, skip = left + part[skip:], max(0, skip - len(part))
        whole = len(part) // 4 * 4
        yield binascii.a2b_base64(part[:whole])
        left = part[whole:]
    if len(left) > 1:
        yield binascii.a2b_base64(left + b"=" * (4 - len(left)))


def _may_pack(data) -> bool:
    """False only if _PACKED finds nothing; literal bytes are found many times faster than patterns."""
    return (
        not isinstance(data, bytes) or b"\x1f\x8b\x08" in data or b"BZh" in data or b"\x28\xb5\x2f\xfd" in data
        or b"x\x01" in data or b"x^" in data or b"x\x9c" in data or b"x\xda" in data
    )


def _may_escape(data) -> bool:
    return not isinstance(data, bytes) or b"%" in data or b"\\" in data or b"&#" in data


def _may_assign(data) -> bool:
    """Every key of ASSIGN holds one of these."""
    if not isinstance(data, bytes):
        return True
    low = data.lower()
    return b"passw" in low or b"secret" in low or b"token" in low or b"api" in low


def _may_hold(raw: bytes) -> bool:
    """False only if there is neither a secret in the bytes nor anything that they could wrap."""
    return (
        _SOLID.search(raw) is not None or _may_assign(raw) and _PLAIN_BYTES["assign"].search(raw) is not None
        or _may_escape(raw) or _may_pack(raw) or b"\n" in raw and _BASE64_BYTES[1].search(raw) is not None
    )


def _aligned(clean: bytes, skip: int) -> bytes:
    """Bytes of base64 characters without their first `skip`; a lone last character says nothing."""
    part = clean[skip:]
    if len(part) % 4 == 1:
        part = part[:-1]
    return binascii.a2b_base64(part + b"=" * (-len(part) % 4))


def _without_escapes(data):
    """The bytes with escapes decoded, in pieces."""
    at = 0
    for m in _ESCAPED_BYTES.finditer(data):
        kind = m.lastgroup
        if kind == "url":
            new = bytes.fromhex(m[0].decode().replace("%", ""))
        elif kind == "pair":
            value = m[0].decode()
            new = bytes.fromhex(value[2:6] + value[8:12]).decode("utf-16-be").encode()
        else:
            code = int(m[kind], 10 if kind == "dec" else 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            new = chr(code).encode()
        for i in range(at, m.start(), STEP):
            yield data[i : min(i + STEP, m.start())]
        yield new
        at = m.end()
    for i in range(at, len(data), STEP):
        yield data[i : i + STEP]


def _gathered(parts):
    spool = Spool()
    for part in parts:
        spool.write(part)
    return spool.done()


def _plain_kinds(data) -> set[str]:
    """Kinds of secrets that stand in the bytes as they are."""
    return {
        kind
        for kind, pattern in _PLAIN_BYTES.items()
        if (kind != "assign" or _may_assign(data)) and any(len(m[m.lastindex or 0]) >= _LEAST[kind] for m in pattern.finditer(data))
    }


def _contents(data):
    """What is wrapped in bytes: compressed stretches, base64 runs in four alignments, escapes."""
    for _, _, inner in _packed(data):
        yield inner
    for pattern in _BASE64_BYTES:
        for m in pattern.finditer(data):
            for skip in range(4):
                inner = _gathered(_decoded(data, m.start(), m.end(), skip))
                if len(inner) > SHORT or _may_hold(inner):
                    yield inner
    if _may_escape(data) and _ESCAPED_BYTES.search(data):
        last = [_gathered(_without_escapes(data))]
        del data  # of a chain of escapes, one layer is held
        yield last.pop()


def _kinds_inside(data) -> set[str]:
    """Kinds of secrets in unpacked bytes, however deep. Their place is that of the compressed data.

    Goes down one branch at a time and stops when all kinds were found or nothing is new.
    """
    found, seen, branch = set(), set(), [iter([data])]
    del data
    while branch and len(found) < len(KINDS):
        inner = next(branch[-1], None)
        if inner is None:
            branch.pop()
            continue
        mark = blake2b(inner, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        found |= _plain_kinds(inner)
        branch.append(_contents(inner))
        del inner
    return found


def _mark(text: str) -> bytes:
    digest = blake2b(digest_size=16)
    for i in range(0, len(text), STEP):
        digest.update(text[i : i + STEP].encode("utf-8", "surrogatepass"))
    return digest.digest()


def _holds_more(raw: bytes) -> bool:
    """Whether a secret, an escape or a base64 run stands in the bytes."""
    return bool(_plain_kinds(raw) or _may_escape(raw) and _ESCAPED_BYTES.search(raw) or any(r.search(raw) for r in _BASE64_BYTES))


def _unwrapped(layer: Layer):
    """Layers inside base64 runs, and (start, end, content) of compressed data in them.

    A run is read in four alignments, since what stands right before it looks like a part of it. Bytes are
    read one by one (latin-1): secrets and encodings are ASCII, so it does not matter what else there is.
    """
    for pattern in _BASE64:
        for m in pattern.finditer(layer.text):
            run = m[0].encode()
            clean = run.translate(_STANDARD, b" \t\r\n=")
            if len(clean) < LEAST_RUN:
                continue
            lines = None
            for skip in range(4):
                raw = _aligned(clean, skip)
                if len(raw) <= SHORT and not _may_hold(raw):
                    continue
                lines = lines or _lines_of(run, m.start())
                place = _Run(*lines, len(clean), m.end(), skip)
                for first, after, content in _packed(raw):
                    yield (*layer.origin(*place.span(first, min(after, len(raw)))), content)
                if _holds_more(raw):
                    yield Layer(raw.decode("latin-1"), (*layer.maps, place))


def _lines_of(run: bytes, start: int) -> tuple[array, array]:
    """(characters before each unbroken stretch of a run, where the stretch stands)."""
    before, starts, n = array("q"), array("q"), 0
    for stretch in _STRETCH.finditer(run):
        before.append(n)
        starts.append(start + stretch.start())
        n += stretch.end() - stretch.start()
    return before, starts


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and kind, of a whole text.

    A worklist holds layers still to be looked into. Each layer is scanned, its escapes are decoded as a
    whole and its base64 runs one by one; what comes out goes on the list unless the same text over the same
    place has been there, so the list ends. Spans of inner layers are those of the document's characters
    that they were decoded from; compressed data is one place, and all that is inside has its span.
    """
    text = text or ""
    base = base_spans(text)
    every = set(base)
    todo, seen = deque([Layer(text)]), set()
    while todo:
        layer = todo.popleft()
        for inner in chain(filter(None, [_unescaped(layer)]), _unwrapped(layer)):
            if isinstance(inner, tuple):
                start, end, content = inner
                mark = (start, end), blake2b(content, digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    every.update((start, end, kind) for kind in _kinds_inside(content))
                continue
            if not inner.text:
                continue
            mark = inner.origin(0, len(inner.text)), _mark(inner.text)
            if mark in seen:
                continue
            seen.add(mark)
            every.update((*inner.origin(a, b), kind) for a, b, kind in base_spans(inner.text))
            todo.append(inner)

    def order(s):
        return s[0], KINDS.index(s[2]), s[1]

    return sorted(base, key=order), sorted(every, key=order)


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; null text is empty.

    One pass over the texts, no shuffle. Held in memory, next to the text: the layers that it spells out (at
    most a few are open at a time, each no longer than the text), 25 bytes for each escape of a layer and 16 for
    each line of a base64 run, to lead spans back. Unpacked layers beyond IN_MEMORY lie in unnamed files of the
    worker's temp folder.
    """
    import pyarrow as pa

    def joined(spans) -> str:
        return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)

    def find(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                got = [scan(t) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
                digests = pa.array([sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, digests, pa.array([joined(every) for _, every in got], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def wrapped(text: str, *how: str) -> str:
    """Encode `text` step by step: url, unicode, base64 or gzip (then base64). For tests and examples."""
    for step in how:
        if step == "url":
            text = "".join(f"%{b:02X}" for b in text.encode())
        elif step == "unicode":
            text = "".join(f"\\u{ord(c):04x}" for c in text)
        elif step == "base64":
            text = base64.b64encode(text.encode()).decode()
        else:
            text = base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()
    return text
