"""Chat formatting: typed content parts, reversible escapes, loss spans and attachment records."""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions, table

TURN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
LEARNT = "assistant"
# Strings that a chat template may read as control, here and elsewhere.
CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SEGMENT = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(BODY) + r"(.*)" + re.escape(CLOSE), re.DOTALL)
IMAGE_TILE, IMAGE_TILE_TOKENS, IMAGE_BASE_TOKENS = 512, 170, 85
AUDIO_TOKENS_A_SECOND = 25
PAGE_TOKENS = 256

PARTS = "array<struct<kind:string,text:string,ref:string,width:long,height:long,length:double>>"
FORMATTED = (
    "conv_id long, turn long, role string, segment string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<kind:string,ref:string,position:long,tokens:long>>"
)


def escape(text: str) -> str:
    """A backslash goes behind the first character of every control string and before every backslash."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visits the parts of a turn in order and writes them as text and placeholders.

    `text` is the body so far, `texts` the spans of it that are text parts, `attachments` what each
    placeholder stands for, where it is and how many tokens it will expand to.
    """

    def __init__(self, start: int):
        self.out: list[str] = []
        self.at = start
        self.texts: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part["kind"] or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def _write(self, s: str) -> int:
        self.out.append(s)
        self.at += len(s)
        return self.at - len(s)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        at = self._write(f"<|{kind}|>")
        self.attachments.append({"kind": kind, "ref": part["ref"], "position": at, "tokens": tokens})

    def visit_text(self, part: dict) -> None:
        at = self._write(escape(part["text"] or ""))
        self.texts.append({"start": at, "end": self.at})

    def visit_image(self, part: dict) -> None:
        """A base and a price for each tile; without a size, one tile."""
        across, down = (-(-max(1, part[side] or 1) // IMAGE_TILE) for side in ("width", "height"))
        self._attach("image", part, IMAGE_BASE_TOKENS + IMAGE_TILE_TOKENS * across * down)

    def visit_audio(self, part: dict) -> None:
        """`length` is in seconds; a started second counts in proportion, one token at least."""
        self._attach("audio", part, max(1, int((part["length"] or 0.0) * AUDIO_TOKENS_A_SECOND + 0.999999)))

    def visit_document(self, part: dict) -> None:
        """`length` is in pages, one at least."""
        self._attach("document", part, PAGE_TOKENS * max(1, int(part["length"] or 1)))

    def visit_unknown(self, part: dict) -> None:
        """A part of another kind keeps its place and its reference; it expands to one token."""
        self._attach("other", part, 1)


def format_turns(conversations: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """Each turn as a segment of its conversation's text; segments in order of turn are the conversation.

    (conv_id, turn, role, segment, loss, attachments). `loss` has the spans of the segment that a model
    learns: text parts of `learnt` turns. If there is a column `parts` (PARTS), it is used where it is not
    null; else `text` is the only part. Null text and null role are empty; an empty list of parts is an
    empty body. Turns need no order here and no turn waits for another. Further columns are not read.
    """
    import pyarrow as pa

    columns = [
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"),
        (F.col("parts") if "parts" in conversations.columns else F.lit(None)).cast(PARTS).alias("parts"),
    ]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    record = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))

    def write(batches):
        for batch in batches:
            segments, losses, attached = [], [], []
            for role, text, parts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                head = TURN + escape(role or "") + BODY
                flat = Flatten(len(head))
                for part in [{"kind": "text", "text": text}] if parts is None else parts:
                    if part is not None:
                        flat.visit(part)
                segments.append(head + "".join(flat.out) + CLOSE)
                losses.append(flat.texts if role == learnt else [])
                attached.append(flat.attachments)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(segments, pa.string()), pa.array(losses, span), pa.array(attached, record)],
                ["conv_id", "turn", "role", "segment", "loss", "attachments"],
            )

    return conversations.select(*columns).mapInArrow(write, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text says, by conversation: roles, texts and what the loss mask covers.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Roles and texts are parsed
    from the segments and unescaped. Turns are sorted by the shuffle and streamed through running digests,
    so a conversation with a third of all turns takes no more memory than a short one. Equal turn numbers
    go by role and text; a null turn is the first and a null conv_id a conversation of its own.
    """
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches):
        now, state, out = object(), None, []

        def close():
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, segment, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, sha256(), 0, sha256(), 0]
                role, body = _SEGMENT.fullmatch(segment).groups()
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = unescape(segment[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if len(out) >= 1024:
                yield rows()
                out = []
        close()
        if out:
            yield rows()

    return (
        formatted.select("conv_id", "turn", "role", "segment", "loss")
        .repartition(partitions(formatted.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "segment")
        .select("conv_id", "segment", "loss")
        .mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def chat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose turns say nothing but control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return read_back(format_turns(turns.unionByName(extra)))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '<\\||</?s>|\\[/?INST\\]|<</?SYS>>|\\\\', 'x\\0', 'g') AS longer,
         regexp_replace(role, '<\\||</?s>|\\[/?INST\\]|<</?SYS>>|\\\\', 'x\\0', 'g') AS longer_role FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(longer) + length(longer_role) + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
