"""Formatting conversations for training (operator 10).

Turns are dealt out by conversation, sorted in the task and streamed through a compiled template
(templates.py), one output row per PART turns: a conversation of any length needs the memory of one
part. A row holds the formatted text and the spans of it that carry loss. Control strings inside
roles and texts are escaped so that the turns can be read back from the output exactly.

Defined results: null roles and texts count as ''; turns of one number are ordered by role, then
text; repeated rows are turns of their own; rows with a null conv_id form one conversation, null
turns come first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wavefield.llm.common import table
from wavefield.llm.templates import compile_template

TEMPLATE = (
    "{% for turn in turns %}<|im_start|>{{ turn.role | label }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
#: Strings with a meaning of their own to the formats and tokenizers in use.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|", "<s>", "</s>", "[INST]", "[/INST]")
PART = 1_000
PARTS = "conv_id long, part long, text string, loss array<struct<start: int, stop: int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_BACK = {"\\": "\\", "e": "", "n": "\n"}
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    r"""text with every \ doubled and \e after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\e" + m[0][1:], text.replace("\\", "\\\\"))


def label(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


FILTERS = {"escape": escape, "label": label}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, values) of rows one by one, the first column being the key."""
    for batch in batches:
        yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)


def _formatter(template: str, part: int):
    def render(conv_id: int | None, number: int, turns: list[dict], write) -> tuple:
        pieces, spans, at = [], [], 0
        for text, generated in write({"turns": turns, "part": number}):
            if generated and text:
                spans.append({"start": at, "stop": at + len(text)})
            pieces.append(text)
            at += len(text)
        return conv_id, number, "".join(pieces), spans

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template, FILTERS)
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
        names = ["conv_id", "part", "text", "loss"]
        made, key, number, turns = [], None, 0, []

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)
            made.clear()
            return out

        for conv_id, role, text in _runs(batches):
            if turns and (conv_id != key or len(turns) == part):
                made.append(render(key, number, turns, write))
                number = number + 1 if conv_id == key else 0
                turns = []
                if len(made) >= 1_000:
                    yield batch()
            key = conv_id
            turns.append({"role": role or "", "text": text or ""})
        if turns:
            made.append(render(key, number, turns, write))
        if made:
            yield batch()

    return form


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part: int = PART) -> DataFrame:
    """One row per part of a conversation: conv_id, part, the formatted text and its loss spans.
    Parts of a conversation follow each other within one partition."""
    dealt = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_formatter(template, part), PARTS)


def read_turns(text: str) -> Iterable[tuple[str, str]]:
    """(role, text) of each turn of a formatted text in TEMPLATE's format."""
    return ((unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    key, n, loss_chars, chars, turns, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    for conv_id, part, text, spans in _runs(batches):
        if part == 0:
            if n:
                done.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            key, n, loss_chars, chars, turns, loss = conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for role, said in read_turns(text):
            turns.update(f"{role}\n{said}\n".encode())
            n += 1
        for span in spans:
            said = unescape(text[span["start"] : span["stop"]])
            loss.update(said.encode())
            loss_chars += len(said)
        chars += len(text)
        if len(done) >= 10_000:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
    if n:
        done.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
    if done:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from the formatted parts."""
    return parts.mapInArrow(_digest, DIGEST)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(extra)))


QUERIES = {"op10_chat_format": op10_chat_format}
ORACLES = {
    # sha256 of a concatenation is the same; formatted_chars follows from the escapes of the format
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
        + 2 * len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]')) AS chars,
        length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, chr(10), ''))
        + 2 * len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]')) AS role_chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(chars + role_chars + 12 + 1 + 10 + 1) AS formatted FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM g"""
}
