"""Chat formatting: canonical turns between marks, control strings escaped reversibly, and the mask that training learns from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chat_layouts import canonical_turns
from tidemark.llm.common import stored, table
from tidemark.llm.registry import query

PIECE = 1 << 20             # characters after which a conversation goes on in another row
OUT = 1 << 23               # characters that leave a task at once


@dataclass(frozen=True)
class Template:
    """``open`` role ``head`` text ``close`` per turn. Backslashes are doubled, marks inside texts get one before them."""

    open: str = "<turn "
    head: str = ">\n"
    close: str = "</turn>\n"
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = (self.open, self.head, self.close)
        if any(not m or "\\" in m or m[0] in m[1:] for m in marks) or self.open[0] in self.close[1:] or self.close[0] in self.open[1:]:
            raise ValueError("a mark's first character must occur nowhere else in the marks around a text, and no mark may hold a backslash")

    def escaped(self, text: str) -> str:
        if "\\" in text or self.open in text or self.close in text:
            return re.sub("|".join(map(re.escape, ("\\", self.open, self.close))), lambda m: "\\" + m[0], text)
        return text

    def escaped_role(self, role: str) -> str:
        firsts = {"\\", self.open[0], self.head[0], self.close[0]}
        return "".join("\\" + c if c in firsts else c for c in role)

    @staticmethod
    def plain(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def written(self, role: str, text: str) -> tuple[str, int, int]:
        """A formatted turn, and where its text starts and ends."""
        head, body = f"{self.open}{self.escaped_role(role)}{self.head}", self.escaped(text)
        return head + body + self.close, len(head), len(head) + len(body)

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn."""
        i = 0
        while i < len(formatted):
            if not formatted.startswith(self.open, i):
                raise ValueError(f"no turn starts at character {i}")
            start = i + len(self.open)
            middle = _unescaped(formatted, self.head, start)
            end = _unescaped(formatted, self.close, middle + len(self.head))
            yield self.plain(formatted[start:middle]), self.plain(formatted[middle + len(self.head):end])
            i = end + len(self.close)


def _unescaped(s: str, mark: str, start: int) -> int:
    """Where ``mark`` next stands with an even number of backslashes before it."""
    i = s.find(mark, start)
    while i >= 0:
        j = i
        while j > start and s[j - 1] == "\\":
            j -= 1
        if (i - j) % 2 == 0:
            return i
        i = s.find(mark, i + 1)
    raise ValueError(f"a turn that starts before character {start} does not end")


def in_order(df: DataFrame, *order) -> DataFrame:
    """Rows dealt by ``key``, each key's rows one after the other in ``order``: tasks stream through them."""
    return df.repartition("key").sortWithinPartitions("key", *order)


def _format(template: Template, piece: int):
    def run(batches):
        schema = None
        done, chars = [], 0
        key, part, texts, size, loss = None, 0, [], 0, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            if schema is None:
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                schema = pa.schema([("key", batch.schema.field("key").type), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])
            roles, said = batch.column("role"), batch.column("text")
            for i, k in enumerate(batch.column("key").to_pylist()):
                if texts and (k != key or size >= piece):
                    done.append((key, part, "".join(texts), loss))
                    chars += size
                    part, texts, size, loss = part + 1, [], 0, []
                if k != key:
                    key, part = k, 0
                role = roles[i].as_py() or ""
                turn, a, b = template.written(role, said[i].as_py() or "")
                if role in template.learn:
                    loss.append({"start": size + a, "end": size + b})
                texts.append(turn)
                size += len(turn)
                if chars > OUT or len(done) > 10_000:
                    yield batch_of(done)
                    done, chars = [], 0
        if texts:
            done.append((key, part, "".join(texts), loss))
        if done:
            yield batch_of(done)

    return run


def format_chats(turns: DataFrame, template: Template = Template(), piece: int = PIECE) -> DataFrame:
    """(key, part, formatted, loss): every conversation as one text, cut between turns into parts of about ``piece`` characters.

    ``turns`` has key, turn, position, role, text, as :func:`chat_layouts.canonical_turns` gives them. ``loss`` holds the
    code points [start, end) of ``formatted`` that are text of a role the template learns from, without the marks.
    Turns come by turn (nulls first), then position, role and text, so that ties and repeated rows have a defined order.
    Null roles and texts are empty; a null key is a conversation like any other; no turns give no rows. Other columns
    are not read. A conversation streams through one task, which holds one part of it; it may have any number of turns.
    """
    rows = in_order(turns.select("key", "turn", "position", "role", "text"), F.asc_nulls_first("turn"), "position", "role", "text")
    return rows.mapInArrow(_format(template, piece),
                           f"key {turns.schema['key'].dataType.simpleString()}, part long, formatted string, loss array<struct<start:long,end:long>>")


def _digest(template: Template):
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        rows, schema = [], None
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        key, held, state = None, False, fresh()
        close = lambda: (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            schema = schema or [batch.schema.field("key").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            texts, masks = batch.column("formatted"), batch.column("loss")
            for i, k in enumerate(batch.column("key").to_pylist()):
                if held and k != key:
                    rows.append(close())
                    state = fresh()
                key, held = k, True
                formatted = texts[i].as_py()
                for role, text in template.read(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in masks[i].as_py():
                    text = template.plain(formatted[span["start"]:span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema)], names)
                rows = []
        if held:
            rows.append(close())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema)], names)

    return run


def read_digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation of :func:`format_chats`, from its formatted text and mask alone: number of turns, SHA-256 of all
    roles and texts, code points and SHA-256 of what is learned, code points of the whole."""
    return in_order(formatted.select("key", "part", "formatted", "loss"), "part").mapInArrow(
        _digest(template), f"key {formatted.schema['key'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
        "loss_chars long, loss_sha256 string, formatted_chars long")


def read_turns(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(key, part, position, role, text): the turns of formatted conversations, as they were before formatting."""
    def run(batches):
        for batch in batches:
            for k, part, text in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "formatted"))):
                said = list(template.read(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(said), batch.schema.field("key").type), pa.array([part] * len(said), pa.int64()), pa.array(range(len(said)), pa.int64()),
                     pa.array([r for r, _ in said], pa.string()), pa.array([t for _, t in said], pa.string())], ["key", "part", "position", "role", "text"])

    return formatted.select("key", "part", "formatted").mapInArrow(
        run, f"key {formatted.schema['key'].dataType.simpleString()}, part long, position long, role string, text string")


@query("op13_chat_format")
def op13_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    records = rows.select(F.col("conv_id").cast("long").alias("conv_id"),
                          F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    planted = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"),
                                  F.to_json(F.struct(F.lit(planted).alias("prompt"), F.lit(planted).alias("response"))).alias("record"))
    formatted = stored(format_chats(canonical_turns(records.unionByName(extra), "conv_id", "record")), "chats")
    return read_digests(formatted).withColumnRenamed("key", "conv_id")
