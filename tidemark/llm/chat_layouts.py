"""Canonical turns from records of many layouts: a hash of a record's nested field paths selects a declarative mapping."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN_CHARS = 1 << 22        # characters of turns that leave a task at once
SPECIAL = str.maketrans({c: f"\\{c}" for c in "\\.[{"})


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns. Paths name fields by dots.

    ``each`` is a list whose elements hold ``role`` and ``text``; without it these are fields of the record, which is
    then one turn, or ``turns`` lists (role, the fields whose texts make it up). A turn of which no field is in
    ``needs`` is left out where all its texts are empty. ``order`` is the field that places a record among others of its
    conversation; ``roles`` renames roles.
    """

    name: str
    each: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    needs: tuple[str, ...] = ()
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def required(self) -> tuple[str, ...]:
        if self.role is None:
            return self.needs
        return tuple(f"{self.each}[].{p}" if self.each else p for p in (self.role, self.text))

    def fits(self, paths: frozenset[str]) -> bool:
        return all(any(p == r or p.startswith((f"{r}.", f"{r}[", f"{r}{{")) for p in paths) for r in self.required())


COMMON_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content"),
    Layout("conversations", each="conversations", role="from", text="value", roles=COMMON_ROLES),
    Layout("dialogue", each="dialogue", role="speaker", text="text", roles=COMMON_ROLES),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
           needs=("instruction", "output")),
    Layout("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), needs=("prompt", "response")),
    Layout("prompt_completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))),
           needs=("prompt", "completion")),
    Layout("question_answer", turns=(("user", ("context", "question")), ("assistant", ("answer",))), needs=("question", "answer")),
    Layout("row", role="role", text="text", order="turn"),
)


def field_paths(value) -> frozenset[str]:
    """All paths to the leaves of parsed JSON: ``.name`` into objects, ``[]`` into lists, whatever the values are.

    The elements of a list count together. An empty list ends in ``[]``, an empty object in ``{}``.
    """
    found, left = set(), [("", value)]
    while left:
        at, v = left.pop()
        if isinstance(v, dict) and v:
            left += [(f"{at}.{k.translate(SPECIAL)}" if at else k.translate(SPECIAL), x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            left += [(f"{at}[]", x) for x in v]
        else:
            found.add(at + ("[]" if isinstance(v, list) else "{}" if isinstance(v, dict) else ""))
    return frozenset(found)


def fingerprint(paths: Iterable[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


def chosen(paths: frozenset[str], layouts: tuple[Layout, ...]) -> Layout | None:
    """The layout that needs most of the fields there are; the first one listed among equals."""
    return max((x for x in layouts if x.fits(paths)), key=lambda x: len(x.required()), default=None)


def _at(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    """A text: null is empty, a list of parts is its texts in a row, other values are their JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_text(p.get("text")) if isinstance(p, dict) else _text(p) for p in value)
    return json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a parsed record."""
    if layout.role is not None:
        listed = _at(record, layout.each) if layout.each else [record]
        raw = [(_text(_at(x, layout.role)), _text(_at(x, layout.text))) for x in listed]
        return [(layout.roles.get(role, role), text) for role, text in raw]
    out = []
    for role, fields in layout.turns:
        texts = [_text(_at(record, p)) for p in fields]
        if any(texts) or any(p in layout.needs for p in fields):
            out.append((role, "\n\n".join(t for t in texts if t)))
    return out


def _parsed(text: str | None):
    try:
        return json.loads(text or "")
    except ValueError:
        return None


def _convert(layouts: tuple[Layout, ...], key_type: pa.DataType):
    names = ["key", "fingerprint", "layout", "turn", "position", "role", "text"]
    types = [key_type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_paths = functools.lru_cache(4096)(lambda paths: (fingerprint(paths), chosen(paths, layouts)))

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, chars = [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("record")):
                record = _parsed(text.as_py())
                mark, layout = by_paths(field_paths(record))
                if layout is None:
                    rows.append((key, mark, None, None, None, None, None))
                    continue
                order = _at(record, layout.order) if layout.order else None
                order = order if isinstance(order, int) and not isinstance(order, bool) else None
                for i, (role, said) in enumerate(turns_of(record, layout)):
                    rows.append((key, mark, layout.name, order, i, role, said))
                    chars += len(said)
                    if chars > TURN_CHARS or len(rows) > 10_000:
                        yield table(rows)
                        rows, chars = [], 0
        if rows:
            yield table(rows)

    return run


def converted(records: DataFrame, key_column: str, record_column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, fingerprint, layout, turn, position, role, text): the turns of JSON records, one row each.

    A record's fingerprint is a hash of its nested field paths; it selects the mapping, once per fingerprint in a task.
    ``turn`` is the record's place in its conversation where its layout has one, ``position`` the place in the record.
    A record that no layout fits (null, empty and broken JSON too) gives one row whose layout is null, so nothing is lost
    unseen. Null fields are fields: null texts and roles are empty. Records that repeat are each converted. Records
    without a message in their list give no row.
    """
    rows = records.select(F.col(key_column).alias("key"), F.col(record_column).alias("record"))
    key_type = rows.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    return rows.mapInArrow(_convert(layouts, to_arrow_type(key_type)),
                           f"key {key_type.simpleString()}, fingerprint string, layout string, turn long, position long, role string, text string")


def canonical_turns(records: DataFrame, key_column: str, record_column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, position, role, text) of all records that a layout fits; see :func:`converted`."""
    return converted(records, key_column, record_column, layouts).where("layout IS NOT NULL").select("key", "turn", "position", "role", "text")


def layouts_found(records: DataFrame, key_column: str, record_column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, layout, turns): what shapes there are; a null layout is one that no mapping fits."""
    return (converted(records, key_column, record_column, layouts).groupBy("fingerprint", "layout")
            .agg(F.count(F.lit(1)).alias("turns")))
