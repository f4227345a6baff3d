"""Spans of a pattern in whole texts, with code-point offsets, in column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def find(text: Column, pattern: str, kind: str, when: Column | None = None) -> Column:
    """All leftmost non-overlapping matches: the texts between them and the matches, side by side, give the offsets.

    ``when`` is a cheap test that must hold for any match. A null text has no spans.
    """
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("value")))

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + F.char_length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("pos"), F.array_append(acc["out"], span).alias("out")))

    walk = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), no_spans().alias("out")), step, lambda acc: acc["out"])
    has = text.rlike(pattern)
    return F.when(has if when is None else when & has, walk).otherwise(no_spans())


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def in_order(spans: Column, kinds: list[str], by_kind_first: bool = False) -> Column:
    """Sort by start and then the place of the kind in ``kinds``, or the other way round."""
    def place(s):
        return reduce(lambda acc, k: acc.when(s["kind"] == k, kinds.index(k)), kinds, F.when(F.lit(False), -1))

    def key(s):
        first, second = (place(s), s["start"]) if by_kind_first else (s["start"], place(s))
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), s.alias("span"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: x["span"])


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one mark. ``spans`` are sorted by start."""
    def step(acc, s):
        lead = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], text.substr(acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark)))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.coalesce(lead, acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["pos"] + 1, F.char_length(text)))))
