"""Declarative specs: sources, columns, transforms, features. Plain frozen dataclasses."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark import fixed_values as fx

ISSUE_SCHEMA = ("code string, severity string, source string, `column` string, n bigint, "
                "details map<string,string>")


@dataclass(frozen=True)
class ColumnSpec:
    """A raw column, its role, its name in the weekly table and the fill of a control."""

    name: str
    role: str
    output_name: str | None = None
    fill: str | None = None

    @property
    def series(self) -> str:
        return self.output_name or self.name


@dataclass(frozen=True)
class Transform:
    op: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Feature:
    name: str
    op: str
    inputs: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class SourceSpec:
    """One raw table: where its date is, which columns count, and how to clean it first."""

    name: str
    columns: tuple[ColumnSpec, ...]
    date_column: str | None = None
    essential: bool = True
    transforms: tuple[Transform, ...] = ()

@dataclass(frozen=True)
class EventDummy:
    name: str
    weeks: tuple[tuple[int, int], ...]


def spec_problems(sources: Iterable[SourceSpec]) -> list[tuple[str, str, str | None]]:
    """(code, source, column) of all that is wrong with declared sources, in the order they are declared."""
    found, seen = [], set()
    for s in sources:
        if s.name in seen:
            found.append(("source_named_twice", s.name, None))
        seen.add(s.name)
        if not s.columns:
            found.append(("source_without_columns", s.name, None))
        outputs = Counter(c.series for c in s.columns)
        for c in s.columns:
            tests = {"unknown_role": c.role not in fx.ROLES, "unknown_fill": c.fill is not None and c.fill not in fx.FILLS,
                     "fill_needs_control": c.fill is not None and c.role != "control", "output_named_twice": outputs[c.series] > 1}
            found += [(code, s.name, c.name) for code, wrong in tests.items() if wrong]
    return found


def issue_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Issues known from declarations alone, e.g. a missing column."""
    return spark.createDataFrame(rows, ISSUE_SCHEMA)
