"""What a contract promises."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

CONTRACT_VERSION = 1
UNITS = {"m": (60, "minute"), "h": (3600, "hour"), "d": (86400, "day"), "w": (604800, "week")}


class Severity(str, Enum):
    FAIL = "fail"
    WARN = "warn"
    IGNORE = "ignore"


class Cardinality(str, Enum):
    MANY_TO_ONE = "many_to_one"
    ONE_TO_ONE = "one_to_one"


def _duration(value: str) -> tuple[int, str] | None:
    m = re.fullmatch(r"\s*(\d+)\s*([mhdw])\s*", str(value), re.I)
    return (int(m[1]), m[2].lower()) if m else None


def seconds_of(value: str) -> int:
    """24h as 86400."""
    d = _duration(value)
    if d is None:
        raise ValueError(f"{value!r} is no duration; write a number and m, h, d or w, such as 24h")
    if d[0] <= 0:
        raise ValueError("a freshness window has to be longer than nothing")
    return d[0] * UNITS[d[1]][0]


def spoken(value: str) -> str:
    """24h as 24 hours."""
    d = _duration(value)
    return f"{d[0]} {UNITS[d[1]][1]}{'s' * (d[0] != 1)}" if d else str(value)


@dataclass
class ColumnContract:
    """Every clause is optional; None means unchecked."""

    name: str
    means: str | None = None
    type: str | None = None
    nullable: bool | None = None
    max_null_rate: float | None = None
    unique: bool | None = None
    formats: list[str] = field(default_factory=list)
    categories: list[str] | None = None
    categories_closed: bool = False
    minimum: Any = None
    maximum: Any = None
    fresh_within: str | None = None
    no_pii: bool = False
    known_issues: list[str] = field(default_factory=list)
    ignore: bool = False
    on_violation: Severity | None = None


@dataclass
class TableRule:
    expr: str
    name: str | None = None
    means: str | None = None
    max_violation_rate: float | None = None
    known_issues: list[str] = field(default_factory=list)
    ignore: bool = False
    on_violation: Severity | None = None

    @property
    def label(self) -> str:
        return self.name or self.expr


@dataclass
class TableContract:
    name: str
    source: str = ""
    profile_fingerprint: str = ""
    min_rows: int | None = None
    volume_tolerance: float | None = None
    allow_new_columns: bool = True
    allow_missing_columns: bool = False
    columns: dict[str, ColumnContract] = field(default_factory=dict)
    rules: list[TableRule] = field(default_factory=list)
    on_violation: Severity | None = None
    #: Written as comments, never read back.
    suggested_rules: list[str] = field(default_factory=list)

    def column(self, name: str) -> ColumnContract | None:
        return self.columns.get(name)


@dataclass
class Relationship:
    """from_table.from_column (child) refers to to_table.to_column (parent)."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    cardinality: Cardinality = Cardinality.MANY_TO_ONE
    max_orphan_rate: float | None = None
    means: str | None = None
    known_issues: list[str] = field(default_factory=list)
    ignore: bool = False
    on_violation: Severity | None = None

    @property
    def child(self) -> str:
        return f"{self.from_table}.{self.from_column}"

    @property
    def parent(self) -> str:
        return f"{self.to_table}.{self.to_column}"

    @property
    def key(self) -> str:
        return f"{self.child}->{self.parent}"


@dataclass
class Contract:
    version: int = CONTRACT_VERSION
    generated_by: str = ""
    generated_at: str = ""
    on_violation: Severity = Severity.FAIL
    tables: dict[str, TableContract] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)

    def table(self, name: str) -> TableContract | None:
        return self.tables.get(name)

    def relationships_for(self, table: str) -> list[Relationship]:
        return [r for r in self.relationships if table in (r.from_table, r.to_table)]

    def severity(self, base: Severity, table: TableContract | None = None, column: ColumnContract | None = None) -> Severity:
        """The column's own setting, else the table's; then warnings stay warnings and failures follow the contract's default."""
        own = next((x.on_violation for x in (column, table) if x is not None and x.on_violation is not None), None)
        if own is not None:
            return own
        return Severity.WARN if base is Severity.WARN else self.on_violation
