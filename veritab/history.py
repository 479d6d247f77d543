"""Counts of past runs, one small file for each table, and the trend of the number of rows."""

from __future__ import annotations

import json
import os
import statistics
from dataclasses import dataclass
from datetime import datetime, timezone

from .contract.findings import Finding, Violation, base_severity
from .contract.model import Contract, Severity
from .model import TableProfile

FOLDER = os.path.join(".veritab", "history")
MOST_RUNS = 100
LEAST_RUNS = 3
#: A drop that warns where the contract has no tolerance of its own.
TOLERANCE = 0.4


@dataclass(frozen=True)
class Snapshot:
    at: str
    rows: int
    fingerprint: str = ""
    columns: dict[str, dict[str, int]] | None = None

    def line(self) -> str:
        return json.dumps({"at": self.at, "rows": self.rows, "fp": self.fingerprint, "cols": self.columns or {}}, separators=(",", ":"), ensure_ascii=False)


def snapshot(p: TableProfile, at: datetime | None = None) -> Snapshot:
    return Snapshot((at or datetime.now(timezone.utc)).isoformat(timespec="seconds"), p.row_count, p.fingerprint(), {c.name: {"nulls": c.null_count, "distinct": c.distinct_count} for c in p.columns})


def path_of(table: str, folder: str = FOLDER) -> str:
    return os.path.join(folder, ("".join(c if c.isalnum() or c in "_-." else "_" for c in table) or "table") + ".jsonl")


def read(table: str, folder: str = FOLDER) -> list[Snapshot]:
    """The runs, oldest first. Lines that cannot be read are passed over."""
    out = []
    try:
        with open(path_of(table, folder), encoding="utf-8") as f:
            lines = f.read().splitlines()
    except (OSError, UnicodeDecodeError):
        return []
    for line in lines:
        try:
            d = json.loads(line)
            out.append(Snapshot(str(d["at"]), int(d["rows"]), str(d.get("fp", "")), dict(d.get("cols", {}))))
        except (ValueError, KeyError, TypeError):
            continue
    return out


def append(table: str, s: Snapshot, folder: str = FOLDER) -> None:
    """Adds a run and drops those beyond MOST_RUNS. A folder that can't be written to is no error: the check is over by then."""
    try:
        os.makedirs(folder, exist_ok=True)
        ignore = os.path.join(os.path.dirname(folder) or folder, ".gitignore")
        if not os.path.exists(ignore):
            with open(ignore, "w", encoding="utf-8") as f:
                f.write("# counts of past runs; remove this file to share them\n*\n")
        runs = [*read(table, folder), s][-MOST_RUNS:]
        with open(path_of(table, folder), "w", encoding="utf-8") as f:
            f.write("".join(r.line() + "\n" for r in runs))
    except OSError:
        return


@dataclass(frozen=True)
class Trend:
    current: int
    baseline: int
    runs: int

    @property
    def drop(self) -> float:
        return max(0.0, (self.baseline - self.current) / self.baseline) if self.baseline > 0 else 0.0


def trend(runs: list[Snapshot], rows: int) -> Trend | None:
    """rows against the median of the runs; None with too few of them, or of nothing but empty ones."""
    if len(runs) < LEAST_RUNS:
        return None
    usual = int(statistics.median(r.rows for r in runs))
    return Trend(rows, usual, len(runs)) if usual > 0 else None


def check_volume(contract: Contract, p: TableProfile, runs: list[Snapshot]) -> list[Violation]:
    """A drop beyond the tolerance: a failure where the contract sets one, else a warning."""
    t, seen = contract.table(p.name), trend(runs, p.row_count)
    if t is None or seen is None:
        return []
    own = t.volume_tolerance is not None
    allowed = t.volume_tolerance if own else TOLERANCE
    severity = Severity.FAIL if own else base_severity(Finding.VOLUME_DROP)
    if seen.drop <= allowed:
        return []
    return [Violation(Finding.VOLUME_DROP, p.name, severity, expected=f"about {seen.baseline:,} rows, the median of {seen.runs} runs, less {allowed:.0%} at most", found=f"{seen.current:,} rows, {seen.drop:.0%} fewer", remedy="look for a partition, a day or a source that did not arrive", evidence={"rows": seen.current, "baseline": seen.baseline, "drop": round(seen.drop, 6), "runs": seen.runs})]
