"""A profile against a contract. No data is read here."""

from __future__ import annotations

from datetime import datetime, timezone

from .. import __version__
from ..model import ColumnProfile, Kind, Seen, TableProfile
from .findings import Finding, Report, Violation, base_severity, quoted_list, rows_of
from .generate import date_part
from .model import ColumnContract, Contract, Severity, TableContract, seconds_of, spoken

# Which types and families a contract's type accepts, and from where on findings are made.
TEXTUAL = frozenset(["text", "email", "url", "uuid", "json"])
MOMENTS = frozenset(["date", "timestamp"])
ACCEPTS = {"float": {"float", "integer"}, "timestamp": {"timestamp", "date"}, "text": TEXTUAL}
#: Of a profile's mixture, which has five families only; textual types and booleans are text there.
FAMILY_ACCEPTS = {"integer": {"integer"}, "float": {"float", "integer"}, "date": {"date"}, "timestamp": {"timestamp", "date"}, "text": {"text", "integer", "float", "date", "timestamp"}}
CONTAMINATION_FLOOR = 0.001
FOREIGN_SHAPE_RATE = 0.01
UNIT_SHIFT = 10.0

F = Finding
#: One cause, one finding: what the key explains is not told again.
EXPLAINS = {
    F.TYPE_CHANGED: {F.TYPE_CONTAMINATED, F.FORMAT_CHANGED, F.NEW_CATEGORY, F.RANGE_EXCEEDED, F.UNIT_SHIFT_SUSPECTED, F.CATEGORIES_UNVERIFIABLE},
    F.TYPE_CONTAMINATED: {F.FORMAT_CHANGED},
    F.UNIT_SHIFT_SUSPECTED: {F.RANGE_EXCEEDED},
}
#: Observations that are findings where the contract does not know them: (finding, patterns that count, what it looks like).
NEWS = {
    Seen.EPOCH_SUSPECTED: (F.EPOCH_SUSPECTED, ("epoch_seconds", "epoch_millis"), "read like Unix times"),
    Seen.EXCEL_SERIAL_SUSPECTED: (F.EXCEL_SERIAL_SUSPECTED, ("excel_serial",), "read like a spreadsheet's day numbers"),
    Seen.NULL_WORDS: (F.NULL_WORDS_APPEARED, ("null_word",), "are words for nothing, which no null check sees"),
    Seen.MOJIBAKE: (F.MOJIBAKE_APPEARED, ("mojibake",), "were decoded with the wrong encoding"),
    Seen.MIXED_BOOLEAN_ENCODING: (F.MIXED_BOOLEAN_ENCODING, (), "spell true and false in several ways"),
}


def accepts(contracted: str, found: str) -> bool:
    return contracted == found or found in ACCEPTS.get(contracted, ())


def family_accepts(contracted: str, family: str) -> bool:
    return family in FAMILY_ACCEPTS.get(contracted, FAMILY_ACCEPTS["text"])


def _mix(mixture: dict[str, float]) -> str:
    return ", ".join(f"{v:.1%} {k}" for k, v in sorted(mixture.items(), key=lambda x: -x[1]) if v > 0)


def read_moment(text: str | None) -> datetime | None:
    """A moment in UTC; without a zone it is UTC, without a time it is midnight. None if unreadable."""
    raw = (text or "").strip()
    for form in (raw.replace("Z", "+00:00"), date_part(raw) or ""):
        try:
            at = datetime.fromisoformat(form)
        except ValueError:
            continue
        return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    return None


def _bound(value, temporal: bool, now: datetime):
    """A bound as something to compare with: a date's text, a number, or None."""
    if value is None:
        return None
    if str(value).strip().lower() in ("today", "now"):
        return now.date().isoformat() if str(value).strip().lower() == "today" else now.isoformat(timespec="seconds")
    if temporal:
        return date_part(str(value)) if len(str(value)) >= 10 else str(value)
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


class _Column:
    """The findings about one column."""

    def __init__(self, p: ColumnProfile, c: ColumnContract, now: datetime) -> None:
        self.p, self.c, self.now = p, c, now
        self.found: list[tuple[Finding, dict]] = []

    def say(self, kind: Finding, **told) -> None:
        self.found.append((kind, told))

    def type(self) -> None:
        p, want = self.p, self.c.type
        if not want or p.inferred_type is Kind.EMPTY:
            return
        have = p.inferred_type.value
        if p.inferred_type is Kind.MIXED:
            changed = sum(v for k, v in p.type_mixture.items() if family_accepts(want, k)) < 0.5
        else:
            changed = not accepts(want, have)
        if changed:
            seen = _mix(p.type_mixture) if p.inferred_type is Kind.MIXED else f"{have}, sure by {p.type_confidence:.0%}"
            self.say(F.TYPE_CHANGED, expected=f"type {want}", found=seen, remedy=f"repair the source, or write type: {have}", evidence={"expected_type": want, "found_type": have, "mixture": p.type_mixture})
            return
        odd = {k: v for k, v in p.type_mixture.items() if v > 0 and not family_accepts(want, k)}
        part = sum(odd.values())
        if odd and part >= CONTAMINATION_FLOOR and Seen.MIXED_TYPES.value not in self.c.known_issues:
            self.say(
                F.TYPE_CONTAMINATED, expected=f"type {want}", found=f"{rows_of(round(part * p.valued_count), p.valued_count)} are of other types: {_mix(p.type_mixture)}",
                detail="shapes: " + ", ".join(f"{s.shape} ({s.count:,})" for s in p.shapes[:3]), remedy="repair the source, or widen the type", evidence={"expected_type": want, "contamination": round(part, 6), "offending": odd},
            )

    def format(self) -> None:
        odd = [s for s in self.p.shapes if s.shape and s.shape not in self.c.formats and (s.rate or 0) >= FOREIGN_SHAPE_RATE]
        if self.c.formats and odd:
            self.say(F.FORMAT_CHANGED, expected="shapes " + quoted_list(self.c.formats), found=", ".join(f"'{s.shape}', {rows_of(s.count, self.p.valued_count)}" for s in odd[:3]), remedy="repair the source, or add the shape to formats", evidence={"allowed": list(self.c.formats), "found": [s.shape for s in odd]})

    def categories(self) -> None:
        c, e = self.c, self.p.enum
        if c.categories is None or not c.categories_closed:
            return
        want = "only " + quoted_list(c.categories)
        if e is None or not e.complete:
            self.say(F.CATEGORIES_UNVERIFIABLE, expected=want, found=f"{self.p.distinct_count:,} different values, more than were listed", remedy="profile with a higher max_enum_cardinality, or open the set")
            return
        have = {m.value: m.count for m in e.members}
        new, gone = sorted(have.keys() - set(c.categories)), sorted(set(c.categories) - have.keys())
        if new:
            self.say(F.NEW_CATEGORY, expected=want, found="also " + ", ".join(f"'{v}' ({have[v]:,} rows)" for v in new[:5]), remedy="add it to categories, or repair the source", evidence={"new_categories": new})
        if gone:
            self.say(F.CATEGORY_DISAPPEARED, expected="each of " + quoted_list(c.categories), found="without " + quoted_list(gone), remedy="remove it from categories if it is retired", evidence={"missing_categories": gone})

    def presence(self) -> None:
        p, c = self.p, self.c
        if c.nullable is False and p.null_count > 0:
            self.say(F.NULLABILITY_VIOLATED, expected="no nulls", found=rows_of(p.null_count, p.row_count) + " are null", remedy="repair the source, or allow some with max_null_rate", evidence={"null_count": p.null_count, "null_rate": p.null_rate})
        elif c.max_null_rate is not None and (p.null_rate or 0.0) > c.max_null_rate:
            self.say(F.NULL_RATE_EXCEEDED, expected=f"at most {c.max_null_rate:.1%} nulls", found=rows_of(p.null_count, p.row_count) + " are null", remedy="repair the source, or raise max_null_rate", evidence={"null_rate": p.null_rate, "max_null_rate": c.max_null_rate})

    def uniqueness(self) -> None:
        p = self.p
        if self.c.unique is True and not p.is_unique and not p.distinct_is_approx:
            extra = max(p.non_null_count - p.distinct_count, 0)
            self.say(F.UNIQUENESS_LOST, expected="no value twice", found=f"{extra:,} more rows than different values ({p.non_null_count:,}, {p.distinct_count:,})", detail="joins on this column multiply rows", remedy="remove the repeats at the source, or drop unique", evidence={"duplicates": extra, "distinct": p.distinct_count})

    def range(self) -> None:
        p, c = self.p, self.c
        temporal = c.type in MOMENTS
        low, high = _bound(c.minimum, temporal, self.now), _bound(c.maximum, temporal, self.now)
        stats = p.temporal if temporal else p.numeric
        if stats is None or (low is None and high is None):
            return
        least, most = (date_part(stats.minimum), date_part(stats.maximum)) if temporal else (stats.minimum, stats.maximum)
        under = low is not None and least is not None and least < low
        over = high is not None and most is not None and most > high
        if not under and not over:
            return
        want = f"from {'any' if low is None else low} to {'any' if high is None else high}"
        if over and not temporal and high > 0 and most >= high * UNIT_SHIFT:
            self.say(F.UNIT_SHIFT_SUSPECTED, expected=want, found=f"up to {most:,.2f}, {most / high:.0f} times the limit", detail="so much more is another unit rather than a large value", remedy="ask the source for its unit before any total is trusted", evidence={"observed_max": most, "expected_max": high, "factor": most / high})
            return
        told = [f"down to {least}"] * under + [f"up to {most}"] * over
        self.say(F.RANGE_EXCEEDED, expected=want, found=" and ".join(told), remedy="repair the source, or widen min and max", evidence={"observed_min": least, "observed_max": most})

    def freshness(self) -> None:
        c, t = self.c, self.p.temporal
        newest = read_moment(t.maximum) if t and c.fresh_within and c.type in MOMENTS else None
        if newest is None:
            return
        age, window = (self.now - newest).total_seconds(), seconds_of(c.fresh_within)
        if age > window:
            self.say(F.STALE_DATA, expected=f"something newer than {spoken(c.fresh_within)}", found=f"the newest is of {date_part(t.maximum)}, {age / 3600:,.0f} hours old", detail="the rows that are here are fine; no new ones came", remedy="look at the job that writes this table", evidence={"newest": t.maximum, "age_seconds": int(age), "window_seconds": window})

    def privacy(self) -> None:
        signals = {k: self.p.pattern_hits[k] for k in self.p.pii_signals}
        if self.c.no_pii and signals:
            self.say(F.PII_APPEARED, expected="no personal data", found=", ".join(f"{k} ({n:,} rows)" for k, n in signals.items()), remedy="remove it at the source, or drop no_pii and guard the column", evidence={"signals": signals})

    def news(self) -> None:
        for seen, (kind, patterns, looks) in NEWS.items():
            if self.p.has(seen) and seen.value not in self.c.known_issues:
                n = max((self.p.pattern_hits.get(k, 0) for k in patterns), default=0)
                self.say(kind, found=f"{rows_of(n, self.p.valued_count) if n else 'values'} {looks}", remedy="repair the source, or accept it under known_issues", evidence={"observation": seen.value})

    def all(self) -> list[tuple[Finding, dict]]:
        for part in (self.type, self.format, self.categories, self.presence, self.uniqueness, self.range, self.freshness, self.privacy, self.news):
            part()
        kinds = {k for k, _ in self.found}
        told = set().union(*(EXPLAINS.get(k, set()) for k in kinds)) if kinds else set()
        return [(k, d) for k, d in self.found if k not in told]


def _table(p: TableProfile, t: TableContract) -> list[tuple[Finding, str | None, dict]]:
    out: list[tuple[Finding, str | None, dict]] = []
    if t.min_rows is not None and p.row_count < t.min_rows:
        out.append((F.ROW_COUNT_BELOW_MIN, None, {"expected": f"{t.min_rows:,} rows or more", "found": f"{p.row_count:,} rows", "remedy": "look at the job that makes this table", "evidence": {"row_count": p.row_count, "min_rows": t.min_rows}}))
    have = {c.name for c in p.columns}
    if not t.allow_missing_columns:
        out += [(F.COLUMN_MISSING, n, {"expected": f"a column {n}", "found": "none", "remedy": "restore it, or set allow_missing_columns"}) for n in t.columns if n not in have]
    if not t.allow_new_columns:
        out += [(F.COLUMN_ADDED, None, {"expected": "no other columns", "found": f"a new column {c.name} ({c.inferred_type.value})", "remedy": "add it to the contract, or set allow_new_columns", "evidence": {"column": c.name}}) for c in p.columns if c.name not in t.columns]
    return out


def check(profiles: TableProfile | list[TableProfile], contract: Contract, now: datetime | None = None) -> Report:
    """What the profiles break of the contract."""
    profiles = [profiles] if isinstance(profiles, TableProfile) else profiles
    now = now or datetime.now(timezone.utc)
    now = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now
    by_name = {p.name: p for p in profiles}
    out = Report(checked_at=now.isoformat(timespec="seconds"), version=__version__)

    def add(kind: Finding, t: TableContract, c: ColumnContract | None, column: str | None, told: dict) -> None:
        severity = contract.severity(base_severity(kind), t, c)
        if severity is not Severity.IGNORE:
            if c is not None and c.means and not told.get("detail"):
                told = told | {"detail": c.means}
            out.violations.append(Violation(kind, t.name, severity, column, **told))

    for name, t in contract.tables.items():
        p = by_name.get(name)
        if p is None:
            add(F.TABLE_MISSING, t, None, None, {"expected": f"a table {name}", "found": "no such table was read", "remedy": "give its source, or remove it from the contract"})
            continue
        out.tables_checked += 1
        for kind, column, told in _table(p, t):
            add(kind, t, t.columns.get(column) if column else None, column, told)
        for column, c in t.columns.items():
            cp = p.get(column)
            if cp is None or c.ignore:
                continue
            out.columns_checked += 1
            for kind, told in _Column(cp, c, now).all():
                add(kind, t, c, column, told)
    return out
