"""Profiles of tables: measured on the executors, put together at the driver from a few rows for each column."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from .. import __version__
from ..infer import DEFAULT, Thresholds, finish
from ..model import Bucket, Categories, ColumnProfile, Member, NumericStats, TableProfile, TemporalStats, TextStats, rate
from . import histogram as H


class Privacy(str, Enum):
    """strict: categories as hashes. masked: categories as they are, no samples. full: samples too."""

    STRICT = "strict"
    MASKED = "masked"
    FULL = "full"


@dataclass(frozen=True)
class ProfileOptions:
    privacy: Privacy = Privacy.MASKED
    max_enum_cardinality: int = 50
    enum_member_limit: int = 64
    shape_limit: int = 12
    #: Columns that are counted in one job.
    column_batch_size: int = 50
    exact_distinct: bool = True
    include_quantiles: bool = True
    patterns: tuple[str, ...] | None = None
    thresholds: Thresholds = DEFAULT
    samples: int = 5
    #: What counts as now; the clock by default.
    now: datetime | None = None


@dataclass
class _Measured:
    stats: dict[int, dict] = field(default_factory=dict)
    shapes: dict[int, list] = field(default_factory=dict)
    shape_counts: dict[int, int] = field(default_factory=dict)
    members: dict[int, list] = field(default_factory=dict)
    samples: dict[int, list] = field(default_factory=dict)
    queries: int = 0


def _now(o: ProfileOptions) -> Column:
    now = o.now or datetime.now(timezone.utc)
    return F.lit(now.astimezone(timezone.utc).replace(tzinfo=None) if now.tzinfo else now).cast("timestamp_ntz")


def _measure(m: _Measured, df: DataFrame, columns: list[int], long: bool, o: ProfileOptions) -> None:
    if not columns:
        return
    h = H.rows(df, columns) if long else H.with_numbers(H.histogram(df, columns)).persist(StorageLevel.MEMORY_AND_DISK)
    keys = None if o.patterns is None else list(o.patterns)
    try:
        for part in H.metric_parts(h, keys, _now(o)):
            for r in part.collect():
                m.stats.setdefault(r["c"], {}).update(r.asDict())
            m.queries += 1
        for c in columns:
            if c in m.stats:
                m.stats[c]["distinct"] = m.stats[c]["texts"]
        if long:
            for r in _distinct(h, o).collect():
                m.stats[r["c"]]["distinct"] = r["distinct"]
            m.queries += 1
        if n := [c for c in columns if c in m.stats and m.stats[c]["num_mean"] is not None]:
            _numbers(m, H.numbers(h.where(F.col("c").isin(n)), summed=long), n, o)
        shapes = H.shapes(h).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for r in shapes.groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect():
                m.shape_counts[r["c"]] = r["k"]
            for r in sorted(H.top(shapes, "shape", o.shape_limit).collect(), key=lambda r: (r["c"], r["rank"])):
                m.shapes.setdefault(r["c"], []).append((r["shape"], r["n"]))
            m.queries += 2
        finally:
            shapes.unpersist()
        few = [c for c in columns if c in m.stats and _enumerable(m.stats[c], o)]
        if few:
            # at most max_enum_cardinality values a column pass the filter
            counts = h.where(F.col("c").isin(few) & F.col("t").isNotNull())
            counts = counts.groupBy("c", "t").agg(F.sum("n").alias("n")) if long else counts.select("c", "t", "n")
            most = max(o.enum_member_limit, o.max_enum_cardinality)
            for r in sorted(counts.collect(), key=lambda r: (r["c"], -r["n"], r["t"])):
                if len(own := m.members.setdefault(r["c"], [])) < most:
                    own.append((r["t"], r["n"]))
            m.queries += 1
        if o.privacy is Privacy.FULL and o.samples:
            for r in H.samples(h, o.samples).orderBy("c", "rank").collect():
                m.samples.setdefault(r["c"], []).append(r["v"])
            m.queries += 1
    finally:
        if not long:
            h.unpersist()


def _numbers(m: _Measured, numbers: DataFrame, columns: list[int], o: ProfileOptions) -> None:
    """Deviations and quantiles of the columns that have numbers."""
    numbers = H.in_order(numbers) if o.include_quantiles else numbers
    try:
        if o.include_quantiles:
            for c, q in H.quantiles(numbers).items():
                m.stats[c]["num_quantiles"] = q
            m.queries += 2
        means = [(c, m.stats[c]["num_mean"]) for c in columns]
        for r in H.deviations(numbers, H.local(numbers.sparkSession, means, "c int, num_mean double")).collect():
            m.stats[r["c"]]["num_stddev"] = r["num_stddev"]
        m.queries += 1
    finally:
        if o.include_quantiles:
            numbers.unpersist()


def _distinct(h: DataFrame, o: ProfileOptions) -> DataFrame:
    """Of rows, which repeat."""
    if o.exact_distinct:
        return H.distinct_rows(h)
    return h.groupBy("c").agg(F.approx_count_distinct("t").alias("distinct"))


def _enumerable(s: dict, o: ProfileOptions) -> bool:
    n = s.get("distinct") or 0
    return 0 < n <= o.max_enum_cardinality and n != s["nonnull"]


def _finite(x: float | None) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)


def _column(name: str, position: int, declared: str, m: _Measured, row_count: int, o: ProfileOptions, approx: bool) -> ColumnProfile:
    c = ColumnProfile(name, position, declared, row_count=row_count)
    s = m.stats.get(position)
    if s is None:  # no rows
        return finish(c, o.thresholds)
    c.null_count, c.blank_count, c.distinct_count, c.distinct_is_approx = row_count - s["nonnull"], s["blank"], s.get("distinct") or 0, approx
    c.type_probes = {k: s[f"probe_{k}"] for k in H.PROBES}
    c.pattern_hits = {k[4:]: n for k, n in s.items() if k.startswith("pat_") and n > 0}
    if c.probe_rate("float") > 0:
        q = s.get("num_quantiles") or [None] * 3
        c.numeric = NumericStats(*map(_finite, (s["num_min"], s["num_max"], s["num_mean"], s.get("num_stddev"), *q)), s["num_zero"], s["num_negative"], s["num_integral"], s["probe_float"])
    if c.valued_count:
        c.text = TextStats(s["len_min"], s["len_max"], s["len_mean"], s["padded"], s["upper"], s["lower"], s["mixed"])
    if max(c.probe_rate("date"), c.probe_rate("timestamp")) >= 0.01 and c.probe_rate("integer") < 0.99:
        c.temporal = TemporalStats(s["ts_min"], s["ts_max"], s["ts_future"], s["ts_distant_past"], s["probe_timestamp"])
    c.shapes = [Bucket(x, n, rate(n, c.valued_count)) for x, n in m.shapes.get(position, [])]
    c.shape_distinct_count = m.shape_counts.get(position, 0)
    if position in m.members and not approx:
        from hashlib import sha256

        hide = o.privacy is Privacy.STRICT
        show = (lambda t: "sha256:" + sha256(t.encode()).hexdigest()[:12]) if hide else (lambda t: t)
        members = [Member(show(t), n, rate(n, c.non_null_count)) for t, n in m.members[position]]
        c.enum = Categories(members, len(members) >= c.distinct_count, c.distinct_count, hide)
    c.samples = m.samples.get(position, [])
    return finish(c, o.thresholds)


def profile(df: DataFrame, name: str = "table", source_uri: str = "", options: ProfileOptions | None = None, declared: dict[str, str] | None = None) -> TableProfile:
    """The profile of df. declared: types that the source claims, by column; df's own by default."""
    o = options or ProfileOptions()
    began = time.monotonic()
    out = TableProfile(name, source_uri, profiled_at=datetime.now(timezone.utc).isoformat(timespec="seconds"), privacy_mode=o.privacy.value, version=__version__)
    m = _Measured()
    long = set(H.long_columns(df))
    order = range(len(df.columns))
    for wanted in (False, True):
        use = [i for i in order if (i in long) == wanted]
        for at in range(0, len(use), o.column_batch_size):
            _measure(m, df, use[at : at + o.column_batch_size], wanted, o)
    out.row_count = max((s["row_count"] for s in m.stats.values()), default=0)
    kinds = dict(df.dtypes) | (declared or {})
    for i, column in enumerate(df.columns):
        c = _column(column, i, kinds.get(column, "unknown"), m, out.row_count, o, i in long and not o.exact_distinct)
        if declared is not None and c.pattern_hits.get("leading_zeros"):
            # a reader that infers types would have cut the zeros off: the column is text
            c.declared_type = "string"
            finish(c, o.thresholds)
        out.columns.append(c)
    out.query_count = m.queries + bool(long)
    out.duration_ms = int((time.monotonic() - began) * 1000)
    return out
