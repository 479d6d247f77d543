"""The value histogram and what is computed from it.

Every per-value metric (type probes, patterns, lengths, case, shapes) is a function of a value's text. So each column is counted by its
values, as they are stored, with map-side sums; only different values become text, and each expression is evaluated once for each of
them instead of once for each row. A column is read, hashed and shuffled by itself, so rows are not multiplied by columns. Columns of
long texts, which seldom repeat, skip the histogram: they are
measured row by row, and only digests of their values are shuffled for the distinct count.
"""

from __future__ import annotations

import math
from datetime import datetime
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType

from ..functions import patterns as P, text as T

#: Mean length over the first rows from which a column counts as long text. It decides the plan only, never a result.
LONG = 200
QUANTILES = (0.25, 0.5, 0.75)
DISTANT_PAST = datetime(1900, 1, 1)
PROBES = ("integer", "float", "boolean", "date", "timestamp")


def values(df: DataFrame, columns: list[int] | None = None) -> DataFrame:
    """Rows (c, t): the position of each column and the text of each of its values."""
    texts = T.text_columns(df)
    use = range(len(df.columns)) if columns is None else columns
    if not use:
        return df.sparkSession.createDataFrame([], "c int, t string")
    return texts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("t")) for i in use])).alias("x")).select("x.*")


#: Types whose different values have different texts (doubles but for their zeros).
_PLAIN = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType, DateType, TimestampNTZType, StringType)


def _counted(df: DataFrame, i: int) -> DataFrame:
    """c, t, n of one column."""
    name, kind = df.columns[i], df.schema[i].dataType
    x = df.select(F.col(T.quoted(name)).alias("x"))
    keys = [F.col("x")]
    if isinstance(kind, (FloatType, DoubleType)):
        keys.append(F.when(F.col("x") == 0, F.col("x").cast("string")).alias("zero"))  # 0 and -0 are equal, their texts are not
    out = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    text = T.text_form(F.col("x"), kind)
    return out.select(F.lit(i).alias("c"), (F.coalesce("zero", text) if len(keys) > 1 else text).alias("t"), "n")


def histogram(df: DataFrame, columns: list[int] | None = None) -> DataFrame:
    """(c, t, n): how often each value occurs, null included."""
    use = list(range(len(df.columns)) if columns is None else columns)
    plain = [i for i in use if isinstance(df.schema[i].dataType, _PLAIN) and _compared_by_bytes(df.schema[i].dataType)]
    rest = [i for i in use if i not in plain]
    parts = [_counted(df, i) for i in plain]
    if rest or not parts:
        parts.append(values(df, rest).groupBy("c", "t").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def _compared_by_bytes(kind: DataType) -> bool:
    return not isinstance(kind, StringType) or kind.simpleString() == "string"


def rows(df: DataFrame, columns: list[int]) -> DataFrame:
    """The same form without the sums: every row with n = 1."""
    return values(df, columns).withColumn("n", F.lit(1).cast("bigint"))


def long_columns(df: DataFrame, look: int = 200) -> list[int]:
    """Positions of the columns of long texts, by their first rows."""
    strings = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, StringType)]
    if not strings:
        return []
    head = df.select(*[F.length(F.col(T.quoted(df.columns[i]))).alias(f"c{i}") for i in strings]).limit(look)
    got = head.agg(*[F.avg(c).alias(c) for c in head.columns]).first()
    return [i for i in strings if (got[f"c{i}"] or 0) >= LONG]


def with_numbers(h: DataFrame) -> DataFrame:
    """h with num, the number that each text is: parsed once for all that follows."""
    if "num" in h.columns:
        return h
    # in two steps: the number is made of the trimmed text several times over
    return h.withColumn("v", T.valued(F.col("t"))).withColumn("num", T.number(F.col("v"))).drop("v")


def prepared(h: DataFrame) -> DataFrame:
    """h with the forms that metrics are made of: num, v, size, low, up, day, moment."""
    d = with_numbers(h).withColumn("v", T.valued(F.col("t")))
    v = F.col("v")
    return d.select("*", F.length(v).alias("size"), F.lower(v).alias("low"), F.upper(v).alias("up"), T.day(v).alias("day"), T.moment(v).alias("moment"))


def _n(when: Column) -> Column:
    return F.sum(F.when(when, F.col("n")).otherwise(F.lit(0).cast("bigint")))


def metric_columns(keys: list[str] | None = None, now: Column | None = None) -> list[Column]:
    """The aggregates of prepared rows, for each column."""
    v, t, num, moment, low, up, size = map(F.col, ("v", "t", "num", "moment", "low", "up", "size"))
    whole = F.rint(num) == num
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    out = [
        F.sum("n").alias("row_count"), F.count(t).alias("texts"), _n(t.isNotNull()).alias("nonnull"), _n(t.isNotNull() & v.isNull()).alias("blank"),
        _n(num.isNotNull() & whole & ~v.rlike("[.eE]")).alias("probe_integer"), _n(num.isNotNull()).alias("probe_float"), _n(T.truth(low)).alias("probe_boolean"),
        _n(F.col("day").isNotNull()).alias("probe_date"), _n(moment.isNotNull()).alias("probe_timestamp"),
        F.min("num").alias("num_min"), F.max("num").alias("num_max"), (F.sum(num * F.col("n")) / F.sum(F.when(num.isNotNull(), F.col("n")))).alias("num_mean"),
        _n(num == 0).alias("num_zero"), _n(num < 0).alias("num_negative"), _n(whole).alias("num_integral"),
        F.min(size).cast("bigint").alias("len_min"), F.max(size).cast("bigint").alias("len_max"), (F.sum(size * F.col("n")) / F.sum(F.when(v.isNotNull(), F.col("n")))).alias("len_mean"),
        _n(t != T.trimmed(t)).alias("padded"), _n((v == up) & (v != low)).alias("upper"), _n((v == low) & (v != up)).alias("lower"), _n((v != up) & (v != low)).alias("mixed"),
        F.min(moment).cast("string").alias("ts_min"), F.max(moment).cast("string").alias("ts_max"),
        _n(moment > now).alias("ts_future"), _n(moment < F.lit(DISTANT_PAST).cast("timestamp_ntz")).alias("ts_distant_past"),
    ]
    return out + [_n(P.matches(p, v, low, size)).alias(f"pat_{p.key}") for p in P.chosen(keys)]


def metrics(h: DataFrame, keys: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """One row for each column c of a histogram, or of rows, with all counts; texts is the distinct count of a histogram."""
    return prepared(h).groupBy("c").agg(*metric_columns(keys, now))


def local(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals: a table without a Python worker."""
    fields = [x.split() for x in schema.split(", ")]
    made = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(k) for v, (k, kind) in zip(r, fields)]) for r in rows])
    return spark.range(1).select(F.inline(made))


#: Aggregates that are made in one pass: the code of more would be too large to be compiled.
AT_ONCE = 14


def metric_parts(h: DataFrame, keys: list[str] | None = None, now: Column | None = None) -> list[DataFrame]:
    """`metrics` in several tables, each of some of the counts."""
    columns = metric_columns(keys, now)
    p = prepared(h)
    return [p.groupBy("c").agg(*columns[i : i + AT_ONCE]) for i in range(0, len(columns), AT_ONCE)]


def numbers(h: DataFrame, summed: bool = False) -> DataFrame:
    """c, num, n: the numbers of each column; summed: each different one once."""
    d = with_numbers(h).where("num is not null").select("c", "num", "n")
    return d.groupBy("c", "num").agg(F.sum("n").alias("n")) if summed else d


def quantiles(ordered: DataFrame, at: tuple[float, ...] = QUANTILES) -> dict[int, list[float]]:
    """The exact quantiles of each column c, interpolated between neighbours, from `numbers` that `in_order` has dealt by range.

    The driver adds up a count for each part and column; then only parts with a wanted rank are summed up in order. No task holds a column.
    """
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in ordered.groupBy("c", "p").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(r["c"], []).append((r["p"], r["n"]))
    wanted: dict[int, list[float]] = {}
    places = []
    for c, parts in sums.items():
        total = sum(n for _, n in parts)
        wanted[c] = [q * (total - 1) for q in at]
        below = 0
        for p, n in sorted(parts):
            ranks = {k for x in wanted[c] for k in (math.floor(x), math.ceil(x)) if below <= k < below + n}
            places += [(c, p, k - below, k) for k in sorted(ranks)]
            below += n
    if not places:
        return {}
    few = local(ordered.sparkSession, places, "c int, p int, k bigint, rank bigint")  # two rows for each column and quantile at most
    here = ordered.join(F.broadcast(few.select("c", "p").distinct()), ["c", "p"], "left_semi")
    upto = Window.partitionBy("c", "p").orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = here.withColumn("upto", F.sum("n").over(upto))
    found = run.join(F.broadcast(few), ["c", "p"]).where("upto - n <= k and k < upto").select("c", "rank", "num").collect()
    of = {(r["c"], r["rank"]): r["num"] for r in found}
    out = {}
    for c, xs in wanted.items():
        low, high = [of[c, math.floor(x)] for x in xs], [of[c, math.ceil(x)] for x in xs]
        out[c] = [a if a == b else a * (math.ceil(x) - x) + b * (x - math.floor(x)) for x, a, b in zip(xs, low, high)]
    return out


def in_order(numbers: DataFrame) -> DataFrame:
    """numbers, dealt by range and cached, with the part p of each; to be unpersisted. Equal numbers of different texts meet in a part."""
    n = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbers.repartitionByRange(n, "c", "num").withColumn("p", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)


def deviations(numbers: DataFrame, means: DataFrame) -> DataFrame:
    """c, num_stddev: the sample deviation of numbers (c, num, n) around the means (c, num_mean); centred, so nothing cancels."""
    d = numbers.join(F.broadcast(means), "c").select("c", "n", (F.col("num") - F.col("num_mean")).alias("d"))
    return d.groupBy("c").agg(F.sqrt(F.sum(F.col("d") * F.col("d") * F.col("n")) / F.nullif(F.sum("n") - 1, F.lit(0))).alias("num_stddev"))


def distinct(h: DataFrame) -> DataFrame:
    """c, distinct: the number of different values of a histogram."""
    return h.where("t is not null").groupBy("c").agg(F.count(F.lit(1)).alias("distinct"))


def distinct_rows(r: DataFrame) -> DataFrame:
    """The same for rows: digests are shuffled, not texts."""
    return distinct(r.where("t is not null").select("c", F.sha2("t", 256).alias("t")).distinct())


def shapes(h: DataFrame) -> DataFrame:
    """c, shape, n."""
    v = T.valued(F.col("t"))
    return h.select("c", "n", T.shape(v).alias("shape")).where("shape is not null").groupBy("c", "shape").agg(F.sum("n").alias("n"))


def top(counts: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values of each c, of equal ones the first by text, with rank. Ranks above k leave before the shuffle."""
    order = Window.partitionBy("c").orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def samples(h: DataFrame, k: int) -> DataFrame:
    """The first k valued texts of each c by order, as (c, v)."""
    v = h.select("c", T.valued(F.col("t")).alias("v")).where("v is not null").distinct()
    return v.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy("v"))).where(F.col("rank") <= k)
