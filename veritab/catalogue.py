"""The registered queries of the library and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import patterns as P, text as T
from .operators import histogram as H
from .relations import orphans, parents
from .rules.measure import counts

#: What counts as now, so that results stay as they are.
NOW = datetime(1997, 1, 1)

# Columns of the tables that are measured, in order.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "labels": "doc_id quality toxic",
    "pages": "page_id url html",
    "conversations": "conv_id turn role text",
}
COLUMNS = {k: v.split() for k, v in COLUMNS.items()}

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*COLUMNS[table]) if table in COLUMNS else df


def _name(table: str) -> Column:
    return F.element_at(F.array(*map(F.lit, COLUMNS[table])), F.col("c") + 1).alias("column")


def _source(df: DataFrame) -> DataFrame:
    """The rows that metrics are made of: histograms for most columns, rows for long texts."""
    long = H.long_columns(df)
    short = [i for i in range(len(df.columns)) if i not in long]
    parts = [H.histogram(df, short)] * bool(short) + [H.rows(df, long)] * bool(long)
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def _metrics(table: str, select: dict[str, str], keys: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = H.metrics(_source(read(spark, sf_dir, table)), keys, F.lit(NOW).cast("timestamp_ntz"))
        return m.select(_name(table), *[F.expr(e).alias(k) for k, e in select.items()])

    return run


def _quantiles(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        source = H.with_numbers(_source(df)).persist()
        ordered = H.in_order(H.numbers(source, summed=bool(H.long_columns(df))))
        found = H.quantiles(ordered)
        ordered.unpersist()
        source.unpersist()
        none = [None] * len(H.QUANTILES)
        rows = [(c, *(None if x is None else round(x, 4) for x in found.get(i, none))) for i, c in enumerate(df.columns)]
        return spark.createDataFrame(rows, "column string, " + ", ".join(f"{k} double" for k in _QUANTILES))

    return run


# ── the same in SQL ──────────────────────────────────────────────────────────


def _sql(table: str, select: dict[str, str], where: str = "") -> str:
    """A SELECT for each column, where t is its text, v its valued text and x the number it is."""
    one = "SELECT '{c}' AS \"column\", {s} FROM (SELECT *, TRY_CAST(v AS DOUBLE) AS x, TRY_CAST(v AS DATE) AS d, TRY_CAST(v AS TIMESTAMP) AS m FROM (SELECT *, NULLIF(TRIM(t), '') AS v FROM (SELECT CAST({c} AS VARCHAR) AS t FROM {table})))"
    return "\nUNION ALL\n".join(one.format(c=c, table=table, s=", ".join(f"{e} AS {k}" for k, e in select.items())) for c in COLUMNS[table])


def _count(when: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {when}) AS BIGINT)"


_PRESENCE = {"rows": "CAST(count(*) AS BIGINT)", "nonnull": _count("t IS NOT NULL"), "blank": _count("t IS NOT NULL AND v IS NULL")}
_PROBES = {
    "integer": _count("x IS NOT NULL AND x = floor(x) AND NOT regexp_matches(v, '[.eE]')"), "float": _count("x IS NOT NULL"),
    "boolean": _count("lower(v) IN ('" + "', '".join(T.BOOLEAN_WORDS) + "')"), "date": _count("d IS NOT NULL"), "timestamp": _count("m IS NOT NULL"),
}
_NUMERIC = {"least": "min(x)", "most": "max(x)", "mean": "round(avg(x), 4)", "zero": _count("x = 0"), "negative": _count("x < 0"), "integral": _count("x = floor(x)")}
_LENGTHS = {"shortest": "CAST(min(length(v)) AS BIGINT)", "longest": "CAST(max(length(v)) AS BIGINT)", "mean_length": "round(avg(length(v)), 4)"}
_HYGIENE = {"padded": _count("t <> TRIM(t)"), "upper": _count("v = upper(v) AND v <> lower(v)"), "lower": _count("v = lower(v) AND v <> upper(v)"), "mixed": _count("v <> upper(v) AND v <> lower(v)")}
_TEMPORAL = {"first": "CAST(min(m) AS VARCHAR)", "last": "CAST(max(m) AS VARCHAR)", "future": _count(f"m > TIMESTAMP '{NOW}'"), "distant_past": _count("m < TIMESTAMP '1900-01-01 00:00:00'")}
_QUANTILES = {f"p{int(q * 100)}": f"round(quantile_cont(x, {q}), 4)" for q in H.QUANTILES}

#: Of each group: the SQL, and the same of this library's metrics.
GROUPS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "presence": (_PRESENCE, {"rows": "row_count", "nonnull": "nonnull", "blank": "blank"}),
    "probes": (_PROBES, {k: f"probe_{k}" for k in _PROBES}),
    "numeric": (_NUMERIC, {"least": "num_min", "most": "num_max", "mean": "round(num_mean, 4)", "zero": "num_zero", "negative": "num_negative", "integral": "num_integral"}),
    "quantiles": (_QUANTILES, {}),
    "lengths": (_LENGTHS, {"shortest": "len_min", "longest": "len_max", "mean_length": "round(len_mean, 4)"}),
    "hygiene": (_HYGIENE, {k: k for k in _HYGIENE}),
    "temporal": (_TEMPORAL, {"first": "ts_min", "last": "ts_max", "future": "ts_future", "distant_past": "ts_distant_past"}),
}


def _pattern_sql(group: str) -> dict[str, str]:
    return {p.key: _count(f"regexp_matches({'lower(v)' if p.lower else 'v'}, '{p.regex}')") for p in P.GROUPS[group]}


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(substring(v, 1, 40), '[0-9]', '#', 'g'), '[A-Za-z]', 'a', 'g'), '\s', '_', 'g')"


def _each(table: str, template: str) -> str:
    """template for each column, with {c} for its name and {rows} for its t and v."""
    rows = "(SELECT *, NULLIF(TRIM(t), '') AS v FROM (SELECT CAST({c} AS VARCHAR) AS t FROM " + table + "))"
    return "\nUNION ALL\n".join("SELECT * FROM (" + template.replace("{rows}", rows).replace("{c}", c) + ")" for c in COLUMNS[table])


def _ranked(value: str, k: int, where: str) -> str:
    counted = f"SELECT {value} AS value, CAST(count(*) AS BIGINT) AS n FROM {{rows}} WHERE {where} GROUP BY 1"
    return f"SELECT '{{c}}' AS \"column\", value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM ({counted}) QUALIFY rank <= {k}"


def _top_shapes(table: str, k: int = 12) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = H.top(H.shapes(_source(read(spark, sf_dir, table))), "shape", k)
        return s.select(_name(table), F.col("shape").alias("value"), "n", "rank")

    return run


def _shape_counts(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = H.shapes(_source(read(spark, sf_dir, table)))
        return s.groupBy("c").agg(F.count(F.lit(1)).alias("shapes")).select(_name(table), "shapes")

    return run


def _distinct(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        long = H.long_columns(df)
        parts = [H.distinct(H.histogram(df, [i for i in range(len(df.columns)) if i not in long]))] + [H.distinct_rows(H.rows(df, long))] * bool(long)
        d = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return d.select(_name(table), "distinct")

    return run


def _members(table: str, strict: bool = False) -> Query:
    """The categories of columns of at most 50 different values that are not unique."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        h = H.histogram(df, [i for i in range(len(df.columns)) if i not in H.long_columns(df)]).where("t is not null")
        few = h.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).where("k <= 50 and k <> rows").select("c")
        t = H.top(h.join(F.broadcast(few), "c"), "t", 64)  # few has a row for each column at most
        return t.select(_name(table), (T.hidden(F.col("t")) if strict else F.col("t")).alias("value"), "n", "rank")

    return run


def _members_sql(table: str, strict: bool = False) -> str:
    value = "'sha256:' || substring(sha256(value), 1, 12)" if strict else "value"
    ranked = _each(table, _ranked("t", 64, "t IS NOT NULL"))
    whole = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT CAST({c} AS VARCHAR)) AS k, count({c}) AS rows FROM {table}" for c in COLUMNS[table])
    return f'SELECT r."column", {value} AS value, n, rank FROM ({ranked}) r JOIN ({whole}) w ON r."column" = w."column" WHERE k <= 50 AND k <> rows'


def _samples(table: str, k: int = 5) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return H.samples(H.histogram(read(spark, sf_dir, table)), k).select(_name(table), F.col("v").alias("value"), "rank")

    return run


def _samples_sql(table: str, k: int = 5) -> str:
    return _each(table, f"SELECT '{{c}}' AS \"column\", v AS value, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS rank FROM (SELECT DISTINCT v FROM {{rows}} WHERE v IS NOT NULL) QUALIFY rank <= {k}")


def _stddev(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = H.histogram(read(spark, sf_dir, table)).select("c", "t", "n")
        numbers = H.numbers(h)
        means = numbers.groupBy("c").agg((F.sum(F.col("num") * F.col("n")) / F.sum("n")).alias("num_mean"))
        return H.deviations(numbers, means).select(_name(table), F.round("num_stddev", 4).alias("stddev"))

    return run


# ── joins ────────────────────────────────────────────────────────────────────


def _orphans(child: str, column: str, parent: str, key: str, only: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = read(spark, sf_dir, parent)
        return orphans(read(spark, sf_dir, child), column, p.where(only) if only else p, key)

    return run


def _orphans_sql(child: str, column: str, parent: str, key: str, only: str | None = None) -> str:
    text = "NULLIF(TRIM(CAST({} AS VARCHAR)), '')"
    return f"""SELECT CAST(count(*) AS BIGINT) AS child_rows, CAST(count(c.k) AS BIGINT) AS child_valued, {_count("c.k IS NOT NULL AND p.k IS NULL")} AS orphan_rows,
 CAST(count(DISTINCT CASE WHEN p.k IS NULL THEN c.k END) AS BIGINT) AS orphan_keys
FROM (SELECT {text.format(column)} AS k FROM {child}) c LEFT JOIN (SELECT DISTINCT {text.format(key)} AS k FROM {parent} {f"WHERE {only}" if only else ""}) p ON c.k = p.k"""


def _parents(parent: str, key: str) -> Query:
    return lambda spark, sf_dir: parents(read(spark, sf_dir, parent), key)


def _parents_sql(parent: str, key: str) -> str:
    return f"SELECT CAST(count(*) AS BIGINT) AS parent_rows, CAST(count(DISTINCT NULLIF(TRIM(CAST({key} AS VARCHAR)), '')) AS BIGINT) AS parent_distinct_keys FROM {parent}"


# ── rules ────────────────────────────────────────────────────────────────────

#: By name: (table, rule, the same in SQL).
RULES = {
    "rule_compare": ("lineitem", "l_extendedprice >= l_quantity", "l_extendedprice >= l_quantity"),
    "rule_arithmetic": ("lineitem", "abs(l_extendedprice - l_extendedprice * (1 - l_discount)) <= l_extendedprice * 0.1", "abs(l_extendedprice - l_extendedprice * (1 - l_discount)) <= l_extendedprice * 0.1"),
    "rule_implies": ("lineitem", "l_linestatus = 'F' implies l_returnflag != 'N'", "NOT (l_linestatus = 'F') OR l_returnflag <> 'N'"),
    "rule_is_null": ("orders", "o_orderstatus is not null and not (o_custkey is null)", "o_orderstatus IS NOT NULL AND NOT (o_custkey IS NULL)"),
    "rule_length": ("customer", "length(c_name) > 12 or length(c_mktsegment) < 9", "length(c_name) > 12 OR length(c_mktsegment) < 9"),
    "rule_boolean_logic": ("orders", "o_totalprice > 100000 and o_orderstatus = 'O' or not o_orderpriority = '1-URGENT'", "o_totalprice > 100000 AND o_orderstatus = 'O' OR NOT (o_orderpriority = '1-URGENT')"),
    "rule_unknown": ("orders", "o_orderstatus > 5", "TRY_CAST(o_orderstatus AS DOUBLE) > 5"),
    "rule_dates": ("orders", "o_orderdate >= '1995-01-01'", "o_orderdate >= TIMESTAMP '1995-01-01'"),
}
RULE_TYPES = {
    "l_extendedprice": "float", "l_quantity": "float", "l_discount": "float", "o_totalprice": "float", "o_custkey": "integer",
    "o_orderstatus": "text", "o_orderdate": "timestamp",
}


def _rule(name: str) -> Query:
    table, rule, _ = RULES[name]
    types = RULE_TYPES | ({"o_orderstatus": "float"} if name == "rule_unknown" else {})
    return lambda spark, sf_dir: counts(read(spark, sf_dir, table), [rule], types).select("rows", F.col("judged0").alias("judged"), F.col("broken0").alias("broken"))


def _rule_sql(name: str) -> str:
    table, _, e = RULES[name]
    return f"SELECT CAST(count(*) AS BIGINT) AS rows, {_count(f'({e}) IS NOT NULL')} AS judged, {_count(f'NOT ({e})')} AS broken FROM {table}"


# ── inference and contracts ──────────────────────────────────────────────────


def _profile(spark: SparkSession, sf_dir: str, table: str, df: DataFrame | None = None):
    from .operators.profile import ProfileOptions, profile

    return profile(read(spark, sf_dir, table) if df is None else df, table, f"{sf_dir}/{table}.parquet", ProfileOptions(now=NOW))


def _profile_rows(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _profile(spark, sf_dir, table)
        rows = [(c.name, c.row_count, c.null_count, c.distinct_count, c.inferred_type.value, c.is_unique) for c in p.columns]
        return spark.createDataFrame(rows, "column string, rows bigint, nulls bigint, distinct bigint, type string, is_unique boolean")

    return run


def _profile_sql(table: str) -> str:
    """Types by the order of the decisions, from counts alone."""
    want = _PRESENCE | {"distinct": "CAST(count(DISTINCT t) AS BIGINT)"} | {f"n_{k}": e for k, e in _PROBES.items()}
    want |= {k: e for g in ("structural", "pii", "temporal") for k, e in _pattern_sql(g).items() if k in ("uuid", "email", "url", "json_object", "iso_date", "iso_datetime", "us_date", "eu_date")}
    looks = "greatest(n_date, iso_date + us_date + eu_date)"
    kind = f"""CASE WHEN k = 0 THEN 'empty' WHEN uuid >= 0.9 * k THEN 'uuid' WHEN email >= 0.9 * k THEN 'email' WHEN url >= 0.9 * k THEN 'url' WHEN json_object >= 0.9 * k THEN 'json'
 WHEN n_boolean >= 0.99 * k AND "distinct" <= 3 THEN 'boolean' WHEN n_integer >= 0.99 * k THEN 'integer' WHEN n_float >= 0.99 * k THEN 'float'
 WHEN {looks} >= 0.99 * k THEN CASE WHEN iso_datetime >= 0.5 * k THEN 'timestamp' ELSE 'date' END WHEN n_timestamp >= 0.99 * k THEN 'timestamp'
 WHEN n_float + least({looks}, k - n_float) + greatest(n_timestamp - {looks}, 0) >= 0.7 * k THEN 'mixed' ELSE 'text' END"""
    want = {('"distinct"' if k == "distinct" else k): e for k, e in want.items()}
    return f"""SELECT "column", rows, rows - nonnull AS nulls, "distinct", {kind} AS type, nonnull > 0 AND "distinct" = nonnull AS is_unique FROM (SELECT *, nonnull - blank AS k FROM ({_sql(table, want)}))"""


def _observations(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _profile(spark, sf_dir, table)
        return spark.createDataFrame([(c.name, o) for c in p.columns for o in c.observations], "column string, observation string")

    return run


def _clauses(table: str) -> Query:
    """The generated contract, a row for each clause."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .contract.generate import table_contract
        from .contract.yaml_io import COLUMN, _plain

        t = table_contract(_profile(spark, sf_dir, table), today=NOW.date())
        rows = [(n, k, str(v)) for n, c in t.columns.items() for k, v in _plain(c, COLUMN).items()]
        return spark.createDataFrame(rows, "column string, clause string, value string")

    return run


def _check(table: str, change: Callable[[DataFrame], DataFrame] | None = None) -> Query:
    """The findings in the changed data against the contract of the data as they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .contract.check import check
        from .contract.generate import generate

        known = _profile(spark, sf_dir, table)
        seen = _profile(spark, sf_dir, table, change(read(spark, sf_dir, table))) if change else known
        found = check(seen, generate(known, today=NOW.date()), datetime(2030, 1, 1))
        return found.to_df(spark).select("table", "column", "type", "severity")

    return run


def _check_sql(table: str, changed: dict[str, str] | None = None, gone: tuple[str, ...] = ()) -> str:
    """The findings that a change of values can make, from the data as they are and as they become: nulls in a column without, values that a
    column of categories has not, medians a power of ten away; and columns that are gone."""
    found = [f"SELECT column_name AS c, 'column_missing' AS type FROM information_schema.columns WHERE table_name = '{table}' AND column_name IN ({', '.join(f"'{c}'" for c in gone)})"] if gone else []
    for c in COLUMNS[table]:
        if c in gone:
            continue
        now = (changed or {}).get(c, c)
        text, now_text = f"CAST({c} AS VARCHAR)", f"CAST({now} AS VARCHAR)"
        found.append(f"SELECT '{c}' AS c, 'nullability_violated' AS type FROM {table} HAVING count(*) = count({c}) AND count({now}) < count(*)")
        found.append(f"SELECT '{c}', 'new_category' FROM {table} HAVING count(DISTINCT {text}) BETWEEN 2 AND 50 AND len(list_filter(list_distinct(list({now_text})), lambda x: NOT list_contains(list_distinct(list({text})), x))) > 0")
        found.append(f"SELECT '{c}', 'unit_shift_suspected' FROM {table} HAVING abs(abs(log10(quantile_cont(TRY_CAST({now_text} AS DOUBLE), 0.5) / quantile_cont(TRY_CAST({text} AS DOUBLE), 0.5))) - 2) < 0.01")
    return f"SELECT '{table}' AS \"table\", c AS \"column\", type, 'fail' AS severity FROM (" + "\nUNION ALL ".join(found) + ")"


def _drift(left: str, right: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = (spark.createDataFrame([(c,) for c in spark.read.parquet(f"{sf_dir}/{t}.parquet").columns], "column string") for t in (left, right))
        return a.exceptAll(b).withColumn("change", F.lit("column_missing")).unionByName(b.exceptAll(a).withColumn("change", F.lit("column_added")))

    return run


def _drift_sql(left: str, right: str) -> str:
    of = "SELECT column_name FROM information_schema.columns WHERE table_name = '{}'"
    one = 'SELECT column_name AS "column", \'{}\' AS change FROM ({} EXCEPT {})'
    return one.format("column_missing", of.format(left), of.format(right)) + " UNION ALL " + one.format("column_added", of.format(right), of.format(left))


# ── all of them ──────────────────────────────────────────────────────────────

MEASURED = {
    "presence": ("orders", "lineitem", "customer", "events", "part", "documents", "region", "supplier"),
    "probes": ("orders", "lineitem", "customer", "events", "part"),
    "numeric": ("orders", "lineitem", "customer"),
    "quantiles": ("orders", "lineitem", "part"),
    "lengths": ("orders", "customer", "documents"),
    "hygiene": ("customer", "part", "conversations"),
    "temporal": ("orders", "events"),
}
MATCHED = ("documents", "pages", "conversations", "events", "orders")
KEYS = {
    "lineitem_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "labels_documents": ("labels", "doc_id", "documents", "doc_id"),
}


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {"profile_orders": (_profile_rows("orders"), _profile_sql("orders"))}
    for t in ("lineitem", "customer", "part", "nation", "supplier"):
        out[f"profile_{t}"] = (_profile_rows(t), _profile_sql(t))
    for group, tables in MEASURED.items():
        sql, own = GROUPS[group]
        for t in tables:
            out[f"{group}_{t}"] = (_metrics(t, own, []) if own else _quantiles(t), _sql(t, sql))
    for t in MATCHED:
        for g in P.GROUPS:
            keys = [p.key for p in P.GROUPS[g]]
            out[f"patterns_{g}_{t}"] = (_metrics(t, {k: f"pat_{k}" for k in keys}, keys), _sql(t, _pattern_sql(g)))
    for t in ("orders", "lineitem", "documents"):
        out[f"distinct_{t}"] = (_distinct(t), _sql(t, {'"distinct"': "CAST(count(DISTINCT t) AS BIGINT)"}))
        out[f"shape_distinct_{t}"] = (_shape_counts(t), _each(t, f"SELECT '{{c}}' AS \"column\", CAST(count(DISTINCT {_SHAPE}) AS BIGINT) AS shapes FROM {{rows}}"))
    out["stddev_orders"] = (_stddev("orders"), 'SELECT * FROM (' + _sql("orders", {"stddev": "round(stddev_samp(x), 4)"}) + ") WHERE stddev IS NOT NULL")
    for t in ("customer", "orders", "part", "documents"):
        out[f"shape_topk_{t}"] = (_top_shapes(t), _each(t, _ranked(_SHAPE, 12, "v IS NOT NULL")))
    for t in ("orders", "part", "nation", "lineitem"):
        out[f"enum_members_{t}"] = (_members(t), _members_sql(t))
    out["strict_hash_enums_orders"] = (_members("orders", True), _members_sql("orders", True))
    out["samples_full_nation"] = (_samples("nation"), _samples_sql("nation"))
    for name, key in KEYS.items():
        out[f"fk_orphans_{name}"] = (_orphans(*key), _orphans_sql(*key))
        out[f"fk_parents_{name}"] = (_parents(*key[2:]), _parents_sql(*key[2:]))
    out["fk_orphans_filtered"] = (_orphans(*KEYS["orders_customer"], "c_custkey % 10 <> 3"), _orphans_sql(*KEYS["orders_customer"], "c_custkey % 10 <> 3"))
    out["fk_fanout_lineitem"] = (_parents("lineitem", "l_orderkey"), _parents_sql("lineitem", "l_orderkey"))
    for name in RULES:
        out[name] = (_rule(name), _rule_sql(name))
    out["observations_orders"] = (_observations("orders"), None)
    out["contract_clauses_orders"] = (_clauses("orders"), None)
    for t in ("orders", "customer", "lineitem"):
        out[f"check_self_{t}"] = (_check(t), _check_sql(t))
    changes = {
        "range": ("o_totalprice", "o_totalprice * 100"), "nulls": ("o_custkey", "CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END"),
        "category": ("o_orderstatus", "CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END"),
    }
    for name, (column, e) in changes.items():
        out[f"check_{name}_orders"] = (_check("orders", lambda d, column=column, e=e: d.withColumn(column, F.expr(e))), _check_sql("orders", {column: e}))
    out["check_column_missing_orders"] = (_check("orders", lambda d: d.drop("o_orderpriority")), _check_sql("orders", gone=("o_orderpriority",)))
    out["column_drift"] = (_drift("orders", "lineitem"), _drift_sql("orders", "lineitem"))
    return out


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s is not None}
