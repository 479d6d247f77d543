"""Where data come from: files, globs, stores, tables of the catalog, databases by JDBC."""

from __future__ import annotations

import fnmatch
import glob
import os
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

PARQUET, JSON, TABS = (".parquet", ".pq"), (".json", ".ndjson", ".jsonl"), (".tsv",)
SYSTEM_SCHEMAS = frozenset("information_schema pg_catalog pg_toast sys mysql performance_schema sqlite_master temp".split())
JDBC = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "sqlite": "sqlite", "duckdb": "duckdb"}
#: Stores that Hadoop's file systems read, with their names there.
STORES = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "gcs": "gs", "az": "abfss", "azure": "abfss", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


class SourceError(ValueError):
    """A source that cannot be read."""


@dataclass
class Source:
    """text: all columns, of CSV as text. declared: types as the source has them, by column."""

    name: str
    uri: str
    text: DataFrame
    declared: dict[str, str] = field(default_factory=dict)


def display_name(uri: str) -> str:
    """The source's name: the last part of its path without ending, in lower-case letters, digits and _."""
    base = os.path.basename(uri.rstrip("/\\").replace("\\", "/"))
    stem = base.split(".")[0] if not any(c in base for c in "*?[") else os.path.splitext(base)[0]
    return "".join(c if c.isalnum() or c == "_" else "_" for c in stem).strip("_").lower() or "source"


def expand_env(text: str) -> str:
    """${NAME} by the environment. What is recorded is what was written, not what this gives."""

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise SourceError(f"the environment has no {m[1]}, which the source names")
        return os.environ[m[1]]

    return re.sub(r"\$\{([A-Za-z_]\w*)\}", value, text, flags=re.A)


def _scheme(uri: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", uri)
    return m[1].lower() if m else ""


def _broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a value may go on in the next line: a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _csv(spark: SparkSession, path: str, options: dict, tabs: bool, infer: bool, whole: bool) -> DataFrame:
    """whole: read files as a whole, each by one task, because lines do not end records."""
    given = {"header": True, "multiLine": whole, "escape": '"', "sep": "\t" if tabs else ",", "inferSchema": infer} | {{"delim": "sep", "delimiter": "sep"}.get(k, k): v for k, v in options.items()}
    return spark.read.options(**given).csv(path)


def _files(spark: SparkSession, uri: str, path: str, options: dict) -> Source:
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in PARQUET:
        df = spark.read.parquet(path)
    elif kind in JSON:
        df = spark.read.options(**options).json(path)
        if "_corrupt_record" in df.columns:  # not a value on each line: an array
            df = spark.read.options(**options | {"multiLine": True}).json(path)
    else:
        whole = options["multiLine"] if "multiLine" in options else _broken_lines(spark, path)
        df = _csv(spark, path, options, kind in TABS, False, whole)
        # the types are looked at, the values are not used
        inferred = dict(_csv(spark, path, options, kind in TABS, True, whole).dtypes)
        return Source(display_name(uri), uri, df, {k: "bigint" if v == "int" else v for k, v in inferred.items()})
    return Source(display_name(uri), uri, df, dict(df.dtypes))


def jdbc_options(uri: str, table: str) -> dict[str, str]:
    """Spark's JDBC options of postgres://user:password@host/base#table and the like."""
    kind = _scheme(uri)
    parts = urlsplit(expand_env(uri))
    if kind in ("sqlite", "duckdb"):
        path = (parts.netloc + parts.path) or parts.path
        return {"url": f"jdbc:{JDBC[kind]}:{path}", "dbtable": table}
    query = dict(parse_qsl(parts.query))
    out = {"url": f"jdbc:{JDBC[kind]}://{parts.hostname or ''}{f':{parts.port}' if parts.port else ''}{parts.path}", "dbtable": table if "." in table or kind == "mysql" else f"public.{table}"}
    return out | ({"user": parts.username} if parts.username else {}) | ({"password": parts.password} if parts.password else {}) | query


def read_jdbc(spark: SparkSession, given: dict[str, str], options: dict | None = None) -> DataFrame:
    """A table by JDBC. With a partitionColumn among the options it is read in numPartitions ranges of that column, whose bounds are asked for unless given."""
    o = given | {k: str(v) for k, v in (options or {}).items()}
    column = o.get("partitionColumn")
    if column and not {"lowerBound", "upperBound"} <= o.keys():
        ask = {k: v for k, v in o.items() if k not in ("partitionColumn", "numPartitions", "lowerBound", "upperBound")}
        quote = "`" if ":mysql:" in o["url"] else '"'
        name = quote + column.strip(quote) + quote
        low, high = spark.read.format("jdbc").options(**ask | {"dbtable": f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {o['dbtable']}) q"}).load().first()
        if low is None:  # no rows, or only nulls: there is nothing to part
            return spark.read.format("jdbc").options(**ask).load()
        o |= {"lowerBound": str(low), "upperBound": str(high)}
    if column:
        o.setdefault("numPartitions", str(spark.sparkContext.defaultParallelism))
    return spark.read.format("jdbc").options(**o).load()


def resolve(source: str, spark: SparkSession, name: str | None = None, options: dict | None = None) -> Source:
    """The data of a source.

    A path or glob of files; s3://, gs://, az://, hdfs:// and such; postgres://...#table, mysql://...#table, sqlite://file#table,
    duckdb://file#table through JDBC, whose driver Spark must have; bigquery://project#dataset.table through its connector; table://name of the catalog.
    """
    source = (source or "").strip()
    if not source:
        raise SourceError("the source is empty")
    uri, _, table = source.partition("#") if "://" in source else (source, "", "")
    kind = _scheme(uri)
    if kind == "table" or not kind and not os.path.splitext(source)[1] and not os.path.exists(source) and not any(c in source for c in "*?[/\\") and spark.catalog.tableExists(source):
        df = spark.table(source.removeprefix("table://"))
        out = Source(display_name(source.removeprefix("table://").replace(".", "_")), source, df, dict(df.dtypes))
    elif kind in JDBC or kind == "bigquery":
        if not table:
            raise SourceError(f"{source}: name the table after #")
        df = spark.read.format("bigquery").options(parentProject=urlsplit(uri).netloc, table=table).load() if kind == "bigquery" else read_jdbc(spark, jdbc_options(uri, table), options)
        out = Source(display_name(table.replace(".", "_") + "."), source, df, dict(df.dtypes))
    elif kind in ("http", "https"):
        raise SourceError(f"{source}: Spark reads no {kind}; copy the file to a store first")
    elif kind in STORES:
        path = f"{STORES[kind]}://{expand_env(uri).split('://', 1)[1]}"
        out = _files(spark, source, path, options or {})
    elif kind:
        raise SourceError(f"{source}: {kind}:// is not known")
    else:
        path = os.path.expanduser(source)
        if any(c in path for c in "*?["):
            if not glob.glob(path, recursive=True):
                raise FileNotFoundError(f"no file is like {source}")
        elif not os.path.exists(path):
            raise FileNotFoundError(f"there is no file {source}")
        out = _files(spark, source, f"file://{os.path.abspath(path)}", options or {})
    out.name = name or out.name
    return out


def matching(tables: list[tuple[str, str]], pattern: str) -> list[str]:
    """Those (schema, table) that a pattern such as public.stg_* or * names, as table or schema.table, without systems' own."""
    schema, _, table = pattern.rpartition(".")
    hit = sorted((s, t) for s, t in tables if s not in SYSTEM_SCHEMAS and fnmatch.fnmatch(s, schema or "*") and fnmatch.fnmatch(t, table))
    if not hit:
        raise SourceError(f"no table is like {pattern}")
    plain = len({s for s, _ in hit}) == 1 and hit[0][0] in ("main", "public", "default")
    return [t if plain else f"{s}.{t}" for s, t in hit]


def expand(source: str, spark: SparkSession) -> list[str]:
    """A source whose table part has a * as one source for each table; others as they are."""
    uri, mark, table = source.strip().partition("#")
    if "*" not in table:
        if _scheme(source) == "table" and "*" in source:
            found = [((t.namespace or ["default"])[-1], t.name) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name)]
            return [f"table://{t}" for t in matching(sorted(set(found)), source.removeprefix("table://"))]
        return [source.strip()]
    kind = _scheme(uri)
    if kind == "bigquery":
        raise SourceError("a project's tables have to be named one by one")
    if kind not in JDBC:
        raise SourceError(f"{source}: only databases have tables to expand; for files use a glob")
    if kind == "sqlite":
        query = "(SELECT 'main' AS s, name AS t FROM sqlite_master WHERE type = 'table') q"
    else:
        query = "(SELECT table_schema AS s, table_name AS t FROM information_schema.tables) q"
    rows = spark.read.format("jdbc").options(**(jdbc_options(uri, "q") | {"dbtable": query})).load().collect()
    return [f"{uri}#{t}" for t in matching([(r[0], r[1]) for r in rows], table)]
