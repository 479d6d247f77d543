"""Contracts as YAML files: reading with line numbers and suggestions, writing in a fixed order with explanations."""

from __future__ import annotations

import difflib
import os
from dataclasses import dataclass
from typing import Any

import yaml

from ..model import Kind
from ..rules.grammar import RuleError, validate_rule
from .model import CONTRACT_VERSION, Cardinality, ColumnContract, Contract, Relationship, Severity, TableContract, TableRule, seconds_of, spoken


@dataclass
class ContractError(Exception):
    message: str
    where: str = ""
    line: int | None = None

    def __str__(self) -> str:
        at = ", ".join(x for x in (self.where, f"line {self.line}" if self.line else "") if x)
        return f"{at}: {self.message}" if at else self.message


class _Map(dict):
    """A mapping that knows the lines of its keys."""

    lines: dict[str, int]


class _Loader(yaml.SafeLoader):
    pass


def _mapping(loader: _Loader, node: yaml.MappingNode) -> _Map:
    out, lines = _Map(), {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in out:
            raise ContractError(f"{key!r} is there twice", line=k.start_mark.line + 1)
        out[key] = loader.construct_object(v, deep=True)
        lines[key] = k.start_mark.line + 1
    out.lines = lines
    return out


_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)
# dates stay as they are written
_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

#: Keys in the order in which they are written; the second names the attribute.
COLUMN = {k: k for k in ("means", "type", "formats", "nullable", "max_null_rate", "unique", "categories", "categories_closed", "min", "max", "fresh_within", "no_pii", "known_issues", "ignore", "on_violation")} | {"min": "minimum", "max": "maximum"}
RULE = {k: k for k in ("expr", "name", "means", "max_violation_rate", "known_issues", "ignore", "on_violation")}
TABLE = ("source", "profile_fingerprint", "min_rows", "volume_tolerance", "allow_new_columns", "allow_missing_columns", "on_violation", "columns", "rules")
RELATION = ("means", "from", "to", "cardinality", "max_orphan_rate", "known_issues", "ignore", "on_violation")
TOP = ("version", "generated_by", "generated_at", "defaults", "tables", "relationships")
TYPES = [k.value for k in Kind if k is not Kind.EMPTY]
BOOLEAN = ("nullable", "unique", "categories_closed", "no_pii", "ignore", "allow_new_columns", "allow_missing_columns")
RATES = ("max_null_rate", "max_violation_rate", "max_orphan_rate", "volume_tolerance")
LISTS = ("formats", "categories", "known_issues")


def _near(word: str, known) -> str:
    best = difflib.get_close_matches(str(word), list(known), 1, 0.6)
    return f"; did you mean {best[0]!r}?" if best else ""


class _Reader:
    def __init__(self, where: str) -> None:
        self.where = where

    def fail(self, message: str, at: Any = None, key: Any = None) -> None:
        raise ContractError(message, self.where, at.lines.get(key) if isinstance(at, _Map) else None)

    def keys(self, m: Any, known, what: str) -> _Map:
        if m is None:
            m = _Map()
            m.lines = {}
        if not isinstance(m, dict):
            self.fail(f"{what} has to be a mapping, not {type(m).__name__}")
        for k in m:
            if k not in known:
                self.fail(f"{what} knows no {k!r}{_near(k, known)}", m, k)
        return m

    def value(self, m: _Map, key: str, what: str) -> Any:
        v = m.get(key)
        if v is None:
            return None
        if key in BOOLEAN and not isinstance(v, bool):
            self.fail(f"{key} of {what} has to be true or false, not {v!r}", m, key)
        if key in RATES and (isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1):
            self.fail(f"{key} of {what} has to be a number from 0 to 1, not {v!r}", m, key)
        if key in LISTS:
            if not isinstance(v, list):
                self.fail(f"{key} of {what} has to be a list", m, key)
            return [str(x).lower() if isinstance(x, bool) else str(x) for x in v]
        if key == "on_violation":
            if str(v) not in [s.value for s in Severity]:
                self.fail(f"on_violation of {what} has to be fail, warn or ignore, not {v!r}{_near(v, [s.value for s in Severity])}", m, key)
            return Severity(str(v))
        if key == "type" and v not in TYPES:
            self.fail(f"{what} has an unknown type {v!r}{_near(v, TYPES)}", m, key)
        if key == "fresh_within":
            try:
                seconds_of(v)
            except ValueError as e:
                self.fail(f"fresh_within of {what}: {e}", m, key)
            return str(v)
        if key == "min_rows" and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
            self.fail(f"min_rows of {what} has to be a whole number, not {v!r}", m, key)
        return v

    def fill(self, out, m: _Map, names: dict[str, str], what: str):
        for key, attribute in names.items():
            if m.get(key) is not None:
                setattr(out, attribute, self.value(m, key, what))
        return out

    def column(self, name: str, m: Any, table: str) -> ColumnContract:
        what = f"column {table}.{name}"
        c = self.fill(ColumnContract(name), self.keys(m, COLUMN, what), COLUMN, what)
        if c.categories_closed and not c.categories:
            self.fail(f"{what} closes its categories but lists none", m, "categories_closed")
        lo, hi = c.minimum, c.maximum
        if isinstance(lo, (int, float)) and isinstance(hi, (int, float)) and lo > hi:
            self.fail(f"{what} has a min of {lo} above its max of {hi}", m, "min")
        return c

    def rule(self, m: Any, t: TableContract) -> TableRule:
        if isinstance(m, str):
            m = _Map(expr=m)
            m.lines = {}
        m = self.keys(m, RULE, f"a rule of {t.name}")
        if not m.get("expr"):
            self.fail(f"a rule of {t.name} has no expr", m)
        r = self.fill(TableRule(str(m["expr"])), m, {k: v for k, v in RULE.items() if k != "expr"}, f"rule {m['expr']!r}")
        try:
            validate_rule(r.expr, set(t.columns) or None)
        except RuleError as e:
            self.fail(f"rule of {t.name}: {e}", m, "expr")
        return r

    def table(self, name: str, m: Any) -> TableContract:
        what = f"table {name}"
        m = self.keys(m, TABLE, what)
        t = self.fill(TableContract(name), m, {k: k for k in TABLE if k not in ("columns", "rules")}, what)
        columns = m.get("columns") or {}
        if not isinstance(columns, dict):
            self.fail(f"columns of {what} has to be a mapping", m, "columns")
        t.columns = {str(k): self.column(str(k), v, name) for k, v in columns.items()}
        if not isinstance(m.get("rules") or [], list):
            self.fail(f"rules of {what} has to be a list", m, "rules")
        t.rules = [self.rule(r, t) for r in m.get("rules") or []]
        return t

    def relation(self, m: Any) -> Relationship:
        m = self.keys(m, RELATION, "a relationship")
        ends = []
        for key in ("from", "to"):
            if not isinstance(m.get(key), str) or "." not in m[key]:
                self.fail(f"{key} of a relationship has to be table.column, not {m.get(key)!r}", m, key)
            ends += m[key].rsplit(".", 1)
        kinds = [c.value for c in Cardinality]
        if m.get("cardinality", kinds[0]) not in kinds:
            self.fail(f"cardinality has to be {' or '.join(kinds)}, not {m['cardinality']!r}{_near(m['cardinality'], kinds)}", m, "cardinality")
        out = Relationship(*ends, Cardinality(m.get("cardinality", kinds[0])))
        return self.fill(out, m, {k: k for k in RELATION if k not in ("from", "to", "cardinality")}, f"relationship {out.key}")


def loads(text: str, where: str = "") -> Contract:
    r = _Reader(where)
    try:
        m = yaml.load(text, _Loader)  # noqa: S506  a subclass of the safe loader
    except ContractError as e:
        raise ContractError(e.message, where, e.line) from None
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise ContractError(f"this is no YAML: {getattr(e, 'problem', e)}", where, mark.line + 1 if mark else None) from None
    m = r.keys(m, TOP, "a contract")
    if m.get("version", CONTRACT_VERSION) != CONTRACT_VERSION:
        r.fail(f"version {m['version']!r} is not known; this reads version {CONTRACT_VERSION}", m, "version")
    out = Contract(CONTRACT_VERSION, str(m.get("generated_by") or ""), str(m.get("generated_at") or ""))
    defaults = r.keys(m.get("defaults"), ("on_violation",), "defaults")
    out.on_violation = r.value(defaults, "on_violation", "defaults") or Severity.FAIL
    if not isinstance(m.get("tables") or {}, dict):
        r.fail("tables has to be a mapping", m, "tables")
    out.tables = {str(k): r.table(str(k), v) for k, v in (m.get("tables") or {}).items()}
    out.relationships = [r.relation(x) for x in m.get("relationships") or []]
    keys = [x.key for x in out.relationships]
    for k in set(keys):
        if keys.count(k) > 1:
            r.fail(f"relationship {k} is there twice", m, "relationships")
    return out


def load(path: str) -> Contract:
    """The contract of a file, or of all the .yml and .yaml files of a folder."""
    if not os.path.exists(path):
        raise ContractError("there is no such contract", path)
    if not os.path.isdir(path):
        with open(path, encoding="utf-8") as f:
            return loads(f.read(), path)
    files = sorted(f for f in os.listdir(path) if f.endswith((".yml", ".yaml")))
    if not files:
        raise ContractError("the folder has no .yml file", path)
    out, default_of = None, ""
    for f in files:
        one = load(os.path.join(path, f))
        if out is None:
            out, default_of = one, f
            continue
        if one.on_violation is not out.on_violation:
            raise ContractError(f"its default on_violation differs from that of {default_of}", f)
        for name in one.tables:
            if name in out.tables:
                raise ContractError(f"table {name} is in another file as well", f)
        known = {x.key for x in out.relationships}
        for x in one.relationships:
            if x.key in known:
                raise ContractError(f"relationship {x.key} is in another file as well", f)
        out.tables |= one.tables
        out.relationships += one.relationships
    return out


class _Inline(list):
    """A list that is written on one line."""


class _Dumper(yaml.SafeDumper):
    def increase_indent(self, flow=False, indentless=False):
        return super().increase_indent(flow, False)


_Dumper.add_representer(_Inline, lambda d, x: d.represent_sequence("tag:yaml.org,2002:seq", list(x), flow_style=True))

HEADER = """\
# What these data promise. Read it, correct it, commit it; `veritab check` holds new data against it.
#
# type: integer, float, boolean, date, timestamp, email, url, uuid, json, text or mixed
# nullable, max_null_rate: whether values may be missing, and how large a share
# unique: no value twice.  min, max: the range; `today` moves with the calendar
# fresh_within: how new the newest value has to be (90m, 24h, 7d, 2w)
# categories, categories_closed: the values; if closed, no others.  formats: shapes, # a digit and a a letter
# no_pii: no personal data.  known_issues: accepted as it is.  ignore: unchecked.  on_violation: fail, warn, ignore
# Of a table: min_rows, volume_tolerance (share below the usual number of rows), rules (between columns of a row):
#   shipped_at >= ordered_at;  abs(total - paid) <= 0.01;  status = 'shipped' implies shipped_at is not null
# Delete a line to stop checking it.
"""
PROSE = {"integer": "whole numbers", "float": "numbers", "boolean": "true or false", "date": "days", "timestamp": "moments", "email": "email addresses", "url": "web addresses", "uuid": "unique ids", "json": "JSON", "text": "text", "mixed": "values of several types"}


def sentence(c: ColumnContract) -> str:
    """What the clauses of a column say."""
    if c.ignore:
        return "Unchecked."
    told = [PROSE.get(c.type or "", "any values")]
    if c.nullable is False:
        told.append("always there")
    elif c.max_null_rate is not None:
        told.append(f"missing in {c.max_null_rate:.0%} of the rows at most")
    if c.unique:
        told.append("each once")
    if c.categories_closed and c.categories:
        told.append(f"one of {len(c.categories)}")
    elif c.minimum is not None or c.maximum is not None:
        told.append(" ".join([f"from {c.minimum}"] * (c.minimum is not None) + [f"up to {c.maximum}"] * (c.maximum is not None)))
    if c.formats:
        told.append("shaped " + " or ".join(c.formats))
    if c.fresh_within:
        told.append(f"new within {spoken(c.fresh_within)}")
    return (", ".join(told) + ".").capitalize() if not c.formats else ", ".join(told)[0].upper() + ", ".join(told)[1:] + "."


def _plain(x, names: dict[str, str]) -> dict:
    out = {}
    for key, attribute in names.items():
        v = getattr(x, attribute)
        v = v.value if isinstance(v, (Severity, Cardinality)) else v
        # false says something for nullable alone
        if v is None or v == [] or v is False and key != "nullable":
            continue
        out[key] = _Inline(v) if isinstance(v, list) else v
    return out


def _yaml(x: Any, indent: int) -> list[str]:
    text = yaml.dump(x, Dumper=_Dumper, sort_keys=False, default_flow_style=False, allow_unicode=True, width=10_000)
    return [" " * indent + line for line in text.rstrip("\n").split("\n")]


def dumps(contract: Contract, header: bool = True) -> str:
    """The file of a contract. Comments are written next to what they are about."""
    top: dict[str, Any] = {"version": contract.version} | {k: v for k in ("generated_by", "generated_at") if (v := getattr(contract, k))}
    if contract.on_violation is not Severity.FAIL:
        top["defaults"] = {"on_violation": contract.on_violation.value}
    out = [*HEADER.rstrip("\n").split("\n"), ""] if header else []
    out += _yaml(top, 0)
    out.append("tables:" if contract.tables else "tables: {}")
    for name, t in contract.tables.items():
        out.append(f"  {_key(name)}:")
        body = _plain(t, {k: k for k in ("source", "profile_fingerprint", "min_rows", "volume_tolerance", "allow_missing_columns", "on_violation")})
        body = {k: v for k, v in body.items() if v != ""}
        if not t.allow_new_columns:
            body["allow_new_columns"] = False
        out += _yaml(body, 4) if body else []
        if t.suggested_rules:
            out += ["    # These held for every row that was measured. Uncomment those that are meant:", "    # rules:", *(f"    #   - {r}" for r in t.suggested_rules)]
        out.append("    columns:" if t.columns else "    columns: {}")
        for column, c in t.columns.items():
            out += [f"      # {sentence(c)}", f"      {_key(column)}:" + ("" if (body := _plain(c, COLUMN)) else " {}"), *(_yaml(body, 8) if body else [])]
        if t.rules:
            rules = [r.expr if len(d := _plain(r, RULE)) == 1 else d for r in t.rules]
            out += _yaml({"rules": rules}, 4)
    if contract.relationships:
        out += _yaml({"relationships": [{k: v for k, v in {"means": r.means, "from": r.child, "to": r.parent, "cardinality": r.cardinality.value}.items() if v} | _plain(r, {k: k for k in RELATION[4:]}) for r in contract.relationships]}, 0)
    return "\n".join(out) + "\n"


def _key(name: str) -> str:
    """name as a key of a mapping, quoted if it must be."""
    return yaml.dump({name: None}, Dumper=_Dumper, allow_unicode=True, width=10_000, default_flow_style=False).rstrip("\n").removesuffix(": null")


def dump(contract: Contract, path: str) -> None:
    """Writes a file; for a path that is a folder or ends in /, a file for each table."""
    if not (path.endswith(os.sep) or os.path.isdir(path)):
        with open(path, "w", encoding="utf-8") as f:
            f.write(dumps(contract))
        return
    os.makedirs(path, exist_ok=True)
    for name, t in contract.tables.items():
        one = Contract(contract.version, contract.generated_by, contract.generated_at, contract.on_violation, {name: t}, [r for r in contract.relationships if r.from_table == name])
        safe = "".join(c if c.isalnum() or c in "_-." else "_" for c in name) or "table"
        with open(os.path.join(path, f"{safe}.yml"), "w", encoding="utf-8") as f:
            f.write(dumps(one))
