"""Profiles, contracts, rules, relationships, history, sources, the command line."""

import json
import os
from datetime import date, datetime, timezone

import pytest
from data import MUTATIONS, messy, orders, write_csv
from pyspark.sql import functions as F

from veritab import Kind, Privacy, ProfileOptions, TableProfile, history, profile, publish
from veritab.contract import yaml_io
from veritab.contract.check import check
from veritab.contract.findings import Finding
from veritab.contract.generate import column_contract, generate, lower_bound, suggest_rules, upper_bound, DEFAULT
from veritab.contract.model import Cardinality, ColumnContract, Contract, Relationship, Severity, TableContract, TableRule, seconds_of
from veritab.functions import patterns as P, text as T
from veritab.infer import declared_family, finish
from veritab.model import Bucket, Categories, ColumnProfile, Member, NumericStats
from veritab.relations import check_relationships, infer_relationships, measure
from veritab.rules.grammar import RuleError, columns_of, parse_rule, validate_rule
from veritab.rules.measure import check_rules, measure_rules
from veritab.sources import dbt
from veritab.sources.resolve import SourceError, display_name, expand_env, jdbc_options, matching, read_jdbc, resolve


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{k}` string" for k in rows[0]))


def column(spark, values, name="x", **options):
    return profile(spark.createDataFrame([(v,) for v in values], f"`{name}` string"), "t", options=ProfileOptions(**options)).columns[0]


# ── text and patterns ────────────────────────────────────────────────────────

MATCHES = {
    "iso_date": (["2024-03-11"], ["2024-3-11", "2024-03-11\n", "2024-03-11 10:00"]),
    "iso_datetime": (["2024-03-11T14:20:00", "2024-03-11 14:20"], ["2024-03-11"]),
    "us_date": (["3/11/2024", "03/11/2024"], ["3/11/24"]),
    "eu_date": (["11.03.2024"], ["11-03-2024"]),
    "compact_date": (["20240311"], ["2024031"]),
    "epoch_seconds": (["1714089600"], ["2714089600", "171408960"]),
    "epoch_millis": (["1714089600000"], ["1714089600"]),
    "excel_serial": (["45231"], ["15231", "452310"]),
    "year_only": (["1999", "2024"], ["2124"]),
    "currency": (["$1,299.00", "€ 5", "-£3.50"], ["1299"]),
    "percent": (["12.5%", "3 %"], ["12.5"]),
    "thousands_separated": (["1,299,000", "-1,000.5"], ["1299"]),
    "scientific": (["1.2e6", "3E-4"], ["1.2"]),
    "leading_zeros": (["00123"], ["0", "123"]),
    "uuid": (["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]),
    "json_object": (['{"a": 1}', " [1,\n2] "], ["a {1}"]),
    "url": (["https://x.y/z"], ["ftp://x", "https://a b"]),
    "null_word": (["N/A", "null", "-", "NaN"], ["nothing"]),
    "mojibake": (["cafÃ©", "Â£"], ["café"]),
    "postal_like": (["12345", "12345-6789"], ["1234"]),
    "email": (["a@b.co"], ["a@b", "mail a@b.co"]),
    "email_embedded": (["mail a@b.co now"], ["a at b.co"]),
    "phone_formatted": (["555-123-4567", "(555) 123-4567", "555.123.4567"], ["5551234567", "11.03.2024"]),
    "phone_international": (["+49 30 1234567"], ["49301234567"]),
    "ssn": (["123-45-6789"], ["123-456-789"]),
    "credit_card": (["4111 1111 1111 1111"], ["4111111111111111"]),
    "ipv4": (["10.0.0.1"], ["10.0.0"]),
    "iban": (["DE89370400440532013000"], ["de89370400440532013000"]),
}


def test_every_pattern_in_spark(spark):
    assert set(MATCHES) == set(P.BY_KEY)
    rows = [(k, v, yes) for k, (good, bad) in MATCHES.items() for yes, vs in ((True, good), (False, bad)) for v in vs]
    df = spark.createDataFrame(rows, "key string, v string, want boolean")
    for key, p in P.BY_KEY.items():
        got = df.where(F.col("key") == key).select("v", "want", (F.lower("v") if p.lower else F.col("v")).rlike(P.java(p.regex)).alias("got")).collect()
        assert all(r["want"] == r["got"] for r in got), (key, got)


def test_guarded_casts(spark):
    rows = ["2024", "12345", "2024-03", "2024-03-11", "2024/03/11", "2024-03-11 junk", "2024-03-11T10:00:00Z", "10:00", "1d", "1.5F", "1_000", "1e5", "abc", "2024-02-30"]
    got = {r["v"]: r for r in spark.createDataFrame([(v,) for v in rows], "v string").select("v", T.number(F.col("v")).alias("n"), T.day(F.col("v")).alias("d"), T.moment(F.col("v")).alias("m")).collect()}
    assert [k for k, r in got.items() if r["d"] is not None] == ["2024-03-11", "2024/03/11", "2024-03-11T10:00:00Z"]
    assert [k for k, r in got.items() if r["n"] is not None] == ["2024", "12345", "1_000", "1e5"] and got["1_000"]["n"] == 1000
    assert got["10:00"]["m"] is None and got["2024-03-11 junk"]["m"] is None


def test_doubles_as_text(spark):
    values = [1e7, 1.5e-4, 1e-5, 1e16, 123456789.125, 0.1, -2.0, float("inf"), float("nan"), 1e15, -1.25e-7]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(T.text_form(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == ["10000000.0", "0.00015", "1e-05", "1e+16", "123456789.125", "0.1", "-2.0", "inf", "nan", "1000000000000000.0", "-1.25e-07"]


def test_shapes_and_trimming(spark):
    df = spark.createDataFrame([("AB-12 \tx",), ("  pad　",), ("\ttab",), ("é9" * 30,)], "t string")
    got = [tuple(r) for r in df.select(T.shape(F.col("t")), T.valued(F.col("t"))).collect()]
    assert got[0][0] == "aa-##__a" and got[1][1] == "pad" and got[2][1] == "\ttab" and got[3][0] == "é#" * 20
    assert T.masked("Ab 1é-" + "x" * 70).startswith("aa_#a-") and T.masked("x" * 70).endswith("…")


# ── inference ────────────────────────────────────────────────────────────────


def synthetic(valued=100, distinct=50, probes=None, hits=None, declared="unknown", **more) -> ColumnProfile:
    return finish(ColumnProfile("x", declared_type=declared, row_count=valued, distinct_count=distinct, type_probes=probes or {}, pattern_hits=hits or {}, **more))


@pytest.mark.parametrize(("probes", "hits", "distinct", "want"), [
    ({}, {}, 50, Kind.TEXT), ({"integer": 100, "float": 100}, {}, 50, Kind.INTEGER), ({"integer": 10, "float": 100}, {}, 50, Kind.FLOAT),
    ({"integer": 100, "float": 100, "boolean": 100}, {}, 2, Kind.BOOLEAN), ({"integer": 100, "float": 100, "boolean": 100}, {}, 4, Kind.INTEGER),
    ({"date": 100, "timestamp": 100}, {"iso_date": 100}, 50, Kind.DATE), ({"date": 100, "timestamp": 100}, {"iso_datetime": 100}, 50, Kind.TIMESTAMP),
    ({}, {"us_date": 100}, 50, Kind.DATE), ({"timestamp": 100}, {}, 50, Kind.TIMESTAMP), ({"integer": 40, "float": 40, "date": 40}, {"iso_date": 40}, 50, Kind.MIXED),
    ({}, {"uuid": 95}, 50, Kind.UUID), ({}, {"email": 90}, 50, Kind.EMAIL), ({}, {"url": 91}, 50, Kind.URL), ({}, {"json_object": 99}, 50, Kind.JSON),
])
def test_types(probes, hits, distinct, want):
    assert synthetic(probes=probes, hits=hits, distinct=distinct).inferred_type is want


def test_empty_and_unique():
    assert finish(ColumnProfile("x", row_count=5, null_count=5)).observations == ["empty_column"]
    assert finish(ColumnProfile("x", row_count=5, null_count=5)).inferred_type is Kind.EMPTY
    assert {"unique", "constant"} & set(synthetic(1, 1).observations) == {"unique", "constant"}


def test_observations():
    c = synthetic(probes={"date": 97, "timestamp": 97, "integer": 3, "float": 3}, hits={"iso_date": 97, "epoch_seconds": 3}, declared="varchar")
    assert {"mixed_types", "epoch_suspected"} <= set(c.observations) and c.type_mixture == {"integer": 0.03, "date": 0.97}
    assert "epoch_suspected" not in synthetic(probes={"integer": 100, "float": 100}, hits={"epoch_seconds": 50}).observations
    assert "epoch_suspected" in synthetic(probes={"integer": 100, "float": 100}, hits={"epoch_seconds": 95}).observations
    assert "mixed_types" not in synthetic(probes={"integer": 40, "float": 100}).observations
    assert "numeric_stored_as_text" in synthetic(probes={"integer": 100, "float": 100}, declared="string").observations
    assert "declared_type_conflict" in synthetic(probes={"date": 100}, declared="bigint").observations
    assert "mixed_boolean_encoding" in synthetic(probes={"boolean": 95, "integer": 10}, distinct=6).observations
    assert [declared_family(x) for x in ("FLOAT[]", "timestamp_ntz", "decimal(10,2)", "interval", "", "binary")] == ["float", "timestamp", "float", "integer", "unknown", "other"]


# ── profiles ─────────────────────────────────────────────────────────────────


def test_profile_of_orders(spark):
    p = profile(frame(spark, orders()), "orders")
    assert {c.name: c.inferred_type.value for c in p.columns} == {"order_id": "integer", "customer_email": "email", "signup_date": "date", "status": "text", "amount": "float", "country": "text", "item_count": "integer"}
    assert p.row_count == 100 and p.column("order_id").is_unique and p.column("status").enum.complete
    a = p.column("amount").numeric
    values = [float(r["amount"]) for r in orders()]
    assert a.minimum == min(values) and a.maximum == max(values) and abs(a.mean - sum(values) / 100) < 1e-9 and a.p50 == pytest.approx(sorted(values)[49] / 2 + sorted(values)[50] / 2)
    assert a.stddev == pytest.approx((sum((v - a.mean) ** 2 for v in values) / 99) ** 0.5)
    assert p.column("signup_date").dominant_shape.shape == "####-##-##" and p.column("signup_date").temporal.minimum == "2024-01-01 00:00:00"
    assert TableProfile.from_dict(json.loads(p.to_json())).to_dict() == p.to_dict()


def test_profile_of_messy(spark):
    p = profile(frame(spark, messy()), "messy")
    has = lambda c, *o: set(o) <= set(p.column(c).observations)
    assert has("account_code", "leading_zeros") and has("full_name", "whitespace_padding") and has("revenue", "currency_in_text") and has("growth_rate", "percent_in_text")
    assert has("signup_date", "null_words", "multiple_date_formats") and has("notes", "pii_in_free_text", "pii_detected", "mojibake") and has("status", "inconsistent_case")


def test_odd_tables(spark):
    empty = profile(spark.createDataFrame([], "a string, b int"), "e")
    assert empty.row_count == 0 and [c.inferred_type for c in empty.columns] == [Kind.EMPTY] * 2
    assert column(spark, [None, None]).is_empty and column(spark, ["", " ", None]).blank_count == 2
    p = profile(spark.createDataFrame([(1, 2.5, True, None, [1], "x")], "`a.b` int, `c d` double, e boolean, f string, g array<int>, `h``i` string"), "t")
    assert [c.name for c in p.columns] == ["a.b", "c d", "e", "f", "g", "h`i"] and p.column("e").inferred_type is Kind.BOOLEAN


def test_long_texts_are_measured_alike(spark):
    rows = ["word " * 100 + str(i % 7) for i in range(50)] + [None, ""]
    c = column(spark, rows)
    assert (c.row_count, c.null_count, c.blank_count, c.distinct_count, c.text.max_length) == (52, 1, 1, 8, 501)
    assert c.enum.cardinality == 8 and column(spark, rows, exact_distinct=False).distinct_is_approx


def test_privacy(spark):
    strict = column(spark, ["a", "a", "b", "b"], privacy=Privacy.STRICT)
    assert all(m.value.startswith("sha256:") and len(m.value) == 19 for m in strict.enum.members) and strict.enum.hashed and not strict.samples
    assert column(spark, ["b", "a", "a"], privacy=Privacy.FULL).samples == ["a", "b"] and column(spark, ["a", "a"]).samples == []


# ── contracts ────────────────────────────────────────────────────────────────


def test_bounds():
    assert [upper_bound(x, DEFAULT) for x in (564, 77, -72.6, 0)] == [1200, 160, -36, 0]
    assert [lower_bound(x, DEFAULT, m) for x, m in ((-120, 0), (0, 10), (94, 200), (5, 100), (29, 77))] == [-300, 0, 40, 0, 10]


def test_generated_contract(spark):
    t = generate(profile(frame(spark, orders()), "orders"), today=date(2024, 6, 1)).tables["orders"]
    c = t.columns
    assert t.min_rows == 50 and c["order_id"].unique and c["order_id"].minimum is None and c["status"].categories_closed and c["status"].categories == sorted({r["status"] for r in orders()})
    assert c["signup_date"].formats == ["####-##-##"] and c["signup_date"].minimum == "2024-01-01" and c["signup_date"].maximum == "today"
    assert c["amount"].minimum == 0 and c["amount"].maximum == 740 and not c["customer_email"].no_pii and c["country"].no_pii and (c["item_count"].minimum, c["item_count"].maximum) == (0, 12)


def test_categories_stay_open():
    def closed(name="kind", kind=Kind.TEXT, counts=(50, 50), **more):
        e = Categories([Member(str(i), n) for i, n in enumerate(counts)], True, len(counts))
        return column_contract(ColumnProfile(name, inferred_type=kind, row_count=sum(counts), distinct_count=len(counts), enum=e, **more)).categories_closed

    assert closed() and closed(kind=Kind.INTEGER) and not closed("error_count", Kind.INTEGER) and not closed(kind=Kind.FLOAT) and not closed("city")
    assert not closed(counts=(20, 19, 1)) and closed(counts=(50, 49, 1)) and not closed(kind=Kind.DATE) and not closed(observations=["currency_in_text"])


def test_a_contract_holds_for_its_own_data(spark):
    for rows in (orders(), messy()):
        p = profile(frame(spark, rows), "t")
        c = generate(p)
        again = yaml_io.loads(yaml_io.dumps(c))
        for contract in (c, again):
            assert check(p, contract).violations == []
        assert yaml_io.dumps(again) == yaml_io.dumps(c)


@pytest.mark.parametrize("name", MUTATIONS)
def test_mutations_are_found(spark, name):
    change, want, prepare, patch = (*MUTATIONS[name], None, None)[:4]
    rows = prepare(orders()) if prepare else orders()
    before = [{k: v or None for k, v in r.items()} for r in rows]
    contract = generate(profile(frame(spark, before), "orders"))
    if patch:
        patch(contract.tables["orders"])
    assert check(profile(frame(spark, before), "orders"), contract).violations == [] or name == "stale_data"
    after = frame(spark, [{k: v or None for k, v in r.items()} for r in change(rows)])
    report = check(profile(after, "orders"), contract)
    t = contract.tables["orders"]
    report.violations += check_rules(contract, measure_rules(after, "orders", t.rules, {k: c.type for k, c in t.columns.items()}))
    found = {v.type.value for v in report.violations}
    assert found & want, found
    assert len(found - want) <= 2, found


def test_severities():
    c = Contract(tables={"t": TableContract("t", columns={"a": ColumnContract("a")})})
    t, a = c.tables["t"], c.tables["t"].columns["a"]
    assert c.severity(Severity.FAIL, t, a) is Severity.FAIL and c.severity(Severity.WARN, t, a) is Severity.WARN
    c.on_violation = Severity.WARN
    assert c.severity(Severity.FAIL, t, a) is Severity.WARN
    t.on_violation, a.on_violation = Severity.FAIL, Severity.IGNORE
    assert c.severity(Severity.WARN, t) is Severity.FAIL and c.severity(Severity.FAIL, t, a) is Severity.IGNORE
    assert [seconds_of(x) for x in ("90m", "24h", "7d", "2W")] == [5400, 86400, 604800, 1209600]
    for bad in ("24", "0h", "1y", ""):
        with pytest.raises(ValueError):
            seconds_of(bad)


def test_single_findings():
    def found(p, c, **table):
        p.name = c.name = "x"
        t = TableProfile("t", row_count=p.row_count, columns=[p])
        return {v.type.value for v in check(t, Contract(tables={"t": TableContract("t", columns={"x": c}, **table)}), datetime(2024, 6, 2)).violations}

    n = lambda **k: ColumnProfile("x", row_count=100, distinct_count=100, **k)
    assert found(n(inferred_type=Kind.TEXT), ColumnContract("x", type="integer")) == {"type_changed"}
    assert found(n(inferred_type=Kind.INTEGER), ColumnContract("x", type="float")) == set()
    assert found(n(inferred_type=Kind.INTEGER, type_mixture={"integer": 0.995, "text": 0.005}), ColumnContract("x", type="integer")) == {"type_contaminated"}
    assert found(n(inferred_type=Kind.INTEGER, type_mixture={"integer": 0.995, "text": 0.005}), ColumnContract("x", type="integer", known_issues=["mixed_types"])) == set()
    assert found(n(null_count=3), ColumnContract("x", nullable=False)) == {"nullability_violated"}
    assert found(n(null_count=30), ColumnContract("x", nullable=True, max_null_rate=0.2)) == {"null_rate_exceeded"}
    assert found(n(inferred_type=Kind.FLOAT, numeric=NumericStats(0, 5000)), ColumnContract("x", type="float", maximum=100)) == {"unit_shift_suspected"}
    assert found(n(inferred_type=Kind.FLOAT, numeric=NumericStats(-1, 150)), ColumnContract("x", type="float", minimum=0, maximum=100)) == {"range_exceeded"}
    assert found(n(), ColumnContract("x", categories=["a"], categories_closed=True)) == {"categories_unverifiable"}
    assert found(n(shapes=[Bucket("##", 99, 0.99), Bucket("a", 1, 0.01)]), ColumnContract("x", formats=["##"])) == {"format_changed"}
    assert found(n(pattern_hits={"ssn": 1}), ColumnContract("x", no_pii=True)) == {"pii_appeared"}
    assert found(n(), ColumnContract("x"), min_rows=101) == {"row_count_below_min"}
    assert check([], Contract(tables={"t": TableContract("t")})).violations[0].type is Finding.TABLE_MISSING


def test_contract_files(tmp_path):
    text = """
version: 1
tables:
  t:
    min_rows: 5
    columns:
      a: {type: integer, min: 0, max: today, categories: [1, true, x]}
    rules:
      - a > 1
      - {expr: a < 9, max_violation_rate: 0.1}
relationships:
  - {from: t.a, to: u.id, cardinality: one_to_one}
"""
    c = yaml_io.loads(text)
    assert c.tables["t"].columns["a"].categories == ["1", "true", "x"] and c.tables["t"].rules[1].max_violation_rate == 0.1 and c.relationships[0].cardinality is Cardinality.ONE_TO_ONE
    for old, new, line, told in (("integer", "intger", 7, "integer"), ("min_rows: 5", "min_row: 5", 5, "min_rows"), ("a > 1", "b > 1", None, "no column"), ("0.1", "3", 10, "0 to 1"), ("one_to_one", "one_to_on", 12, "one_to_one"), ("version: 1", "version: 9", 2, "version"), ("min_rows: 5", "min_rows: [", None, "")):
        with pytest.raises(yaml_io.ContractError) as e:
            yaml_io.loads(text.replace(old, new, 1), "f.yml")
        assert told in str(e.value) and (line is None or e.value.line == line), str(e.value)
    folder = tmp_path / "contracts"
    folder.mkdir()
    two = Contract(tables={"t": c.tables["t"], "u v": TableContract("u v", columns={"id: x": ColumnContract("id: x", type="text", means="it's # odd")})}, relationships=c.relationships)
    yaml_io.dump(two, str(folder))
    back = yaml_io.load(str(folder))
    assert back.tables == two.tables and back.relationships == two.relationships
    (folder / "more.yml").write_text("tables: {t: {columns: {}}}")
    with pytest.raises(yaml_io.ContractError, match="another file"):
        yaml_io.load(str(folder))


def test_describers():
    p = TableProfile("t", row_count=100, columns=[ColumnProfile("a", inferred_type=Kind.INTEGER, row_count=100, distinct_count=90, numeric=NumericStats(1, 9))])
    c = generate(p, describer=lambda *_: {"a": {"means": "a number", "withdraw": ["max"]}, "zz": "?"}).tables["t"].columns["a"]
    assert c.means == "a number" and c.maximum is None and c.minimum is not None
    assert generate(p, describer=lambda *_: 1 / 0).tables["t"].columns["a"].maximum == 18


# ── rules ────────────────────────────────────────────────────────────────────


def test_grammar():
    col, val = (lambda n: ("column", n)), (lambda v: ("value", v))
    assert parse_rule("a or b and not c = 1") == ("or", col("a"), ("and", col("b"), ("not", ("=", col("c"), val(1)))))
    assert parse_rule("a implies b implies c") == ("implies", col("a"), ("implies", col("b"), col("c")))
    assert parse_rule("a - b - 2 * -c <= .5") == ("<=", ("-", ("-", col("a"), col("b")), ("*", val(2), ("negative", col("c")))), val(0.5))
    assert parse_rule("\"od\"\"d\" <> 'it''s'") == ("!=", col('od"d'), val("it's"))
    assert parse_rule("NOT abs(a) is NOT null") == ("not", ("is not null", ("abs", col("a")))) and parse_rule("a == TRUE") == ("=", col("a"), val(True))
    assert columns_of(parse_rule("length(a) > b + 1 implies c is null")) == {"a", "b", "c"}
    for bad in ("", "a >", "a > > b", "(a", "a b", "sum(a) > 1", "abs(a, b) > 1", "a = 1 = 2", "a ; b", "abs() > 1", "1 + not a"):
        with pytest.raises(RuleError):
            parse_rule(bad)
    with pytest.raises(RuleError, match="amount"):
        validate_rule("amont > 1", {"amount"})


def test_measured_rules(spark):
    df = spark.createDataFrame([("1", "2", "x"), ("3", "2", "xyz"), (None, "2", ""), ("z", "0", None)], "a string, b string, c string")
    kinds = {"a": "float", "b": "integer"}
    rules = [TableRule(r) for r in ("a < b", "length(c) <= 1", "a > b implies c = 'xyz'", "nope > 1", "a / b > 0", "c is not null or b = 0", "a < b and nope = 1")]
    got = measure_rules(df, "t", [*rules, TableRule("a > 0", ignore=True)], kinds)
    assert [(m.rows, m.judged, m.broken) for m in got if m.error is None] == [(4, 2, 1), (4, 3, 1), (4, 2, 0), (4, 2, 0), (4, 4, 0)]
    assert [m.rule.expr for m in got if m.error] == ["nope > 1", "a < b and nope = 1"]
    c = Contract(tables={"t": TableContract("t")})
    found = check_rules(c, got)
    assert [(v.severity, v.expected) for v in found] == [(Severity.FAIL, "a < b"), (Severity.FAIL, "length(c) <= 1"), (Severity.WARN, "nope > 1"), (Severity.WARN, "a < b and nope = 1")]
    got[0].rule.max_violation_rate = 0.5
    assert len(check_rules(c, got)) == 3


def test_suggested_rules():
    t = TableContract("t", columns={n: ColumnContract(n, type="date") for n in ("created_at", "shipped at", "vendor_day")})
    assert suggest_rules(t) == ['"shipped at" >= created_at']


# ── relationships ────────────────────────────────────────────────────────────


@pytest.mark.parametrize(("child", "parent", "want"), [
    (["1", "2", "1"], ["1", "2"], (3, 3, 0, 0, 0)), (["1", "99", "1"], ["1", "2"], (3, 3, 1, 1, 0)), (["99", "99", "99", "1"], ["1"], (4, 4, 3, 1, 0)), ([None, "", " ", "1"], ["1"], (4, 1, 0, 0, 0)),
    (["123"], ["00123"], (1, 1, 1, 1, 0)), ([" 1 "], ["1"], (1, 1, 0, 0, 0)), (["1", "1", "9"], ["1", "1", "2"], (3, 3, 1, 1, 1)), ([], [], (0, 0, 0, 0, 0)),
])
def test_orphans(spark, child, parent, want):
    df = lambda v, n: spark.createDataFrame([(x,) for x in v], f"{n} string")
    m = measure(Relationship("c", "k", "p", "id"), df(child, "k"), df(parent, "id"))
    assert (m.child_rows, m.child_valued, m.orphan_rows, m.orphan_keys, m.parent_duplicates) == want


def test_relationship_findings(spark):
    df = spark.createDataFrame([("1",), ("1",), ("9",)], "k string")
    c = Contract(tables={"c": TableContract("c")})
    m = measure(Relationship("c", "k", "p", "k"), df, df.where("k = '1'"))
    assert {v.type.value for v in check_relationships(c, [m])} == {"fk_orphans", "fk_fanout"}
    m.relationship.max_orphan_rate = 1 / 3
    assert {v.type.value for v in check_relationships(c, [m])} == {"fk_fanout"}
    gone = measure(Relationship("c", "zz", "p", "k"), df, df)
    assert [v.type.value for v in check_relationships(c, [gone, measure(Relationship("c", "k", "q", "k"), df, None)])] == ["relationship_uncheckable"] * 2


def test_inferred_relationships():
    def t(name, rows, **columns):
        return TableProfile(name, row_count=rows, columns=[ColumnProfile(k, row_count=rows, distinct_count=d) for k, d in columns.items()])

    found = infer_relationships([t("customers", 100, id=100, country_code=5), t("orders", 500, order_id=500, customer_id=90, country_code=9), t("dim_city", 20, city_id=20), t("lines", 900, order_id=480, city_id=20, paid=2)])
    assert [r.key for r in found] == ["lines.city_id->dim_city.city_id", "lines.order_id->orders.order_id", "orders.customer_id->customers.id"]
    assert infer_relationships([t("a", 100, a_id=100)]) == []


# ── history ──────────────────────────────────────────────────────────────────


def test_history(tmp_path):
    folder = str(tmp_path / ".veritab" / "history")
    for n in [*range(1000, 1105)]:
        history.append("a/b", history.Snapshot("t", n), folder)
    runs = history.read("a/b", folder)
    assert len(runs) == 100 and runs[-1].rows == 1104 and os.path.exists(tmp_path / ".veritab" / ".gitignore")
    with open(history.path_of("a/b", folder), "a") as f:
        f.write("garbage\n{}\n")
    assert len(history.read("a/b", folder)) == 100 and history.read("none", folder) == []
    assert history.trend(runs[:2], 5) is None and history.trend(runs, 527).drop == pytest.approx(0.5, abs=0.01)
    c = Contract(tables={"t": TableContract("t")})
    p = TableProfile("t", row_count=500)
    assert [v.severity for v in history.check_volume(c, p, runs)] == [Severity.WARN]
    c.tables["t"].volume_tolerance = 0.2
    assert [v.severity for v in history.check_volume(c, p, runs)] == [Severity.FAIL]
    c.tables["t"].volume_tolerance = 0.6
    assert history.check_volume(c, p, runs) == []


# ── sources ──────────────────────────────────────────────────────────────────


def test_sources(spark, tmp_path, monkeypatch):
    rows = [{"id": "001", "note": 'a "quoted",\nline'}, {"id": "002", "note": ""}]
    s = resolve(write_csv(tmp_path / "My Data-1.csv", rows), spark)
    assert s.name == "my_data_1" and s.text.dtypes == [("id", "string"), ("note", "string")] and s.declared["id"] == "bigint"
    assert [tuple(r) for r in s.text.collect()] == [("001", 'a "quoted",\nline'), ("002", None)]
    p = profile(s.text, declared=s.declared)
    assert p.columns[0].declared_type == "string" and "leading_zeros" in p.columns[0].observations
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert resolve(str(tmp_path / "t.tsv"), spark).text.columns == ["a", "b"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}, {"a": 3}]')
    assert resolve(str(tmp_path / "l.jsonl"), spark).text.count() == 2 and resolve(str(tmp_path / "a.json"), spark).text.count() == 3
    spark.range(5).write.parquet(str(tmp_path / "p.parquet"))
    assert resolve(str(tmp_path / "p.parquet"), spark).text.count() == 5 and resolve(f"file://{tmp_path}/p.parquet", spark).text.count() == 5
    for i in (1, 2):
        write_csv(tmp_path / f"part_{i}.csv", rows)
    assert resolve(str(tmp_path / "part_*.csv"), spark).text.count() == 4
    spark.range(3).createOrReplaceTempView("some_view")
    assert resolve("table://some_view", spark).text.count() == 3
    for bad, error in (("", SourceError), (str(tmp_path / "no.csv"), FileNotFoundError), (str(tmp_path / "no*.csv"), FileNotFoundError), ("https://x/y.csv", SourceError), ("postgres://h/db", SourceError), ("odd://x", SourceError)):
        with pytest.raises(error):
            resolve(bad, spark)
    assert [display_name(x) for x in ("a/b.csv.gz", "s3://x/Y-z.parquet", "***", "data/*.csv")] == ["b", "y_z", "source", "source"]
    monkeypatch.setenv("PW", "secret")
    assert jdbc_options("postgres://u:${PW}@h:5/db", "t") == {"url": "jdbc:postgresql://h:5/db", "dbtable": "public.t", "user": "u", "password": "secret"}
    assert jdbc_options("sqlite:///x/y.db", "t") == {"url": "jdbc:sqlite:/x/y.db", "dbtable": "t"}
    with pytest.raises(SourceError, match="NOPE"):
        expand_env("${NOPE}")
    tables = [("public", "stg_a"), ("public", "b"), ("pg_catalog", "stg_c"), ("other", "stg_d")]
    assert matching(tables, "public.stg_*") == ["stg_a"] and matching(tables, "stg_*") == ["other.stg_d", "public.stg_a"]
    with pytest.raises(SourceError):
        matching(tables, "x.*")


def test_dbt(tmp_path):
    node = lambda kind, name, **k: {"resource_type": kind, "name": name, "schema": "s"} | k
    m = {"nodes": {"m.o": node("model", "orders"), "m.c": node("model", "customers", alias="dim_customers"), "m.h": node("model", "helper", config={"materialized": "ephemeral"}), "s.c": node("seed", "codes"), "t.x": node("test", "check")}}
    (tmp_path / "m.json").write_text(json.dumps(m))
    loaded = dbt.load_manifest(str(tmp_path / "m.json"))
    assert dbt.sources(loaded, "postgres://h/db") == [("codes", "postgres://h/db#s.codes"), ("customers", "postgres://h/db#s.dim_customers"), ("orders", "postgres://h/db#s.orders")]
    assert dbt.sources(loaded, "table://", ["m.o"]) == [("orders", "table://s.orders")]
    with pytest.raises(SourceError, match="codes"):
        dbt.models(loaded, ["nope"])
    with pytest.raises(SourceError):
        dbt.sources(loaded, "")
    with pytest.raises(SourceError):
        dbt.load_manifest(str(tmp_path / "none.json"))


def test_csv_is_split_unless_values_have_line_ends(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x ""y"" z"\n2,w\n')
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n2,w\n')
    plain, broken = resolve(str(tmp_path / "plain.csv"), spark), resolve(str(tmp_path / "broken.csv"), spark)
    assert [tuple(r) for r in plain.text.collect()] == [("1", 'x "y" z'), ("2", "w")]
    assert [tuple(r) for r in broken.text.collect()] == [("1", "x\ny"), ("2", "w")] and broken.declared["a"] == "bigint"


def test_databases_are_read_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    given = {"url": url, "dbtable": "numbers", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        spark.range(100).selectExpr("cast(id as int) AS id", "cast(id * 2 as int) AS x").write.format("jdbc").options(**given).save()
    except Exception as e:
        pytest.skip(f"no database here: {str(e)[:80]}")
    got = read_jdbc(spark, given, {"partitionColumn": "id", "numPartitions": 5})
    assert got.rdd.getNumPartitions() == 5 and got.count() == 100 and read_jdbc(spark, given).rdd.getNumPartitions() == 1
    assert profile(got, "numbers").row_count == 100


# ── reports and the command line ─────────────────────────────────────────────


def report_of(spark):
    contract = generate(profile(frame(spark, orders()), "orders"))
    change = MUTATIONS["new_category"][0]
    return check(profile(frame(spark, change(orders())), "orders"), contract)


def test_publishing(spark):
    r = report_of(spark)
    assert "awaiting_pickup" in r.text() and "awaiting_pickup" in publish.markdown(r, show_values=True)
    for out in (publish.markdown(r), json.dumps(publish.slack(r)), json.dumps(publish.payload(r, "me/x"))):
        assert "awaiting_pickup" not in out and "new_category" in out
    assert publish.payload(r, "me/x")["findings"][0]["metrics"] == {"new_categories_count": 1}
    assert r.to_df(spark).count() == len(r.violations) and json.loads(r.to_json())["failed"] == 1
    many = r.violations * 12
    r.violations = many
    assert len(publish.slack(r)["blocks"]) == 12
    with pytest.raises(ValueError):
        publish.post("file:///etc/passwd", {})


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from veritab.cli import main

    monkeypatch.chdir(tmp_path)
    data = write_csv(tmp_path / "orders.csv", orders())
    assert main(["init", data]) == 0 and main(["init", data]) == 2 and main(["check"]) == 0
    write_csv(tmp_path / "orders.csv", MUTATIONS["new_category"][0](orders()))
    capsys.readouterr()
    assert main(["check", "--json"]) == 1
    assert json.loads(capsys.readouterr().out)["violations"][0]["type"] == "new_category"
    assert main(["check", "--warn-only"]) == 0 and main(["check", "--warn-only", "--fail-on-warn"]) == 1
    assert main(["explain", "status"]) == 0 and "new_category" in capsys.readouterr().out
    assert main(["accept", "--dry-run"]) == 0 and main(["check"]) == 1
    assert main(["accept"]) == 0 and main(["check", "--no-history", "--format", "markdown"]) == 0
    os.remove(data)
    assert main(["check"]) == 1 and "table_missing" in capsys.readouterr().out
    assert main(["check", "-c", "none.yml"]) == 2 and main([]) == 0 and main(["explain", "nope"]) == 2


def test_now_is_utc():
    p = ColumnProfile("x", inferred_type=Kind.TIMESTAMP, row_count=1, distinct_count=1)
    from veritab.model import TemporalStats

    p.temporal = TemporalStats(maximum="2024-06-01 00:00:00")
    t = TableProfile("t", row_count=1, columns=[p])
    c = Contract(tables={"t": TableContract("t", columns={"x": ColumnContract("x", type="timestamp", fresh_within="24h")})})
    assert check(t, c, datetime(2024, 6, 1, 12, tzinfo=timezone.utc)).kept() and not check(t, c, datetime(2024, 6, 3)).kept()


# ── the registry ─────────────────────────────────────────────────────────────


def test_catalogue_is_registered():
    import __spark_entry__ as e

    from veritab import catalogue

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_and_some_sql(spark, sf):
    import __spark_entry__ as e
    import duckdb

    from veritab import catalogue

    assert e.entry(spark).count() == 6
    con = duckdb.connect()
    for t in catalogue.COLUMNS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("profile_orders", "probes_events", "shape_topk_customer", "enum_members_part", "fk_orphans_filtered", "rule_implies", "patterns_structural_events", "check_self_orders", "column_drift"):
        q = con.execute(catalogue.oracle_sql()[name])
        columns = [c[0] for c in q.description]
        got = catalogue.queries()[name](spark, sf)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, q.fetchall())), name


def test_streams_are_checked(spark, tmp_path):
    from veritab.streaming.monitor import monitor

    rows = frame(spark, orders())
    contract = generate(profile(rows, "orders"))
    contract.tables["orders"].min_rows = None
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    MUTATIONS["new_category"][0](orders())
    frame(spark, MUTATIONS["new_category"][0](orders())).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitor(stream, "orders", contract, lambda n, r: told.append({v.type.value for v in r.violations}), str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    assert sorted(map(sorted, told)) == [[], ["new_category"]]
