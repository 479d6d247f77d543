"""The command line: init, check, explain, accept, profile. Exit codes: 0 kept, 1 broken, 2 could not be done."""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys

from . import __version__

CONTRACT = "veritab.yml"


class CliError(Exception):
    """Something that the caller has to put right."""


def _spark(args):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("veritab").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if args.threads:
        b = b.master(f"local[{args.threads}]")
    if args.memory_limit:
        b = b.config("spark.driver.memory", args.memory_limit)
    return b.getOrCreate()


def _options(args):
    from .operators.profile import Privacy, ProfileOptions

    return ProfileOptions(privacy=Privacy(args.privacy), max_enum_cardinality=args.max_categories, column_batch_size=args.batch_size)


def _csv_options(args) -> dict:
    return dict(x.split("=", 1) for x in args.csv_option or [])


class _Run:
    """Sources that are resolved and profiled once."""

    def __init__(self, args) -> None:
        self.args, self.spark, self.frames = args, _spark(args), {}

    def profile(self, source: str, name: str | None = None):
        from .operators.profile import profile
        from .sources.resolve import resolve

        s = resolve(source, self.spark, name, _csv_options(self.args))
        self.frames[s.name] = s.text
        return profile(s.text, s.name, s.uri, _options(self.args), s.declared)

    def named(self, sources: list[str]) -> list:
        from .sources import dbt
        from .sources.resolve import expand

        if self.args.dbt:
            pairs = dbt.sources(dbt.load_manifest(self.args.dbt), self.args.warehouse, self.args.models)
            return [self.profile(s, n) for n, s in pairs]
        every = [x for s in sources for x in expand(s, self.spark)]
        if self.args.table and len(every) > 1:
            raise CliError("--table names one source; there are several")
        return [self.profile(s, self.args.table) for s in every]

    def of_contract(self, contract, sources: list[str]) -> list:
        """The profiles of the sources, or else of the contract's own; a table that is gone is left out."""
        if sources or self.args.dbt:
            return self.named(sources)
        out = []
        for name, t in contract.tables.items():
            if not t.source:
                raise CliError(f"the contract has no source for {name}; name one")
            try:
                out.append(self.profile(t.source, name))
            except FileNotFoundError as e:
                print(f"{name}: {e}", file=sys.stderr)
        return out


def _scoped(contract, profiles):
    from .contract.model import Contract

    names = {p.name for p in profiles}
    both = [r for r in contract.relationships if {r.from_table, r.to_table} <= names]
    return Contract(contract.version, contract.generated_by, contract.generated_at, contract.on_violation, {k: t for k, t in contract.tables.items() if k in names}, both)


def full_check(contract, profiles, frames, history_folder: str | None = None):
    """All checks: columns, volume, rules, relationships. frames: the data by table."""
    from . import history
    from .contract.check import check
    from .contract.findings import Finding
    from .relations import check_relationships, measure
    from .rules.measure import check_rules, measure_rules

    report = check(profiles, contract)
    if history_folder:
        for p in profiles:
            report.violations += history.check_volume(contract, p, history.read(p.name, history_folder))
            history.append(p.name, history.snapshot(p), history_folder)
    if report.count(Finding.TABLE_MISSING):
        return report
    for name, t in contract.tables.items():
        if name in frames and t.rules:
            report.violations += check_rules(contract, measure_rules(frames[name], name, t.rules, {k: c.type for k, c in t.columns.items()}))
    live = [r for r in contract.relationships if not r.ignore]
    measured = [measure(r, frames.get(r.from_table), frames.get(r.to_table)) for r in live]
    report.relationships_checked = len(measured)
    report.violations += check_relationships(contract, measured, report.violations)
    return report


def init(args) -> int:
    from .contract import yaml_io
    from .contract.generate import generate, suggest_rules
    from .contract.model import TableRule
    from .relations import infer_relationships
    from .rules.measure import measure_rules

    if os.path.isfile(args.output) and not args.force:
        raise CliError(f"{args.output} is there already; --force writes over it")
    if not args.sources and not args.dbt:
        raise CliError("name a source, or a manifest with --dbt")
    run = _Run(args)
    profiles = run.named(args.sources)
    contract = generate(profiles)
    for name, t in contract.tables.items():
        rules = [TableRule(r) for r in suggest_rules(t)]
        held = measure_rules(run.frames[name], name, rules, {k: c.type for k, c in t.columns.items()})
        t.suggested_rules = [m.rule.expr for m in held if m.error is None and m.judged > 0 and m.broken == 0]
    contract.relationships = infer_relationships(profiles)
    yaml_io.dump(contract, args.output)
    columns = [c for t in contract.tables.values() for c in t.columns.values()]
    print(f"{os.path.abspath(args.output)}: {len(contract.tables)} tables, {len(columns)} columns, {len(contract.relationships)} relationships. Read it, correct it, commit it.")
    return 0


def check(args) -> int:
    from . import publish
    from .contract import yaml_io
    from .contract.model import Severity
    from .history import FOLDER

    contract = yaml_io.load(args.contract)
    run = _Run(args)
    profiles = run.of_contract(contract, args.sources)
    if args.sources or args.dbt:
        contract = _scoped(contract, profiles)
    if args.warn_only:
        contract.on_violation = Severity.WARN
    report = full_check(contract, profiles, run.frames, None if args.no_history else FOLDER)
    form = "json" if args.json else args.format
    print({"json": report.to_json, "markdown": lambda: publish.markdown(report, args.show_values), "text": lambda: report.text(sys.stdout.isatty() and not args.no_colour)}[form]())
    if args.slack_webhook:
        try:
            publish.post(args.slack_webhook, publish.slack(report, args.show_values))
        except (OSError, ValueError) as e:  # the verdict stands without the message
            print(f"no message was sent: {e}", file=sys.stderr)
    if args.upload:
        target, project = args.endpoint or os.environ.get("VERITAB_ENDPOINT"), args.project or os.environ.get("VERITAB_PROJECT")
        if not target or not project:
            print("nothing was sent: --upload needs --endpoint and --project", file=sys.stderr)
        else:
            try:
                publish.post(target, publish.payload(report, project), {"Authorization": f"Bearer {os.environ.get('VERITAB_TOKEN', '')}"})
            except (OSError, ValueError) as e:
                print(f"nothing was sent: {e}", file=sys.stderr)
    return 1 if report.at(Severity.FAIL) or args.fail_on_warn and report.at(Severity.WARN) else 0


def _target(text: str, contract) -> tuple[str, str]:
    """(table, column) of column or table.column."""
    table, _, column = text.rpartition(".")
    if table in contract.tables and column in contract.tables[table].columns:
        return table, column
    found = [n for n, t in contract.tables.items() if text in t.columns]
    if len(found) != 1:
        raise CliError(f"the contract has {'no column' if not found else 'several columns'} {text}" + (": " + ", ".join(f"{t}.{text}" for t in found) if found else ""))
    return found[0], text


def explain(args) -> int:
    from .contract import yaml_io
    from .contract.check import check as check_profile
    from .contract.findings import written_out

    contract = yaml_io.load(args.contract)
    table, column = _target(args.target, contract)
    t = contract.tables[table]
    c = t.columns[column]
    print(f"{table}.{column}: {yaml_io.sentence(c)}" + (f" {c.means}" if c.means else ""))
    p = _Run(args).profile(args.source or t.source, table)
    cp = p.get(column)
    if cp is None:
        print("The data have no such column.")
        return 0
    print(f"Measured: {cp.inferred_type.value}, {cp.row_count:,} rows, {cp.null_count:,} null, {cp.distinct_count:,} different" + (f"; {', '.join(cp.observations)}" if cp.observations else ""))
    found = [v for v in check_profile([p], contract).violations if v.table == table and v.column == column]
    print(written_out(found) or "The contract holds.")
    return 0


def accept(args) -> int:
    from .contract import yaml_io
    from .contract.check import check as check_profile
    from .contract.generate import column_contract
    from .contract.model import Severity

    contract = yaml_io.load(args.contract)
    run = _Run(args)
    profiles = {p.name: p for p in run.of_contract(contract, args.sources)}
    if args.columns:
        targets = [_target(x, contract) for x in args.columns]
    else:
        targets = sorted({(v.table, v.column) for v in check_profile(list(profiles.values()), contract).at(Severity.FAIL) if v.column})
    changes = []
    for table, column in targets:
        old, seen = contract.tables[table].columns.get(column), profiles[table].get(column) if table in profiles else None
        if old is None or seen is None:
            continue
        new = column_contract(seen)
        new.means, new.ignore, new.on_violation = old.means, old.ignore, old.on_violation
        new.known_issues = sorted({*old.known_issues, *new.known_issues})
        for f in dataclasses.fields(new):
            if f.name != "fresh_within" and getattr(old, f.name) != getattr(new, f.name):
                changes.append(f"{table}.{column}: {f.name} was {getattr(old, f.name)}, becomes {getattr(new, f.name)}")
        contract.tables[table].columns[column] = new
    print("\n".join(changes) or "There is nothing to accept.")
    if changes and not args.dry_run:
        yaml_io.dump(contract, args.contract)
    return 0


def show_profile(args) -> int:
    p = _Run(args).profile(args.source, args.table)
    if args.json:
        print(p.to_json())
        return 0
    print(f"{p.name}: {p.row_count:,} rows, {p.column_count} columns, {p.duration_ms:,} ms")
    for c in p.columns:
        print(f"  {c.name:<24} {c.inferred_type.value:<10} {c.type_confidence:>4.0%}  {c.null_count:>10,} null  {c.distinct_count:>12,} different  {', '.join(c.observations)}")
    return 0


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--debug", action="store_true", help="full traces of errors")
    common.add_argument("--no-colour", action="store_true")
    common.add_argument("--table", help="the table's name; by default the source's")
    common.add_argument("--privacy", choices=["strict", "masked", "full"], default="masked")
    common.add_argument("--max-categories", type=int, default=50)
    common.add_argument("--batch-size", type=int, default=200, help="columns measured at a time")
    common.add_argument("--threads", type=int)
    common.add_argument("--memory-limit")
    common.add_argument("--csv-option", action="append", metavar="KEY=VALUE")
    common.add_argument("--dbt", metavar="MANIFEST")
    common.add_argument("--warehouse", default="")
    common.add_argument("--models", nargs="*")
    top = argparse.ArgumentParser("veritab", description="Data contracts on Spark.")
    top.add_argument("--version", action="version", version=f"veritab {__version__}")
    commands = top.add_subparsers(dest="command")

    def command(name: str, run, help: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, parents=[common], help=help)
        p.set_defaults(run=run)
        return p

    p = command("init", init, "write a contract of the data as they are")
    p.add_argument("sources", nargs="*")
    p.add_argument("-o", "--output", default=CONTRACT)
    p.add_argument("-f", "--force", action="store_true")
    p = command("check", check, "hold data against the contract")
    p.add_argument("sources", nargs="*")
    p.add_argument("-c", "--contract", default=CONTRACT)
    p.add_argument("--format", choices=["text", "json", "markdown"], default="text")
    for flag, told in (("--json", "as --format json"), ("--show-values", "values of categories in Markdown and messages too"), ("--warn-only", "failures of the contract's default become warnings"), ("--fail-on-warn", "warnings fail"), ("--no-history", "neither read nor write past runs"), ("--upload", "send counts of the run")):
        p.add_argument(flag, action="store_true", help=told)
    for flag in ("--slack-webhook", "--endpoint", "--project"):
        p.add_argument(flag)
    p = command("explain", explain, "what a column promises and what it is")
    p.add_argument("target")
    p.add_argument("-c", "--contract", default=CONTRACT)
    p.add_argument("--source")
    p = command("accept", accept, "make the contract say what the data are")
    p.add_argument("sources", nargs="*")
    p.add_argument("-c", "--contract", default=CONTRACT)
    p.add_argument("--column", dest="columns", action="append")
    p.add_argument("-n", "--dry-run", action="store_true")
    p = command("profile", show_profile, "measure a source")
    p.add_argument("source")
    p.add_argument("--json", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        top.print_help()
        return 0
    try:
        return args.run(args)
    except Exception as e:  # noqa: BLE001  the message is for people; --debug has the trace
        if args.debug:
            raise
        print(f"{type(e).__name__}: {e}" if not isinstance(e, CliError) else str(e), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
