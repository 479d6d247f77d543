"""Small tables of the kinds that go wrong."""

from __future__ import annotations

import csv
import random
from datetime import date, timedelta

STATUS, COUNTRY = ("pending", "shipped", "delivered", "refunded"), ("US", "GB", "DE", "FR")


def orders(n: int = 100) -> list[dict]:
    first = date(2024, 1, 1)
    return [
        {"order_id": str(1000 + i), "customer_email": f"user{i}@example.com", "signup_date": str(first + timedelta(days=i % 300)), "status": STATUS[i % 4], "amount": f"{19.99 + 3.5 * i:.2f}", "country": COUNTRY[i % 4], "item_count": str(i % 7)}
        for i in range(n)
    ]


def messy() -> list[dict]:
    rows = [
        ("00123", "  Ada Lovelace ", "$1,299.00", "12.5%", "N/A", "write to ada@example.com please", "ACTIVE"),
        ("00124", "GRACE HOPPER", "$99.50", "3%", "null", "café", "active"),
        ("00125", "alan turing", "$1,000.00", "7.25%", "2024-03-11", "call me", "Active"),
        ("00126", "Edsger", "$15.00", "1%", "11.03.2024", "cafÃ©", "INACTIVE"),
        ("00127", "Barbara", "$20.00", "2%", "3/11/2024", "mail bob@example.org", "inactive"),
        ("00128", "Donald ", "$12,345.67", "0.5%", "-", "nothing", "Inactive"),
        ("00129", "Frances", "$1.00", "99%", "2024-05-01", "â€œquotedâ€", "ACTIVE"),
        ("00130", "Radia", "$2.00", "100%", "2024-06-01", "ok", "active"),
    ]
    return [dict(zip(("account_code", "full_name", "revenue", "growth_rate", "signup_date", "notes", "status"), r)) for r in rows]


def write_csv(path, rows: list[dict]) -> str:
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    return str(path)


def _each(column: str, value, which) -> callable:
    def change(rows):
        return [r | {column: value(r, i)} if which(i) else r for i, r in enumerate(rows)]

    return change


every = lambda k, at=0: lambda i: i % k == at
always = lambda i: True

#: name: (what is done to the rows, findings of which one is expected, what is done before the contract is made, a change of the contract)
MUTATIONS: dict[str, tuple] = {
    "epoch_swap": (_each("signup_date", lambda r, i: str(1714089600 + i), every(33)), {"epoch_suspected", "type_contaminated"}),
    "dollars_to_cents": (_each("amount", lambda r, i: f"{float(r['amount']) * 100:.0f}", always), {"unit_shift_suspected"}),
    "type_contamination": (_each("amount", lambda r, i: "unknown", every(50)), {"type_contaminated", "type_changed"}),
    "new_category": (_each("status", lambda r, i: "awaiting_pickup", every(10)), {"new_category"}),
    "category_disappeared": (_each("status", lambda r, i: "shipped", every(4, 3)), {"category_disappeared"}),
    "null_words": (_each("signup_date", lambda r, i: "N/A", every(20)), {"null_words_appeared", "type_contaminated"}),
    "mojibake": (_each("customer_email", lambda r, i: "JosÃ©@example.com", every(25)), {"mojibake_appeared"}),
    "row_count_collapse": (lambda rows: rows[:5], {"row_count_below_min"}),
    "column_removed": (lambda rows: [{k: v for k, v in r.items() if k != "country"} for r in rows], {"column_missing"}),
    "column_added": (lambda rows: [r | {"extra": "1"} for r in rows], {"column_added"}, None, lambda t: setattr(t, "allow_new_columns", False)),
    "nulls_in_required": (_each("amount", lambda r, i: "", every(10)), {"nullability_violated"}),
    "uniqueness_lost": (_each("order_id", lambda r, i: "1000", every(10)), {"uniqueness_lost"}),
    "range_exceeded": (_each("amount", lambda r, i: "4000.00", every(50)), {"range_exceeded"}),
    "excel_serial": (_each("signup_date", lambda r, i: str(45000 + i), always), {"excel_serial_suspected", "type_changed"}),
    "mixed_date_formats": (_each("signup_date", lambda r, i: "3/11/2024", every(4)), {"format_changed", "type_contaminated"}),
    "pii_in_free_text": (_each("notes", lambda r, i: f"ask u{i}@example.com", every(5)), {"pii_appeared"}, lambda rows: [r | {"notes": f"note {i % 3}"} for i, r in enumerate(rows)]),
    "numeric_as_text": (_each("amount", lambda r, i: f"{float(r['amount']):,.2f}", always), {"type_changed", "type_contaminated"}, lambda rows: [r | {"amount": f"{float(r['amount']) * 1000:.2f}"} for r in rows]),
    "whitespace_padding": (_each("status", lambda r, i: f" {r['status']} ", every(3)), {"new_category"}),
    "leading_zeros_lost": (_each("code", lambda r, i: r["code"].lstrip("0"), always), {"format_changed", "type_changed"}, lambda rows: [r | {"code": f"{100 + i:05d}"} for i, r in enumerate(rows)]),
    "stale_data": (_each("updated_at", lambda r, i: "2024-01-01 00:00:00", always), {"stale_data"}, lambda rows: [r | {"updated_at": f"{date.today()} 00:00:00"} for r in rows], lambda t: setattr(t.columns["updated_at"], "fresh_within", "24h")),
    "rule_broken": (_each("amount", lambda r, i: "0.50", every(3, 2)), {"rule_violated"}, None, lambda t: t.rules.append(__import__("veritab.contract.model", fromlist=["TableRule"]).TableRule("amount >= item_count"))),
    "case_drift": (_each("status", lambda r, i: r["status"].upper(), every(2)), {"new_category"}),
    "mixed_boolean": (_each("is_gift", lambda r, i: ("true", "TRUE", "yes", "t", "no", "0")[i % 6], always), {"mixed_boolean_encoding", "new_category", "type_changed"}, lambda rows: [r | {"is_gift": ("true", "false")[i % 2]} for i, r in enumerate(rows)]),
}


def shuffled(rows: list[dict], seed: int = 3) -> list[dict]:
    return random.Random(seed).sample(rows, len(rows))
