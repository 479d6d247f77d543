"""The pattern library: what values look like, whatever their declared type."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Pattern:
    """regex is an RE2 expression, searched for anywhere in a value; lower: in its lower-case form; pii: personal data."""

    key: str
    regex: str
    pii: bool = False
    lower: bool = False


# Results depend on each of these expressions as it is.
TEMPORAL = (
    Pattern("iso_date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    Pattern("iso_datetime", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"),
    Pattern("us_date", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    Pattern("eu_date", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"),
    Pattern("compact_date", r"^[0-9]{8}$"),
    Pattern("epoch_seconds", r"^1[0-9]{9}$"),
    Pattern("epoch_millis", r"^1[0-9]{12}$"),
    Pattern("excel_serial", r"^[2-5][0-9]{4}$"),
    Pattern("year_only", r"^(19|20)[0-9]{2}$"),
)
NUMERIC_TEXT = (
    Pattern("currency", r"^[-+]?[$€£¥]\s?[0-9][0-9,]*(\.[0-9]+)?$"),
    Pattern("percent", r"^[-+]?[0-9]+(\.[0-9]+)?\s?%$"),
    Pattern("thousands_separated", r"^[-+]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"),
    Pattern("scientific", r"^[-+]?[0-9]+(\.[0-9]+)?[eE][-+]?[0-9]+$"),
    Pattern("leading_zeros", r"^0[0-9]+$"),
)
STRUCTURAL = (
    Pattern("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    Pattern("json_object", r"^\s*[{[][\s\S]*[}\]]\s*$"),
    Pattern("url", r"^https?://[^\s]+$"),
    Pattern("null_word", r"^(null|none|n/a|na|nan|nil|undefined|missing|-|\?)$", lower=True),
    Pattern("mojibake", r"(Â|â€|Ã¢|Ã©|Ã¨|ï»¿)"),
    Pattern("postal_like", r"^[0-9]{5}(-[0-9]{4})?$"),
)
PII = (
    Pattern("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", pii=True),
    Pattern("email_embedded", r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}", pii=True),
    Pattern("phone_formatted", r"^[(]?[0-9]{3}[)]?[ .\-][0-9]{3}[ .\-][0-9]{4}$", pii=True),
    Pattern("phone_international", r"^[+][0-9]{1,3}[ .\-]?[0-9][0-9 .\-()]{5,16}[0-9]$", pii=True),
    Pattern("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", pii=True),
    Pattern("credit_card", r"^([0-9]{4}[ -]){3}[0-9]{1,4}$", pii=True),
    Pattern("ipv4", r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$", pii=True),
    Pattern("iban", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$", pii=True),
)

GROUPS = {"temporal": TEMPORAL, "numeric": NUMERIC_TEXT, "structural": STRUCTURAL, "pii": PII}
ALL = (*TEMPORAL, *NUMERIC_TEXT, *STRUCTURAL, *PII)
BY_KEY = {p.key: p for p in ALL}
PII_KEYS = frozenset(p.key for p in PII)


def chosen(keys: list[str] | None = None) -> tuple[Pattern, ...]:
    """The patterns of those keys, all by default, in the library's order."""
    return ALL if keys is None else tuple(p for p in ALL if p.key in set(keys))


#: What a value must have for its pattern to match, from the value and its length: tests on bytes, made before any regular expression.
GUARDS: dict[str, Callable[[Column, Column], Column]] = {
    "iso_date": lambda v, n: n == 10,
    "iso_datetime": lambda v, n: v.contains(":"),
    "us_date": lambda v, n: v.contains("/"),
    "eu_date": lambda v, n: n.between(8, 10),
    "compact_date": lambda v, n: n == 8,
    "epoch_seconds": lambda v, n: n == 10,
    "epoch_millis": lambda v, n: n == 13,
    "excel_serial": lambda v, n: n == 5,
    "year_only": lambda v, n: n == 4,
    "currency": lambda v, n: v.contains("$") | v.contains("€") | v.contains("£") | v.contains("¥"),
    "percent": lambda v, n: v.endswith("%"),
    "thousands_separated": lambda v, n: v.contains(","),
    "scientific": lambda v, n: v.contains("e") | v.contains("E"),
    "leading_zeros": lambda v, n: v.startswith("0"),
    "uuid": lambda v, n: n == 36,
    "json_object": lambda v, n: v.contains("{") | v.contains("["),
    "url": lambda v, n: v.startswith("http"),
    "null_word": lambda v, n: n <= 9,
    "postal_like": lambda v, n: n.isin(5, 10),
    "email": lambda v, n: v.contains("@"),
    "email_embedded": lambda v, n: v.contains("@"),
    "phone_formatted": lambda v, n: n.between(12, 14),
    "phone_international": lambda v, n: v.startswith("+"),
    "ssn": lambda v, n: n == 11,
    "credit_card": lambda v, n: n.between(16, 19),
    "ipv4": lambda v, n: n.between(7, 15),
    "iban": lambda v, n: n.between(14, 34),
}


def matches(p: Pattern, v: Column, low: Column, size: Column) -> Column:
    """Whether p is in a value, given with its lower-case form and its length."""
    x = low if p.lower else v
    found = x.rlike(java(p.regex))
    return GUARDS[p.key](x, size) & found if p.key in GUARDS else found


def java(regex: str) -> str:
    """An RE2 expression of this library as Java has to be told it: white space is five characters, $ is the text's end."""
    space = r"\t\n\f\r "
    out = regex.replace(r"[\s\S]", "(?s:.)").replace("[{[]", r"[{\[]")
    # inside a class, \s is its characters; elsewhere it is a class
    out = re.sub(r"\[(?:\\.|[^\]\\])*\]", lambda m: m[0].replace(r"\s", space), out)
    out = out.replace(r"\s", f"[{space}]")
    return re.sub(r"(?<!\\)\$\Z", r"\\z", out)
