"""Values as text: every column is measured in its text form, and types are tried rather than trusted.

Casts carry guards, because Spark's are more generous than a profile may be: "2024" is no date, "1d" is no number.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

SHAPE_LENGTH = 40
#: The characters of the Unicode class of spaces.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
BOOLEAN_WORDS = ("true", "false", "t", "f", "yes", "no", "y", "n", "0", "1")
#: Years, months and days with - or /, then perhaps a time and a zone.
MOMENT = r"^[0-9]{1,6}[-/][0-9]{1,2}[-/][0-9]{1,2}([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]+)?)?( ?(Z|UTC|[-+][0-9]{2}(:?[0-9]{2})?))?)?\z"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _plain(x: Column) -> Column:
    """A double or float in plain decimals, with an exponent only outside 1e-4 to 1e16, always with a fraction or an exponent."""
    s = x.cast("string")
    size = F.abs(x)
    digits = F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+\z", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^(.*)E", 1), r"\.0\z", "")
    power = F.regexp_extract(s, r"E(-?[0-9]+)\z", 1).try_cast("int")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(~s.contains("E"), s).when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent)
    )


def text_form(x: Column, kind: DataType) -> Column:
    """The text of a value of any type."""
    return _plain(x) if isinstance(kind, (DoubleType, FloatType)) else x.cast("string")


def text_columns(df: DataFrame) -> DataFrame:
    """df with all columns as text, under names c0, c1, ... by position."""
    return df.select(*[text_form(F.col(quoted(f.name)), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)])


def trimmed(t: Column) -> Column:
    """t without Unicode spaces at its ends; tabs stay."""
    return F.btrim(t, F.lit(SPACES))


def valued(t: Column) -> Column:
    """t trimmed, null where nothing is left."""
    return F.nullif(trimmed(t), F.lit(""))


def shape(v: Column) -> Column:
    """The first 40 characters with digits as #, ASCII letters as a and white space as _."""
    return F.translate(F.substring(v, 1, SHAPE_LENGTH), string.digits + string.ascii_letters + "\t\n\f\r ", "#" * 10 + "a" * 52 + "_" * 5)


def number(v: Column) -> Column:
    """v as a double, null where it is none. Only what begins like a number, or like its words, is cast."""
    clean = F.when(v.contains("_"), F.regexp_replace(v, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(v)
    first = F.ascii(v)
    typed = (v.endswith("d") | v.endswith("D") | v.endswith("f") | v.endswith("F")) & clean.rlike(r"[0-9.][dDfF]\z")
    return F.when(((first <= ord("9")) | first.isin(*map(ord, "INin"))) & ~typed, clean).try_cast("double")


def _written_moment(v: Column) -> Column:
    return F.when(F.ascii(v).between(ord("0"), ord("9")) & (v.contains("-") | v.contains("/")) & v.rlike(MOMENT), F.translate(v, "/", "-"))


def day(v: Column) -> Column:
    return _written_moment(v).try_cast("date")


def moment(v: Column) -> Column:
    return _written_moment(v).try_cast("timestamp_ntz")


def truth(low: Column) -> Column:
    """Whether a lower-case value is a word for true or false."""
    return low.isin(*BOOLEAN_WORDS)


def hidden(t: Column) -> Column:
    """A category's stand-in where values must not be shown."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(t, 256), 1, 12))


def masked(value: str, limit: int = 64) -> str:
    """A single value's shape, for messages; letters and digits of any script count."""
    out = ["#" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c for c in value[:limit]]
    return "".join(out) + ("…" if len(value) > limit else "")
