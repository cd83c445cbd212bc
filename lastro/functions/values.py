"""Text to typed value. Bad text becomes NULL (or 0 for INTEGER); nothing here can fail a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type names a user may declare.
DECLARED_TYPES = ("TEXT", "INTEGER", "REAL", "NUMERIC", "BLOB", "DATE", "DATETIME", "TIME", "BOOLEAN")

# The boolean tokens and what they stand for.
BOOLEAN_TOKENS = {
    "true": 1,
    "false": 0,
    "1": 1,
    "0": 0,
    "sim": 1,
    "não": 0,
    "yes": 1,
    "no": 0,
}

DIGITS = r"^[0-9]+$"
CLOCK = r"[0-9]{2}:[0-9]{2}"
NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"

_TIME_OF_DAY = r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
# Order matters: a column takes the first format that all of its values satisfy.
DATE_FORMATS = {
    "ymd": (rf"^([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}}){_TIME_OF_DAY}$", "$1-$2-$3$4"),
    "mdy": (rf"^([0-9]{{1,2}})[-/]([0-9]{{1,2}})[-/]([0-9]{{4}}){_TIME_OF_DAY}$", "$3-$1-$2$4"),
    "dmy": (rf"^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}){_TIME_OF_DAY}$", "$3-$2-$1$4"),
    "clock": (r"^([0-9]{2}:[0-9]{2}(:[0-9]{2})?)$", "1970-01-01 $1"),
}


def is_number(value: Column) -> Column:
    """The guard in front of numeric casts, which would also take ``1d`` and the like."""
    return value.rlike(NUMBER)


def to_real(value: Column) -> Column:
    return F.when(is_number(value), F.trim(value).try_cast("double"))


def to_integer(value: Column) -> Column:
    """Whole number, fraction cut off, 0 for anything else.

    The direct cast comes first because going through double loses digits beyond 2^53.
    """
    whole = F.trim(value).try_cast("bigint")
    return F.when(is_number(value), F.coalesce(whole, to_real(value).try_cast("bigint"), F.lit(0))).otherwise(
        F.lit(0).cast("bigint")
    )


def to_numeric(value: Column) -> Column:
    return F.when(is_number(value), F.trim(value).try_cast("decimal(38,10)"))


def to_boolean_number(value: Column) -> Column:
    """1 or 0 for a known token in any case, NULL for everything else."""
    token = F.lower(F.trim(value))
    ones = [t for t, n in BOOLEAN_TOKENS.items() if n == 1]
    zeros = [t for t, n in BOOLEAN_TOKENS.items() if n == 0]
    return F.when(token.isin(ones), F.lit(1)).when(token.isin(zeros), F.lit(0))


def is_boolean_token(value: Column) -> Column:
    return F.lower(value).isin(list(BOOLEAN_TOKENS))


def to_timestamp(value: Column, date_format: str = "ymd") -> Column:
    """Rewrite to ISO order, then cast: independent of the session's time parser policy.

    A written offset fixes the instant; without one the text is taken in the session's time zone.
    """
    pattern, iso = DATE_FORMATS[date_format]
    text = F.trim(value)
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, iso).try_cast("timestamp"))


def to_date(value: Column, date_format: str = "ymd") -> Column:
    """The written day, whatever offset follows it: no time zone takes part."""
    pattern, iso = DATE_FORMATS[date_format]
    text = F.trim(value)
    day = F.regexp_replace(text, pattern, "1970-01-01" if date_format == "clock" else iso.removesuffix("$4"))
    return F.when(to_timestamp(value, date_format).isNotNull(), day.try_cast("date"))


def to_time(value: Column) -> Column:
    """Time of day stays text; text that is none becomes NULL."""
    text = F.trim(value)
    return F.when(text.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), text)


def converted(value: Column, declared: str, keep_text: bool = False) -> Column:
    """``value`` as its declared type. ``DATE:dmy`` names a date order other than year first.

    With ``keep_text`` only INTEGER, REAL and BOOLEAN change the data and the rest stays as written.
    """
    name, _, detail = declared.partition(":")
    if name not in DECLARED_TYPES:
        raise ValueError(f"unknown type: {declared}")
    if name == "INTEGER":
        return to_integer(value)
    if name == "REAL":
        return to_real(value)
    if name == "BOOLEAN":
        return to_boolean_number(value)
    if name == "TEXT" or keep_text:
        return value
    if name == "NUMERIC":
        return to_numeric(value)
    if name == "BLOB":
        return value.cast("binary")
    if name == "DATE":
        return to_date(value, detail or "ymd")
    if name == "DATETIME":
        return to_timestamp(value, detail or "ymd")
    return to_time(value)


def converted_to(value: Column, spark_type: str) -> Column:
    """``value`` as the type of an existing column without a stored declaration, by the rules of ``converted``."""
    rules = {"bigint": to_integer, "int": to_integer, "double": to_real, "date": to_date, "timestamp": to_timestamp}
    if spark_type in rules:
        out = rules[spark_type](value)
        # Without a declaration an int column may hold booleans as well as numbers.
        return F.coalesce(to_boolean_number(value), out.try_cast("int")) if spark_type == "int" else out
    if spark_type == "boolean":
        return to_boolean_number(value).cast("boolean")
    if spark_type.startswith("decimal"):
        return F.when(is_number(value), F.trim(value).try_cast(spark_type))
    return value.try_cast(spark_type)
