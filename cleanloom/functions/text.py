"""Text as Column expressions: trimming, null tokens, numbers, dates, names.

All expressions are native, so that they stay inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as a written null, as a truth word, and how dates are written.
WHITE = " \t\n\r\x0b\x0c"
NULL_TOKENS = ("", "na", "n/a", "n.a.", "null", "none", "nil", "nan", "-", "--", "?", "unknown", "missing", "#n/a", "-999", "999999", "(blank)")
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
BOOL_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f")
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"
PLUS_INFINITY, MINUS_INFINITY = r"^[+]?inf(inity)?$", r"^-inf(inity)?$"
NUMBER_IN_TEXT = r"([+-]?[0-9][0-9,]*\.?[0-9]*)"
NUMERIC_TEXT = r"(?i)^([$€£₹]|usd|eur|inr)?\s*[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?\s*(%|[a-z]{1,6}\.?)?$"
#: (name of the value type, expression)
DATE_TYPES = (
    ("date:iso", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("datetime:iso", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"),
    ("date:us", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("date:dotted", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"),
    ("date:text_dmy", r"^[0-9]{1,2} [A-Za-z]{3,9},? [0-9]{4}$"),
    ("date:text_mdy", r"^[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}$"),
)
ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"
#: (expression, format); tried in this order.  An empty format is the ISO one with an optional time.
DATE_FORMATS = (
    (ISO_DAY, "yyyy-MM-dd"),
    (ISO_TIME, ""),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{3},? [0-9]{4}$", "d MMM yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{4,9},? [0-9]{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2},? [0-9]{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,9} [0-9]{1,2},? [0-9]{4}$", "MMMM d yyyy"),
)


def quoted(name: str) -> str:
    """A column's name as an identifier; dots and back-ticks are part of it."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def trimmed(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WHITE))


def folded(c: Column) -> Column:
    return F.lower(trimmed(c))


def is_null_token(c: Column, more: tuple[str, ...] = ()) -> Column:
    return folded(c).isin(*dict.fromkeys((*NULL_TOKENS, *(str(t).strip(WHITE).lower() for t in more))))


def plain_number(c: Column) -> Column:
    """Text that is a number as it stands, else null.  The expression keeps out suffixes that a cast takes."""
    t = trimmed(c)
    special = F.when(F.lower(t).rlike(PLUS_INFINITY), F.lit(float("inf"))).when(F.lower(t).rlike(MINUS_INFINITY), F.lit(float("-inf")))
    return F.coalesce(F.when(t.rlike(DECIMAL), t.try_cast("double")), special)


def number_in(c: Column) -> Column:
    """The first number in a text, without its thousands commas; in parentheses it is negative."""
    t = trimmed(c)
    found = F.nullif(F.regexp_extract(t, NUMBER_IN_TEXT, 1), F.lit("")).alias("found")
    n = F.replace(found, F.lit(","), F.lit("")).try_cast("double")
    return F.when(t.rlike(r"(?s)^\(.*\)$"), -F.abs(n)).otherwise(n)


def iso_time(t: Column) -> Column:
    """An ISO time; an offset is taken into account, the result is in UTC without a zone."""
    return F.to_utc_timestamp(F.try_to_timestamp(t), F.current_timezone()).cast("timestamp_ntz")


def date_as(c: Column, form: str, read_as: str | None = None) -> Column:
    """A date written in one of DATE_FORMATS, else null; read_as reads it in another order of its parts."""
    expression = next(e for e, f in DATE_FORMATS if f == form)
    v = trimmed(c)
    plain = F.replace(v, F.lit(","), F.lit(""))
    return F.when(v.rlike(expression), F.try_to_timestamp(plain, F.lit(read_as or form)).cast("timestamp_ntz") if form else iso_time(plain))


def date_in(c: Column, dayfirst: bool = False) -> Column:
    """A date written in any of DATE_FORMATS, else null; dayfirst turns the order around in slash dates."""
    return F.coalesce(*(date_as(c, form, "d/M/yyyy" if dayfirst and form == "M/d/yyyy" else None) for _, form in DATE_FORMATS))


def clipped(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


#: A word in a name: capitals that no small letter follows, or letters and digits from a capital on.
NAME_WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z][A-Z0-9]*")


def snake(name: str) -> str:
    """customerId, Customer-ID and ' customer id ' are customer_id; a name without letters or digits is col."""
    return "_".join(NAME_WORD.findall(str(name))).lower() or "col"


def is_snake(name: str) -> bool:
    return snake(name) == name
