"""The actions of a plan as Column expressions, and the aggregates that fix their parameters.

An action takes a column and gives a column; what it needs to know about the whole column (the
spelling of each category, whether all numbers are whole, the format of the first date, whether days
come first) is an aggregate that runs once, when the plan is bound, and becomes a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions import text as t
from cleanloom.plans.model import Step


def standardize_nulls(c: Column, tokens: tuple[str, ...] = ()) -> Column:
    """Written nulls become null; every other text stays as it is, blanks and all."""
    raw = c.cast("string")
    return F.when(~t.is_null_token(raw, tuple(tokens)), raw)


def strip(c: Column) -> Column:
    return F.nullif(t.trimmed(c), F.lit(""))


def cast_numeric(c: Column, integer: bool = False, strategy: int = 0) -> Column:
    """Strategy 0 takes plain numbers only, later ones the first number in the text.

    integer asks for whole numbers; the caller has made sure that all are (`all_whole`).
    """
    n = t.plain_number(c) if strategy <= 0 else t.number_in(c)
    return F.bround(n).cast("bigint") if integer else n


def parse_dates(c: Column, strategy: int = 0, dayfirst: bool = False, form: str | None = None) -> Column:
    """Strategy 0 takes dates in the one format `form` (null: every known one), later ones each known format.

    dayfirst holds from strategy 2 on.
    """
    if strategy <= 0 and form is not None:
        return t.date_as(c, form)
    return t.date_in(c, dayfirst and strategy >= 2)


def to_bool(c: Column) -> Column:
    k = t.folded(c)
    return F.when(k.isin(*t.TRUE_WORDS), True).when(k.isin(*t.FALSE_WORDS), False)


def canonicalize(c: Column, mapping: dict[str, str]) -> Column:
    """Each text becomes the spelling that its folded form is mapped to, or its own trimmed form."""
    if not mapping:
        return t.trimmed(c)
    pairs = F.create_map(*(F.lit(x) for kv in sorted(mapping.items()) for x in kv))
    return F.coalesce(F.try_element_at(pairs, t.folded(c)), t.trimmed(c))


def custom(expression: str) -> Column:
    """A guarded Spark SQL expression over the row's columns."""
    return F.expr(expression)


def apply(step: Step, c: Column) -> Column:
    """One step over a column; the step's parameters are bound (`bind`)."""
    p = step.params
    if step.action == "standardize_nulls":
        return standardize_nulls(c, tuple(p.get("tokens", ())))
    if step.action == "strip":
        return strip(c)
    if step.action == "cast_numeric":
        return cast_numeric(c, bool(p.get("integer")), step.strategy)
    if step.action == "parse_dates":
        return parse_dates(c, step.strategy, bool(p.get("dayfirst")), p.get("form"))
    if step.action == "to_bool":
        return to_bool(c)
    if step.action == "canonicalize":
        return canonicalize(c, p.get("mapping") or {})
    if step.action == "custom":
        return custom(p["expression"])
    raise ValueError(step.action)


# -- aggregates ------------------------------------------------------------------------------


def spellings(df: DataFrame, c: Column) -> DataFrame:
    """(key, spelling): the most frequent trimmed spelling of each folded text; of equals the smallest."""
    v = t.trimmed(c)
    counts = df.select(v.alias("spelling")).where("spelling is not null").groupBy("spelling").agg(F.count("*").alias("n"))
    ranked = counts.groupBy(F.lower("spelling").alias("key"))
    # of equal counts the smaller text: a maximum over the count and the minimum among those that reach it
    best = ranked.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("spelling"))).alias("b"))
    return best.select("key", F.col("b.spelling").alias("spelling"))


def canonical_mapping(df: DataFrame, c: Column, most: int = 10_000) -> dict[str, str]:
    """`spellings` as a literal; a column with more than `most` folded texts has no categories."""
    rows = spellings(df.where(t.trimmed(c) != ""), c).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} different texts are no categories")
    return {r["key"]: r["spelling"] for r in rows}


def unseen_mapping(df: DataFrame, c: Column, known: dict[str, str], most: int = 10_000) -> dict[str, str]:
    """The spellings of folded texts that known lacks and that are spelled in several ways; the others stay as they are."""
    v = t.trimmed(c)
    varied = df.select(v.alias("v")).where("v <> ''").groupBy(F.lower("v").alias("key")).agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least <> most")
    keys = [r["key"] for r in varied.where(~F.col("key").isin(list(known))).select("key").limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} different texts are no categories")
    return canonical_mapping(df.where(F.lower(v).isin(keys)), c, most) if keys else {}


def all_whole(c: Column) -> Column:
    """Whether all numbers of a double column are whole, to 1e-9."""
    return F.coalesce(F.bool_and(F.abs(c - F.bround(c)) < 1e-9), F.lit(True))


def dayfirst_evidence(c: Column) -> Column:
    """Whether some slash date has a first part over 12 and none a second one."""
    v = t.trimmed(c)
    slash = v.rlike(dict(t.DATE_TYPES)["date:us"])
    part = lambda i: F.when(slash, F.split(v, "/").getItem(i).try_cast("int"))
    return F.coalesce(F.bool_or(part(0) > 12) & ~F.bool_or(part(1) > 12), F.lit(False))


def first_form(c: Column, order: Column) -> Column:
    """The format of the first value that is not null, null if no format is known for it."""
    v = t.trimmed(c)
    form = F.lit(None).cast("string")
    for expression, f in reversed(t.DATE_FORMATS):
        form = F.when(v.rlike(expression), F.lit(f)).otherwise(form)
    first = F.min_by(F.struct(form.alias("form")), F.when(v.isNotNull(), order))
    return first.getField("form")
