"""Post-conditions: did a plan do what it says, and nothing else?

Before and after stand side by side in one projection, so nothing is joined or sorted, and one
aggregate gives every count.  A value that was there and is null now is a new null; written nulls do not
count as values.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import text as t
from cleanloom.operators.profile import rendered
from cleanloom.plans import compiler
from cleanloom.plans.model import EXPECTED, Plan

LOST = 5
YEARS = (1900, 2100)
KINDS = {"numeric": (T.NumericType,), "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType), "bool": (T.BooleanType,)}
B, A = "before ", "after "


def side_by_side(df: DataFrame, plan: Plan) -> DataFrame:
    """Each column as it was, named 'before x', and as it becomes, named 'after x'."""
    was = df.withColumns({B + c: t.column(c) for c in df.columns})
    done = compiler.compiled(was, Plan([s for s in plan.steps if s.action != "rename"]))
    return done.select(*(t.column(B + c) for c in df.columns), *(t.column(c).alias(A + c) for c in df.columns))


def joined(before: DataFrame, after: DataFrame, plan: Plan, key: str) -> DataFrame:
    """The same for an output that was made elsewhere, by a key that names each row."""
    names = plan.renames()
    left = before.select(t.column(key).alias("key"), *(t.column(c).alias(B + c) for c in before.columns))
    right = after.select(t.column(names.get(key, key)).alias("key"), *(t.column(names.get(c, c)).alias(A + c) for c in before.columns if names.get(c, c) in after.columns))
    return left.join(right, "key", "left").drop("key")


def _text(df: DataFrame, c: str) -> Column:
    return rendered(df, c)


def new_null(c: str, text: Column) -> Column:
    return t.column(A + c).isNull() & text.isNotNull() & ~t.is_null_token(text)


def counts(both: DataFrame, plan: Plan, years: tuple[int, int] = YEARS) -> DataFrame:
    """One row: n, and for each column the new nulls, changed cells, odd dates and up to LOST lost values."""
    columns = [c.removeprefix(B) for c in both.columns if c.startswith(B) and A + c.removeprefix(B) in both.columns]
    out = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        was, is_ = _text(both, B + c), _text(both, A + c)
        out.append(F.count_if(~was.eqNullSafe(is_)).alias(f"changed{i}"))
        if c in plan.touched():
            lost = new_null(c, was)
            out += [F.count_if(lost).alias(f"lost{i}"), _few(F.when(lost, t.clipped(was))).alias(f"examples{i}")]
        if isinstance(both.schema[A + c].dataType, KINDS["datetime"]):
            out.append(F.avg(F.when(t.column(A + c).isNotNull(), (~F.year(t.column(A + c)).between(*years)).cast("double"))).alias(f"odd{i}"))
    return both.agg(*out)


def _few(c: Column) -> Column:
    """LOST of a column's values, with a state that does not grow with the table."""
    return F.transform(F.approx_top_k(c, F.lit(LOST)), lambda x: x["item"]) if hasattr(F, "approx_top_k") else F.slice(F.collect_set(c), 1, LOST)


class Cell(NamedTuple):
    """What the result row says of one column."""

    name: str
    touched: bool
    actions: tuple[str, ...]
    kind: T.DataType
    rows: int
    changed: int
    lost: int
    examples: list[str]
    odd: float

    @property
    def share(self) -> float:
        return self.lost / self.rows if self.rows else 0.0


def cells(both: DataFrame, plan: Plan) -> list[Cell]:
    """The one row of `counts`, by column."""
    row = counts(both, plan).first().asDict()
    out = []
    for i, c in enumerate(c.removeprefix(B) for c in both.columns if c.startswith(B) and A + c.removeprefix(B) in both.columns):
        actions = tuple(s.action for s in plan.ordered() if s.column == c)
        examples = [x for x in row.get(f"examples{i}") or () if x is not None]
        out.append(Cell(c, c in plan.touched(), actions, both.schema[A + c].dataType, row["n"], row[f"changed{i}"], row.get(f"lost{i}", 0), examples, row.get(f"odd{i}") or 0.0))
    return out


def untouched_changed(x: Cell, _: float) -> list[dict]:
    return [{"message": f"{x.name} is not in the plan but {x.changed} of its values changed"}] if x.changed and not x.touched else []


def new_nulls(x: Cell, most: float) -> list[dict]:
    if not x.touched or x.share <= most:
        return []
    return [{"message": f"{x.name}: {x.share:.1%} of the values became null (at most {most:.0%} may), such as {x.examples}", "ratio": round(x.share, 4), "actions": list(x.actions), "examples": x.examples}]


def dtype(x: Cell, _: float) -> list[dict]:
    wrong = [a for a in x.actions if a in EXPECTED and not isinstance(x.kind, KINDS[EXPECTED[a]])]
    return [{"message": f"{x.name}: {a} should give a {EXPECTED[a]} column, not {x.kind.simpleString()}", "actions": [a]} for a in wrong]


#: Each names its check; all are asked of every column.
RULES = (untouched_changed, new_nulls, dtype)
ODD_DATES = 0.01


def shape(df: DataFrame, after: DataFrame, plan: Plan) -> tuple[list[dict], list[str]]:
    """(problems, warnings) of another output's rows and columns."""
    names, n, m = plan.renames(), df.count(), after.count()
    wanted = [names.get(c, c) for c in df.columns]
    gone, more = [c for c in wanted if c not in after.columns], [c for c in after.columns if c not in wanted]
    found = ((n != m, "row_count", f"there were {n} rows and there are {m}; a plan drops none"), (bool(gone), "columns", f"columns are missing: {gone}"))
    return [{"column": None, "check": check, "message": message} for there, check, message in found if there], [f"columns were added: {more}"] * bool(more)


def check(df: DataFrame, plan: Plan, most: float = 0.02, after: DataFrame | None = None, key: str | None = None) -> dict[str, Any]:
    """{passed, problems, warnings, columns} of a bound plan over df, or of an output `after` that has the key.

    An output with another number of rows is not compared further.
    """
    problems, warnings = shape(df, after, plan) if after is not None else ([], [])
    found: list[Cell] = []
    if not any(p["check"] == "row_count" for p in problems):
        found = cells(side_by_side(df, plan) if after is None else joined(df, after, plan, key), plan)
    problems += [{"column": x.name, "check": rule.__name__, **p} for x in found for rule in RULES for p in rule(x, most)]
    warnings += [f"{x.name}: {x.odd:.1%} of the dates are not in {YEARS[0]} to {YEARS[1]}" for x in found if x.touched and x.odd > ODD_DATES]
    stats = {x.name: {"new_null_ratio": round(x.share, 4), "changed_cells": x.changed, "dtype_after": x.kind.simpleString()} for x in found if x.touched}
    return {"passed": not problems, "problems": problems, "warnings": warnings, "columns": stats}
