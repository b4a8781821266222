"""How well a messy table was repaired, against its truth, cell by cell."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import text as t
from cleanloom.operators.datagen import Messy


def comparable(df: DataFrame, c: str) -> Column:
    """A value as text that does not depend on how it is typed: numbers to 6 digits, times to the second."""
    kind, v = df.schema[c].dataType, t.column(c)
    if isinstance(kind, T.BooleanType):
        return v.cast("string")
    if isinstance(kind, T.NumericType):
        return F.round(v.cast("double"), 6).cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(v, "yyyy-MM-dd HH:mm:ss")
    return F.lower(t.trimmed(v))


def cells(messy: Messy, cleaned: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row for each column: dirty, repaired, clean, damaged, garbage and nulled cells.

    A dirty cell is repaired if it is the truth again, or null if that was written; a clean cell is damaged
    if it is something else; garbage should be null.  names: where a clean column is in the result.
    """
    names = names or {c: messy.renames.get(c, c) for c in messy.clean.columns}
    columns = [c for c in messy.clean.columns if c != "_rid" and names.get(c, c) in cleaned.columns]
    truth = messy.clean.select("_rid", *(comparable(messy.clean, c).alias(f"truth {c}") for c in columns))
    marks = messy.marks.select("_rid", *(t.column(c).alias(f"mark {c}") for c in columns))
    got = cleaned.select("_rid", *(comparable(cleaned, names.get(c, c)).alias(f"got {c}") for c in columns))
    rows = truth.join(marks, "_rid").join(got, "_rid", "left")
    out = []
    for c in columns:
        truth_, mark, got_ = (t.column(f"{k} {c}") for k in ("truth", "mark", "got"))
        wanted = F.when(mark == "null_token", F.lit(None)).otherwise(truth_)
        right, garbage = got_.eqNullSafe(wanted), F.coalesce(mark == "garbage", F.lit(False))
        dirty = mark.isNotNull() & ~garbage
        out.append(F.struct(F.lit(c).alias("column"), F.count_if(dirty).alias("dirty"), F.count_if(dirty & right).alias("repaired"), F.count_if(mark.isNull()).alias("clean"), F.count_if(mark.isNull() & ~right).alias("damaged"), F.count_if(garbage).alias("garbage"), F.count_if(garbage & got_.isNull()).alias("nulled")))
    return rows.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quality(found: DataFrame) -> dict[str, float]:
    s = found.agg(*(F.sum(c).alias(c) for c in ("dirty", "repaired", "clean", "damaged", "garbage", "nulled"))).first()
    share = lambda a, b: round(a / b, 4) if b else 1.0
    return {"repaired": share(s["repaired"], s["dirty"]), "damaged": round(s["damaged"] / s["clean"], 4) if s["clean"] else 0.0, "garbage_nulled": share(s["nulled"], s["garbage"])}


def detection(issues: list[dict[str, Any]], injected: set[tuple[str, str]]) -> dict[str, float]:
    """Precision and recall of the issues that were found; ways to say the same kind count as one."""
    same = {"numeric_as_text": "mixed_types", "date_as_text": "date_formats"}
    kinds = lambda pairs: {(c, same.get(k, k)) for c, k in pairs}
    found = kinds((i["column"], i["issue"]) for i in issues if i["issue"] not in ("unmatched_column", "missing_column"))
    put = kinds(injected)
    hit = len(found & put)
    return {"precision": round(hit / len(found), 4) if found else 1.0, "recall": round(hit / len(put), 4) if put else 1.0}
