"""A bound plan over a stream: the same projections, row by row, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cleanloom.functions import text as t
from cleanloom.operators.profile import value_type
from cleanloom.plans import compiler
from cleanloom.plans.model import Plan


def cleaned(stream: DataFrame, plan: Plan) -> DataFrame:
    """The stream after the plan.  What a plan needs of a whole table must be bound before (compiler.bind)."""
    for s in plan.steps:
        if s.action == "canonicalize" and not s.params.get("mapping"):
            raise ValueError(f"{s.column}: categories need a mapping")
        if s.action == "parse_dates" and s.strategy <= 0 and "form" not in s.params:
            raise ValueError(f"{s.column}: dates in the first value's format need that format")
    return compiler.compiled(stream, plan)


def type_counts(stream: DataFrame, column: str, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Value types of a column by window, for watching a stream for drift; rows later than `late` are left out."""
    kinds = stream.withWatermark(time, late).select(F.col(time), value_type(t.column(column).cast("string")).alias("type"))
    return kinds.groupBy(F.window(time, window), "type").agg(F.count("*").alias("n"))


def write(stream: DataFrame, plan: Plan, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Appends the cleaned stream to files, each batch once; works off what is there and ends."""
    return cleaned(stream, plan).writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
