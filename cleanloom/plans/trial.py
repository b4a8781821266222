"""Whole runs over generated messy tables of all domains, scored against their truth.

Three passes go over the domains with one engine, so that later ones meet what it remembers: first contact, a
repeated delivery of other rows, and a drifted one (dates in another order, a column more, source names gone).
Formats go round.  Each run is one record; the report of a pass is one aggregate over its records.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions import text as t
from cleanloom.operators import datagen, score
from cleanloom.plans.engine import Engine, Result
from cleanloom.plans.model import Plan, Settings
from cleanloom.sources import tables
from cleanloom.sources.spec import Source

FORMATS = ("csv", "parquet", "json")
#: pass: how its tables are corrupted
PASSES: dict[str, dict[str, Any]] = {"first": {}, "repeat": {}, "drift": {"dates": "mixed_eu", "rename": False}}
#: The row number's name in a source, and its type in a target schema.
ROW, ROW_TYPE = "row_no", {"type": "int"}
UNITS = 0.15

RECORD = """pass string, domain string, format string, rows long, seconds double, status string, asked boolean, reason string, attempts int, memory string, planned int, prompt_tokens long,
  precision double, recall double, renamed int, renames int"""
CELLS = "pass string, domain string, kind string, dirty long, repaired long, clean long, damaged long, garbage long, nulled long"


def _answered(engine: Engine, result: Result) -> tuple[Result, str | None]:
    """A run after a reviewer who approves what may run, and why one was asked."""
    if result.review is None:
        return result, None
    reason = result.review["reason"]
    return engine.resume(result.run_id, {"action": "approve"}), reason


def run_one(spark: SparkSession, engine: Engine, name: str, domain: str, kind: str, rows: int, seed: int, folder: str) -> tuple[tuple, list[tuple]]:
    """A record of RECORD and its rows of CELLS: one messy table, stored, cleaned by the engine and scored."""
    messy = datagen.corrupt(datagen.generate(spark, domain, rows, seed), domain, seed, units=UNITS, **PASSES[name])
    extra = [F.lit("v2").alias("batch_tag")] if name == "drift" else []
    source = Source(kind, domain, f"{folder}/{name}/{domain}.{kind}")
    tables.store(messy.dirty.select("*", *extra).withColumnRenamed("_rid", ROW), source)
    target = datagen.target_schema(domain) | {ROW: ROW_TYPE}
    began = time.time()
    result, reason = _answered(engine, engine.run(source, target))
    took, state = round(time.time() - began, 3), result.state
    found = [i for i in state["issues"] if i["column"] not in (ROW, "batch_tag")]
    seen = score.detection(found, messy.injected)
    renames = Plan.from_dict(state["plan"]).renames()
    hits = sum(renames.get(raw) == c for c, raw in messy.renames.items())
    record = (name, domain, kind, state["row_count"], took, result.status, reason is not None, reason, state["attempts"], state.get("memory"), state["planned"], state["usage"].get("prompt_tokens", 0), seen["precision"], seen["recall"], hits, len(messy.renames))
    cells: list[tuple] = []
    if result.status == "succeeded":
        names = {c: renames.get(messy.renames.get(c, c), messy.renames.get(c, c)) for c in messy.clean.columns}
        stored = Plan.from_dict(state["plan"])
        done = _cleaned(spark, Source(kind, domain, state["output"]), stored)
        kinds = {c: spec[0] for c, spec in datagen.DOMAINS[domain].items()}
        cells = [(name, domain, kinds[r["column"]], *(r[c] for c in ("dirty", "repaired", "clean", "damaged", "garbage", "nulled"))) for r in score.cells(messy, done, names).collect()]
    return record, cells


def _cleaned(spark: SparkSession, output: Source, plan: Plan) -> DataFrame:
    """What a run wrote, read again; the types that its plan made return where the format holds text only."""
    df, renames = tables.load(spark, output), plan.renames()
    kinds = {"cast_numeric": "double", "parse_dates": "timestamp_ntz", "to_bool": "boolean"}
    made = {renames.get(s.column, s.column): kinds[s.action] for s in plan.steps if s.action in kinds}
    return df.select(*(t.column(c).cast(made[c]).alias(c) if c in made else t.column(c) for c in df.columns)).withColumn("_rid", t.column(renames.get(ROW, ROW)).cast("long"))


def trial(spark: SparkSession, folder: str, rows: int = 2000, seed: int = 2026, domains: tuple[str, ...] = tuple(datagen.DOMAINS), sample: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(records of runs, their cells by kind) for all passes over all domains."""
    engine = Engine(spark, Settings(folder=f"{folder}/runs", sample_size=sample))
    records, cells = [], []
    for nth, name in enumerate(PASSES):
        for i, domain in enumerate(domains):
            record, counted = run_one(spark, engine, name, domain, FORMATS[i % len(FORMATS)], rows, seed + 100 * nth + i, folder)
            records.append(record)
            cells += counted
    return spark.createDataFrame(records, RECORD), spark.createDataFrame(cells, CELLS)


def summary(records: DataFrame, cells: DataFrame) -> DataFrame:
    """One row for each pass: shares of runs, medians, what was found, and what became of the cells."""
    share = lambda c: F.round(F.avg(F.expr(c).cast("int")), 4)
    runs = records.groupBy("pass").agg(
        F.count("*").alias("runs"), F.sum("rows").alias("rows"), F.round(F.median("seconds"), 3).alias("median_seconds"), F.round(F.try_divide(F.sum("rows"), F.sum("seconds"))).alias("rows_per_second"),
        share("status = 'succeeded' and not asked").alias("auto_success"), share("status = 'succeeded' and not asked and attempts = 1").alias("first_attempt"), share("asked").alias("asked"),
        share("status = 'succeeded'").alias("final_success"), F.round(F.avg("attempts"), 2).alias("mean_attempts"), share("memory = 'exact'").alias("exact_memory"), share("memory = 'similar'").alias("similar_memory"),
        F.sum("planned").alias("planner_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.try_divide(F.sum("renamed"), F.sum("renames")), 4).alias("renames_right"),
    )
    of = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 4)
    return runs.join(cells.groupBy("pass").agg(of("repaired", "dirty").alias("repaired"), of("damaged", "clean").alias("damaged"), of("nulled", "garbage").alias("garbage_nulled")), "pass", "left")


def by_kind(cells: DataFrame) -> DataFrame:
    return cells.groupBy("pass", "kind").agg(F.round(F.try_divide(F.sum("repaired"), F.sum("dirty")), 4).alias("repaired"))


def reasons(records: DataFrame) -> DataFrame:
    """How often a reviewer was asked, by reason: what stands before the first colon or number."""
    return records.where("reason is not null").groupBy(F.trim(F.regexp_extract("reason", r"^[^:\d]*", 0)).alias("reason")).agg(F.count("*").alias("n"))


def rendered(rows: DataFrame) -> str:
    """A small result as a Markdown table, a line for each figure and a column for each pass."""
    found = {r["pass"]: r.asDict() for r in rows.collect()}
    passes = [p for p in PASSES if p in found]
    lines = [["figure", *passes], ["-"] * (len(passes) + 1)]
    lines += [[c, *(str(found[p][c]) for p in passes)] for c in rows.columns if c != "pass"]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)
