"""Plans to programs: a chain of projections, Spark SQL text, or a document pipeline."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions import text as t
from cleanloom.operators import actions, programs
from cleanloom.plans.model import Plan, Step, Unsupported


#: A row's place in the table, beside its columns.
PLACE = "__place"


#: Actions that read a text without the white space around it.
TRIMS = ("canonicalize", "cast_numeric", "parse_dates", "to_bool")


def raw_before(plan: Plan, step: Step) -> Column:
    """The column as the step finds it: after the steps before."""
    c = t.column(step.column).cast("string")
    for s in plan.of(step.column):
        if s is step:
            return c
        c = actions.apply(s, c)
    raise ValueError(step)


def bind(df: DataFrame, plan: Plan) -> Plan:
    """The plan with every parameter that depends on the whole table, from one aggregate over it.

    Dates with strategy 0 get the format of the first value, numbers that should be whole lose that
    wish if one of them is not, categories without a mapping get one, and a mapping (of a sample, say) the
    spellings of the texts that it lacks.  A bound plan has a fixed schema.
    """
    plan = copy.deepcopy(plan)
    asked: dict[str, tuple[Step, Column]] = {}
    for i, s in enumerate(plan.steps):
        if s.action == "cast_numeric" and s.params.get("integer"):
            asked[f"w{i}"] = s, actions.all_whole(actions.cast_numeric(raw_before(plan, s), False, s.strategy))
        if s.action == "parse_dates" and s.strategy <= 0 and "form" not in s.params:
            asked[f"f{i}"] = s, actions.first_form(raw_before(plan, s), F.col(PLACE))
        if s.action == "canonicalize":
            before, known = df.select(raw_before(plan, s).alias("v")), s.params.get("mapping")
            more = actions.unseen_mapping(before, F.col("v"), known) if known else actions.canonical_mapping(before, F.col("v"))
            s.params["mapping"] = {**more, **(known or {})}
    if asked:
        row = df.withColumn(PLACE, F.monotonically_increasing_id()).agg(*(c.alias(k) for k, (_, c) in asked.items())).first()
        for k, (s, _) in asked.items():
            if k[0] == "w":
                s.params["integer"] = bool(row[k])
            elif row[k] is not None:
                s.params["form"] = row[k]
    return plan


def compiled(df: DataFrame, plan: Plan) -> DataFrame:
    """df after a bound plan: no row is dropped, columns keep their places, the untouched ones their types.

    Steps are folded one projection each, so that an expression is written once however often the next
    one uses it; Catalyst decides which of them to merge.  Only a custom step with a pandas program leaves
    the JVM.
    """
    for names in _levels(plan):
        # trimmed text is used by many branches of one expression, so it gets a projection of its own
        trimmed = {s.column: t.trimmed(t.column(s.column)) for s in names if s.action in TRIMS}
        df = df.withColumns(trimmed) if trimmed else df
        plain = {s.column: actions.apply(s, t.column(s.column)) for s in names if "program" not in s.params}
        df = df.withColumns(plain) if plain else df
        for s in names:
            if "program" in s.params:
                df = programs.transformed(df, s.params["program"], s.params.get("types"))
    return df.withColumnsRenamed(plan.renames()) if plan.renames() else df


def _levels(plan: Plan) -> list[list[Step]]:
    """Steps that can share a projection: one of each column, in order."""
    out: list[list[Step]] = []
    depth: dict[str, int] = {}
    for s in plan.ordered():
        if s.action == "rename":
            continue
        k = depth.get(s.column, 0)
        depth[s.column] = k + 1
        while len(out) <= k:
            out.append([])
        out[k].append(s)
    return out


# -- Spark SQL ------------------------------------------------------------------------------


def literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_step(step: Step, c: str) -> str:
    trim = f"btrim({c}, ' \\t\\n\\r\\u000b\\u000c')"
    p = step.params
    if step.action == "standardize_nulls":
        tokens = dict.fromkeys((*t.NULL_TOKENS, *(str(x).strip(t.WHITE).lower() for x in p.get("tokens", ()))))
        return f"CASE WHEN NOT lower({trim}) IN ({', '.join(map(literal, tokens))}) THEN {c} END"
    if step.action == "strip":
        return f"nullif({trim}, '')"
    if step.action == "canonicalize":
        cases = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in sorted((p.get("mapping") or {}).items()))
        return f"CASE lower({trim}) {cases} ELSE {trim} END" if cases else trim
    if step.action == "cast_numeric":
        if step.strategy <= 0:
            special = "|".join((t.PLUS_INFINITY, t.MINUS_INFINITY))
            n = f"CASE WHEN {trim} RLIKE {literal(f'{t.DECIMAL}|(?i){special}')} THEN try_cast({trim} AS DOUBLE) END"
        else:
            found = f"try_cast(replace(nullif(regexp_extract({trim}, {literal(t.NUMBER_IN_TEXT)}, 1), ''), ',', '') AS DOUBLE)"
            n = f"CASE WHEN {trim} RLIKE {literal('(?s)^\\(.*\\)$')} THEN -abs({found}) ELSE {found} END"
        return f"CAST(bround({n}) AS BIGINT)" if p.get("integer") else n
    if step.action == "parse_dates":
        if step.strategy <= 0:
            raise Unsupported("dates in the one format of the first value need the table")
        out = []
        for expression, form in t.DATE_FORMATS:
            if p.get("dayfirst") and step.strategy >= 2 and form == "M/d/yyyy":
                form = "d/M/yyyy"
            plain = f"replace({trim}, ',', '')"
            value = f"try_to_timestamp({plain}, {literal(form)})" if form else f"to_utc_timestamp(try_to_timestamp({plain}), current_timezone())"
            out.append(f"WHEN {trim} RLIKE {literal(expression)} THEN CAST({value} AS TIMESTAMP_NTZ)")
        return f"CASE {' '.join(out)} END"
    if step.action == "to_bool":
        yes, no = (", ".join(map(literal, w)) for w in (t.TRUE_WORDS, t.FALSE_WORDS))
        return f"CASE WHEN lower({trim}) IN ({yes}) THEN true WHEN lower({trim}) IN ({no}) THEN false END"
    raise Unsupported(f"{step.action} has no SQL form")


def to_sql(plan: Plan, columns: list[str], source: str, target: str) -> list[str]:
    """Statements that write the cleaned table `target`: nested selects, one level for each step of a column."""
    inner = f"SELECT {', '.join(f'CAST({t.quoted(c)} AS STRING) AS {t.quoted(c)}' if c in plan.touched() else t.quoted(c) for c in columns)} FROM {t.quoted(source)}"
    for level in _levels(plan):
        now = {s.column: _sql_step(s, t.quoted(s.column)) for s in level}
        inner = f"SELECT {', '.join(f'{now[c]} AS {t.quoted(c)}' if c in now else t.quoted(c) for c in columns)} FROM ({inner})"
    names = plan.renames()
    last = f"SELECT {', '.join(f'{t.quoted(c)} AS {t.quoted(names[c])}' if c in names else t.quoted(c) for c in columns)} FROM ({inner})"
    return [f"DROP TABLE IF EXISTS {t.quoted(target)}", f"CREATE TABLE {t.quoted(target)} USING parquet AS {last}"]


# -- document pipeline ----------------------------------------------------------------------


def to_pipeline(plan: Plan, target: str) -> list[dict[str, Any]]:
    """The plan as stages over documents, for a store that runs them itself; ends in a merge into target."""
    out: list[dict[str, Any]] = []
    for s in plan.ordered():
        field = f"${s.column}"
        text = {"$toString": field}
        trim = {"$trim": {"input": text}}
        low = {"$toLower": trim}
        if s.action == "standardize_nulls":
            tokens = list(dict.fromkeys((*t.NULL_TOKENS, *(str(x).strip().lower() for x in s.params.get("tokens", ())))))
            value: Any = {"$cond": [{"$in": [low, tokens]}, None, field]}
        elif s.action == "strip":
            value = {"$cond": [{"$eq": [{"$type": field}, "string"]}, trim, field]}
        elif s.action == "canonicalize":
            cases = [{"case": {"$eq": [low, k]}, "then": v} for k, v in sorted((s.params.get("mapping") or {}).items())]
            value = {"$switch": {"branches": cases, "default": field}} if cases else field
        elif s.action == "cast_numeric":
            found = {"$regexFind": {"input": text, "regex": t.NUMBER_IN_TEXT}}
            value = {"$convert": {"input": {"$replaceAll": {"input": {"$getField": {"field": "match", "input": found}}, "find": ",", "replacement": ""}}, "to": "double", "onError": None, "onNull": None}}
            if s.params.get("integer"):
                value = {"$round": [value, 0]}
        elif s.action == "parse_dates":
            order = "%d/%m/%Y" if s.params.get("dayfirst") and s.strategy >= 2 else "%m/%d/%Y"
            parse = lambda form: {"$dateFromString": {"dateString": trim, "format": form, "onError": None, "onNull": None}}
            value = {"$ifNull": [parse("%Y-%m-%d"), parse(order), parse("%d.%m.%Y"), {"$dateFromString": {"dateString": trim, "onError": None, "onNull": None}}]}
        elif s.action == "to_bool":
            value = {"$switch": {"branches": [{"case": {"$in": [low, list(t.TRUE_WORDS)]}, "then": True}, {"case": {"$in": [low, list(t.FALSE_WORDS)]}, "then": False}], "default": None}}
        elif s.action == "rename":
            out += [{"$set": {s.params["to"]: field}}, {"$unset": s.column}]
            continue
        else:
            raise Unsupported(f"{s.action} has no form in a document pipeline")
        out.append({"$set": {s.column: value}})
    return [*out, {"$merge": {"into": target, "whenMatched": "replace"}}]
