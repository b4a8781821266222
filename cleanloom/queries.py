"""The engine's own queries over the driver's tables, each with the SQL that gives the same rows.

The tables are typed and clean, so each query first dirties `orders` by a rule that Spark and SQL share:
prices with currency, unit, parentheses or as a written null, dates in four styles, truth words, and
categories in three spellings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions import text as t
from cleanloom.operators import actions, datagen, docschema, drift, issues, matching, score, validate
from cleanloom.operators import profile as prof
from cleanloom.plans import compiler
from cleanloom.plans.engine import Engine
from cleanloom.plans.model import Plan, Settings, Step
from cleanloom.plans.planner import RulePlanner
from cleanloom.sources import tables
from cleanloom.sources.spec import Source, parse

Query = Callable[[SparkSession, str], DataFrame]
TEXT = ["price", "ordered", "priority", "urgent", "custKey"]
#: The columns of a later delivery: one is gone, one is new, one is typed otherwise, one has more nulls.
LATER = {"price": "price", "ordered": "id", "priority": "CASE WHEN id % 2 = 0 THEN priority END", "urgent": "urgent", "status": "status"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        """CASE o_orderkey % 5 WHEN 0 THEN concat('$', format_number(o_totalprice, 2)) WHEN 1 THEN cast(cast(o_totalprice AS decimal(15, 2)) AS string)
           WHEN 2 THEN concat(' ', cast(o_totalprice AS decimal(15, 2)), ' USD') WHEN 3 THEN 'N/A' ELSE concat('(', cast(o_totalprice AS decimal(15, 2)), ')') END AS price""",
        """CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy')
           WHEN 2 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE date_format(o_orderdate, 'MMM d, yyyy') END AS ordered""",
        "CASE o_orderkey % 3 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority) ELSE concat(' ', initcap(o_orderpriority), '\\t') END AS priority",
        """CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' TRUE' WHEN 3 THEN 'f' WHEN 4 THEN '1' WHEN 5 THEN 'maybe' ELSE 'n/a' END AS urgent""",
        "cast(o_custkey AS string) AS custKey",
        "o_orderstatus AS status",
    )


DIRTY = r"""dirty AS (SELECT o_orderkey AS id,
  CASE o_orderkey % 5 WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN o_totalprice::DECIMAL(15, 2)::VARCHAR
    WHEN 2 THEN ' ' || o_totalprice::DECIMAL(15, 2)::VARCHAR || ' USD' WHEN 3 THEN 'N/A' ELSE '(' || o_totalprice::DECIMAL(15, 2)::VARCHAR || ')' END AS price,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS ordered,
  CASE o_orderkey % 3 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority)
    ELSE ' ' || array_to_string(list_transform(string_split(o_orderpriority, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || chr(9) END AS priority,
  CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' TRUE' WHEN 3 THEN 'f' WHEN 4 THEN '1' WHEN 5 THEN 'maybe' ELSE 'n/a' END AS urgent,
  o_custkey::VARCHAR AS custKey, o_orderstatus AS status, o_totalprice, o_orderdate, o_orderpriority FROM orders)"""

NULLS = "('', 'na', 'n/a', 'n.a.', 'null', 'none', 'nil', 'nan', '-', '--', '?', 'unknown', 'missing', '#n/a', '-999', '999999', '(blank)')"


def trim(c: str) -> str:
    return f"trim({c}, E' \\t\\n\\r')"


def nulled(c: str) -> str:
    return f"CASE WHEN lower({trim(c)}) NOT IN {NULLS} THEN {c} END"


def number(c: str) -> str:
    found = f"try_cast(replace(nullif(regexp_extract({trim(c)}, '([+-]?[0-9][0-9,]*\\.?[0-9]*)', 1), ''), ',', '') AS DOUBLE)"
    return f"CASE WHEN regexp_full_match({trim(c)}, '\\(.*\\)') THEN -abs({found}) ELSE {found} END"


def date(c: str, slash: str = "%m/%d/%Y") -> str:
    return f"coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '{slash}'), try_strptime({c}, '%d %b %Y'), try_strptime({c}, '%b %d, %Y'))"


BOOL = f"CASE WHEN lower({trim('urgent')}) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower({trim('urgent')}) IN ('false', 'f', 'no', 'n', '0') THEN false END"

ORDERS = Plan(
    [
        Step("price", "standardize_nulls"),
        Step("price", "cast_numeric", {"integer": False}, 1),
        Step("ordered", "parse_dates", {}, 1),
        Step("priority", "strip"),
        Step("urgent", "standardize_nulls"),
        Step("urgent", "to_bool"),
        Step("custKey", "cast_numeric", {"integer": True}, 0),
        Step("custKey", "rename", {"to": "cust_key"}),
    ]
)
CLEAN = f"""SELECT id, {number(f'({nulled("price")})')} AS price, {date('ordered')} AS ordered, nullif({trim('priority')}, '') AS priority,
  {BOOL.replace('urgent', f'({nulled("urgent")})')} AS urgent, custKey::BIGINT AS cust_key, status FROM dirty"""


def with_plan(*steps: Step, keep: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = dirty(spark, sf_dir)
        return compiler.compiled(df, compiler.bind(df, Plan(list(steps)))).select("id", *keep)

    return run


def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty(spark, sf_dir)
    return compiler.compiled(df, compiler.bind(df, ORDERS))


def clean_orders_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan as SQL text over a view."""
    df = dirty(spark, sf_dir)
    df.createOrReplaceTempView("cleanloom_dirty_orders")
    _, create = compiler.to_sql(compiler.bind(df, ORDERS), df.columns, "cleanloom_dirty_orders", "clean_orders")
    return spark.sql(create.split(" AS ", 1)[1])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.values(dirty(spark, sf_dir).select(*TEXT))


def prof_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.type_histogram(texts(spark, sf_dir))


def prof_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.top_values(texts(spark, sf_dir))


def summary(*columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prof.summary(texts(spark, sf_dir)).select("column", *columns)

    return run


TYPE = f"""CASE WHEN value IS NULL THEN 'null' WHEN lower({trim('value')}) IN {NULLS} THEN 'null_token'
  WHEN regexp_full_match({trim('value')}, '[+-]?[0-9]+') THEN CASE WHEN length({trim('value')}) > 1 AND regexp_matches({trim('value')}, '^[+-]*0') THEN 'str' ELSE 'int' END
  WHEN regexp_full_match({trim('value')}, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float'
  WHEN regexp_full_match({trim('value')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date:iso'
  WHEN regexp_full_match({trim('value')}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN 'date:us'
  WHEN regexp_full_match({trim('value')}, '[0-9]{{1,2}} [A-Za-z]{{3,9}},? [0-9]{{4}}') THEN 'date:text_dmy'
  WHEN regexp_full_match({trim('value')}, '[A-Za-z]{{3,9}} [0-9]{{1,2}},? [0-9]{{4}}') THEN 'date:text_mdy'
  WHEN lower({trim('value')}) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f') THEN 'bool'
  WHEN regexp_full_match({trim('value')}, '(?i)([$€£₹]|usd|eur|inr)?\\s*[+-]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\\.[0-9]+)?\\s*(%|[a-z]{{1,6}}\\.?)?') THEN 'numeric_text'
  ELSE 'str' END"""


def typed(columns: dict[str, str], at: str = "") -> str:
    """v: the values of columns (by expression), c: each with its count and type."""
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", ({x})::VARCHAR AS value FROM dirty" for c, x in columns.items())
    return f'v{at} AS ({parts}), c{at} AS (SELECT "column", value, count(*) AS n, {TYPE} AS type FROM v{at} GROUP BY ALL)'


def facts(at: str = "") -> str:
    """p: what `profiled` gives, and more that the rules ask for, from c."""
    return f"""z{at} AS (SELECT "column", bool_and(ltrim({trim('value')}, '+') IN ('0', '1')) FILTER (type = 'int') AND count(*) FILTER (type = 'bool') > 0 AS ones FROM c{at} GROUP BY 1),
    g{at} AS (SELECT "column", CASE WHEN type = 'int' AND ones THEN 'bool' WHEN type IN ('int', 'float', 'numeric_text') THEN 'number' WHEN type LIKE 'date%' THEN 'date' ELSE type END AS family, type, n
      FROM c{at} JOIN z{at} USING ("column") WHERE type NOT IN ('null', 'null_token')),
    f{at} AS (SELECT "column", family, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY "column") AS present FROM g{at} GROUP BY 1, 2),
    b{at} AS (SELECT "column", arg_min(family, (-n, family)) AS family, max(n) / any_value(present) AS share, any_value(present) AS present FROM f{at} GROUP BY 1),
    r{at} AS (SELECT "column", list(value ORDER BY n DESC, value)[1:8] AS top FROM c{at} WHERE value IS NOT NULL GROUP BY 1),
    m{at} AS (SELECT "column", sum(n) AS n, round(sum(n) FILTER (type IN ('null', 'null_token')) / sum(n), 4) AS null_ratio, count(value) AS "distinct", count(DISTINCT lower({trim('value')})) AS folded, count(DISTINCT {trim('value')}) AS stripped,
      count(*) FILTER (type = 'null_token') AS tokens, sum(n) FILTER (value <> {trim('value')} AND {trim('value')} <> '') AS padded, list_sort(list(DISTINCT type) FILTER (type LIKE 'date%')) AS forms,
      count(*) FILTER (type IN ('numeric_text', 'str')) AS strays FROM c{at} GROUP BY 1),
    p{at} AS (SELECT "column", coalesce(family, 'null') AS family, coalesce(null_ratio, 0.0) AS null_ratio, "distinct", top, folded, stripped, tokens, padded, forms, strays, share, present FROM m{at} LEFT JOIN b{at} USING ("column") LEFT JOIN r{at} USING ("column"))"""


TYPED = f"{DIRTY}, {typed({c: c for c in TEXT})}"
PROFILED = f"{TYPED}, {facts()}"
DRIFT = f"""WITH {PROFILED}, {typed(LATER, "2")}, {facts("2")},
j AS (SELECT coalesce(a."column", b."column") AS "column", a."column" IS NOT NULL AS was, b."column" IS NOT NULL AS is_, a.family AS f1, b.family AS f2, a.null_ratio AS n1, b.null_ratio AS n2, a."distinct" AS d1,
  list_sort(list_filter(b.top, lambda x: NOT list_contains(a.top, x))) AS fresh FROM p a FULL JOIN p2 b ON a."column" = b."column")
SELECT "column", 'new_column' AS kind, true AS structural, NULL::VARCHAR AS detail FROM j WHERE NOT was
UNION ALL SELECT "column", 'dropped_column', true, NULL FROM j WHERE NOT is_
UNION ALL SELECT "column", 'type_change', true, '{{"from":"' || f1 || '","to":"' || f2 || '"}}' FROM j WHERE was AND is_ AND f1 <> f2
UNION ALL SELECT "column", 'null_jump', false, '{{"from":' || n1 || ',"to":' || n2 || '}}' FROM j WHERE n2 - n1 > 0.2
UNION ALL SELECT "column", 'new_categories', false, '{{"values":["' || replace(array_to_string(fresh[1:5], '","'), chr(9), '\\t') || '"]}}' FROM j WHERE was AND is_ AND f1 = 'str' AND d1 <= 20 AND len(fresh) > 0"""
ISSUES = f"""{PROFILED}, i AS (
  SELECT "column", 'null_tokens' AS issue, 'standardize_nulls' AS action, 'error' AS severity FROM p WHERE tokens > 0
  UNION ALL SELECT "column", 'whitespace', 'strip', 'error' FROM p JOIN m USING ("column") WHERE round(m.padded / m.n, 4) > 0
  UNION ALL SELECT "column", CASE WHEN strays > 0 THEN 'mixed_types' ELSE 'numeric_as_text' END, 'cast_numeric', 'error' FROM p WHERE family = 'number' AND share >= 0.8
  UNION ALL SELECT "column", CASE WHEN len(forms) > 1 THEN 'date_formats' ELSE 'date_as_text' END, 'parse_dates', 'error' FROM p WHERE family = 'date' AND share >= 0.8
  UNION ALL SELECT "column", 'bool_as_text', 'to_bool', 'error' FROM p WHERE family = 'bool' AND share >= 0.8
  UNION ALL SELECT "column", 'inconsistent_categories', 'canonicalize', 'error' FROM p WHERE family = 'str' AND share >= 0.8 AND folded <= 50 AND folded < stripped AND folded < 0.5 * present
  UNION ALL SELECT "column", 'naming', 'rename', 'warning' FROM p WHERE NOT regexp_full_match("column", '[a-z0-9]+(_[a-z0-9]+)*'))"""


def before_and_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Plan]:
    df = dirty(spark, sf_dir)
    return validate.side_by_side(df, compiler.bind(df, ORDERS)), ORDERS


def val_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New nulls and changed cells of each column of the plan, in one pass; a row for each column."""
    both, plan = before_and_after(spark, sf_dir)
    columns = [c.removeprefix(validate.B) for c in both.columns if c.startswith(validate.B)]
    row = validate.counts(both, plan)
    cells = [F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"changed{i}").alias("changed"), (F.col(f"lost{i}") if c in plan.touched() else F.lit(None).cast("long")).alias("new_nulls")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def val_odd_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of dates outside 1993 to 1996, as validation counts it."""
    both, plan = before_and_after(spark, sf_dir)
    columns = [c.removeprefix(validate.B) for c in both.columns if c.startswith(validate.B)]
    return validate.counts(both, plan, (1993, 1996)).select(F.round(f"odd{columns.index('ordered')}", 6).alias("odd"), "n")


def dayfirst_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).groupBy("status").agg(actions.dayfirst_evidence(F.col("ordered")).alias("dayfirst"))


def canonical_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.spellings(dirty(spark, sf_dir), F.col("priority"))


def profiled(v: DataFrame) -> DataFrame:
    """(column, family, null_ratio, distinct, top): what drift and signatures need of a profile."""
    tops = prof.ranked(v.where("value is not null"), prof.TOP, "tops").select("column", F.transform("tops", lambda x: x["value"]).alias("top"))
    return prof.facts(v).select("column", F.col("dominant_family").alias("family"), "null_ratio", "distinct").join(tops, "column", "left")


def prof_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiled(texts(spark, sf_dir)).withColumn("top", F.array_join("top", "|"))


def prof_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent written nulls of each column."""
    v = texts(spark, sf_dir).where("type = 'null_token'")
    return prof.ranked(v, prof.TOKENS, "x").select("column", F.explode("x").alias("x")).select("column", "x.*")


def prof_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of each value type of each column."""
    v = texts(spark, sf_dir).where("value is not null")
    return prof.ranked(v, prof.EXAMPLES, "x", ("type",)).select("column", F.explode("x").alias("x")).select("column", "x.*")


def drift_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = dirty(spark, sf_dir).selectExpr(*(f"cast({x} AS string) AS {c}" for c, x in LATER.items()))
    return drift.signals(profiled(texts(spark, sf_dir)), profiled(prof.values(now)))


def schema_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiled(texts(spark, sf_dir))
    names = {c: t.snake(c) for c in TEXT}
    named = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("column")]
    return rows.select(F.concat(named, F.lit(":"), "family").alias("part")).agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("signature")).select("signature", F.substring(F.sha2("signature", 256), 1, 16).alias("fingerprint"))


def shaped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of mixed shapes, made of events."""
    return table(spark, sf_dir, "events").selectExpr(
        """CASE event_id % 4 WHEN 0 THEN concat('{"id": ', event_id, ', "type": "', event_type, '", "at": {"city": "x", "zip": 1}}')
           WHEN 1 THEN concat('{"id": ', event_id, ', "at": "nowhere", "tags": [{"n": 1}, {"n": "two"}]}')
           WHEN 2 THEN concat('{"id": "', event_id, '", "at": null, "tags": "none"}') ELSE props END AS doc"""
    )


def doc_schema_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docschema.histogram(shaped_events(spark, sf_dir), "doc")


def doc_shape_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docschema.conflicts(docschema.histogram(shaped_events(spark, sf_dir), "doc"))


EVENTS = """d AS (SELECT CASE event_id % 4 WHEN 0 THEN '{"id": ' || event_id || ', "type": "' || event_type || '", "at": {"city": "x", "zip": 1}}'
    WHEN 1 THEN '{"id": ' || event_id || ', "at": "nowhere", "tags": [{"n": 1}, {"n": "two"}]}'
    WHEN 2 THEN '{"id": "' || event_id || '", "at": null, "tags": "none"}' ELSE props END AS doc FROM events),
s(path, v, field) AS (SELECT '', doc::JSON, false FROM d WHERE json_valid(doc) AND json_type(doc) = 'OBJECT'
  UNION ALL SELECT x.path, x.v, x.field FROM (SELECT unnest(CASE json_type(v)
    WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'path': CASE path WHEN '' THEN k ELSE path || '.' || k END, 'v': json_extract(v, '$."' || k || '"'), 'field': true})
    WHEN 'ARRAY' THEN list_transform(list_filter((v::JSON[])[1:3], lambda e: json_type(e) = 'OBJECT'), lambda e: {'path': path || '[]', 'v': e, 'field': false}) END) AS x FROM s)),
t AS (SELECT count(*) AS total FROM d),
h AS (SELECT path, CASE json_type(v) WHEN 'VARCHAR' THEN 'str' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS type,
      count(*) AS n FROM s WHERE field AND path <> '_id' GROUP BY ALL)"""


def score_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each dirtied column: cells that differ from the truth as text, and those the plan gives back."""
    truth = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS t_price", "o_orderdate AS t_ordered", "o_orderpriority AS t_priority")
    out = clean_orders(spark, sf_dir).join(truth, "id")
    same = {
        "price": F.abs(F.abs("price") - F.col("t_price")) < 0.005,
        "ordered": F.col("ordered") == F.date_trunc("day", "t_ordered").cast("timestamp_ntz"),
        "priority": F.lower("priority") == F.lower("t_priority"),
    }
    cells = [F.struct(F.lit(c).alias("column"), F.count("*").alias("cells"), F.count_if(F.coalesce(x, F.lit(False))).alias("repaired")) for c, x in same.items()]
    return out.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def act_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.compiled(dirty(spark, sf_dir), Plan([Step("status", "custom", {"expression": "concat(lower(status), '-', id % 3)"})])).select("id", "status")


def issues_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inconsistencies that the rules find in the raw table.

    A quarter of the prices that are there stand in parentheses, which is no number's form, so numbers are too
    few there to be the column's family.
    """
    found = issues.detect(prof.profile(dirty(spark, sf_dir).select(*TEXT)))
    return spark.createDataFrame([(i["column"], i["issue"], i["action"], i["severity"]) for i in found], "column string, issue string, action string, severity string")


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that the rules plan for them, with the strategy each starts from."""
    raw = dirty(spark, sf_dir).select(*TEXT)
    p = prof.profile(raw)
    plan = RulePlanner().plan(p, issues.detect(p), raw).plan
    return spark.createDataFrame([(i, s.column, s.action, s.strategy) for i, s in enumerate(plan.ordered())], "place int, column string, action string, strategy int")


#: Source columns, with the column of orders that holds their values, and a target schema's.
SOURCE = {"orderKey": "o_orderkey", "client_id": "o_custkey", "order_dates": "o_orderdate", "total": "o_totalprice", "zz": "o_orderstatus"}
WANTED = ["order_key", "customer_id", "order_date", "total"]


def match_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw columns against a target schema: the same name, a normalised name, a synonym, a near name."""
    shown = prof.profile(table(spark, sf_dir, "orders").select(*(F.col(x).cast("string").alias(c) for c, x in SOURCE.items())))
    found, left = matching.match({c: [x for xs in shown[c]["examples"].values() for x in xs] for c in SOURCE}, {c: [] for c in WANTED})
    return spark.createDataFrame([(m.source, m.target, m.level) for m in found] + [(c, None, "none") for c in left], "source string, target string, level string")


SYNONYMS = ", ".join(f"('{name}', {k})" for k, group in enumerate(matching.SYNONYMS) for name in group)
MATCHED = f"""WITH s AS (SELECT unnest({list(SOURCE)}) AS s), t AS (SELECT unnest({WANTED}) AS t), y(name, k) AS (VALUES {SYNONYMS}),
p AS (SELECT s, t, lower(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS n FROM s, t),
l AS (SELECT s, t, CASE WHEN s = t THEN 1 WHEN n = t THEN 2 WHEN EXISTS (SELECT 1 FROM y a JOIN y b USING (k) WHERE a.name = n AND b.name = t) THEN 3
  WHEN 100 * (length(n) + length(t) - levenshtein(n, t)) / (length(n) + length(t)) >= 88 THEN 4 ELSE 9 END AS level FROM p),
b AS (SELECT s, min(level) AS level, arg_min(t, level) AS t FROM l GROUP BY 1)
SELECT s AS source, CASE WHEN level < 9 THEN t END AS target, CASE level WHEN 1 THEN 'exact' WHEN 2 THEN 'normalized' WHEN 3 THEN 'synonym' WHEN 4 THEN 'fuzzy' ELSE 'none' END AS level FROM b"""


#: Schemas to compare with.
OTHERS = {"same": ["price:number", "ordered:date", "priority:str", "urgent:bool", "custKey:number"], "typed": ["price:number", "ordered:str", "priority:str"], "other": ["x:str"]}


def schema_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the raw table's schema is to each of three others: shared columns with families, shared names."""
    own = profiled(texts(spark, sf_dir)).select(F.concat("column", F.lit(":"), "family").alias("part")).agg(F.collect_set("part").alias("a"))
    others = spark.createDataFrame(list(OTHERS.items()), "name string, b array<string>")
    names = lambda c: F.array_distinct(F.transform(c, lambda x: F.split(x, ":")[0]))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return others.join(F.broadcast(own)).select("name", F.round(0.7 * share(F.col("a"), F.col("b")) + 0.3 * share(names(F.col("a")), names(F.col("b"))), 4).alias("similarity"))


def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "named_struct('status', o_orderstatus, 'price', named_struct('total', o_totalprice)) AS o")
    return docschema.flattened(nested)


def repair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated messy tables of all domains, in all as many rows as orders, planned and repaired by the rules: cells by column."""
    out, rows = None, -(-table(spark, sf_dir, "orders").count() // len(datagen.DOMAINS))
    for seed, domain in enumerate(datagen.DOMAINS):
        messy = datagen.corrupt(datagen.generate(spark, domain, rows, seed), domain, seed)
        raw = messy.dirty.drop("_rid")
        p = prof.profile(raw)
        plan = RulePlanner().plan(p, issues.detect(p), raw).plan
        done = compiler.compiled(messy.dirty, compiler.bind(messy.dirty, plan))
        names = {c: plan.renames().get(messy.renames.get(c, c), messy.renames.get(c, c)) for c in messy.clean.columns}
        cells = score.cells(messy, done, names).select(F.lit(domain).alias("domain"), "*")
        out = cells if out is None else out.unionByName(cells)
    return out


def dates_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with an offset become UTC without one."""
    raw = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:15:00', CASE o_orderkey % 3 WHEN 0 THEN '+02:00' WHEN 1 THEN 'Z' ELSE '-05:30' END) AS placed")
    return compiler.compiled(raw, Plan([Step("placed", "parse_dates", {}, 1)]))


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table stored as delimited text and read again: all text, white space kept."""
    source = Source("csv", "orders", f"{tables.scratch(spark, 'csv')}/orders.csv")
    tables.store(dirty(spark, sf_dir), source)
    return tables.load(spark, source)


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat columns nested for a document store and flattened when read."""
    source = Source("json", "orders", f"{tables.scratch(spark, 'json')}/orders.json")
    tables.store(flatten_documents(spark, sf_dir), source)
    return tables.load(spark, source)


def source_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingesting a table comes to: rows, rows of the sample, those of them that are the table's, distinct ones."""
    got = tables.ingest(spark, parse(f"{sf_dir}/orders.parquet"), 1000)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    own = got.sample.join(orders, "o_orderkey", "left").agg(F.count("*").alias("sampled"), F.count_if(F.col("price") == F.col("o_totalprice")).alias("own"), F.count_distinct("o_orderkey").alias("distinct"))
    return own.withColumn("row_count", F.lit(got.row_count).cast("long")).withColumn("columns", F.lit(len(got.declared)).cast("long"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw table that the engine cleans by itself."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        """CASE o_orderkey % 10 WHEN 0 THEN concat('$', format_number(o_totalprice, 2)) WHEN 1 THEN concat(' ', cast(o_totalprice AS decimal(15, 2)), ' USD') WHEN 2 THEN 'N/A'
           ELSE cast(cast(o_totalprice AS decimal(15, 2)) AS string) END AS price""",
        "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE date_format(o_orderdate, 'MMM d, yyyy') END AS ordered",
        "CASE o_orderkey % 10 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority) ELSE concat(initcap(o_orderpriority), '\\t') END AS priority",
        "CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' TRUE' WHEN 3 THEN 'f' ELSE 'n/a' END AS urgent",
        "cast(o_custkey AS string) AS custKey",
        "o_orderstatus AS status",
    )


ENGINE = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 2 THEN o_totalprice::DECIMAL(15, 2)::DOUBLE END AS price, o_orderdate::DATE::TIMESTAMP AS ordered,
  array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS priority,
  CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS urgent, o_custkey::BIGINT AS cust_key, o_orderstatus AS status FROM orders"""


def engine_run(times: int) -> Query:
    """A whole run over a raw table, from ingest to the table it writes; with more than one the last uses the stored plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = tables.scratch(spark, "engine")
        source = Source("parquet", "raw_orders", f"{folder}/raw_orders.parquet")
        tables.store(raw_orders(spark, sf_dir), source)
        engine = Engine(spark, Settings(folder=f"{folder.removeprefix('file:')}/runs"))
        for nth in range(times):
            done = engine.run(source)
            if done.status != "succeeded" or (done.state["memory"] == "exact") != (nth > 0):
                raise RuntimeError(f"run {nth}: {done.status}, {done.state['memory']}, {done.state['errors']}")
        return spark.read.parquet(done.state["output"])

    return run


def sql_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan over a catalog table, applied as the SQL that it compiles to, by the engine's own last step."""
    source = Source("table", f"cleanloom_raw_{uuid.uuid4().hex}")
    tables.store(dirty(spark, sf_dir), source)
    df = tables.load(spark, source)
    where, by = Engine(spark).written(df, compiler.bind(df, ORDERS), source, tables.output_name(source))
    if by != "sql":
        raise RuntimeError(f"written by {by}")
    return spark.table(where)


QUERIES: dict[str, tuple[Query, str | None]] = {
    "clean_orders": (clean_orders, f"WITH {DIRTY} {CLEAN}"),
    "clean_orders_sql": (clean_orders_sql, f"WITH {DIRTY} {CLEAN}"),
    "act_standardize_nulls": (with_plan(Step("price", "standardize_nulls"), Step("urgent", "standardize_nulls", {"tokens": ["Maybe "]}), keep=("price", "urgent")), f"WITH {DIRTY} SELECT id, {nulled('price')} AS price, CASE WHEN lower({trim('urgent')}) NOT IN {NULLS} AND lower({trim('urgent')}) <> 'maybe' THEN urgent END AS urgent FROM dirty"),
    "act_strip": (with_plan(Step("price", "strip"), Step("priority", "strip"), keep=("price", "priority")), f"WITH {DIRTY} SELECT id, nullif({trim('price')}, '') AS price, nullif({trim('priority')}, '') AS priority FROM dirty"),
    "act_cast_numeric_s0": (with_plan(Step("price", "cast_numeric", {}, 0), keep=("price",)), f"WITH {DIRTY} SELECT id, CASE WHEN regexp_full_match({trim('price')}, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({trim('price')} AS DOUBLE) END AS price FROM dirty"),
    "act_cast_numeric_s1": (with_plan(Step("price", "cast_numeric", {}, 1), keep=("price",)), f"WITH {DIRTY} SELECT id, {number('price')} AS price FROM dirty"),
    "act_cast_int": (with_plan(Step("custKey", "cast_numeric", {"integer": True}, 0), Step("price", "cast_numeric", {"integer": True}, 1), keep=("custKey", "price")), f"WITH {DIRTY} SELECT id, custKey::BIGINT AS custKey, {number('price')} AS price FROM dirty"),
    "act_parse_dates_s0": (with_plan(Step("ordered", "parse_dates", {"form": "M/d/yyyy"}, 0), keep=("ordered",)), f"WITH {DIRTY} SELECT id, try_strptime(ordered, '%m/%d/%Y') AS ordered FROM dirty"),
    "act_parse_dates_s1": (with_plan(Step("ordered", "parse_dates", {"dayfirst": True}, 1), keep=("ordered",)), f"WITH {DIRTY} SELECT id, {date('ordered')} AS ordered FROM dirty"),
    "act_parse_dates_s2": (with_plan(Step("ordered", "parse_dates", {"dayfirst": True}, 2), keep=("ordered",)), f"WITH {DIRTY} SELECT id, {date('ordered', '%d/%m/%Y')} AS ordered FROM dirty"),
    "act_to_bool": (with_plan(Step("urgent", "to_bool"), keep=("urgent",)), f"WITH {DIRTY} SELECT id, {BOOL} AS urgent FROM dirty"),
    "act_canonicalize": (
        with_plan(Step("priority", "canonicalize"), keep=("priority",)),
        f"""WITH {DIRTY}, s AS (SELECT {trim('priority')} AS v, count(*) AS n FROM dirty GROUP BY 1),
        b AS (SELECT lower(v) AS k, v, row_number() OVER (PARTITION BY lower(v) ORDER BY n DESC, v) AS r FROM s)
        SELECT id, v AS priority FROM dirty JOIN b ON k = lower({trim('priority')}) AND r = 1""",
    ),
    "act_rename": (with_plan(Step("custKey", "rename", {"to": "cust_key"}), keep=("cust_key",)), f"WITH {DIRTY} SELECT id, custKey AS cust_key FROM dirty"),
    "act_custom": (act_custom, f"WITH {DIRTY} SELECT id, lower(status) || '-' || (id % 3) AS status FROM dirty"),
    "prof_types": (prof_types, f"WITH {TYPED}, k AS (SELECT \"column\", type, sum(n)::BIGINT AS n FROM c GROUP BY ALL) SELECT \"column\", type, n, round(n / sum(n) OVER (PARTITION BY \"column\"), 4) AS ratio FROM k"),
    "prof_top_values": (prof_top_values, f"WITH {TYPED} SELECT \"column\", value, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 8"),
    "prof_null_ratio": (summary("count", "nulls", "null_tokens"), f"WITH {TYPED} SELECT \"column\", sum(n)::BIGINT AS count, coalesce(sum(n) FILTER (type = 'null'), 0)::BIGINT AS nulls, coalesce(sum(n) FILTER (type = 'null_token'), 0)::BIGINT AS null_tokens FROM c GROUP BY 1"),
    "prof_distinct": (summary("distinct", "distinct_normalized", "distinct_stripped"), f"WITH {TYPED} SELECT \"column\", count(value) AS \"distinct\", count(DISTINCT lower({trim('value')})) AS distinct_normalized, count(DISTINCT {trim('value')}) AS distinct_stripped FROM c GROUP BY 1"),
    "prof_whitespace": (summary("padded"), f"WITH {TYPED} SELECT \"column\", coalesce(sum(n) FILTER (value <> {trim('value')} AND {trim('value')} <> ''), 0)::BIGINT AS padded FROM c GROUP BY 1"),
    "prof_integral": (summary("whole", "ints_are_01"), f"WITH {TYPED} SELECT \"column\", bool_and(try_cast(replace(nullif(regexp_extract(value, '([+-]?[0-9][0-9,]*\\.?[0-9]*)', 1), ''), ',', '') AS DOUBLE) % 1 = 0) AS whole, coalesce(bool_and(ltrim({trim('value')}, '+') IN ('0', '1')) FILTER (type = 'int'), true) AS ints_are_01 FROM c GROUP BY 1"),
    "val_counts": (
        val_counts,
        f"""WITH {DIRTY}, after_ AS ({CLEAN}), b AS (SELECT d.*, a.price AS p2, a.ordered AS o2, a.priority AS q2, a.urgent AS u2 FROM dirty d JOIN after_ a USING (id)),
        n AS (SELECT count(*) AS n FROM b)
        SELECT 'id' AS "column", n, 0::BIGINT AS changed, NULL::BIGINT AS new_nulls FROM n UNION ALL SELECT 'status', n, 0, NULL FROM n UNION ALL SELECT 'custKey', n, 0, 0 FROM n
        UNION ALL SELECT 'price', n, (SELECT count(*) FROM b WHERE p2 IS NULL OR id % 5 <> 1 OR p2::VARCHAR <> price AND regexp_replace(p2::VARCHAR, '\\.0$', '') <> price), (SELECT count(*) FROM b WHERE p2 IS NULL AND price <> 'N/A') FROM n
        UNION ALL SELECT 'ordered', n, (SELECT count(*) FROM b WHERE strftime(o2, '%Y-%m-%d %H:%M:%S') IS DISTINCT FROM ordered), (SELECT count(*) FROM b WHERE o2 IS NULL) FROM n
        UNION ALL SELECT 'priority', n, (SELECT count(*) FROM b WHERE q2 IS DISTINCT FROM priority), (SELECT count(*) FROM b WHERE q2 IS NULL) FROM n
        UNION ALL SELECT 'urgent', n, n, (SELECT count(*) FROM b WHERE u2 IS NULL AND urgent <> 'n/a') FROM n""",
    ),
    "val_odd_dates": (val_odd_dates, f"WITH {DIRTY}, a AS ({CLEAN}) SELECT round(avg((year(ordered) NOT BETWEEN 1993 AND 1996)::DOUBLE), 6) AS odd, count(*) AS n FROM a"),
    "dayfirst_evidence": (dayfirst_evidence, f"WITH {DIRTY}, p AS (SELECT status, try_cast(string_split(ordered, '/')[1] AS INTEGER) AS a, try_cast(string_split(ordered, '/')[2] AS INTEGER) AS b FROM dirty WHERE ordered LIKE '%/%/%') SELECT status, coalesce(bool_or(a > 12) AND NOT bool_or(b > 12), false) AS dayfirst FROM dirty LEFT JOIN p USING (status) GROUP BY 1"),
    "canonical_spellings": (canonical_spellings, f"WITH {DIRTY}, s AS (SELECT {trim('priority')} AS v, count(*) AS n FROM dirty GROUP BY 1) SELECT lower(v) AS key, arg_min(v, (-n, v)) AS spelling FROM s GROUP BY 1"),
    "prof_facts": (prof_facts, f"WITH {PROFILED} SELECT \"column\", family, null_ratio, \"distinct\", array_to_string(top, '|') AS top FROM p"),
    "prof_tokens": (prof_tokens, f"WITH {TYPED} SELECT * FROM (SELECT \"column\", row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value)::INTEGER AS rank, value, n FROM c WHERE type = 'null_token') WHERE rank <= 5"),
    "prof_examples": (prof_examples, f"WITH {TYPED} SELECT * FROM (SELECT \"column\", type, row_number() OVER (PARTITION BY \"column\", type ORDER BY n DESC, value)::INTEGER AS rank, value, n FROM c WHERE value IS NOT NULL) WHERE rank <= 3"),
    "drift_signals": (drift_signals, DRIFT),
    "schema_signature": (schema_signature, f"WITH {PROFILED}, s AS (SELECT string_agg(part, ',' ORDER BY part) AS signature FROM (SELECT (CASE \"column\" WHEN 'custKey' THEN 'cust_key' ELSE \"column\" END) || ':' || family AS part FROM p)) SELECT signature, sha256(signature)[1:16] AS fingerprint FROM s"),
    "doc_schema_hist": (doc_schema_hist, f"WITH RECURSIVE {EVENTS} SELECT path, type, n, round(sum(n) OVER (PARTITION BY path) / total, 4) AS presence FROM h, t"),
    "doc_shape_conflicts": (doc_shape_conflicts, f"WITH RECURSIVE {EVENTS}, k AS (SELECT * FROM h WHERE type <> 'null') SELECT path, type AS shape FROM k WHERE type IN ('object', 'array') AND path IN (SELECT path FROM k GROUP BY 1 HAVING count(DISTINCT type) > 1)"),
    "issues_list": (issues_list, f"WITH {ISSUES} SELECT * FROM i"),
    "plan_steps": (
        plan_steps,
        f"""WITH {ISSUES}, o(action, o) AS (VALUES ('standardize_nulls', 0), ('strip', 1), ('canonicalize', 2), ('cast_numeric', 3), ('parse_dates', 3), ('to_bool', 3), ('rename', 9))
        SELECT (row_number() OVER (ORDER BY o, "column") - 1)::INTEGER AS place, "column", action,
          CASE WHEN action = 'cast_numeric' AND strays > 0 OR action = 'parse_dates' AND forms NOT IN (['date:iso'], ['datetime:iso']) THEN 1 ELSE 0 END AS strategy FROM i JOIN o USING (action) JOIN p USING ("column")""",
    ),
    "match_columns": (match_columns, MATCHED),
    "schema_similarity": (
        schema_similarity,
        f"""WITH {PROFILED}, o AS (SELECT unnest([{", ".join(f"{{'name': '{k}', 'b': {v}}}" for k, v in OTHERS.items())}], recursive := true)),
        a AS (SELECT list("column" || ':' || family) AS a FROM p), x AS (SELECT name, a, b, list_distinct(list_transform(a, lambda s: string_split(s, ':')[1])) AS an, list_distinct(list_transform(b, lambda s: string_split(s, ':')[1])) AS bn FROM o, a)
        SELECT name, round(0.7 * len(list_intersect(a, b)) / len(list_distinct(a || b)) + 0.3 * len(list_intersect(an, bn)) / len(list_distinct(an || bn)), 4) AS similarity FROM x""",
    ),
    "flatten_documents": (flatten_documents, 'SELECT o_orderkey AS id, o_orderstatus AS "o.status", o_totalprice AS "o.price.total" FROM orders'),
    "act_date_offsets": (
        dates_with_offsets,
        "SELECT o_orderkey AS id, o_orderdate::DATE::TIMESTAMP + INTERVAL '10 hours 15 minutes' + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '-2 hours' WHEN 1 THEN INTERVAL '0 hours' ELSE INTERVAL '5 hours 30 minutes' END AS placed FROM orders",
    ),
    "source_csv": (source_csv, f"WITH {DIRTY} SELECT id::VARCHAR AS id, price, ordered, priority, urgent, custKey, status FROM dirty"),
    "source_json": (source_json, 'SELECT o_orderkey AS id, o_orderstatus AS "o.status", o_totalprice AS "o.price.total" FROM orders'),
    "source_sample": (source_sample, "SELECT least(count(*), 1000) AS sampled, least(count(*), 1000) AS own, least(count(*), 1000) AS \"distinct\", count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE orders)) AS \"columns\" FROM orders"),
    "engine_run": (engine_run(1), ENGINE),
    "engine_replay": (engine_run(2), ENGINE),
    "sql_applied": (sql_applied, f"WITH {DIRTY} {CLEAN}"),
    "repair_scores": (repair_scores, None),
    "score_repair": (
        score_repair,
        f"""WITH {DIRTY}, a AS ({CLEAN}), b AS (SELECT a.*, o_totalprice, o_orderdate, o_orderpriority FROM a JOIN orders ON id = o_orderkey)
        SELECT 'price' AS "column", count(*) AS cells, count(*) FILTER (abs(abs(price) - o_totalprice) < 0.005) AS repaired FROM b
        UNION ALL SELECT 'ordered', count(*), count(*) FILTER (ordered = date_trunc('day', o_orderdate)) FROM b
        UNION ALL SELECT 'priority', count(*), count(*) FILTER (lower(priority) = lower(o_orderpriority)) FROM b""",
    ),
}


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
