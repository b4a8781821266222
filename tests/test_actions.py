"""Actions, bound parameters and the two compilers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cleanloom.functions import text as t
from cleanloom.operators import actions
from cleanloom.plans import compiler
from cleanloom.plans.model import Plan, Step, Unsupported


def column(spark, values, c):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", c.alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def V():
    return F.col("v")


def test_standardize_nulls_keeps_other_text_as_it_is(spark):
    got = column(spark, [" N/A ", "", "  ", None, " x ", "-999", "Gone"], actions.standardize_nulls(V(), ("GONE ",)))
    assert got == [None, None, None, None, " x ", None, None]


def test_strip(spark):
    assert column(spark, [" a b\t", "\n\x0b", "", None], actions.strip(V())) == ["a b", None, None, None]


@pytest.mark.parametrize(
    ("strategy", "values", "want"),
    [
        (0, ["1", " 2.5 ", "1e3", ".5", "12.", "inf", "12f", "1d", "$5", "1,000", "1_000", "0x10", "True", "nan", None], [1, 2.5, 1000, 0.5, 12, float("inf"), None, None, None, None, None, None, None, None, None]),
        (1, ["$1,200.50", "42 yrs", "(5)", "abc", "-$5", "70kg", "€ -3", None], [1200.5, 42, -5, None, 5, 70, -3, None]),
    ],
)
def test_cast_numeric(spark, strategy, values, want):
    assert column(spark, values, actions.cast_numeric(V(), False, strategy)) == want


def test_dates(spark):
    values = ["2026-02-03", "2026-02-03T08:00:00+05:30", "2026-02-03 08:00", "2/3/2026", "3.2.2026", "3 Feb 2026", "3 february, 2026", "FEB 3, 2026", "March 5 2026", "02/30/2026", "Sept 1, 2026", "soon", None]
    day, march = dt.datetime(2026, 2, 3), dt.datetime(2026, 3, 5)
    want = [day, dt.datetime(2026, 2, 3, 2, 30), dt.datetime(2026, 2, 3, 8), day, day, day, day, day, march, None, None, None, None]
    assert column(spark, values, actions.parse_dates(V(), 1)) == want
    assert column(spark, ["13/04/2026", "01/05/2026"], actions.parse_dates(V(), 2, True)) == [dt.datetime(2026, 4, 13), dt.datetime(2026, 5, 1)]
    assert column(spark, ["13/04/2026"], actions.parse_dates(V(), 1, True)) == [None]


def test_to_bool(spark):
    assert column(spark, [" YES", "t", "1", "n", "False", "0", "perhaps", None], actions.to_bool(V())) == [True, True, True, False, False, False, None, None]


def test_canonicalize(spark):
    values = ["Red ", "red", "Red", "BLUE", "green", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    mapping = actions.canonical_mapping(df, V())
    assert mapping == {"red": "Red", "blue": "BLUE", "green": "green"}
    assert column(spark, ["RED", " blue", "other ", None], actions.canonicalize(V(), mapping)) == ["Red", "BLUE", "other", None]
    with pytest.raises(ValueError):
        actions.canonical_mapping(df, V(), most=2)


def test_spellings_break_ties_by_text(spark):
    df = spark.createDataFrame([("b B",), ("B b",)], "v string")
    assert actions.canonical_mapping(df, V()) == {"b b": "B b"}


@pytest.mark.parametrize(("values", "want"), [(["13/04/2026", "01/05/2026"], True), (["13/04/2026", "01/15/2026"], False), (["01/05/2026"], False), (["2026-01-15"], False), ([], False)])
def test_dayfirst_evidence(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.agg(actions.dayfirst_evidence(V())).first()[0] is want


@pytest.mark.parametrize(("raw", "want"), [("customerId", "customer_id"), ("Customer-ID", "customer_id"), (" customer id ", "customer_id"), ("HTTPServer", "http_server"), ("temp2C", "temp2_c"), ("LTV_usd", "ltv_usd"), ("??", "col"), ("a__b", "a_b"), ("already_snake", "already_snake")])
def test_names(raw, want):
    assert t.snake(raw) == want


PLAN = [
    Step("Age", "standardize_nulls"),
    Step("Age", "cast_numeric", {"integer": True}, 1),
    Step("Age", "rename", {"to": "age"}),
    Step("price", "cast_numeric", {}, 1),
    Step("signup.date", "parse_dates", {"dayfirst": True}, 2),
    Step("plan", "strip"),
    Step("plan", "canonicalize"),
    Step("active", "to_bool"),
]
ROWS = [("1", "42 yrs", "$1,200.50", "13/04/2026", " Pro", "yes"), ("2", "N/A", "(5)", "2026-04-01", "pro ", "f"), ("3", None, "it's", "Mar 5, 2026", "PRO", "?"), ("4", "7", "", None, "pro", "")]
SCHEMA = "id string, Age string, price string, `signup.date` string, plan string, active string"


def test_a_plan_and_its_sql_agree(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = compiler.bind(df, Plan(PLAN))
    out = compiler.compiled(df, plan)
    assert out.columns == ["id", "age", "price", "signup.date", "plan", "active"]
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "bigint", "double", "timestamp_ntz", "string", "boolean"]
    df.createOrReplaceTempView("raw_rows")
    _, create = compiler.to_sql(plan, df.columns, "raw_rows", "clean_rows")
    other = spark.sql(create.split(" AS ", 1)[1])
    assert other.schema.simpleString() == out.schema.simpleString()
    assert other.orderBy("id").collect() == out.orderBy("id").collect()
    assert out.orderBy("id").collect()[0] == ("1", 42, 1200.5, dt.datetime(2026, 4, 13), "pro", True)


def test_both_compilers_take_the_same_numbers(spark):
    texts = ["inf", " -Infinity", "+INF", "infinite", "nan", "1e5", ".5", "12.", "12f", "1_000", "-inf ", "--inf", ""]
    df = spark.createDataFrame([(x,) for x in texts], "n string")
    plan = Plan([Step("n", "cast_numeric", {"integer": False}, 0)])
    df.createOrReplaceTempView("raw_numbers")
    _, create = compiler.to_sql(plan, df.columns, "raw_numbers", "clean_numbers")
    got = [r["n"] for r in spark.sql(create.split(" AS ", 1)[1]).collect()]
    assert got == [r["n"] for r in compiler.compiled(df, plan).collect()]
    inf = float("inf")
    assert got == [inf, -inf, inf, None, None, 1e5, 0.5, 12.0, None, None, -inf, None, None]


def test_binding_fixes_what_depends_on_the_table(spark):
    df = spark.createDataFrame([("1.5", "3 Feb 2026"), ("2", "2026-01-01")], "n string, d string")
    plan = compiler.bind(df, Plan([Step("n", "cast_numeric", {"integer": True}), Step("d", "parse_dates")]))
    assert [s.params for s in plan.steps] == [{"integer": False}, {"form": "d MMM yyyy"}]
    assert [r["d"] for r in compiler.compiled(df, plan).collect()] == [dt.datetime(2026, 2, 3), None]


def test_order_of_steps():
    plan = Plan([Step("b", "rename", {"to": "x"}), Step("b", "cast_numeric"), Step("a", "strip"), Step("b", "standardize_nulls")])
    assert [(s.column, s.action) for s in plan.ordered()] == [("b", "standardize_nulls"), ("a", "strip"), ("b", "cast_numeric"), ("b", "rename")]


def test_one_projection_for_a_step_of_each_column(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = compiler.bind(df, Plan(PLAN))
    text = compiler.compiled(df, plan)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text


def test_what_cannot_be_compiled():
    with pytest.raises(Unsupported):
        compiler.to_sql(Plan([Step("a", "parse_dates")]), ["a"], "s", "clean_s")
    with pytest.raises(Unsupported):
        compiler.to_pipeline(Plan([Step("a", "custom", {"expression": "1"})]), "clean_s")
    with pytest.raises(ValueError):
        Step("a", "explode")
    with pytest.raises(ValueError):
        Plan([], 1.5)


def test_pipeline():
    stages = compiler.to_pipeline(Plan([Step("a", "strip"), Step("a", "rename", {"to": "b"})]), "clean_s")
    assert [next(iter(s)) for s in stages] == ["$set", "$set", "$unset", "$merge"]


def test_pandas_programs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "n int, s string")
    code = "def transform(df):\n    df['s'] = df['s'].str.len() + df['n']\n    return df"
    out = compiler.compiled(df, Plan([Step("s", "custom", {"program": code, "types": {"s": "bigint"}}), Step("n", "rename", {"to": "m"})]))
    assert [tuple(r) for r in out.collect()] == [(1, 2), (2, 4)]
    with pytest.raises(PermissionError):
        compiler.compiled(df, Plan([Step("s", "custom", {"program": "import os"})]))
    with pytest.raises(Exception, match="the program made 1 rows of"):
        compiler.compiled(df.coalesce(1), Plan([Step("s", "custom", {"program": "def transform(df):\n    return df.head(1)"})])).collect()
