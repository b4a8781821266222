"""Value types, profiles, issues, matching, drift, document shapes."""

import json

import pytest
from pyspark.sql import functions as F

from cleanloom.operators import docschema, drift, issues, matching
from cleanloom.operators import profile as prof

TYPES = [
    ("12", "int"), ("-3", "int"), ("02134", "str"), ("-0", "str"), ("0", "int"), ("1.5", "float"), ("1e5", "float"), (".5", "float"), ("$1,200", "numeric_text"), ("42 yrs", "numeric_text"),
    ("70%", "numeric_text"), ("EUR 5", "numeric_text"), ("2026-01-31", "date:iso"), ("2026-01-31T10:00:00Z", "datetime:iso"), ("1/2/2026", "date:us"), ("1.2.2026", "date:dotted"),
    ("3 Feb 2026", "date:text_dmy"), ("Mar 5, 2026", "date:text_mdy"), ("yes", "bool"), ("T", "bool"), (" n/a ", "null_token"), ("", "null_token"), ('{"a": 1}', "json"), ("[1, 2]", "json"), ("hello", "str"), ("{", "str"), (None, "null"),
]


def test_value_types(spark):
    rows = spark.createDataFrame([(v, w) for v, w in TYPES], "v string, want string").withColumn("got", prof.value_type(F.col("v"))).collect()
    assert [(r["v"], r["got"]) for r in rows] == TYPES


def classic(spark):
    rows = []
    for i in range(40):
        rows.append((["42", "17 yrs", "N/A", " 30"][i % 4], ["2026-01-0%d" % (i % 9 + 1), "1/%d/2026" % (i % 28 + 1)][i % 2], ["Pro", "pro", "FREE ", "free"][i % 4], ["yes", "no", "1", "0"][i % 4]))
    return spark.createDataFrame(rows, "Age string, signup string, plan string, active string")


def test_issues_of_a_messy_table(spark):
    found = issues.detect(prof.profile(classic(spark)))
    kinds = {(i["column"], i["issue"]) for i in found}
    assert {("Age", "mixed_types"), ("Age", "null_tokens"), ("Age", "whitespace"), ("Age", "naming"), ("signup", "date_formats"), ("plan", "inconsistent_categories"), ("active", "bool_as_text")} <= kinds


def test_a_clean_table_has_no_issues(spark):
    df = spark.createDataFrame([("a1", 1.5, "first"), ("b2", 2.5, "second")], "id string, amount double, note string")
    assert issues.detect(prof.profile(df)) == []


def test_profile_of_a_column(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "a", " A", "N/A", None, "b" * 70]], "c string")
    p = prof.profile(df)["c"]
    assert (p["count"], p["null_ratio"], p["true_null_ratio"], p["null_tokens"]) == (6, 0.3333, 0.1667, {"N/A": 1})
    assert (p["distinct"], p["distinct_normalized"], p["distinct_stripped"]) == (4, 3, 4)
    assert p["whitespace_ratio"] == 0.1667
    assert list(p["top_values"])[0] == "a" and "b" * 59 + "…" in p["top_values"]
    assert prof.compact({"c": p})["c"]["null_tokens"] == ["N/A"]


def test_profile_of_an_empty_table(spark):
    p = prof.profile(spark.createDataFrame([], "a string, b int"))
    assert p["a"]["count"] == 0 and p["b"]["dominant_family"] == "null"


def test_typed_columns_are_left_alone(spark):
    df = spark.createDataFrame([(1, 2.0, True, [1])], "i int, d double, b boolean, l array<int>")
    assert [p["dominant_type"] for p in prof.profile(df).values()] == ["int", "float", "bool", "json"]
    assert issues.detect(prof.profile(df)) == []


def test_a_target_schema_decides(spark):
    target = {"age": "int", "joined": {"type": "date", "examples": ["2026-01-05"]}, "plan": "category", "active": "bool", "extra": "string"}
    found = issues.detect(prof.profile(classic(spark)), target)
    assert {(i["column"], i["issue"]) for i in found} >= {("extra", "missing_column"), ("Age", "mixed_types"), ("active", "bool_as_text")}
    assert next(i for i in found if i["column"] == "Age" and i["action"] == "cast_numeric")["detail"]["integer"]


def test_matching():
    source = {"customerId": ["c1"], "dob": ["1990-04-12"], "emial": ["a@b.de"], "phone_no": ["+49 30 1234"], "zzz": []}
    target = {"customer_id": ["c9"], "date_of_birth": ["1985-11-03"], "email": ["x@y.org"], "contact_number": ["+49 30 9876"]}
    found, left = matching.match(source, target)
    assert {m.source: (m.target, m.level) for m in found} == {"customerId": ("customer_id", "normalized"), "dob": ("date_of_birth", "synonym"), "emial": ("email", "embedding"), "phone_no": ("contact_number", "embedding")} or {m.source: m.target for m in found}["phone_no"] == "contact_number"
    assert left == ["zzz"]
    judged, left = matching.match({"zzz": []}, {"other": []}, judge=lambda s, d: {"zzz": "other"})
    assert (judged[0].level, left) == ("llm", [])


def test_sorted_ratio():
    assert matching.sorted_ratio("b a", "a b") == 100
    assert matching.sorted_ratio("abcd", "abxd") == 75
    assert matching.sorted_ratio("", "") == 100


def test_drift(spark):
    base = {"a": {"dominant_family": "number", "null_ratio": 0.0}, "s": {"dominant_family": "str", "null_ratio": 0.0, "distinct": 2, "top_values": {"x": 1, "y": 1}}, "gone": {"dominant_family": "str"}}
    now = {"a": {"dominant_family": "str", "null_ratio": 0.5}, "s": {"dominant_family": "str", "null_ratio": 0.1, "top_values": {"x": 1, "z": 3}}, "new": {}}
    kinds = [(d["column"], d["kind"]) for d in drift.detect(base, now)]
    assert kinds == [("new", "new_column"), ("gone", "dropped_column"), ("a", "type_change"), ("a", "null_jump"), ("s", "new_categories")]


def test_categories_that_were_less_frequent_are_not_new(spark):
    def shown(most, more=()):
        return prof.profile(spark.createDataFrame([(f"kind {c}",) for c in "abcdefghijkl"] + [(f"kind {c}",) for c in most] * 3 + [(x,) for x in more], "s string"))

    base = shown("abcdefgh")
    assert len(base["s"]["top_values"]) == 8 and len(base["s"]["categories"]) == 12
    assert drift.detect(base, shown("efghijkl")) == []
    found = drift.detect(base, shown("efghijkl", ["fresh"] * 9))
    assert [(d["kind"], d["detail"]) for d in found] == [("new_categories", {"values": ["fresh"]})]


DOCS = [{"_id": 1, "price": 2.5, "address": {"city": "x", "geo": {"lat": 1}}}, {"_id": 2, "price": "2.5", "address": "x"}, {"_id": 3, "tags": [{"n": 1}, {"n": None}, 5, {"n": "late"}], "ok": True}]


def test_document_shapes(spark):
    df = spark.createDataFrame([(json.dumps(d),) for d in DOCS] + [(None,), ("no json",)], "doc string")
    got = {(r["path"], r["type"]): (r["n"], r["presence"]) for r in docschema.histogram(df, "doc").collect()}
    assert got == {
        ("price", "float"): (1, 0.4), ("price", "str"): (1, 0.4), ("address", "object"): (1, 0.4), ("address", "str"): (1, 0.4), ("address.city", "str"): (1, 0.2), ("address.geo", "object"): (1, 0.2),
        ("address.geo.lat", "int"): (1, 0.2), ("tags", "array"): (1, 0.2), ("tags[].n", "int"): (1, 0.4), ("tags[].n", "null"): (1, 0.4), ("ok", "bool"): (1, 0.2),
    }
    assert [(i["column"], i["detail"]) for i in docschema.issues(df, "doc")] == [("address", {"shape": "object"})]


def test_flatten_and_nest(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"a": {"b": 1, "c": {"d": [1]}}, "e": 2}']))
    flat = docschema.flattened(df)
    assert flat.columns == ["a.b", "a.c.d", "e"]
    assert docschema.nested(flat).collect() == df.collect()
    mixed = spark.createDataFrame([(1, 2)], "`x` int, `x.y` int")
    assert json.loads(docschema.nested(mixed).toJSON().first()) == {"x": {"_value": 1, "y": 2}}
    assert json.loads(docschema.nested(mixed.select("`x.y`", "x")).toJSON().first()) == {"x": {"y": 2, "_value": 1}}


@pytest.mark.parametrize("n", [0, 1, 50])
def test_samples(spark, n):
    from cleanloom.sources import tables

    df = spark.range(1000)
    assert tables.sample(df, n, 1000).count() <= n
    assert tables.exact_sample(df, n).count() == n
    assert tables.sample(df, 1000, 1000).count() == 1000


def test_samples_are_of_all_parts_and_come_again(spark):
    from cleanloom.sources import tables

    df = spark.range(0, 100_000, 1, 10)
    first, again = ([r["id"] for r in tables.sample(df, 1000, 100_000).collect()] for _ in range(2))
    assert len(set(first)) == 1000 and sorted(first) == sorted(again)
    assert {i // 10_000 for i in first} == set(range(10))
