"""The shapes of JSON documents: which paths they have, of which types, and where those conflict.

Documents are parsed as variants, and their levels are taken apart by native generators, one round
for each level of nesting.  A path's presence is the share of its occurrences in the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import text as t

#: Elements of an array that are looked into, and levels of nesting.
PEEK, DEPTH = 3, 64


def kind_of(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v) | s.isin("VOID"), F.lit("null"))
        .when(s.startswith("OBJECT"), F.lit("object"))
        .when(s.startswith("ARRAY"), F.lit("array"))
        .when(s == "STRING", F.lit("str"))
        .when(s == "BOOLEAN", F.lit("bool"))
        .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
        .otherwise(F.lit("float"))
    )


def paths(docs: DataFrame, json: str, depth: int = DEPTH) -> DataFrame:
    """(path, type) for each field of each document, fields of the first PEEK elements of arrays too.

    Texts that are no JSON objects have no paths.  A level is kept while the next one is made from
    it, and the first empty level is the last; with `depth` given the levels below are not looked into.
    """
    level = docs.select(F.lit("").alias("path"), F.try_parse_json(t.column(json).cast("string")).alias("v")).where("v is not null")
    level = level.where(F.schema_of_variant("v").startswith("OBJECT"))
    out = None
    for _ in range(depth):
        fields = (
            level.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
            .select(F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.col("value").alias("v"))
            .withColumn("type", kind_of(F.col("v")))
            .persist()
        )
        out = fields.select("path", "type") if out is None else out.unionByName(fields.select("path", "type"))
        items = F.slice(F.try_variant_get("v", F.lit("$"), "array<variant>"), 1, PEEK)
        inside = F.when(F.col("type") == "object", F.array("v")).when(F.col("type") == "array", items)
        name = F.when(F.col("type") == "array", F.concat("path", F.lit("[]"))).otherwise(F.col("path"))
        level = fields.where("type in ('object', 'array')").select(name.alias("path"), F.explode(inside).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
        if level.isEmpty():
            break
    return out


def histogram(docs: DataFrame, json: str, depth: int = DEPTH) -> DataFrame:
    """(path, type, n, presence); presence is of the path, in all its types."""
    total = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    n = paths(docs, json, depth).where("path <> '_id'").groupBy("path", "type").agg(F.count("*").alias("n"))
    of = n.groupBy("path").agg(F.sum("n").alias("all"))
    shares = of.join(F.broadcast(total)).select("path", F.round(F.col("all") / F.col("total"), 4).alias("presence"))
    return n.join(shares, "path")


def conflicts(hist: DataFrame) -> DataFrame:
    """(path, shape): object or array, where the path has another type too; nulls are no type."""
    kinds = hist.where("type <> 'null'").groupBy("path").agg(F.collect_set("type").alias("types"))
    return kinds.where(F.size("types") > 1).select("path", F.explode(F.array("types")).alias("types")).select("path", F.explode("types").alias("shape")).where("shape in ('object', 'array')")


def issues(docs: DataFrame, json: str) -> list[dict]:
    return [{"column": r["path"], "issue": "mixed_shapes", "action": "none", "severity": "warning", "detail": {"shape": r["shape"]}} for r in conflicts(histogram(docs, json)).orderBy("path", "shape").collect()]


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs to columns named a.b; arrays and maps stay whole."""

    def leaves(kind: T.StructType, at: Column | None, prefix: str) -> list[Column]:
        out = []
        for f in kind.fields:
            c, name = (t.column(f.name) if at is None else at.getField(f.name)), f"{prefix}{f.name}"
            out += leaves(f.dataType, c, f"{name}.") if isinstance(f.dataType, T.StructType) and f.dataType.fields else [c.alias(name)]
        return out

    return df.select(*leaves(df.schema, None, ""))


def nested(df: DataFrame) -> DataFrame:
    """Columns named a.b to structs; a value that stands where a struct must be becomes its field _value."""
    tree: dict = {}
    for c in df.columns:
        node, parts = tree, ["_id"] if c == "_id" else c.split(".")
        for p in parts[:-1]:
            if not isinstance(node.get(p), dict):
                node[p] = {"_value": node[p]} if p in node else {}
            node = node[p]
        if isinstance(node.get(parts[-1]), dict):
            node[parts[-1]]["_value"] = c
        else:
            node[parts[-1]] = c

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else t.column(v)).alias(k) for k, v in node.items()]

    return df.select(*build(tree))
