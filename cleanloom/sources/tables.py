"""Sources to DataFrames, samples of them, and cleaned tables to new places."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import text as t
from cleanloom.operators import docschema
from cleanloom.operators.profile import rendered
from cleanloom.sources.spec import Source, redacted

SEED = 7
#: Tasks of a JDBC read.
SPLITS = 64


@dataclass
class Ingested:
    sample: DataFrame
    row_count: int
    declared: dict[str, str]
    documents: DataFrame | None = None


def _check_name(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"there is no table {name!r}")


def _runs_on(spark: SparkSession, path: str) -> bool:
    """Whether some record of a delimited file goes over several lines: a line then has an odd number of quotes.

    Only such files must be read whole by one task each; this look at the lines is itself split.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _split(spark: SparkSession, source: Source) -> dict[str, str]:
    """What splits a JDBC read over tasks by ranges of a column; null keys go with the first range."""
    if not source.split_by:
        return {}
    column = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source.uri).quoteIdentifier(source.split_by)
    bounds = f"(SELECT min({column}) AS a, max({column}) AS b FROM {source.name}) bounds"
    a, b = spark.read.format("jdbc").option("url", source.uri).option("dbtable", bounds).load().first()
    if a is None:
        return {}
    return {"partitionColumn": source.split_by, "lowerBound": str(int(a)), "upperBound": str(int(b) + 1), "numPartitions": str(min(SPLITS, int(b) - int(a) + 1))}


def load(spark: SparkSession, source: Source) -> DataFrame:
    """The whole source, lazily, without inference: raw files are text, documents become columns a.b."""
    if source.kind == "csv":
        return spark.read.option("header", True).option("escape", '"').option("multiLine", _runs_on(spark, source.uri)).option("mode", "PERMISSIVE").csv(source.uri)
    if source.kind in ("parquet", "orc"):
        return spark.read.format(source.kind).load(source.uri)
    if source.kind == "json":
        return docschema.flattened(spark.read.json(source.uri))
    if source.kind == "table":
        _check_name(spark, source.name)
        return spark.table(source.name)
    if source.kind == "sql":
        return spark.read.format("jdbc").options(**_split(spark, source)).option("url", source.uri).option("dbtable", source.name).load()
    if source.kind == "mongo":
        return docschema.flattened(spark.read.format("mongodb").option("connection.uri", source.uri).option("database", source.database).option("collection", source.name).load())
    raise ValueError(f"no reader for {source.kind!r}")


def documents(spark: SparkSession, source: Source) -> DataFrame | None:
    """A document source's raw JSON, column doc; None for tables."""
    return spark.read.text(source.uri).select(F.col("value").alias("doc")) if source.kind == "json" else None


def transport(df: DataFrame) -> DataFrame:
    """Nested values as JSON text; typed columns stay typed."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(*((rendered(df, f.name) if isinstance(f.dataType, nested) else t.column(f.name)).alias(f.name) for f in df.schema))


def sample(df: DataFrame, n: int, rows: int, seed: int = SEED) -> DataFrame:
    """n of df's rows at random, all of them if there are no more.

    Rows pass a coin that lets twice n through, in percent to two digits, and n of those are taken in a random
    order.  Both go by a row's part and place, so a table that is read again in the same parts gives the same
    rows, from all parts, whichever task ends first.
    """
    if rows <= n:
        return df
    percent = min(100.0, -(-n * 200 * 100 // rows) / 100)
    # the coin draws from the streams of seed + part, so the order takes others
    return exact_sample(df.sample(fraction=percent / 100, seed=seed), n, ~seed)


def exact_sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows in a random order, by a distributed top-n."""
    return df.orderBy(F.rand(seed)).limit(n)


def ingest(spark: SparkSession, source: Source, n: int = 5000) -> Ingested:
    df = transport(load(spark, source))
    rows = df.count()
    return Ingested(sample(df, n, rows), rows, {f.name: f.dataType.simpleString() for f in df.schema}, documents(spark, source))


def output_name(source: Source, prefix: str = "clean_") -> str:
    return f"{prefix}{source.name}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the folder that driver and executors share; a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cleanloom-")
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame, source: Source) -> None:
    """Writes df as the whole of a source, so that `load` gives its rows: text keeps its white space."""
    if source.kind == "table":
        df.write.mode("overwrite").saveAsTable(source.name)
    elif source.kind == "sql":
        df.write.format("jdbc").mode("overwrite").option("url", source.uri).option("dbtable", source.name).save()
    elif source.kind == "mongo":
        docschema.nested(df).write.format("mongodb").mode("overwrite").option("connection.uri", source.uri).option("database", source.database).option("collection", source.name).save()
    elif source.kind == "csv":
        as_is = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.mode("overwrite").options(**as_is).csv(source.uri)
    else:
        (docschema.nested(df) if source.kind == "json" else df).write.mode("overwrite").format(source.kind).save(source.uri)


def write(df: DataFrame, source: Source, target: str, prefix: str = "clean_") -> str:
    """Writes a new table beside the source, never in place; gives where it is, without passwords."""
    if not target.startswith(prefix):
        raise PermissionError(f"outputs start with {prefix!r}, {target!r} does not")
    uri = source.staging_uri or source.uri
    if source.kind not in ("table", "sql", "mongo"):
        uri = os.path.join(os.path.dirname(source.uri.rstrip("/")), f"{target}.{source.kind}")
    store(df, replace(source, name=target, uri=uri))
    return {"table": target, "sql": f"{redacted(uri)}::{target}", "mongo": f"{source.database}.{target}"}.get(source.kind, uri)


def run_sql(spark: SparkSession, statements: list[str]) -> None:
    for s in statements:
        spark.sql(s)
