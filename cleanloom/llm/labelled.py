"""What the two classifiers share: the split by key, and a bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str) -> Column:
    """Whether a row is kept for testing: crc32 of its key as text is divisible by FOLDS.  False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(place long, text, label int) of at most `rows` labelled rows that are not held out.

    They are those whose hashed key is least, so the choice spreads over the corpus and does not depend
    on how it is partitioned.  A key with several labels has its greatest; null labels are none.  The
    chosen keys, at most `rows` of them, are all that is broadcast.  Rows that repeat a key count once, with
    the greatest text.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).where("k is not null and label is not null")
    known = known.where(~held_out("k")).groupBy("k").agg(F.max("label").alias("label"))
    some = known.withColumn("place", F.xxhash64(F.lit(label), F.col("k").cast("string"))).orderBy("place", "k").limit(rows)
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "k")
    one = found.groupBy("place").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label")).alias("one"))
    return one.select("place", "one.text", "one.label")
