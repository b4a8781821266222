"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that go to a Python worker at once, a longer row alone: whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster has no folder that we could choose.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder: neither lost executors nor later plans compute them again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in bounded batches.  The session's limits hold for plans that run later, so they are lowered where they are wider."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not now.isdigit() or int(now) not in range(1, most + 1):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(run, schema)


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names called otherwise, and what gives them their names back."""
    own = {c.lower() for c in df.columns}
    moved = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_"
            while new.lower() in own:
                new += "_"
            moved[c] = new
            own.add(new.lower())
    return df.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({v: k for k, v in moved.items()})
