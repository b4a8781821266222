"""Near-duplicate documents by SimHash and ball hashing that meets in the middle.

Two fingerprints within RADIUS bits have a common variant within half the radius of both, so every
fingerprint emits the variants of its half-radius ball, and those that meet are verified and linked.

Emitting whole balls (2081 variants of 64 bits) for every fingerprint would cost most of the job for
fingerprints that meet none.  So the variants are emitted in two steps that lose nothing.  Of two
fingerprints within 4 bits one 32-bit half differs in at most 2, so the halves' balls of radius 1
(33 variants each) meet, in a bucket.  The fingerprints of a bucket are then verified: up to BUCKET of
them by their distances, of which a forest comes out and not the pairs; more by emitting the variants of
the other half too.  Whatever meets at a whole variant is within RADIUS, so there one link from each to
the smallest will do.  Up to BUCKET rows a distance to each other one costs less than 33 to 529 variants
that are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleanloom.llm.common import aside, cut, map_batches
from cleanloom.llm.components import components, join_parts

RADIUS = 4
SHINGLE = 4
SEED = 42
LOW = 0xFFFFFFFF
#: Fingerprints of a bucket that are compared with each other, and rows of buckets that are held at once.
BUCKET, ROWS = 4096, 1 << 16
#: Fingerprints whose variants one task makes.
FINGERPRINTS = 20_000
#: Columns of our own beside those of the input.
MARK = "__mark"
OWN = ("__first_key", "__first_mark", "fp", "component", "component_id", "fingerprint")


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles as an unsigned 64-bit number; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", beside: Sequence[str] = ()) -> DataFrame:
    """(key, beside, fp long) for each row; fp has the fingerprint's 64 bits.  A null text has no words."""
    names = [key, *beside]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            fps = np.fromiter(map(fingerprint, b.column(len(names)).to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fps)], names=[*names, "fp"])

    return map_batches(df.select(*names, F.col(text).cast("string").alias(text)), run, f"{schema}, fp long")


def balls(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` of `width` bits."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of a bucket (rows of one key, side by side) that are within RADIUS bits.

    Each row is compared with the next one of its bucket, then with the one after that, and so on.  Of the
    pairs that are near only those are kept that join two parts which were apart until then.
    """
    nodes, node = np.unique(fp, return_inverse=True)
    part, found = np.arange(len(nodes)), [(fp[:0], fp[:0])]
    at, step = np.arange(len(fp)), 1
    while len(at := at[at + step < len(fp)]) and len(at := at[key[at] == key[at + step]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= RADIUS]
        near = near[join_parts(part, node[near], node[near + step])]
        found.append((fp[near], fp[near + step]))
        step += 1
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets, from their rows (key, x) in the order of keys."""
    held, n = [], 0
    for b in chain(batches, [None]):
        if b is not None:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
            n += b.num_rows
        if n == 0 or b is not None and n < ROWS:
            continue
        key, x = map(np.concatenate, zip(*held, strict=True))
        end = n if b is None else int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        held, n = [(key[end:], x[end:])], n - end
        key, x = key[:end], x[:end]
        fp = np.where(key > LOW, x << np.uint64(32) | x >> np.uint64(32), x)
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in forest(key, fp)], names=["a", "b"])


def split(met: DataFrame) -> DataFrame:
    """Links within buckets (key, x) by the variants of the other half: two that meet at a whole variant are near."""
    own, near = F.shiftrightunsigned("x", 32), F.col("key").bitwiseAND(F.lit(LOW))
    rest = F.explode(F.when(own == near, F.lit(balls(32, 2))).otherwise(F.lit(balls(32, 1))))
    other = F.col("x").bitwiseAND(F.lit(LOW)).bitwiseXOR(F.col("mask"))
    is_second = F.col("key") > LOW
    variants = met.select("key", "x", rest.alias("mask")).select(
        F.when(is_second, F.shiftleft("x", 32).bitwiseOR(own)).otherwise(F.col("x")).alias("fp"),
        F.when(is_second, F.shiftleft(other, 32).bitwiseOR(near)).otherwise(F.shiftleft(near, 32).bitwiseOR(other)).alias("variant"),
    )
    least = variants.withColumn("least", F.min("fp").over(W.partitionBy("variant")))
    out = least.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return out.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp that connect whatever is within RADIUS bits.

    What is shuffled is kept narrow: x is the fingerprint with the half in question in front; a key is
    that half's variant and, above its 32 bits, which half it is.  Where all halves of a bucket are
    equal, only the key that is that half counts.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    flip = F.when(F.col("i") % 33 == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, cast(i % 33 as int) - 1)"))
    second = F.col("i") >= 33
    x = F.when(second, F.shiftleft(low, 32).bitwiseOR(high)).otherwise(F.col("fp"))
    met = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i")).select(
        F.shiftrightunsigned(x, 32).bitwiseXOR(flip).bitwiseOR(F.when(second, F.lit(LOW + 1)).otherwise(F.lit(0))).alias("key"), x.alias("x")
    )
    own, near, bucket = F.shiftrightunsigned("x", 32), F.col("key").bitwiseAND(F.lit(LOW)), W.partitionBy("key")
    sized = met.select("key", "x", F.count("*").over(bucket).alias("n"), (F.min(own).over(bucket) != F.max(own).over(bucket)).alias("mixed"))
    met = cut(sized.where((F.col("n") > 1) & ((own == near) | F.col("mixed"))).drop("mixed"))
    small = met.where(F.col("n") <= BUCKET).select("key", "x").repartition("key").sortWithinPartitions("key", "x")
    return map_batches(small, compared, "a long, b long").unionByName(split(met.where(F.col("n") > BUCKET))).distinct()


def mark(df: DataFrame) -> Column:
    """A hash of all that a row holds; a map has no hash and does not count."""
    names = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*(F.col(f"`{c}`") for c in names), *(F.col(f"`{c}`").isNull() for c in names))


def first_row(key: str) -> Column:
    """What orders the rows of a group: their key, null last, then their mark."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(MARK).alias("mark"))


def first_rows(df: DataFrame, named: DataFrame, group: str, key: str) -> DataFrame:
    """The rows of df that come first in their group; named has key, MARK and group of each row.

    Neither a null key nor one that several rows share names a row, so the mark is compared too.  Rows
    alike in both are repeated rows, of which one stays.
    """
    firsts = named.groupBy(group).agg(F.min(first_row(key)).alias("first")).select("first.key", "first.mark").distinct()
    firsts = firsts.select(F.col("key").alias("__first_key"), F.col("mark").alias("__first_mark"))
    marked = df.withColumn(MARK, mark(df))
    same = marked[key].eqNullSafe(firsts["__first_key"]) & (marked[MARK] == firsts["__first_mark"])
    return marked.join(firsts, same, "left_semi").dropDuplicates([key, MARK]).drop(MARK)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", beside: Sequence[str] = ()) -> DataFrame:
    """(key, fingerprint, component_id) for each row: near-duplicates share a component_id, their smallest key.

    Null and empty texts have fingerprint zero and so are near-duplicates of each other.  Repeated rows
    come out each; a null key is never a component_id unless no other is there.  Of the columns besides
    key and text those named in beside come out too, with `component`, the group's smallest fingerprint.
    """
    rows = cut(fingerprints(df, key, text, beside))
    each = rows.groupBy("fp").agg(F.min(key).alias("first"))
    # a fingerprint becomes many rows, so few bytes of them must not be one task
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, rows.count() // FINGERPRINTS)
    roots = components(links(each.select("fp").repartition(parts, "fp")))
    named = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(firsts, "root").select("fp", "component_id", F.col("root").alias("component"))
    more = [*beside, "component"] if beside else []
    return rows.join(of, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df for each near-duplicate group, the first by `first_row`; all its columns stay, whatever they are called."""
    rows, back = aside(df, [n for n in (MARK, *OWN) if n not in (key, text)])
    named = groups(rows.withColumn(MARK, mark(rows)), key, text, [MARK])
    return back(first_rows(rows, named, "component", key))
