"""Vectors: exact top-k search by inner product, and near-duplicates by cosine.

A search sends a block of at most QUERY_BYTES of queries to all tasks at a time, and each streams its rows
past it.  Near-duplicates are found in tiles: rows are dealt into blocks of about BLOCK rows by a hash
of their key, and a task gets one block, or a pair of them, as matrices.  What leaves a task is
bounded: the best K for each query of the block, or counts and the links of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleanloom.llm.common import cut, map_batches, new_folder
from cleanloom.llm.components import components, join_parts

BLOCK = 4096
#: Bytes of a block of queries, and rows that are scored against it at once.
QUERY_BYTES, ROWS = 16 << 20, 8192
#: Numbers of pairs' vectors that are compared in full precision at once.
WIDE = 1 << 22


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as doubles): one row for each key, the smallest vector of those it has.

    Rows with a null key name no vector and are left out.  Vectors that are null or hold null or non-finite components are left out.
    """
    v = F.col(vector).cast("array<double>")
    fit = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & fit)
    return rows.groupBy("key").agg(F.min("v").alias("v"))


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


# -- exact top-k search ------------------------------------------------------------------------


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, a term at a time: each term's postings are scattered, times the query's weight."""
    out = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(min(queries.shape[1], rows.shape[1])):
        posted, weights = np.flatnonzero(rows[:, term]), rows[:, term]
        asking = np.flatnonzero(queries[:, term])
        if len(posted) == len(rows) and len(asking) == len(queries):
            out += np.multiply.outer(queries[:, term], weights)
        elif len(posted) and len(asking):
            out[np.ix_(asking, posted)] += np.multiply.outer(queries[asking, term], weights[posted])
    return out


def best(found: np.ndarray, keys: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the places of its k highest; of equals those with smaller keys.  keys ascend."""
    n = found.shape[1]
    if n <= k:
        return [np.arange(n)] * len(found)
    bar = np.partition(found, n - k, axis=1)[:, n - k]
    out = []
    for row, low in zip(found, bar, strict=True):
        over = np.flatnonzero(row > low)
        out.append(np.concatenate([over, np.flatnonzero(row == low)[: k - len(over)]]))
    return out


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best rows for each row whose key is divisible by `every`: query_id, rank, vec_id, score.

    The score is the inner product of the vectors' components floor(scale * x); equal scores go to the
    smaller key.  All rows but the query's own are candidates; with fewer than k of them all are returned.
    A key that is repeated counts once, with its smallest vector.  Vectors that are null or hold null or
    non-finite components take no part; of vectors that differ in length the missing terms are zero.
    """
    rows = cut(usable(df, key, vector).select("key", F.transform("v", lambda x: F.floor(x * scale)).alias("w")))
    asking = F.col("key") % every == 0
    n, asked, width = rows.agg(F.count("*"), F.count_if(asking), F.coalesce(F.max(F.size("w")), F.lit(0))).first()
    blocks = max(1, -(-asked * max(1, width) * 8 // QUERY_BYTES))
    spark = df.sparkSession
    parts = n // BLOCK + 1
    if parts < 2 * spark.sparkContext.defaultParallelism:  # few rows: a partition must not be a whole task's share of bytes
        rows = rows.repartition(parts)
    path = new_folder(spark, "top-k") if blocks > 1 else ""
    for block in range(blocks):
        queries = rows.where(asking & (F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)).toArrow()
        keys = queries["key"].to_numpy()
        sent = spark.sparkContext.broadcast((keys, matrix(whole(queries["w"]), width)))
        near = map_batches(rows, searched(sent, width, k), "query_id long, vec_id long, score long")
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        out = ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if blocks == 1:
            return out
        out.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.parquet(path)


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers; missing terms are zero."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def searched(sent, width: int, k: int):
    """The k best rows of a partition for each query that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_keys, queries = sent.value
        held = tuple(np.empty(0, np.int64) for _ in range(3))  # place of the query, key, score
        fresh: list[pa.RecordBatch] = []

        def scored() -> None:
            nonlocal held
            table = pa.Table.from_batches(fresh)
            fresh.clear()
            order = np.argsort(table["key"].to_numpy(), kind="stable")
            keys, rows = table["key"].to_numpy()[order], matrix(whole(table["w"]), width)[order]
            found = [held]
            for at in range(0, len(queries), 128):
                s = scores(queries[at : at + 128], rows)
                for one, places in enumerate(best(s, keys, k + 1), at):  # one may be the query's own
                    places = places[keys[places] != query_keys[one]]
                    found.append((np.full(len(places), one), keys[places], s[one - at][places]))
            query, key, score = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((key, -score, query))
            query, key, score = query[order], key[order], score[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            held = query[rank < k], key[rank < k], score[rank < k]

        for b in batches:
            fresh.append(b)
            if sum(x.num_rows for x in fresh) >= ROWS:
                scored()
        if fresh:
            scored()
        yield pa.RecordBatch.from_arrays([pa.array(query_keys[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    return run


# -- near-duplicates by cosine -----------------------------------------------------------------


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error): unit = scale * codes + e with |e| <= error, for each row."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - scale[:, None] * codes, axis=1)
    return codes.astype(np.int8), scale, error * (1 + 1e-9) + 1e-12


def linked(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with cosine(a[i], b[j]) >= least, some rows of a at a time.

    With x = s p + d, y = t q + e and |x| = |y| = 1: |x.y - s t p.q| <= |d| |y| + |s p| |e| <= |d| + (1 + |d|) |e|.
    Products of codes are sums of at most 2**24 / 127**2 terms that float32 holds exactly; wider vectors
    are summed in parts.  Only pairs that the bound leaves open or above are computed in double precision.
    """
    ua, ub = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    (ca, sa, ea), (cb, sb, eb) = quantised(ua), quantised(ub)
    some = max(1, WIDE // max(1, a.shape[1]))
    for at in range(0, len(a), 256):
        c, s, e = ca[at : at + 256], sa[at : at + 256], ea[at : at + 256]
        dots = sum((c[:, k : k + 1024].astype(np.float32) @ cb[:, k : k + 1024].astype(np.float32).T).astype(np.float64 if c.shape[1] > 1024 else np.float32) for k in range(0, c.shape[1], 1024))
        # least <= x.y  implies  dots >= (least - bound) / (s t), with the largest bound and scale of the tile rounded outwards
        slack = e + (1 + e) * eb.max()
        low = (least - slack) / (s * sb.max()) if least > slack.max() else np.full(len(c), -np.inf)
        i, j = np.nonzero(dots >= (low * (1 - 1e-6))[:, None].astype(np.float32))
        value = dots[i, j].astype(np.float64) * s[i] * sb[j]
        open_ = value + e[i] + (1 + e[i]) * eb[j] >= least - 1e-6
        i, j = i[open_] + at, j[open_]
        for k in range(0, len(i), some):
            x, y = a[i[k : k + some]], b[j[k : k + some]]
            cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            sure = cosine >= least
            yield i[k : k + some][sure], j[k : k + some][sure]


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row for each key: key, n_links, component_id, kept; links are pairs with cosine >= least.

    Every pair of different vectors is covered, by tiles of two blocks.  Equal vectors become one class
    first, so that a group of copies costs as one row.  Vectors that are null, zero, or hold null or
    non-finite components link with nothing and are their own component; so do, with each other,
    vectors of different lengths.  A key that is repeated is one row, with its smallest usable vector;
    rows with a null key are left out.
    """
    every = df.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    rows = cut(usable(df, key, vector).where(F.exists("v", lambda x: x != 0)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 equals 0.0
    classes = cut(rows.groupBy("v").agg(F.min("key").alias("first"), F.count("*").alias("copies")).withColumn("width", F.size("v")))
    n = classes.count()
    blocks = max(1, -(-n // BLOCK))
    block = classes.withColumn("b", F.pmod(F.xxhash64("first"), F.lit(blocks)).cast("int"))
    tiles = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "width", (F.col("b") > F.col("o")).alias("right"), "first", "copies", "v"
    )

    def tile(table: pa.Table) -> pa.Table:
        first, copies, right = (table[c].to_numpy() for c in ("first", "copies", "right"))
        v = whole(table["v"]).flatten().to_numpy(zero_copy_only=False).reshape(len(first), -1)
        one = table["b1"][0].as_py() == table["b2"][0].as_py()
        left = np.flatnonzero(~right)
        other = left if one else np.flatnonzero(right)
        links, part, tree = np.zeros(len(first), np.int64), np.arange(len(first)), []
        for i, j in linked(v[left], v[other], least):
            i, j = left[i], other[j]
            if one:
                i, j = i[i < j], j[i < j]
            links += (np.bincount(i, copies[j], len(first)) + np.bincount(j, copies[i], len(first))).astype(np.int64)
            needed = join_parts(part, i, j)
            tree.append(np.stack([i[needed], j[needed]], axis=1))
        some = np.flatnonzero(links)
        tree = np.concatenate([np.empty((0, 2), np.int64), *tree])
        nodes = np.concatenate([first[some], first[tree[:, 0]]])
        others = np.concatenate([first[some], first[tree[:, 1]]])
        n_links = np.concatenate([links[some], np.zeros(len(tree), np.int64)])
        return pa.table([pa.array(nodes), pa.array(others), pa.array(n_links)], names=["a", "b", "n"])

    found = cut(tiles.groupBy("b1", "b2", "width").applyInArrow(tile, "a long, b long, n long"))
    roots = components(found.where("a <> b"))
    linked_ = found.groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    of = (
        classes.join(linked_, "first", "left").join(roots, F.col("first") == roots["node"], "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "first").alias("component_id"))
    )
    named = rows.join(of, "v").select("key", "n_links", "component_id")
    out = every.join(named, "key", "left").select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
