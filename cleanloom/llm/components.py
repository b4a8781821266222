"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that can be reached.

    Alternates two rewritings of the links that keep connectivity: each node points its larger
    neighbours, then its smaller ones, at the smallest node it sees.  Both work by minima that are
    taken before a shuffle; no group is gathered.  The links end as one star for each component, after
    a number of rounds that grows with the logarithm of the number of nodes.  Null nodes have no links.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, seen = cut(pairs), None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(low.unionByName(small.withColumnRenamed("m", "v")).distinct())


def join_parts(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the parts of nodes i[k] and j[k] in place; gives the k whose links are needed for that.

    part[x] is the smallest node of x's part.  Of the links between the same two parts one is taken, so that
    those taken over many calls stay near a forest.
    """
    u, v = part[i], part[j]
    apart = np.flatnonzero(u != v)
    u, v = u[apart], v[apart]
    _, first = np.unique(np.minimum(u, v) * len(part) + np.maximum(u, v), return_index=True)
    u, v = u[first], v[first]
    while (part[u] != part[v]).any():
        np.minimum.at(part, np.maximum(part[u], part[v]), np.minimum(part[u], part[v]))
        while (part != part[part]).any():
            part[:] = part[part]
    return apart[first]
