"""Connected components of an edge table, without collecting anything.

Alternating large-star and small-star rounds: every node's neighbours move to the
least neighbour, until the edges form stars.  Each round is a pair of aggregations
and joins whose result is cut by a reliable checkpoint, so neither lineage nor a
lost executor matters.

The driver plans some ten shuffles a round, and their threads and plans are what fills its
memory.  Where a caller allows it, a table of few edges is joined up by one task instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ready, trim


#: Keys of more rows than this, and than the share below of all, are joined by broadcast.
HOT, SHARE = 256, 50_000
#: Distinct edges that one task may join up (16 bytes each).
ONE_TASK = 1 << 20


def spread_join(rows: DataFrame, low: DataFrame, on: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` with what ``low`` has for their key; ``low`` has each key once, and ``n`` of its rows.

    Rows of a key stay where they are if they are many: such keys are fewer than twice
    ``SHARE``, as there are but ``total`` rows, and go to all executors.
    """
    bound = max(HOT, total // SHARE)
    hot = F.broadcast(low.filter(F.col(n) > bound).drop(n))
    cold = low.filter(F.col(n) <= bound).drop(n)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on))


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node that each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(x):
        # the larger of two roots moves below the lesser, then all nodes to their roots
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
        x, y = low[x], low[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[low]


def _by_one_task(e: DataFrame) -> DataFrame:
    """Components of the edges (u, v), gathered in one task."""

    def run(batches):
        parts = [[np.asarray(batch.column(c)) for c in ("u", "v")] for batch in batches]
        if parts:
            node, low = joined_up(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], names=["node", "component"])
        trim()

    return checkpoint(ready(e).coalesce(1).mapInArrow(run, "node long, component long"))


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 0) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Nulls and loops are left out; repeated edges do no harm; an empty table gives an
    empty one.  At most ``one_task`` distinct edges of longs are joined up by one task, more
    of them in rounds: the result is the same.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = checkpoint(e.filter("u is not null and v is not null and u <> v").distinct())
    n, seen = e.count(), None
    if n <= one_task:
        return _by_one_task(e)
    while n:
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = checkpoint(spread_join(both, low, "u", n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = spread_join(large, low, "u", n)
        small = pairs.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(pairs.select("u", F.col("m").alias("v")))
        e = checkpoint(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == seen and now[0] == now[2]:
            break
        n, seen = max(n, now[0]), now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct().toDF("node", "component"))
