"""Exact top-k inner products with KD-trees, one per shard of the vectors.

A shard's tree is built by median splits along the widest side of each node; every
node keeps its tight bounding box.  The best score a box can hold for a query is the
sum over components of the larger of ``q * low`` and ``q * high``.  A query takes the
leaves in the order of that bound and stops when it falls below its kth score; whole
subtrees are cut the same way.  The kth score of a first shard is propagated to the
search of all others.

Shards and query blocks never meet as a whole.  The boxes of the shards go to the query
blocks, and a shard is asked only those queries whose bound its box can reach.  A task
has one shard and some blocks of queries, so its memory is bounded by these sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ready, trim, whole_number

#: Vectors of a shard, of a leaf, queries of a block, and blocks that ask a shard at once.
SHARD, LEAF, BLOCK, ASKING = 8192, 128, 512, 64
#: Boxes that a query block looks at together.
BOXES = 4096
#: Stands for no score; its negative is a 64-bit integer too.
_NOTHING = np.int64(-(2**63 - 1))


class Tree:
    """Median splits over ``vectors``; nodes level by level, leaves as index ranges."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        index = np.arange(len(ids))
        spans = [(0, len(ids))]
        self.levels = []  # (low, high, first child or -1) of the nodes of a level
        while spans:
            low = np.stack([self.vectors[index[i:j]].min(axis=0) for i, j in spans])
            high = np.stack([self.vectors[index[i:j]].max(axis=0) for i, j in spans])
            children, below = [], []
            for (i, j), a, b in zip(spans, low, high, strict=True):
                if j - i <= leaf or not len(a) or (a == b).all():
                    children.append(-1)
                    continue
                axis = int(np.argmax(b - a))
                mid = (i + j) // 2
                index[i:j] = index[i:j][np.argpartition(self.vectors[index[i:j], axis], mid - i)]
                children.append(len(below))
                below += [(i, mid), (mid, j)]
            self.levels.append((low, high, np.array(children), np.array(spans)))
            spans = below
        self.ids, self.vectors = self.ids[index], self.vectors[index]


def exact_kind(q: np.ndarray, v: np.ndarray) -> type:
    """A type in which all inner products are exact: floats, 64-bit integers, or Python's."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return np.float64
    return np.int64 if top < 2.0**62 else object


def reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The best score that each box (a row) can hold for each query."""
    kind = exact_kind(q, np.concatenate([low, high]))
    q, low, high = q.astype(kind), low.astype(kind), high.astype(kind)
    zero = kind(0) if kind is not object else 0
    return np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T


def _saturated(score: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what is beyond them becomes their end."""
    if score.dtype != object:
        return score.astype(np.int64)
    return np.array([max(-(2**63 - 1), min(2**63 - 1, int(x))) for x in score.ravel()], np.int64).reshape(score.shape)


def search(tree: Tree, qid: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's best ``k`` in the tree.

    Scores below ``bound`` (the kth score known so far) need not be found; the query's
    own id is passed over; ties go to smaller ids.
    """
    kind = exact_kind(q, tree.vectors)
    if kind is object:
        return _search_all(tree, qid, q, k)
    q, v = q.astype(kind), tree.vectors.astype(kind)
    n = len(q)
    best = np.full((n, k), _NOTHING, np.int64)
    names = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    kth = bound.copy()
    # bounds of the nodes of each level, for the queries that still need them
    least = -np.inf if kind is np.float64 else _NOTHING
    leaves, bounds = [], []
    alive = np.ones((n, 1), bool)
    for low, high, child, spans in tree.levels:
        most = np.where(alive, reach(q, low, high), least)
        alive &= most >= kth[:, None]
        ends = child < 0
        leaves.append(spans[ends])
        bounds.append(np.where(alive[:, ends], most[:, ends], least))
        alive = np.repeat(alive[:, ~ends], 2, axis=1)
    spans, most = np.concatenate(leaves), np.concatenate(bounds, axis=1)
    turn = np.argsort(-most, axis=1, kind="stable")
    going = np.arange(n)
    for step in range(len(spans)):
        leaf = turn[going, step]
        ok = (most[going, leaf] >= kth[going]) & (most[going, leaf] > least)
        going, leaf = going[ok], leaf[ok]
        if not len(going):
            break
        by = np.argsort(leaf, kind="stable")
        cut = np.flatnonzero(np.r_[True, leaf[by][1:] != leaf[by][:-1], True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            who = going[by[a:b]]
            i, j = spans[leaf[by[a]]]
            got = (q[who] @ v[i:j].T).astype(np.int64)
            got[qid[who][:, None] == tree.ids[None, i:j]] = _NOTHING
            hit = got.max(axis=1) >= kth[who]
            if not hit.any():
                continue
            who, got = who[hit], got[hit]
            s = np.concatenate([best[who], got], axis=1)
            m = np.concatenate([names[who], np.broadcast_to(tree.ids[i:j], got.shape)], axis=1)
            order = np.lexsort((m, -s), axis=1)[:, :k]
            best[who] = np.take_along_axis(s, order, 1)
            names[who] = np.take_along_axis(m, order, 1)
            kth[who] = np.maximum(kth[who], best[who][:, -1])
    row, col = np.nonzero(best > _NOTHING)
    return row, names[row, col], best[row, col]


def _search_all(tree: Tree, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for components so large that products need Python's integers: no tree."""
    v = _exact(tree.vectors)
    rows, names, scores = [], [], []
    for i, x in enumerate(_exact(q)):
        got = _saturated(v @ x)
        other = np.flatnonzero(tree.ids != qid[i])
        pick = other[np.lexsort((tree.ids[other], -got[other]))[:k]]
        rows += [i] * len(pick)
        names += tree.ids[pick].tolist()
        scores += got[pick].tolist()
    return np.array(rows, np.int64), np.array(names, np.int64), np.array(scores, np.int64)


def _exact(a: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's integers."""
    return np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape)


def _dump(a: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them: integers, or floats beyond 64 bits."""
    top = float(np.abs(a.astype(float)).max(initial=0))
    kind = next(c for c, most in (("b", 2.0**7 - 1), ("h", 2.0**15 - 1), ("i", 2.0**31 - 1), ("q", 2.0**62), ("d", np.inf)) if top <= most)
    return kind.encode() + np.ascontiguousarray(a, f"<{np.dtype(kind).str[1:]}").tobytes()


def _load(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"<{np.dtype(chr(blob[0])).str[1:]}", -1, 1).reshape(-1, width)


def _pack(table: pa.Table, rest: list[str]) -> pa.Table:
    """One row of packed ids and vectors, in the order of ids and components."""
    v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(table), -1)
    ids = np.asarray(table.column("id")).astype(np.int64)
    order = np.lexsort((*v.T[::-1], ids))
    ids, v = ids[order], v[order]
    box = _dump(np.stack([v.min(axis=0), v.max(axis=0)]))
    return pa.table([*(table.column(c).slice(0, 1) for c in rest), *(pa.array([x], pa.binary()) for x in (ids.astype("<i8").tobytes(), _dump(v), box))], names=[*rest, "ids", "vectors", "box"])


def scaled(df: DataFrame, vec_id: str, vector: str, factor: int) -> DataFrame:
    """(id, v, dim): components floor(factor * x) as doubles; unusable vectors are left out."""
    # a floor beyond 64 bits stays a double, which is whole there already
    def whole(e):
        x = F.lit(float(factor)) * e.cast("double")
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)

    fine = F.forall(df[vector], lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double") * factor) < F.lit(float("inf"))))
    return df.filter(df[vec_id].isNotNull() & df[vector].isNotNull() & fine).select(whole_number(df, vec_id).alias("id"), F.transform(df[vector], whole).alias("v"), F.size(df[vector]).alias("dim"))


def exact_topk(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", factor: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows of ``df``.

    Components become ``floor(factor * x)``; the score is the integer inner product;
    ties go to the smaller id; a query's own id is no candidate.  Vectors that are null
    or hold a null or non-finite component take no part, neither do rows without an id;
    vectors of different lengths never meet, those without components score zero.  Fewer
    candidates than ``k`` are all returned; a candidate id on several rows counts once for
    each; a query id on several rows is a query each time, with ranks of its own.  Scores
    beyond 64 bits are exact for the ranking within a shard and end at +-(2^63 - 1).
    """
    ready(df)
    data, asked = checkpoint(scaled(df, vec_id, vector, factor)), checkpoint(scaled(queries, vec_id, vector, factor))
    shards, blocks = max(1, -(-data.count() // shard)), max(1, -(-asked.count() // block))
    packed = "dim int, part int, ids binary, vectors binary, box binary"

    def pack(rows: DataFrame, parts: int, salt: int) -> DataFrame:
        # repeated ids are dealt out by their vectors too
        part = F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(parts)).cast("int")
        return rows.select("dim", part.alias("part"), "id", "v").groupBy("dim", "part").applyInArrow(lambda t: _pack(t, ["dim", "part"]), packed)

    trees = checkpoint(pack(data, shards, 0).withColumnRenamed("part", "tree"))
    # written once: a query is told by its block and its place there
    asking = checkpoint(pack(asked, blocks, 7).withColumnRenamed("part", "block").select("dim", "block", "ids", "vectors"))
    asks = "dim int, tree int, crowd int, block int, places binary, ids binary, vectors binary, bounds binary"
    schema = "dim int, block int, place int, query_id long, vec_id long, score long"

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The queries that ask a shard, block by block, against its tree."""
        out = []
        dim = key[0].as_py()
        if len(left) and len(right):
            tree = Tree(np.frombuffer(right.column("ids")[0].as_py(), "<i8"), _load(right.column("vectors")[0].as_py(), dim) if dim else np.zeros((len(right.column("ids")[0].as_py()) // 8, 0)))
            for r in left.select(["block", "places", "ids", "vectors", "bounds"]).to_pylist():
                qid = np.frombuffer(r["ids"], "<i8")
                place = np.frombuffer(r["places"], "<i4")
                q = _load(r["vectors"], dim) if dim else np.zeros((len(qid), 0))
                row, name, score = search(tree, qid, q, k, np.frombuffer(r["bounds"], "<i8"))
                out.append((np.full(len(row), r["block"], np.int32), place[row], qid[row], name, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.int64)] * 3
        trim()
        return pa.table([pa.array(np.full(len(cols[0]), dim, np.int32)), *map(pa.array, cols)], names=["dim", "block", "place", "query_id", "vec_id", "score"])

    def against(questions: DataFrame) -> DataFrame:
        # a shard goes to each crowd of blocks that asks it
        questions = checkpoint(questions)
        crowds = questions.select("dim", "tree", "crowd").distinct().toDF("dim", "tree", "__crowd")
        right = trees.select("dim", "tree", "ids", "vectors").join(crowds, ["dim", "tree"])
        return questions.groupBy("dim", "tree", "crowd").cogroup(right.groupBy("dim", "tree", "__crowd")).applyInArrow(answer, schema)

    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")

    def all_ask(batches):
        for b in batches:
            for r in b.to_pylist():
                n = len(r["ids"]) // 8
                yield _asks([(r["dim"], r["tree"], r["block"], np.arange(n), np.frombuffer(r["ids"], "<i8"), r["vectors"], np.full(n, _NOTHING))])

    near = checkpoint(against(asking.withColumn("tree", home).mapInArrow(all_ask, asks)))
    if shards > 1:
        # kth score so far of each query that has k
        low = near.groupBy("dim", "block", "place").agg(F.min("score").alias("s"), F.count("*").alias("c")).filter(F.col("c") >= k)
        low = low.groupBy("dim", "block").agg(F.collect_list(F.struct("place", "s")).alias("known"))  # a block's queries at most
        # boxes, some thousand to a row
        group = F.floor(F.col("tree") / BOXES).cast("int")
        boxes = trees.groupBy("dim", group.alias("boxes")).agg(F.collect_list(F.struct("tree", "box")).alias("all"))
        mine = asking.join(low, ["dim", "block"], "left").withColumn("boxes", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // BOXES))))

        def who_asks(batches):
            for b in batches:
                for r in b.to_pylist():
                    ids, dim = np.frombuffer(r["ids"], "<i8"), r["dim"]
                    q = _load(r["vectors"], dim) if dim else np.zeros((len(ids), 0))
                    bound = np.full(len(ids), _NOTHING)
                    for x in r["known"] or ():
                        bound[x["place"]] = x["s"]
                    others = [x for x in r["all"] if x["tree"] != r["block"] % shards]
                    if not others:
                        continue
                    low_, high = np.stack([_load(x["box"], dim) if dim else np.zeros((2, 0)) for x in others], axis=1)
                    may = _saturated(reach(q, low_, high)) >= bound[:, None]
                    for t, x in enumerate(others):
                        at = np.flatnonzero(may[:, t])
                        if len(at):
                            yield _asks([(dim, x["tree"], r["block"], at, ids[at], _dump(q[at]), bound[at])])

        near = near.unionByName(against(mine.join(boxes, ["dim", "boxes"]).mapInArrow(who_asks, asks)))
    w = Window.partitionBy("dim", "block", "place").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    """Questions of blocks to shards: which queries, their vectors, and the kth scores they have."""
    kinds = [pa.int32()] * 4 + [pa.binary()] * 4
    cols = zip(*[(d, t, b // ASKING, b, p.astype("<i4").tobytes(), i.astype("<i8").tobytes(), v, s.astype("<i8").tobytes()) for d, t, b, p, i, v, s in rows], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["dim", "tree", "crowd", "block", "places", "ids", "vectors", "bounds"])
