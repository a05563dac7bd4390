"""Exact top-k inner products with a ball tree per shard.

Every task builds a ball tree over each block of its rows and searches it for all queries
of a block at once: a node is entered only by the queries whose upper bound
`q.c + |q| r` reaches their current kth score, the child with the larger bound first. The
kth scores are shared: a first round finds, in every shard, the kth score of the leaf with
the best bound, and the largest of them per query is where the full search starts.

Queries go to the shards in blocks of about `QUERY_BLOCK` (broadcast, so bounded); the
candidates are never shuffled, only at most k rows per query and task are.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; only vectors as long as the query's are its candidates; rows with the query's own id
are not its candidates; an id repeated among the queries is answered once (smallest vector),
repeated candidates all count; equal scores go to the smaller id, a null id last; with fewer
candidates than k all are returned; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 8192
LEAF = 64
_NO_ID = np.iinfo(np.int64).max
_NONE = -(1 << 62)          # below every score; its negative is a number too


def quantised(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component; null for a vector that takes no part."""
    ok = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


class BallTree:
    def __init__(self, vecs: np.ndarray, ids: np.ndarray):
        self.vecs, self.ids = vecs, ids
        f = vecs.astype(np.float64)
        self.order = np.arange(len(f))
        self.nodes: list = []           # (center, radius, lo, hi, left, right)
        self._build(f, 0, len(f))

    def _build(self, f, lo, hi) -> int:
        part = self.order[lo:hi]
        x = f[part]
        c = x.mean(axis=0)
        d = np.sqrt(((x - c) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append([c, float(d.max()), lo, hi, -1, -1])
        if hi - lo > LEAF and d.max() > 0:
            a = x[d.argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            mid = (hi - lo) // 2
            self.order[lo:hi] = part[np.argpartition(x @ (b - a), mid)]
            self.nodes[me][4] = self._build(f, lo, lo + mid)
            self.nodes[me][5] = self._build(f, lo + mid, hi)
        return me

    def leaves(self):
        return [n for n in self.nodes if n[4] < 0]


class Search:
    """Running top-k of a block of queries over any number of trees."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, queries, k
        self.qf = queries.astype(np.float64)
        self.norm = np.sqrt((self.qf ** 2).sum(axis=1))
        self.score = np.full((len(ids), k), _NONE, np.int64)
        self.got = np.full((len(ids), k), _NO_ID, np.int64)
        self.bound = np.full(len(ids), _NONE, np.int64) if bound is None else bound
        self.kth = self.bound.copy()

    def _upper(self, node, act):
        ub = self.qf[act] @ node[0] + self.norm[act] * node[1]
        return ub + 1e-6 + 1e-9 * np.abs(ub)

    def _products(self, tree, act, rows):
        x = tree.vecs[rows]
        most = float(np.abs(self.q[act]).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
        if most < 2 ** 52:      # exact in doubles
            s = (self.qf[act] @ x.astype(np.float64).T).astype(np.int64)
        else:
            s = self.q[act] @ x.T
        s[self.ids[act][:, None] == tree.ids[rows][None, :]] = _NONE
        return s

    def _leaf(self, tree, node, act):
        rows = tree.order[node[2]:node[3]]
        s = self._products(tree, act, rows)
        better = (s >= np.maximum(self.kth[act], _NONE + 1)[:, None]).any(axis=1)
        act, s = act[better], s[better]
        if not len(act):
            return
        score = np.concatenate([self.score[act], s], axis=1)
        ids = np.concatenate([self.got[act], np.broadcast_to(tree.ids[rows], s.shape)], axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, :self.k]
        self.score[act] = np.take_along_axis(score, best, 1)
        self.got[act] = np.take_along_axis(ids, best, 1)
        self.kth[act] = np.maximum(self.bound[act], self.score[act][:, -1])

    def run(self, tree: BallTree) -> None:
        stack = [(0, np.arange(len(self.ids)))]
        while stack:
            i, act = stack.pop()
            node = tree.nodes[i]
            act = act[self._upper(node, act) >= self.kth[act]]
            if not len(act):
                continue
            if node[4] < 0:
                self._leaf(tree, node, act)
                continue
            l, r = node[4], node[5]
            left_first = self._upper(tree.nodes[l], act).sum() >= self._upper(tree.nodes[r], act).sum()
            stack += [(r, act), (l, act)] if left_first else [(l, act), (r, act)]

    def probe(self, tree: BallTree) -> None:
        """Only each query's most promising leaf."""
        leaves = tree.leaves()
        if not leaves:
            return
        every = np.arange(len(self.ids))
        best = np.stack([self._upper(n, every) for n in leaves]).argmax(axis=0)
        for j in np.unique(best):
            self._leaf(tree, leaves[j], every[best == j])


def _trees(pdf: pd.DataFrame):
    """A tree per vector length of a block of rows."""
    if not len(pdf):
        return
    size = pdf["vec"].map(len).to_numpy()
    ids = pdf["id"].to_numpy()
    ids = np.array([_NO_ID if pd.isna(x) else int(x) for x in ids], np.int64)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), BallTree(np.stack([np.asarray(pdf["vec"].iloc[i], np.int64) for i in at]), ids[at])


def top_k(candidates: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """candidates and queries: (id long, vec array<long>), no null vectors. Returns query_id,
    rank (from 1), id, score."""
    spark = candidates.sparkSession
    asked = queries.filter("id is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    n = asked.count()
    blocks = max(1, math.ceil(n / query_block))
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()   # about query_block rows
        by_len: dict = {}
        for r in sorted(rows, key=lambda r: r["id"]):
            by_len.setdefault(len(r["vec"]), []).append(r)
        block = {d: (np.array([r["id"] for r in rs], np.int64), np.array([r["vec"] for r in rs], np.int64)) for d, rs in by_len.items()}
        shared = spark.sparkContext.broadcast(block)

        def probe(batches, shared=shared):
            found = {d: Search(i, q, k) for d, (i, q) in shared.value.items()}
            for pdf in batches:
                for d, tree in _trees(pdf):
                    if d in found:
                        found[d].probe(tree)
            for s in found.values():
                hit = s.kth > _NONE
                yield pd.DataFrame({"query_id": s.ids[hit], "kth": s.kth[hit]})

        kth = (candidates.mapInPandas(probe, "query_id long, kth long").groupBy("query_id").agg(F.max("kth").alias("kth")).collect()
               if rows else [])
        bounds = spark.sparkContext.broadcast({r["query_id"]: r["kth"] for r in kth})

        def search(batches, shared=shared, bounds=bounds):
            least = bounds.value
            found = {d: Search(i, q, k, np.array([least.get(int(x), _NONE) for x in i], np.int64)) for d, (i, q) in shared.value.items()}
            for pdf in batches:
                for d, tree in _trees(pdf):
                    if d in found:
                        found[d].run(tree)
            for s in found.values():
                a, c = np.nonzero((s.score > _NONE) & (s.score >= s.bound[:, None]))
                yield pd.DataFrame({"query_id": s.ids[a], "id": s.got[a, c], "score": s.score[a, c]})

        parts.append(candidates.mapInPandas(search, "query_id long, id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"),
                    F.when(F.col("id") == F.lit(int(_NO_ID)), F.lit(None).cast("long")).otherwise(F.col("id")).alias("id"), "score"))
