"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size and queries into blocks of bounded size; every pair of blocks
is one task.  A block keeps, for every dimension, its vectors sorted by that component.  A query goes down
all lists at once (from the top where its component is positive, from the bottom where it is negative),
scores each vector on first sight by its whole components, and stops once its k-th score is above the bound:
the inner product with the components last seen, which no unseen vector can beat.  The k best of each block
are then merged by query.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a
null id; shorter vectors count as padded with zeros; ties go to the smaller id; a row that repeats with the same
vector counts once, other vectors of the same id are ranked too; a query's candidates are the rows of other ids;
fewer candidates than k give fewer rows.  Ids are read as 64-bit integers, others stop with a cast error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces

CANDIDATES, QUERIES = 16_384, 16_384


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0) -> DataFrame:
    """(id, v): floor(factor * x) of every component, as 64-bit integers, of the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~bad).select(
        F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long")).alias("v")
    )


class Block:
    """Sorted lists of a block of vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], np.ascontiguousarray(matrix[order])
        self.lists = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T)  # by dimension, ascending
        self.values = np.take_along_axis(self.rows, self.lists.T, axis=0).T
        self.scored = 0  # vectors scored by all queries so far: what stopping early saves

    def top(self, query: np.ndarray, own: int, k: int, first: int = 16) -> list[tuple[int, int]]:
        """The k best (score, id) but rows of id ``own``; ties to the smaller id."""
        n = len(self.ids)
        use = np.flatnonzero(query)
        up = query[use] > 0
        seen = np.zeros(n, np.bool_)
        best = np.zeros(0, np.int64)  # rows, best first
        scores = np.zeros(0, self.rows.dtype)
        a, step = 0, first
        while True:
            b = min(n, a + step)
            fresh = np.zeros(n, np.bool_)
            if len(use):
                fresh[self.lists[use[up], n - b : n - a]] = True
                fresh[self.lists[use[~up], a:b]] = True
            else:
                fresh[a:b] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            self.scored += len(new)
            new = new[self.ids[new] != own]
            if len(new):
                s = self.rows[new] @ query
                if len(best) == k:
                    ok = s >= scores[-1]
                    new, s = new[ok], s[ok]
                best, scores = np.concatenate([best, new]), np.concatenate([scores, s])
                keep = np.lexsort((best, -scores))[:k]  # rows are in id order
                best, scores = best[keep], scores[keep]
            if b == n:
                break
            if len(best) == k:
                bound = query[use[up]] @ self.values[use[up], n - b] + query[use[~up]] @ self.values[use[~up], b - 1]
                if scores[-1] > bound:
                    break
            a, step = b, 2 * step
        return [(int(s), int(self.ids[i])) for s, i in zip(scores, best, strict=True)]


def _arrays(column) -> np.ndarray:
    """A list column as a matrix, shorter lists padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (id, v) that ``is_query`` holds for, against all rows."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), "v", is_query.alias("q"))
    n, nq = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    cb, qb = pieces(n, candidates), pieces(nq, queries)
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = rows.select("id", "v", F.lit(False).alias("q"), part(cb).alias("c"), every(qb).alias("b"))
    asked = rows.where("q").select("id", "v", F.lit(True).alias("q"), every(cb).alias("c"), part(qb).alias("b"))
    both = base.unionByName(asked).repartition(max(cb * qb, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "c", "b")

    def work(table: pa.Table) -> pa.Table:
        ids, asked = np.asarray(table.column("id")), np.asarray(table.column("q"))
        matrix = _arrays(table.column("v"))
        top = int(np.abs(matrix).max()) if matrix.size else 0
        exact = top * top * max(1, matrix.shape[1]) < 1 << 53
        matrix = matrix.astype(np.float64) if exact else matrix.astype(object)

        def distinct(mask):
            at, seen = np.flatnonzero(mask), set()
            at = at[np.argsort(ids[at], kind="stable")]
            if len(np.unique(ids[at])) == len(at):
                return at
            return np.array([i for i in at if (key := (ids[i], tuple(matrix[i]))) not in seen and not seen.add(key)])

        c, q = distinct(~asked), distinct(asked)
        out = []
        if len(c):
            block = Block(ids[c], matrix[c])
            for i in q:
                mark = hash(tuple(matrix[i].tolist()))
                out += [(int(ids[i]), mark, v, s) for s, v in block.top(matrix[i], ids[i], k)]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "mark", "vec_id", "score"])

    found = both.groupBy("c", "b").applyInArrow(work, "query_id long, mark long, vec_id long, score long")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
