"""Exact top-k by inner product with a pivot table.

Components become integers floor(256 x). For every distinct vector the distances to ``pivots`` pivots are kept; the largest
difference of a query's and a vector's distances to a pivot is a lower bound of their distance, and with both norms it
gives an upper bound of their inner product: <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2.

Two passes over the groups. 1: of each block, the ``CHUNK`` candidates of highest bound are evaluated; the k-th best score
over all blocks is the query's bar. 2: a block's candidates are evaluated in the order of the bound, in chunks of 64, 128, 256 and so on, until
the next bound is below the bar and below the k-th best score found: no candidate left can enter.

Pivots are chosen farthest-first among the vectors of a dimension in a sample of ``SAMPLE`` vectors (the smallest hashes); a
dimension without enough of them gets pivots drawn by its number. Every vector is in the table, and the result is exact whatever
the pivots. How many candidates are spared depends on the data: where distances to all pivots are much alike (random directions
in many dimensions), nearly none; in clusters, most.

Defined results: as in ``vector_blocks``; zero vectors take part. Where sums can pass 2^53 they are done in whole numbers, and
scores beyond a long become the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, scope
from .vector_blocks import Search, best, kth, matrix

SAMPLE, CHUNK, LARGEST, PIVOTS = 1024, 64, 2048, 32
MOST = (1 << 63) - 1


def choose(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first choice, starting at the vector farthest from the mean."""
    far = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    picked = [int(far.argmax())]
    near = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(pivots, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots], 1)


def with_table(vectors: DataFrame, pivots: int) -> DataFrame:
    """``vectors`` with the distances ``far`` to the pivots of their dimension."""
    sample = vectors.select("v", F.xxhash64("key").alias("h"), "rid").orderBy("h", "rid").limit(SAMPLE).select("v").collect()
    by: dict[int, list] = {}
    for (v,) in sample:
        by.setdefault(len(v), []).append(v)
    chosen = {d: choose(np.array(rows), pivots) for d, rows in by.items()}

    def pivots_of(d: int) -> np.ndarray:
        got = chosen.get(d, np.empty((0, d)))
        more = np.random.default_rng(d).standard_normal((pivots - len(got), d))
        return np.concatenate([got, more * 256 / np.sqrt(d)])

    def run(batches):
        for b in batches:
            d = b["d"].to_numpy()
            for size in np.unique(d):
                part = b.filter(pa.array(d == size))
                far = distances(matrix(part["v"]), pivots_of(int(size)))
                far = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * pivots), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in b.schema.names), far], names=[*b.schema.names, "far"])

    return vectors.mapInArrow(run, "rid long, key binary, d int, v array<double>, least long, asked boolean, far array<double>")


def whole(a: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as Python integers."""
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)


class _Block:
    """A group's queries and candidates; at the end, the best ``k`` of each query, in bound order until the exact stop."""

    def __init__(self, k: int, first_only: bool):
        self.k, self.first_only = k, first_only
        self.asked: list[pa.RecordBatch] = []
        self.held: list[pa.RecordBatch] = []
        self.evaluated = self.met = 0

    def asks(self, b: pa.RecordBatch):
        self.asked.append(b)

    def given(self, b: pa.RecordBatch):
        if self.asked:
            self.held.append(b)  # at most a block
        return iter(())

    def finish(self):
        if not self.held:
            return
        asked, given = pa.Table.from_batches(self.asked), pa.Table.from_batches(self.held)
        ids, least, v, far = given["rid"].to_numpy(), given["least"].to_numpy(), matrix(given["v"]), matrix(given["far"])
        qs, q_far = matrix(asked["v"]), matrix(asked["far"])
        bars = asked["bar"].to_numpy().astype(float)
        exact = max(np.abs(v).max(), 1) * max(np.abs(qs).max(), 1) * v.shape[1] < 2**53
        square = (v * v).sum(axis=1)
        big = None if exact else whole(v)
        columns = np.ascontiguousarray(far.T)
        out = []
        for qid, q, at, bar in zip(asked["rid"].to_numpy(), qs, q_far, np.where(np.isnan(bars), -np.inf, bars)):
            gap = np.abs(columns[0] - at[0])
            for j in range(1, len(at)):
                np.maximum(gap, np.abs(columns[j] - at[j]), out=gap)
            top = (q @ q + square - gap * gap) / 2
            top += 1e-9 * (q @ q + square) + 1e-6  # rounding of the bound
            top[np.isnan(top)] = np.inf  # beyond a double: no bound
            if self.first_only:
                order = np.argpartition(-top, CHUNK)[:CHUNK] if len(top) > CHUNK else np.arange(len(top))
            else:
                order = np.flatnonzero(top >= bar)
                order = order[np.argsort(-top[order], kind="stable")]
            pos, got = np.empty(0, np.int64), np.empty(0, np.float64 if exact else object)
            i, size = 0, CHUNK
            while i < len(order):
                part = order[i : i + size]
                if len(got) == self.k and top[part[0]] < got[-1]:
                    break
                if exact:
                    s = v[part] @ q
                else:
                    s = np.array([max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(row, map(int, q))))) for row in big[part]], object)
                self.evaluated += len(part)
                i, size = i + size, min(2 * size, LARGEST)  # at most about twice of what is needed is evaluated
                if len(got) == self.k:
                    some = s >= got[-1]
                    part, s = part[some], s[some]
                pos, got = np.concatenate([pos, part]), np.concatenate([got, s])
                keep = best(least[pos], got, self.k)
                pos, got = pos[keep], got[keep]
            out.append((qid, ids[pos], got))
        self.met += len(out) * len(ids)
        score = np.concatenate([g for _, _, g in out]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([x for x, _, _ in out], [len(c) for _, c, _ in out])), pa.array(np.concatenate([c for _, c, _ in out])), pa.array(score)],
            names=["q", "c", "score"],
        )


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """Per query row its ``k`` best: query_id, rank, vec_id, score."""
    with scope(vectors.sparkSession) as own:
        search = Search(vectors, every, k, floored=256)
        search.deal(durable(with_table(search.vectors, pivots), "pivot-table"), 8 * pivots, 8 * pivots)
        given = search.index.select("rid", "d", "v", "far", "least")
        asked = search.index.filter("asked").select("rid", "d", "v", "far")
        found = lambda q, first: search.streamed(given, q, lambda _: _Block(k + 1, first), "q long, c long, score long")
        bars = durable(kth(found(asked.withColumn("bar", F.lit(None).cast("double")), True), k + 1), "pivot-bars")
        order = W.partitionBy("q").orderBy(F.col("score").desc(), "least")
        hits = found(asked.join(bars, "rid", "left"), False).join(search.index.select(F.col("rid").alias("c"), "least"), "c")
        out = search.lists(hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("q", "c", "score"))
        own.spare(search.asks, search.near)
    return out


def op7(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.i <> c.i AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
