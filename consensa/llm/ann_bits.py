"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every distinct vector is padded with zeros to ``BITS`` dimensions at least, turned by one random rotation, and keeps its
sign bits (packed), its norm and the inner product of its direction with its code's direction (the correction scalar).
For a query, turned alike, the inner product with a code, scaled by norm and correction scalar, estimates the true inner
product; its error is at most ``eps`` standard deviations with high probability, and shrinks with the number of bits.

Three passes. 1: every query meets every code, and the best estimates of all blocks are measured on the vectors; the
k-th best true inner product is the query's bar, one for all blocks. 2: every query meets every code again, and the vectors whose
upper bound reaches the bar go on. 3: these alone are fetched and measured, in double precision. Only codes and scalars
(80 bytes a vector of 64 dimensions) travel to the groups.

Defined results: as in ``vector_blocks``; all-zero vectors take no part.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, scope
from .vector_blocks import Search, kth, matrix

BITS, CHUNK = 512, 2048


@functools.lru_cache(4)
def rotation(d: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """The first ``d`` columns of a random rotation of max(bits, d) dimensions, rounded up to whole bytes."""
    n = -(-max(bits, d) // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :d])


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; components are scaled first, so their squares stay in range."""
    big = np.abs(v).max(axis=1)
    v = v / big[:, None]
    norm = np.sqrt((v * v).sum(axis=1))
    return v / norm[:, None], norm * big


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: n x bytes, norms, correction scalars)."""
    way, norm = directions(v)
    u = way @ turn.T
    return np.packbits(u > 0, axis=1), norm, np.abs(u).sum(axis=1) / np.sqrt(len(turn))


def with_codes(vectors: DataFrame, bits: int, seed: int) -> DataFrame:
    """``vectors`` with code, norm and correction scalar."""

    def run(batches):
        for b in batches:
            d = b["d"].to_numpy()
            for size in np.unique(d):
                part = b.filter(pa.array(d == size))
                code, norm, fix = encode(matrix(part["v"]), rotation(int(size), bits, seed))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in b.schema.names), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(norm), pa.array(fix)],
                    names=[*b.schema.names, "code", "norm", "fix"],
                )

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInArrow(run, f"rid long, key binary, d int, v {kind}, least long, asked boolean, code binary, norm double, fix double")


class _Codes:
    """A group's queries, and estimates for its candidates as they come."""

    def __init__(self, d: int, bits: int, seed: int, eps: float):
        self.turn, self.eps = rotation(d, bits, seed), eps
        self.parts, self.ready = [], False

    def asks(self, b: pa.RecordBatch):
        self.parts.append((b["rid"].to_numpy(), matrix(b["v"]), b["bar"].to_numpy(zero_copy_only=False).astype(float)))

    def given(self, b: pa.RecordBatch):
        if not self.parts:
            return
        if not self.ready:
            self.q, v, self.bar = (np.concatenate(x) for x in zip(*self.parts))
            way, self.length = directions(v)
            self.turned = (way @ self.turn.T).astype(np.float32)
            self.ready = True
            self.begin()
        n = b.num_rows
        raw = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(n, -1)
        signs = np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1
        norm, fix = b["norm"].to_numpy(), b["fix"].to_numpy()
        size = signs.shape[1]
        scale, spread = norm / (fix * np.sqrt(size)), norm * (np.sqrt(np.maximum(1 - fix * fix, 0)) / fix / np.sqrt(size - 1) * self.eps + 1e-5)
        for at in range(0, len(self.q), CHUNK):
            some = slice(at, at + CHUNK)
            about = (self.turned[some] @ signs.T) * scale[None, :]  # in units of the query's length
            yield from self.seen(some, about, spread, b["rid"].to_numpy())

    def begin(self):
        pass

    def finish(self):
        return iter(())


def _rows(q, c, **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), *map(pa.array, more.values())], names=["q", "c", *more])


class _First(_Codes):
    """The best ``k`` estimates of a group."""

    def __init__(self, k: int, *a):
        super().__init__(*a)
        self.k = k

    def begin(self):
        self.ids = np.full((len(self.q), self.k), -1, np.int64)
        self.top = np.full((len(self.q), self.k), -np.inf)

    def seen(self, some, about, spread, ids):
        every = np.concatenate([self.top[some], about], axis=1)
        names = np.concatenate([self.ids[some], np.broadcast_to(ids, about.shape)], axis=1)
        at = np.argpartition(-every, self.k - 1, axis=1)[:, : self.k]
        self.top[some], self.ids[some] = np.take_along_axis(every, at, 1), np.take_along_axis(names, at, 1)
        return iter(())

    def finish(self):
        if self.ready:
            row, column = np.nonzero(self.ids >= 0)
            yield _rows(self.q[row], self.ids[row, column], about=self.top[row, column])


class _Reaching(_Codes):
    """Candidates whose upper bound reaches the query's bar; all of them where there is no bar."""

    def begin(self):
        self.bar = np.where(np.isnan(self.bar), -np.inf, self.bar) / self.length

    def seen(self, some, about, spread, ids):
        row, column = np.nonzero(about + spread[None, :] >= self.bar[some, None])
        if len(row):
            yield _rows(self.q[some][row], ids[column])


def _measure(batches):
    """Exact inner products of (v, w), component by component."""
    for b in batches:
        if b.num_rows:
            v, w = (b[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in "vw")
            product = v * w
            ends = np.cumsum(b["v"].value_lengths().to_numpy(zero_copy_only=False))
            yield _rows(b["q"], b["c"], score=np.add.reduceat(product, np.concatenate(([0], ends[:-1]))))


def measured(pairs: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """(q, c, score) of the pairs (q, c), on the vectors themselves."""
    x = pairs.join(index.select(F.col("rid").alias("c"), "v"), "c").join(index.select(F.col("rid").alias("q"), F.col("v").alias("w")), "q")
    return durable(x.select("q", "c", "v", "w").mapInArrow(_measure, "q long, c long, score double"), name)


def reaching(search: Search, k: int, eps: float, bits: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(scores of the first estimates, pairs (q, c) whose bound reaches the bar)."""
    given = search.index.select("rid", "d", "code", "norm", "fix")
    asked = search.index.filter("asked").select("rid", "d", "v")
    near = search.streamed(given, asked.withColumn("bar", F.lit(None).cast("double")), lambda d: _First(k, d, bits, seed, eps), "q long, c long, about double")
    order = W.partitionBy("q").orderBy(F.col("about").desc(), "c")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * k)
    sure = measured(near.select("q", "c"), search.index, "ann-first")
    asked = asked.join(kth(sure, k), "rid", "left")
    return sure, search.streamed(given, asked, lambda d: _Reaching(d, bits, seed, eps), "q long, c long")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, eps: float = 2.5, bits: int = BITS, seed: int = 11) -> DataFrame:
    """Per query row its ``k`` nearest: query_id, rank, vec_id, score."""
    with scope(vectors.sparkSession) as own:
        search = Search(vectors, every, k, zero=False)
        search.deal(durable(with_codes(search.vectors, bits, seed), "ann-index"), bits // 8)
        sure, pairs = reaching(search, k + 1, eps, bits, seed)
        rest = measured(pairs.join(sure, ["q", "c"], "left_anti"), search.index, "ann-rest")
        order = W.partitionBy("q").orderBy(F.col("score").desc(), "least")
        hits = sure.unionByName(rest).join(search.index.select(F.col("rid").alias("c"), "least"), "c")
        out = search.lists(hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("q", "c", "score"))
        own.spare(search.asks, search.near)
    return out


def op5(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
