"""Blocked search of a stated query set against all vectors.

Rows become distinct vectors first. Of the rows that share a vector only the ``k + 1`` smallest ids can enter a list of
``k`` (one of them may be the query itself), so these are its members, and a vector is searched once however many rows
hold it. Every list is cut to ``k`` and freed of the query's own row at the end, row by row.

Distinct vectors are dealt over blocks by a hash, query vectors over tiles; a pair (block, tile) is one group. A group's
queries come first, its candidates are streamed behind them (``streamed``), so what a task holds is bounded by the parameters.
Vectors meet those of their own dimension only.

Defined results: rows without vector, without components, or with a null or non-finite component take no part; a null
vec_id is a candidate, never a query, and the last among ties; repeated ids and repeated rows are rows of their own, each
other's candidates, and each has its list; fewer candidates than k give fewer rows; no vectors give an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

BLOCK_ROWS, TILE_ROWS, GROUP_BYTES = 20_000, 16_000, 64_000_000
LEAST_BLOCKS, LEAST_ROWS = 12, 1_000  # small tables still give some tasks, unless blocks fall below so many rows
NO_ID, MOST = (1 << 63) - 1, np.finfo(np.float64).max


def matrix(column, dtype=np.float64) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1) if n else np.empty((0, 0), dtype)


def _keyed(floored: int | None, single: bool):
    """Batches (vec_id, v) with d and a 128-bit key of the vector; ``floored``: components become floor(floored * x); ``single``: floats stay floats."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = b["v"].offsets.to_numpy()
            flat = b["v"].values.to_numpy(zero_copy_only=False).astype(np.float64)
            if floored:
                with np.errstate(over="ignore"):
                    flat = np.clip(np.floor(flat * floored), -MOST, MOST)
            flat = flat + 0.0  # one zero
            keys = [hashlib.blake2b(flat[s:e].tobytes(), digest_size=16).digest() for s, e in zip(at, at[1:])]
            v = pa.ListArray.from_arrays(b["v"].offsets, pa.array(flat.astype(np.float32) if single else flat))
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array(keys, pa.binary()), pa.array(np.diff(at).astype(np.int32)), v], names=["vec_id", "key", "d", "v"],
            )

    return run


class Search:
    """``vectors`` made ready for lists of ``k`` for every row whose vec_id is divisible by ``every``.

    members (key, vec_id, lead): the rows that can be listed; asks (key, vec_id): the query rows;
    vectors (rid, key, d, v, least, asked): the distinct vectors. The result of ``lists`` is read from ``asks`` and ``near``.
    """

    def __init__(self, vectors: DataFrame, every: int, k: int, floored: int | None = None, zero: bool = True):
        self.k = k
        single = vectors.schema["embedding"].dataType.simpleString() == "array<float>" and floored is None
        kind = "array<float>" if single else "array<double>"
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"),
        ).filter((F.size("v") > 0) & fine)
        if not zero:
            rows = rows.filter(F.exists("v", lambda x: x != 0))
        keyed = lambda x: x.mapInArrow(_keyed(floored, single), f"vec_id long, key binary, d int, v {kind}")
        order = W.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
        first = keyed(rows).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).withColumn("lead", F.rank().over(order) == F.col("r"))
        first = durable(first, "vector-rows")
        self.members = first.select("key", "vec_id", "lead")
        self.asks = durable(keyed(rows.filter(F.col("vec_id") % every == 0)).select("key", "vec_id"), "vector-asks")
        asked = self.asks.select("key").distinct().withColumn("asked", F.lit(True))
        one = first.filter("r = 1").join(asked, "key", "left")
        self.vectors = one.select(
            F.monotonically_increasing_id().alias("rid"), "key", "d", "v", F.coalesce("vec_id", F.lit(NO_ID)).alias("least"),
            F.coalesce("asked", F.lit(False)).alias("asked"),
        )

    def deal(self, index: DataFrame, block_row_bytes: int = 0, tile_row_bytes: int = 0) -> None:
        """Number of blocks and tiles for the rows of ``index`` (made from ``vectors``); a row's bytes beside 8 a component."""
        self.index = index
        n, q, d = index.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max("d"), F.lit(1))).first()
        fit = lambda rows, extra: max(64, min(rows, GROUP_BYTES // (8 * d + extra)))
        self.blocks = max(math.ceil(n / fit(BLOCK_ROWS, block_row_bytes)), min(LEAST_BLOCKS, math.ceil(n / LEAST_ROWS)), 1)
        self.tiles = max(1, math.ceil(q / fit(TILE_ROWS, tile_row_bytes)))

    def streamed(self, given: DataFrame, asked: DataFrame, state: Callable, schema: str) -> DataFrame:
        """``state(d)`` takes a group's queries by ``asks``, its candidates by ``given`` and yields record batches; ``finish`` ends it.

        Both tables have rid and d. A group's rows are sorted queries first.
        """
        tiles, blocks = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (self.tiles, self.blocks))
        deal = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n).cast("long")).cast("int")
        a = asked.select("*", F.lit(0).alias("side"), deal(self.tiles, 1).alias("tile"), F.explode(blocks).alias("block"))
        b = given.select("*", F.lit(1).alias("side"), deal(self.blocks, 2).alias("block"), F.explode(tiles).alias("tile"))
        group = ["d", "block", "tile"]
        return a.unionByName(b, allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group, "side").mapInArrow(_grouped(group, state), schema)

    def lists(self, hits: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score) from (q, c, score) that hold the best ``k + 1`` vectors c of each query vector q."""
        names = self.index.select("rid", "key")
        x = hits.join(names.select(F.col("rid").alias("c"), "key"), "c").join(self.members, "key").drop("key")
        order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), (~F.col("lead")).cast("int"))
        x = x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k + 1)
        near = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", (F.col("lead") & (F.col("q") == F.col("c"))).alias("own"))))  # k + 1 at most
        self.near = near = durable(x.groupBy("q").agg(near.alias("near")).join(names.withColumnRenamed("rid", "q"), "q").select("key", "near"), "vector-lists")
        x = self.asks.select("key", F.col("vec_id").alias("query_id")).join(near, "key")
        kept = F.expr(f"slice(filter(near, x -> not (x.own and x.vec_id <=> query_id)), 1, {self.k})")
        return x.select("query_id", F.posexplode(kept).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def _grouped(group: list[str], state: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b[c].to_numpy() for c in group], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if now != tuple(keys[lo]):
                    if held is not None:
                        yield from held.finish()
                    now, held = tuple(keys[lo]), state(int(keys[lo][0]))
                part = b.slice(lo, hi - lo)
                n = int((part["side"].to_numpy() == 0).sum())
                if n:
                    held.asks(part.slice(0, n))
                if n < part.num_rows:
                    yield from held.given(part.slice(n))
        if held is not None:
            yield from held.finish()

    return run


def kth(scores: DataFrame, k: int) -> DataFrame:
    """(rid, bar): the k-th best score of each q; q with fewer have none. ``scores`` holds a bounded number of rows a q."""
    ordered = F.sort_array(F.collect_list(F.col("score").cast("double")), asc=False)
    return scores.groupBy(F.col("q").alias("rid")).agg(F.get(ordered, F.lit(k - 1)).alias("bar"))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]

