"""Cosine similarity of samples over their genes' strengths, and the leaf order of its heat map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import keep, scope

TILE = 1024  # samples of one side of a block
CELLS = 4_000_000  # cells (samples x genes) of a block, about


def cosine(strengths: DataFrame) -> DataFrame:
    """(s1, s2, similarity, distance) for s1 <= s2 from (sample_id, gene, value); null where a norm is 0, absent genes are 0.

    Samples are dealt over tiles and genes over blocks. A task multiplies two tiles' matrices over one block of genes, and its partial sums, one a
    pair of samples, are added up: no pair is made for each gene. Norms are the sums of samples with themselves.
    """
    x = strengths.filter("gene is not null and sample_id is not null")
    samples, genes = x.agg(F.count_distinct("sample_id"), F.count_distinct("gene")).first()
    tiles = max(1, -(-samples // TILE))
    blocks = max(1, -(-genes * min(samples, 2 * TILE) // CELLS))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    x = x.select("sample_id", "gene", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), dealt("gene", blocks).alias("block"))
    # an empty gene in the first block, so samples that share no gene meet there
    x = x.unionByName(x.select("sample_id").distinct().select("sample_id", F.lit("").alias("gene"), F.lit(0.0).alias("value"), F.lit(0).alias("block")))
    x = x.withColumn("tile", dealt("sample_id", tiles)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    x = x.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("other")
    kind = strengths.schema["sample_id"].dataType.simpleString()
    parts = x.groupBy("block", "i", "j").applyInArrow(_gram, f"s1 {kind}, s2 {kind}, dot double")
    with scope(strengths.sparkSession) as own:
        dot = keep(parts.groupBy("s1", "s2").agg(F.sum("dot").alias("dot")), "gram")
        own.spare(dot)
    norm = lambda s, n: dot.filter("s1 = s2").select(F.col("s1").alias(s), F.sqrt("dot").alias(n))
    sim = F.try_divide("dot", F.nullif(F.col("n1") * F.col("n2"), F.lit(0.0)))
    return dot.join(norm("s1", "n1"), "s1").join(norm("s2", "n2"), "s2").select("s1", "s2", sim.alias("similarity"), (1 - sim).alias("distance"))


def _gram(t):
    """Partial products of the samples of two tiles over one block of genes."""
    import numpy as np
    import pyarrow as pa

    gene = t["gene"].dictionary_encode().combine_chunks()
    sample = t["sample_id"].dictionary_encode().combine_chunks()
    names = sample.dictionary
    order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    names = names.take(pa.array(order))
    at = place[sample.indices.to_numpy()]
    m = np.zeros((len(names), len(gene.dictionary)))
    np.add.at(m, (at, gene.indices.to_numpy()), t["value"].to_numpy())
    tile = np.zeros(len(names), int)
    tile[at] = t["tile"].to_numpy()
    product = m @ m.T
    low, high = np.triu_indices(len(names))
    if t["i"][0].as_py() != t["j"][0].as_py():
        across = tile[low] != tile[high]
        low, high = low[across], high[across]
    return pa.Table.from_arrays([names.take(pa.array(low)), names.take(pa.array(high)), pa.array(product[low, high])], names=["s1", "s2", "dot"])


def leaf_order(distances: DataFrame) -> DataFrame:
    """(sample, position): the order of a clustered heat map, from (s1, s2, distance) for s1 <= s2.

    Rows of the distance matrix are clustered by Euclidean distance and complete linkage. Of two single rows the earlier name comes first,
    a single row before a cluster, and of two clusters the one joined earlier. Null distances count as 1. The matrix of a cohort, samples squared, is one
    task's: so is a heat map. Three matrices of that size are held, and each row's nearest is kept, so most steps look at one row.
    """

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        names = sorted(set(pdf["s1"]) | set(pdf["s2"]))
        at = {s: i for i, s in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        i, j = pdf["s1"].map(at), pdf["s2"].map(at)
        m[i, j] = m[j, i] = pdf["distance"].fillna(1.0)
        return pd.DataFrame({"sample": [names[i] for i in complete_linkage(m)], "position": range(1, len(names) + 1)})

    return distances.groupBy(F.lit(0).alias("all")).applyInPandas(run, f"sample {distances.schema['s1'].dataType.simpleString()}, position int")


def complete_linkage(rows) -> list[int]:
    """Leaf order of ``rows``."""
    import numpy as np

    n = len(rows)
    d = np.empty((n, n))
    for i in range(n):
        d[i] = np.sqrt(((rows - rows[i]) ** 2).sum(axis=1))
        d[i, i] = np.inf
    groups = {i: ([i], -1) for i in range(n)}  # leaves, and when the cluster was joined
    if n < 2:
        return list(range(n))
    nearest = d.argmin(axis=1)
    least = d[np.arange(n), nearest]
    for step in range(n - 1):
        a = int(least.argmin())
        i, j = sorted((a, int(nearest[a])))
        (left, when_left), (right, when_right) = groups[i], groups.pop(j)
        groups[i] = (left + right if (when_left, left[0]) <= (when_right, right[0]) else right + left, step)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[j] = d[:, j] = d[i, i] = np.inf
        least[j] = np.inf
        # distances only grow, so the others keep their nearest
        for k in np.flatnonzero((nearest == i) | (nearest == j) | (np.arange(n) == i)):
            if k != j and np.isfinite(least[k]):
                nearest[k] = d[k].argmin()
                least[k] = d[k, nearest[k]]
    return next(iter(groups.values()))[0]
