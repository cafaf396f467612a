"""Sample-specific correlation networks, in closed form.

With centred values d and sums S_ij = sum d_i d_j over N samples, leaving sample q out changes S_ij by
-d_iq d_jq N / (N - 1). So each weight N (r - r_q) + r_q is one expression of five numbers, and no
correlation is computed anew. The diagonal is 1 in every sample and is not stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def centred(values: DataFrame) -> DataFrame:
    """(gene, sample_id, d, s): deviations from the gene's mean, and their sum of squares; only genes seen in every sample."""
    g = W.partitionBy("gene")
    n = values.select("sample_id").distinct().count()
    x = values.withColumn("d", F.col("value") - F.avg("value").over(g)).withColumn("_n", F.count("value").over(g)).filter(F.col("_n") == n)
    return x.select("gene", "sample_id", "d", F.sum(F.col("d") * F.col("d")).over(g).alias("s"), F.lit(n).alias("n"))


def _closed_form(da, db, sa, sb, sab, n, greatest):
    """(whether there is a weight, weight) for one sample, of five numbers; columns or arrays."""
    out = n / (n - 1)
    ra, rb = sa - da * da * out, sb - db * db * out
    fine = (sa > 0) & (sb > 0) & (ra > TINY * sa) & (rb > TINY * sb)
    r = sab / greatest(sa * sb) ** 0.5
    rq = (sab - da * db * out) / greatest(ra * rb) ** 0.5
    return fine, n * (r - rq) + rq


TINY = 1e-12
BLOCK_CELLS = 2_000_000  # pairs x samples of one pair of gene blocks whose edges are listed
BLOCK_GENES = 512  # genes of a block whose edges are only summed


def _block_pairs(values: DataFrame, genes: int, kernel, schema: str) -> DataFrame:
    """``kernel`` over every pair of gene blocks (i <= j): names, deviations (genes x samples) and sums of squares of both, and sample names."""
    rows = centred(values).filter("n >= 3")
    vectors = rows.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("sample_id", "d"))).alias("x"), F.first("s").alias("s"))  # a row a sample
    blocks = max(1, -(-values.select("gene").distinct().count() // genes))
    block = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = vectors.withColumn("block", block).withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def run(key, pdf):
        import numpy as np

        pdf = pdf.sort_values("gene", kind="stable")
        names = [r["sample_id"] for r in pdf["x"].iloc[0]]
        sides = []
        for b in (int(key[0]), int(key[1])):
            own = pdf[pdf["block"] == b]
            sides.append((own["gene"].to_numpy(), np.array([[r["d"] for r in x] for x in own["x"]]).reshape(len(own), len(names)), own["s"].to_numpy()))
        return kernel(*sides, key[0] == key[1], names)

    return dealt.groupBy("i", "j").applyInPandas(run, schema)


def _weights(a, b, names):
    """For each sample, the matrix of weights of genes ``a`` by genes ``b``, 0 where there is none."""
    import numpy as np

    n = len(names)
    sab = a[1] @ b[1].T
    floor = lambda x: np.maximum(x, 1e-300)
    for q in range(n):
        fine, w = _closed_form(a[1][:, q, None], b[1][None, :, q], a[2][:, None], b[2][None, :], sab, n, floor)
        yield np.where(fine, w, 0.0)


def strengths(values: DataFrame) -> DataFrame:
    """(sample_id, gene, strength, degree): sums of absolute weights and numbers of weights over all other genes.

    Every pair of genes is met in one pair of blocks, a task each, and only sums by gene leave it.
    """
    kind = values.schema

    def kernel(a, b, same, names):
        import numpy as np
        import pandas as pd

        out = []
        for q, w in enumerate(_weights(a, b, names)):
            if same:
                np.fill_diagonal(w, 0.0)
            w = np.abs(w)
            out.append((names[q], a[0], w.sum(axis=1), (w > 0).sum(axis=1)))
            if not same:
                out.append((names[q], b[0], w.sum(axis=0), (w > 0).sum(axis=0)))
        return pd.concat([pd.DataFrame({"sample_id": s, "gene": g, "part": p, "n": c}) for s, g, p, c in out])

    schema = f"sample_id {kind['sample_id'].dataType.simpleString()}, gene string, part double, n long"
    parts = _block_pairs(values, BLOCK_GENES, kernel, schema)
    return parts.groupBy("sample_id", "gene").agg(F.sum("part").alias("strength"), F.sum("n").alias("degree"))


def edges(values: DataFrame, pairs: DataFrame | None = None, keep_zero: bool = False) -> DataFrame:
    """(sample_id, a, b, weight) for the canonical ``pairs`` (a, b), or for all pairs of genes.

    With fewer than 3 samples there are no edges. Pairs with a gene that is constant, or constant but for the
    sample left out, have no weight there and are dropped; so are weights of 0, unless ``keep_zero`` (given pairs only).

    All pairs of G genes are G^2 / 2 rows a sample (listed block by block, without a shuffle of pairs): give pairs (those of a reference
    network, those that touch a gene set) wherever the result is not an aggregate; for the aggregate see ``strengths``.
    """
    if pairs is None:
        samples = values.select("sample_id").distinct().count()

        def kernel(a, b, same, names):
            import numpy as np
            import pandas as pd

            out = []
            for q, w in enumerate(_weights(a, b, names)):
                i, j = np.nonzero(np.triu(w, 1) if same else w)
                u, v = a[0][i], b[0][j]
                swap = u > v
                out.append(pd.DataFrame({"sample_id": names[q], "a": np.where(swap, v, u), "b": np.where(swap, u, v), "weight": w[i, j]}))
            return pd.concat(out)

        schema = f"sample_id {values.schema['sample_id'].dataType.simpleString()}, a string, b string, weight double"
        return _block_pairs(values, max(8, int((BLOCK_CELLS / max(samples, 1)) ** 0.5)), kernel, schema)
    return _listed(values, pairs, keep_zero)


LISTED_CELLS = 4_000_000  # genes x samples of a block of vectors whose pairs are listed
CHUNK_CELLS = 1_000_000  # pairs x samples that are weighed at once


def _listed(values: DataFrame, pairs: DataFrame, keep_zero: bool) -> DataFrame:
    """Weights of listed pairs as a sampled product of two dense matrices.

    Genes are dealt over blocks and pairs over pairs of blocks. A task gets both blocks' vectors once and the pairs that are listed there;
    products are taken for these pairs only, in chunks. A pair is one row until its weights are written.
    """
    x = centred(values).filter("n >= 3")
    sample = values.schema["sample_id"].dataType
    vectors = x.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("sample_id", "d")))["d"].alias("d"), F.first("s").alias("s"))  # a gene's samples
    samples, genes = values.select("sample_id").distinct().count(), values.select("gene").distinct().count()
    blocks = max(1, min(1024, -(-genes * max(samples, 1) // LISTED_CELLS)), -(-genes // 4096))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    own = vectors.withColumn("own", block("gene")).withColumn("other", F.explode(every))
    low, high = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    rows = own.select(low, high, F.lit(1).alias("kind"), F.col("gene").alias("a"), "d", "s")
    names = values.agg(F.sort_array(F.collect_set("sample_id")).alias("names")).select("names", F.explode(every).alias("i")).select("names", "i", F.explode(every).alias("j"))
    listed = pairs.select("a", "b").distinct().filter("a is not null and b is not null").withColumn("u", block("a")).withColumn("v", block("b"))
    listed = listed.select(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), F.lit(2).alias("kind"), "a", "b")
    work = names.filter("i <= j").withColumn("kind", F.lit(0)).unionByName(rows, True).unionByName(listed, True)
    work = work.repartition("i", "j").sortWithinPartitions("i", "j", "kind").select("i", "j", "kind", "a", "b", "d", "s", "names")
    return work.mapInArrow(_weigh(keep_zero), f"sample_id {sample.simpleString()}, a string, b string, weight double")


def _weigh(keep_zero: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, names, at, matrix, squares = None, None, {}, None, None
        held: list = []
        floor = lambda v: np.maximum(v, 1e-300)

        def weighed(a, b):
            ia = np.array([at.get(g, -1) for g in a.to_pylist()], np.int64)
            ib = np.array([at.get(g, -1) for g in b.to_pylist()], np.int64)
            known = np.flatnonzero((ia >= 0) & (ib >= 0))
            step = max(1, CHUNK_CELLS // len(names))
            for some in (known[k : k + step] for k in range(0, len(known), step)):
                da, db = matrix[ia[some]], matrix[ib[some]]
                sab = np.einsum("ij,ij->i", da, db)
                fine, w = _closed_form(da, db, squares[ia[some], None], squares[ib[some], None], sab[:, None], len(names), floor)
                row, q = np.nonzero(fine if keep_zero else fine & (w != 0))
                which = pa.array(some[row])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), a.take(which), b.take(which), pa.array(w[row, q])], names=["sample_id", "a", "b", "weight"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch[c].to_numpy() for c in ("i", "j", "kind")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
                part, (i, j, kind) = batch.slice(lo, hi - lo), key[lo]
                if (i, j) != now:
                    now, at, matrix, held = (i, j), {}, None, []
                if kind == 0:
                    names = part["names"].flatten()
                elif kind == 1:
                    held.append((part["a"].to_pylist(), part["d"].flatten().to_numpy(), part["s"].to_numpy()))
                elif held or matrix is not None:
                    if matrix is None:
                        at = {g: k for k, g in enumerate(g for genes, _, _ in held for g in genes)}
                        matrix = np.concatenate([d for _, d, _ in held]).reshape(len(at), len(names))
                        squares = np.concatenate([s for _, _, s in held])
                        held = []
                    yield from weighed(part["a"], part["b"])

    return run
