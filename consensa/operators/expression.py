"""Count matrices in long form (gene, sample_id, count): sums, filters, size factors, variance stabilisation."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import strip_version
from ..functions.tables import keep, scope


def by_gene(counts: DataFrame) -> DataFrame:
    """Counts summed by version-less gene and sample (lanes of a sample add up); null counts as 0."""
    return counts.groupBy(strip_version("gene").alias("gene"), "sample_id").agg(F.sum(F.coalesce(F.col("count").cast("long"), F.lit(0))).alias("count"))


def expressed(counts: DataFrame, least: int = 15, share: int = 5) -> DataFrame:
    """Genes with at least floor(samples / share) samples of ``least`` counts or more."""
    n = counts.select("sample_id").distinct().count()
    kept = counts.groupBy("gene").agg(F.count_if(F.col("count") >= least).alias("n")).filter(F.col("n") >= n // share)
    return counts.join(kept.select("gene"), "gene", "left_semi")


def size_factors(counts: DataFrame) -> DataFrame:
    """(sample_id, size_factor): median ratio to the geometric mean, over genes positive in every sample."""
    n = counts.select("sample_id").distinct().count()
    logs = counts.filter("count > 0").select("gene", "sample_id", F.ln(F.col("count").cast("double")).alias("l"))
    mean = logs.groupBy("gene").agg(F.avg("l").alias("m"), F.count("*").alias("n")).filter(F.col("n") == n).select("gene", "m")
    return logs.join(mean, "gene").groupBy("sample_id").agg(F.exp(F.median(F.col("l") - F.col("m"))).alias("size_factor"))


SUBSET, LEAST_MEAN, LEAST_DISPERSION = 1000, 5, 1e-8  # fixed values: genes the trend is fitted on, their least mean, the smallest dispersion


def _lgamma(x):
    """Log gamma of positive arrays, by Stirling's series eight steps up."""
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - sum(np.log(x + k) for k in range(8))


def profile_likelihood(alpha, y, mu):
    """Adjusted profile log likelihoods of negative-binomial counts ``y`` with means ``mu``, for each dispersion of ``alpha``."""
    r = 1 / np.asarray(alpha, float)[:, None]
    fit = _lgamma(y + r) - _lgamma(r) - y * np.log(mu + r) - r * np.log1p(mu / r)
    return fit.sum(axis=1) - 0.5 * np.log((1 / (1 / mu + 1 / r)).sum(axis=1))


def dispersion(y, factors) -> float:
    """The dispersion of greatest adjusted profile likelihood, by a grid that is narrowed five times."""
    y, factors = np.asarray(y, float), np.asarray(factors, float)
    mu = np.maximum((y / factors).mean() * factors, 0.5)
    low, high = math.log(LEAST_DISPERSION), math.log(max(10, len(y)))
    for _ in range(5):
        grid = np.linspace(low, high, 25)
        k = int(np.argmax(profile_likelihood(np.exp(grid), y, mu)))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, 24)]
    return float(np.exp(grid[k]))


def dispersions(counts: DataFrame) -> DataFrame:
    """(gene, m, d) from (gene, sample_id, count, size_factor): mean of normalised counts and dispersion, for the genes the trend is fitted on.

    Of the genes with a mean over ``LEAST_MEAN``, ``SUBSET`` that are evenly spaced by mean; all genes if there are fewer.
    """
    means = counts.groupBy("gene").agg(F.avg(F.col("count") / F.col("size_factor")).alias("m")).filter("m > 0")
    high = means.filter(F.col("m") > LEAST_MEAN)
    n = high.count()
    chosen = means
    if n >= SUBSET:
        at = F.row_number().over(W.orderBy("m", "gene"))  # a row a gene
        spaced = [round(1 + i * (n - 1) / (SUBSET - 1)) for i in range(SUBSET)]
        chosen = high.withColumn("at", at).filter(F.col("at").isin(spaced)).drop("at")
    rows = counts.join(chosen, "gene").groupBy("gene", "m").agg(F.collect_list(F.struct("count", "size_factor")).alias("x"))  # a sample's row each

    @F.pandas_udf("double")
    def fitted(y, s):
        import pandas as pd

        return pd.Series([dispersion(a, b) for a, b in zip(y, s)], dtype=float)

    return rows.select("gene", "m", fitted(F.col("x.count"), F.col("x.size_factor")).alias("d"))


def trend(fits: DataFrame) -> tuple[float, float] | None:
    """(a0, a1) of a0 + a1 / mean: a gamma model with identity link, without genes far from it, fitted on sums that Spark computes.

    None where it has no such fit: a coefficient is not positive, or 50 steps do not settle it.
    """
    g = fits.filter(F.col("d") > 100 * LEAST_DISPERSION).select((1 / F.col("m")).alias("i"), "d").persist()
    a0, a1 = 0.1, 1.0
    try:
        for _ in range(50):
            fit = F.lit(a0) + F.lit(a1) * F.col("i")
            w = 1 / (fit * fit)
            use = g.filter((F.col("d") / fit > 1e-4) & (F.col("d") / fit < 15))
            s = use.agg(F.sum(w), F.sum(w * F.col("i")), F.sum(w * F.col("i") * F.col("i")), F.sum(w * F.col("d")), F.sum(w * F.col("i") * F.col("d"))).first()
            if s[0] is None:
                return None
            det = s[0] * s[2] - s[1] * s[1]
            if abs(det) <= 1e-12 * s[0] * s[2]:
                return None
            b0, b1 = (s[3] * s[2] - s[4] * s[1]) / det, (s[0] * s[4] - s[1] * s[3]) / det
            if b0 <= 0 or b1 <= 0:
                return None
            settled = math.log(b0 / a0) ** 2 + math.log(b1 / a1) ** 2 < 1e-6
            a0, a1 = b0, b1
            if settled:
                return a0, a1
        return None
    finally:
        g.unpersist()


SPAN, KNOTS = 0.7, 200  # share of the genes in a local fit; places where fits are taken


def local_trend(m: np.ndarray, d: np.ndarray, span: float = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(log means, log dispersions): local quadratic regression of the logarithms, tricube weights over the nearest share of genes, times the means."""
    fine = d > 100 * LEAST_DISPERSION
    x, y, mass = np.log(m[fine]), np.log(d[fine]), m[fine]
    if not len(x):
        return np.zeros(1), np.full(1, math.log(LEAST_DISPERSION))
    at = np.linspace(x.min(), x.max(), KNOTS)
    k = max(min(len(x), 4), math.ceil(span * len(x)))
    out = np.empty(KNOTS)
    for i, c in enumerate(at):
        far = np.abs(x - c)
        reach = max(np.partition(far, k - 1)[k - 1], 1e-9) * 1.000001
        w = np.sqrt(np.clip(1 - (far / reach) ** 3, 0, None) ** 3 * mass)
        design = np.stack([np.ones(len(x)), x - c, (x - c) ** 2], 1) * w[:, None]
        out[i] = np.linalg.lstsq(design, y * w, rcond=None)[0][0]
    return at, out


def stabiliser(at: np.ndarray, logs: np.ndarray, noise: float, top: float, high: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(asinh of counts, values): the integral of 1 / sqrt(variance) for a dispersion given by knots, scaled to meet log2 at two high means.

    ``noise``: the mean of 1 / size factor, ``top``: the largest normalised count.
    """
    q = np.sinh(np.linspace(0, math.asinh(top), 2001))[1:]
    rate = 1 / np.sqrt(np.exp(np.interp(np.log(q), at, logs)) * q * q + noise * q)
    area = np.concatenate(([0], np.cumsum(np.diff(q) * (rate[1:] + rate[:-1]) / 2)))
    grid = np.arcsinh(q)
    low, up = (np.interp(math.asinh(h), grid, area) for h in high)
    scale = (math.log2(high[1]) - math.log2(high[0])) / (up - low) if up > low else 1.0
    return grid, scale * area + math.log2(high[0]) - scale * low


def vst(counts: DataFrame) -> DataFrame:
    """(gene, sample_id, value): variance-stabilised log2 values.

    Dispersions by adjusted profile likelihood, their trend over the mean, and the closed form for that trend. Where the trend has no parametric fit, it is
    a local regression, and the transformation is its integral over a grid. Written from the published method; not compared with its published
    implementation, which is not at hand. The counts are written once: factors, dispersions and values all read them.
    """
    counts = keep(counts, "counts")
    x = keep(counts.join(size_factors(counts), "sample_id"), "normalised")
    fits = dispersions(x)
    with scope(counts.sparkSession):
        fits = keep(fits, "dispersions")
        found = trend(fits)
        knots = None if found else _local(fits)  # a row a gene that is fitted
    q = F.col("count") / F.col("size_factor")
    if found:
        a0, a1 = found
        value = F.log2((1 + a1 + 2 * a0 * q + 2 * F.sqrt(a0 * q * (1 + a1 + a0 * q))) / (4 * a0))
        return x.select("gene", "sample_id", value.alias("value"))
    warnings.warn("the dispersions have no parametric trend; a local regression is used", stacklevel=2)
    means = x.groupBy("gene").agg(F.avg(q).alias("m"))
    high = means.filter("m > 0").agg(F.percentile("m", 0.95), F.percentile("m", 0.999)).first()
    side = x.agg(F.max(q).alias("top")).first()[0], x.select("sample_id", "size_factor").distinct().agg(F.avg(1 / F.col("size_factor"))).first()[0]
    if high[0] is None:
        return x.select("gene", "sample_id", F.lit(None).cast("double").alias("value"))
    grid, values = stabiliser(*knots, side[1], max(side[0], high[1]), (high[0], max(high[1], high[0] * 1.001)))

    @F.pandas_udf("double")
    def on_curve(y):
        import pandas as pd

        return pd.Series(np.interp(np.arcsinh(y.to_numpy(float)), grid, values))

    return x.select("gene", "sample_id", on_curve(q).alias("value"))


def _local(fits: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = fits.select("m", "d").toPandas().sort_values(["m", "d"])
    return local_trend(rows["m"].to_numpy(float), rows["d"].to_numpy(float))
