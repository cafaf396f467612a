"""Weighted Borda consensus per sample.

Each feature ranks its finite values inside a sample; points are (n - rank) / (n - 1), or 1 for n <= 1. The score
is the weighted sum of points, folded in the order of the configuration so that equal inputs give equal doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import is_finite, signif
from ..functions.tables import keep, scope
from .config import BordaConfig


def ranks(values: DataFrame) -> DataFrame:
    """(_s, _f, _v, _low, _alike, _n) for each distinct value of (_s sample, _f feature, _v value): its least ascending rank, its rows, and the feature's rows.

    Values are counted first and dealt over ranges, and a range is numbered by itself after the sums of those before it: no sample is sorted in one task.
    """
    with scope(values.sparkSession) as own:
        counted = values.filter("_v is not null").groupBy("_s", "_f", "_v").agg(F.count("*").alias("_alike"))
        dealt = keep(counted.repartitionByRange("_f", "_s", "_v").withColumn("_range", F.spark_partition_id()), "values")
        sums = dealt.groupBy("_s", "_f", "_range").agg(F.sum("_alike").alias("_rows"))  # a row a sample, feature and range
        every = W.partitionBy("_s", "_f")
        sums = sums.withColumn("_before", F.sum("_rows").over(every.orderBy("_range")) - F.col("_rows")).withColumn("_n", F.sum("_rows").over(every))
        sums = sums.select(F.col("_s").alias("_s1"), F.col("_f").alias("_f1"), F.col("_range").alias("_r1"), "_before", "_n")
        inside = F.sum("_alike").over(W.partitionBy("_s", "_f", "_range").orderBy("_v")) - F.col("_alike")
        x = dealt.withColumn("_inside", inside)
        x = x.join(sums, x["_s"].eqNullSafe(F.col("_s1")) & (x["_f"] == F.col("_f1")) & (x["_range"] == F.col("_r1")))
        out = keep(x.select("_s", "_f", "_v", (F.col("_before") + F.col("_inside") + 1).alias("_low"), "_alike", "_n"), "ranks")
        own.spare(out)
    return out


def ranked(rows: DataFrame, table: DataFrame, feature: int, value: str, ties: str, sample: str, row: str, seed: int = 1) -> DataFrame:
    """``rows`` with _n (the sample's values of the feature) and _r (rank under a tie policy), null where the value is; ``row`` is the input order."""
    t = table.filter(F.col("_f") == feature).drop("_f")
    x = rows.join(t, rows[sample].eqNullSafe(t["_s"]) & (rows[value] == t["_v"]), "left").drop("_s", "_v")
    low, alike = F.col("_low").cast("double"), F.col("_alike")
    if ties in ("first", "random"):  # inside the rows of one value; rows without one are dealt by themselves
        order = [F.col(row)] if ties == "first" else [F.xxhash64(F.col(row), F.lit(seed)), F.col(row)]
        apart = F.when(F.col(value).isNull(), F.xxhash64(F.col(row)))
        extra = (F.row_number().over(W.partitionBy(sample, value, apart).orderBy(*order)) - 1).cast("double")
    else:
        extra = {"min": F.lit(0.0), "max": (alike - 1).cast("double"), "average": (alike - 1) / F.lit(2.0)}[ties]
    return x.withColumn("_r", low + extra).drop("_low", "_alike")


def consensus(rows: DataFrame, cfg: BordaConfig, sample: str = "sample_id", row: str = "row_id") -> DataFrame:
    """``rows`` with Borda_Score (rounded to significant digits) and Borda_Rank. They are written once, since counts and ranks are taken of them."""
    total = sum(f.weight for f in cfg.features)
    found = [(f, c) for f, c in cfg.resolve(rows.columns) if c is not None]
    x, scored = keep(rows, "rows"), []
    for i, (f, c) in enumerate(found):
        v = F.col(f"`{c}`").try_cast("double")
        x = x.withColumn(f"_v{i}", F.when(is_finite(v), v if f.direction == "lower_better" else -v))
    if found:
        each = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"_v{i}").alias("_v")) for i in range(len(found))])
        table = ranks(x.select(F.col(sample).alias("_s"), F.inline(each)))
    for i, (f, _) in enumerate(found):
        x = ranked(x, table, i, f"_v{i}", cfg.ties, sample, row, cfg.seed)
        n, r = F.col("_n"), F.col("_r")
        points = F.when(n <= 1, F.lit(1.0)).otherwise((n - r) / (n - 1).cast("double"))
        x = x.withColumn(f"_p{i}", F.when(F.col(f"_v{i}").isNotNull(), points)).drop("_n", "_r")
        scored.append((F.lit(f.weight / total), F.col(f"_p{i}")))
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    mass = add([w * F.coalesce(p, F.lit(0.0)) for w, p in scored])
    if cfg.na_policy == "ignore":
        there = add([F.when(p.isNotNull(), w).otherwise(0.0) for w, p in scored])
        score = F.when(there > 0, mass / there).otherwise(0.0)
    else:
        score = mass
        if cfg.na_policy == "drop" and scored:
            x = x.filter(reduce(lambda a, b: a & b, [p.isNotNull() for _, p in scored]))
    x = x.withColumn("_score", score).withColumn("_minus", -F.col("_score"))
    x = ranked(x, ranks(x.select(F.col(sample).alias("_s"), F.lit(0).alias("_f"), F.col("_minus").alias("_v"))), 0, "_minus", cfg.ties, sample, row, cfg.seed)
    return x.withColumn("Borda_Rank", F.col("_r")).withColumn("Borda_Score", signif("_score", cfg.digits)).select(*rows.columns, "Borda_Score", "Borda_Rank")
