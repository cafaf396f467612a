"""Variant tables: hard filters as named tags, type selection, concatenation, order, combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the site and genotype filters (name, field, comparison, bound).
SNP = (
    ("QD2", "QD", "<", 2.0), ("FS60", "FS", ">", 60.0), ("MQ40", "MQ", "<", 40.0), ("SOR4", "SOR", ">", 4.0),
    ("MQRankSum-12.5", "MQRankSum", "<", -12.5), ("ReadPosRankSum-8", "ReadPosRankSum", "<", -8.0),
)
INDEL = (("QD2", "QD", "<", 2.0), ("FS200", "FS", ">", 200.0), ("SOR10", "SOR", ">", 10.0))
GENOTYPE = (("LowDP", "DP", "<", 10.0), ("LowGQ", "GQ", "<", 10.0))


def tags(rules: Sequence[tuple]) -> Column:
    """Array of the names of failed rules; a null field fails none."""
    test = lambda f, op, x: F.col(f) < x if op == "<" else F.col(f) > x
    return F.array_compact(F.array(*[F.when(test(f, op, x), F.lit(name)) for name, f, op, x in rules]))


def hard_filter(rows: DataFrame, site: Sequence[tuple], genotype: Sequence[tuple] = GENOTYPE) -> DataFrame:
    """``rows`` with filter and ft: failed names joined by ';', or PASS."""
    said = lambda t: F.when(F.size(t) == 0, "PASS").otherwise(F.concat_ws(";", t))
    return rows.withColumn("filter", said(tags(site))).withColumn("ft", said(tags(genotype)))


def passing(rows: DataFrame) -> DataFrame:
    """Sites that pass; genotype tags do not count."""
    return rows.filter(F.col("filter") == "PASS")


def is_snp() -> Column:
    return (F.length("ref") == 1) & (F.length("alt") == 1)


def select_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(is_snp() if kind == "SNP" else ~is_snp())


def concat_sorted(frames: Sequence[DataFrame], contigs: DataFrame | None = None) -> DataFrame:
    """Union in coordinate order; ``contigs`` (chrom, contig_rank) gives dictionary order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if contigs is None:
        return out.orderBy("chrom", "pos", "ref", "alt")
    return out.join(contigs, "chrom", "left").orderBy(F.col("contig_rank").asc_nulls_last(), "pos", "ref", "alt").drop("contig_rank")


def combine(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full outer by (chrom, pos, ref, alt): the first table's values before the second's."""
    key = ["chrom", "pos", "ref", "alt"]
    a = first.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_first"))
    b = second.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_second"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return a.join(b, key, "outer").select(
        *key, *[F.when(F.col("in_first"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in columns], flag("in_first"),
        flag("in_second"),
    )


def restrict(rows: DataFrame, intervals: DataFrame, width: int = 10_000) -> DataFrame:
    """Rows inside an interval (chrom, start, stop; start excluded, stop included, as in BED), by equi-join on bins of ``width``."""
    bins = intervals.withColumn("bin", F.explode(F.sequence(F.expr(f"(start + 1) div {width}"), F.expr(f"stop div {width}"))))
    inside = (F.col("pos") > F.col("start")) & (F.col("pos") <= F.col("stop"))
    x = rows.withColumn("bin", F.expr(f"pos div {width}"))
    iv = bins.select(F.col("chrom").alias("_c"), F.col("bin").alias("_b"), "start", "stop")
    return x.join(iv, (F.col("chrom") == F.col("_c")) & (F.col("bin") == F.col("_b")) & inside, "left_semi").drop("bin")


# The calling modes.
MODES = ("all_intervals", "WGS", "WES")


def in_mode(rows: DataFrame, mode: str, wgs: DataFrame | None = None, wes: DataFrame | None = None, width: int = 10_000) -> DataFrame:
    """``rows`` of the intervals that a mode calls: all of them, the genome's list, or the exome's where one is given."""
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")
    if mode == "WGS" and wgs is None:
        raise ValueError("mode WGS needs its intervals")
    chosen = {"all_intervals": None, "WGS": wgs, "WES": wes}[mode]
    return rows if chosen is None else restrict(rows, chosen, width)


def single_sample(rows: DataFrame, sample: str) -> DataFrame:
    return rows.filter(F.col("sample_id") == sample)


def rename_sample(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumn("sample_id", F.when(F.col("sample_id") == old, F.lit(new)).otherwise(F.col("sample_id")))


def attach_expression(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Left join of transcript abundance, by version-less transcript id."""
    t = transcripts.groupBy(F.regexp_replace("transcript", r"\..*$", "").alias("_t")).agg(F.sum("tpm").alias("tpm"))
    return rows.withColumn("_t", F.regexp_replace("transcript", r"\..*$", "")).join(t, "_t", "left").drop("_t")
