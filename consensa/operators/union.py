"""Canonical projection of the candidate sources, and their union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import to_double, to_int

STANDARD = ["gene_name", "hla_allele", "peptide_length", "mt_epitope_seq", "wt_epitope_seq", "median_mt_ic50", "mutation_source", "hla_class", "fusion_genes"]
# Display names at the sink.
DISPLAY = dict(zip(
    STANDARD,
    ["Gene.Name", "HLA.Allele", "Peptide.Length", "MT.Epitope.Seq", "WT.Epitope.Seq", "Median.MT.IC50.Score", "Mutation.Source", "HLA.Class", "Fusion_Genes"],
))


#: Column of a row's place in its file (``readers.placed``).
PLACE = "_place"


def column_or_null(df: DataFrame, name: str | None):
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def first_present(df: DataFrame, name: str) -> str | None:
    """The first spelling of ``name`` that exists: as given, or with '_', '.', '-' or ' ' for one another."""
    for sep in "_.- ":
        for option in (name, *(name.replace(a, sep) for a in "_.- ")):
            if option in df.columns:
                return option
    return None


def project(df: DataFrame, columns: Sequence[str], source: str, hla_class: str, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One source in the standard columns, then its configured extras.

    ``columns``: the configured names in order: gene, allele, length, sequence, [wild-type sequence for
    'Somatic'], ic50, extras. For 'Fusion' the gene is split at '_' into one row a partner. ``PLACE``, if there, is kept.
    """
    somatic = source == "Somatic"
    need = 6 if somatic else 5
    names = list(columns[:need])
    if not somatic:
        names.insert(4, None)
    gene, allele, length, seq, wild, ic50 = (column_or_null(df, n) for n in names)
    extras = [c for c in columns[need:] if c in df.columns and c not in STANDARD and c not in keys]
    place = [PLACE] if PLACE in df.columns else []
    x = df.select(
        *keys, *place, gene.alias("_gene"), allele.cast("string").alias("hla_allele"), to_int(length).alias("_len"),
        seq.cast("string").alias("mt_epitope_seq"), wild.cast("string").alias("wt_epitope_seq"), to_double(ic50).alias("median_mt_ic50"),
        *[F.col(f"`{c}`") for c in extras]
    )
    if not somatic:  # a source without any length gets the sequences' lengths
        some = x.filter("_len is not null").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_some")).distinct()
        same = reduce(lambda a, b: a & b, [x[k].eqNullSafe(some[f"_k{i}"]) for i, k in enumerate(keys)])
        x = x.join(F.broadcast(some), same, "left")  # a row a sample
        x = x.withColumn("_len", F.when(F.col("_some"), F.col("_len")).otherwise(F.length("mt_epitope_seq")))
    fused = F.col("_gene") if source == "Fusion" else F.lit(None)
    x = x.withColumn("fusion_genes", fused.cast("string")).withColumn("peptide_length", F.col("_len"))
    x = x.withColumn("gene_name", F.explode_outer(F.split("_gene", "_")) if source == "Fusion" else F.col("_gene").cast("string"))
    x = x.withColumn("mutation_source", F.lit(source)).withColumn("hla_class", F.lit(hla_class))
    return x.select(*keys, *STANDARD, *[F.col(f"`{c}`") for c in extras], *place)


def merge(frames: Sequence[DataFrame], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Union of heterogeneous frames (absent columns null), distinct rows, standard columns first.

    Where every frame has ``PLACE``, the result has it too: the first frame and place of each row.
    """
    placed = all(PLACE in f.columns for f in frames)
    out = None
    for at, f in enumerate(frames):
        f = f.withColumn(PLACE, F.struct(F.lit(at).alias("frame"), F.col(PLACE).alias("place"))) if placed else f.drop(PLACE)
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    extras = [c for c in out.columns if c not in STANDARD and c not in keys and c != PLACE]
    columns = [*keys, *STANDARD, *extras]
    if placed:
        return out.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(PLACE).alias(PLACE))
    return out.select(*[F.col(f"`{c}`") for c in columns]).dropDuplicates()


def merged_order(df: DataFrame):
    """The order of the merged table as one sortable column: class, gene, nulls last, then the place read."""
    place = [F.col(PLACE)] if PLACE in df.columns else []
    return F.struct(F.col("hla_class").isNull(), "hla_class", F.col("gene_name").isNull(), "gene_name", *place)


def presented(df: DataFrame) -> DataFrame:
    """Sorted by class and gene, nulls last."""
    return df.orderBy(F.col("hla_class").asc_nulls_last(), F.col("gene_name").asc_nulls_last())
