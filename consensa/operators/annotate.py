"""Dimension tables and the joins that attach them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import blank_key, collapse_ordered, collapse_sorted, median, null_if_blank, strip_version, trim_blanks, upper_key
from ..functions.tables import keep


# dimensions ---------------------------------------------------------------------------------------
def essentiality(wide: DataFrame, index: str | None = None) -> DataFrame:
    """(gene, entrez_id, median) per column 'SYMBOL (ID)' of a cell-line matrix; the index column is dropped."""
    genes = [c for c in wide.columns if c != index]
    return essentiality_cells(wide.unpivot([], [F.col(f"`{c}`").cast("double").alias(c) for c in genes], "label", "score"))


def essentiality_cells(long: DataFrame) -> DataFrame:
    """``essentiality`` from cells (label, score): for matrices of thousands of columns, see ``readers.cells``."""
    one = long.groupBy("label").agg(median("score").alias("median_score"))
    part = lambda i: F.regexp_extract("label", r"^(.*?) \((.*)\)$", i)
    return one.select(F.when(part(1) != "", part(1)).otherwise(F.col("label")).alias("gene"), F.nullif(part(2), F.lit("")).alias("entrez_id"), "median_score")


def drivers(compendium: DataFrame) -> DataFrame:
    """One row a symbol: sorted distinct roles, transcripts, cohorts and cancer types of act/LoF rows."""
    role = F.lower("role")
    kept = compendium.filter(role.contains("act") | role.contains("lof"))
    return kept.groupBy("symbol").agg(*[collapse_sorted(c).alias(c) for c in ("role", "transcript", "cohort", "cancer_type")])


def by_key(rows: DataFrame, dim: DataFrame, gene: str, key: str, take: dict[str, str]) -> DataFrame:
    """Left join on upper-cased, trimmed keys (null meets null); ``take`` renames the dimension's columns."""
    d = dim.select(upper_key(key).alias("_k"), *[F.col(c).alias(n) for c, n in take.items()])
    return rows.withColumn("_g", upper_key(gene)).join(d, F.col("_g").eqNullSafe(F.col("_k")), "left").drop("_g", "_k")


def essentiality_rows(dim: DataFrame, gene: str = "gene") -> DataFrame:
    """Usable rows of the dimension: a gene that is not blank and not the leaked index name."""
    return dim.filter(null_if_blank(gene).isNotNull() & (F.col(gene) != "V1"))


# metrics ------------------------------------------------------------------------------------------
# The usual names of a metric table's id column.
GENE_COLUMNS = ("gene", "Gene", "ensembl_gene_id", "gene_id")


def gene_column(df: DataFrame) -> str:
    """The id column of a metric table, under any of its usual names; else the first."""
    return next(c for c in (*GENE_COLUMNS, df.columns[0]) if c in df.columns)


def combine_metrics(metrics: dict[str, DataFrame | None], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One row a gene with every metric: the union of the long tables and one aggregate, not a chain of outer joins.

    Ids lose their version; several values of a gene become their median. A metric whose table is None is null.
    """
    long = None
    for name, df in metrics.items():
        if df is None:
            continue
        part = df.select(*keys, strip_version(gene_column(df)).alias("gene"), F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    if long is None:
        raise ValueError("no metric table at all")
    return long.groupBy(*keys, "gene").agg(*[median(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def symbols(gene_map: DataFrame) -> DataFrame:
    """(gene, symbol) from a dictionary (gene_id, symbol): of an id's symbols the one with the least ``ordinal`` (a column of the dictionary's order), else the least."""
    place = F.col("ordinal") if "ordinal" in gene_map.columns else F.lit(0)
    named = gene_map.filter(null_if_blank("symbol").isNotNull())
    return named.groupBy(strip_version("gene_id").alias("gene")).agg(F.min_by("symbol", F.struct(place, "symbol")).alias("symbol"))


def to_symbols(table: DataFrame, gene_map: DataFrame | Sequence[DataFrame | None], metrics: Sequence[str], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Genes become symbols, by the first of the dictionaries that is there; medians where ids share one; genes without a symbol go."""
    given = gene_map if isinstance(gene_map, DataFrame) else next(m for m in gene_map if m is not None)
    return table.join(symbols(given), "gene").groupBy(*keys, "symbol").agg(*[median(m).alias(m) for m in metrics])


def attach_metrics(rows: DataFrame, by_symbol: DataFrame, gene: str = "gene_name", keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Left join on the exact symbol (case and blanks count)."""
    return rows.join(by_symbol.withColumnRenamed("symbol", gene), [*keys, gene], "left")


# ontology terms and gene sets ---------------------------------------------------------------------
EVIDENCE = ("EXP", "IDA", "IMP", "IPI", "IGI", "IEP", "TAS", "IC")  # fixed values: experimental evidence codes


def annotated_genes(gaf: DataFrame, ids: DataFrame, strict_not: bool = False) -> DataFrame:
    """Genes with an accepted evidence code for one of ``ids`` (go_id); 'NOT' is excluded as an exact qualifier, or anywhere if strict."""
    q = F.coalesce("qualifier", F.lit(""))
    allowed = ~F.array_contains(F.split(q, r"\|"), "NOT") if strict_not else q != "NOT"
    return gaf.filter(F.col("evidence").isin(*EVIDENCE) & allowed).join(ids.select("go_id").distinct(), "go_id", "left_semi").select("gene").distinct()


def go_terms(annotations: DataFrame, names: DataFrame, drop_iea: bool = False) -> DataFrame:
    """One row a gene: go_mf, go_bp, go_cc, each the sorted distinct term names, null if there are none."""
    x = annotations
    if drop_iea:
        x = x.filter(F.col("evidence").isNull() | (F.col("evidence") != "IEA"))
    x = x.join(names, "go_id", "left")
    return x.groupBy("gene").agg(*[F.nullif(
        collapse_sorted(F.when(F.col("ontology") == o, F.col("term"))), F.lit(""),
    ).alias(f"go_{o.lower()}") for o in ("MF", "BP", "CC")])


def hallmarks(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """(gene, hallmark) by case-insensitive symbol, sets sorted and joined."""
    x = genes.select("gene").distinct().withColumn("_k", F.upper("gene"))
    y = sets.select(F.upper("gene").alias("_k"), "set_name").distinct()
    return x.join(y, "_k").groupBy("gene").agg(collapse_sorted("set_name").alias("hallmark"))


# allele frequencies -------------------------------------------------------------------------------
# Spellings of a class's number, and of the word before it.
CLASS_NUMBERS = {"I": ("i", "1"), "II": ("ii", "2")}
CLASS_WORDS = ("mhc class ", "class ", "mhc", "mhc ")


def class_of(x: Column | str) -> Column:
    """'I' or 'II' from the many spellings of the class, else the trimmed text itself."""
    raw = trim_blanks(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    t = F.regexp_replace(F.lower(raw), "[_-]", " ")
    said = {k: t.isin(*numbers, *(w + numbers[0] for w in CLASS_WORDS)) for k, numbers in CLASS_NUMBERS.items()}
    one = said["I"] | (~said["II"] & t.contains("class i") & ~t.contains("ii"))
    two = said["II"] | t.contains("class ii") | t.contains("mhcii")
    return F.when(one, "I").when(two, "II").otherwise(raw)


def attach_values(
    rows: DataFrame, source: DataFrame, keys: Sequence[tuple[str, str]], values: dict[str, str], order: str, normal: dict | None = None,
    require: bool = True,
) -> DataFrame:
    """Left join on normalised keys (blank meets blank) to values collapsed in first-seen order, so rows never fan out."""
    missing = [b for _, b in keys if b not in source.columns] + [v for v in values if v not in source.columns]
    if missing and require:
        raise ValueError(f"columns missing: {missing}")
    norm = lambda name, c: (normal or {}).get(name, blank_key)(c)
    ks = [f"_k{i}" for i in range(len(keys))]
    right = source.select(*[norm(a, b).alias(k) for k, (a, b) in zip(ks, keys)], F.col(order).alias("_o"), *[F.col(f"`{v}`") for v in values])
    # each value with its first place before any list is made, so that lists hold distinct values alone; written, so that the join knows its size
    each = F.array(*[F.struct(F.lit(i).alias("_i"), trim_blanks(F.col(v).cast("string")).alias("_v")) for i, v in enumerate(f"`{v}`" for v in values)])
    seen = right.select(*ks, "_o", F.inline(each)).filter("_v is not null and _v <> '' and lower(_v) <> 'nan'").groupBy(*ks, "_i", "_v")
    seen = seen.agg(F.when(F.bool_or(F.col("_o").isNull()), None).otherwise(F.min("_o")).alias("_o"))
    right = keep(seen.groupBy(*ks).agg(*[collapse_ordered(F.when(F.col("_i") == i, F.col("_v")), "_o").alias(n) for i, n in enumerate(values.values())]), "values")
    left = rows.select("*", *[norm(a, a).alias(k) for k, (a, _) in zip(ks, keys)])
    return left.join(right, ks, "left").drop(*ks)


def value_counts(rows: DataFrame, value: str = "tumor_dna_vaf", keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(keys, rows, with_value, somatic): what a run reports of its table."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count(value).alias("with_value"),
        F.count_if(F.coalesce(F.lower("mutation_source"), F.lit("")).contains("somatic")).alias("somatic"),
    )


# HLA ----------------------------------------------------------------------------------------------
def allele_keys(allele: Column | str) -> Column:
    """Gene keys of an allele: 'HLA-A*02:01' -> [A]; 'DQA1*01:01-DQB1*02:01' -> [DQA1, DQB1]."""
    a = F.col(allele) if isinstance(allele, str) else allele
    keys = F.transform(F.split(trim_blanks(a), "-"), lambda p: F.regexp_extract(p, r"^([A-Z0-9]+)\*", 1))
    return F.filter(keys, lambda k: k != "")


def hla_tpm(rows: DataFrame, allele: str, by_gene: Column) -> DataFrame:
    """``rows`` with hla_tpm (least TPM of the allele's chains) and hla_tpm_detail ('A: TPM=12.5; count=3; rel=0.1', chains joined).

    ``by_gene``: map gene -> [TPM, count, rel], as text; a list of two is [count, rel], and a shorter one has nothing. What is absent reads None.
    """
    known = F.filter(allele_keys(allele), lambda k: F.map_contains_key(by_gene, k))

    def part(k: Column, from_end: int) -> Column:
        values = by_gene[k]
        there = F.size(values) >= (3 if from_end == 3 else 2)
        at = F.when(F.size(values) == 2, 3 - from_end).otherwise(4 - from_end)
        return F.when(there, F.element_at(values, at.cast("int")).cast("string"))

    said = lambda k, n: F.coalesce(part(k, n), F.lit("None"))
    detail = lambda k: F.concat(k, F.lit(": TPM="), said(k, 3), F.lit("; count="), said(k, 2), F.lit("; rel="), said(k, 1))
    least = F.array_min(F.transform(known, lambda k: part(k, 3).try_cast("double")))
    return rows.withColumn("hla_tpm", least).withColumn("hla_tpm_detail", F.concat_ws("; ", F.transform(known, detail)))


def hla_format(genotype: Column, with_prefix: bool = True) -> Column:
    """Comma-joined alleles of a map locus -> alleles: two fields, 'HLA-' ahead unless they start with D."""
    two = lambda a: F.array_join(F.slice(F.split(a, ":"), 1, 2), ":")
    named = lambda a: F.when(a.startswith("D"), two(a)).otherwise(F.concat(F.lit("HLA-"), two(a)))
    loci = F.array_sort(F.map_keys(genotype))
    return F.array_join(F.transform(F.flatten(F.transform(loci, lambda k: genotype[k])), named), ",")


def insert_after(df: DataFrame, anchor: str, new: Sequence[str]) -> DataFrame:
    """``new`` columns moved behind ``anchor``; to the end if it is absent."""
    rest = [c for c in df.columns if c not in new]
    at = rest.index(anchor) + 1 if anchor in rest else len(rest)
    return df.select(*[F.col(f"`{c}`") for c in [*rest[:at], *new, *rest[at:]]])


def sequence_windows(rows: DataFrame, sequence: str, lengths: Sequence[int]) -> DataFrame:
    """One row for each substring of each of ``lengths``: k, pos (from 0), kmer."""
    x = rows.withColumn("k", F.explode(F.array(*map(F.lit, lengths)))).filter(F.length(sequence) >= F.col("k"))
    x = x.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length(sequence) - F.col("k"))))
    return x.withColumn("kmer", F.substring(F.col(sequence), F.col("pos") + 1, F.col("k")))

