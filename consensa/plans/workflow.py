"""The two workflows as single plans over all samples: candidate prioritisation and sample networks.

Nothing is written between steps but what iterative graph steps need; the sample is a column, so one job serves
the cohort, and a sink partitioned by ``sample_id`` replaces single samples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import null_if_blank
from ..functions.session import prepare
from ..functions.tables import keep, parts, scope
from ..operators import annotate, borda, expression, graph_kernels, lioness, network, ontology, similarity, union
from ..operators.config import BordaConfig, FilterConfig
from ..sources import readers

#: (source, class) of the six optional predictor outputs of a sample.
SOURCES = [(s, c) for s in ("Somatic", "Fusion", "Splice Variant") for c in ("MHC Class I", "MHC Class II")]
METRICS = ("betweenness", "degree", "strength", "largest_component_impact", "wci")
NAMES = {"betweenness": "Net_Betweenness", "degree": "Net_Degree", "strength": "Net_Strength", "largest_component_impact": "Net_Impact", "wci": "Net_WCI"}


@dataclass
class Dimensions:
    """Annotation tables; those that are None add null columns or nothing."""

    essentiality: DataFrame | None = None  # gene, median_score
    drivers: DataFrame | None = None  # symbol, role, cohort, cancer_type
    gene_map: DataFrame | None = None  # gene_id, symbol, optional ordinal
    other_gene_map: DataFrame | None = None  # taken where there is no gene_map
    metrics: dict[str, DataFrame | None] = field(default_factory=dict)  # sample_id, gene, metric
    go: DataFrame | None = None  # gene, go_id, ontology, evidence
    go_names: DataFrame | None = None  # go_id, term
    gene_sets: DataFrame | None = None  # set_name, gene
    hla_expression: DataFrame | None = None  # sample_id, m: map<string, array<string>>
    allele_tables: DataFrame | None = None  # sample_id, keys and Tumor DNA columns; _order or _place for the order of values


def read_candidates(spark: SparkSession, paths: dict[tuple[str, str, str], str | None], columns: dict[str, list[str]]) -> DataFrame:
    """``paths``: (sample, source, class) -> TSV path or None; ``columns``: source -> configured names. Absent and empty files are empty."""
    frames = []
    for (sample, source, hla_class), path in sorted(paths.items()):
        kind = ", ".join(f"`{c}` string" for c in columns[source])
        raw = readers.tolerant(spark, path, kind, place=True).withColumn("sample_id", F.lit(sample))
        frames.append(union.project(raw, columns[source], source, hla_class))
    return union.merge(frames)


def prioritise(candidates: DataFrame, dims: Dimensions, cfg: BordaConfig, vaf_keys: list[tuple[str, str]] | None = None) -> DataFrame:
    """Candidates annotated, ranked per sample, and in the order of presentation.

    Annotation tables are written before they are joined: Spark sees their size, and rows are not dealt by a sample or a gene to meet a small one.
    """
    prepare(candidates.sparkSession)
    x = candidates
    if dims.essentiality is not None:
        x = annotate.by_key(x, keep(annotate.essentiality_rows(dims.essentiality), "essentiality"), "gene_name", "gene", {"median_score": "Depmap_survivability_score"})
    if dims.drivers is not None:
        x = annotate.by_key(
            x, keep(dims.drivers, "drivers"), "gene_name", "symbol",
            {"role": "Intogen_Driver_role", "cohort": "Intogen_Cohort", "cancer_type": "Intogen_CancerType"},
        )
    maps = [m for m in (dims.gene_map, dims.other_gene_map) if m is not None]
    if any(d is not None for d in dims.metrics.values()) and maps:
        table = annotate.combine_metrics({m: dims.metrics.get(m) for m in METRICS})
        x = annotate.attach_metrics(x, keep(annotate.to_symbols(table, maps, METRICS), "metrics"))
    else:
        for m in METRICS:
            x = x.withColumn(m, F.lit(None).cast("double"))
    for m, n in NAMES.items():
        x = x.withColumnRenamed(m, n)
    x = borda.consensus(x.withColumn("row_id", union.merged_order(x)), cfg)
    if dims.go is not None and dims.go_names is not None:
        x = x.join(keep(annotate.go_terms(dims.go, dims.go_names).withColumnRenamed("gene", "gene_name"), "terms"), "gene_name", "left")
    if dims.gene_sets is not None:
        sets = annotate.hallmarks(x.select(F.col("gene_name").alias("gene")), dims.gene_sets).withColumnRenamed("gene", "gene_name")
        x = x.join(keep(sets, "sets"), "gene_name", "left")
    if dims.hla_expression is not None:
        names = x.columns
        x = annotate.hla_tpm(x.join(keep(dims.hla_expression.withColumnRenamed("m", "_m"), "hla"), "sample_id", "left"), "hla_allele", F.col("_m"))
        x = annotate.insert_after(x.select(*names, "hla_tpm", "hla_tpm_detail"), "hla_allele", ["hla_tpm"])
    if dims.allele_tables is not None and vaf_keys:
        t = dims.allele_tables
        order = next((c for c in ("_order", "_place") if c in t.columns), None)
        if order is None:  # no order is known: that of the values
            t, order = t.withColumn("_order", F.struct(*[F.col(f"`{c}`") for c in sorted(t.columns)])), "_order"
        x = annotate.attach_values(
            x, t, [("sample_id", "sample_id"), *vaf_keys], {"Tumor DNA Depth": "tumor_dna_depth", "Tumor DNA VAF": "tumor_dna_vaf"}, order,
            {"hla_class": annotate.class_of},
        )
    first = ["sample_id", *union.STANDARD]
    x = x.orderBy("sample_id", F.col("Borda_Rank").asc_nulls_last(), F.col("Borda_Score").desc_nulls_last(), "row_id")
    return x.select(*first, *[F.col(f"`{c}`") for c in x.columns if c not in (*first, "row_id", union.PLACE)])


@dataclass
class ReferenceNetwork:
    edges: DataFrame  # edge_id, src, dst; parallel edges stay
    membrane: DataFrame  # gene
    combined: DataFrame  # gene: of the network or the membrane
    absent: DataFrame  # gene: of the membrane, not of the network


def reference_network(
    ontology_relation: DataFrame, roots: DataFrame, annotations: DataFrame, symbol_ids: DataFrame, interactions: DataFrame, entrez_ids: DataFrame, strict_not: bool = False,
) -> ReferenceNetwork:
    """The gene network and the membrane genes, from an ontology (parent, child) below ``roots`` (id), an annotation file (gene, go_id, evidence,
    qualifier), symbols (symbol, ensembl), interactions (id1, id2, ...) and their ids (entrez, ensembl).

    Edges are numbered as they are stored.
    """
    terms = ontology.descendants(ontology_relation, roots).withColumnRenamed("id", "go_id")
    genes = annotate.annotated_genes(annotations, terms, strict_not).withColumnRenamed("gene", "symbol")
    membrane = symbol_ids.join(genes, "symbol", "left_semi").filter("ensembl is not null").select(F.col("ensembl").alias("gene")).distinct()
    ids = entrez_ids.filter("ensembl is not null").select("entrez", "ensembl").distinct()
    with scope(annotations.sparkSession) as own:
        membrane = keep(membrane, "membrane")
        edges = keep(network.entrez_to_ensembl(interactions, ids).select("src", "dst").withColumn("edge_id", F.monotonically_increasing_id()), "reference")
        own.spare(membrane, edges)
    known = edges.select(F.explode(F.array("src", "dst")).alias("gene")).distinct()
    return ReferenceNetwork(edges, membrane, known.unionByName(membrane).distinct(), membrane.join(known, "gene", "left_anti"))


@dataclass
class Networks:
    edges: DataFrame
    vertices: DataFrame
    qc: DataFrame
    measures: dict[str, Callable[[], DataFrame]]
    distances: DataFrame

    @property
    def metrics(self) -> dict[str, DataFrame]:
        """All measures by name, (sample_id, gene, measure); each is begun here."""
        return {m: f() for m, f in self.measures.items()}


def networks(
    counts: DataFrame, reference: DataFrame, membrane: DataFrame, cfg: FilterConfig, store: Callable[[DataFrame, str], DataFrame] = keep,
    normalise: bool = True,
) -> Networks:
    """Counts (gene, sample_id, count) and reference edges (edge_id, src, dst) to filtered networks and their measures.

    Pair weights are computed for the reference's pairs and for those that touch a membrane gene; the full matrix is
    only ever summed, for the share of connectivity.
    """
    prepare(counts.sparkSession)
    genes = store(expression.by_gene(counts.withColumnRenamed("gene_id", "gene") if "gene_id" in counts.columns else counts), "counts")
    values = expression.vst(expression.expressed(genes)) if normalise else genes.select("gene", "sample_id", F.col("count").cast("double").alias("value"))
    values = store(values, "values")
    known = values.select("gene").distinct()
    mem = membrane.filter(null_if_blank("gene").isNotNull()).select("gene").distinct()
    inside = store(mem.join(known, "gene", "left_semi"), "membrane")
    ref = network.canonical(reference)
    pairs = ref.select("a", "b").unionByName(network.membrane_pairs(known, inside)).distinct()
    weights = store(lioness.edges(values, pairs), "weights")
    unfiltered = store(network.weighted(reference, weights), "unfiltered")
    ppi = network.top_proportion(unfiltered, cfg.top_prop, parts(unfiltered, times=2) if store is keep else None)
    # the reference network's genes are vertices of every sample, as are the membrane genes where pairs are added
    named = reference.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("gene")).distinct()
    own = values.select("sample_id", "gene").join(named, "gene", "left_semi").select("sample_id", "gene")
    edges, qc = network.enrich(ppi, unfiltered, weights, mem, cfg, own, store)
    edges = store(edges, "edges")
    vertices = store(network.vertices(own, edges, mem, qc), "vertices")
    ds = network.degree_strength(edges, vertices)
    full = network.connectivity(lioness.strengths(values))
    measures = {
        "betweenness": lambda: graph_kernels.betweenness(edges, vertices),
        "degree": lambda: ds.select("sample_id", "gene", "degree"),
        "strength": lambda: ds.select("sample_id", "gene", "strength"),
        "largest_component_impact": lambda: graph_kernels.impact(edges, vertices),
        "wci": lambda: full.select("sample_id", "gene", "wci"),
    }
    return Networks(edges, vertices, qc, measures, similarity.cosine(ds.select("sample_id", "gene", F.col("strength").alias("value"))))
