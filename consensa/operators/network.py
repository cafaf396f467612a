"""Sample networks as edge and vertex tables: filters, enrichment and metrics.

edges(sample_id, edge_id, src, dst, weight) may hold parallel edges; vertices(sample_id, gene) hold isolated genes too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import share_ceil
from ..functions.tables import dealt, keep, release, scope
from .config import FilterConfig


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """With a < b; self-loops and edges with a null end go."""
    x = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    return x.withColumn("a", F.least(src, dst)).withColumn("b", F.greatest(src, dst))


def weighted(reference: DataFrame, weights: DataFrame) -> DataFrame:
    """Reference edges (edge_id, src, dst) with each sample's weight (sample_id, a, b, weight); missing or NaN weights drop the edge."""
    return canonical(reference).join(
        weights.filter(F.col("weight").isNotNull() & ~F.isnan("weight")), ["a", "b"],
    ).select("sample_id", "edge_id", "src", "dst", "weight")


def entrez_to_ensembl(pairs: DataFrame, id_map: DataFrame) -> DataFrame:
    """Both ends translated; several translations give several edges, and parallel edges stay."""
    one = id_map.select(F.col("entrez").alias("id1"), F.col("ensembl").alias("src"))
    two = id_map.select(F.col("entrez").alias("id2"), F.col("ensembl").alias("dst"))
    return pairs.join(one, "id1").join(two, "id2").filter("src is not null and dst is not null")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select("*", F.explode(F.array("src", "dst")).alias("gene"))


def top_proportion(edges: DataFrame, top_prop: float, parts: int | None = None) -> DataFrame:
    """Edges among the max(1, ceil(k * top_prop)) strongest at one of their ends; ties by edge_id.

    ``parts``: into how many the edges' ends are dealt (``tables.parts``), so that a task sorts no more of a larger table.
    """
    x = dealt(ends(edges).select("sample_id", "edge_id", "gene", F.abs("weight").alias("_size")), parts, "gene", "sample_id")
    x = x.withColumn("_node", F.xxhash64("gene", "sample_id"))  # sorted by first: a number is compared faster than names that begin alike
    order = W.partitionBy("_node", "gene", "sample_id").orderBy(F.col("_size").desc(), "edge_id")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in the order of the rank: one window serves both
    x = x.withColumn("_r", F.row_number().over(order)).withColumn("_k", F.count("*").over(every))
    kept = x.filter(F.col("_r") <= F.greatest(F.lit(1), share_ceil(F.col("_k"), top_prop))).select("edge_id", "sample_id")
    kept = dealt(kept, parts, "edge_id", "sample_id")
    if parts is not None:
        kept = kept.hint("shuffle_hash")  # a part's ids fit a task, so the edges are not sorted
    return edges.join(kept, ["edge_id", "sample_id"], "left_semi").select(*edges.columns)


def strongest(rows: DataFrame, wanted: DataFrame, ties: list[str], bins: int = 1024) -> DataFrame:
    """Of each sample the ``wanted`` (sample_id, requested) rows of greatest |weight|, ties by the columns ``ties``.

    No sample is ranked in one task: rows are counted by bins of log2 |weight|, running counts give the bin where the cut
    lies, whole bins above it are taken, and only that bin's rows are ranked.
    """
    size = F.abs("weight")
    binned = rows.withColumn("_bin", F.when(size > 0, F.floor(F.log2(size) * bins)).otherwise(F.lit(-(1 << 40))).cast("long"))
    count = binned.groupBy("sample_id", "_bin").agg(F.count("*").alias("_n")).join(wanted, "sample_id")
    upto = F.sum("_n").over(W.partitionBy("sample_id").orderBy(F.col("_bin").desc()))
    at = count.withColumn("_above", upto - F.col("_n")).filter("_above < requested").withColumn("_left", F.col("requested") - F.col("_above")).select(
        "sample_id", "_bin", "_left", (F.col("_n") <= F.col("_left")).alias("_whole"),
    )
    x = binned.join(at, ["sample_id", "_bin"])
    order = W.partitionBy("sample_id", "_bin").orderBy(size.desc(), *ties)
    last = x.filter("not _whole").withColumn("_r", F.row_number().over(order)).filter("_r <= _left")
    return x.filter("_whole").select(*rows.columns).unionByName(last.select(*rows.columns))


def enrich(
    ppi: DataFrame, unfiltered: DataFrame, weights: DataFrame, membrane: DataFrame, cfg: FilterConfig,
    graph_vertices: DataFrame | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(edges, one summary row a sample): the PPI edges and the strongest further pairs that touch a membrane gene.

    A sample gets ceil(add_prop * its unfiltered, or filtered, edges) pairs, or as many as there are. With none to add, its PPI
    edges stay as they are; otherwise parallel edges become one (PPI before added, then the lower edge_id).
    ``weights`` has one row a pair. ``graph_vertices`` (sample_id, gene): the PPI graph's, its edges' ends if not given.
    ``store(df, name)`` writes what several steps read, and reads it back.
    """
    on = cfg.enrich and cfg.add_prop > 0
    put = store or (lambda df, _: df)
    ppi = put(ppi, "ppi")
    genes = membrane.select("gene").distinct()
    # one filter on the two ends goes below the steps that make the weights; a join for each end made them twice
    touching = weights.filter("a < b and weight is not null and not isnan(weight)").filter(F.col("a").isin(genes) | F.col("b").isin(genes))
    if not on:
        touching = touching.filter("false")
    # pairs of the graph go by one hash aggregation (a row a pair in ``weights``); an anti join sorted both sides by their names
    known = canonical(ppi).filter("sample_id is not null").select("sample_id", "a", "b", F.lit(None).cast(touching.schema["weight"].dataType).alias("weight"))
    both = touching.select("sample_id", "a", "b", "weight").unionByName(known).groupBy("sample_id", "a", "b")
    free = put(both.agg(F.max("weight").alias("weight"), F.bool_or(F.col("weight").isNull()).alias("_known")).filter("not _known").drop("_known"), "candidates")
    whole = unfiltered.groupBy("sample_id").agg(F.count("*").alias("unfiltered_edges"))
    counts = whole.join(ppi.groupBy("sample_id").agg(F.count("*").alias("ppi_edges")), "sample_id", "left")
    counts = counts.join(free.groupBy("sample_id").agg(F.count("*").alias("candidates")), "sample_id", "left").na.fill(0, ["ppi_edges", "candidates"])
    base = F.col("unfiltered_edges" if cfg.denominator == "unfiltered_ppi_edges" else "ppi_edges")
    counts = put(counts.withColumn("requested", F.least(share_ceil(base, cfg.add_prop if on else 0.0), F.col("candidates"))), "counts")
    added = strongest(free, counts.filter("requested > 0").select("sample_id", "requested"), ["a", "b"])
    added = put(added.select("sample_id", F.lit(None).cast("long").alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), "added")
    both = ppi.select(
        "sample_id", F.col("edge_id").cast("long").alias("edge_id"), "src", "dst", "weight",
    ).withColumn("_o", F.lit(0)).unionByName(added.withColumn("_o", F.lit(1)))
    both = canonical(both).join(counts.select("sample_id", "requested"), "sample_id", "left")
    first = W.partitionBy("sample_id", "a", "b").orderBy("_o", "edge_id")
    edges = both.withColumn("_r", F.row_number().over(first)).filter("_r = 1 or coalesce(requested, 0) = 0").select("sample_id", "edge_id", "src", "dst", "weight")
    own = (graph_vertices if graph_vertices is not None else ends(ppi)).select("sample_id", "gene").distinct()
    final = vertices(own, added, membrane, counts)
    n = lambda df, name: df.groupBy("sample_id").agg(F.count("*").alias(name))
    qc = counts
    for df, name in ((edges, "final_edges"), (own, "ppi_vertices"), (final, "final_vertices")):
        qc = qc.join(n(df, name), "sample_id", "left")
    qc = qc.na.fill(0, ["final_edges", "ppi_vertices", "final_vertices"])
    return edges, qc.select(
        "sample_id", F.lit(cfg.enrich).alias("enabled"), F.lit(float(cfg.add_prop)).alias("add_prop"), F.lit(cfg.denominator).alias("denominator"), F.lit(cfg.require_membrane_endpoint).alias("require_membrane_endpoint"),
        F.lit(cfg.metric).alias("metric"), "unfiltered_edges", "ppi_edges", "candidates", "requested", F.col("requested").alias("added"), "final_edges", "ppi_vertices", "final_vertices",
    )


def vertices(own: DataFrame, edges: DataFrame, membrane: DataFrame, counts: DataFrame) -> DataFrame:
    """(sample_id, gene): a graph's own vertices, its edges' ends and, in the samples with added pairs (``requested``), every membrane gene."""
    part = F.pmod(F.xxhash64("gene"), F.lit(DEAL)).cast("int")
    samples = counts.filter("requested > 0").select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("_d"))
    listed = samples.join(membrane.select("gene", part.alias("_d")).distinct(), "_d").select("sample_id", "gene")
    return own.select("sample_id", "gene").unionByName(listed).unionByName(ends(edges).select("sample_id", "gene")).distinct()


#: Parts over which a gene set meets samples or genes, so that no task holds a whole product.
DEAL = 16


def membrane_pairs(genes: DataFrame, membrane: DataFrame) -> DataFrame:
    """Canonical pairs (a, b) of a membrane gene and any other gene: the candidates themselves, made in ``DEAL`` parts."""
    part = F.pmod(F.xxhash64("gene"), F.lit(DEAL)).cast("int")
    x = genes.select(F.col("gene").alias("x"), part.alias("_d"))
    y = membrane.select(F.col("gene").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("_d"))
    return x.join(y, "_d").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def degree_strength(edges: DataFrame, vertices: DataFrame | None = None, signed: bool = False) -> DataFrame:
    """(sample_id, gene, degree, strength): parallel edges count, isolated vertices get 0."""
    w = F.col("weight") if signed else F.abs("weight")
    got = ends(edges).groupBy("sample_id", "gene").agg(F.count("*").alias("degree"), F.sum(w).alias("strength"))
    if vertices is None:
        return got
    return vertices.join(got, ["sample_id", "gene"], "left").select(
        "sample_id", "gene", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"),
    )


def full_strength(pairs: DataFrame) -> DataFrame:
    """``connectivity`` from a list of pairs (sample_id, a, b, weight)."""
    both = pairs.select("sample_id", F.col("a").alias("gene"), "weight").unionByName(pairs.select("sample_id", F.col("b").alias("gene"), "weight"))
    return connectivity(both.groupBy("sample_id", "gene").agg(F.sum(F.abs("weight")).alias("strength"), F.count_if(F.col("weight") != 0).alias("degree")))


def connectivity(sums: DataFrame) -> DataFrame:
    """Strength, degree and share of connectivity in the full matrix, whose diagonal is one, from sums over other genes."""
    s = sums.select("sample_id", "gene", (F.col("strength") + 1).alias("strength"), (F.col("degree") + 1).alias("degree"))
    total = s.groupBy("sample_id").agg(F.sum("strength").alias("_t"))
    return s.join(total, "sample_id").select("sample_id", "gene", "strength", "degree", F.try_divide("strength", "_t").alias("wci"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(sample_id, gene, component): the least gene reachable. Labels spread along edges, then jump to their label's label.

    Each round's table is written and read back, so lineage stays short and rounds survive lost executors; it goes when the next one is there.
    """
    with scope(edges.sparkSession) as own:
        label = _components(edges, vertices)
        own.spare(label)
    return label.select("sample_id", "gene", F.col("new").alias("component"))


def _components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    both = edges.select(
        "sample_id", F.col("src").alias("gene"), F.col("dst").alias("other"),
    ).unionByName(edges.select("sample_id", F.col("dst").alias("gene"), F.col("src").alias("other"))).filter("gene <> other").distinct()
    both = keep(both, "links")
    first = vertices.select("sample_id", "gene").distinct()
    last = keep(first.select("*", F.col("gene").alias("new"), F.col("gene").alias("component")), "labels")
    while True:
        label = last.select("sample_id", "gene", F.col("new").alias("component"))
        near = both.join(
            label.select("sample_id", F.col("gene").alias("other"), "component"), ["sample_id", "other"],
        ).groupBy("sample_id", "gene").agg(F.min("component").alias("near"))
        step = label.join(near, ["sample_id", "gene"], "left").withColumn("low", F.least("component", "near"))
        jump = step.select("sample_id", F.col("gene").alias("low"), F.col("low").alias("next"))
        nxt = keep(step.join(jump, ["sample_id", "low"], "left").select("sample_id", "gene", F.least("low", "next").alias("new"), "component"), "labels")
        release(last)
        last = nxt
        if nxt.filter("new <> component").isEmpty():
            return nxt


def component_sizes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, component, size, weight): genes, and the sum of weights inside."""
    size = labels.groupBy("sample_id", "component").agg(F.count("*").alias("size"))
    inside = edges.join(labels.withColumnRenamed("gene", "src"), ["sample_id", "src"]).groupBy("sample_id", "component").agg(F.sum("weight").alias("weight"))
    return size.join(inside, ["sample_id", "component"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def adjacency(edges: DataFrame) -> DataFrame:
    """(sample_id, a, b, weight): parallel edges summed."""
    return canonical(edges).groupBy("sample_id", "a", "b").agg(F.sum("weight").alias("weight"))
