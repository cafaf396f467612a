"""Largest component impact of graphs that no task could hold: biconnected components by joins.

After a vertex goes, the pieces of its component are the biconnected components that met in it. They are found without a depth-first search:
a breadth-first tree, subtree sums and preorder numbers by doubling (rounds grow with the logarithm of the tree's depth), the least and greatest
number that a subtree's other edges reach, and connected components of the tree's edges: two tree edges belong together if a
non-tree edge ties their lower ends, or if a subtree has an edge past its parent's subtree. Every step is a join or an aggregate by (sample, gene), written
and read back, so nothing holds a sample.

Roots are the least genes of components, so the piece that holds the root is the one with the least gene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import keep, release, scope
from .network import components

SIBLINGS = 256  # parts over which a vertex's children are numbered


def _renamed(df: DataFrame, gene: str, **columns: str) -> DataFrame:
    return df.select("sample_id", F.col("gene").alias(gene), *[F.col(c).alias(new) for c, new in columns.items()])


def tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(sample_id, gene, parent, depth): breadth-first from ``roots`` (sample_id, gene) over (sample_id, a, b). A level meets the two before it."""
    both = edges.select("sample_id", F.col("a").alias("gene"), F.col("b").alias("other")).unionByName(edges.select("sample_id", F.col("b").alias("gene"), F.col("a").alias("other")))
    both = keep(both, "tree-links")
    front = keep(roots.select("sample_id", "gene", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")), "tree-level")
    levels, before = [front], front.limit(0)
    while True:
        found = both.join(front.select("sample_id", "gene"), ["sample_id", "gene"]).groupBy("sample_id", F.col("other")).agg(F.min("gene").alias("parent"))
        seen = front.select("sample_id", "gene").unionByName(before.select("sample_id", "gene"))
        new = found.withColumnRenamed("other", "gene").join(seen, ["sample_id", "gene"], "left_anti")
        before, front = front, keep(new.withColumn("depth", F.lit(len(levels))).select("sample_id", "gene", "parent", "depth"), "tree-level")
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return keep(out, "tree")


def over_subtrees(nodes: DataFrame, **how: tuple[Column, str]) -> DataFrame:
    """``nodes`` (sample_id, gene, parent) with aggregates over each vertex's subtree: name=(value, 'sum' | 'min' | 'max').

    Round k adds what the descendants 2^k below have gathered over 2^k levels.
    """
    of = {"sum": F.sum, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    last = keep(nodes.select("sample_id", "gene", F.col("parent").alias("up"), *[v.alias(c) for c, (v, _) in how.items()]), "subtree")
    while not last.filter("up is not null").isEmpty():
        sums = last.filter("up is not null").groupBy("sample_id", F.col("up").alias("gene")).agg(*[of[h](c).alias(f"_{c}") for c, (_, h) in how.items()])
        ups = last.select("sample_id", F.col("gene").alias("up"), F.col("up").alias("_up"))
        x = last.join(sums, ["sample_id", "gene"], "left").join(ups, ["sample_id", "up"], "left")
        nxt = keep(x.select("sample_id", "gene", F.col("_up").alias("up"), *[join[h](F.col(c), F.col(f"_{c}")).alias(c) for c, (_, h) in how.items()]), "subtree")
        release(last)
        last = nxt
    return nodes.join(last.drop("up"), ["sample_id", "gene"])


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (sample_id, gene, parent, size, ...) with ``pre``: preorder numbers, 0 at roots.

    A child's step is one more than the sizes of the siblings before it; siblings are dealt over parts, so a hub's children are no single task's.
    """
    part = F.pmod(F.xxhash64("gene"), F.lit(SIBLINGS)).cast("int")
    x = nodes.select("sample_id", "gene", "parent", "size").withColumn("part", part)
    inside = W.partitionBy("sample_id", "parent", "part").orderBy("gene").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = x.groupBy("sample_id", "parent", "part").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy("sample_id", "parent").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.filter("parent is not null").join(sums.drop("n"), ["sample_id", "parent", "part"])
    x = x.select("sample_id", "gene", F.col("parent").alias("up"), (F.col("ahead") + F.col("earlier") + 1).alias("pre"))
    last = keep(x.unionByName(nodes.filter("parent is null").select("sample_id", "gene", F.col("parent").alias("up"), F.lit(0).cast("long").alias("pre"))), "preorder")
    while not last.filter("up is not null").isEmpty():
        ups = last.select("sample_id", F.col("gene").alias("up"), F.col("up").alias("_up"), F.col("pre").alias("_pre"))
        nxt = keep(last.join(ups, ["sample_id", "up"], "left").select("sample_id", "gene", F.col("_up").alias("up"), (F.col("pre") + F.coalesce("_pre", F.lit(0))).alias("pre")), "preorder")
        release(last)
        last = nxt
    return nodes.join(last.select("sample_id", "gene", "pre"), ["sample_id", "gene"])


def blocks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, gene, block): the biconnected component of the edge from ``gene`` to its parent.

    ``nodes`` (sample_id, gene, parent, size, pre) of breadth-first trees, so no non-tree edge joins a vertex and its ancestor.
    """
    a, b = _renamed(nodes, "a", parent="pa", pre="na"), _renamed(nodes, "b", parent="pb", pre="nb")
    x = keep(edges.select("sample_id", "a", "b").join(a, ["sample_id", "a"]).join(b, ["sample_id", "b"]), "tree-edges")
    other = x.filter("not (pa <=> b) and not (pb <=> a)")
    ends = other.select("sample_id", F.col("a").alias("gene"), F.col("nb").alias("n")).unionByName(other.select("sample_id", F.col("b").alias("gene"), F.col("na").alias("n")))
    reach = ends.groupBy("sample_id", "gene").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    own = keep(nodes.select("sample_id", "gene", "parent", "size", "pre").join(reach, ["sample_id", "gene"], "left"), "reach")
    low = over_subtrees(own, low=(F.least("pre", "least_n"), "min"), high=(F.greatest("pre", "most_n"), "max"))
    above = _renamed(nodes, "parent", pre="up_pre", size="up_size", parent="grand")
    past = low.join(above, ["sample_id", "parent"]).filter("grand is not null and (low < up_pre or high >= up_pre + up_size)")
    tied = other.select("sample_id", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(past.select("sample_id", F.col("gene").alias("src"), F.col("parent").alias("dst")))
    return components(keep(tied, "tied"), nodes.filter("parent is not null").select("sample_id", "gene")).withColumnRenamed("component", "block")


def impact(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(sample_id, gene, largest_component_impact), as ``graph_kernels.component_impact``."""
    with scope(edges.sparkSession) as own:
        e = edges.filter("src <> dst").select("sample_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.abs(F.col("weight").cast("double")).alias("w"))
        e = keep(e.groupBy("sample_id", "a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("m")), "impact-edges")
        named = vertices.select("sample_id", "gene").unionByName(e.select("sample_id", F.col("a").alias("gene"))).unionByName(e.select("sample_id", F.col("b").alias("gene")))
        label = keep(components(e.withColumnsRenamed({"a": "src", "b": "dst"}), named.distinct()), "impact-labels")
        size = label.groupBy("sample_id", "component").agg(F.count("*").alias("n"))
        mass = e.join(_renamed(label, "a", component="component"), ["sample_id", "a"]).groupBy("sample_id", "component").agg(F.sum("w").alias("mass"))
        comp = keep(size.join(mass, ["sample_id", "component"], "left").fillna(0.0, ["mass"]), "impact-components")
        rank = F.struct((-F.col("n")).alias("n"), "component", "mass")
        top = keep(comp.groupBy("sample_id").agg(F.min(rank).alias("top")), "impact-top")
        second = comp.join(top, "sample_id").filter("component <> top.component").groupBy("sample_id").agg(F.min(rank).alias("second"))
        top = keep(top.join(second, "sample_id", "left").join(e.groupBy("sample_id").agg(F.sum("m").alias("edges")), "sample_id", "left"), "impact-tops")
        inside = label.join(top.select("sample_id", F.col("top.component").alias("component")), ["sample_id", "component"]).select("sample_id", "gene")
        e_top = keep(e.join(_renamed(inside, "a"), ["sample_id", "a"]), "impact-inside")
        nodes = tree(e_top, top.select("sample_id", F.col("top.component").alias("gene")))
        ends = lambda x, *more: x.select("sample_id", F.col("a").alias("gene"), "w", "m", *more).unionByName(x.select("sample_id", F.col("b").alias("gene"), "w", "m", *more))
        degree = ends(e).groupBy("sample_id", "gene").agg(F.sum("w").alias("around"), F.sum("m").alias("degree"))
        nodes = nodes.join(degree, ["sample_id", "gene"], "left").fillna(0.0, ["around"])
        nodes = keep(over_subtrees(nodes, size=(F.lit(1).cast("long"), "sum"), weight=(F.col("around"), "sum"), least=(F.col("gene"), "min")), "impact-sums")
        nodes = keep(numbered(nodes), "impact-numbered")
        block = keep(blocks(e_top, nodes), "impact-blocks")
        nodes = keep(nodes.join(block, ["sample_id", "gene"], "left"), "impact-nodes")
        # an edge belongs to the block of its end that comes later
        lab = e_top.join(_renamed(nodes, "a", pre="na", block="ba"), ["sample_id", "a"]).join(_renamed(nodes, "b", pre="nb", block="bb"), ["sample_id", "b"])
        lab = lab.withColumn("block", F.when(F.col("na") > F.col("nb"), F.col("ba")).otherwise(F.col("bb")))
        near = ends(lab, "block").groupBy("sample_id", "gene", "block").agg(F.sum("w").alias("near"))
        below = nodes.filter("parent is not null").groupBy("sample_id", F.col("parent").alias("gene"), "block").agg(
            F.sum("size").alias("n"), F.sum("weight").alias("weight"), F.min("least").alias("least"))
        cut = below.join(nodes.select("sample_id", "gene", F.col("block").alias("up")), ["sample_id", "gene"]).filter("not (block <=> up)")
        cut = cut.join(near, ["sample_id", "gene", "block"]).withColumn("w", (F.col("weight") - F.col("near")) / 2)
        piece = F.struct((-F.col("n")).alias("n"), F.col("least").alias("component"), F.col("w").alias("mass"))
        cut = cut.groupBy("sample_id", "gene").agg(F.sum("n").alias("cut_n"), F.sum("w").alias("cut_w"), F.min(piece).alias("piece"))
        x = label.join(top, "sample_id").join(nodes.select("sample_id", "gene", "parent", "around", "depth"), ["sample_id", "gene"], "left").join(cut, ["sample_id", "gene"], "left")
        x = x.join(degree.select("sample_id", "gene", "degree"), ["sample_id", "gene"], "left")
        rest_n = -F.col("top.n") - 1 - F.coalesce("cut_n", F.lit(0))
        rest = F.struct((-rest_n).alias("n"), F.col("top.component").alias("component"), (F.col("top.mass") - F.col("around") - F.coalesce("cut_w", F.lit(0.0))).alias("mass"))
        x = x.withColumn("rest", F.when(F.col("parent").isNotNull() & (rest_n > 0), rest)).withColumn("best", F.least("piece", "rest", "second"))
        big, mass = -F.col("top.n"), F.col("top.mass")
        loss = 0.5 * (big + F.coalesce("best.n", F.lit(0))) / big + F.when(mass != 0, 0.5 * (mass - F.coalesce("best.mass", F.lit(0.0))) / F.nullif(mass, F.lit(0.0))).otherwise(0.0)
        none_left = F.coalesce("edges", F.lit(0)) == F.coalesce("degree", F.lit(0))
        out = F.when(none_left, 1.0).when(F.col("component") == F.col("top.component"), loss).otherwise(0.0)
        out = keep(x.select("sample_id", "gene", out.alias("largest_component_impact")), "impact")
        own.spare(out)
    return out
