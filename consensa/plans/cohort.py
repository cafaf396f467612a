"""Registered queries of the cohort workflow: the reference network, and sample networks from counts to distances, each as one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.config import FilterConfig
from . import workflow
from .catalog import _NAIVE, VALUES, query, rel

# a tree of terms with a second parent for some; lines annotate suppliers with parts' terms
_ONTOLOGY = """SELECT concat('GO:', p_partkey div 2) AS parent, concat('GO:', p_partkey) AS child FROM {part}
UNION ALL SELECT concat('GO:', p_partkey div 3), concat('GO:', p_partkey) FROM {part} WHERE p_size % 4 = 0"""
_ROOTS = "SELECT 'GO:11' AS id UNION ALL SELECT 'GO:18' UNION ALL SELECT 'GO:none'"
_GAF = """SELECT concat('S', l_suppkey) AS gene, concat('GO:', l_partkey) AS go_id, CASE l_linenumber WHEN 1 THEN 'IDA' WHEN 2 THEN 'IEA' WHEN 3 THEN 'TAS' WHEN 4 THEN 'ISS' ELSE 'IC' END AS evidence,
  CASE l_returnflag WHEN 'A' THEN 'NOT' WHEN 'N' THEN 'NOT|located_in' END AS qualifier
FROM {lineitem} WHERE l_quantity > 45"""
_SYMBOLS = """SELECT concat('S', s_suppkey) AS symbol, CASE WHEN s_nationkey % 6 <> 0 THEN concat('E', s_suppkey) END AS ensembl FROM {supplier}
UNION ALL SELECT concat('S', s_suppkey), concat('M', s_suppkey) FROM {supplier} WHERE s_nationkey % 5 = 0"""
_PAIRS = "SELECT CAST(l_suppkey AS STRING) AS id1, CAST(o_custkey % 120 AS STRING) AS id2, l_quantity AS score FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_discount < 0.02"
_ENTREZ = """SELECT CAST(s_suppkey AS STRING) AS entrez, CASE WHEN s_suppkey % 9 <> 4 THEN concat('E', s_suppkey) END AS ensembl FROM {supplier}
UNION ALL SELECT CAST(s_suppkey AS STRING), concat('X', s_suppkey) FROM {supplier} WHERE s_suppkey % 7 = 0"""


@query("reference_network", f"""WITH RECURSIVE o AS ({_ONTOLOGY.replace(" div ", " // ")}), r AS ({_ROOTS}), t(id) AS (SELECT id FROM r UNION SELECT o.child FROM o JOIN t ON o.parent = t.id),
g AS (SELECT DISTINCT gene FROM ({_GAF}) WHERE go_id IN (SELECT id FROM t) AND evidence IN ('EXP', 'IDA', 'IMP', 'IPI', 'IGI', 'IEP', 'TAS', 'IC') AND qualifier IS DISTINCT FROM 'NOT'),
m AS (SELECT DISTINCT ensembl AS gene FROM ({_SYMBOLS}) WHERE symbol IN (SELECT gene FROM g) AND ensembl IS NOT NULL),
i AS (SELECT DISTINCT * FROM ({_ENTREZ}) WHERE ensembl IS NOT NULL),
e AS (SELECT a.ensembl AS src, b.ensembl AS dst FROM ({_PAIRS}) p JOIN i a ON p.id1 = a.entrez JOIN i b ON p.id2 = b.entrez),
k AS (SELECT src AS gene FROM e UNION SELECT dst FROM e)
SELECT 'edge' AS part, src AS gene, dst AS other FROM e UNION ALL SELECT 'membrane', gene, NULL FROM m
UNION ALL SELECT 'combined', gene, NULL FROM (SELECT gene FROM k UNION SELECT gene FROM m) UNION ALL SELECT 'absent', gene, NULL FROM m WHERE gene NOT IN (SELECT gene FROM k)""")
def reference_network(spark, sf_dir):
    x = workflow.reference_network(*[rel(spark, sf_dir, s) for s in (_ONTOLOGY, _ROOTS, _GAF, _SYMBOLS, _PAIRS, _ENTREZ)])
    none = F.lit(None).cast("string")
    out = x.edges.select(F.lit("edge").alias("part"), F.col("src").alias("gene"), F.col("dst").alias("other"))
    for name in ("membrane", "combined", "absent"):
        out = out.unionByName(getattr(x, name).select(F.lit(name).alias("part"), "gene", none.alias("other")))
    return out


_REFERENCE = "SELECT p_partkey AS edge_id, p_brand AS src, concat('Brand#', 1 + p_size % 5, 1 + p_partkey % 5) AS dst FROM {part}"
_MEMBRANE = "SELECT DISTINCT p_brand AS gene FROM {part} WHERE substr(p_brand, 8, 1) = '3' UNION ALL SELECT 'Brand#99' UNION ALL SELECT ' '"
_QC = {c: c for c in ("candidates", "requested", "ppi_edges", "final_edges", "ppi_vertices", "final_vertices")} | {"unfiltered_edges": "base", "added": "requested"}
_NETWORKS = _NAIVE + f""", ref AS ({_REFERENCE}), m AS (SELECT DISTINCT gene FROM ({_MEMBRANE}) WHERE trim(gene) <> ''),
g AS (SELECT DISTINCT gene FROM v), named AS (SELECT src AS gene FROM ref WHERE src <> dst UNION SELECT dst FROM ref WHERE src <> dst),
own AS (SELECT DISTINCT sample_id, gene FROM v WHERE gene IN (SELECT gene FROM named)),
u AS (SELECT sample_id, edge_id, src, dst, weight FROM ref JOIN e ON least(src, dst) = a AND greatest(src, dst) = b WHERE src <> dst),
n2 AS (SELECT sample_id, edge_id, src AS gene, weight FROM u UNION ALL SELECT sample_id, edge_id, dst, weight FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, gene ORDER BY abs(weight) DESC, edge_id) AS r, count(*) OVER (PARTITION BY sample_id, gene) AS c FROM n2),
t AS (SELECT * FROM u WHERE (sample_id, edge_id) IN (SELECT sample_id, edge_id FROM k WHERE r <= greatest(1, ceil(CAST(c AS DOUBLE) * CAST(0.2 AS DOUBLE))))),
free AS (SELECT * FROM e WHERE (a IN (SELECT gene FROM m) OR b IN (SELECT gene FROM m)) AND (sample_id, a, b) NOT IN (SELECT sample_id, least(src, dst), greatest(src, dst) FROM t)),
b AS (SELECT sample_id, count(*) AS base FROM u GROUP BY 1),
c AS (SELECT b.sample_id, base, least(ceil(CAST(base AS DOUBLE) * CAST(0.05 AS DOUBLE)), coalesce(n, 0)) AS requested, coalesce(n, 0) AS candidates
  FROM b LEFT JOIN (SELECT sample_id, count(*) AS n FROM free GROUP BY 1) USING (sample_id)),
d AS (SELECT sample_id, a, b, weight FROM (SELECT free.*, requested, row_number() OVER (PARTITION BY free.sample_id ORDER BY abs(weight) DESC, a, b) AS r FROM free JOIN c USING (sample_id)) WHERE r <= requested),
z AS (SELECT sample_id, least(src, dst) AS a, greatest(src, dst) AS b, weight FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, least(src, dst), greatest(src, dst) ORDER BY edge_id) AS r FROM t)
  LEFT JOIN c USING (sample_id) WHERE r = 1 OR coalesce(requested, 0) = 0 UNION ALL SELECT sample_id, a, b, weight FROM d),
every AS (SELECT * FROM own UNION SELECT sample_id, gene FROM c, m WHERE requested > 0 UNION SELECT sample_id, a FROM z UNION SELECT sample_id, b FROM z),
t1 AS (SELECT sample_id, count(*) AS ppi_edges FROM t GROUP BY 1), x1 AS (SELECT sample_id, count(*) AS final_edges FROM z GROUP BY 1),
v1 AS (SELECT sample_id, count(*) AS ppi_vertices FROM own GROUP BY 1), v2 AS (SELECT sample_id, count(*) AS final_vertices FROM every GROUP BY 1),
qc AS (SELECT * FROM c JOIN t1 USING (sample_id) JOIN x1 USING (sample_id) JOIN v1 USING (sample_id) JOIN v2 USING (sample_id)),
ends AS (SELECT sample_id, a AS gene, weight FROM z UNION ALL SELECT sample_id, b, weight FROM z),
s AS (SELECT every.sample_id, every.gene, count(weight) AS degree, coalesce(sum(abs(weight)), 0) AS strength FROM every LEFT JOIN ends ON every.sample_id = ends.sample_id AND every.gene = ends.gene GROUP BY 1, 2),
full_ends AS (SELECT sample_id, a AS gene, weight FROM e UNION ALL SELECT sample_id, b, weight FROM e),
w AS (SELECT sample_id, gene, sum(abs(weight)) + 1 AS strength FROM full_ends GROUP BY 1, 2),
norm AS (SELECT sample_id, sqrt(sum(strength * strength)) AS n FROM s GROUP BY 1),
dots AS (SELECT x.sample_id AS s1, y.sample_id AS s2, sum(x.strength * y.strength) AS d FROM s x JOIN s y ON x.gene = y.gene AND x.sample_id <= y.sample_id GROUP BY 1, 2)
SELECT 'edge' AS part, sample_id, a, b, round(weight, 6) AS value FROM z
UNION ALL SELECT 'degree', sample_id, gene, NULL, CAST(degree AS DOUBLE) FROM s UNION ALL SELECT 'strength', sample_id, gene, NULL, round(strength, 6) FROM s
UNION ALL SELECT 'wci', sample_id, gene, NULL, round(strength / sum(strength) OVER (PARTITION BY sample_id), 6) FROM w
UNION ALL SELECT 'cosine', a.sample_id, b.sample_id, NULL, round(coalesce(d, 0) / (a.n * b.n), 6) FROM norm a JOIN norm b ON a.sample_id <= b.sample_id LEFT JOIN dots ON s1 = a.sample_id AND s2 = b.sample_id
""" + "".join(f"UNION ALL SELECT 'qc', sample_id, '{c}', NULL, CAST({x} AS DOUBLE) FROM qc\n" for c, x in _QC.items())


@query("networks", _NETWORKS)
def networks(spark, sf_dir):
    """Edges, summary, measures and distances of the sample networks, as rows (part, sample_id, a, b, value)."""
    counts = rel(spark, sf_dir, VALUES).withColumnRenamed("value", "count")
    n = workflow.networks(counts, rel(spark, sf_dir, _REFERENCE), rel(spark, sf_dir, _MEMBRANE), FilterConfig(), normalise=False)
    none = F.lit(None).cast("string")
    out = n.edges.select(F.lit("edge").alias("part"), "sample_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.round("weight", 6).alias("value"))
    for m in ("degree", "strength", "wci"):
        out = out.unionByName(n.measures[m]().select(F.lit(m).alias("part"), "sample_id", F.col("gene").alias("a"), none.alias("b"), F.round(F.col(m).cast("double"), 6).alias("value")))
    out = out.unionByName(n.distances.select(F.lit("cosine").alias("part"), F.col("s1").alias("sample_id"), F.col("s2").alias("a"), none.alias("b"), F.round("similarity", 6).alias("value")))
    qc = n.qc.select("sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("a"), F.col(c).cast("double").alias("value")) for c in _QC])).alias("x"))
    return out.unionByName(qc.select(F.lit("qc").alias("part"), "sample_id", "x.a", none.alias("b"), "x.value"))
