"""Registered queries: the engine's operators over the driver's tables through thin adapters, each with its SQL.

Adapters are SQL that both engines read: ``{table}`` names a table. What an operator does to the adapter's
rows is written twice, as DataFrame code in ``operators`` and as plain SQL here.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import to_double, to_int
from ..functions.session import prepare
from ..functions.tables import dealt, keep, parts, shared_dir
from ..operators import annotate, borda, expression, graph_kernels, lioness, network, ontology, report, similarity, union, variants
from ..operators.config import BordaConfig, Feature, FilterConfig
from ..sources import readers, sinks, variant_files
from ..streaming import incremental
from . import workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rel(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    prepare(spark)
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(name: str, sql: str | None = None):
    """Register a query (adapter rows come through ``rel``) and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = plain(sql)
        return f

    return add


# consensus ranking --------------------------------------------------------------------------------
EPI = """SELECT p_brand AS sample_id, p_partkey AS row_id, p_retailprice AS ic50,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE q END AS Network_Strength,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS Network_Degree
FROM {part} LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey) x ON p_partkey = l_partkey"""
WEIGHTS = (("ic50", 0.5, "lower_better"), ("Net_Strength", 0.3, "higher_better"), ("Net_Degree", 0.2, "higher_better"))


def borda_config(ties: str = "average", policy: str = "ignore") -> BordaConfig:
    return BordaConfig([Feature(*w) for w in WEIGHTS], ties, policy)


def borda_sql(ties: str, policy: str, epi: str = EPI) -> str:
    def ranked(v: str, parts: str) -> str:
        if ties == "first":
            return f"CAST(row_number() OVER (PARTITION BY {parts} ORDER BY {v}, row_id) AS DOUBLE)"
        low, alike = f"CAST(rank() OVER (PARTITION BY {parts} ORDER BY {v}) AS DOUBLE)", f"count(*) OVER (PARTITION BY {parts}, {v})"
        return {"min": low, "max": f"{low} + CAST({alike} - 1 AS DOUBLE)", "average": f"{low} + ({alike} - 1) / CAST(2 AS DOUBLE)"}[ties]

    w = [f"CAST({x[1]} AS DOUBLE)" for x in WEIGHTS]
    points = ",".join(f"CASE WHEN v{i} IS NOT NULL THEN CASE WHEN count(v{i}) OVER (PARTITION BY sample_id) <= 1 THEN CAST(1 AS DOUBLE) ELSE (count(v{i}) OVER (PARTITION BY sample_id) - ({ranked(f'v{i}', f'sample_id, v{i} IS NULL')})) / CAST(count(v{i}) OVER (PARTITION BY sample_id) - 1 AS DOUBLE) END END AS p{i}" for i in range(3))
    mass = " + ".join(["CAST(0 AS DOUBLE)", *(f"{w[i]} * coalesce(p{i}, 0)" for i in range(3))])
    there = " + ".join(["CAST(0 AS DOUBLE)", *(f"CASE WHEN p{i} IS NOT NULL THEN {w[i]} ELSE 0 END" for i in range(3))])
    score = f"CASE WHEN {there} > 0 THEN ({mass}) / ({there}) ELSE 0 END" if policy == "ignore" else mass
    only = "WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL" if policy == "drop" else ""
    ten = "pow(CAST(10 AS DOUBLE), 3 - floor(log10(abs(s))))"
    return f"""WITH e AS ({epi}), v AS (SELECT sample_id, row_id, ic50 AS v0, -Network_Strength AS v1, -Network_Degree AS v2
FROM e),
p AS (SELECT sample_id, row_id, {points} FROM v), s AS (SELECT sample_id, row_id, {score} AS s, -({score}) AS m
FROM p {only})
SELECT sample_id, row_id, CASE WHEN s = 0 THEN s ELSE round(s * {ten}) / {ten} END AS borda_score, {ranked('m', 'sample_id')} AS borda_rank
FROM s"""


def _borda(ties: str, policy: str):
    def run(spark, sf_dir):
        x = borda.consensus(rel(spark, sf_dir, EPI), borda_config(ties, policy))
        return x.select("sample_id", "row_id", F.col("Borda_Score").alias("borda_score"), F.col("Borda_Rank").alias("borda_rank"))

    return run


for _t in ("average", "min", "max", "first"):
    for _p in ("ignore", "worst", "drop"):
        query(f"borda_{_t}_{_p}", borda_sql(_t, _p))(_borda(_t, _p))
query("borda_random_ignore")(_borda("random", "ignore"))

# union of sources ---------------------------------------------------------------------------------
SOMATIC = """SELECT concat('s', CAST(user_id % 5 AS STRING)) AS sample_id, concat('G', CAST(user_id % 40 AS STRING)) AS `Gene Name`, concat('HLA-A*0',
  CAST(event_id % 3 AS STRING), ':01') AS `HLA Allele`,
  CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE concat(CAST(8 + event_id % 4 AS STRING), '.0') END AS `Peptide Length`, concat('PEP',
  CAST(event_id % 97 AS STRING)) AS `MT Epitope Seq`, concat('WT', CAST(event_id % 11 AS STRING)) AS `WT Epitope Seq`,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(event_id % 500 AS STRING) END AS `Median MT IC50 Score`, event_type AS kind
FROM {events} WHERE event_type IN ('view', 'click')"""
FUSION = """SELECT concat('s', CAST(user_id % 5 AS STRING)) AS sample_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('G', CAST(user_id % 40 AS STRING),
  '_', 'H', CAST(event_id % 20 AS STRING)) END AS `Gene Name`, concat('DRB1*0', CAST(event_id % 3 AS STRING), ':01') AS `HLA Allele`,
  concat('FUSEPEP', CAST(event_id % 97 AS STRING)) AS `Epitope Seq`, CAST(event_id % 700 AS STRING) AS `Median IC50 Score`,
  CAST(event_id % 2 AS STRING) AS tier
FROM {events} WHERE event_type = 'purchase'"""
SPLICE = """SELECT concat('s', CAST(user_id % 5 AS STRING)) AS sample_id, concat('G', CAST(user_id % 40 AS STRING)) AS `Gene Name`, concat('HLA-B*0',
  CAST(event_id % 3 AS STRING), ':02') AS `HLA Allele`,
  CASE WHEN user_id % 5 = 1 THEN NULL WHEN event_id % 2 = 0 THEN NULL ELSE '9' END AS `Peptide Length`, concat('SPL', CAST(event_id % 97 AS STRING)) AS `Epitope Seq`,
  CAST(event_id % 700 AS STRING) AS `Median IC50 Score`
FROM {events} WHERE event_type IN ('signup', 'error')"""
_S = ["Gene Name", "HLA Allele", "Peptide Length", "MT Epitope Seq", "WT Epitope Seq", "Median MT IC50 Score", "kind"]
_O = ["Gene Name", "HLA Allele", "Peptide Length", "Epitope Seq", "Median IC50 Score", "tier"]


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union.merge([
        union.project(rel(spark, sf_dir, SOMATIC), _S, "Somatic", "MHC Class I"),
        union.project(rel(spark, sf_dir, FUSION), _O, "Fusion", "MHC Class II"),
        union.project(rel(spark, sf_dir, SPLICE), _O, "Splice Variant", "MHC Class I"),
    ])


def _duck(adapter: str) -> str:
    return adapter.replace("`", '"').replace("STRING", "VARCHAR")


MERGED_SQL = f"""WITH a AS ({_duck(SOMATIC)}), b AS ({_duck(FUSION)}), c AS ({_duck(SPLICE)})
SELECT DISTINCT * FROM (
SELECT sample_id, "Gene Name" AS gene_name, "HLA Allele" AS hla_allele, CAST(trunc(TRY_CAST("Peptide Length" AS DOUBLE)) AS INTEGER) AS peptide_length,
  "MT Epitope Seq" AS mt_epitope_seq, "WT Epitope Seq" AS wt_epitope_seq,
  TRY_CAST("Median MT IC50 Score" AS DOUBLE) AS median_mt_ic50, 'Somatic' AS mutation_source, 'MHC Class I' AS hla_class,
  CAST(NULL AS VARCHAR) AS fusion_genes, kind, CAST(NULL AS VARCHAR) AS tier
FROM a
UNION ALL SELECT sample_id, g, "HLA Allele", CAST(length("Epitope Seq") AS INTEGER), "Epitope Seq", NULL, TRY_CAST("Median IC50 Score" AS DOUBLE),
  'Fusion', 'MHC Class II', "Gene Name", NULL, tier
  FROM (SELECT *, unnest(CASE WHEN "Gene Name" IS NULL THEN [NULL] ELSE string_split("Gene Name", '_') END) AS g
FROM b)
UNION ALL SELECT sample_id, "Gene Name", "HLA Allele", CASE WHEN count("Peptide Length") OVER (PARTITION BY sample_id) = 0 THEN CAST(length("Epitope Seq") AS INTEGER) ELSE CAST("Peptide Length" AS INTEGER) END,
  "Epitope Seq", NULL,
  TRY_CAST("Median IC50 Score" AS DOUBLE), 'Splice Variant', 'MHC Class I', NULL, NULL, NULL
FROM c)"""
query("source_union", MERGED_SQL)(merged)


@query("fusion_explode", """SELECT p_partkey, g AS partner FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 17 = 0 THEN [NULL] ELSE string_split(p_name, ' ') END) AS g
FROM {part})""")
def fusion_explode(spark, sf_dir):
    x = rel(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS n FROM {part}")
    return x.select("p_partkey", F.explode_outer(F.split("n", " ")).alias("partner"))


@query("number_rules", """SELECT event_id, TRY_CAST(s AS DOUBLE) AS d, CAST(trunc(TRY_CAST(s AS DOUBLE)) AS INTEGER) AS i
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '8.0' WHEN 1 THEN 'abc' WHEN 2 THEN '1e-3' ELSE CAST(event_id AS VARCHAR) END AS s
FROM {events})""")
def number_rules(spark, sf_dir):
    x = rel(spark, sf_dir, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '8.0' WHEN 1 THEN 'abc' WHEN 2 THEN '1e-3' ELSE CAST(event_id AS STRING) END AS s
FROM {events}""")
    return x.select("event_id", to_double("s").alias("d"), to_int("s").alias("i"))


@query("sample_sheet_last", "SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey FROM {orders} GROUP BY o_custkey, o_orderstatus")
def sample_sheet_last(spark, sf_dir):
    return readers.last_of(rel(spark, sf_dir, "SELECT o_custkey, o_orderstatus, o_orderkey FROM {orders}"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("first_lane", "SELECT CAST(user_id AS VARCHAR) AS sample_id, min(event_type) AS path FROM {events} GROUP BY user_id")
def first_lane(spark, sf_dir):
    return readers.first_lane(rel(spark, sf_dir, "SELECT CAST(user_id AS STRING) AS sample_id, event_type AS path FROM {events}"))


@query("gene_set_lines", """SELECT p_brand AS set_name, gene FROM (SELECT p_brand, p_partkey, unnest(list_slice(string_split(p_name, ' '), 2, 99)) AS gene
FROM {part} WHERE len(string_split(p_name, ' ')) >= 2) WHERE gene <> ''""")
def gene_set_lines(spark, sf_dir):
    x = rel(spark, sf_dir, "SELECT concat(p_brand, '\\t', replace(p_name, ' ', '\\t')) AS value FROM {part}")
    return readers.split_sets(x)


# annotation ---------------------------------------------------------------------------------------
@query("annotate_left", """WITH d AS (SELECT upper(trim(n_name)) AS k, n_nationkey, r_name FROM {nation}
JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
SELECT c_custkey, d.n_nationkey AS nation_id, d.r_name AS region FROM {customer}
JOIN {nation} n ON c_nationkey = n.n_nationkey LEFT JOIN d ON upper(trim(n.n_name)) = d.k""")
def annotate_left(spark, sf_dir):
    rows = rel(spark, sf_dir, "SELECT c_custkey, concat(' ', lower(n_name), '\\t') AS gene FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
    dim = rel(spark, sf_dir, """SELECT n_name AS gene, n_nationkey, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
WHERE r_name <> 'ASIA' UNION ALL SELECT 'V1', -1, 'x' UNION ALL SELECT '  ', -1, 'x'""")
    return annotate.by_key(rows, annotate.essentiality_rows(dim), "gene", "gene", {"n_nationkey": "nation_id", "r_name": "region"}).drop("gene")


DRIVER = """SELECT p_brand AS symbol, CASE p_size % 4 WHEN 0 THEN 'Act' WHEN 1 THEN 'LoF' WHEN 2 THEN 'ambiguous' ELSE 'lof' END AS role,
  CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_type END AS transcript, concat('C', p_size % 9) AS cohort, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS cancer_type
FROM {part}"""
_JOIN = "coalesce(string_agg(DISTINCT {c}, ';' ORDER BY {c}) FILTER (trim({c}) <> ''), '') AS {c}"


@query(
    "driver_collapse",
    f"WITH d AS ({DRIVER}) SELECT symbol, " + ", ".join(_JOIN.replace("{c}", c) for c in ("role", "transcript", "cohort", "cancer_type")) + " FROM d WHERE lower(role) LIKE '%act%' OR lower(role) LIKE '%lof%' GROUP BY symbol"
)
def driver_collapse(spark, sf_dir):
    return annotate.drivers(rel(spark, sf_dir, DRIVER))


_WIDE = "SELECT concat('m', l_linenumber, l_returnflag) AS model, l_partkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY ALL"


@query("wide_median", f"""SELECT concat('N', l_partkey) AS gene, concat('E', l_partkey) AS entrez_id, median(q) AS median_score
FROM ({_WIDE}) GROUP BY l_partkey""")
def wide_median(spark, sf_dir):
    """A file of a column a part, written and read back; a header in each part of it."""
    x = rel(spark, sf_dir, _WIDE)
    every = "sequence({}L, {}L)".format(*x.agg(F.min("l_partkey"), F.max("l_partkey")).first())
    grid = x.select("model").distinct().select("model", F.expr(f"explode({every}) AS l_partkey")).join(x, ["model", "l_partkey"], "left")
    row = grid.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "q")))["q"].alias("q"))
    line = row.select(F.crc32("model").alias("deal"), F.lit(1).alias("at"), F.expr("concat(model, ',', array_join(transform(q, v -> coalesce(cast(v as string), '')), ','))").alias("value"))
    head = F.expr(f"concat(',', array_join(transform({every}, p -> concat('N', p, ' (E', p, ')')), ','))")
    head = spark.range(4).select(F.col("id").alias("deal"), F.lit(0).alias("at"), head.alias("value"))
    path = folder(spark, "wide")
    line.withColumn("deal", F.col("deal") % 4).unionByName(head).repartition(4, "deal").sortWithinPartitions("deal", "at").select("value").write.text(path)
    found = readers.cells(spark, path)
    return annotate.essentiality_cells(found.select(F.col("column").alias("label"), F.col("value").alias("score"))).filter("median_score is not null")


METRIC = """SELECT l_returnflag AS sample_id, concat(CASE WHEN l_suppkey % {m} = 0 THEN '{n}' ELSE 'G' END, l_suppkey, '.', l_linenumber) AS gene, {v} AS {n}
FROM {lineitem} GROUP BY ALL"""
_M = {
    "betweenness": ("sum(l_quantity)", 2), "degree": ("CAST(count(*) AS DOUBLE)", 3), "strength": ("max(l_extendedprice)", 5),
    "largest_component_impact": ("min(l_discount)", 7), "wci": ("max(l_tax)", 11),
}
METRICS = {n: METRIC.replace("{v}", v).replace("{n}", n).replace("{m}", str(m)) for n, (v, m) in _M.items()}
_OUTER = "SELECT sample_id, gene, " + ", ".join(f"median({n}) AS {n}" for n in METRICS) + " FROM (" + " UNION ALL BY NAME ".join(
    f"SELECT sample_id, split_part(gene, '.', 1) AS gene, {n} FROM ({s})" for n, s in METRICS.items()
) + ") GROUP BY sample_id, gene"


def _metrics(spark, sf_dir):
    return annotate.combine_metrics({n: rel(spark, sf_dir, s) for n, s in METRICS.items()})


query("metric_outer_combine", _OUTER)(_metrics)
GENE_MAP = """SELECT concat('G', s_suppkey, '.3') AS gene_id, CASE WHEN s_suppkey % 10 = 0 THEN ' ' ELSE concat('S', s_suppkey % 40) END AS symbol
FROM {supplier}"""


@query(
    "metric_symbols",
    f"WITH m AS ({_OUTER}), g AS ({GENE_MAP}) SELECT sample_id, symbol, " + ", ".join(f"median({n}) AS {n}" for n in METRICS) + " FROM m JOIN g ON m.gene = split_part(gene_id, '.', 1) WHERE trim(symbol) <> '' GROUP BY sample_id, symbol"
)
def metric_symbols(spark, sf_dir):
    return annotate.to_symbols(_metrics(spark, sf_dir), rel(spark, sf_dir, GENE_MAP), list(METRICS))


@query("metric_attach", f"""WITH m AS ({_OUTER}), g AS ({GENE_MAP}), s AS (SELECT sample_id, symbol, median(degree) AS degree, median(wci) AS wci
FROM m JOIN g ON m.gene = split_part(gene_id, '.', 1) WHERE trim(symbol) <> ''
GROUP BY sample_id, symbol)
SELECT p_partkey, e.sample_id, e.gene_name, degree, wci FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'R' END AS sample_id,
  concat('S', p_partkey % 60) AS gene_name
FROM {{part}}) e LEFT JOIN s ON e.sample_id = s.sample_id AND e.gene_name = s.symbol""")
def metric_attach(spark, sf_dir):
    rows = rel(spark, sf_dir, """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'R' END AS sample_id, concat('S', p_partkey % 60) AS gene_name
FROM {part}""")
    return annotate.attach_metrics(
        rows, metric_symbols(spark, sf_dir).select("sample_id", "symbol", "degree", "wci"),
    ).select("p_partkey", "sample_id", "gene_name", "degree", "wci")


GAF = """SELECT p_brand AS gene, concat('GO:', p_size % 12) AS go_id, CASE p_partkey % 3 WHEN 0 THEN 'MF' WHEN 1 THEN 'BP' ELSE 'CC' END AS ontology,
  CASE p_partkey % 5 WHEN 0 THEN 'IEA' WHEN 1 THEN 'EXP' WHEN 2 THEN 'IDA' WHEN 3 THEN NULL ELSE 'TAS' END AS evidence, CASE p_partkey % 7 WHEN 0 THEN 'NOT' WHEN 1 THEN 'NOT|x' ELSE NULL END AS qualifier
FROM {part}"""
GO = """SELECT concat('GO:', r) AS go_id, CASE WHEN r <> 4 THEN concat('term ', r) END AS term
FROM (SELECT DISTINCT p_size % 12 AS r FROM {part})"""
_GO_SQL = f"WITH a AS ({GAF}), n AS ({GO}) SELECT gene, " + ", ".join(f"nullif(coalesce(string_agg(DISTINCT term, ';' ORDER BY term) FILTER (ontology = '{o}'), ''), '') AS go_{o.lower()}" for o in ("MF", "BP", "CC")) + " FROM a LEFT JOIN n ON a.go_id = n.go_id WHERE {w} GROUP BY gene"
query("go_collapse", _GO_SQL.replace("{w}", "true"))(lambda spark, sf_dir: annotate.go_terms(rel(spark, sf_dir, GAF), rel(spark, sf_dir, GO)))
query(
    "go_collapse_no_iea", _GO_SQL.replace("{w}", "(evidence IS NULL OR evidence <> 'IEA')"),
)(lambda spark, sf_dir: annotate.go_terms(rel(spark, sf_dir, GAF), rel(spark, sf_dir, GO), True))


@query("evidence_genes", f"""WITH a AS ({GAF}) SELECT DISTINCT concat(gene, go_id) AS gene FROM a WHERE evidence IN ('EXP', 'IDA', 'IMP', 'IPI', 'IGI',
  'IEP', 'TAS', 'IC') AND coalesce(qualifier, '') <> 'NOT' AND go_id IN ('GO:1', 'GO:2', 'GO:3')""")
def evidence_genes(spark, sf_dir):
    ids = rel(spark, sf_dir, "SELECT 'GO:1' AS go_id UNION ALL SELECT 'GO:2' UNION ALL SELECT 'GO:3' UNION ALL SELECT 'GO:3'")
    return annotate.annotated_genes(rel(spark, sf_dir, GAF).withColumn("gene", F.concat("gene", "go_id")), ids)


SETS = """SELECT upper(n_name) AS gene, r_name AS set_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT lower(n_name), concat('Z', n_regionkey % 2) FROM {nation}"""


@query("hallmark_match", f"""WITH s AS ({SETS}), g AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS gene
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey) SELECT g.gene, string_agg(DISTINCT set_name, ';'
ORDER BY set_name) AS hallmark FROM g JOIN s ON upper(g.gene) = upper(s.gene)
GROUP BY g.gene""")
def hallmark_match(spark, sf_dir):
    genes = rel(spark, sf_dir, """SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS gene
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")
    return annotate.hallmarks(genes, rel(spark, sf_dir, SETS))


@query("ontology_closure", """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent
FROM {part} UNION ALL SELECT p_partkey, p_partkey // 3 FROM {part}), r(id) AS (
SELECT CAST(7 AS BIGINT) UNION SELECT child FROM r JOIN e ON r.id = e.parent) SELECT id
FROM r""")
def ontology_closure(spark, sf_dir):
    e = rel(spark, sf_dir, "SELECT p_partkey AS child, p_partkey div 2 AS parent FROM {part} UNION ALL SELECT p_partkey, p_partkey div 3 FROM {part}")
    return ontology.descendants(e, spark.sql("SELECT 7L AS id"))


@query("gene_lists_sets", """SELECT 'union' AS op, k FROM (SELECT p_partkey AS k FROM {part} WHERE p_size > 40
UNION SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49) UNION ALL SELECT 'except', k
FROM (SELECT p_partkey AS k FROM {part} WHERE p_size > 40 EXCEPT SELECT l_partkey
FROM {lineitem} WHERE l_quantity > 49) UNION ALL SELECT 'intersect', k FROM (SELECT p_partkey AS k
FROM {part} WHERE p_size > 40 INTERSECT SELECT l_partkey FROM {lineitem}
WHERE l_quantity > 49)""")
def gene_lists_sets(spark, sf_dir):
    a = rel(spark, sf_dir, "SELECT p_partkey AS k FROM {part} WHERE p_size > 40")
    b = rel(spark, sf_dir, "SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 49")
    named = lambda n, d: d.select(F.lit(n).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("except", a.subtract(b))).union(named("intersect", a.intersect(b)))


# allele frequencies and HLA -----------------------------------------------------------------------
VAF_ROWS = """SELECT p_partkey AS row_id, concat('t', p_partkey % 50) AS gene, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(' k',
  p_size % 5, ' ') END AS wt, CASE p_partkey % 4 WHEN 0 THEN 'MHC Class I' WHEN 1 THEN 'mhc_class_ii' WHEN 2 THEN ' Other-one' ELSE '1' END AS hla_class
FROM {part}"""
VAF_SRC = """SELECT event_id, concat('t', user_id % 50) AS gene, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('k', event_id % 5) END AS wt,
  CASE event_id % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'MHC-Class-II' ELSE 'Other-one' END AS hla_class, CASE event_id % 8 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' ELSE CAST(event_id % 4 AS {S}) END AS depth
FROM {events}"""
_CLASS = """CASE WHEN lower(replace(replace(hla_class, '_', ' '), '-', ' ')) IN ('mhc class ii', 'ii', '2') THEN 'II' WHEN lower(hla_class) IN ('mhc class i',
  'i', '1') THEN 'I' ELSE trim(hla_class) END"""


@query("vaf_collapse_join", f"""WITH e AS ({VAF_ROWS}), s AS (SELECT *, {_CLASS} AS c FROM ({VAF_SRC.replace('{S}', 'VARCHAR')})),
f AS (SELECT gene, wt, c, trim(depth) AS d, min(event_id) AS o FROM s WHERE trim(depth) NOT IN ('', 'nan')
GROUP BY ALL), g AS (SELECT gene, wt, c, string_agg(d, ';' ORDER BY o) AS tumor_dna_depth
FROM f GROUP BY gene, wt, c)
SELECT row_id, e.gene, tumor_dna_depth FROM e LEFT JOIN g ON e.gene = g.gene AND coalesce(trim(e.wt), '') = g.wt AND {_CLASS} = g.c""")
def vaf_collapse_join(spark, sf_dir):
    src = rel(spark, sf_dir, VAF_SRC.replace("{S}", "STRING"))
    keys = [("gene", "gene"), ("wt", "wt"), ("hla_class", "hla_class")]
    x = annotate.attach_values(rel(spark, sf_dir, VAF_ROWS), src, keys, {"depth": "tumor_dna_depth"}, "event_id", {"hla_class": annotate.class_of})
    return x.select("row_id", "gene", "tumor_dna_depth")


HLA_JSON = '{"A": [12.5, 3, 0.1], "DQA1": [7.0, 2, 0.2], "DQB1": [4.0, 1, 0.3], "C": [5, 0.5], "E": [1]}'
# allele -> (least TPM, detail) by the rule: 'gene: TPM=..; count=..; rel=..' a chain, None for what the list lacks
HLA_CASES = {
    "HLA-A*02:01": (12.5, "A: TPM=12.5; count=3; rel=0.1"),
    " DQA1*01:01-DQB1*02:01 ": (4.0, "DQA1: TPM=7.0; count=2; rel=0.2; DQB1: TPM=4.0; count=1; rel=0.3"),
    "X": (None, ""),
    "HLA-C*01:01": (None, "C: TPM=None; count=5; rel=0.5"),
    "HLA-B*07:02": (None, ""),
    "HLA-E*01:01": (None, "E: TPM=None; count=None; rel=None"),
}
_CASE = lambda said: "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {said(x)}" for i, x in enumerate(HLA_CASES.items())) + " END"


@query(
    "hla_tpm",
    "SELECT event_id, " + _CASE(lambda x: f"CAST({'NULL' if x[1][0] is None else x[1][0]} AS DOUBLE)") + " AS hla_tpm, " + _CASE(lambda x: f"'{x[1][1]}'") + " AS hla_tpm_detail FROM {events}",
)
def hla_tpm(spark, sf_dir):
    x = rel(spark, sf_dir, "SELECT event_id, " + _CASE(lambda x: f"'{x[0]}'") + " AS hla_allele FROM {events}")
    m = F.from_json(F.lit(HLA_JSON), "map<string,array<string>>")
    return annotate.hla_tpm(x, "hla_allele", m).select("event_id", "hla_tpm", "hla_tpm_detail")


@query("props_json", "SELECT event_id, CAST(props->>'k' AS DOUBLE) AS k FROM {events}")
def props_json(spark, sf_dir):
    x = rel(spark, sf_dir, "SELECT event_id, props FROM {events}")
    return x.select("event_id", F.from_json("props", "map<string,double>")["k"].alias("k"))


@query("hla_format", """SELECT p_partkey, concat('HLA-A*0', p_size % 9, ':01,HLA-A*0', p_size % 9, ':01,DRB1*1', p_size % 4, ':02') AS alleles
FROM {part}""")
def hla_format(spark, sf_dir):
    x = rel(spark, sf_dir, """SELECT p_partkey, map('A', array(concat('A*0', p_size % 9, ':01:02'), concat('A*0', p_size % 9, ':01')), 'DRB1', array(concat('DRB1*1',
  p_size % 4, ':02:01:01'))) AS m
FROM {part}""")
    return x.select("p_partkey", annotate.hla_format(F.col("m")).alias("alleles"))


@query("kmer_windows", """SELECT p_partkey, k, pos, substr(p_name, pos + 1, k) AS kmer FROM {part}, (SELECT unnest([8, 9, 10]) AS k), (SELECT unnest(range(0,
  64))::INTEGER AS pos)
WHERE pos <= length(p_name) - k""")
def kmer_windows(spark, sf_dir):
    return annotate.sequence_windows(rel(spark, sf_dir, "SELECT p_partkey, p_name FROM {part}"), "p_name", [8, 9, 10]).select("p_partkey", "k", "pos", "kmer")


# expression and networks --------------------------------------------------------------------------
COUNTS = """SELECT concat(p_brand, '.', l_linenumber % 2) AS gene, concat('n', o_custkey % 25) AS sample_id, CAST(sum(l_quantity) AS BIGINT) AS count
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
GROUP BY 1, 2"""
_SUMS = f"SELECT split_part(gene, '.', 1) AS gene, sample_id, CAST(sum(count) AS BIGINT) AS count FROM ({COUNTS}) GROUP BY 1, 2"


def gene_counts(spark, sf_dir):
    return keep(expression.by_gene(rel(spark, sf_dir, COUNTS)), "counts")


query("count_matrix_rowsum", _SUMS)(gene_counts)
query("low_count_filter", f"""WITH c AS ({_SUMS}) SELECT * FROM c WHERE gene IN (SELECT gene FROM c GROUP BY gene
HAVING count(*) FILTER (count >= 400) >= (SELECT count(DISTINCT sample_id)
FROM c) // 5)""")(lambda s, d: expression.expressed(gene_counts(s, d), 400))


@query("size_factors", f"""WITH c AS ({_SUMS}), l AS (SELECT gene, sample_id, ln(CAST(count AS DOUBLE)) AS l
FROM c WHERE count > 0), m AS (SELECT gene, avg(l) AS m FROM l GROUP BY gene
HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM c)) SELECT sample_id, round(exp(median(l - m)), 6) AS size_factor
FROM l JOIN m USING (gene) GROUP BY sample_id""")
def size_factors(spark, sf_dir):
    return expression.size_factors(gene_counts(spark, sf_dir)).withColumn("size_factor", F.round("size_factor", 6))


@query("vst_values")
def vst_values(spark, sf_dir):
    return expression.vst(expression.by_gene(rel(spark, sf_dir, COUNTS))).withColumn("value", F.round("value", 6))


VALUES = """SELECT p_brand AS gene, concat('n', o_custkey % 25) AS sample_id, CAST(sum(l_quantity) AS DOUBLE) AS value
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
GROUP BY 1, 2"""
# leave-one-out correlations one by one, not by the closed form
_NAIVE = f"""WITH v AS ({VALUES}), n AS (SELECT CAST(count(DISTINCT sample_id) AS DOUBLE) AS n
FROM v),
f AS (SELECT * FROM v WHERE gene IN (SELECT gene FROM v GROUP BY gene HAVING count(*) = (SELECT n
FROM n))),
x AS (SELECT a.gene AS a, b.gene AS b, a.sample_id, a.value AS va, b.value AS vb
FROM f a JOIN f b ON a.sample_id = b.sample_id AND a.gene < b.gene),
r AS (SELECT a, b, corr(va, vb) AS r FROM x GROUP BY a, b),
q AS (SELECT x.a, x.b, s.sample_id, corr(va, vb) AS q FROM x JOIN (SELECT DISTINCT sample_id
FROM v) s ON x.sample_id <> s.sample_id GROUP BY x.a, x.b, s.sample_id),
e AS (SELECT sample_id, r.a, r.b, n * (r - q) + q AS weight FROM q JOIN r USING (a, b), n
WHERE n >= 3)"""


def sample_edges(spark, sf_dir, pairs=None):
    return lioness.edges(rel(spark, sf_dir, VALUES), pairs)


query(
    "lioness_edges", _NAIVE + " SELECT sample_id, a, b, round(weight, 6) AS weight FROM e",
)(lambda s, d: sample_edges(s, d).withColumn("weight", F.round("weight", 6)))


@query("wci_strength", _NAIVE + """, g AS (SELECT sample_id, a AS gene, weight FROM e UNION ALL SELECT sample_id, b, weight
FROM e), s AS (SELECT sample_id, gene, sum(abs(weight)) + 1 AS strength, count(*) + 1 AS degree
FROM g GROUP BY 1, 2) SELECT sample_id, gene, round(strength, 6) AS strength, CAST(degree AS BIGINT) AS degree, round(strength / sum(strength) OVER (PARTITION BY sample_id),
  6) AS wci
FROM s""")
def wci_strength(spark, sf_dir):
    x = network.connectivity(lioness.strengths(rel(spark, sf_dir, VALUES)))
    return x.select("sample_id", "gene", F.round("strength", 6).alias("strength"), "degree", F.round("wci", 6).alias("wci"))


PPI = """SELECT l_returnflag AS sample_id, min(l_orderkey * 10 + l_linenumber) AS edge_id, concat('p', l_partkey) AS src, concat('s',
  l_suppkey) AS dst, sum(l_extendedprice) AS weight
FROM {lineitem} GROUP BY l_returnflag, l_partkey, l_suppkey, l_linenumber % 2"""
_TOP = f"""WITH e AS ({PPI}), n AS (SELECT sample_id, edge_id, src AS gene, weight
FROM e UNION ALL SELECT sample_id, edge_id, dst, weight FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, gene ORDER BY abs(weight) DESC, edge_id) AS r, count(*) OVER (PARTITION BY sample_id,
  gene) AS c
FROM n),
t AS (SELECT * FROM e WHERE (sample_id, edge_id) IN (SELECT sample_id, edge_id
FROM k WHERE r <= greatest(1, ceil(CAST(c AS DOUBLE) * CAST(0.2 AS DOUBLE)))))"""


def top_edges(spark, sf_dir):
    return network.top_proportion(rel(spark, sf_dir, PPI), 0.2, parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), times=2))


query(
    "ppi_top_prop", _TOP + " SELECT sample_id, edge_id, src, dst, round(weight, 6) AS weight FROM t",
)(lambda s, d: top_edges(s, d).select("sample_id", "edge_id", "src", "dst", F.round("weight", 6).alias("weight")))
# pairs with customers are in no reference network: they are the candidates
PAIRS = """SELECT sample_id, a, b, max(w) AS weight FROM (SELECT l_returnflag AS sample_id, concat('p', l_partkey) AS a, concat('s',
  l_suppkey) AS b, l_extendedprice AS w
FROM {lineitem}
UNION ALL SELECT l_returnflag, concat('c', o_custkey % 200), concat('s', l_suppkey), l_extendedprice
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) x GROUP BY sample_id, a, b"""
MEMBRANE = "SELECT concat('s', s_suppkey) AS gene FROM {supplier} WHERE s_nationkey < 8"
_ENRICH = _TOP + f""", w AS ({PAIRS}), m AS ({MEMBRANE}), u AS (SELECT sample_id, count(*) AS base
FROM e GROUP BY 1),
f AS (SELECT * FROM w WHERE (a IN (SELECT gene FROM m) OR b IN (SELECT gene
FROM m)) AND (sample_id, a, b) NOT IN (SELECT sample_id, least(src, dst), greatest(src, dst)
FROM t)),
c AS (SELECT u.sample_id, base, least(ceil(CAST(base AS DOUBLE) * CAST(0.05 AS DOUBLE)), coalesce(n, 0)) AS requested, coalesce(n, 0) AS candidates
FROM u LEFT JOIN (SELECT sample_id, count(*) AS n FROM f GROUP BY 1) USING (sample_id)),
d AS (SELECT sample_id, a, b, weight FROM (SELECT f.*, requested, row_number() OVER (PARTITION BY f.sample_id
ORDER BY abs(weight) DESC, a, b) AS r FROM f JOIN c USING (sample_id)) WHERE r <= requested),
x AS (SELECT sample_id, edge_id, least(src, dst) AS a, greatest(src, dst) AS b, weight
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, least(src, dst), greatest(src, dst)
ORDER BY edge_id) AS r FROM t) LEFT JOIN c USING (sample_id) WHERE r = 1 OR coalesce(requested, 0) = 0
  UNION ALL SELECT sample_id, NULL, a, b, weight FROM d)"""


def _enriched(spark, sf_dir):
    return network.enrich(top_edges(spark, sf_dir), rel(spark, sf_dir, PPI), rel(spark, sf_dir, PAIRS), rel(spark, sf_dir, MEMBRANE), FilterConfig(), store=keep)


@query("membrane_enrich", _ENRICH + " SELECT sample_id, edge_id, a, b, round(weight, 6) AS weight FROM x")
def membrane_enrich(spark, sf_dir):
    x = _enriched(spark, sf_dir)[0]
    return x.select("sample_id", "edge_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.round("weight", 6).alias("weight"))


_QC = ", ".join(f"CAST({n} AS BIGINT) AS {c}" for n, c in (("base", "unfiltered_edges"), ("t1.n", "ppi_edges"), ("candidates", "candidates"), ("requested", "requested"), ("requested", "added"), ("x1.n", "final_edges"), ("v1.n", "ppi_vertices"), ("v2.n", "final_vertices")))


@query("membrane_qc", _ENRICH + f""", own AS (SELECT DISTINCT sample_id, src AS gene FROM t UNION SELECT DISTINCT sample_id, dst
FROM t),
every AS (SELECT * FROM own UNION SELECT sample_id, gene FROM c, m WHERE requested > 0
UNION SELECT sample_id, a FROM d UNION SELECT sample_id, b FROM d),
t1 AS (SELECT sample_id, count(*) AS n FROM t GROUP BY 1), x1 AS (SELECT sample_id, count(*) AS n
FROM x GROUP BY 1), v1 AS (SELECT sample_id, count(*) AS n FROM own GROUP BY 1),
v2 AS (SELECT sample_id, count(*) AS n FROM every GROUP BY 1)
SELECT c.sample_id, true AS enabled, CAST(0.05 AS DOUBLE) AS add_prop, 'unfiltered_ppi_edges' AS denominator, true AS require_membrane_endpoint,
  'absolute_weight' AS metric, {_QC}
FROM c JOIN t1 USING (sample_id) JOIN x1 USING (sample_id) JOIN v1 USING (sample_id)
JOIN v2 USING (sample_id)""")
def membrane_qc(spark, sf_dir):
    return _enriched(spark, sf_dir)[1]


VERTICES = """SELECT DISTINCT l_returnflag AS sample_id, concat('p', l_partkey) AS gene
FROM {lineitem} UNION SELECT DISTINCT l_returnflag, concat('s', l_suppkey)
FROM {lineitem}"""


@query("degree_strength", _TOP + f""", v AS ({VERTICES}), g AS (SELECT sample_id, src AS gene, weight FROM t
UNION ALL SELECT sample_id, dst, weight FROM t) SELECT v.sample_id, v.gene, CAST(count(weight) AS BIGINT) AS degree, round(coalesce(sum(abs(weight)),
  0), 4) AS strength
FROM v LEFT JOIN g ON v.sample_id = g.sample_id AND v.gene = g.gene GROUP BY 1, 2""")
def degree_strength(spark, sf_dir):
    x = network.degree_strength(top_edges(spark, sf_dir), rel(spark, sf_dir, VERTICES))
    return x.withColumn("strength", F.round("strength", 4))


# every line is an edge; keys are folded, so that there are some components of different size
SPARSE = """SELECT l_linestatus AS sample_id, l_orderkey * 10 + l_linenumber AS edge_id, concat('p', l_partkey % 300) AS src, concat('s',
  l_partkey % 20, '_', l_suppkey % (3 + l_partkey % 20)) AS dst, CAST(1 + l_orderkey % 5 AS DOUBLE) AS weight
FROM {lineitem}"""
SPARSE_V = f"""SELECT DISTINCT sample_id, src AS gene FROM ({SPARSE}) UNION SELECT DISTINCT sample_id, dst
FROM ({SPARSE}) UNION SELECT 'O', 'lonely'"""
_COMP = f"""WITH RECURSIVE e AS ({SPARSE}), l AS (SELECT DISTINCT sample_id, src AS x, dst AS y
FROM e UNION SELECT DISTINCT sample_id, dst, src FROM e), v AS ({SPARSE_V}),
r(sample_id, gene, c) AS (SELECT sample_id, gene, gene FROM v UNION SELECT r.sample_id, l.y, r.c
FROM r JOIN l ON r.sample_id = l.sample_id AND r.gene = l.x), m AS (SELECT sample_id, gene, min(c) AS component
FROM r GROUP BY 1, 2)"""


def _labels(spark, sf_dir):
    return network.components(rel(spark, sf_dir, SPARSE), rel(spark, sf_dir, SPARSE_V))


query("components", _COMP + " SELECT * FROM m")(_labels)
query("component_sizes", _COMP + """, s AS (SELECT sample_id, component, count(*) AS size FROM m GROUP BY 1, 2),
w AS (SELECT e.sample_id, component, sum(weight) AS weight FROM e JOIN m ON e.sample_id = m.sample_id AND e.src = m.gene
GROUP BY 1, 2) SELECT s.sample_id, s.component, CAST(size AS BIGINT) AS size, coalesce(weight, 0) AS weight
FROM s LEFT JOIN w ON s.sample_id = w.sample_id AND s.component = w.component""")(
    lambda s, d: network.component_sizes(_labels(s, d), rel(s, d, SPARSE)))
query("adjacency", f"""WITH e AS ({SPARSE}) SELECT sample_id, least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight
FROM e WHERE src <> dst GROUP BY 1, 2, 3""")(lambda s, d: network.adjacency(rel(s, d, SPARSE)))


@query("matrix_market_cells", f"""WITH e AS ({SPARSE}), a AS (SELECT sample_id, least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight
FROM e WHERE src <> dst GROUP BY 1, 2, 3), g AS (SELECT sample_id, gene, row_number() OVER (PARTITION BY sample_id
ORDER BY gene) AS i FROM ({SPARSE_V})), t AS (SELECT * FROM a UNION ALL SELECT sample_id, b, a, weight
FROM a) SELECT t.sample_id, CAST(x.i AS INTEGER) AS row, CAST(y.i AS INTEGER) AS col, weight
FROM t JOIN g x ON t.sample_id = x.sample_id AND t.a = x.gene JOIN g y ON t.sample_id = y.sample_id AND t.b = y.gene""")
def matrix_market_cells(spark, sf_dir):
    return sinks.indexed(network.adjacency(rel(spark, sf_dir, SPARSE)), rel(spark, sf_dir, SPARSE_V))[0]


query("betweenness")(lambda s, d: graph_kernels.betweenness(rel(s, d, SPARSE), rel(s, d, SPARSE_V)).withColumn("betweenness", F.round("betweenness", 9)))
query("component_impact")(lambda s, d: graph_kernels.impact(rel(s, d, SPARSE), rel(s, d, SPARSE_V)).withColumn(
    "largest_component_impact", F.round("largest_component_impact", 9),
))


@query("id_translation", """WITH m AS (SELECT s_suppkey // 2 AS k, concat('E', s_suppkey) AS e FROM {supplier}) SELECT c_custkey, x.e AS src, y.e AS dst
FROM {customer} JOIN m x ON c_custkey % 53 = x.k JOIN m y ON c_custkey % 37 = y.k""")
def id_translation(spark, sf_dir):
    pairs = rel(spark, sf_dir, "SELECT c_custkey, c_custkey % 53 AS id1, c_custkey % 37 AS id2 FROM {customer}")
    ids = rel(spark, sf_dir, "SELECT s_suppkey div 2 AS entrez, concat('E', s_suppkey) AS ensembl FROM {supplier}")
    return network.entrez_to_ensembl(pairs, ids).select("c_custkey", "src", "dst")


REFERENCE = """SELECT l_orderkey * 10 + l_linenumber AS edge_id, CASE l_linenumber WHEN 7 THEN concat('s', l_suppkey) ELSE concat('p', l_partkey) END AS src,
  concat('s', l_suppkey) AS dst
FROM {lineitem}"""
SAMPLED = """SELECT l_linestatus AS sample_id, concat('p', l_partkey) AS a, concat('s', l_suppkey) AS b, CASE WHEN max(l_quantity) > 49 THEN CAST('NaN' AS DOUBLE) WHEN max(l_quantity) < 4 THEN NULL ELSE max(l_extendedprice) END AS weight
FROM {lineitem} GROUP BY l_linestatus, l_partkey, l_suppkey"""


@query("ppi_weighted", f"""WITH r AS ({REFERENCE}), w AS ({SAMPLED}) SELECT sample_id, edge_id, src, dst, weight
FROM r JOIN w ON least(src, dst) = a AND greatest(src, dst) = b WHERE src <> dst AND weight IS NOT NULL AND NOT isnan(weight)""")
def ppi_weighted(spark, sf_dir):
    return network.weighted(rel(spark, sf_dir, REFERENCE), rel(spark, sf_dir, SAMPLED))


STRENGTH = """SELECT concat('n', o_custkey % 25) AS sample_id, p_brand AS gene, sum(l_quantity) AS value
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
GROUP BY 1, 2"""


@query("cosine_samples", f"""WITH s AS ({STRENGTH}), n AS (SELECT sample_id, sqrt(sum(value * value)) AS n
FROM s GROUP BY 1), d AS (SELECT x.sample_id AS s1, y.sample_id AS s2, sum(x.value * y.value) AS d
FROM s x JOIN s y ON x.gene = y.gene AND x.sample_id <= y.sample_id GROUP BY 1, 2) SELECT a.sample_id AS s1, b.sample_id AS s2,
  round(coalesce(d, 0) / (a.n * b.n), 6) AS similarity, round(1 - coalesce(d, 0) / (a.n * b.n), 6) + 0.0 AS distance
FROM n a JOIN n b ON a.sample_id <= b.sample_id LEFT JOIN d ON d.s1 = a.sample_id AND d.s2 = b.sample_id""")
def cosine_samples(spark, sf_dir):
    x = similarity.cosine(rel(spark, sf_dir, STRENGTH))
    return x.select("s1", "s2", F.round("similarity", 6).alias("similarity"), (F.round("distance", 6) + 0.0).alias("distance"))


@query("cosine_leaf_order")
def cosine_leaf_order(spark, sf_dir):
    return similarity.leaf_order(similarity.cosine(rel(spark, sf_dir, STRENGTH)))


# variants -----------------------------------------------------------------------------------------
VCF = """SELECT concat('chr', l_linenumber) AS chrom, l_orderkey AS pos, CASE WHEN l_suppkey % 3 = 0 THEN 'AT' ELSE 'A' END AS ref,
  CASE WHEN l_partkey % 4 = 0 THEN 'GC' ELSE 'G' END AS alt, l_quantity / 10 AS QD, l_extendedprice / 1000 AS FS, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity + 10 END AS MQ,
  l_discount * 100 AS SOR, l_quantity - 30 AS MQRankSum, l_quantity - 20 AS ReadPosRankSum, l_quantity AS DP, l_tax * 500 AS GQ
FROM {lineitem}"""


def _tags(rules) -> str:
    return "coalesce(nullif(concat_ws(';', " + ", ".join(f"CASE WHEN {f} {op} {x} THEN '{n}' END" for n, f, op, x in rules) + "), ''), 'PASS')"


for _n, _r in (("snp", variants.SNP), ("indel", variants.INDEL)):
    _snp = "length(ref) = 1 AND length(alt) = 1"
    query(f"vcf_hard_filter_{_n}", f"""WITH v AS ({VCF}) SELECT chrom, pos, ref, alt, {_tags(_r)} AS filter, {_tags(variants.GENOTYPE)} AS ft
FROM v WHERE {_snp if _n == 'snp' else f'NOT ({_snp})'}""")(
        lambda s, d, n=_n, r=_r: variants.hard_filter(variants.select_type(rel(s, d, VCF), n.upper()), r).select("chrom", "pos", "ref", "alt", "filter", "ft"))


@query("vcf_concat_passing", f"""WITH v AS ({VCF}), f AS (SELECT *, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN {_tags(variants.SNP)} ELSE {_tags(variants.INDEL)} END AS filter
FROM v) SELECT chrom, pos, ref, alt FROM f WHERE filter = 'PASS'""")
def vcf_concat_passing(spark, sf_dir):
    v = rel(spark, sf_dir, VCF)
    return variants.concat_sorted([variants.passing(variants.hard_filter(variants.select_type(v, k), r)).select("chrom", "pos", "ref", "alt") for k, r in (("SNP", variants.SNP), ("INDEL", variants.INDEL))])


BED = """SELECT concat('chr', 1 + n_nationkey % 5) AS chrom, CAST(n_nationkey * 400 AS BIGINT) AS start, CAST(n_nationkey * 400 + 150 + n_regionkey * 90 AS BIGINT) AS stop
FROM {nation}"""


@query("interval_restrict", f"""WITH v AS ({VCF}), b AS ({BED}) SELECT chrom, pos, ref, alt FROM v WHERE EXISTS (SELECT 1
FROM b WHERE b.chrom = v.chrom AND v.pos > b.start AND v.pos <= b.stop)""")
def interval_restrict(spark, sf_dir):
    return variants.restrict(rel(spark, sf_dir, VCF), rel(spark, sf_dir, BED), 1000).select("chrom", "pos", "ref", "alt")


HALF = """SELECT concat('chr', l_linenumber) AS chrom, l_orderkey AS pos, 'A' AS ref, 'G' AS alt, max(l_quantity) AS dp
FROM {lineitem} WHERE l_returnflag <> '{m}' GROUP BY 1, 2"""


@query("vcf_combine", f"""WITH a AS ({HALF.replace('{m}', 'A')}), b AS ({HALF.replace('{m}', 'R')}) SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos,
  b.pos) AS pos, 'A' AS ref, 'G' AS alt, coalesce(a.dp, b.dp) AS dp, a.chrom IS NOT NULL AS in_first, b.chrom IS NOT NULL AS in_second
FROM a FULL JOIN b ON a.chrom = b.chrom AND a.pos = b.pos""")
def vcf_combine(spark, sf_dir):
    prepare(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # dealt by the key of both groups and the join, into as many parts as the rows need: a task's tables do not grow with the input
    lines = dealt(lines, parts(lines, times=2), F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")), "l_orderkey")
    first, second = (spark.sql(HALF.replace("{m}", m), lineitem=lines) for m in "AR")
    return variants.combine(first, second, ["dp"])


@query("vcf_expression", """SELECT l_orderkey, l_linenumber, t.tpm FROM {lineitem} LEFT JOIN (SELECT p_partkey, p_retailprice AS tpm
FROM {part} WHERE p_size > 15) t ON l_partkey = p_partkey""")
def vcf_expression(spark, sf_dir):
    rows = rel(spark, sf_dir, "SELECT l_orderkey, l_linenumber, concat('T', l_partkey, '.2') AS transcript FROM {lineitem}")
    return variants.attach_expression(
        rows, rel(spark, sf_dir, "SELECT concat('T', p_partkey, '.7') AS transcript, p_retailprice AS tpm FROM {part} WHERE p_size > 15"),
    ).select("l_orderkey", "l_linenumber", "tpm")


VCF_HEADER = variant_files.Header(
    ["##fileformat=VCFv4.2", *[f"##contig=<ID=chr{i},length=1000>" for i in range(7, 0, -1)], '##INFO=<ID=QD,Number=1,Type=Float,Description="quality, by depth">', '##INFO=<ID=AC,Number=A,Type=Integer,Description="x">',
     '##INFO=<ID=DB,Number=0,Type=Flag,Description="y">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="z">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="w">'], ["TUMOR", "germline"])
_CALLS = """SELECT concat('chr', l_linenumber) AS chrom, l_orderkey AS pos, CASE WHEN l_suppkey % 3 = 0 THEN concat('rs', l_partkey) END AS id, 'A' AS ref, CASE WHEN l_partkey % 4 = 0 THEN 'G,T' ELSE 'G' END AS alt,
  l_quantity / 10 AS qd, l_returnflag = 'N' AS db, CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS INT) END AS dp, l_discount > 0.05 AS het FROM {lineitem}"""


@query("variant_file", f"""WITH c AS ({_CALLS}) SELECT chrom, pos, id, ref, alt, 'PASS' AS filter, qd AS "QD", db AS "DB", CASE WHEN alt = 'G,T' THEN 3 ELSE 1 END AS ac, sample_id,
  CASE WHEN sample_id = 'TUMOR' AND het THEN '0/1' ELSE '0/0' END AS "GT", CASE WHEN sample_id = 'TUMOR' THEN dp ELSE 7 END AS "DP" FROM c, (SELECT unnest(['TUMOR', 'NORMAL']) AS sample_id)""")
def variant_file(spark, sf_dir):
    """Calls written in the header's contig order and read back, with a sample renamed on the way; genotypes are rows."""
    x = rel(spark, sf_dir, _CALLS).selectExpr(
        "chrom", "pos", "id", "ref", "alt", "qd * 10 AS qual", "'PASS' AS filter", "array('GT', 'DP') AS format",
        "if(db, map('QD', cast(qd as string), 'DB', null, 'AC', if(alt = 'G,T', '1,2', '1')), map('QD', cast(qd as string), 'AC', if(alt = 'G,T', '1,2', '1'))) AS info",
        "array(struct('TUMOR' AS sample_id, map('GT', if(het, '0/1', '0/0'), 'DP', cast(dp as string)) AS fields), struct('germline' AS sample_id, map('GT', '0/0', 'DP', '7') AS fields)) AS samples",
    )
    path = folder(spark, "calls")
    variant_files.write(variant_files.renamed(x, "germline", "NORMAL"), VCF_HEADER.renamed("germline", "NORMAL"), path)
    head, back = variant_files.scan(spark, path)
    y = variant_files.genotypes(variant_files.with_info(back, head, ["QD", "DB", "AC"]), head, ["GT", "DP"])
    return y.select("chrom", "pos", "id", "ref", "alt", "filter", "QD", "DB", F.aggregate("AC", F.lit(0), lambda a, v: a + v).alias("ac"), "sample_id", "GT", "DP")


@query("variant_sample_rename", "SELECT event_id, 'NORMAL' AS sample_id FROM {events} WHERE event_type = 'error'")
def variant_sample_rename(spark, sf_dir):
    x = rel(spark, sf_dir, "SELECT event_id, event_type AS sample_id FROM {events}")
    return variants.rename_sample(variants.single_sample(x, "error"), "error", "NORMAL")


# reports ------------------------------------------------------------------------------------------
_DEG = _TOP + """, g AS (SELECT sample_id, src AS gene FROM t UNION ALL SELECT sample_id, dst
FROM t), d AS (SELECT sample_id, gene, CAST(count(*) AS DOUBLE) AS degree
FROM g GROUP BY 1, 2)"""


def _degrees(spark, sf_dir):
    return network.degree_strength(top_edges(spark, sf_dir)).select("sample_id", "gene", F.col("degree").cast("double").alias("degree"))


@query("qc_stats", _DEG + """ SELECT sample_id, CAST(count(degree) AS BIGINT) AS n, round(avg(degree), 6) AS mean, median(degree) AS median, round(stddev_samp(degree),
  6) AS sd, max(degree) AS max, min(degree) AS min
FROM d GROUP BY 1""")
def qc_stats(spark, sf_dir):
    x = report.summary(_degrees(spark, sf_dir), "degree", ["sample_id"])
    return x.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("qc_histogram", _DEG + """, s AS (SELECT sample_id, min(degree) AS lo, max(degree) AS hi FROM d GROUP BY 1),
b AS (SELECT sample_id, lo, hi, CASE WHEN hi > lo THEN CAST(least(199, floor((degree - lo) / (hi - lo) * 200)) AS INTEGER) ELSE 0 END AS bin
FROM d JOIN s USING (sample_id)) SELECT sample_id, bin, round(lo + bin * (hi - lo) / 200, 6) AS low, CAST(count(*) AS BIGINT) AS n
FROM b GROUP BY sample_id, bin, lo, hi""")
def qc_histogram(spark, sf_dir):
    return report.histogram(_degrees(spark, sf_dir), "degree", ["sample_id"]).withColumn("low", F.round("low", 6))


_FD = """, g AS (SELECT sample_id, src AS gene, weight FROM t UNION ALL SELECT sample_id, dst, weight
FROM t), d AS (SELECT sample_id, gene, round(sum(abs(weight)), 2) AS v FROM g
GROUP BY 1, 2),
s AS (SELECT sample_id, min(v) AS lo, max(v) AS hi, count(*) AS n, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(CAST(count(*) AS DOUBLE),
  CAST(1 AS DOUBLE) / 3) AS width, count(DISTINCT round(v, 6)) AS u
FROM d GROUP BY 1),
bk AS (SELECT *, CASE WHEN n < 2 THEN 80 ELSE greatest(80, least(300, CASE WHEN width > 0 AND hi > lo THEN ceil((hi - lo) / width) ELSE u END)) END AS k
FROM s),
b AS (SELECT d.sample_id, lo, hi, k, CASE WHEN hi > lo THEN CAST(least(k - 1, floor((v - lo) / (hi - lo) * k)) AS INTEGER) ELSE 0 END AS bin
FROM d JOIN bk USING (sample_id))
SELECT sample_id, bin, round(lo + bin * (hi - lo) / k, 4) AS low, CAST(count(*) AS BIGINT) AS n
FROM b GROUP BY sample_id, bin, lo, hi, k"""


@query("qc_histogram_fd", _TOP + _FD)
def qc_histogram_fd(spark, sf_dir):
    x = network.degree_strength(top_edges(spark, sf_dir)).withColumn("strength", F.round("strength", 2))
    return report.histogram(x, "strength", ["sample_id"], None).withColumn("low", F.round("low", 4))


query("qc_top_components", _COMP + """, s AS (SELECT sample_id, component, count(*) AS size FROM m GROUP BY 1, 2) SELECT sample_id, component, CAST(size AS BIGINT) AS size,
  CAST(r AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY size DESC, component) AS r
FROM s) WHERE r <= 10""")(
    lambda s, d: _top_components(s, d))


def _top_components(spark, sf_dir):
    x = _labels(spark, sf_dir).groupBy("sample_id", "component").agg(F.count("*").alias("size"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("size"), "component"))).filter("rank <= 10")


def _esc(x: str) -> str:
    for raw, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{said}')"
    return x


_BARE = "regexp_replace({x}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


@query("html_cells", f"""SELECT page_id, {_esc('html')} AS cell, CASE WHEN t = '' OR lower(t) = 'nan' THEN '' ELSE concat('<span class=\"pill\" title=\"',
  {_esc('t')}, '\">MF</span>') END AS badge
FROM (SELECT page_id, coalesce(html, '') AS html, coalesce({_BARE.replace('{x}', 'html')}, '') AS t
FROM {{pages}})""")
def html_cells(spark, sf_dir):
    x = rel(spark, sf_dir, "SELECT page_id, html FROM {pages}")
    return x.select("page_id", report.escape("html").alias("cell"), report.badge("html", "MF").alias("badge"))


# what the table shows for each text of roles, written out
_ACT, _LOF = (
    "Act: Activating mutation (oncogene-like): mutation confers gain-of-function or increased activity.",
    "LoF: Loss of Function (tumor suppressor-like): mutation likely inactivates or reduces the gene&#x27;s function.",
)
ROLE_TEXTS = "CASE p_size % 5 WHEN 0 THEN 'Act, LoF;ACTIVATING' WHEN 1 THEN ' lof ' WHEN 2 THEN 'x \"q\" act' WHEN 3 THEN p_type ELSE 'NaN' END"
_SPAN = lambda title, shown: f"concat('<span class=\"driver\" title=\"', {title}, '\">', {shown}, '</span>')"
_TIPS = f"""CASE p_size % 5 WHEN 0 THEN {_SPAN(f"concat('{_ACT} ', chr(10), '{_LOF}')", "'Act, LoF;ACTIVATING'")} WHEN 1 THEN {_SPAN(f"'{_LOF}'", "'lof'")}
WHEN 2 THEN {_SPAN(f"concat('x ', chr(10), '&quot;q&quot; ', chr(10), '{_ACT}')", "'x &quot;q&quot; act'")} WHEN 3 THEN {_SPAN("replace(p_type, ' ', concat(' ', chr(10)))", "p_type")} ELSE '' END"""


@query("driver_tips", f"SELECT p_partkey, {_TIPS} AS tip, CASE WHEN p_size % 2 = 0 THEN 'Genomic' ELSE 'Fusion' END AS source FROM {{part}}")
def driver_tips(spark, sf_dir):
    x = rel(spark, sf_dir, f"SELECT p_partkey, {ROLE_TEXTS} AS r, CASE WHEN p_size % 2 = 0 THEN 'Somatic' ELSE 'Fusion' END AS m FROM {{part}}")
    return x.select("p_partkey", report.driver_tip("r").alias("tip"), report.display_source("m").alias("source"))


# the whole chain ----------------------------------------------------------------------------------
ESS = """SELECT concat('g', i) AS gene, CAST(i AS DOUBLE) / 10 - 2 AS chronos FROM (SELECT DISTINCT CAST(user_id % 40 AS INT) AS i
FROM {events}) WHERE i < 27"""
FLAG_WEIGHTS = (("median_mt_ic50", 0.6, "lower_better"), ("chronos", 0.4, "lower_better"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources united, essentiality and driver roles attached, consensus rank per sample."""
    x = merged(spark, sf_dir)
    x = annotate.by_key(x, keep(annotate.essentiality_rows(rel(spark, sf_dir, ESS)), "essentiality"), "gene_name", "gene", {"chronos": "chronos"})
    x = annotate.by_key(
        x, keep(annotate.drivers(rel(spark, sf_dir, DRIVER.replace("p_brand AS symbol", "concat('G', p_size % 40) AS symbol"))), "drivers"), "gene_name",
        "symbol", {"role": "driver_role", "cohort": "driver_cohort"},
    )
    return borda.consensus(x.withColumn("row_id", union.merged_order(x)), BordaConfig([Feature(*w) for w in FLAG_WEIGHTS])).drop("row_id")


_V = [w[0] for w in FLAG_WEIGHTS]
_PTS = ",".join(f"""CASE WHEN {v} IS NOT NULL THEN CASE WHEN count({v}) OVER (PARTITION BY sample_id) <= 1 THEN CAST(1 AS DOUBLE) ELSE (count({v}) OVER (PARTITION BY sample_id) - (CAST(rank() OVER (PARTITION BY sample_id,
  {v} IS NULL
ORDER BY {v}) AS DOUBLE) + (count(*) OVER (PARTITION BY sample_id, {v} IS NULL, {v}) - 1) / CAST(2 AS DOUBLE))) / CAST(count({v}) OVER (PARTITION BY sample_id) - 1 AS DOUBLE) END END AS p{i}""" for i, v in enumerate(_V))
_W = [f"CAST({w[1]} AS DOUBLE)" for w in FLAG_WEIGHTS]
_SC = "CASE WHEN ({t}) > 0 THEN ({m}) / ({t}) ELSE 0 END".replace("{m}", " + ".join(["CAST(0 AS DOUBLE)", *(f"{w} * coalesce(p{i}, 0)" for i, w in enumerate(_W))])).replace(
    "{t}", " + ".join(["CAST(0 AS DOUBLE)", *(f"CASE WHEN p{i} IS NOT NULL THEN {w} ELSE 0 END" for i, w in enumerate(_W))])
)
_TEN = "pow(CAST(10 AS DOUBLE), 3 - floor(log10(abs(s))))"
query("prioritise", f"""WITH u AS ({MERGED_SQL}), ess AS ({ESS}), dr AS ({DRIVER.replace("p_brand AS symbol", "concat('G', p_size % 40) AS symbol")}),
dd AS (SELECT symbol, {_JOIN.replace("{c}", "role")}, {_JOIN.replace("{c}", "cohort")}
FROM dr WHERE lower(role) LIKE '%act%' OR lower(role) LIKE '%lof%' GROUP BY symbol),
j AS (SELECT u.*, chronos, dd.role AS driver_role, dd.cohort AS driver_cohort
FROM u LEFT JOIN ess ON upper(u.gene_name) = upper(ess.gene) LEFT JOIN dd ON upper(u.gene_name) = upper(dd.symbol)),
p AS (SELECT *, {_PTS} FROM j), s AS (SELECT * EXCLUDE (p0, p1), {_SC} AS s
FROM p)
SELECT * EXCLUDE (s), CASE WHEN s = 0 THEN s ELSE round(s * {_TEN}) / {_TEN} END AS "Borda_Score", CAST(rank() OVER (PARTITION BY sample_id
ORDER BY -s) AS DOUBLE) + (count(*) OVER (PARTITION BY sample_id, s) - 1) / CAST(2 AS DOUBLE) AS "Borda_Rank"
FROM s""")(flagship)


# the candidate workflow, every step ------------------------------------------------------------------
WF_METRICS = {n: f"""SELECT concat('s', l_suppkey % 5) AS sample_id, concat('E', l_partkey % {60 + i}, '.', l_linenumber) AS gene, {v} AS {n}
FROM {{lineitem}} GROUP BY l_suppkey % 5, l_partkey % {60 + i}, l_linenumber""" for i, (n, (v, _)) in enumerate(_M.items())}
WF_MAP = """SELECT DISTINCT concat('E', l_partkey % 60, '.9') AS gene_id, CASE WHEN l_partkey % 60 = 7 THEN ' ' ELSE concat('G', l_partkey % 60 % 45) END AS symbol
FROM {lineitem}"""
WF_DRIVER = DRIVER.replace("p_brand AS symbol", "concat('G', p_size % 40) AS symbol")
WF_GAF = GAF.replace("p_brand AS gene", "concat('G', p_partkey % 40) AS gene")
WF_SETS = """SELECT concat('g', n_nationkey) AS gene, r_name AS set_name FROM {nation}
JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT concat('G', n_nationkey), concat('Z', n_regionkey % 2)
FROM {nation}"""
WF_ALLELES = """SELECT event_id AS _order, concat('s', user_id % 5) AS sample_id, concat('G', user_id % 40) AS g, CASE WHEN event_id % 3 = 0 THEN 'mhc_ii' ELSE 'Class I' END AS c,
  CASE event_id % 8 WHEN 0 THEN 'nan' ELSE CAST(event_id % 4 AS {S}) END AS `Tumor DNA Depth`, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 3 AS {S}) END AS `Tumor DNA VAF`
FROM {events}"""
WF_HLA = """SELECT concat('s', user_id % 5) AS sample_id, map('A', array(CAST(10 + user_id % 5 AS STRING), '3', '0.1'), 'B', array('7',
  '0.2'), 'DRB1', array('4.25', '1', '0.3')) AS m
FROM {events} WHERE user_id % 5 > 0 GROUP BY user_id % 5"""
WF_FEATURES = (("median_mt_ic50", 0.5, "lower_better"), ("Net_Strength", 0.3, "higher_better"), ("Depmap_survivability_score", 0.2, "lower_better"))


def candidate_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to the final table: essentiality, drivers, network metrics, consensus rank, terms, gene sets, HLA abundance, allele frequencies."""
    of = lambda sql: rel(spark, sf_dir, sql)
    dims = workflow.Dimensions(
        essentiality=of(ESS).withColumnRenamed("chronos", "median_score"), drivers=annotate.drivers(of(WF_DRIVER)), gene_map=of(WF_MAP), metrics={n: of(q) for n, q in WF_METRICS.items()},
        go=of(WF_GAF), go_names=of(GO), gene_sets=of(WF_SETS), hla_expression=of(WF_HLA), allele_tables=of(WF_ALLELES.replace("{S}", "STRING")),
    )
    return workflow.prioritise(merged(spark, sf_dir), dims, BordaConfig([Feature(*w) for w in WF_FEATURES]), [("gene_name", "g"), ("hla_class", "c")])


def _workflow_sql() -> str:
    signed = [f'-"{c}"' if d == "higher_better" else f'"{c}"' for c, _, d in WF_FEATURES]
    n = "count({v}) OVER (PARTITION BY sample_id)"
    rank = "CAST(rank() OVER (PARTITION BY sample_id, {v} IS NULL ORDER BY {v}) AS DOUBLE) + (count(*) OVER (PARTITION BY sample_id, {v} IS NULL, {v}) - 1) / CAST(2 AS DOUBLE)"
    points = ", ".join(f"CASE WHEN {{v}} IS NOT NULL THEN CASE WHEN {n} <= 1 THEN CAST(1 AS DOUBLE) ELSE ({n} - ({rank})) / CAST({n} - 1 AS DOUBLE) END END AS p{i}".replace("{v}", f"v{i}") for i in range(3))
    w = [f"CAST({x[1]} AS DOUBLE)" for x in WF_FEATURES]
    mass = " + ".join(["CAST(0 AS DOUBLE)", *(f"{w[i]} * coalesce(p{i}, 0)" for i in range(3))])
    there = " + ".join(["CAST(0 AS DOUBLE)", *(f"CASE WHEN p{i} IS NOT NULL THEN {w[i]} ELSE 0 END" for i in range(3))])
    outer = " UNION ALL BY NAME ".join(f"SELECT sample_id, split_part(gene, '.', 1) AS gene, {m} FROM ({q})" for m, q in WF_METRICS.items())
    med = ", ".join(f"median({m}) AS {m}" for m in WF_METRICS)
    nets = ", ".join(f'sy.{m} AS "{c}"' for m, c in workflow.NAMES.items())
    kept = lambda c, name: f"""SELECT sample_id, g, k, string_agg(d, ';' ORDER BY o) AS {name} FROM (SELECT sample_id, g, k, \"{c}\" AS d, min(_order) AS o
FROM al WHERE \"{c}\" <> 'nan' GROUP BY ALL) GROUP BY ALL"""  # noqa: E731
    return f"""WITH u AS ({MERGED_SQL}), es AS ({ESS}), dr AS ({WF_DRIVER}),
dd AS (SELECT symbol, {", ".join(_JOIN.replace("{c}", c) for c in ("role", "cohort", "cancer_type"))}
FROM dr WHERE lower(role) LIKE '%act%' OR lower(role) LIKE '%lof%' GROUP BY symbol),
mm AS (SELECT sample_id, gene, {med} FROM ({outer}) GROUP BY 1, 2), gm AS ({WF_MAP}),
sy AS (SELECT sample_id, symbol, {med} FROM mm JOIN gm ON gene = split_part(gene_id, '.', 1)
WHERE trim(symbol) <> '' GROUP BY 1, 2),
go AS ({_GO_SQL.replace("{w}", "true").replace(GAF, WF_GAF)}), hs AS ({WF_SETS}),
hm AS (SELECT gene_name AS gene, string_agg(DISTINCT set_name, ';' ORDER BY set_name) AS hallmark
FROM u JOIN hs ON upper(gene_name) = upper(hs.gene) GROUP BY 1),
al AS (SELECT *, CASE c WHEN 'mhc_ii' THEN 'II' ELSE 'I' END AS k FROM ({_duck(WF_ALLELES.replace("{S}", "VARCHAR"))})),
vd AS ({kept("Tumor DNA Depth", "tumor_dna_depth")}), vv AS ({kept("Tumor DNA VAF", "tumor_dna_vaf")}),
j AS (SELECT u.*, chronos AS "Depmap_survivability_score", dd.role AS "Intogen_Driver_role", dd.cohort AS "Intogen_Cohort",
  dd.cancer_type AS "Intogen_CancerType", {nets}
  FROM u LEFT JOIN es ON upper(u.gene_name) = upper(es.gene) LEFT JOIN dd ON upper(u.gene_name) = upper(dd.symbol)
LEFT JOIN sy ON u.sample_id = sy.sample_id AND u.gene_name = sy.symbol),
f AS (SELECT *, {", ".join(f"{x} AS v{i}" for i, x in enumerate(signed))}
FROM j), p AS (SELECT *, {points} FROM f),
s AS (SELECT * EXCLUDE (p0, p1, p2, v0, v1, v2), CASE WHEN {there} > 0 THEN ({mass}) / ({there}) ELSE 0 END AS s
FROM p),
h AS (SELECT *, CASE WHEN sample_id = 's0' THEN '' WHEN hla_allele LIKE 'HLA-A*%' THEN 'A' WHEN hla_allele LIKE 'HLA-B*%' THEN 'B' WHEN hla_allele LIKE 'DRB1*%' THEN 'DRB1' ELSE '' END AS chain,
  10 + CAST(substr(sample_id, 2) AS INTEGER) AS a
FROM s)
SELECT h.* EXCLUDE (s, chain, a), CASE WHEN s = 0 THEN s ELSE round(s * {_TEN}) / {_TEN} END AS "Borda_Score",
  CAST(rank() OVER (PARTITION BY h.sample_id ORDER BY -s) AS DOUBLE) + (count(*) OVER (PARTITION BY h.sample_id, s) - 1) / CAST(2 AS DOUBLE) AS "Borda_Rank",
  go.go_mf, go.go_bp, go.go_cc, hm.hallmark, CASE chain WHEN 'A' THEN CAST(a AS DOUBLE) WHEN 'DRB1' THEN CAST(4.25 AS DOUBLE) END AS hla_tpm,
  CASE chain WHEN 'A' THEN concat('A: TPM=', a, '; count=3; rel=0.1') WHEN 'B' THEN 'B: TPM=None; count=7; rel=0.2' WHEN 'DRB1' THEN 'DRB1: TPM=4.25; count=1; rel=0.3' ELSE '' END AS hla_tpm_detail,
  vd.tumor_dna_depth, vv.tumor_dna_vaf
FROM h LEFT JOIN go ON h.gene_name = go.gene LEFT JOIN hm ON h.gene_name = hm.gene
LEFT JOIN vd ON h.sample_id = vd.sample_id AND h.gene_name = vd.g AND split_part(h.hla_class, ' ', 3) = vd.k
LEFT JOIN vv ON h.sample_id = vv.sample_id AND h.gene_name = vv.g AND split_part(h.hla_class, ' ', 3) = vv.k"""


WORKFLOW_SQL = _workflow_sql()
query("candidate_workflow", WORKFLOW_SQL)(candidate_workflow)
query("workflow_counts", f"""SELECT sample_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(tumor_dna_vaf) AS BIGINT) AS with_value, CAST(count(*) FILTER (mutation_source = 'Somatic') AS BIGINT) AS somatic
FROM ({WORKFLOW_SQL}) GROUP BY 1""")(
    lambda s, d: annotate.value_counts(candidate_workflow(s, d)))


# files: what a sink writes, a reader reads back ------------------------------------------------------
def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(prepare(spark))}/{name}-{uuid.uuid4().hex}"


def put_bytes(spark: SparkSession, path: str, raw: bytes) -> str:
    p, fs = readers._path(spark, path)
    out = fs.create(p)
    out.write(bytearray(raw))
    out.close()
    return path


TYPED = """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  concat('a "quoted", word', c_nationkey) AS note FROM {customer}"""
_TYPES = "c_custkey long, c_name string, c_acctbal double, note string"


def _read_back(sep: str):
    def run(spark, sf_dir):
        x, path = rel(spark, sf_dir, TYPED), folder(spark, "delimited")
        sinks.csv(x, path, sep=sep)
        return readers.tolerant(spark, path, _TYPES, sep)

    return run


query("csv_round_trip", TYPED)(_read_back(","))
query("tsv_round_trip", TYPED)(_read_back("\t"))


@query("empty_csv_header", "SELECT 'c_custkey,c_name' AS value FROM {customer} HAVING count(*) FILTER (c_acctbal > 1e9) = 0")
def empty_csv_header(spark, sf_dir):
    """No customer is so rich: the file is a header."""
    path = folder(spark, "empty")
    sinks.csv(rel(spark, sf_dir, "SELECT c_custkey, c_name FROM {customer} WHERE c_acctbal > 1e9"), path)
    return spark.read.text(path)


@query("samples_replaced", "SELECT p_brand, CASE WHEN p_brand < 'Brand#2' THEN 2 ELSE 1 END AS version, CAST(count(*) AS BIGINT) AS n FROM {part} GROUP BY 1, 2")
def samples_replaced(spark, sf_dir):
    """A second run over some samples replaces theirs and leaves the others'."""
    x, path = rel(spark, sf_dir, "SELECT p_partkey, p_brand FROM {part}"), folder(spark, "samples")
    sinks.csv(x.withColumn("version", F.lit(1)), path, ["p_brand"])
    sinks.csv(x.withColumn("version", F.lit(2)).filter("p_brand < 'Brand#2'"), path, ["p_brand"])
    back = spark.read.option("header", True).schema("p_partkey long, version int, p_brand string").csv(path)
    return back.groupBy("p_brand", "version").agg(F.count("*").alias("n"))


@query("count_files", "SELECT concat('G', p_partkey, '.3') AS gene, concat('S', p_size % 4) AS sample_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS count FROM {part}")
def count_files(spark, sf_dir):
    """Files of several samples, each with a comment line and a header, written and read back."""
    row = "concat('G', p_partkey, '.3\t1\t', CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE concat(p_size, '.0') END)"
    lines = f"SELECT concat('S', p_size % 4) AS sample, 2 AS at, {row} AS value FROM {{part}}"
    lines += "".join(f" UNION ALL SELECT DISTINCT concat('S', p_size % 4), {at}, {value} FROM {{part}}" for at, value in ((0, "'# run'"), (1, "'Geneid\tChr\tx.bam'")))
    path = folder(spark, "counts")
    x = rel(spark, sf_dir, lines).withColumn("sample", F.concat("sample", F.lit("_CancerRNA_L1.txt")))
    x.repartition("sample").sortWithinPartitions("sample", "at").drop("at").write.partitionBy("sample").text(path)
    # the sample's name is that of the folder here, and of the file where a caller writes one file a sample
    back = spark.read.option("recursiveFileLookup", True).text(path)
    return readers.count_lines(back.withColumn("path", F.regexp_extract(F.input_file_name(), "sample=([^/]+)", 1)))


@query("dense_matrix", "SELECT concat('g', l_suppkey) AS gene, l_returnflag AS sample_id, sum(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2")
def dense_matrix(spark, sf_dir):
    path = folder(spark, "matrix")
    wide = rel(spark, sf_dir, "SELECT concat('g', l_suppkey) AS gene, l_returnflag, l_quantity FROM {lineitem}").groupBy("gene").pivot("l_returnflag", ["A", "N", "R"]).sum("l_quantity")
    sinks.csv(wide, path)
    return readers.matrix(spark, path).filter("value is not null")


@query("annotation_file", "SELECT concat('G', p_partkey) AS gene, concat('GO:', p_size) AS go_id, p_type AS evidence FROM {part}")
def annotation_file(spark, sf_dir):
    path = folder(spark, "gaf")
    said = {"gene": "concat('G', p_partkey)", "go_id": "concat('GO:', p_size)", "evidence": "p_type"}
    full = ", ".join(f"{said.get(c, repr(c))} AS {c}" for c in readers.GAF)
    x = rel(spark, sf_dir, f"SELECT {full} FROM {{part}} UNION ALL SELECT " + ", ".join("'!x'" if c == "db" else "NULL" for c in readers.GAF) + " FROM {region}")
    sinks.tsv(x, path, header=False)
    return readers.annotations(spark, path).select("gene", "go_id", "evidence")


@query("graph_round_trip", SPARSE)
def graph_round_trip(spark, sf_dir):
    path = folder(spark, "graph")
    sinks.graph(rel(spark, sf_dir, SPARSE_V), rel(spark, sf_dir, SPARSE), path)
    return readers.graph(spark, path)[1].select("sample_id", "edge_id", "src", "dst", "weight")


@query("yaml_config", _TOP.replace("CAST(0.2 AS DOUBLE)", "CAST(0.3 AS DOUBLE)") + " SELECT sample_id, edge_id, src, dst, round(weight, 6) AS weight FROM t")
def yaml_config(spark, sf_dir):
    """A configuration file decides how many edges of a node stay."""
    path = put_bytes(prepare(spark), folder(spark, "config"), b"ppi:\n  top_prop: 0.3\nmembrane:\n  enabled: true\n  add_prop: 0.1\n  denominator: ppi_filtered_edges\n")
    x = network.top_proportion(rel(spark, sf_dir, PPI), FilterConfig.from_dict(readers.config(spark, path)).top_prop)
    return x.select("sample_id", "edge_id", "src", "dst", F.round("weight", 6).alias("weight"))


@query("archive_member", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}")
def archive_member(spark, sf_dir):
    """Archives that tasks make of the lines, one for some thousand orders; each one's member is read by a task as well."""
    x = rel(spark, sf_dir, "SELECT l_orderkey div 5000 AS archive, concat_ws('\t', l_orderkey, l_linenumber, l_quantity) AS value FROM {lineitem}")

    def packed(key, rows):
        import pandas as pd

        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("notes.tsv.txt", "x")
            z.writestr("top/lines.tsv", "".join(f"{v}\n" for v in rows["value"]))
        return pd.DataFrame({"path": [f"{key[0]}.zip"], "content": [raw.getvalue()]})

    found = readers.archive_lines(x.groupBy("archive").applyInPandas(packed, "path string, content binary"), ".tsv")
    c = F.split("value", "\t")
    return found.select(c[0].cast("long").alias("l_orderkey"), c[1].cast("int").alias("l_linenumber"), c[2].cast("double").alias("l_quantity"))


@query("read_groups", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'flowcell' ELSE concat('FC', p_size) END AS flowcell, CASE WHEN p_size % 3 = 0 THEN 'lane' ELSE CAST(p_size % 8 AS VARCHAR) END AS lane,
CASE p_size % 3 WHEN 1 THEN 'ACGT' ELSE 'barcode' END AS barcode FROM {part}""")
def read_groups(spark, sf_dir):
    x = rel(spark, sf_dir, """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '@odd' WHEN 1 THEN concat('@M:1:FC', p_size, ':', p_size % 8, ':9:9 1:N:0:ACGT')
ELSE concat('@M:1:FC', p_size, ':', p_size % 8) END AS h FROM {part}""")
    g = readers.read_group(F.col("h"))
    return x.select("p_partkey", *[g[c].alias(c) for c in ("flowcell", "lane", "barcode")])


@query("existing_paths", "SELECT p_brand AS name, CAST(count(*) AS BIGINT) AS n FROM {part} WHERE p_size > 48 GROUP BY 1")
def existing_paths(spark, sf_dir):
    """Of a file for each brand, those that are there and hold any bytes are read."""
    x, top = rel(spark, sf_dir, "SELECT p_brand, concat('p', p_partkey) AS value, p_size FROM {part}"), folder(spark, "paths")
    x.filter("p_size > 48").select("p_brand", "value").write.partitionBy("p_brand").text(top)
    put_bytes(spark, f"{top}/p_brand=none/part-0.txt", b"")
    brands = [r[0] for r in x.select("p_brand").distinct().collect()]  # as many as there are files to look for
    found = readers.existing(spark, [f"{top}/p_brand={b.replace('#', '%23')}" for b in [*brands, "none", "absent"]] + ["", None])
    return spark.read.option("basePath", top).text(found).groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))


@query("ranked_stream", borda_sql("average", "ignore"))
def ranked_stream(spark, sf_dir):
    """The candidates arrive in two batches, each with some of every sample's rows, and are ranked as they come."""
    x, top = rel(spark, sf_dir, EPI), folder(spark, "stream")
    for at, part in enumerate(("row_id % 3 = 0", "row_id % 3 <> 0")):
        x.filter(part).write.parquet(f"{top}/in/{at}")
        incremental.rank_arrivals(spark, f"{top}/in/*", x.schema, f"{top}/out", f"{top}/state", borda_config()).awaitTermination()
    return spark.read.parquet(f"{top}/out").select("sample_id", "row_id", F.col("Borda_Score").alias("borda_score"), F.col("Borda_Rank").alias("borda_rank"))


@query("presented_order", """SELECT CAST(row_number() OVER (ORDER BY hla_class NULLS LAST, gene_name NULLS LAST) AS BIGINT) AS place, hla_class, gene_name
FROM (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat('c', p_size % 2) END AS hla_class, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS gene_name FROM {part})""")
def presented_order(spark, sf_dir):
    x = rel(spark, sf_dir, "SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat('c', p_size % 2) END AS hla_class, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS gene_name FROM {part}")
    path = folder(spark, "presented")
    union.presented(x).write.parquet(path)  # a range a file, named in order
    back = spark.read.parquet(path).select(F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("at"), "hla_class", "gene_name")
    return back.select(F.row_number().over(W.orderBy("at")).cast("long").alias("place"), "hla_class", "gene_name")  # some dozens of rows


# the cohort workflow's queries build on those above
from . import cohort  # noqa: E402, F401
