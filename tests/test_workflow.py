"""Both workflows end to end on a small cohort."""

import random

from pyspark.sql import functions as F

from consensa.operators.config import BordaConfig, Feature, FilterConfig
from consensa.plans import workflow

COLUMNS = {
    "Somatic": ["Gene Name", "HLA Allele", "Peptide Length", "MT Epitope Seq", "WT Epitope Seq", "Median MT IC50 Score"],
    "Fusion": ["Gene Name", "HLA Allele", "Peptide Length", "Epitope Seq", "Median IC50 Score"],
}


def test_networks_then_prioritisation(spark, tmp_path):
    rng = random.Random(1)
    genes = [f"E{i}" for i in range(14)]
    counts = spark.createDataFrame(
        [(f"{g}.{rng.randint(1, 3)}", f"s{j}", rng.randint(20, 400)) for g in genes for j in range(6)],
        "gene string, sample_id string, count int",
    )
    ref = spark.createDataFrame([(i, *rng.sample([*genes, "E99"], 2)) for i in range(40)], "edge_id long, src string, dst string")
    mem = spark.createDataFrame([("E1",), ("E2",), ("E77",), (" ",)], "gene string")
    n = workflow.networks(counts, ref, mem, FilterConfig(top_prop=0.3, add_prop=0.1))
    assert n.edges.join(n.vertices, (n.edges["sample_id"] == n.vertices["sample_id"]) & (F.col("src") == F.col("gene")), "left_anti").isEmpty()
    assert n.vertices.filter("gene = 'E77'").count() == n.qc.filter("requested > 0").count() > 0
    assert n.distances.filter("s1 = s2 and abs(similarity - 1) > 1e-9").isEmpty() and n.distances.count() == 21
    total = n.metrics["wci"].groupBy("sample_id").agg(F.sum("wci").alias("t"))
    assert total.filter("abs(t - 1) > 1e-9").isEmpty() and total.count() == 6
    (tmp_path / "a.tsv").write_text("\t".join(COLUMNS["Somatic"]) + "\n" + "".join(f"G{i}\tHLA-A*02:01\t9\tPEP{i}\tWT{i}\t{i * 10}\n" for i in range(8)))
    (tmp_path / "b.tsv").write_text("\t".join(COLUMNS["Fusion"]) + "\nG1_G2\tDQA1*01:01-DQB1*02:01\t15\tFUS\t33\n")
    paths = {
        ("s1", "Somatic", "MHC Class I"): str(tmp_path / "a.tsv"), ("s1", "Fusion", "MHC Class II"): str(tmp_path / "b.tsv"),
        ("s2", "Somatic", "MHC Class I"): str(tmp_path / "none.tsv"),
    }
    x = workflow.read_candidates(spark, paths, COLUMNS)
    assert x.count() == 10
    dims = workflow.Dimensions(
        essentiality=spark.createDataFrame([("g1 ", -0.5), ("G3", 0.1)], "gene string, median_score double"),
        drivers=spark.createDataFrame([("G2", "Act", "C1", "X")], "symbol string, role string, cohort string, cancer_type string"),
        gene_map=spark.createDataFrame([(f"E{i}", f"G{i}") for i in range(14)], "gene_id string, symbol string"),
        metrics=dict(n.metrics) | {"degree": None},
        go=spark.createDataFrame([("G1", "GO:1", "MF", "EXP")], "gene string, go_id string, ontology string, evidence string"),
        go_names=spark.createDataFrame([("GO:1", "binding")], "go_id string, term string"),
        gene_sets=spark.createDataFrame([("H1", "g3")], "set_name string, gene string"),
        hla_expression=spark.sql("SELECT 's1' AS sample_id, map('A', array(5D, 1D, 1D), 'DQA1', array(9D, 1D, 1D), 'DQB1', array(2D, 1D, 1D)) AS m"),
        allele_tables=spark.createDataFrame([("s1", "G1", "I", "40", "0.2")], "sample_id string, g string, c string, `Tumor DNA Depth` string, `Tumor DNA VAF` string"),
    )
    cfg = BordaConfig([Feature("median_mt_ic50", 3), Feature("Network_Strength", 2, "higher_better"), Feature("Depmap_survivability_score")])
    out = workflow.prioritise(x, dims, cfg, [("gene_name", "g"), ("hla_class", "c")])
    got = out.collect()
    assert len(got) == 10 and [r.Borda_Rank for r in got] == sorted(r.Borda_Rank for r in got)
    one = next(r for r in got if r.gene_name == "G1" and r.mutation_source == "Somatic")
    assert (one.Depmap_survivability_score, one.go_mf, one.tumor_dna_vaf, one.hla_tpm) == (-0.5, "binding", "0.2", 5.0)
    assert one.Net_Strength is not None and one.Net_Degree is None
    assert next(r for r in got if r.mutation_source == "Fusion" and r.gene_name == "G2").hla_tpm == 2.0
    bare = workflow.prioritise(x, workflow.Dimensions(), cfg)
    assert bare.count() == 10 and "Net_WCI" in bare.columns
