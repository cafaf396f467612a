"""Micro-cases with hand-made results, and invariants."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from consensa.functions import nulls
from consensa.operators import annotate, borda, expression, graph_kernels, lioness, network, ontology, report, similarity, union, variants
from consensa.operators.config import BordaConfig, Feature, FilterConfig


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_numbers(spark):
    df = spark.createDataFrame([("abc",), (" 1e-3 ",), ("8.0",), ("Infinity",), ("NaN",), (None,)], "s string")
    got = df.select(
        nulls.to_double("s").alias("d"), nulls.to_int("s").alias("i"),
        F.coalesce(nulls.is_finite(nulls.to_double("s")), F.lit(False)).alias("ok"),
    ).collect()
    assert [r.ok for r in got] == [False, True, True, False, False, False]
    assert got[1].d == 0.001 and got[2].i == 8 and got[0].d is None


@pytest.mark.parametrize("x,want", [(0.0, 0.0), (0.123456, 0.1235), (123456.0, 123500.0), (-0.00012345, -0.0001235), (1.0, 1.0)])
def test_signif(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(nulls.signif("x")).first()[0] == pytest.approx(want, rel=1e-9)


def test_collapses(spark):
    df = spark.createDataFrame([(1, "b"), (2, " a "), (3, None), (4, "nan"), (5, "b"), (6, " ")], "o int, v string")
    assert df.agg(nulls.collapse_ordered("v", "o")).first()[0] == "b;a"
    assert df.filter("v is null").agg(nulls.collapse_ordered("v", "o"), nulls.collapse_sorted("v")).first() == (None, "")


def points(values, ties="average", higher=False):
    v = [(-x if higher else x) for x in values if x is not None and math.isfinite(x)]
    n, out = len(v), []
    for i, x in enumerate(values):
        if x is None or not math.isfinite(x):
            out.append(None)
            continue
        x = -x if higher else x
        low, alike = sum(y < x for y in v) + 1, v.count(x)
        before = sum(1 for y in values[:i] if y is not None and (-y if higher else y) == x)
        r = {"average": low + (alike - 1) / 2, "min": low, "max": low + alike - 1, "first": low + before}[ties]
        out.append(1.0 if n <= 1 else (n - r) / (n - 1))
    return out


@pytest.mark.parametrize("ties,policy", list(itertools.product(("average", "min", "max", "first"), ("ignore", "worst", "drop"))))
def test_borda(spark, ties, policy):
    rng = random.Random(hash((ties, policy)) % 100)
    data = [(
        f"s{i % 3}", i, rng.choice([None, 1.0, 2.0, float("nan"), 5.0]), rng.choice([None, 1.0, float("inf"), 3.0]),
    ) for i in range(40)] + [("one", 99, 2.0, None)]
    df = spark.createDataFrame(data, "sample_id string, row_id int, a double, Net_B double")
    cfg = BordaConfig([Feature("a", 2), Feature("Network_B", 1, "higher_better"), Feature("absent", 1)], ties, policy)
    got = {r.row_id: (r.Borda_Score, r.Borda_Rank) for r in borda.consensus(df, cfg).collect()}
    want = {}
    for s in {d[0] for d in data}:
        own = [d for d in data if d[0] == s]
        pa, pb = points([d[2] for d in own], ties), points([d[3] for d in own], ties, True)
        score = {}
        for d, x, y in zip(own, pa, pb):
            if policy == "drop" and (x is None or y is None):
                continue
            mass = 0.5 * (x or 0) + 0.25 * (y or 0)
            there = 0.5 * (x is not None) + 0.25 * (y is not None)
            score[d[1]] = (mass / there if there else 0.0) if policy == "ignore" else mass
        for k, v in score.items():
            low = sum(x > v for x in score.values()) + 1
            alike = [j for j, x in score.items() if x == v]
            want[k] = (v, {"average": low + (len(alike) - 1) / 2, "min": low, "max": low + len(alike) - 1, "first": low + sorted(alike).index(k)}[ties])
    assert set(got) == set(want)
    for k, (v, r) in want.items():
        assert got[k][1] == r and got[k][0] == pytest.approx(v, rel=6e-4) and 0 <= got[k][0] <= 1


def test_config_checks():
    for bad in (lambda: Feature("a", float("nan")), lambda: Feature("a", 1, "up"), lambda: BordaConfig([Feature("a")], "odd"), lambda: BordaConfig([], "min"), lambda: FilterConfig(top_prop=0), lambda: FilterConfig(add_prop=2), lambda: FilterConfig(metric="x"), lambda: FilterConfig(denominator="x"), lambda: FilterConfig(require_membrane_endpoint=False)):
        with pytest.raises(ValueError):
            bad()
    assert FilterConfig.from_dict({"top_prop": 0.3, "membrane": {"mem_prop": 0.9}}).add_prop == pytest.approx(0.1)
    assert BordaConfig.from_dict({"features": {"x": {"weight": 2, "direction": "higher_better"}}}).features[0].weight == 2


def test_union(spark):
    a = spark.createDataFrame(
        [("s", "A_B", "x", None, "PEP", "1.5", "e"), ("s", None, "x", None, "PEPT", "abc", "e")],
        "sample_id string, gene string, al string, len string, seq string, ic string, extra string",
    )
    f = union.project(a, ["gene", "al", "len", "seq", "ic", "extra", "missing"], "Fusion", "MHC Class I")
    s = union.project(a, ["gene", "al", "len", "seq", "nope", "ic"], "Somatic", "MHC Class II")
    m = union.merge([f, s, s])
    assert m.columns == ["sample_id", *union.STANDARD, "extra"]
    got = rows(m, "gene_name", "peptide_length", "median_mt_ic50", "mutation_source", "fusion_genes", "extra")
    assert got == sorted(
        [
            ("A", 3, 1.5, "Fusion", "A_B", "e"), ("B", 3, 1.5, "Fusion", "A_B", "e"), (None, 4, None, "Fusion", None, "e"),
            ("A_B", None, 1.5, "Somatic", None, None), (None, None, None, "Somatic", None, None),
        ],
        key=str,
    )
    assert union.first_present(a.withColumnRenamed("extra", "HLA.Allele"), "HLA_Allele") == "HLA.Allele"


def test_partial_lengths_stay_null(spark):
    a = spark.createDataFrame(
        [("s", "A", "x", "9", "PEP", "1"), ("s", "B", "x", None, "PEPT", "2")],
        "sample_id string, gene string, al string, len string, seq string, ic string",
    )
    assert rows(union.project(a, ["gene", "al", "len", "seq", "ic"], "Splice Variant", "MHC Class I"), "gene_name", "peptide_length") == [("A", 9), ("B", None)]


def test_hla(spark):
    df = spark.createDataFrame([("HLA-A*02:01",), (" DQA1*01:01-DQB1*02:01",), ("X",), (None,), ("HLA-B*07:02",), ("C*01",)], "a string")
    assert [r[0] for r in df.select(annotate.allele_keys("a")).collect()] == [["A"], ["DQA1", "DQB1"], [], None, ["B"], ["C"]]
    m = F.from_json(F.lit('{"DQA1": [7.5, 1, 0.5], "DQB1": [4.0, 2, null], "A": [1, 2.5], "C": []}'), "map<string,array<string>>")
    got = annotate.hla_tpm(df, "a", m).collect()
    assert [r.hla_tpm for r in got] == [None, 4.0, None, None, None, None]
    assert [r.hla_tpm_detail for r in got] == [
        "A: TPM=None; count=1; rel=2.5", "DQA1: TPM=7.5; count=1; rel=0.5; DQB1: TPM=4.0; count=2; rel=None", "", "", "",
        "C: TPM=None; count=None; rel=None",
    ]


def test_class_names(spark):
    said = {
        "I": "I", "1": "I", "MHC_Class-II": "II", "mhci": "I", "II": "II", "class ii x": "II", " Other-one ": "Other-one", None: "",
        "class i b": "I", "MHC-II": "II", "mhcii?": "II",
    }
    df = spark.createDataFrame([(x,) for x in said], "c string")
    assert [r[0] for r in df.select(annotate.class_of("c")).collect()] == list(said.values())


def test_tips_and_badges(spark):
    df = spark.createDataFrame([("Act, ACTIVATING;x",), (" lof ",), (None,), (" nan",), ('a"b',)], "s string")
    got = [tuple(r) for r in df.select(report.driver_tip("s"), report.badge("s", "MF")).collect()]
    act = "Act: " + report.ROLES["Act"]
    assert got[0] == (f'<span class="driver" title="{act} \nx">Act, ACTIVATING;x</span>', '<span class="pill" title="Act, ACTIVATING;x">MF</span>')
    assert got[1][0].startswith('<span class="driver" title="LoF: Loss') and got[1][0].endswith("gene&#x27;s function.\">lof</span>")
    assert got[2] == got[3] == ("", "") and got[4][1] == '<span class="pill" title="a&quot;b">MF</span>'


def test_symbols_by_order_of_the_dictionary(spark):
    first = spark.createDataFrame([("g.1", "Z", 1), ("g.2", "A", 2), ("h", " ", 3), ("h", "B", 4)], "gene_id string, symbol string, ordinal int")
    assert rows(annotate.symbols(first), "gene", "symbol") == [("g", "Z"), ("h", "B")]
    assert rows(annotate.symbols(first.drop("ordinal")), "gene", "symbol") == [("g", "A"), ("h", "B")]
    table = spark.createDataFrame([("s", "g", 1.0), ("s", "h", 2.0)], "sample_id string, gene string, m double")
    assert rows(annotate.to_symbols(table, [None, first], ["m"]), "symbol", "m") == [("B", 2.0), ("Z", 1.0)]


def test_blank_keys_meet(spark):
    a = spark.createDataFrame([(1, "g", None), (2, "g", " x ")], "row int, gene string, wt string")
    b = spark.createDataFrame([(1, "g", "", "0.5"), (2, "g", "x", "0.1"), (3, "g", "x", "0.1")], "o int, gene string, w string, vaf string")
    got = annotate.attach_values(a, b, [("gene", "gene"), ("wt", "w")], {"vaf": "v"}, "o")
    assert rows(got, "row", "v") == [(1, "0.5"), (2, "0.1")]
    with pytest.raises(ValueError):
        annotate.attach_values(a, b, [("gene", "nope")], {"vaf": "v"}, "o")


def test_top_proportion(spark):
    rng = random.Random(1)
    edges = [("s", i, f"g{rng.randrange(12)}", f"h{rng.randrange(12)}", rng.choice([-2.0, 1.0, 3.0, 0.5])) for i in range(80)]
    df = spark.createDataFrame(edges, "sample_id string, edge_id long, src string, dst string, weight double")
    got = {r.edge_id for r in network.top_proportion(df, 0.2).collect()}
    want = set()
    for g in {e[2] for e in edges} | {e[3] for e in edges}:
        own = sorted((e for e in edges if g in e[2:4]), key=lambda e: (-abs(e[4]), e[1]))
        want |= {e[1] for e in own[: max(1, math.ceil(len(own) * 0.2))]}
    assert got == want
    assert {r.edge_id for r in network.top_proportion(df, 1.0).collect()} == {e[1] for e in edges}


def test_top_proportion_in_parts_keeps_every_edge_of_an_id(spark):
    rng = random.Random(2)
    edges = [("st"[i % 2], i // 6, f"g{rng.randrange(9)}", f"h{rng.randrange(30)}", float(i * 7 % 300)) for i in range(300)] + [("s", None, "g1", "h1", 999.0), (None, 7, "g1", "h1", 999.0)]
    df = spark.createDataFrame(edges, "sample_id string, edge_id long, src string, dst string, weight double")
    hit = set()
    for s, g in {(e[0], g) for e in edges for g in e[2:4]}:
        own = sorted((e for e in edges if e[0] == s and g in e[2:4]), key=lambda e: (-e[4], -1 if e[1] is None else e[1]))
        hit |= {e[:2] for e in own[: max(1, math.ceil(len(own) * 0.2))]}
    want = sorted(e for e in edges if e[:2] in hit and None not in e[:2])
    for n in (None, 7):
        got = network.top_proportion(df, 0.2, n)
        assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == want
    assert network.top_proportion(df, 0.2, 7).groupBy(F.spark_partition_id()).count().count() > 4  # more than the session's


def test_candidates_read_the_weights_once(spark, tmp_path, capsys):
    pairs = [("s", "a", "b", 1.0), ("s", "a", "m", -9.0), ("s", "m", "z", 4.0), ("s", "c", "z", 5.0), ("s", "a", None, 1.0), ("s", "a", "n", math.nan), ("t", "a", "m", 2.0), ("s", "m", "n", 3.0)]
    spark.createDataFrame(pairs, "sample_id string, a string, b string, weight double").write.parquet(f"{tmp_path}/w")
    weights = spark.read.parquet(f"{tmp_path}/w").groupBy("sample_id", "a", "b").agg(F.max("weight").alias("weight"))
    kind = "sample_id string, edge_id long, src string, dst string, weight double"
    ppi = spark.createDataFrame([("s", 1, "m", "a", 1.0), ("s", 2, "b", "a", 2.0), (None, 3, "a", "m", 2.0)], kind)
    seen = {}
    network.enrich(ppi, ppi, weights, spark.createDataFrame([("m",), ("n",), (None,), ("m",)], "gene string"), FilterConfig(add_prop=0.5), store=lambda df, name: seen.setdefault(name, df))
    assert seen["candidates"].columns == ["sample_id", "a", "b", "weight"]
    assert rows(seen["candidates"], "sample_id", "a", "b", "weight") == [("s", "m", "n", 3.0), ("s", "m", "z", 4.0), ("t", "a", "m", 2.0)]
    capsys.readouterr()
    seen["candidates"].select("*").explain()
    assert capsys.readouterr().out.count("/w]") == 1


def test_enrichment_edge_cases(spark):
    kind = "sample_id string, edge_id long, src string, dst string, weight double"
    ppi = spark.createDataFrame([("s", 1, "a", "b", 1.0), ("s", 2, "b", "a", 2.0)], kind)
    pairs = spark.createDataFrame([("s", "a", "b", 1.0), ("s", "a", "m", -9.0), ("s", "b", "m", 4.0)], "sample_id string, a string, b string, weight double")
    mem = spark.createDataFrame([("m",)], "gene string")
    same, _ = network.enrich(ppi, ppi, pairs, mem, FilterConfig(add_prop=0))
    assert same.count() == 2
    none, _ = network.enrich(ppi, ppi, pairs, mem.filter("false"), FilterConfig(add_prop=0.5))
    assert none.count() == 2
    one, qc = network.enrich(ppi, ppi, pairs, mem, FilterConfig(add_prop=0.5))
    assert rows(one, "src", "dst", "weight") == [("a", "b", 1.0), ("a", "m", -9.0)]
    r = qc.first()
    assert (r.unfiltered_edges, r.ppi_edges, r.candidates, r.requested, r.added, r.final_edges, r.ppi_vertices, r.final_vertices) == (2, 2, 2, 1, 1, 2, 2, 3)
    assert len(qc.columns) == 14
    other = FilterConfig(add_prop=0.5, denominator="ppi_filtered_edges")
    assert network.enrich(ppi.limit(1), ppi.unionByName(ppi).unionByName(ppi), pairs, mem, other)[1].first().requested == 1
    every, qc = network.enrich(ppi, ppi.unionByName(ppi).unionByName(ppi), pairs, mem, FilterConfig(add_prop=1.0))
    assert every.count() == 3 and qc.first().requested == 2


def test_share_is_ceiled_in_doubles(spark):
    got = spark.range(1, 300).select("id", nulls.share_ceil(F.col("id"), 0.07).alias("c")).collect()
    assert all(r.c == math.ceil(r.id * 0.07) for r in got)


def test_lioness_equals_naive(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5, 7))
    x[4] = 3.0
    data = [(f"g{i}", f"s{j}", float(x[i, j])) for i in range(5) for j in range(7)]
    got = {(r.sample_id, r.a, r.b): r.weight for r in lioness.edges(spark.createDataFrame(data, "gene string, sample_id string, value double")).collect()}
    for q in range(7):
        for i, j in itertools.combinations(range(4), 2):
            r = np.corrcoef(x[i], x[j])[0, 1]
            rq = np.corrcoef(np.delete(x[i], q), np.delete(x[j], q))[0, 1]
            assert got[(f"s{q}", f"g{i}", f"g{j}")] == pytest.approx(7 * (r - rq) + rq, abs=1e-9)
    assert len(got) == 7 * 6
    few = spark.createDataFrame([d for d in data if d[1] in ("s0", "s1")], "gene string, sample_id string, value double")
    assert lioness.edges(few).count() == 0


def test_blocks_of_genes_equal_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((23, 6))
    x[3], x[4] = 1.0, [0, 0, 5, 0, 0, 0]
    values = spark.createDataFrame(
        [(f"g{i:02}", f"s{j}", float(x[i, j])) for i in range(23) for j in range(6)] + [("part", "s1", 1.0)],
        "gene string, sample_id string, value double",
    )
    pairs = spark.createDataFrame([(f"g{i:02}", f"g{j:02}") for i, j in itertools.combinations(range(23), 2)], "a string, b string")
    want = {(r.sample_id, r.a, r.b): r.weight for r in lioness.edges(values, pairs).collect()}
    monkeypatch.setattr(lioness, "BLOCK_CELLS", 600)
    monkeypatch.setattr(lioness, "BLOCK_GENES", 7)
    got = {(r.sample_id, r.a, r.b): r.weight for r in lioness.edges(values).collect()}
    assert got == pytest.approx(want) and len(want) > 1000
    full = {(r.sample_id, r.gene): (r.strength, r.degree, r.wci) for r in network.connectivity(lioness.strengths(values)).collect()}
    for (s, g), (strength, degree, _) in full.items():
        own = [abs(w) for (q, a, b), w in want.items() if q == s and g in (a, b)]
        assert strength == pytest.approx(1 + sum(own)) and degree == 1 + len(own)


def test_strongest_equals_a_full_ranking(spark):
    rng = random.Random(5)
    data = [(rng.choice("st"), f"a{i}", f"b{rng.randrange(50)}", rng.choice([1.0, -1.0, 0.0, rng.uniform(-3, 3)])) for i in range(400)]
    df = spark.createDataFrame(data, "sample_id string, a string, b string, weight double")
    for n in (0, 1, 37, 160, 1000):
        wanted = spark.createDataFrame([("s", n), ("t", n // 2)], "sample_id string, requested long")
        got = {tuple(r) for r in network.strongest(df, wanted, ["a", "b"], 2).collect()}
        want = set()
        for s, k in (("s", n), ("t", n // 2)):
            want |= set(sorted((d for d in data if d[0] == s), key=lambda d: (-abs(d[3]), d[1], d[2]))[:k])
        assert got == want


def test_leaf_order(spark):
    d = {("a", "c"): 0.1, ("a", "b"): 0.9, ("b", "c"): 0.9, ("a", "d"): 0.8, ("b", "d"): 0.2, ("c", "d"): 0.85}
    df = spark.createDataFrame([(*k, v) for k, v in d.items()] + [(s, s, 0.0) for s in "abcd"], "s1 string, s2 string, distance double")
    assert [r.sample for r in similarity.leaf_order(df).orderBy("position").collect()] in (["a", "c", "b", "d"], ["b", "d", "a", "c"])
    assert similarity.leaf_order(df.filter("false")).count() == 0


def test_wci_sums_to_one(spark):
    pairs = spark.createDataFrame([("s", "a", "b", -2.0), ("s", "a", "c", 1.0)], "sample_id string, a string, b string, weight double")
    got = {r.gene: (r.strength, r.degree, r.wci) for r in network.full_strength(pairs).collect()}
    assert got["a"][:2] == (4.0, 3) and got["b"][:2] == (3.0, 2)
    assert sum(v[2] for v in got.values()) == pytest.approx(1)


def brute_impact(n, edges):
    def largest(alive):
        es = [e for e in edges if e[0] in alive and e[1] in alive]
        parent = {v: v for v in alive}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b, _ in es:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        comps = {}
        for v in sorted(alive):
            comps.setdefault(find(v), []).append(v)
        best = max(comps.values(), key=lambda c: (len(c), -min(c))) if comps else []
        return len(best), sum(abs(w) for a, _, w in es if a in set(best)), len(es)

    b, w, _ = largest(set(range(n)))
    out = []
    for v in range(n):
        b2, w2, left = largest(set(range(n)) - {v})
        out.append(1.0 if not left else 0.5 * (b - b2) / b + (0.5 * (w - w2) / w if w else 0))
    return out


def test_component_impact_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(2, 12)
        edges = [(*sorted(rng.sample(range(n), 2)), rng.choice([1.0, -2.0, 0.5])) for _ in range(rng.randint(1, 16))]
        assert np.allclose(graph_kernels.component_impact(n, edges), brute_impact(n, edges), atol=1e-9), (n, edges)


def test_component_impact_by_joins(spark):
    """Graphs that are taken by joins: parallel edges, equal sizes, chains, isolated vertices and several components."""
    rng = random.Random(5)
    data, names, want = [], [], {}
    for k in range(40):
        n = rng.randint(2, 12)
        edges = [(*rng.sample(range(n), 2), rng.choice([1.0, -2.0, 0.5])) for _ in range(rng.randint(1, 16))]
        if k % 4 == 0:  # a cactus with a tail
            edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(0, n // 2, 2.0)] * (n > 3)
        data += [(f"s{k}", f"v{a:02}", f"v{b:02}", w) for a, b, w in edges]
        names += [(f"s{k}", f"v{i:02}") for i in range(n)]
        want |= {(f"s{k}", f"v{i:02}"): x for i, x in enumerate(brute_impact(n, edges))}
    e = spark.createDataFrame(data, "sample_id string, src string, dst string, weight double")
    v = spark.createDataFrame(names, "sample_id string, gene string")
    for local in (8,):
        got = {(r.sample_id, r.gene): r.largest_component_impact for r in graph_kernels.impact(e, v, local).collect()}
        assert got == pytest.approx(want, abs=1e-9), local


def brute_betweenness(n, edges):
    """Shares of shortest paths through each vertex, by listing all of them."""
    out = [0.0] * n
    adj = [[] for _ in range(n)]
    for a, b, w in edges:
        adj[a].append((b, 1 / abs(w)))
        adj[b].append((a, 1 / abs(w)))
    for s, t in itertools.combinations(range(n), 2):
        best, paths, stack = math.inf, [], [(s, 0.0, (s,))]
        while stack:
            u, d, path = stack.pop()
            if u == t:
                if d < best - 1e-9:
                    best, paths = d, []
                if d <= best + 1e-9:
                    paths.append(path)
                continue
            stack += [(v, d + w, (*path, v)) for v, w in adj[u] if v not in path and d + w <= best + 1e-9]
        for path in paths:
            for v in path[1:-1]:
                out[v] += 1 / len(paths)
    return [x / ((n - 1) * (n - 2) / 2) for x in out]


def test_betweenness(spark):
    kind = "sample_id string, src string, dst string, weight double"
    rng = random.Random(11)
    data, want = [], {}
    for k in range(12):
        n = rng.randint(4, 7)
        edges = [(*rng.sample(range(n), 2), rng.choice([1.0, -1.0, 2.0, 0.5])) for _ in range(rng.randint(4, 12))]
        data += [(f"s{k}", f"v{a}", f"v{b}", w) for a, b, w in edges]
        want |= {(f"s{k}", f"v{i}"): x for i, x in enumerate(brute_betweenness(n, edges))}
    vertices = spark.createDataFrame(list(want), "sample_id string, gene string")
    for work in (3, 10**9):
        got = {(r.sample_id, r.gene): r.betweenness for r in graph_kernels.betweenness(spark.createDataFrame(data, kind), vertices, work).collect()}
        assert got == pytest.approx(want)


def test_arrays_equal_single_searches():
    """Many searches at once against one vertex at a time, with equal lengths, very unequal ones and several components."""
    rng = np.random.default_rng(4)
    for k in range(60):
        n, m = int(rng.integers(3, 40)), int(rng.integers(2, 90))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        pairs = sorted({(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b) if x != y})
        length = {e: float(rng.choice([[1.0, 2.0, 3.0], [1e-3, 1.0, 1e3], [1.0, 1.0, 1.0]][k % 3])) for e in pairs}
        adj = [[] for _ in range(n)]
        for (x, y), w in length.items():
            times = int(rng.integers(1, 3))
            adj[x].append((y, w, times))
            adj[y].append((x, w, times))
        adj = [sorted(x) for x in adj]
        flat = [e for x in adj for e in x]
        start = np.concatenate(([0], np.cumsum([len(x) for x in adj]))).astype(np.int64)
        to, w, t = (np.array([e[i] for e in flat], kind) for i, kind in ((0, np.int32), (1, float), (2, float)))
        got = graph_kernels.dependencies(start, to, w, t, np.arange(n))
        assert np.allclose(got, graph_kernels.partial_betweenness(n, adj, range(n)), atol=1e-9)


def test_components_and_degree(spark):
    e = spark.createDataFrame(
        [("s", 1, "a", "b", 1.0), ("s", 2, "b", "a", 2.0), ("s", 3, "d", "c", -4.0)],
        "sample_id string, edge_id long, src string, dst string, weight double",
    )
    v = spark.createDataFrame([("s", g) for g in "abcdx"], "sample_id string, gene string")
    assert rows(network.components(e, v), "gene", "component") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("x", "x")]
    chain = spark.createDataFrame(
        [("s", i, f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(200)],
        "sample_id string, edge_id long, src string, dst string, weight double",
    )
    ends_ = network.ends(chain).select("sample_id", "gene").distinct()
    assert [r[0] for r in network.components(chain, ends_).select("component").distinct().collect()] == ["n000"]
    assert rows(network.degree_strength(e, v), "gene", "degree", "strength") == [("a", 2, 3.0), ("b", 2, 3.0), ("c", 1, 4.0), ("d", 1, 4.0), ("x", 0, 0.0)]


def test_cosine(spark):
    s = spark.createDataFrame([("x", "g", 3.0), ("x", "h", 4.0), ("y", "g", 1.0), ("z", "g", 0.0)], "sample_id string, gene string, value double")
    got = {(r.s1, r.s2): r.similarity for r in similarity.cosine(s).collect()}
    assert got[("x", "x")] == pytest.approx(1) and got[("x", "y")] == pytest.approx(0.6) and got[("x", "z")] is None


def test_cosine_of_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(23, 17)) * (rng.random((23, 17)) < 0.4)
    m[5] = 0
    m[6, :9], m[7, 9:] = 0, 0
    data = [(f"s{i:02}", f"g{j}", float(m[i, j])) for i in range(23) for j in range(17) if m[i, j] or i == 5 and j == 0]
    df = spark.createDataFrame(data, "sample_id string, gene string, value double")
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "CELLS", 50)
    got = {(r.s1, r.s2): r.similarity for r in similarity.cosine(df).collect()}
    assert len(got) == 23 * 24 // 2
    for (a, b), sim in got.items():
        u, v = m[int(a[1:])], m[int(b[1:])]
        n = np.linalg.norm(u) * np.linalg.norm(v)
        assert (sim is None and n == 0) or sim == pytest.approx(u @ v / n, abs=1e-12)


def test_leaf_order_of_many_rows():
    """The nearest rows that are kept give the order that a search of the whole matrix gives."""

    def searched(rows):
        d = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        groups = {i: ([i], -1) for i in range(len(rows))}
        for step in range(len(rows) - 1):
            i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
            (a, x), (b, y) = groups[i], groups.pop(j)
            groups[i] = (a + b if (x, a[0]) <= (y, b[0]) else b + a, step)
            d[i] = d[:, i] = np.maximum(d[i], d[j])
            d[j] = d[:, j] = d[i, i] = np.inf
        return next(iter(groups.values()))[0]

    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 10, 60):
        for rows in (rng.random((n, n)), rng.integers(0, 3, (n, n)).astype(float)):  # ties too
            assert similarity.complete_linkage(rows) == searched(rows)
    assert sorted(similarity.complete_linkage(rng.random((2000, 2000)))) == list(range(2000))


def test_closure_of_a_deep_chain(spark):
    rel = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(70)], "parent string, child string").coalesce(1).cache()
    got = ontology.descendants(rel, spark.createDataFrame([("t0",)], "id string"))
    assert {r.id for r in got.collect()} == {f"t{i}" for i in range(71)}


def test_closure_with_cycle(spark):
    rel = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (2, 4), (9, 8)], "parent int, child int")
    assert rows(ontology.descendants(rel, spark.createDataFrame([(1,)], "id int")), "id") == [(1,), (2,), (3,), (4,)]


def test_filters_and_intervals(spark):
    v = spark.createDataFrame(
        [("c", 5, "A", "G", 1.0, 1.0, 50.0, 1.0, None, 0.0, 5.0, 99.0), ("c", 10, "A", "G", 9.0, 1.0, 50.0, 1.0, 0.0, 0.0, 50.0, 99.0)],
        "chrom string, pos long, ref string, alt string, QD double, FS double, MQ double, SOR double, MQRankSum double, ReadPosRankSum double, DP double, GQ double",
    )
    f = variants.hard_filter(v, variants.SNP)
    assert rows(f, "pos", "filter", "ft") == [(10, "PASS", "PASS"), (5, "QD2", "LowDP")]
    iv = spark.createDataFrame([("c", 4, 5), ("c", 5, 9)], "chrom string, start long, stop long")
    assert rows(variants.restrict(v, iv, 3), "pos") == [(5,)]


def test_counts(spark):
    c = spark.createDataFrame([("a.1", "s", 3), ("a.2", "s", 4), ("a", "t", None), ("b", "s", 20), ("b", "t", 10)], "gene string, sample_id string, count int")
    g = expression.by_gene(c)
    assert rows(g, "gene", "sample_id", "count") == [("a", "s", 7), ("a", "t", 0), ("b", "s", 20), ("b", "t", 10)]
    f = {r.sample_id: r.size_factor for r in expression.size_factors(g).collect()}
    assert f["s"] == pytest.approx(math.sqrt(2)) and f["t"] == pytest.approx(math.sqrt(0.5))
    assert expression.expressed(g).count() == 4  # fewer than five samples: everything stays


def test_dispersions_without_a_parametric_trend(spark):
    """Dispersions that grow with the mean have no trend a0 + a1 / mean: the local fit follows them, and variances stop growing with the mean."""
    rng = np.random.default_rng(6)
    genes, samples = 600, 24
    means = np.exp(rng.uniform(math.log(20), math.log(20_000), genes))
    true = 0.02 * (means / 20) ** 0.4
    y = rng.poisson(rng.gamma(1 / true[:, None], (true * means)[:, None], (genes, samples)))
    data = [(f"g{i}", f"s{j}", int(y[i, j])) for i in range(genes) for j in range(samples)]
    c = spark.createDataFrame(data, "gene string, sample_id string, count long")
    fits = expression.dispersions(c.withColumn("size_factor", F.lit(1.0)))
    assert expression.trend(fits) is None
    at, logs = expression._local(fits)
    error = np.abs(np.exp(np.interp(np.log(means), at, logs)) / true - 1)
    assert np.median(error) < 0.1 and np.quantile(error, 0.95) < 0.3
    with pytest.warns(UserWarning, match="local regression"):
        x = expression.vst(c).toPandas()
    g = x.groupby("gene")["value"].agg(["mean", "std"]).sort_values("mean")["std"].to_numpy()
    assert 0.8 < g[:150].mean() / g[-150:].mean() < 1.25
    raw = np.log2(y + 1).std(axis=1)[np.argsort(means)]
    assert abs(g[:150].mean() / g[-150:].mean() - 1) < abs(raw[:150].mean() / raw[-150:].mean() - 1)
    assert (x.merge(c.toPandas()).groupby("gene").apply(lambda v: v["value"].rank().corr(v["count"].rank()), include_groups=False) > 0.9).all()


def test_dispersions_of_known_counts(spark):
    rng = np.random.default_rng(8)

    def likelihood(alpha, y, mu):
        r = 1 / alpha
        fit = sum(math.lgamma(k + r) - math.lgamma(r) - k * math.log(m + r) - r * math.log(1 + m / r) for k, m in zip(y, mu))
        return fit - 0.5 * math.log(sum(1 / (1 / m + alpha) for m in mu))

    size = rng.uniform(0.5, 2, 40)
    for true in (0.05, 0.4, 2.0):
        y = rng.negative_binomial(1 / true, 1 / (1 + true * 80 * size))
        got, mu = expression.dispersion(y, size), (y / size).mean() * size
        best = max((likelihood(a, y, mu), a) for a in np.exp(np.linspace(math.log(got) - 1, math.log(got) + 1, 2001)))
        assert abs(math.log(got / best[1])) < 2e-3 and abs(math.log(got / true)) < 0.7
    data = []
    for g in range(300):
        mean = 2.0 ** rng.uniform(3, 11)
        a = 0.05 + 3 / mean
        data += [(f"g{g}", f"s{j}", int(k)) for j, k in enumerate(rng.negative_binomial(1 / a, 1 / (1 + a * mean), 12))]
    c = spark.createDataFrame(data, "gene string, sample_id string, count long")
    a0, a1 = expression.trend(expression.dispersions(c.withColumn("size_factor", F.lit(1.0))))
    assert 0.03 < a0 < 0.08 and 1.5 < a1 < 5
    sd = expression.vst(c).groupBy("gene").agg(F.avg("value").alias("m"), F.stddev("value").alias("sd")).toPandas()
    low, high = sd[sd.m < sd.m.median()].sd.median(), sd[sd.m >= sd.m.median()].sd.median()
    assert 0.7 < low / high < 1.4  # the variance no longer depends on the mean


def test_modes(spark):
    v = spark.createDataFrame([("c", 5, "x"), ("d", 5, "y")], "chrom string, pos long, id string")
    iv = spark.createDataFrame([("c", 4, 5)], "chrom string, start long, stop long")
    assert variants.in_mode(v, "all_intervals", iv, iv).count() == variants.in_mode(v, "WES").count() == 2
    assert rows(variants.in_mode(v, "WGS", iv), "id") == [("x",)] and rows(variants.in_mode(v, "WES", None, iv), "id") == [("x",)]
    for bad in (("WGS", None), ("panel", iv)):
        with pytest.raises(ValueError):
            variants.in_mode(v, *bad)


def test_histogram_of_odd_values(spark):
    inf = float("inf")
    df = spark.createDataFrame(
        [("s", 1.0), ("s", inf), ("s", None), ("s", float("nan")), ("t", 2.0), ("t", 2.0000001), ("u", inf)], "sample_id string, v double",
    )
    for bins in (200, None):
        got = report.histogram(df, "v", ["sample_id"], bins).groupBy("sample_id").agg(F.sum("n")).collect()
        assert {tuple(r) for r in got} == {("s", 1), ("t", 2)}


def test_histogram_counts_everything(spark):
    df = spark.range(1000).select(F.lit("s").alias("sample_id"), (F.col("id") % 97).cast("double").alias("v"))
    for bins in (200, None):
        assert report.histogram(df, "v", ["sample_id"], bins).agg(F.sum("n")).first()[0] == 1000


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_borda_in_ranges(spark):
    """No sample is ranked by one window: values are numbered range by range, also without a sample, and equal to the rule."""
    rng = random.Random(5)
    values = [rng.choice([None, rng.randint(-40, 40) / 4, 1e9 + i, float("nan")]) for i in range(400)]
    df = spark.createDataFrame([(None if i % 2 else "s", i, v) for i, v in enumerate(values)], "sample_id string, row_id int, ic50 double")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = borda.consensus(df, BordaConfig([Feature("ic50", 1.0)]))
        got = {r.row_id: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert "Window" not in physical(out)
    for odd in (0, 1):
        want = [p or 0.0 for p in points(values[odd::2])]
        for i, p in enumerate(want):
            better, alike = sum(q > p for q in want), want.count(p)
            assert got[2 * i + odd].Borda_Score == pytest.approx(p, rel=1e-3) and got[2 * i + odd].Borda_Rank == better + 1 + (alike - 1) / 2


def test_lengths_without_a_window(spark):
    kind = "sample_id string, `Gene Name` string, `Peptide Length` string, `Epitope Seq` string"
    df = spark.createDataFrame([("a", "G1", None, "PEPT"), ("a", "G2", "9", "PEP"), ("b", "G1", None, "PEPTI"), (None, "G1", "7", "P"), (None, "G3", None, "PP")], kind)
    x = union.project(df, ["Gene Name", "HLA Allele", "Peptide Length", "Epitope Seq", "IC50"], "Splice Variant", "MHC Class I")
    assert rows(x, "sample_id", "gene_name", "peptide_length") == sorted([("a", "G1", None), ("a", "G2", 9), ("b", "G1", 5), (None, "G1", 7), (None, "G3", None)], key=str)
    assert "Window" not in physical(x)


def test_values_collapsed_by_first_place(spark):
    """Repeated values meet before lists are made; a place that is not known comes first."""
    b = spark.createDataFrame([("g", i, str(i % 3), None if i % 2 else "nan") for i in range(300)] + [("g", None, "z", " x ")], "gene string, o long, `a.b` string, w string")
    a = spark.createDataFrame([("g",), ("h",)], "gene string")
    out = annotate.attach_values(a, b, [("gene", "gene")], {"a.b": "v", "w": "w"}, "o", require=False)
    assert rows(out, "gene", "v", "w") == [("g", "z;0;1;2", "x"), ("h", None, None)]
    assert "collect_list" not in physical(out)


def test_vst_reads_its_input_once(spark):
    """What comes out is read from the counts that are written first, not from the input again."""
    c = spark.createDataFrame([(f"g{i}", f"s{j}", (i * 7 + j * 3) % 50 + 5 * i) for i in range(30) for j in range(6)], "gene string, sample_id string, count long")
    out = expression.vst(c)
    assert out.count() == 180 and "ExistingRDD" not in physical(out)
