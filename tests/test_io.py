"""Readers, writers, the stream and the registered queries."""

import re
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from consensa.functions import tables
from consensa.operators import report
from consensa.plans import catalog
from consensa.sources import readers, sinks, variant_files
from consensa.streaming.incremental import rank_arrivals

DIR = "/root/testdata/sf0.001"


def test_tolerant_scan(spark, tmp_path):
    kind = "a string, b int, c double"
    (tmp_path / "empty.tsv").write_text("")
    for path in (None, "", str(tmp_path / "no.tsv"), str(tmp_path / "empty.tsv")):
        got = readers.tolerant(spark, path, kind)
        assert got.count() == 0 and got.columns == ["a", "b", "c"]
    (tmp_path / "x.tsv").write_text("b\ta\n7\tx\nq\ty\n")
    assert [tuple(r) for r in readers.tolerant(spark, str(tmp_path / "x.tsv"), kind).orderBy("a").collect()] == [("x", 7, None), ("y", None, None)]


def test_formats(spark, tmp_path):
    (tmp_path / "S1_CancerRNA_L1.txt").write_text("# program\nGeneid\tChr\tx.bam\nA\t1\t5\nB\t1\t7\n")
    assert sorted(map(tuple, readers.counts(spark, [str(tmp_path / "S1_CancerRNA_L1.txt")]).collect())) == [("A", "S1", 5), ("B", "S1", 7)]
    (tmp_path / "m.csv").write_text(",s-1,s.2\ng,1.5,2\n")
    assert sorted(map(tuple, readers.matrix(spark, str(tmp_path / "m.csv")).collect())) == [("g", "s-1", 1.5), ("g", "s.2", 2.0)]
    (tmp_path / "sets.gmt").write_text("S\tdesc\tA\tB\nT\tdesc\nU\td\tC\n")
    assert sorted(map(tuple, readers.gene_sets(spark, str(tmp_path / "sets.gmt")).collect())) == [("S", "A"), ("S", "B"), ("U", "C")]
    (tmp_path / "net.tsv").write_text("#x\n1\t2\t0.5\n")
    assert tuple(readers.interactions(spark, str(tmp_path / "net.tsv")).first()) == ("1", "2", 0.5)
    (tmp_path / "a.gaf").write_text("!c\n" + "\t".join(f"v{i}" for i in range(17)) + "\n")
    assert readers.annotations(spark, str(tmp_path / "a.gaf")).first().go_id == "v4"
    (tmp_path / "g.json").write_text('{"A": [1.5, 2, 3], "B": [1, 2]}')
    assert readers.json_map(spark, str(tmp_path / "g.json")).first().m == {"A": ["1.5", "2", "3"], "B": ["1", "2"]}
    (tmp_path / "c.yaml").write_text("a:\n  b: 1\n")
    assert readers.config(spark, str(tmp_path / "c.yaml")) == {"a": {"b": 1}}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("dir/x.tsv", "hello")
    found = readers.archive_lines(readers.archives(spark, str(tmp_path / "z.zip")), "x.tsv").collect()
    assert [(r.member.endswith("x.tsv"), r.line, r.value) for r in found] == [(True, 0, "hello")]
    assert readers.archive_lines(readers.archives(spark, str(tmp_path / "z.zip")), "none").isEmpty()
    (tmp_path / "sheet.csv").write_text("sample_name,fastq_R1,fastq_R2,datatype,lane\na,1,2,CancerRNA,L1\na,3,4,CancerRNA,L1\n")
    got = readers.sample_sheet(spark, str(tmp_path / "sheet.csv")).collect()
    assert len(got) == 1 and got[0].fastq_R1 == "3"
    assert readers.first_match(spark, str(tmp_path / "*.csv")).endswith("m.csv") and readers.first_match(spark, str(tmp_path / "*.none")) is None
    assert readers.existing(spark, [str(tmp_path / "m.csv"), str(tmp_path / "q")]) == [str(tmp_path / "m.csv")]
    (tmp_path / "x.bed").write_text("track x\nc1\t4\t9\n")
    (tmp_path / "x.interval_list").write_text("@HD\n@SQ\nc1\t5\t9\t+\tn\nc2:7-8\n")
    assert [tuple(r) for r in readers.intervals(spark, str(tmp_path / "x.bed")).collect()] == [("c1", 4, 9)]
    assert [tuple(r) for r in readers.intervals(spark, str(tmp_path / "x.interval_list")).collect()] == [("c1", 4, 9), ("c2", 6, 8)]
    h = spark.createDataFrame([("@M:1:FC9:3:1:2:3 1:N:0:ACGT",), ("@odd",)], "h string")
    g = readers.read_group(h["h"])
    assert [tuple(r) for r in h.select(g["flowcell"], g["lane"], g["barcode"]).collect()] == [("FC9", "3", "ACGT"), ("flowcell", "lane", "barcode")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "a", None), ("t", "b", 1)], "sample_id string, x string, y int")
    sinks.csv(df, str(tmp_path / "o"), ["sample_id"])
    back = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert back.count() == 2
    sinks.csv(df.filter("false"), str(tmp_path / "e"), rename={"x": "X.1"})
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv")).strip() == "sample_id,X.1,y"
    edges = spark.createDataFrame([("s", "a", "b", 2.0)], "sample_id string, a string, b string, weight double")
    vertices = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "sample_id string, gene string")
    sinks.matrix_market(edges, vertices, str(tmp_path / "mm"))
    text = "".join(p.read_text() for p in (tmp_path / "mm/matrix/sample_id=s").glob("*.txt"))
    assert text.splitlines() == ["%%MatrixMarket matrix coordinate real general", "3 3 2", "1 2 2.0", "2 1 2.0"]
    assert "".join(p.read_text() for p in (tmp_path / "mm/genes/sample_id=s").glob("*.txt")).split() == ["a", "b", "c"]
    with pytest.raises(ValueError):
        sinks.require_rows(df.filter("false"), "x")
    html = sinks.html_batch(
        spark.createDataFrame([("s", "<b>", "Act", "Somatic")], "sample_id string, x string, GO_MF string, `Mutation.Source` string"),
        str(tmp_path), shape={"x": lambda c: report.badge(c, "X")},
    )
    page = open(html[0]).read()
    assert 'title="&lt;b&gt;">X<' in page and '<span class="pill" title="Act">MF</span>' in page and "Genomic" in page and "All" in page
    for name in ("s1_epitopes_final.csv", "s2_epitopes_final.csv", "other.csv"):
        (tmp_path / "final").mkdir(exist_ok=True)
        (tmp_path / "final" / name).write_text('Gene,Intogen_Driver_role\n"z ""q""",LoF\nb,\n')
    out = sinks.html_files(spark, str(tmp_path / "final"), str(tmp_path))
    assert [x.rsplit("/", 1)[1] for x in out] == ["s1_epitopes.html", "s2_epitopes.html"]
    assert "z &quot;q&quot;" in open(out[0]).read() and open(out[0]).read().index("z &quot;") < open(out[0]).read().index("<td>b</td>")
    assert len(sinks.html_files(spark, str(tmp_path / "final" / "*.csv"), str(tmp_path))) == 3
    assert [x.rsplit("/", 1)[1] for x in sinks.html_files(spark, str(tmp_path / "final" / "other.csv"), str(tmp_path))] == ["other.html"]


def test_variant_files(spark, tmp_path):
    """A made file read and written again; order by the header's contigs over several part files; unknown contigs come last."""
    head = ["##fileformat=VCFv4.2", "##contig=<ID=c2,length=9>", "##contig=<ID=c10>", "##contig=<ID=c1>", '##INFO=<ID=DP,Number=1,Type=Integer,Description="a, b">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">']
    body = [
        "c1\t5\t.\tA\tG\t50\tPASS\tDP=7;DB;DP=9;X=a=b\tGT:AD\t0/1:3,4\t./.", "c10\t7\trs1\tA\tG,T\t.\t.\t.\tGT\t0/0\t1/1",
        "c2\t9\t.\tAT\tG\t1.5\tq10\tDP=x\tGT:AD:Z\t0/0:1,.:.\t0/1", "zz\t1\t.\tA\t.\t3\tPASS\tDB\tGT\t.\t.",
    ]
    names = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tN\tT"
    (tmp_path / "a.vcf").write_text("\n".join([*head, names, *body]) + "\n")
    h, x = variant_files.scan(spark, str(tmp_path / "a.vcf"))
    assert h.contigs == ["c2", "c10", "c1"] and h.samples == ["N", "T"] and h.declared("INFO") == {"DP": ("Integer", "1")}
    got = {(r.chrom, r.sample_id): r for r in variant_files.genotypes(variant_files.with_info(x, h, ["DP"]), h, ["GT", "AD"]).collect()}
    assert len(got) == 8 and got["c1", "N"].DP == 7 and got["c1", "N"].AD == [3, 4] and got["c1", "T"].AD is None and got["c1", "T"].GT == "./."
    assert got["c2", "N"].DP is None and got["c2", "N"].AD == [1, None] and got["zz", "T"].GT is None and got["c10", "T"].id == "rs1"
    variant_files.write(x, h, str(tmp_path / "out"), files=3)
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    want = [body[i] for i in (2, 1, 0, 3)]
    want = [w.replace("DP=7;DB;DP=9;X=a=b", "DP=7;DB;X=a=b").replace("./.", "./.:.", 1) if w.startswith("c1\t") else w for w in want]
    want = [w.replace("0/0:1,.:.\t0/1", "0/0:1,.:.\t0/1:.:.") for w in want]
    assert len(parts) > 1 and lines == [*head, names, *want]
    one = variant_files.renamed(variant_files.only_sample(x, "T"), "T", "tumour")
    variant_files.write(one, h.only("T").renamed("T", "tumour"), str(tmp_path / "one"))
    h, y = variant_files.scan(spark, str(tmp_path / "one"))
    assert h.samples == ["tumour"] and [len(r.samples) for r in y.collect()] == [1] * 4
    gtf = spark.createDataFrame([(f"{c}\t{s}", c, s) for c, s in (("b", 3), ("a", 20), ("a", 3), ("b", 1))], "value string, chrom string, start long")
    variant_files.by_coordinate(gtf, str(tmp_path / "gtf"), files=2)
    assert [line for p in sorted((tmp_path / "gtf").glob("part-*")) for line in p.read_text().splitlines()] == ["a\t3", "a\t20", "b\t1", "b\t3"]


def test_pages_of_a_cohort(spark, tmp_path):
    """One job writes every sample's page, rows in order, with search and sorting; a second run replaces pages, and nothing else is left."""
    rows = [(f"s {i % 3}", i, f"<{i}>") for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, n int, text string").repartition(5).sort("n")
    for _ in range(2):
        out = sinks.html_batch(df, str(tmp_path / "pages"))
        assert len(out) == 3 and sorted(p.name for p in (tmp_path / "pages").iterdir() if not p.name.startswith(".")) == [f"s {i}_epitopes.html" for i in range(3)]
    page = open(out[1]).read()
    assert re.findall(r"<td>(\d+)</td>", page) == [str(i) for i in range(60) if i % 3 == 1] and "&lt;1&gt;" in page and "<title>s 1</title>" in page
    assert "type='search'" in page and "onclick" in page and page.endswith("</html>\n")


def test_stream(spark, tmp_path):
    """A sample's rows come in several files: its ranks are those of all of them."""
    from consensa.operators.borda import consensus

    rows = catalog.rel(spark, DIR, catalog.EPI).cache()
    parts = ("sample_id like 'Brand#1%'", "sample_id like 'Brand#2%' and row_id % 2 = 0", "sample_id like 'Brand#2%' and row_id % 2 = 1 or sample_id = 'Brand#31'")
    for i, part in enumerate(parts):
        rows.filter(part).write.parquet(str(tmp_path / "in" / f"b{i}"))
        src = str(tmp_path / "in" / "*")
        rank_arrivals(spark, src, rows.schema, str(tmp_path / "out"), str(tmp_path / "ck"), catalog.borda_config()).awaitTermination()
        want = consensus(rows.filter(" or ".join(f"({p})" for p in parts[: i + 1])), catalog.borda_config())
        got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def _cells(df):
    df = df[sorted(df.columns)]
    say = lambda v: "~" if pd.isna(v) else f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(say(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        con.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    assert isinstance(got, pd.DataFrame) and sorted(got.columns) == sorted(want.columns)
    assert _cells(got) == _cells(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_component_sizes_of_measures(spark):
    b = catalog.QUERIES["betweenness"](spark, DIR)
    assert b.filter("betweenness < 0 or betweenness > 1").count() == 0
    i = catalog.QUERIES["component_impact"](spark, DIR)
    assert i.filter("largest_component_impact > 1").count() == 0


def test_tables_between_steps(spark):
    from consensa.functions import tables

    first = tables.keep(spark.range(3).toDF("x"), "first")
    with tables.scope(spark) as own:
        second = tables.keep(first, "second")
        with tables.scope(spark) as inner:  # what an inner scope spares is the outer one's
            third, fourth = tables.keep(second, "third"), tables.keep(second, "fourth")
            inner.spare(third, fourth)
        own.spare(third)
    paths = [t._consensa_path for t in (first, second, third)]
    assert readers.size_of(spark, fourth._consensa_path) == 0
    assert [readers.size_of(spark, p) > 0 for p in paths] == [True, False, True] and third.count() == 3
    tables.release(first, third)
    assert [readers.size_of(spark, p) > 0 for p in paths] == [False] * 3
    with pytest.raises(ValueError), tables.scope(spark) as own:
        fifth = tables.keep(spark.range(3), "fifth")
        own.spare(fifth)
        raise ValueError
    assert readers.size_of(spark, fifth._consensa_path) == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_wide_lines_in_parts(monkeypatch):
    """A line's cells come in batches of ``WIDTH``; short lines, blanks and text give nulls."""
    import pyarrow as pa

    monkeypatch.setattr(readers, "WIDTH", 3)
    lines = ["m,1,,x, 2 ,nan,1e3,7,8", 'n,"4",5', "o"]
    out = list(readers._dense('row,a,b,"c,1",d,e,f,g', ",")([pa.record_batch({"value": lines})]))
    assert max(b.num_rows for b in out) == 3
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert [g[1] for g in got[:7]] == ["a", "b", "c,1", "d", "e", "f", "g"] and [g[0] for g in got[::7]] == ["m", "n", "o"]
    monkeypatch.undo()
    cells = ["" if i % 3 else f"{i % 50}.25" for i in range(150000)]
    batch = pa.record_batch({"value": ["m," + ",".join(cells)]})
    long = [v for b in readers._dense("," + ",".join(map(str, range(150000))), ",")([batch]) for v in b.column(2).to_pylist()]
    assert long == [float(c) if c else None for c in cells]
    assert [None if v is None or v != v else v for _, _, v in got] == [1, None, None, 2, None, 1000, 7, 4, 5, *[None] * 5, *[None] * 7]


def test_info_of_odd_parts(spark, tmp_path):
    """A list of parts is made only for texts that need one; the first value of a key counts there."""
    said = ["A=1;B;C=2=3", "A=1;B;A=2", "AA=1;A=2", ".", "A=1;;B", "A=", "A;A=1", "A=1;.", "B=A;A=B"]
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n" + "".join(f"c\t{i}\t.\tA\tG\t.\t.\t{x}\tGT:DP\t0/1\n" for i, x in enumerate(said)))
    _, x = variant_files.scan(spark, str(tmp_path / "a.vcf"))
    assert "str_to_map" in x._jdf.queryExecution().analyzed().toString().lower()
    want = [{"A": "1", "B": None, "C": "2=3"}, {"A": "1", "B": None}, {"AA": "1", "A": "2"}, {}, {"A": "1", "B": None}, {"A": ""}, {"A": None}, {"A": "1"}, {"B": "A", "A": "B"}]
    assert [r.info for r in x.orderBy("pos").collect()] == want
    assert all(r.samples[0].fields == {"GT": "0/1", "DP": None} for r in x.collect())


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 4000)
    got = catalog.QUERIES["vcf_combine"](spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 4000
