"""Scans of the file formats that the workflow exchanges. Paths go through Spark's file system, so any store works."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHEET = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_name", "fastq_R1", "fastq_R2", "datatype", "lane", "HLA-types")])
# The 17 columns of gene annotation files.
GAF = [
    "db", "object_id", "gene", "qualifier", "go_id", "reference", "evidence", "with_from", "aspect", "name", "synonym", "type", "taxon",
    "date", "assigned_by", "extension", "product",
]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, path: str | None) -> int:
    """Bytes below ``path``; 0 if it is empty, blank or absent."""
    if not path:
        return 0
    p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that hold any bytes."""
    return [p for p in paths if size_of(spark, p) > 0]


def first_match(spark: SparkSession, pattern: str) -> str | None:
    """The first path, in order, that matches a glob."""
    p, fs = _path(spark, pattern)
    found = fs.globStatus(p)
    return min((str(x.getPath().toString()) for x in found), default=None) if found is not None else None


def first_lane(files: DataFrame) -> DataFrame:
    """(sample_id, path): the least path of each sample."""
    return files.groupBy("sample_id").agg(F.min("path").alias("path"))


def tolerant(spark: SparkSession, path: str | None, schema: T.StructType | str, sep: str = "\t", comment: str | None = None, place: bool = False) -> DataFrame:
    """A delimited file with header; absent, blank and zero-byte paths give an empty frame. Columns are matched by name; ``place`` adds ``_place``."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if size_of(spark, path) == 0:
        none = spark.createDataFrame([], kind)
        return none.withColumn("_place", F.lit(None).cast(PLACE_TYPE)) if place else none
    r = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')  # quotes are doubled
    if comment:
        r = r.option("comment", comment)
    raw = r.csv(path)
    have = raw.columns
    raw = placed(raw) if place else raw
    return raw.select(
        *[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind],
        *["_place"] * place
    )


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One row a (sample_name, datatype, lane): the last of duplicates, by file and place in it."""
    raw = placed(spark.read.option("header", True).csv(path))
    x = raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in SHEET.names], "_place")
    return last_of(x, ["sample_name", "datatype", "lane"], "_place").drop("_place")


PLACE_TYPE = "struct<file:string,block:bigint,row:bigint>"


def placed(raw: DataFrame) -> DataFrame:
    """A file scan with ``_place``: file, start of the file's block, and place in it, so rows sort as they were read."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select("*", at.cast(PLACE_TYPE).alias("_place"))


def last_of(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    w = W.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def counts(spark: SparkSession, paths: Sequence[str], suffix: str = r"_CancerRNA.*$") -> DataFrame:
    """(gene, sample_id, count) from count files: one comment line, a header, gene id first and the count last."""
    return count_lines(spark.read.text(list(paths)).withColumn("path", F.input_file_name()), suffix)


def count_lines(lines: DataFrame, suffix: str = r"_CancerRNA.*$") -> DataFrame:
    """``counts`` from lines (value, path); the sample is the file's name without ``suffix``."""
    cells = F.split("value", "\t")
    number = F.element_at(cells, -1).try_cast("double").try_cast("long")
    sample = F.regexp_replace(F.element_at(F.split("path", "/"), -1), suffix, "")
    x = lines.filter(~F.col("value").startswith("#")).select(cells[0].alias("gene"), number.alias("count"), sample.alias("sample_id"))
    return x.filter(F.col("gene") != "Geneid").select("gene", "sample_id", "count")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(gene, sample_id, value) from a dense CSV whose first column is the row name."""
    return cells(spark, path).select(F.col("row").alias("gene"), F.col("column").alias("sample_id"), "value")


def cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(row, column, value) of a dense delimited matrix: row names first, a header in each file (the same). Cells that are no number are null.

    Lines are taken apart in tasks, each into one array beside the header's, so the plan has three columns however wide the file is.
    Quotes are doubled; a field with a line end in it is not for such files.
    """
    lines = spark.read.text(path)
    first = lines.filter("value <> ''").first()
    kind = "row string, column string, value double"
    if first is None:
        return spark.createDataFrame([], kind)
    return lines.filter((F.col("value") != first[0]) & (F.col("value") != "")).mapInArrow(_dense(first[0], sep), kind)


#: Cells of a line that are made at once.
WIDTH = 1 << 16


def _dense(header: str, sep: str):
    """Lines in, a row a cell out. Lines are parted by Arrow and given out ``WIDTH`` cells at a time: no line becomes a list of Python's, unless it has quotes."""

    def run(batches):
        import csv

        import pyarrow as pa
        import pyarrow.compute as pc

        def fields(line):
            text = line.as_py() if pc.match_substring(line, '"').as_py() else None
            return pc.split_pattern(line, sep).values if text is None else pa.array(next(csv.reader([text], delimiter=sep)))

        def number(x: str) -> float | None:
            try:
                return float(x)
            except (TypeError, ValueError):
                return None

        def numbers(x):
            try:  # numbers and blanks throughout
                # not if_else: on a slice of texts it garbled the last one (Arrow 23.0.1)
                return pc.cast(pc.replace_with_mask(x, pc.equal(x, ""), pa.scalar(None, x.type)), pa.float64())
            except pa.ArrowInvalid:
                return pa.array([number(v) for v in x.to_pylist()], pa.float64())

        columns = fields(pa.scalar(header)).slice(1)
        for b in batches:
            for line in b.column(0):
                cells = fields(line)
                name, cells = cells.slice(0, 1), cells.slice(1)
                for at in range(0, len(columns), WIDTH):
                    label = columns.slice(at, WIDTH)
                    value = numbers(cells.slice(at, WIDTH))
                    if len(value) < len(label):
                        value = pa.concat_arrays([value, pa.nulls(len(label) - len(value), pa.float64())])
                    yield pa.RecordBatch.from_arrays([pa.repeat(name[0], len(label)), label, value.slice(0, len(label))], names=["row", "column", "value"])

    return run


def interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("comment", "#").schema("id1 string, id2 string, score double").csv(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Gene annotation file; lines that begin with '!' are comments."""
    return spark.read.option("sep", "\t").option("comment", "!").schema(", ".join(f"{c} string" for c in GAF)).csv(path)


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, gene) from ragged lines: name, description, genes; lines with fewer than 3 fields are skipped."""
    return split_sets(spark.read.text(path))


def split_sets(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t")
    x = lines.filter(F.size(cells) >= 3).select(cells[0].alias("set_name"), F.explode(F.slice(cells, 3, F.size(cells))).alias("gene"))
    return x.filter(F.col("gene") != "")


def json_map(spark: SparkSession, path: str, kind: str = "map<string,array<string>>") -> DataFrame:
    """One row a file: (path, m)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", kind).alias("m"))


def config(spark: SparkSession, path: str) -> dict:
    """A YAML configuration."""
    import yaml

    return yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop), start excluded, from BED, from interval lists with header lines ('@'), or from 'chrom:start-stop' lines."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^(@|#|track|browser|\s*$)"))
    cells, colon = F.split("value", "\t"), F.regexp_extract("value", r"^(.+):(\d+)-(\d+)$", 1)
    bed = path.lower().removesuffix(".gz").endswith(".bed")
    by_tab = F.struct(
        cells[0].alias("chrom"), (F.get(cells, F.lit(1)).cast("long") - (0 if bed else 1)).alias("start"),
        F.get(cells, F.lit(2)).cast("long").alias("stop"),
    )
    number = lambda i: F.regexp_extract("value", r"^(.+):(\d+)-(\d+)$", i).try_cast("long")
    by_colon = F.struct(colon.alias("chrom"), (number(2) - 1).alias("start"), number(3).alias("stop"))
    return lines.select(F.when(colon != "", by_colon).otherwise(by_tab).alias("x")).select("x.*")


def archives(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")


def archive_lines(files: DataFrame, ending: str) -> DataFrame:
    """(path, member, line, value): the lines of the first member of each archive (path, content) whose name ends so.

    A task opens its archives and unpacks a member as a stream, a few thousand lines at a time; an archive without such a member has no rows.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    name = min((n for n in z.namelist() if n.endswith(ending)), default=None)
                    if name is None:
                        continue
                    with io.TextIOWrapper(z.open(name), "utf-8", newline="\n") as f:
                        at = 0
                        while some := list(itertools.islice(f, 8192)):
                            yield pd.DataFrame({"path": path, "member": name, "line": range(at, at + len(some)), "value": [x.rstrip("\r\n") for x in some]})
                            at += len(some)

    return files.select("path", "content").mapInPandas(run, "path string, member string, line long, value string")


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) as Parquet tables."""
    return spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges")


def read_group(header: F.Column) -> dict[str, F.Column]:
    """Flow cell, lane and barcode of a FASTQ header line, with stand-ins for what is missing."""
    left, right = F.split(header, " ")[0], F.split(header, " ")
    f = F.split(left, ":")
    has = F.size(f) >= 4
    bar = F.split(F.get(right, F.lit(1)), ":")
    return {
        "flowcell": F.when(has, F.get(f, F.lit(2))).otherwise("flowcell"), "lane": F.when(has, F.get(f, F.lit(3))).otherwise("lane"),
        "barcode": F.coalesce(F.nullif(F.element_at(F.when(F.size(bar) >= 4, bar), -1), F.lit("")), F.lit("barcode")),
    }
