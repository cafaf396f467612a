"""Writers. A sample is a partition folder of the output, and a run replaces only its own samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import report
from . import readers


def csv(df: DataFrame, path: str, by: Sequence[str] = (), sep: str = ",", header: bool = True, rename: dict[str, str] | None = None) -> None:
    """Delimited files; null is blank, quotes are doubled; an empty frame still writes its header."""
    out = df.select(*[F.col(f"`{c}`").alias((rename or {}).get(c, c)) for c in df.columns])
    if not by and out.isEmpty():
        out = out.coalesce(1)
    w = out.write.mode("overwrite").option("header", header).option("sep", sep).option("nullValue", "").option("emptyValue", "").option("escape", '"')
    if by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    w.csv(path)


def tsv(df: DataFrame, path: str, header: bool = True, by: Sequence[str] = ()) -> None:
    csv(df, path, by, "\t", header)


def graph(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    for name, df in (("vertices", vertices), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(f"{folder}/{name}")


def indexed(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, genes) of symmetric coordinate matrices: row numbers from 1 in gene order, each edge in both triangles."""
    genes = vertices.select("sample_id", "gene").distinct().withColumn("i", F.row_number().over(W.partitionBy("sample_id").orderBy("gene")))
    both = edges.select(
        "sample_id", F.col("a").alias("r"), F.col("b").alias("c"), "weight",
    ).unionByName(edges.select("sample_id", F.col("b").alias("r"), F.col("a").alias("c"), "weight"))
    at = lambda n: genes.select("sample_id", F.col("gene").alias(n), F.col("i").alias(f"{n}_i"))
    return both.join(at("r"), ["sample_id", "r"]).join(at("c"), ["sample_id", "c"]).select(
        "sample_id", F.col("r_i").alias("row"), F.col("c_i").alias("col"), "weight",
    ), genes


def matrix_market(edges: DataFrame, vertices: DataFrame, folder: str) -> None:
    """One coordinate file a sample (header lines first) and one gene list beside it, as text."""
    cells, genes = indexed(edges, vertices)
    n = genes.groupBy("sample_id").agg(F.count("*").alias("n"))
    m = cells.groupBy("sample_id").agg(F.count("*").alias("m"))
    head = n.join(m, "sample_id", "left").select(
        "sample_id", F.lit(0).alias("o"), F.lit(0).alias("p"),
        F.concat(F.lit("%%MatrixMarket matrix coordinate real general\n"), F.concat_ws(" ", "n", "n", F.coalesce("m", F.lit(0)))).alias("value"),
    )
    body = cells.select("sample_id", F.col("row").alias("o"), F.col("col").alias("p"), F.concat_ws(" ", "row", "col", "weight").alias("value"))
    lines = head.unionByName(body).repartition("sample_id").sortWithinPartitions("sample_id", "o", "p").select("sample_id", "value")
    for df, name in (
        (lines, "matrix"),
        (genes.repartition("sample_id").sortWithinPartitions("sample_id", "i").select("sample_id", F.col("gene").alias("value")), "genes"),
    ):
        df.write.mode("overwrite").partitionBy("sample_id").text(f"{folder}/{name}")


def cells(df: DataFrame, shape: dict[str, Callable] | None = None) -> DataFrame:
    """Every column as HTML: escaped text, or what ``report.shapes`` or ``shape`` makes of it."""
    how = report.shapes(df.columns) | (shape or {})
    return df.select(*[how.get(c, report.escape)(F.col(f"`{c}`")).alias(c) for c in df.columns])


def pages(df: DataFrame, folder: str, name: Column, title: Column | None = None, drop: Sequence[str] = (), shape: dict[str, Callable] | None = None) -> list[str]:
    """One standalone page for each ``name``, in one job: their paths, by name. Rows keep the order they have.

    Tasks write the pages as text below a folder of their own, a page in one task, through the file system of ``folder``; when all are there, each is moved
    to its name, so a failed run leaves no page half written. No cell passes the driver.
    """
    spark, shown = df.sparkSession, [c for c in df.columns if c not in drop]
    at = F.monotonically_increasing_id().alias("_row")
    named = df.select(name.alias("_name"), (title if title is not None else name).alias("_title"), at, *[F.col(f"`{c}`") for c in shown])
    how = report.shapes(shown) | (shape or {})
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(how.get(c, report.escape)(F.col(f"`{c}`")), F.lit("")), F.lit("</td>")) for c in shown], F.lit("</tr>"))
    body = named.select("_name", F.lit(1).alias("_part"), "_row", row.alias("value"))
    around = named.groupBy("_name").agg(F.min("_title").alias("_title"))
    head, foot = report.page_head(F.col("_title"), shown), F.lit(report.PAGE_FOOT)
    ends = [around.select("_name", F.lit(k).alias("_part"), F.lit(0).cast("long").alias("_row"), v.alias("value")) for k, v in ((0, head), (2, foot))]
    lines = body.unionByName(ends[0]).unionByName(ends[1]).repartition("_name").sortWithinPartitions("_name", "_part", "_row")
    made = f"{folder.rstrip('/')}/_pages-{uuid.uuid4().hex}"
    lines.select("_name", "value").write.partitionBy("_name").text(made)
    return _moved(spark, made, folder)


def _moved(spark: SparkSession, made: str, folder: str) -> list[str]:
    """Each page of ``made`` to its name in ``folder``."""
    p, fs = readers._path(spark, made)
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    out = []
    for at in fs.globStatus(readers._path(spark, f"{made}/_name=*/part-*")[0]) or []:
        name = plain(at.getPath().getParent().getName().removeprefix("_name="))
        to, _ = readers._path(spark, f"{folder.rstrip('/')}/{name}")
        fs.delete(to, False)
        if not fs.rename(at.getPath(), to):
            raise OSError(f"{name} could not be moved to {folder}")
        out.append(f"{folder.rstrip('/')}/{name}")
    fs.delete(p, True)
    return sorted(out)


def html(df: DataFrame, path: str, title: str, shape: dict[str, Callable] | None = None) -> None:
    """Write one standalone page."""
    folder, _, name = path.rpartition("/")
    if df.isEmpty():  # a page without rows has no name of its own
        df = df.unionByName(df.sparkSession.createDataFrame([tuple([None] * len(df.columns))], df.schema))
    pages(df, folder or ".", F.lit(name), F.lit(title), shape=shape)


def html_batch(df: DataFrame, folder: str, by: str = "sample_id", shape: dict[str, Callable] | None = None) -> list[str]:
    """One page a sample, in one job: <sample>_epitopes.html."""
    sample = F.coalesce(F.col(by).cast("string"), F.lit("None"))
    return pages(df, folder, F.concat(sample, F.lit("_epitopes.html")), sample, [by], shape)


def html_files(spark: SparkSession, source: str, folder: str, title: str = "Epitope Prioritisation Table", pattern: str = "*_epitopes_final.csv") -> list[str]:
    """One page for each CSV of ``source``: a file, a folder (its files that match ``pattern``), or a glob. Rows keep their order.

    Files with the same header are one job.
    """
    p, fs = readers._path(spark, source)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        p, fs = readers._path(spark, f"{source.rstrip('/')}/{pattern}")
    found = [x.getPath().toString() for x in fs.globStatus(p) or []]
    if not found:
        return []
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(found).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    heads: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "at").alias("head")).collect():  # a line a file
        heads.setdefault(r.head, []).append(r.file)
    out = []
    for files in heads.values():
        x = readers.placed(spark.read.option("header", True).option("escape", '"').csv(files))
        file = F.element_at(F.split("_place.file", "/"), -1)
        name = F.when(file.endswith("_epitopes_final.csv"), F.concat(F.regexp_replace(file, "_epitopes_final[.]csv$", ""), F.lit("_epitopes.html")))
        name = F.coalesce(name, F.concat(F.regexp_replace(file, "[.][^.]*$", ""), F.lit(".html")))
        out += pages(x.sort("_place"), folder, name, F.lit(title), ["_place"])
    return sorted(out)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` if it has any row; an error otherwise."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
