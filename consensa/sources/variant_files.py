"""Variant call files: header-driven scan, genotypes as rows, and a writer in the order of the header's contigs.

Lines are read and written as text by Spark, so compressed files, folders and any store work. Only header lines reach the driver.
Rows are (chrom, pos, id, ref, alt, qual, filter, info map, format array, samples array of (sample_id, fields map)); a dot is null. A flag is a key with
a null value. Of a key that a line repeats, the first value counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")  # fixed values: the columns of the format
TYPES = {"Integer": "int", "Float": "double", "Flag": "boolean"}


@dataclass
class Header:
    """A file's meta lines, in order, and its samples."""

    meta: list[str] = field(default_factory=lambda: ["##fileformat=VCFv4.2"])
    samples: list[str] = field(default_factory=list)

    def declared(self, kind: str) -> dict[str, tuple[str, str]]:
        """{id: (type, number)} of ``kind`` lines: INFO, FORMAT, FILTER, contig."""
        out = {}
        for line in self.meta:
            if line.startswith(f"##{kind}=<"):
                part = lambda k, line=line: (re.search(rf"[<,]{k}=([^,>]+)", line) or [None, ""])[1]
                out[part("ID")] = (part("Type"), part("Number"))
        return out

    @property
    def contigs(self) -> list[str]:
        return list(self.declared("contig"))

    def renamed(self, old: str, new: str) -> Header:
        return replace(self, samples=[new if s == old else s for s in self.samples])

    def only(self, sample: str) -> Header:
        return replace(self, samples=[s for s in self.samples if s == sample])

    def lines(self) -> list[str]:
        return [*self.meta, "#" + "\t".join([*FIXED, *(["FORMAT", *self.samples] if self.samples else [])])]


def _known(x: Column) -> Column:
    return F.nullif(x, F.lit("."))


def _entries(text: str, sep: str) -> str:
    """SQL: a map of ``key=value`` parts, the first of each key."""
    parts = f"transform(filter(split({text}, '{sep}'), x -> x <> '' and x <> '.'), x -> struct(substring_index(x, '=', 1) as key, if(instr(x, '=') > 0, substr(x, instr(x, '=') + 1), null) as value))"
    every = f"map_from_entries(filter({parts}, (e, i) -> array_position(transform({parts}, y -> y.key), e.key) = i + 1))"
    # only a text with a repeated key, an empty part or a dot needs the list of its parts
    odd = rf"(?:^|{sep})([^{sep}=]*)(?:=[^{sep}]*)?{sep}(?:.*{sep})?\1(?:=|{sep}|$)|(?:^|{sep})\.?(?:{sep}|$)"
    return f"case when {text} rlike r'{odd}' then {every} else str_to_map({text}, '{sep}', '=') end"


def header(lines: DataFrame) -> Header:
    """From the lines (value, at) of one file or folder."""
    found = [r.value for r in lines.filter(F.col("value").startswith("#")).orderBy("at").select("value").collect()]
    names = next((x.split("\t") for x in found if x.startswith("#CHROM")), ["#CHROM"])
    return Header([x for x in found if x.startswith("##")], names[len(FIXED) + 1 :])


def scan(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """(header, rows) of a file, or of a folder of its parts."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    head = header(spark.read.text(path).select("value", at.alias("at")))
    x = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    x = x.select(
        cell(0).alias("chrom"), cell(1).cast("long").alias("pos"), _known(cell(2)).alias("id"), cell(3).alias("ref"), _known(cell(4)).alias("alt"),
        _known(cell(5)).try_cast("double").alias("qual"), _known(cell(6)).alias("filter"), cell(7).alias("_info"), F.split(_known(cell(8)), ":").alias("format"),
        F.slice("c", len(FIXED) + 2, max(len(head.samples), 1)).alias("_cells"),
    )
    names = F.array(*[F.lit(s) for s in head.samples]).cast("array<string>")
    x = x.withColumn("_names", names)
    values = "transform(split(s._cells, ':'), v -> nullif(v, '.'))"
    padded = f"slice(concat({values}, array_repeat(cast(null as string), greatest(size(format) - size(split(s._cells, ':')), 0))), 1, size(format))"
    fields = f"map_from_arrays(format, {padded})"
    samples = f"transform(arrays_zip(_names, _cells), s -> struct(s._names as sample_id, {fields} as fields))"
    return head, x.select(
        "chrom", "pos", "id", "ref", "alt", "qual", "filter", F.expr(_entries("_info", ";")).alias("info"), "format", F.expr(samples).alias("samples"),
    )


def _typed(value: Column, declared: tuple[str, str] | None) -> Column:
    kind, number = declared or ("String", "1")
    to = TYPES.get(kind, "string")
    return value.try_cast(to) if number in ("0", "1") else F.transform(F.split(value, ","), lambda v: _known(v).try_cast(to))


def with_info(rows: DataFrame, head: Header, names: Sequence[str]) -> DataFrame:
    """``rows`` with INFO keys as columns of the declared types; several values are an array, a flag is true or false."""
    known = head.declared("INFO")
    flag = lambda n: F.array_contains(F.map_keys("info"), n)
    return rows.withColumns({n: flag(n) if known.get(n, ("", ""))[0] == "Flag" else _typed(F.try_element_at("info", F.lit(n)), known.get(n)) for n in names})


def genotypes(rows: DataFrame, head: Header, names: Sequence[str]) -> DataFrame:
    """A row a variant and sample: the variant's columns, sample_id, and FORMAT keys as columns of the declared types."""
    known = head.declared("FORMAT")
    x = rows.withColumn("_s", F.explode("samples")).drop("samples", "format")
    own = [c for c in x.columns if c != "_s"]
    return x.select(*own, "_s.sample_id", *[_typed(F.try_element_at("_s.fields", F.lit(n)), known.get(n)).alias(n) for n in names])


def _named(sample: str):
    return lambda s: s["sample_id"] == sample


def only_sample(rows: DataFrame, sample: str) -> DataFrame:
    return rows.withColumn("samples", F.filter("samples", _named(sample)))


def renamed(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumn("samples", F.transform("samples", lambda s: s.withField("sample_id", F.when(s["sample_id"] == old, new).otherwise(s["sample_id"]))))


def by_coordinate(lines: DataFrame, path: str, contigs: Sequence[str] | None = None, first: Sequence[str] = (), files: int | None = None) -> None:
    """Write text lines (value, chrom, start, ...) by contig and start, further columns breaking ties; part files follow one another in name.

    The order of contigs is that of ``contigs`` (others after them, by name), or that of names. Lines ``first`` come before all others. The table
    is dealt over ranges and each is sorted by itself, so no task holds it whole.
    """
    spark = lines.sparkSession
    rank = F.lit(0)
    if contigs:
        known = spark.createDataFrame([(c, i) for i, c in enumerate(contigs)], "chrom string, _rank int")  # as many as the header names
        lines = lines.join(F.broadcast(known), "chrom", "left")
        rank = F.coalesce("_rank", F.lit(len(contigs)))
    more = [c for c in lines.columns if c not in ("value", "chrom", "start", "_rank")]
    x = lines.select(rank.alias("_rank"), "chrom", F.col("start").cast("long").alias("start"), *more, "value")
    if first:
        none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in more]
        x = x.unionByName(spark.createDataFrame(list(enumerate(first)), "start long, value string").select(F.lit(-1).alias("_rank"), F.lit("").alias("chrom"), "start", *none, "value"))
    order = ["_rank", "chrom", "start", *more]
    x = x.repartitionByRange(files, *order) if files else x.repartitionByRange(*order)
    x.sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def write(rows: DataFrame, head: Header, path: str, files: int | None = None) -> None:
    """Rows as of ``scan`` in the order of the header's contigs, position and alleles; the header's samples are the columns."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    info = "array_join(transform(map_entries(info), e -> if(e.value is null, e.key, concat(e.key, '=', e.value))), ';')"
    mine = [F.element_at(F.filter("samples", _named(name)), 1)["fields"] for name in head.samples]
    x = rows.withColumns({f"_f{i}": c for i, c in enumerate(mine)})
    said = [F.expr(f"array_join(transform(format, k -> coalesce(try_element_at(_f{i}, k), '.')), ':')") for i in range(len(mine))]
    line = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), dot(F.col("id")), "ref", dot(F.col("alt")), dot(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", "")),
        dot(F.col("filter")), dot(F.nullif(F.expr(info), F.lit(""))), *([dot(F.array_join("format", ":"))] if head.samples else []), *[dot(c) for c in said],
    )
    by_coordinate(x.select(line.alias("value"), "chrom", F.col("pos").alias("start"), "ref", "alt"), path, head.contigs, head.lines(), files)
