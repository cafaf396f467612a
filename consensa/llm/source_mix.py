"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budget cuts.

Sources, in code-point order (null last), weigh 1, 2, 3, repeating, and share the total number of words; a
source gives at most ``most`` times its own words, and what is over is shared again by weight. That end
state is one level: source i gets min(most * size_i, weight_i * level), found by one pass over the sources
sorted by most * size_i / weight_i.

Each document has a key of 60 hash bits (seed, doc_id, text). A source's target is so many whole epochs and
a rest; the rest is cut from the source in key order. The cut is found without sorting the source in one place:
words are summed by key range (three hex digits), prefix sums over ranges give the range that holds the cut,
that range is divided again, and only what is left of it is ordered and summed row by row. Rows with equal
key (repetitions) share what is left of the budget at the cut evenly, rounded down.

Only DataFrame functions are used. Defined results: null text has size 0 and is taken 0 times; null source is
a source; an empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, packed, release, scope

WORD = r"[^\x20\x09-\x0D]+"
MANY_SOURCES = 100_000  # up to so many sources, the table of cuts (about 100 bytes a source) is broadcast


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with _size (words) and _key (15 hex digits)."""
    text = F.coalesce("text", F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), ident, F.md5(text))), 1, 15)
    return docs.withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_key", key)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", w.cast("long")).withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    x = x.withColumn("total", F.sum("source_size").over(W.partitionBy())).withColumn("capped", F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    x = x.withColumn("level", (F.col("total") - most * F.col("capped")) / F.sum("w").over(rest))
    # the level holds from the first source that it doesn't fill
    level = F.min_by(
        F.when(F.col("level") <= F.col("ratio"), F.col("level")),
        F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.coalesce("source", F.lit("")), F.col("source").isNull())),
    ).over(W.partitionBy())
    x = x.withColumn("common", F.coalesce(level, F.lit(0.0)))
    return x.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.col("w") * F.col("common")).alias("target"))


def _narrow(rows: DataFrame, cuts: DataFrame, lead: int, digits: int) -> DataFrame:
    """``cuts`` with ``left`` (words still to take) and ``prefix`` (key range) narrowed by ``digits`` more hex digits."""
    inside = rows.join(F.broadcast(cuts) if cuts._few else cuts, rows["source"].eqNullSafe(cuts["c_source"]) & F.expr(f"left(_key, {lead}) = prefix"))
    sums = inside.groupBy("c_source", F.substring("_key", 1, lead + digits).alias("range"), "left").agg(F.sum("_size").alias("n"))
    w = W.partitionBy("c_source").orderBy("range")
    run = sums.withColumn("upto", F.sum("n").over(w))
    # the first range whose end reaches the budget; the last one if rounding left none
    hit = run.filter("upto >= left").groupBy("c_source").agg(F.min("range").alias("prefix"), F.min_by(F.expr("left - (upto - n)"), "range").alias("left"))
    return hit


def cuts(rows: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source: c_source, source_size, target, epochs, cut (key; rows below it are taken once more), share (words of each row at the cut)."""
    with scope(rows.sparkSession) as own:
        sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
        goal = durable(targets(sizes, weights, most).withColumnRenamed("source", "c_source"), "mix-targets")
        few = goal.count() <= MANY_SOURCES
        budget = F.floor(F.col("target") + 1e-6)  # a target that is whole but for rounding stays whole
        goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        goal = goal.withColumn("left", budget.cast("long") - F.col("epochs") * F.col("source_size"))
        at = goal.filter("left > 0").select("c_source", F.lit("").alias("prefix"), "left")
        for lead in (0, 3):
            at._few = few
            at = durable(_narrow(rows, at, lead, 3).select("c_source", "prefix", "left"), "mix-range")
        inside = rows.join(F.broadcast(at) if few else at, rows["source"].eqNullSafe(at["c_source"]) & F.expr("left(_key, 6) = prefix"))
        ties = inside.groupBy("c_source", "_key", "left").agg(F.sum("_size").alias("n"), F.count_if(F.col("_size") > 0).alias("rows"))
        run = ties.withColumn("upto", F.sum("n").over(W.partitionBy("c_source").orderBy("_key")))
        hit = run.filter("upto >= left").groupBy("c_source").agg(
            F.min("_key").alias("cut"), F.min_by(F.expr("left - (upto - n)"), "_key").alias("over"), F.min_by("rows", "_key").alias("rows"),
        )
        out = goal.join(hit.withColumnRenamed("c_source", "h_source"), F.col("c_source").eqNullSafe(F.col("h_source")), "left")
        out = durable(out.select("c_source", "source_size", "target", "epochs", "cut", F.expr("over div rows").alias("share")), "mix-cuts")
        own.spare(out)
    out._few = few
    return out


def plan(docs: DataFrame, at: DataFrame) -> DataFrame:
    """Keyed ``docs`` with target, source_size and taken (words, repeats counted)."""
    x = docs.join(F.broadcast(at) if at._few else at, docs["source"].eqNullSafe(at["c_source"]), "left")
    again = F.when(F.col("_key") < F.col("cut"), F.col("_size")).when(F.col("_key") == F.col("cut"), F.least("_size", "share")).otherwise(F.lit(0))
    return x.withColumn("taken", (F.col("epochs") * F.col("_size") + again).cast("long")).withColumn("_again", again)


def op2(docs: DataFrame, seed: int = 7) -> DataFrame:
    rows = durable(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", "_size", "_key"), "mix-keys")
    return plan(rows, cuts(rows, seed)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Whole documents, repeated by epochs. The document at a cut joins once more if at least half of it fits."""
    rows = durable(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", "_size", "_key"), "mix-keys")
    at = cuts(rows, seed)
    release(rows)
    x = plan(keyed(packed(docs, "doc_id", "source", "text"), seed), at)
    copies = F.when(F.col("_size") > 0, F.col("epochs") + (2 * F.col("_again") >= F.col("_size")).cast("long")).otherwise(F.lit(0)).cast("int")
    return x.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5(concat_ws(':', '7', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
v AS (
  SELECT *, ((sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level
  FROM r),
c AS (SELECT coalesce((SELECT level FROM v WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), 0) AS common),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, w * common) AS target FROM v, c),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 1e-6)::BIGINT // source_size ELSE 0 END AS epochs,
         floor(target + 1e-6)::BIGINT AS budget
  FROM t),
p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) - sum(d.size) OVER (PARTITION BY d.source, d.k) AS before,
         sum(d.size) OVER (PARTITION BY d.source, d.k) AS tied,
         count(*) FILTER (d.size > 0) OVER (PARTITION BY d.source, d.k) AS rows_tied
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN rest <= before OR size = 0 THEN 0 WHEN rest > before + tied THEN size
          ELSE least(size, (rest - before) // rows_tied) END)::BIGINT AS taken
FROM p
"""
