"""URL filter: host rules, and a ratio of two character language models for the rest.

Two Markov models of order two are learned from accepted and rejected URLs (those that rules judge), whole: scheme, query and
fragment are read like host and path. A character's probability after a context of two characters is smoothed with that after one character, that with
the one after none, and that with the uniform one, by Witten-Bell weights, so the order varies with what has
been seen. A URL's score is the mean log ratio over its characters; the verdict compares it with a cut
calibrated on labelled URLs that the models were not fitted on: the point between the two classes' mean
scores that splits their distance by their deviations.

The alphabet has 47 symbols (46 and one for all other characters), so the model is one array of 103,823 log
ratios (in thousandths), whatever the input: it enters the scoring expression as a constant; URLs are neither
exploded nor shuffled to be scored. Only DataFrame and SQL functions are used.

Defined results: null URLs, and URLs without ``://``, have empty host and path; null and empty URLs score 0, all others by their
characters; where one class has no labelled URL, every score and the cut are 0 and the method allows; a score equal to the cut is
allowed; a very long URL is scored whole, as one row of a task; repeated rows each get a row; an empty table gives an empty result; columns of the same names as those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, scope

# The rules of the contract (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-./:?#=&_%"
N = len(SYMBOLS) + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str = "url") -> tuple[str, str]:
    """SQL of host and path."""
    rest = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    host = f"translate(coalesce(regexp_extract({rest}, '^[^/?#]*', 0), ''), '{UPPER}', '{LOWER}')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    return host, path


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and by_rule (allow, block or null); the longest fitting rule wins."""
    host, path = parts()
    x = pages.withColumn("host", F.expr(host)).withColumn("path", F.expr(path))
    rule, by = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, by = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(by)
    return x.withColumn("rule", rule).withColumn("by_rule", by)


def codes(text: str) -> str:
    """SQL: symbol numbers of a text, two blanks (0) ahead of it."""
    return f"concat(array(0, 0), transform(filter(split(translate({text}, '{UPPER}', '{LOWER}'), ''), c -> c <> ''), c -> instr('{SYMBOLS}', c)))"


def _grams() -> str:
    return f"transform(sequence(1, size(code) - 2), i -> (code[i - 1] * {N} + code[i]) * {N} + code[i + 1])"


def ratios(labelled: DataFrame) -> DataFrame:
    """One row: N^3 log ratios in thousandths, comma-joined in the order of (a * N + b) * N + c, from (code, accepted)."""
    spark = labelled.sparkSession
    grams = labelled.filter("size(code) > 2").select("accepted", F.explode(F.expr(_grams())).alias("g"))
    counts = grams.groupBy("g").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0"))
    grid = spark.range(N**3).withColumnRenamed("id", "g").join(counts.withColumn("g", F.col("g").cast("long")), "g", "left")
    grid = durable(
        grid.select(
            "g", F.expr(f"cast(g div {N * N} as int) a"), F.expr(f"cast(g div {N} % {N} as int) b"), F.expr(f"cast(g % {N} as int) c"),
            F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n0", F.lit(0)).alias("n0"),
        ),
        "url-grams",
    )
    uni, bi, ab = grid.groupBy("c"), grid.groupBy("b", "c"), grid.groupBy("a", "b")
    both = lambda f: [f(k).alias(f.__name__ + k) for k in "10"]

    def N_(k):  # occurrences
        return F.sum("n" + k)

    def T_(k):  # different symbols seen
        return F.count_if(F.col("n" + k) > 0)

    u = uni.agg(*[F.sum("n" + k).alias("n" + k) for k in "10"])
    total = u.agg(*both(N_), *both(T_))
    p0 = u.join(F.broadcast(total), F.lit(True)).select("c", *[F.expr(f"(n{k} + T_{k} / {N}) / nullif(N_{k} + T_{k}, 0) as p0_{k}") for k in "10"])
    b2 = bi.agg(*[F.sum("n" + k).alias("n" + k) for k in "10"])
    m1 = b2.groupBy("b").agg(*both(N_), *both(T_))
    p1 = b2.join(m1, "b").join(p0, "c").select("b", "c", *[F.expr(f"if(N_{k} = 0, p0_{k}, (n{k} + T_{k} * p0_{k}) / (N_{k} + T_{k})) as p1_{k}") for k in "10"])
    m2 = ab.agg(*both(N_), *both(T_))
    p2 = grid.join(m2, ["a", "b"]).join(p1, ["b", "c"]).select(
        "g", *[F.expr(f"if(N_{k} = 0, p1_{k}, (n{k} + T_{k} * p1_{k}) / (N_{k} + T_{k})) as p2_{k}") for k in "10"]
    )
    lr = p2.select(F.struct("g", F.expr("cast(round(1000 * coalesce(ln(p2_1) - ln(p2_0), 0.0)) as int)").alias("r")).alias("x"))
    return lr.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"].cast("string")), ",").alias("lr"))


def fitted(pages: DataFrame) -> tuple[F.Column, float]:
    """(score expression over ``code``, cut), from the URLs that rules judge."""
    seen = judged(pages.select("url")).filter("by_rule is not null")
    seen = seen.select(
        "url", F.expr(codes("url")).alias("code"), (F.col("by_rule") == "allow").alias("accepted"),
        F.expr("instr('048c', left(md5(url), 1)) > 0").alias("apart"),
    )
    with scope(pages.sparkSession):
        model = F.split(F.lit(ratios(seen.filter("not apart")).first()["lr"]), ",").cast("array<int>")  # folded to one constant
    grams = F.expr(f"if(size(code) > 2, {_grams()}, cast(array() as array<int>))")
    score = F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a + F.get(model, g)) / (1000.0 * F.greatest(F.size("code") - 2, F.lit(1)))
    by = {r["accepted"]: r for r in seen.filter("apart").select("accepted", F.round(score, 9).alias("s")).groupBy("accepted").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).collect()}
    if len(by) < 2:
        return F.lit(0.0), 0.0
    up, down = by[True], by[False]
    d1, d0 = max(up["d"], 1e-6), max(down["d"], 1e-6)
    return score, (up["m"] * d0 + down["m"] * d1) / (d0 + d1)


def filter_urls(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule, verdict and _score (null where a rule decides)."""
    score, cut = fitted(pages)
    x = judged(packed(pages, F.col("url"))).withColumn("code", F.expr(codes("coalesce(url, '')")))
    x = x.withColumn("_score", F.when(F.col("by_rule").isNull(), score))
    x = x.withColumn("verdict", F.coalesce("by_rule", F.when(F.col("_score") >= F.lit(cut), "allow").otherwise("block")))
    new = ("host", "path", "rule", "verdict", "_score")
    return x.select(*[F.col(f"row.`{c}`") for c in pages.columns if c not in new], *new)


def op6(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _model_sql() -> str:
    """The same model in plain SQL, grid joins and all."""
    both = lambda f: ", ".join(f(k) for k in "10")
    rule = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    said = " ".join(f"WHEN {rule(h, p)} THEN '{h}{p}'" for h, p, _ in by_length)
    judged_as = " ".join(f"WHEN {rule(h, p)} THEN '{v}'" for h, p, v in by_length)
    sums, seen = both(lambda k: f"sum(n{k}) AS N_{k}"), both(lambda k: f"count(*) FILTER (n{k} > 0) AS T_{k}")
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE {said} END AS rule, CASE {judged_as} END AS by_rule,
  list_concat([0, 0], list_transform(list_filter(string_split(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), ''), lambda c: c <> ''), lambda c: strpos('{SYMBOLS}', c))) AS code FROM h),
k AS (SELECT *, row_number() OVER () AS i, CASE WHEN len(code) > 2 THEN list_transform(range(1, len(code) - 1), lambda x: (code[x] * {N} + code[x + 1]) * {N} + code[x + 2]) ELSE [] END AS grams, strpos('048c', left(md5(url), 1)) > 0 AS apart FROM j),
c AS (SELECT g, count(*) FILTER (by_rule = 'allow') AS n1, count(*) FILTER (by_rule = 'block') AS n0 FROM (SELECT by_rule, unnest(grams) AS g FROM k WHERE by_rule IS NOT NULL AND NOT apart) GROUP BY g),
grid AS (SELECT x.g, x.g // {N * N} AS a, x.g // {N} % {N} AS b, x.g % {N} AS c, coalesce(n1, 0) AS n1, coalesce(n0, 0) AS n0 FROM (SELECT unnest(range({N**3})) AS g) x LEFT JOIN c ON x.g = c.g),
u AS (SELECT c, sum(n1) AS n1, sum(n0) AS n0 FROM grid GROUP BY c), tot AS (SELECT {sums}, {seen} FROM u),
p0 AS (SELECT c, {both(lambda k: f"(n{k} + T_{k} / {N}) / nullif(N_{k} + T_{k}, 0) AS p0_{k}")} FROM u, tot),
b2 AS (SELECT b, c, sum(n1) AS n1, sum(n0) AS n0 FROM grid GROUP BY b, c), m1 AS (SELECT b, {sums}, {seen} FROM b2 GROUP BY b),
p1 AS (SELECT b2.b, b2.c, {both(lambda k: f"CASE WHEN N_{k} = 0 THEN p0_{k} ELSE (n{k} + T_{k} * p0_{k}) / (N_{k} + T_{k}) END AS p1_{k}")} FROM b2 JOIN m1 ON b2.b = m1.b JOIN p0 ON b2.c = p0.c),
m2 AS (SELECT a, b, {sums}, {seen} FROM grid GROUP BY a, b),
p2 AS (SELECT g, {both(lambda k: f"CASE WHEN N_{k} = 0 THEN p1_{k} ELSE (n{k} + T_{k} * p1_{k}) / (N_{k} + T_{k}) END AS p2_{k}")} FROM grid JOIN m2 ON grid.a = m2.a AND grid.b = m2.b JOIN p1 ON grid.b = p1.b AND grid.c = p1.c),
lr AS (SELECT g, round(1000 * coalesce(ln(p2_1) - ln(p2_0), 0))::BIGINT AS r FROM p2),
s AS (SELECT k.i, coalesce(sum(lr.r), 0) / (1000.0::DOUBLE * greatest(any_value(len(code)) - 2, 1)) AS score FROM k LEFT JOIN (SELECT i, unnest(grams) AS g FROM k) e ON k.i = e.i LEFT JOIN lr ON e.g = lr.g GROUP BY k.i),
d AS (SELECT by_rule, avg(round(score, 9)) AS m, greatest(stddev_pop(round(score, 9)), 1e-6) AS d FROM k JOIN s ON k.i = s.i WHERE by_rule IS NOT NULL AND apart GROUP BY by_rule),
cut AS (SELECT (x.m * y.d + y.m * x.d) / (x.d + y.d) AS cut FROM d x, d y WHERE x.by_rule = 'allow' AND y.by_rule = 'block')
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN (SELECT count(*) FROM cut) = 0 OR score >= (SELECT cut FROM cut) THEN 'allow' ELSE 'block' END) AS verdict
FROM k JOIN s ON k.i = s.i
"""


OP6_SQL = _model_sql()
