"""One document of each group of near copies stays: SimHash tries propose, texts decide.

Two texts are near copies if their sets of five-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or more. Texts are taken
by their smallest doc_id; a text goes if and only if one that stays is similar to it, so chains of similar texts remove nothing unlike.

1. Rows with the same text are one text. Each text gets a SimHash print of 256 bits over its set of shingles, and ``BANDS`` minhash bands.
2. A band's value is the root of a binary trie of the prints below it, so each text stands in ``BANDS`` tries whatever the size of the corpus. A pair at
   similarity 0.8 shares none of the roots with probability 0.002.
3. Roots with more than ``unit_rows`` texts are peeled: a text that is the smallest below all its roots is surely kept, and every text below
   one of these roots is compared with it. A large group of near copies is gone after one round, with one comparison a text.
4. The tries are joined with themselves as in ``simhash`` (64 of 256 bits may differ; at 0.8 about 39 do, with a deviation of 6). Roots that are still
   large are dealt into parts, and each pair of parts is walked by itself. Spanning links give components: groups in which near copies must lie.
5. Inside a group texts are compared exactly, each with those before it that stay. Groups of more than ``group_bytes`` of text are worked off in
   blocks: a block is settled, then all other texts of the group are compared with what the block keeps, in as many tasks as they ask for.

Defined results: doc_ids are whole numbers; a null text is an empty one, and all texts without a word are alike; texts of fewer than five words are one shingle; a very long
text is one row of a task; rows without a doc_id all stay and are compared with none; rows that are repeated whole leave one; an
empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, scope
from .simhash import _few, _walk, components

BITS, WORDS, NEAR, SPARE_BITS = 256, 5, 0.8, 64
BANDS, BAND_ROWS = 12, 4
PEELS = 4  # rounds of peeling at most; what is large after them is dealt into parts
_ODD = np.random.default_rng(42).integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(43).integers(1, 1 << 63, BITS // 64, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text's word shingles, as sorted 64-bit digests."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(w) - words + 1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of ``shingles``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signature(text: str | None, words: int = WORDS) -> tuple[bytes, np.ndarray]:
    """(SimHash print, values of the minhash bands) of the set of shingles."""
    h = shingles(text, words)
    votes, least = np.zeros(BITS, np.int64), np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None]
        value = x * _ODD
        m = (x ^ _MIX) * np.uint64(0x9E3779B97F4A7C15)
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
        votes += np.unpackbits(np.ascontiguousarray(m).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (value ^ (value >> np.uint64(31))).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    band = np.arange(BANDS, dtype=np.uint64)
    for column in rows.T:
        band = (band ^ column) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(32)
    return np.packbits(2 * votes > len(h)).tobytes(), band.astype(np.int64)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, tid, bytes, print, bands) of each row with a doc_id; tid names the text."""

    @F.pandas_udf("print binary, bands array<long>")
    def udf(texts):
        import pandas as pd

        return pd.DataFrame([(p, b) for p, b in (signature(t, words) for t in texts)], columns=["print", "bands"])

    text = F.coalesce("text", F.lit(""))
    x = docs.filter("doc_id is not null").select("doc_id", tid(text).alias("tid"), F.octet_length(text).alias("bytes"), udf("text").alias("s"))
    return x.select("doc_id", "tid", "bytes", "s.print", "s.bands")


def tid(text: F.Column) -> F.Column:
    """A text's name: 128 bits."""
    return F.unhex(F.md5(text))


def distinct_texts(marked: DataFrame) -> DataFrame:
    """(tid, rep, copies, repeated, bytes, print, bands): rep is the smallest doc_id; repeated: rows of that doc_id."""
    firsts = [F.first(c).alias(c) for c in ("bytes", "print", "bands")]
    by_id = marked.groupBy("tid", "doc_id").agg(F.count("*").alias("n"), *firsts)
    return by_id.groupBy("tid").agg(F.min("doc_id").alias("rep"), F.sum("n").alias("copies"), F.min_by("n", "doc_id").alias("repeated"), *firsts)


# texts against texts ---------------------------------------------------------------------------------
class Kept:
    """The sets of a group that stay. Two sets at ``near`` or more share one of their first shingles, so only these are looked up."""

    def __init__(self, near: float):
        self.near, self.names, self.sets, self.at = near, [], [], {}

    def first(self, s: np.ndarray) -> list[int]:
        return s[: len(s) - math.ceil(self.near * len(s) - 1e-9) + 1].tolist()

    def add(self, name: bytes, s: np.ndarray) -> None:
        for x in self.first(s):
            self.at.setdefault(x, []).append(len(self.sets))
        self.names.append(name)
        self.sets.append(s)

    def similar(self, s: np.ndarray) -> bytes | None:
        """The first that is similar to ``s``."""
        for i in sorted({i for x in self.first(s) for i in self.at.get(x, ())}):
            if similarity(s, self.sets[i]) >= self.near:
                return self.names[i]
        return None


def _compare(near: float, words: int, grow: bool):
    """Groups (unit, part) sorted by side, rep, tid in; (tid, by) of the texts of side 1 that are similar to one before them out.

    Texts of side 0 stay. With ``grow`` a text of side 1 that is similar to none stays as well and meets all that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = kept = None
        for b in batches:
            gone, by = [], []
            for unit, part, side, name, text in zip(*(b[c].to_pylist() for c in ("unit", "part", "side", "tid", "text"))):
                if (unit, part) != now:
                    now, last, kept = (unit, part), None, Kept(near)
                if name == last:
                    continue  # a row that is repeated whole
                last, s = name, shingles(text, words)
                hit = kept.similar(s) if side else None
                if hit is not None:
                    gone.append(name)
                    by.append(hit)
                elif grow or not side:
                    kept.add(name, s)
            if gone:
                yield pa.RecordBatch.from_arrays([pa.array(gone, pa.binary()), pa.array(by, pa.binary())], names=["tid", "by"])

    return run


def compared(docs: DataFrame, rows: DataFrame, near: float, words: int, grow: bool) -> DataFrame:
    """``_compare`` over rows (unit binary, part, side, rep, tid) with the texts of ``docs``."""
    named = docs.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), tid(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    x = named.join(_few(rows), ["rep", "tid"]).select("unit", "part", "side", "rep", "tid", "text")
    x = x.repartition("unit", "part").sortWithinPartitions("unit", "part", "side", "rep", "tid")
    return x.mapInArrow(_compare(near, words, grow), "tid binary, by binary").dropDuplicates(["tid"])


def _parts(rows: DataFrame, leaders: DataFrame, part_bytes: int) -> DataFrame:
    """Rows for ``compared``: ``rows`` (unit, rep, tid, bytes) dealt into parts of about ``part_bytes``, each beside its unit's ``leaders`` (unit, rep, tid)."""
    size = rows.groupBy("unit").agg(F.sum("bytes").alias("total")).select("unit", F.ceil(F.col("total") / part_bytes + F.lit(0.001)).cast("int").alias("parts"))
    dealt = rows.join(_few(size), "unit").select("unit", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "rep", "tid")
    heads = leaders.join(_few(size), "unit").select("unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "rep", "tid")
    return heads.unionByName(dealt)


# large roots -----------------------------------------------------------------------------------------
def peeled(docs: DataFrame, texts: DataFrame, unit_rows: int, near: float, words: int, part_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows (unit, rep, tid, bytes, print) left below the roots, tables (tid, by) of texts that go)."""
    units = texts.select(F.posexplode("bands").alias("band", "value"), "rep", "tid", "bytes", "print")
    units = units.select(F.xxhash64("band", "value").alias("unit"), "rep", "tid", "bytes", "print")
    gone: list[DataFrame] = []
    for _ in range(PEELS):
        if units.groupBy("unit").count().filter(F.col("count") > unit_rows).isEmpty():
            break
        own = F.struct("rep", "tid")
        least = durable(units.groupBy("unit").agg(F.min(own).alias("least"), F.count("*").alias("n")), "near-least")
        beside = units.join(least, "unit").withColumn("first", F.col("least") == own)
        heads = durable(beside.groupBy("tid", "rep").agg(F.min("first").alias("head")).filter("head").select("tid", "rep"), "near-heads")
        # one comparison for each text and head, however many roots they share
        pairs = beside.filter("not first and n > 1").select(F.col("least.tid").alias("unit"), "rep", "tid", "bytes").distinct()
        pairs = durable(pairs.join(_few(heads.select(F.col("tid").alias("unit"))), "unit", "left_semi"), "near-pairs")
        leaders = heads.select(F.col("tid").alias("unit"), "rep", "tid")
        found = durable(compared(docs, _parts(pairs, leaders, part_bytes), near, words, False), "near-peeled")
        gone.append(found)
        units = durable(units.join(_few(found.select("tid").unionByName(heads.select("tid"))), "tid", "left_anti"), "near-units")
    return units, gone


# candidates ------------------------------------------------------------------------------------------
def candidate_links(units: DataFrame, budget: int = SPARE_BITS, unit_rows: int = 1536) -> DataFrame:
    """Spanning links (u, v) of texts below one root whose prints differ in ``budget`` bits at most."""
    sizes = durable(units.groupBy("unit").agg(F.count("*").alias("n")).filter("n > 1"), "near-sizes")
    x = units.join(_few(sizes), "unit")
    # every pair of a large root's parts is walked by itself
    parts = F.ceil(F.col("n") / unit_rows).cast("int")
    x = x.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = F.least("part", "other"), F.greatest("part", "other")
    x = x.select(F.xxhash64("unit", a, b).alias("unit"), (F.col("part") > F.col("other")).cast("int").alias("side"), (a != b).alias("cross"), "print", F.col("tid").alias("fp"))
    return x.repartition("unit").sortWithinPartitions("unit", "side", "print").mapInArrow(_walk(budget, "print"), "u binary, v binary")


# groups ----------------------------------------------------------------------------------------------
def settled(docs: DataFrame, members: DataFrame, near: float, words: int, group_bytes: int) -> list[DataFrame]:
    """Tables (tid, by) of the texts that go, from the groups ``members`` (unit, rep, tid, bytes)."""
    one = lambda x: x.select("unit", F.lit(0).alias("part"), F.lit(1).alias("side"), "rep", "tid")
    gone: list[DataFrame] = []
    while True:
        sizes = durable(members.groupBy("unit").agg(F.sum("bytes").alias("total")), "near-totals")
        large = sizes.filter(F.col("total") > group_bytes)
        small = members.join(_few(large), "unit", "left_anti")
        gone.append(durable(compared(docs, one(small), near, words, True), "near-settled"))
        if large.isEmpty():
            return gone
        rest = durable(members.join(_few(large.select("unit", "total")), "unit"), "near-large")
        # the first texts by order, about a quarter of what a task may hold: cut by counts over ranges of rep, not by a sort of the group
        lead = durable(_leading(rest, group_bytes // 4), "near-block")
        found = durable(compared(docs, one(lead), near, words, True), "near-block-gone")
        stay = durable(lead.join(_few(found), "tid", "left_anti").select("unit", "rep", "tid"), "near-block-kept")
        others = rest.join(_few(lead.select("tid")), "tid", "left_anti").select("unit", "rep", "tid", "bytes")
        others = durable(others, "near-others")
        hit = durable(compared(docs, _parts(others, stay, group_bytes // 2), near, words, False), "near-hit")
        gone += [found, hit]
        members = durable(others.join(_few(hit), "tid", "left_anti"), "near-members")


def _leading(rest: DataFrame, block: int, ranges: int = 256) -> DataFrame:
    """The texts (unit, rep, tid, bytes) of each unit that come first, about ``block`` bytes of them, the first text at least."""
    at = rest
    ends = rest.groupBy("unit").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    while True:
        step = F.expr(f"(high - low) div {ranges} + 1")
        x = at.select("unit", "rep", "tid", "bytes").join(_few(ends), "unit").withColumn("cell", F.expr("(rep - low)") / step)
        x = x.withColumn("cell", F.floor("cell").cast("int")).filter(f"cell >= 0 and cell < {ranges}")
        cells = x.groupBy("unit", "low", "high", "cell").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        run = F.expr("array_sort(collect_list(struct(cell, b, n)))")  # ``ranges`` cells at most
        cells = cells.groupBy("unit", "low", "high").agg(run.alias("cells"))
        fit = F.expr(
            f"aggregate(cells, named_struct('b', 0L, 'cell', -1, 'full', false), (a, c) -> if(a.full or a.b + c.b > {block}, "
            "named_struct('b', a.b, 'cell', a.cell, 'full', true), named_struct('b', a.b + c.b, 'cell', c.cell, 'full', false)))"
        )
        cut = durable(cells.select("unit", "low", "high", fit["cell"].alias("cut"), F.expr("cells[0]").alias("head"), step.alias("step")), "near-cut")
        narrow = cut.filter("cut < 0 and head.n > 1 and step > 1")
        if narrow.isEmpty():
            upto = cut.select("unit", F.expr("low + greatest(cut, head.cell) * step + step - 1").alias("upto"))
            return rest.join(_few(upto), "unit").filter("rep <= upto").select("unit", "rep", "tid", "bytes")
        ends = cut.select(
            "unit", F.expr("if(cut < 0 and head.n > 1 and step > 1, low + head.cell * step, low)").alias("low"),
            F.expr("if(cut < 0 and head.n > 1 and step > 1, low + head.cell * step + step - 1, high)").alias("high"),
        )


def near_copies(docs: DataFrame, words: int = WORDS, near: float = NEAR, unit_rows: int = 1536, group_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """(texts as of ``distinct_texts``, (tid, by): the texts that go, each with one that stays and is similar to it)."""
    spark = docs.sparkSession
    with scope(spark) as own:
        marked = durable(signed(docs, words), "near-signed")
        texts = durable(distinct_texts(marked), "near-texts")
        units, gone = peeled(docs, texts, unit_rows, near, words, group_bytes // 2)
        budget = round(BITS * SPARE_BITS / 256)
        stars = components(candidate_links(units.select("unit", "tid", "print"), budget, unit_rows))
        member = stars.unionByName(stars.select(F.col("root").alias("u"), "root").distinct())
        members = durable(member.select(F.col("root").alias("unit"), F.col("u").alias("tid")).join(texts.select("tid", "rep", "bytes"), "tid"), "near-members")
        gone += settled(docs, members, near, words, group_bytes)
        out = gone[0]
        for x in gone[1:]:
            out = out.unionByName(x)
        out = durable(out, "near-gone")
        own.spare(texts, out)
    return texts, out


def keep_one(docs: DataFrame, words: int = WORDS, near: float = NEAR, unit_rows: int = 1536, group_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without exact and near copies: of each text the row with the smallest doc_id, if the text stays."""
    with scope(docs.sparkSession) as own:
        texts, gone = near_copies(docs, words, near, unit_rows, group_bytes)
        marks = texts.select("tid", "rep", "copies", "repeated").join(gone.select("tid", F.lit(True).alias("gone")), "tid", "left")
        marks = durable(marks.filter("gone or copies > 1").drop("copies"), "near-marks")
        own.spare(marks)
    x = packed(docs, "doc_id", tid(F.coalesce("text", F.lit(""))).alias("tid")).join(_few(marks), "tid", "left")
    kept = x.filter("doc_id is null or (gone is null and (rep is null or doc_id = rep))")
    if marks.filter("repeated > 1").isEmpty():
        return kept.select("row.*")
    again = F.coalesce(F.expr("doc_id is not null and repeated > 1"), F.lit(False))
    return kept.filter(~again).select("row.*").unionByName(kept.filter(again).select("row.*").dropDuplicates())
