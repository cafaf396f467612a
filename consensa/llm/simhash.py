"""SimHash near-duplicate groups by a binary-trie self-join.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its word shingles.
Two fingerprints link at ``budget`` or fewer differing bits, so they agree on one of ``budget + 1``
bit bands at least. Each band gives one forest of binary tries: fingerprints are rotated so that the
band comes first, and the subtree below one band value is a unit of work. Inside a unit, node pairs are
walked together from the root, differing bits are accumulated, and a pair of nodes is dropped as soon as
the budget is exceeded. Units above ``unit_rows`` fingerprints are replaced by their pairs of child
nodes (six bits further down) within the budget until every unit is small, so no task holds an unbounded
group. A unit returns a spanning forest of its links; components follow by alternating large-star and
small-star rounds.

Only distinct fingerprints are joined; copies never meet in pairs.

``near_copies``, the corpus stage, walks the same tries below other roots and then compares texts.

Defined results: null and empty texts have fingerprint zero and link like any other; a very long text is one row of a task, its
shingles counted in runs of 32,768; repeated rows each get a row; null doc_ids count as larger than all others; an empty table gives an empty
result; columns of any name are ignored but for doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, release, scope

SPLIT_BITS = 6


def _majority(text: str | None, words: int, digest, bits: int) -> np.ndarray:
    """The bits (of the digest, highest first) set in over half of the word shingles, lower-cased (A-Z), repeats included."""
    w = text.encode("utf-8", "replace").lower().split() if text else []
    if not w:
        return np.zeros(bits, bool)
    n = max(len(w) - words + 1, 1)
    votes = np.zeros(bits, np.int64)
    for at in range(0, n, 1 << 15):
        part = w[at : at + (1 << 15) + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        raw = np.frombuffer(b"".join(map(digest, grams)), np.uint8).reshape(-1, bits // 8)
        votes += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32)
    return 2 * votes > n


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash, by XXH64 (seed 42)."""
    import xxhash

    return int.from_bytes(np.packbits(_majority(text, words, lambda g: xxhash.xxh64_digest(g, 42), 64)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> F.Column:
    """Column expression: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def udf(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).astype(np.int64))

    return udf(F.col(text))


LEAF = 1024  # pairs of prints below a pair of nodes that are not walked further but compared
AT_ONCE = 250_000  # pairs compared together


def _within(keys: np.ndarray, i: np.ndarray, j: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that differ in ``budget`` bits at most; words are compared one by one, and most pairs fall out on the way."""
    far = np.zeros(len(i), np.int16)
    for word in keys.T:
        far += np.bitwise_count(word[i] ^ word[j])
        ok = far <= budget
        i, j, far = i[ok], j[ok], far[ok]
    return i, j


def trie_pairs(keys: np.ndarray, starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits. ``keys``: rows of 64-bit words, highest first, sorted within each root range.

    ``starts``: rows (lo_a, hi_a, lo_b, hi_b); equal ranges are a self-join.
    """
    lo_a, hi_a, lo_b, hi_b = (starts[:, i].astype(np.int32) for i in range(4))
    diff = np.zeros(len(starts), np.int16)
    left, right = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for level in range(64 * keys.shape[1] + 1):
        # few prints below a pair of nodes: all their bits are counted at once
        wide = hi_b - lo_b
        size = (hi_a - lo_a) * wide.astype(np.int64)
        leaf = (size <= LEAF) | (level == 64 * keys.shape[1])
        if leaf.any():
            ready = (lo_a[leaf], lo_b[leaf], wide[leaf], size[leaf])
            for some in np.split(np.arange(len(ready[0])), np.flatnonzero(np.diff(np.cumsum(ready[3]) // AT_ONCE)) + 1):
                a, b, w, n = (x[some] for x in ready)
                at = np.arange(n.sum(), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
                row, column = np.divmod(at, np.repeat(w, n))
                i, j = np.repeat(a, n) + row, np.repeat(b, n) + column
                once = (i < j) | np.repeat(a != b, n)  # a node meets itself: each pair once
                i, j = _within(keys, i[once], j[once], budget)
                left.append(i)
                right.append(j)
            lo_a, hi_a, lo_b, hi_b, diff = (x[~leaf] for x in (lo_a, hi_a, lo_b, hi_b, diff))
        if not len(lo_a):
            break
        word, bit = keys[:, level // 64], np.uint64(63 - level % 64)
        ones = np.concatenate(([0], np.cumsum((word >> bit) & np.uint64(1)))).astype(np.int32)
        mid_a, mid_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        same = lo_a == lo_b
        nxt = [
            (lo_a, mid_a, lo_b, mid_b, diff),
            (mid_a, hi_a, mid_b, hi_b, diff),
            (lo_a, mid_a, mid_b, hi_b, diff + 1),
            tuple(x[~same] for x in (mid_a, hi_a, lo_b, mid_b, diff + 1)),
        ]
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate([x[k] for x in nxt]) for k in range(5))
        keep = (diff <= budget) & (hi_a > lo_a) & (hi_b > lo_b) & ~((lo_a == lo_b) & (hi_a - lo_a == 1))
        lo_a, hi_a, lo_b, hi_b, diff = (x[keep] for x in (lo_a, hi_a, lo_b, hi_b, diff))
    return np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all() and (label[i] == label[j]).all():
            break
    return label


PAIRS = 1_000_000  # pairs of leaves that one walk can meet at most, but for a single unit


def _walk(budget: int, key: str):
    """Whole units (unit, side, ``key``, fp; sorted so) in, spanning links (u, v) of prints ``fp`` out."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, side, fp = t["unit"].combine_chunks(), t["side"].to_numpy(), t["fp"].combine_chunks()
        if pa.types.is_binary(t[key].type):
            keys = np.frombuffer(b"".join(t[key].to_pylist()), ">u8").astype(np.uint64).reshape(len(fp), -1)
        else:
            keys = t[key].to_numpy().astype(np.uint64)[:, None]
        lo = np.flatnonzero(np.concatenate(([True], _differs(unit))))
        hi = np.append(lo[1:], len(fp))
        cross = t["cross"].to_numpy()[lo]
        ones = np.concatenate(([0], np.cumsum(side)))
        mid = hi - (ones[hi] - ones[lo])
        # the walk starts above the unit's bits and counts those in which its two sides differ
        starts = np.stack([lo, np.where(cross, mid, hi), np.where(cross, mid, lo), hi], 1)
        use = np.where(cross, (mid > lo) & (hi > mid), hi - lo > 1)
        work = np.where(cross, (mid - lo) * (hi - mid), (hi - lo) ** 2 // 2)[use].cumsum()
        starts = starts[use].astype(np.int64)
        for some in np.split(starts, np.flatnonzero(np.diff(work // PAIRS)) + 1):
            if len(some):
                i, j = trie_pairs(keys, some, budget)
                base = int(some[0, 0])
                label = forest(int(some[-1, 3]) - base, i - base, j - base) + base
                at = np.flatnonzero(label != np.arange(base, base + len(label))) + base
                if len(at):
                    yield pa.RecordBatch.from_arrays([fp.take(pa.array(at)), fp.take(pa.array(label[at - base]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                t = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(np.concatenate(([True], _differs(t["unit"].combine_chunks()))))[-1])
                if cut:
                    yield from solve(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    rows = t.num_rows - cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    return pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _units(prints: DataFrame, budget: int) -> DataFrame:
    """Rows (unit, band, side, cross, diff, rot, fp): each fingerprint once in every band's forest."""
    bands = budget + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    rows = []
    for b in range(bands):
        off, width = edges[b], edges[b + 1] - edges[b]
        rot = F.col("fp") if off == 0 else F.shiftleft("fp", off).bitwiseOR(F.shiftrightunsigned("fp", 64 - off))
        rows.append(F.struct(F.lit(b).alias("band"), F.lit(width).alias("width"), rot.alias("rot")))
    return prints.select("fp", F.explode(F.array(*rows)).alias("r")).select(
        F.concat_ws(":", F.col("r.band").cast("string"), F.hex(F.expr("shiftrightunsigned(r.rot, 64 - r.width)"))).alias("unit"),
        F.col("r.width").alias("used"), F.lit(0).alias("side"), F.lit(False).alias("cross"), F.lit(0).alias("diff"), F.col("r.rot").alias("rot"), "fp",
    )


def _children(units: DataFrame, budget: int) -> DataFrame:
    """Replace units by their pairs of child nodes, ``SPLIT_BITS`` further down, within the budget."""
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
    bits = F.expr(f"least({SPLIT_BITS}, 64 - used)")
    # the child's bits, as a number of SPLIT_BITS bits (shorter at the leaves)
    child = F.expr(f"cast(shiftrightunsigned(shiftleft(rot, used), 64 - least({SPLIT_BITS}, 64 - used)) as int)")
    x = (
        units.withColumn("bits", bits).withColumn("c", child)
        .withColumn("m", F.explode(F.array(*map(F.lit, masks))))
        .filter(F.expr(f"m < shiftleft(1, bits) and diff + bit_count(m) <= {budget}"))
        .withColumn("o", F.col("c").bitwiseXOR(F.col("m")))
    )
    own = F.expr("cross and side = 1")  # in a cross unit, sides stay; in a self unit, the smaller child is side 0
    first = F.when(own, F.col("o")).when(F.col("cross"), F.col("c")).otherwise(F.least("c", "o"))
    second = F.when(own, F.col("c")).when(F.col("cross"), F.col("o")).otherwise(F.greatest("c", "o"))
    side = F.when(F.col("cross"), F.col("side")).otherwise((F.col("c") > F.col("o")).cast("int"))
    return x.select(
        F.concat_ws("/", "unit", first.cast("string"), second.cast("string")).alias("unit"),
        (F.col("used") + F.col("bits")).alias("used"), side.alias("side"), (F.col("cross") | (F.col("m") != 0)).alias("cross"),
        (F.col("diff") + F.expr("cast(bit_count(m) as int)")).alias("diff"), "rot", "fp",
    )


def links(prints: DataFrame, budget: int = 2, unit_rows: int = 2048) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints ``fp`` at ``budget`` or fewer differing bits."""
    units, ready = _units(prints, budget), []
    for _ in range(64 // SPLIT_BITS + 1):
        hot = durable(units.groupBy("unit").count().filter(F.col("count") > unit_rows).select("unit"), "simhash-hot")
        if hot.isEmpty():
            break
        splittable = F.col("used") < 64
        ready.append(units.join(hot, "unit", "left_anti"))
        big = units.join(hot, "unit", "left_semi")
        ready.append(big.filter(~splittable))
        units = _children(big.filter(splittable), budget)
    ready.append(units)
    work = ready[0]
    for x in ready[1:]:
        work = work.unionByName(x)
    # unsigned order of rot: the sign bit is flipped for the sort
    work = work.select("unit", "side", "cross", "diff", "rot", "fp", F.expr("rot ^ (-9223372036854775807L - 1L)").alias("o"))
    return (
        work.repartition("unit").sortWithinPartitions("unit", "side", "o").drop("o")
        .mapInArrow(_walk(budget, "rot"), "u long, v long")
    )


ROUND_ROWS = 200_000  # links of a file that a component round writes


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) but the roots; root: the smallest node reachable.

    Alternating large-star and small-star rounds; each round is written to the shared folder.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    cur = durable(edges.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "cc")
    files = max(12, cur.count() // ROUND_ROWS)
    put = lambda df, name: durable(df.coalesce(files), name)
    last = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a join's side is a plain table and the rows of a hub can be split
        mins = put(both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m")), "cc-least")
        large = both.join(mins, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = put(large.select(high.alias("u"), low.alias("v")), "cc-large")
        lows = put(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(lows, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        nxt = put(small.filter("u <> v").distinct(), "cc")
        got = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(cur, mins, large, lows)
        cur = nxt
        if tuple(got) == last:
            return cur.select("u", F.col("v").alias("root"))
        last = tuple(got)


def _labels(prints: DataFrame, stars: DataFrame) -> DataFrame:
    """(fp, label) of prints that more than one document or link has, from one row a print (fp, rep, n) and links to roots."""
    member = stars.unionByName(stars.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "fp")
    least = durable(member.join(prints, "fp").groupBy("root").agg(F.min("rep").alias("least")), "simhash-least")
    found = member.join(_few(least), "root").select("fp", "least")
    # a document alone in its group needs no label; of the rest, a small table is sent whole, so copies stay where they are
    return durable(prints.filter("n > 1").join(found, "fp", "outer").select("fp", F.coalesce("least", "rep").alias("label")), "simhash-labels")


FEW_ROWS = 500_000  # of about 100 bytes each, hashed


def _few(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if it has few rows: what it is joined to stays where it is, copies and hubs too."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def _prints(marked: DataFrame) -> DataFrame:
    return marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, budget: int = 2, words: int = 3, unit_rows: int = 2048) -> DataFrame:
    """Per document: doc_id, fp (long), component_id (smallest doc_id reachable over links)."""
    with scope(docs.sparkSession) as own:
        marked = durable(docs.select("doc_id", fingerprints(docs, words).alias("fp")), "simhash-prints")
        prints = _prints(marked)
        label = _labels(prints, components(links(prints.select("fp"), budget, unit_rows)))
        own.spare(marked, label)
    return marked.join(_few(label), "fp", "left").select("doc_id", "fp", F.coalesce("label", "doc_id").alias("component_id"))


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
