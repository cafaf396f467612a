"""Removal of long repeated byte strings by bucket-pointer refinement of sparse suffix buckets.

A byte goes if a string of ``LENGTH`` (200) bytes that covers it starts anywhere else too. Suffixes lie in buckets by
the q-gram at their offset; a bucket is refined by sorting its members on the bucket identifiers of a later offset, and the
identifiers so found are those that the next depth is refined by.

Over the whole corpus nothing is sorted; suffixes are dealt to coarse buckets, and only those that can still be equal are refined:
1. Every start of a 200-byte string points to the least 32-gram (leftmost of equals) among its 169 offsets.
   Equal strings point to equal buckets at equal distances. Consecutive starts with one pointer are a segment.
2. Segments are grouped by pointed bucket, and by a name of the whole segment (64 bits of a mixing function beside the 64 of the
   bucket). A segment found twice is repeated throughout. A bucket with one kind of segment is done; all others hold open segments.
3. Open segments (one of each kind) travel with their bytes to their bucket and are refined there, exactly (``refined``): 8-gram
   buckets become buckets of 16, 32, 64 and 128 bytes by pairs of identifiers half as deep, and the last sort, on the
   128-byte identifiers at offsets 0 and 72, leaves the starts that agree in all 200 bytes together. A bucket with more than
   ``BUCKET`` kinds of segment (a passage in very many surroundings) sends the names of its starts instead, which are counted one by one.
Texts that occur twice as a whole and have 200 bytes go entirely.

Row counts: one row in about 85 bytes in step 2, one row with about 300 bytes for each kind of open segment in step 3
(these lie at the ends of repeated passages). Counting is by partial aggregates (least and greatest place of a
name), so a passage that millions of documents share costs no task more than its own documents.

Defined results: null text is empty; texts under 200 bytes keep everything unless step 2 cannot apply (they have
no 200-byte string); repeated rows count as other places; an empty table gives an empty result. Two different segments are
taken for equal if bucket and name, 128 bits, both agree; step 3 compares bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release, scope

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
PIECE = 1 << 17
BUCKET = 8_000  # open segments (of at most 368 bytes) that one task refines together
SMALL = 128_000_000  # bytes as a hashed relation: a table up to this size is broadcast, a larger one is joined by key
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a pair of names, order kept."""
    h = b * _C1
    h ^= h >> np.uint64(32)
    h += a
    h *= _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    return h


def names32(raw: bytes) -> np.ndarray:
    """32-buckets of every offset that has 32 bytes."""
    n8 = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)) * _C3
    n8 ^= n8 >> np.uint64(31)
    n16 = _pair(n8[:-8], n8[8:])
    return _pair(n16[:-16], n16[16:])


def names200(n32: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the 200 bytes at offsets ``at``."""
    n128 = lambda p: _pair(_pair(n32[p], n32[p + 32]), _pair(n32[p + 64], n32[p + 96]))
    return _pair(n128(at), n128(at + 72))


def pieces(raw: bytes):
    """(offset, part): parts overlap by 199 bytes, so every 200-byte string lies in exactly one, counted by its start."""
    for at in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
        yield at, raw[at : at + PIECE + LENGTH - 1]


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, by block-wise running minima."""
    n = len(key)
    pad = -n % span
    x = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], ahead[span - 1 : n])


def segments(texts: list[bytes]):
    """(text index, start, stop, bucket, name) arrays; start to stop: the 200-byte strings' starts."""
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        raw = b"".join(p for _, _, p in group)
        n32 = names32(raw)
        mask = np.uint64((1 << 21) - 1)
        key = (n32 & ~mask) | np.arange(len(n32), dtype=np.uint64)
        lens = np.array([len(p) for _, _, p in group])
        begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
        number = lens - LENGTH + 1
        part = np.repeat(np.arange(len(group)), number)
        p = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + begin[part]
        a = (_least(key, SPAN)[p] & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]))))
        last = np.append(first[1:], len(a)) - 1
        s, e, w, g = p[first], p[last], a[first], part[first]
        shape = ((e - s).astype(np.uint64) << np.uint64(16)) | (w - s).astype(np.uint64)
        name = _pair(_pair(names200(n32, s), names200(n32, e)), shape * _C1)
        base = np.array([at for _, at, _ in group])[g] - begin[g]
        return np.array([i for i, _, _ in group])[g], s + base, e + 1 + base, n32[w].view(np.int64), name.view(np.int64)

    for i, raw in enumerate(texts):
        for at, part in pieces(raw):
            if size + len(part) > 2 * PIECE and group:
                yield flush()
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield flush()


def _raw(b: pa.RecordBatch) -> list[bytes]:
    column = b["text"]
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"))


def _segment_rows(keyed: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            k1, k2, ids = b["k1"].to_numpy(), b["k2"].to_numpy(), b["doc_id"]
            for i, s, e, bucket, name in segments(_raw(b)):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i)), *(pa.array(x) for x in (k1[i], k2[i], s, e, bucket, name))],
                    names=["doc_id", "k1", "k2", "start", "stop", "bucket", "name"],
                )

    kind = f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, start long, stop long, bucket long, name long"
    return keyed.select("doc_id", "k1", "k2", "text").mapInArrow(run, kind).withColumn("place", F.xxhash64("k1", "k2", "start"))


def _small(df: DataFrame, row_bytes: int, column: str | None = None) -> DataFrame:
    """``df``, marked for broadcast if its checked size allows."""
    n = df.count() if column is None else df.agg(F.count("*") + F.sum(F.size(column)) / 2).first()[0] or 0
    return F.broadcast(df) if n * row_bytes <= SMALL else df


def _open_rows(docs: DataFrame) -> DataFrame:
    """Rows (bucket, k1, k2, start, bytes) of the open segments in small buckets."""

    def run(batches):
        for b in batches:
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            for i, (text, open_) in enumerate(zip(b["text"], b["open"])):
                raw = text.as_py().encode()
                rows = [(x["bucket"], x["start"], raw[x["start"] : x["stop"] + LENGTH - 1]) for x in open_.as_py()]
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(n, k1[i])), pa.array(np.full(n, k2[i])),
                            pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())
                        ],
                        names=["bucket", "k1", "k2", "start", "raw"],
                    )

    return docs.select("k1", "k2", "text", "open").mapInArrow(run, "bucket long, k1 long, k2 long, start int, raw binary")


def _buckets(key: np.ndarray) -> np.ndarray:
    """Bucket identifiers: the ranks of the sorted keys."""
    return np.unique(key, return_inverse=True)[1].astype(np.uint64)


def refined(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the 200 bytes at ``starts``; suffixes alone in their bucket are sorted no further."""
    ids = _buckets(np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)))
    depth = 8
    while depth < 128:
        here, later = ids[:-depth], ids[depth:]
        open_ = np.bincount(here.astype(np.int64))[here.astype(np.int64)] > 1
        new = np.empty(len(here), np.uint64)
        new[open_] = _buckets(here[open_] * np.uint64(len(ids)) + later[open_])
        new[~open_] = np.arange(open_.sum(), len(here), dtype=np.uint64)  # identifiers of their own
        ids, depth = new, 2 * depth
    return _buckets(ids[starts] * np.uint64(len(ids)) + ids[starts + LENGTH - depth])


def _refine(batches):
    """Whole buckets in, (k1, k2, start, stop) of runs of repeated starts out."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        k1, k2, start = (t[c].to_numpy() for c in ("k1", "k2", "start"))
        parts, seen = t["raw"].to_pylist(), set()
        use = [i for i, key in enumerate(zip(k1.tolist(), k2.tolist(), start.tolist())) if not (key in seen or seen.add(key))]
        lens = np.array([len(parts[i]) for i in use])
        number = lens - LENGTH + 1
        first_of = np.cumsum(number) - number
        begin = np.repeat(np.cumsum(lens) - lens - first_of, number)
        ids = refined(b"".join(parts[i] for i in use), np.arange(number.sum()) + begin).astype(np.int64)
        hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
        if not len(hit):
            return None
        row = np.searchsorted(first_of, hit, side="right") - 1
        within = hit - first_of[row]
        new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(row) != 0)))
        first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        at = np.array(use)[row[new]]
        begin = start[at] + within[new]
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[at]), pa.array(k2[at]), pa.array(begin.astype(np.int32)), pa.array((begin + last - first + 1).astype(np.int32))],
            names=["k1", "k2", "start", "stop"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= 1 << 20:
            t = pa.Table.from_batches(held)
            bucket = t["bucket"].to_numpy()
            cut = int(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[-1])
            if cut:
                out = solve(t.slice(0, cut))
                if out is not None:
                    yield out
                held = t.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
    if held:
        out = solve(pa.Table.from_batches(held))
        if out is not None:
            yield out


def _windows(docs: DataFrame) -> DataFrame:
    """Rows (bucket, w, k1, k2, at) of the starts of open segments in large buckets."""

    def run(batches):
        for b in batches:
            k1, k2, wide = b["k1"].to_numpy(), b["k2"].to_numpy(), b["wide"].to_pylist()
            for i, raw in enumerate(_raw(b)):
                starts, bucket = (np.concatenate(x) for x in zip(*((
                    np.arange(x["start"], x["stop"]), np.full(x["stop"] - x["start"], x["bucket"]),
                ) for x in wide[i])))
                for at, part in pieces(raw):
                    here = (starts >= at) & (starts < at + PIECE)  # segments of a text do not overlap
                    p = starts[here]
                    if len(p):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(bucket[here]), pa.array(names200(names32(part), p - at).view(np.int64)),
                                pa.array(np.full(len(p), k1[i])), pa.array(np.full(len(p), k2[i])), pa.array(p.astype(np.int32)),
                            ],
                            names=["bucket", "w", "k1", "k2", "at"],
                        )

    return docs.select("k1", "k2", "text", "wide").mapInArrow(run, "bucket long, w long, k1 long, k2 long, at int")


def _join_spans(batches):
    """``full``: starts become byte ranges, and neighbours that touch become one."""
    for b in batches:
        if not b.num_rows:
            continue
        spans = pc.list_flatten(b["full"])
        row = pc.list_parent_indices(b["full"]).to_numpy()
        start, stop = (spans.field(i).to_numpy() for i in range(2))
        order = np.lexsort((start, row))
        row, start, stop = row[order], start[order], stop[order] + LENGTH - 1  # stops rise with starts in a text
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > stop[:-1])))) if len(row) else np.empty(0, int)
        last = np.append(new[1:] - 1, len(row) - 1)[: len(new)]
        offsets = np.searchsorted(row[new], np.arange(b.num_rows + 1)).astype(np.int32)
        joined = pa.StructArray.from_arrays([pa.array(start[new].astype(np.int32)), pa.array(stop[last].astype(np.int32))], names=["start", "stop"])
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(offsets), joined) if c == "full" else b[c] for c in b.schema.names], names=b.schema.names
        )


def repeated(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(k1, k2, spans array<struct<start, stop>>): byte ranges to remove, by text."""
    keyed = _keyed(docs)
    texts = keyed.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("c"), F.max(F.octet_length("text")).alias("n"))
    texts = durable(texts, "suffix-texts")
    again = not texts.filter("c > 1").isEmpty()
    place = [F.min("place").alias("low"), F.max("place").alias("high")]
    every = _segment_rows(keyed).groupBy("bucket", "name").agg(*place).select("bucket", "name", "low", (F.col("low") != F.col("high")).alias("full"))
    every = durable(every, "suffix-names")
    # counted by partial aggregates and joined from tables, so a join's hot bucket can be split
    sizes = durable(every.groupBy("bucket").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-sizes")
    kinds = every.join(_small(sizes, 48), "bucket", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    kinds = durable(kinds.filter("full or kinds > 1").select("bucket", "name", "full", "kinds", "low"), "suffix-kinds")
    release(every)
    release(sizes)
    # one long as the key makes a table in a third of the memory; buckets are compared beside it
    kinds = _small(kinds.withColumnRenamed("bucket", "its"), 80)
    rows = _segment_rows(keyed).join(kinds, "name").filter("(bucket ^ its) = 0").drop("its")
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    asked = (F.col("kinds") > 1) & (F.col("place") == F.col("low"))
    with_bucket = F.struct("bucket", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    marked = rows.filter(F.col("full") | asked).groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.collect_set(F.when(F.col("full"), span)).alias("full"),  # at most the text's own segments
        F.collect_set(F.when(asked & (F.col("kinds") <= bucket), with_bucket)).alias("open"), F.collect_set(F.when(asked & (F.col("kinds") > bucket), with_bucket)).alias("wide"))
    marked = durable(marked.mapInArrow(_join_spans, marked.schema), "suffix-marked")

    def asking(column: str) -> DataFrame:
        """Texts with segments in ``column``, from one row of each text."""
        some = marked.filter(F.size(column) > 0).select("k1", "k2", "rep", column)
        rows = keyed.join(_small(some, 64, column), ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("rep")))
        return rows.dropDuplicates(["k1", "k2"]) if again else rows  # rows that are repeated whole

    found = _open_rows(asking("open")).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine, "k1 long, k2 long, start int, stop int")
    parts = found
    if not marked.filter(F.size("wide") > 0).isEmpty():
        windows = durable(_windows(asking("wide")), "suffix-windows")
        twice = windows.withColumn("place", F.xxhash64("k1", "k2", "at")).groupBy("bucket", "w").agg(*place).filter("low <> high").select("bucket", "w")
        parts = parts.unionByName(windows.join(durable(twice, "suffix-twice"), ["bucket", "w"]).select(
            "k1", "k2", F.col("at").alias("start"), F.expr("at + 1").alias("stop"),
        ).distinct())
    copies = texts.groupBy("k1", "k2").agg(F.sum("c").alias("c"), F.max("n").alias("n")).filter(f"c > 1 and n >= {LENGTH}")
    parts = parts.select("k1", "k2", "start", (F.col("stop") + LENGTH - 1).alias("stop"))
    parts = parts.unionByName(marked.select("k1", "k2", F.explode("full").alias("s")).select("k1", "k2", "s.start", "s.stop"))
    parts = parts.unionByName(copies.select("k1", "k2", F.lit(0).alias("start"), F.col("n").alias("stop")))
    return parts.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def strip(raw: bytes, spans) -> tuple[bytes, int]:
    """(what is left, number of maximal removed runs)."""
    if spans is None or not len(spans):
        return raw, 0
    kept, at, runs = [], 0, 0
    until = -1
    for s, e in sorted((x["start"], x["stop"]) for x in spans):
        if s > until:
            runs += 1
            kept.append(raw[at:s])
        until = max(until, e)
        at = max(at, e)
    kept.append(raw[at:])
    return b"".join(kept), runs


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (bytes) and its digest."""
    with scope(docs.sparkSession) as own:
        spans = durable(repeated(docs), "suffix-spans")
        own.spare(spans)

    def run(batches):
        for b in batches:
            rows = [(len(raw), *strip(raw, s)) for raw, s in zip(_raw(b), b["spans"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([n for n, _, _ in rows], pa.int64()), pa.array([n - len(k) for n, k, _ in rows], pa.int64()), pa.array([r for _, _, r in rows], pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in rows]), pa.array([k for _, k, _ in rows], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    x = _keyed(docs).join(_small(spans, 64, "spans"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return x.mapInArrow(run, kind)


def op10(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).drop("kept")
