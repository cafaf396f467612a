"""Spelling variants by deletion keys from rolling hashes.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point parts them, so either one is the other without a
code point, or both are equal without the code point at one place. Prefix and suffix polynomial hashes of a word (modulo 2^64) give the hash of the
word without any of its code points in one addition, for all places and all words of a length at once in NumPy. Keys are parted by their first
bits, sorted, and only keys that two words share go on; there the strings themselves are compared, so a collision of hashes links nothing.

Every near pair meets under exactly one key: of a run of equal code points only the first is left out for insertions, and a replacement's key holds the
place and the length. A key's words differ in one code point, so there are as many as the alphabet has letters at most: no key is hot, and each
word gets one row a key (how many it met, and the best of them) and not one a pair.

Defined results: a null text has no words; a null doc_id counts as an empty one in the deletion rule; repeated rows count each time; a very long run is
one word whose keys are numbers, not strings; ties of counts go to the smaller word by code points; an empty table gives an empty result;
columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .branch_merge import CRC_TABLE, crc_sql
from .common import durable, release, scope
from .simhash import _few

LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
RADIX_BITS = 12
HELD = 200_000  # different words that a task holds before it hands on their counts
CELLS = 1 << 20  # code points that are hashed at once, but for a single longer word
BASE, PLACE, LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
WHOLE, LACKING, REPLACED = 0, 1, 2  # kinds of keys


Change = Callable[[object], Callable[[bytes], str]]


def noisy(doc_id, one_in: int = 199) -> Callable[[bytes], str]:
    """For a document: runs stay, but for one code point where crc32 of ``doc_id:run`` is a multiple of ``one_in``."""
    before = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))

    def change(run: bytes) -> str:
        h, word = zlib.crc32(run, before), run.decode()
        if h % one_in:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def _tally(changes: Change, least: int):
    """Rows (doc_id, text) in, (word, n) out; counts of a task's words are added up before they leave it."""
    import re

    run_of = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)  # a shorter run cannot become a word

    def handed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                lower: Counter = Counter()
                for word, n in Counter(run_of.findall(text or "")).items():
                    lower[word.encode().lower()] += n
                change = changes(doc_id)
                for word, n in lower.items():
                    said = change(word)
                    if len(said) >= least:
                        held[said] += n
            if len(held) > HELD:
                yield handed(held)
                held = Counter()
        if held:
            yield handed(held)

    return run


def counted(docs: DataFrame, changes: Change = noisy, least: int = LEAST_CHARS, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of ``least`` code points and ``often`` occurrences."""
    parts = docs.select("doc_id", "text").mapInArrow(_tally(changes, least), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    """The first bits say as much as the last ones."""
    x = (x ^ np.uint64(0xA0761D6478BD642F * (kind + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))).astype(np.int64)


def deletion_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, hashes without each of its code points) for words of one length: rows of code points."""
    m, n = points.shape
    prefix, suffix = np.zeros((m, n + 1), np.uint64), np.zeros((m, n + 1), np.uint64)
    powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(n)], np.uint64)
    for i in range(n):
        prefix[:, i + 1] = prefix[:, i] * BASE + points[:, i]
    for i in range(n - 1, -1, -1):
        suffix[:, i] = suffix[:, i + 1] + points[:, i] * powers[n - 1 - i]
    return prefix[:, n], prefix[:, :n] * powers[None, ::-1] + suffix[:, 1:]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (wid, word) in, their keys (key, kind, place, wid) out."""
    for b in batches:
        length = pc.utf8_length(b["word"]).to_numpy()
        wid = b["wid"].to_numpy()
        for n in np.unique(length):
            of = np.flatnonzero(length == n)
            step = max(1, CELLS // int(n))
            for some in (of[i : i + step] for i in range(0, len(of), step)):
                words = b["word"].take(pa.array(some)).to_pylist()
                points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(some), n).astype(np.uint64)
                whole, less = deletion_hashes(points)
                first = np.concatenate((np.ones((len(some), 1), bool), points[:, 1:] != points[:, :-1]), axis=1)
                row, at = np.nonzero(first)
                every = np.tile(np.arange(n), len(some))
                same = _mixed(less + np.arange(n, dtype=np.uint64)[None, :] * PLACE + np.uint64(int(n) * int(LENGTH) % (1 << 64)), REPLACED)
                for kind, key, place, who in (
                    (WHOLE, _mixed(whole, WHOLE), np.zeros(len(some), np.int64), wid[some]),
                    (LACKING, _mixed(less[row, at], WHOLE), at, wid[some][row]),
                    (REPLACED, same.ravel(), every, np.repeat(wid[some], n)),
                ):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.full(len(key), kind, np.int8)), pa.array(place.astype(np.int32)), pa.array(who)], names=["key", "kind", "place", "wid"],
                    )


def _runs(batches: Iterator[pa.RecordBatch], column: str = "key") -> Iterator[pa.Table]:
    """Tables that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        key = b[column].to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))  # sorted inside a partition
        if cut:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys sorted by key and kind in; the rows of keys that may hold a near pair out."""
    for t in _runs(batches):
        key, kind = t["key"].to_numpy(), t["kind"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        # insertions need the word that lacks nothing, which comes first
        fine = (size > 1) & (kind[start] != LACKING)
        if fine.any():
            yield from t.take(pa.array(np.flatnonzero(np.repeat(fine, size)))).combine_chunks().to_batches()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared keys with their words, sorted by key, in; a row (word, near, n, other) for each word and key out, strings compared."""
    for t in _runs(batches):
        groups: dict[tuple, list[tuple[int, str, bool]]] = {}
        for key, kind, place, word, n in zip(*(t[c].to_pylist() for c in ("key", "kind", "place", "word", "n"))):
            if kind == WHOLE:
                groups.setdefault((key, word), []).insert(0, (n, word, True))
            else:
                rest = word[:place] + word[place + 1 :]
                groups.setdefault((key, rest) if kind == LACKING else (key, rest, place), []).append((n, word, False))
        out: list[tuple[str, int, int, str]] = []
        for name, group in groups.items():
            if len(group) < 2:
                continue
            placed = len(name) == 3
            order = sorted(group, key=lambda x: (-x[0], x[1]))
            if group[0][2]:  # a word and those with one code point more
                n, word, _ = group[0]
                best = next(x for x in order if x[1] != word)
                out.append((word, len(group) - 1, best[0], best[1]))
                out += [(w, 1, n, word) for _, w, own in group if not own]
            elif placed:
                for n, w, _ in group:
                    best = order[0] if order[0][1] != w else order[1]
                    out.append((w, len(group) - 1, best[0], best[1]))
        if out:
            word, near, n, other = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(other)], names=["word", "near", "n", "other"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (wid, word, n) that have a near one."""
    keys = words.select("wid", "word").mapInArrow(_keys, "key long, kind byte, place int, wid long")
    parted = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "kind")
    shared = durable(parted.mapInArrow(_shared, "key long, kind byte, place int, wid long"), "spelling-shared")
    x = shared.join(_few(words), "wid").select("key", "kind", "place", "word", "n")
    x = x.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    met = x.mapInArrow(_met, "word string, near long, n long, other string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "other"))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.other").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps taken. Counts grow along forms, so there is no cycle."""
    last = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while True:
        nxt = last.select("word", "root").join(_few(last.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        nxt = durable(nxt.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(last)
        last = nxt
        if last.filter("moved").isEmpty():
            return last.select("word", "root")


def variants(docs: DataFrame, changes: Change = noisy, least: int = LEAST_CHARS, often: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    with scope(docs.sparkSession) as own:
        words = durable(counted(docs, changes, least, often).withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
        near = durable(words.join(near_words(words), "word"), "spelling-near")
        better = near.filter(F.col("best_n") >= times * F.col("n")).select("word", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
        roots = durable(better.join(_few(followed(better)), "word"), "spelling-forms")
        own.spare(words, near, roots)
    x = words.select("word", "n").join(near.select("word", "n_near"), "word", "left").join(roots, "word", "left")
    return x.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11(docs: DataFrame) -> DataFrame:
    return variants(docs)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOISE = crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || low")
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS low FROM documents),
g AS (SELECT doc_id, low, count(*) AS c FROM t WHERE length(low) >= {LEAST_CHARS} GROUP BY ALL),
h AS (SELECT low, c, {_NOISE} AS h FROM g, crc),
r AS (SELECT CASE WHEN h % 199 = 0 THEN substr(low, 1, (h % length(low))::BIGINT) || substr(low, (h % length(low))::BIGINT + 2) ELSE low END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM r WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
i AS (SELECT word, unnest(range(length(word))) AS i FROM w),
d AS MATERIALIZED (SELECT word, i, length(word) AS k, substr(word, 1, i) || substr(word, i + 2) AS rest FROM i),
p AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.k = b.k AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
b AS (SELECT p.word, count(*) AS n_near, max(w.n) AS best_n FROM p JOIN w ON p.other = w.word GROUP BY p.word),
c AS (SELECT p.word, min(p.other) AS best FROM p JOIN w ON p.other = w.word JOIN b ON b.word = p.word AND b.best_n = w.n GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {TIMES} * w.n THEN best END AS form, CASE WHEN best_n >= {TIMES} * w.n THEN best_n END AS form_n
  FROM w LEFT JOIN b ON w.word = b.word LEFT JOIN c ON w.word = c.word),
s AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON s.here = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, max_by(here, step) AS root FROM s GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word
"""
