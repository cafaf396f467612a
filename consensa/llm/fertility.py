"""Quality rules by tokeniser fertility: how public vocabularies cut a text, against what is usual for its language or script.

Measured per text and vocabulary: characters per token, the share of byte fallback tokens (tokens that are no text by themselves) and the entropy
of the tokens in bits. Words are encoded one by one, each after a blank, so a word costs its encoding once in a batch of documents. Texts of
one language (script where no language is given) and one length (powers of two of words) form a cell. Quartiles of every measure over all
documents of a cell that pass the base rules give its band: the median and ``SPREAD`` robust deviations to each side, ``FLOORS`` at least, since a
cell may hold copies of one text. A text outside a band is rejected. Cells of fewer than ``LEAST`` documents take the
bands of all languages at that length; where these are fewer too, nothing is rejected.

Base rules: fewer than 10 words, or over 20% of the words in repeated five-word windows.

Defined results: a null or empty text has no words and fails the base; a very long text is one row of a task; repeated rows each get a row and count
each time in the bands; an empty table gives an empty result; columns of any name pass through ``rules``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, scope
from .simhash import _few

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
MEASURES = ("fertility", "fallback", "entropy")
SPREAD, LEAST = 6.0, 64
#: Least half-widths of bands: share of the median for fertility and entropy, share of tokens for fallback.
FLOORS = (0.12, 0.05, 0.25)
CACHE = 200_000  # words whose tokens a task remembers
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
BLANKS, SYMBOLS = " \t\n\v\f\r", b"#*$%&|<>"
# First code points of the blocks that tell scripts apart.
SCRIPTS = (
    (0x41, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"),
    (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)


class Vocabulary:
    """Tokens of words, and which of them are byte fallback."""

    def __init__(self, name: str):
        import public_tokenizers as P

        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
            self.encode = lambda words: model.encode(words, num_threads=1)
            self.bytes = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        else:
            import tiktoken

            with open(P.path(name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [model.encode_ordinary(f" {w}") for w in words]
            self.bytes = np.zeros(max(ranks.values()) + 1, bool)
            for raw, i in ranks.items():
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    self.bytes[i] = True


class Words:
    """Numbers for words, and their tokens under each vocabulary as one flat array."""

    def __init__(self, vocabularies: Sequence[Vocabulary]):
        self.vocabularies = vocabularies
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32) for _ in self.vocabularies]
        self.length = [np.empty(0, np.int64) for _ in self.vocabularies]
        self.start = self.length

    def numbers(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Numbers of the words of each text; new words are encoded."""
        if len(self.number) > CACHE:
            self.clear()
        n, known = self.number, len(self.number)
        out = [np.array([n.setdefault(w, len(n)) for w in words_of(t)], np.int64) for t in texts]
        new = list(n)[known:]
        if new:
            for i, v in enumerate(self.vocabularies):
                got = v.encode(new)
                self.length[i] = np.concatenate((self.length[i], np.fromiter(map(len, got), np.int64, len(got))))
                self.flat[i] = np.concatenate((self.flat[i], np.fromiter((x for g in got for x in g), np.int32)))
            self.start = [np.cumsum(x) - x for x in self.length]
        return out

    def tokens(self, i: int, words: np.ndarray) -> np.ndarray:
        """Tokens of a text, given its words' numbers."""
        n = self.length[i][words]
        at = np.arange(n.sum()) + np.repeat(self.start[i][words] - (np.cumsum(n) - n), n)
        return self.flat[i][at]


def words_of(text: str) -> list[str]:
    """Words are what ASCII white space parts."""
    return [w.decode() for w in text.encode().split()] if not text.isascii() else [w for w in text.translate(_BLANK).split(" ") if w]


_BLANK = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    rank, width = words, 1
    while width < window:  # exact numbers of windows, each step joining two shorter ones
        step = min(width, window - width)
        rank = np.unique(rank[: len(rank) - step] * np.int64(len(words) + 1 + int(rank.max())) + rank[step:], return_inverse=True)[1].astype(np.int64)
        width += step
    again = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counted(text: str, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    raw = text.encode()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def script(text: str) -> str:
    """The script of most letters."""
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), np.uint32)
    if not len(points):
        return "none"
    at = np.searchsorted([first for first, _ in SCRIPTS], points, "right") - 1
    sums: dict[str, int] = {}
    for i, k in enumerate(np.bincount(np.maximum(at, 0), minlength=len(SCRIPTS))):
        sums[SCRIPTS[i][1]] = sums.get(SCRIPTS[i][1], 0) + int(k)
    return max(sorted(sums), key=sums.get)


def measures(tokens: np.ndarray, bytes_: np.ndarray, chars: int) -> tuple[float, float, float]:
    share = np.unique(tokens, return_counts=True)[1] / len(tokens)
    return round(chars / len(tokens), 2), round(float(bytes_[tokens].mean()), 3), round(float(-(share * np.log2(share)).sum()), 1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(vocabularies: Sequence[str]):
    """Pandas UDF of (text, language): counts, cell (language, length) and measures."""
    import pandas as pd

    kind = ", ".join(f"{c} long" for c in COUNTS) + ", language string, length int, measures array<double>"

    def run(batches):
        known = Words([Vocabulary(v) for v in vocabularies])
        for texts, languages in batches:
            texts = ["" if t is None else t for t in texts]
            rows = []
            for text, words, lang in zip(texts, known.numbers(texts), languages):
                got, found = counted(text, words), []
                for i, v in enumerate(known.vocabularies):
                    tokens = known.tokens(i, words)
                    if not len(tokens):
                        found = None
                        break
                    found += measures(tokens, v.bytes, got[1])
                rows.append((*got, script(text) if lang is None else lang, len(words).bit_length(), found))
            yield pd.DataFrame(rows, columns=[*COUNTS, "language", "length", "measures"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind)


def bands(found: DataFrame, vocabularies: Sequence[str], spread: float = SPREAD, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(language, length, low, high) and (length, low, high) of cells with ``least`` documents: arrays in the order of ``measures``."""
    names = [m for _ in vocabularies for m in range(3)]
    quarters = [F.expr(f"percentile(measures[{i}], array(0.25D, 0.5D, 0.75D))").alias(f"q{i}") for i in range(len(names))]

    def sides(x: DataFrame, *keys: str) -> DataFrame:
        x = x.groupBy(*keys).agg(F.count("*").alias("n"), *quarters).filter(F.col("n") >= least)
        low, high = [], []
        for i, m in enumerate(names):
            mid, wide = F.col(f"q{i}")[1], (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349
            half = F.greatest(spread * wide, F.lit(FLOORS[m]) * (F.lit(1.0) if m == 1 else mid))
            low.append(F.lit(float("-inf")) if m == 1 else mid - half)
            # many different tokens are no fault
            high.append(F.lit(float("inf")) if m == 2 else mid + half)
        return x.select(*keys, F.array(*low).alias("low"), F.array(*high).alias("high"))

    good = found.filter("not base_failed and measures is not null")
    return sides(good, "language", "length"), sides(good, "length")


def rules(docs: DataFrame, vocabularies: Sequence[str] = VOCABULARIES, spread: float = SPREAD, least: int = LEAST, carry: Sequence[str] | None = None) -> DataFrame:
    """(row, counts, language, length, measures, base_failed, outside, kept): rows (of the columns ``carry``, or all) as structs; outside: positions of measures beyond their band."""
    with scope(docs.sparkSession) as own:
        row = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row")
        x = docs.select(row, measured(tuple(vocabularies))("text", "lang").alias("m")).select("row", "m.*")
        repeated = F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words")
        found = durable(x.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | repeated), "fertility")
        cells, lengths = bands(found, vocabularies, spread, least)
        cells, lengths = durable(cells, "fertility-cells"), durable(lengths, "fertility-lengths")
        own.spare(found, cells, lengths)
    wide = lengths.select("length", F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    x = found.join(_few(cells), ["language", "length"], "left").join(F.broadcast(wide), "length", "left")  # 64 lengths at most
    x = x.withColumn("low", F.coalesce("low", "all_low")).withColumn("high", F.coalesce("high", "all_high"))
    beyond = "filter(sequence(0, size(measures) - 1), i -> measures[i] < low[i] or measures[i] > high[i])"
    x = x.withColumn("outside", F.expr(f"if(measures is null or low is null, cast(array() as array<int>), {beyond})"))
    return x.select("row", *COUNTS, "language", "length", "measures", "base_failed", "outside", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"))


def op12(docs: DataFrame) -> DataFrame:
    return rules(docs, carry=["doc_id"]).select("row.doc_id", *COUNTS, "base_failed", "kept", "language", "outside")
