"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits. A binary classifier predicts each bit from hashed byte
trigrams of the lower-cased text (its letters; ASCII non-letters count as blanks): the weight of a trigram
is the log ratio of its smoothed frequency in the languages whose bit is +1 to that in the others, each
language weighing the same. Decoding sums, over the bits, the hinge loss of the normalised bit margin,
weighted by the bit's reliability on the training sample; the codeword of least loss is the language, and
a small gap to the second least marks the row as ambiguous.

The fit uses a sample of ``per_language`` labelled rows of each language in expectation (chosen by hash, the
bound is the parameter); prediction covers whole texts of all rows.

Defined results: null text, or text without a letter, gives ``und`` with score 0; null doc_id is neither
held out nor learned from; with no labelled row, everything is ``und``; one learned language is always predicted; ties of two languages go to
the first by name; a very long text is one row of a task; repeated rows each get a row, and are learned from as often as they are drawn; an empty
table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, release

BITS = 14
_ASCII = np.arange(256, dtype=np.uint32)
_ASCII[[b for b in range(128) if not chr(b).isalpha()]] = 32


def histogram(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams; long texts go in pieces that overlap by two bytes."""
    raw = b" " + text.encode("utf-8", "replace") + b" "
    out = np.zeros(1 << BITS, np.int64)
    step = 1 << 20
    for at in range(0, max(len(raw) - 2, 0), step):
        x = _ASCII[np.frombuffer(raw, np.uint8, min(step + 2, len(raw) - at), at)]
        h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def codewords(n: int) -> np.ndarray:
    """n x bits matrix of +1/-1: all splits for few languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        cols = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    bits, best, far = math.ceil(15 * math.log2(n)), None, -1
    for seed in range(50):
        m = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        agree = m.astype(np.int32) @ m.T.astype(np.int32)
        np.fill_diagonal(agree, -bits)
        gap = (m.shape[1] - agree.max()) // 2
        if gap > far:
            best, far = m, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # trigrams x bits
    scale: np.ndarray
    trust: np.ndarray
    ambiguous_below: float = 0.02

    def margins(self, text: str) -> np.ndarray:
        h = histogram(text)
        at = np.flatnonzero(h)
        return (h[at] @ self.weights[at]) / max(int(h.sum()), 1)

    def decode(self, f: np.ndarray) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.maximum(0, 1 - self.code * (f / self.scale)) @ self.trust
        order = np.argsort(loss, kind="stable")
        a, b = loss[order[0]], loss[order[1]]
        score = float((b - a) / (b + a)) if b > 0 else 0.0
        return self.languages[order[0]], score, score < self.ambiguous_below


def _held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = 600) -> Model | None:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1; about ``per_language`` rows a language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rates = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language-sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(rates, F.col("lang"))
    sample = durable(rows.filter(draw < share).select("lang", F.lower("text").alias("text")), "language-sample")  # read twice

    def tally(batches):
        import pandas as pd

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                h = histogram(text)
                sums[lang] = sums.get(lang, 0) + h / max(h.sum(), 1)
        for lang, h in sums.items():
            at = np.flatnonzero(h)
            yield pd.DataFrame({"lang": lang, "gram": at, "mass": h[at]})

    table = sample.mapInPandas(tally, "lang string, gram long, mass double").groupBy("lang", "gram").agg(F.sum("mass").alias("mass")).toPandas()
    mass = np.zeros((len(languages), 1 << BITS))
    row = {k: i for i, k in enumerate(languages)}
    mass[table["lang"].map(row).to_numpy(int), table["gram"].to_numpy(int)] = table["mass"].round(9)
    mass = (mass + 1e-4) / (mass + 1e-4).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((1 << BITS, 1), np.float32), np.ones(1), np.ones(1))
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.log((up / up.sum(0)).T @ mass) - np.log((down / down.sum(0)).T @ mass)
    model = Model(languages, code, weights.T.astype(np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))

    def score(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "f": [model.margins(t).tolist() for t in b["text"]]})

    seen = sample.mapInPandas(score, "lang string, f array<double>").toPandas()
    if len(seen):
        f = np.array(seen["f"].tolist())
        want = code[seen["lang"].map(row).to_numpy(int)]
        model.scale = np.maximum(np.abs(f).mean(axis=0), 1e-9)
        hit = np.clip((np.sign(f) == want).mean(axis=0), 0.501, 0.999)
        model.trust = np.log(hit / (1 - hit))
        model.trust /= model.trust.sum()
    release(sample)
    return model


def predict(model: Model | None) -> F.Column:
    """Struct column (lang_pred, score, ambiguous) of the whole text."""
    kind = "lang_pred string, score double, ambiguous boolean"
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))

    @F.pandas_udf(kind)
    def udf(texts):
        import pandas as pd

        rows = [("und", 0.0, True) if t is None else model.decode(model.margins(t)) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous"])

    text = F.col("text")
    return udf(F.when(text.rlike(r"\p{L}"), F.lower(text)))


def identify(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """(row, language): the documents' rows as structs, and a struct of lang_pred, score and ambiguous."""
    return packed(docs, "text").withColumn("language", predict(fit(docs, per_language))).select("row", "language")


def op3(docs: DataFrame) -> DataFrame:
    x = identify(docs.select("doc_id", "text", "lang")).select("row.doc_id", "language.*")
    return x.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a recognised language; text without a letter and ambiguous text go."""
    return identify(docs).filter("language.lang_pred <> 'und' and not language.ambiguous").select("row.*")
