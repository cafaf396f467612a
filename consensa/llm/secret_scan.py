"""Secret scan: fixed patterns, and a randomness battery on token-like runs.

Patterns (leftmost, non-overlapping per kind; code-point offsets, end exclusive):
assign, access and hex, as in ``BASE``. The battery looks at every maximal run of ``RUN`` of 20 or more
characters that is not digits alone. Its encoding is inferred: the smallest of hex, base32, base36, base62 and base64 that holds it, or the
letters of one case or both. Three statistics are taken over that alphabet:
chi-squared, as the rate of equal pairs of symbols (the same statistic, shifted and scaled); runs of symbols of one class
(lower, upper, digit; a capital belongs to the lower case behind it; signs do not count; with one class only, about the median symbol); lag-one
serial correlation.

Each has a distribution under two sources: uniform over the alphabet, and written text joined to identifiers. What the second
needs (symbol frequencies, share of word starts, correlation of neighbours, as seen through each alphabet) is counted over
all documents outside of token-like runs; fixed frequencies of English letters stand in where there is little text. The p-value under written text is
that of the best weighted sum of the three standardised statistics, each weighing what the two sources' means differ by in it. It enters
a Benjamini-Hochberg step at level ``q`` over all documents, separately for each encoding and length band: short runs, which
show little, must meet the level among themselves. The step works on a histogram of at most 21 x 401 cells. A run that a test rejects as uniform
(p below ``reject``) is no discovery.

Random runs that lie inside a pattern's span are reported by the pattern only.
Defined results: null text is empty; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed

# The base patterns of the contract.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(BASE[0][1], re.I | re.A)
_ACCESS = re.compile(BASE[1][1])
_HEX = re.compile(BASE[2][1])
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_SYMBOLS = {
    "hex": _DIGITS + "abcdef",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "letters": _LOWER,
    "both": _UPPER + _LOWER,
}
LEAST = 20  # symbols of a run that is tested
ENCODINGS, BANDS = tuple(_SYMBOLS), (32, 64)
_CODE = {k: {c: i for i, c in enumerate(v)} for k, v in _SYMBOLS.items()}
# Shares of letters in English text, in 1/10000.
_ENGLISH = dict(zip(_LOWER, (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)))
#: Symbols of English that stand in for what little text shows: capitals begin one word in five, a symbol in 25 is a digit, a word has six symbols.
PRIOR, WORD = 2000, 6


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(token: str) -> tuple[str, str] | None:
    """(encoding, symbols tested): the smallest alphabet that holds the run; digits alone have none.

    Hyphens and underscores are separators where 20 symbols remain without them, as in hyphenated hex or after a prefix.
    """
    t = token.rstrip("=")
    parted = t.replace("-", "").replace("_", "")
    if len(parted) >= LEAST:
        t = parted
    kinds = {("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s") for c in t}
    if kinds <= {"d", "s"}:
        return None
    low = t if "l" in kinds and "u" in kinds else t.lower()
    if kinds <= {"l", "u"}:
        return ("letters", low) if len(kinds) == 1 else ("both", t)
    for name, body in (("hex", low), ("base32", t), ("base36", low), ("base62", t)):
        if all(c in _CODE[name] for c in body):
            return name, body
    return "base64", t.translate({45: 43, 95: 47})


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2


def _changes(u: int, v: int) -> bool:
    """Whether class ``v`` after ``u`` begins a new run: lower case goes on from a capital."""
    return u != v and (u, v) != (1, 0)


def _sides(name: str, symbols: str) -> list[int]:
    """What runs are runs of: classes, or the alphabet's halves where it has one class."""
    if name == "letters":
        return [int(_CODE[name][c] >= 13) + 3 for c in symbols]  # two more classes
    return [_class(c) for c in symbols if c not in "+/="]


def uniform_moments(name: str) -> tuple[float, float]:
    """(chance of a change, chance of two changes in a row) of uniform symbols."""
    side = _sides(name, _SYMBOLS[name])
    share = {u: side.count(u) / len(side) for u in set(side)}
    one = sum(share[u] * share[v] for u in share for v in share if _changes(u, v))
    two = sum(share[u] * share[v] * share[w] for u in share for v in share for w in share if _changes(u, v) and _changes(v, w))
    return one, two


_UNIFORM = {k: uniform_moments(k) for k in _SYMBOLS}


def statistics(name: str, body: str) -> tuple[int, float, int, float, float]:
    """(n, rate of equal pairs, places for a change, share of changes, serial correlation freed of its bias)."""
    n, code = len(body), _CODE[name]
    x = [code.get(c, 0) for c in body]
    count: dict[int, int] = {}
    for i in x:
        count[i] = count.get(i, 0) + 1
    pairs = sum(c * (c - 1) for c in count.values()) / (n * (n - 1))
    side = _sides(name, body)
    steps = max(len(side) - 1, 1)
    changed = sum(map(_changes, side, side[1:])) / steps
    m = sum(x) / n
    spread = sum((i - m) ** 2 for i in x)
    r = sum((u - m) * (v - m) for u, v in zip(x, x[1:])) / spread if spread else 1.0
    return n, pairs, steps, changed, r + 1 / n


def poisson_tail(count: float, mean: float) -> float:
    """P(X >= count)."""
    if mean > 500:
        return _upper((count - 0.5 - mean) / math.sqrt(mean))
    term = math.exp(-mean)
    below = 0.0
    for i in range(round(count)):
        below += term
        term *= mean / (i + 1)
    return max(1.0 - below, 1e-16)


def uniform_tests(name: str, got: tuple) -> tuple[float, float, float]:
    """p-values of chi-squared, runs and serial correlation under a uniform source."""
    n, pairs, steps, changed, r = got
    every, (one, two) = n * (n - 1) / 2, _UNIFORM[name]
    # equal pairs of few symbols are nearly Poisson, where the usual approximation of chi-squared fails
    p_chi = poisson_tail(pairs * every, every / len(_SYMBOLS[name]))
    var = steps * one * (1 - one) + 2 * (steps - 1) * (two - one * one)
    p_runs = min(1.0, 2 * _upper((abs(changed - one) * steps - 0.5) / math.sqrt(var)))
    return p_chi, p_runs, min(1.0, 2 * _upper(abs(r) * math.sqrt(n)))


# written text ---------------------------------------------------------------------------------------
_ALL = _SYMBOLS["base64"]
_BYTE = [64] * 256
for _i, _c in enumerate(_ALL):
    _BYTE[ord(_c)] = _i
_BYTE[45], _BYTE[95] = 62, 63


def tally(texts) -> list[int]:
    """64 x 64 counts of neighbouring symbols (others dropped) outside token-like runs, and the number of word starts."""
    import numpy as np

    raw = " ".join(_RUN.sub(" ", t) for t in texts if t).encode("utf-8", "replace")
    x = np.array(_BYTE, np.uint8)[np.frombuffer(raw, np.uint8)]
    is_symbol = x < 64
    starts = int((is_symbol[1:] & ~is_symbol[:-1]).sum()) + int(is_symbol[:1].sum())
    x = x[is_symbol].astype(np.int32)
    return [*np.bincount(x[:-1] * 64 + x[1:], minlength=4096).tolist(), starts]


def written(counts: list[int]) -> list[tuple[float, float, float, float]]:
    """For each encoding (chance of an equal pair, of three alike, of a change, correlation of neighbours) in written text."""
    import numpy as np

    english = np.zeros(64)
    for c, share in _ENGLISH.items():
        english[_ALL.index(c)], english[_ALL.index(c.upper())] = share * (1 - 0.2 / WORD), share * 0.2 / WORD
    english[52:62] = english.sum() / 24 / 10
    english /= english.sum()
    joint = np.array(counts[:4096], float).reshape(64, 64) + PRIOR * np.outer(english, english)
    starts = (counts[4096] + PRIOR / WORD) / joint.sum()
    out = []
    for name, symbols in _SYMBOLS.items():
        fold = {"base32": str.upper, "hex": str.lower, "base36": str.lower, "letters": str.lower}.get(name, str)
        to = [_CODE[name].get(fold(c), -1) for c in _ALL]
        seen = np.zeros((len(symbols), len(symbols)))
        inside = [i for i, k in enumerate(to) if k >= 0]
        for i in inside:
            for j in inside:
                seen[to[i], to[j]] += joint[i, j]
        seen /= seen.sum()
        a, b, k = seen.sum(axis=1), seen.sum(axis=0), np.arange(len(symbols))
        sd = np.sqrt((a @ (k * k) - (a @ k) ** 2) * (b @ (k * k) - (b @ k) ** 2))
        rho = (k @ seen @ k - (a @ k) * (b @ k)) / sd
        half = k >= len(symbols) // 2
        change = seen[half][:, ~half].sum() + seen[~half][:, half].sum() if name == "letters" else starts
        out.append((float((a * a).sum()), float((a**3).sum()), float(change), float(rho)))
    return out


def profile(docs: DataFrame, text: str = "text") -> list[tuple[float, float, float, float]]:
    """``written`` over all texts; 4,097 numbers reach the driver."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b[0].to_pylist()
            for at in range(0, len(texts), 64):
                found = [(i, n) for i, n in enumerate(tally(texts[at : at + 64])) if n]
                yield pa.RecordBatch.from_pydict(
                    {"cell": [i for i, _ in found], "n": [n for _, n in found]}, pa.schema([("cell", pa.int32()), ("n", pa.int64())])
                )

    counts = [0] * 4097
    for cell, n in docs.select(text).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    return written(counts)


def written_p(name: str, got: tuple, text: tuple[float, float, float, float]) -> float:
    """p-value of the statistics under written text, against uniform symbols."""
    n, pairs, steps, changed, r = got
    two, three, change, rho = text
    every = n * (n - 1) / 2
    sd = math.sqrt(every * two * (1 - two) + n * (n - 1) * (n - 2) * max(three - two * two, 0)) / every, math.sqrt(change * (1 - change) / steps), 1 / math.sqrt(n)
    seen = (two - pairs) / sd[0], (changed - change) / sd[1], (r - rho) / sd[2]
    far = (two - 1 / len(_SYMBOLS[name])) / sd[0], (_UNIFORM[name][0] - change) / sd[1], -rho / sd[2]
    return _upper(sum(a * b for a, b in zip(seen, far)) / math.sqrt(sum(b * b for b in far)))


def battery(token: str, text: list[tuple], reject: float = 1e-4) -> tuple[str, int, int] | None:
    """(encoding, length band, strength): strength is -4 log10 p under written text, 0 if a test rejects uniform symbols."""
    got = infer(token)
    if got is None or len(got[1]) < 20:
        return None
    name, body = got
    seen = statistics(name, body)
    band = bisect_right(BANDS, len(body))
    if min(uniform_tests(name, seen)) < reject:
        return name, band, 0
    p = written_p(name, seen, text[ENCODINGS.index(name)])
    return name, band, min(400, int(-4 * math.log10(max(p, 1e-300))))


def scan_text(text: str, profile: list[tuple], reject: float = 1e-4):
    """Base spans (start, kind index, end) in order, and random runs (start, end, stratum, strength)."""
    base = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    # a run lies inside a base span if the furthest end among spans that begin no later reaches the run's
    begins, ends = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    found = []
    for m in _RUN.finditer(text):
        got = battery(m[0], profile, reject)
        if got:
            i = bisect_right(begins, m.start()) - 1
            if i < 0 or ends[i] < m.end():
                found.append((m.start(), m.end(), ENCODINGS.index(got[0]) * 3 + got[1], got[2]))
    return base, found


def masked_text(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """``text`` with ``mask`` in place of its spans (start, end), ordered by start; overlapping spans are one."""
    done, at = [], 0
    for s, e in spans:
        if s >= at:
            done += [text[at:s], mask]
        at = max(at, e)
    return "".join([*done, text[at:]])


_SPAN = "array<struct<start:int,kind:int,stop:int>>"
_SCAN = f"base {_SPAN}, base_sha256 string, found array<struct<start:int,stop:int,stratum:int,strength:int>>"


def scan(profile: list[tuple], text: str = "text", reject: float = 1e-4) -> F.Column:
    """Struct column: base spans, their digest, and candidate random runs with stratum and strength."""

    @F.pandas_udf(_SCAN)
    def udf(texts):
        import pandas as pd

        rows = []
        for t in texts:
            base, found = scan_text(t or "", profile, reject)
            said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            rows.append((
                [{"start": s, "kind": k, "stop": e} for s, k, e in base], hashlib.sha256(said.encode()).hexdigest(),
                [dict(zip(("start", "stop", "stratum", "strength"), f)) for f in found]
            ))
        return pd.DataFrame(rows, columns=["base", "base_sha256", "found"])

    return udf(F.col(text))


def thresholds(scanned: DataFrame, column: str = "scan", q: float = 0.01) -> dict[int, int]:
    """Least strength that Benjamini-Hochberg admits in each stratum, over all documents."""
    runs = scanned.select(F.explode(f"{column}.found").alias("f"))
    cells: dict[int, dict[int, int]] = {}
    for stratum, strength, n in runs.groupBy("f.stratum", "f.strength").count().collect():
        cells.setdefault(stratum, {})[strength] = n
    out = {}
    for stratum, by in cells.items():
        tests, above = sum(by.values()), 0
        for strength in sorted(by, reverse=True):
            above += by[strength]
            if strength and tests * 10 ** (-strength / 4) / above <= q:
                out[stratum] = strength
    return out


def spans(column: str, admit: dict[int, int]) -> F.Column:
    """All spans (start, kind, stop), ordered by start, then kind."""
    rules = " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(admit.items()))
    need = f"CASE x.stratum {rules} ELSE 1000000 END" if rules else "1000000"
    return F.expr(f"array_sort(concat({column}.base, transform(filter({column}.found, x -> x.strength >= {need}), x -> struct(x.start as start, 3 as kind, x.stop as stop))))")


def _said(column: str) -> F.Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), cast(x.start as string), cast(x.stop as string))), ',')")


def op1(docs: DataFrame) -> DataFrame:
    scanned = durable(docs.select("doc_id", scan(profile(docs)).alias("scan")), "secret-scan")
    n = lambda k: F.expr(f"cast(size(filter(scan.base, x -> x.kind = {k})) as long)")
    return scanned.withColumn("every", spans("scan", thresholds(scanned))).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.col("scan.base_sha256").alias("base_sha256"), _said("every").alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Every document stays; spans are replaced by ``mask``, overlapping spans by one. n_chars follows the text.

    Texts are scanned once; their rows are written with what was found, and only texts with a span are opened again.
    """
    scanned = durable(packed(docs, "text").select("row", scan(profile(docs)).alias("scan")), "secret-scan")

    @F.pandas_udf("string")
    def masked(texts, starts, stops):
        import pandas as pd

        return pd.Series([None if t is None else masked_text(t, list(zip(a, b)), mask) for t, a, b in zip(texts, starts, stops)], dtype=object)

    x = scanned.withColumn("every", spans("scan", thresholds(scanned)))
    x = x.withColumn("masked", masked(F.when(F.size("every") > 0, F.col("row.text")), "every.start", "every.stop"))
    row = F.col("row").withField("text", F.coalesce("masked", "row.text"))
    if "n_chars" in docs.columns:
        length = F.char_length("masked").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("masked").isNotNull(), length).otherwise(F.col("row.n_chars")))
    return x.select(row.alias("row")).select("row.*")
