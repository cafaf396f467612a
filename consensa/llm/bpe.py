"""Byte-level BPE as a bounded-lookahead streaming transducer.

``Vocabulary`` reads the merge list and computes its sufficient lookahead: how far left of the end of
the known bytes an unknown continuation can still change tokens. Merges apply in rank order, and at each rank
the leftmost place where two continuations differ moves left by the left part u of the merge u+v at most,
where v starts at that place. A later merge of the chain has a higher rank and a right part that begins with
the u of the one before, so the largest sum of left parts over such chains is a longest path, found by one
pass over the list. A token that ends so far before the end of the buffer is stable and is emitted; the
buffer never grows beyond a few times that distance, however long a word is.

``StreamEncoder`` cuts the stream into words with the public split pattern, keeps back what more characters
could change, and sends words through the merges (short ones by way of a bounded cache). ``StreamDecoder`` turns
ids into bytes and bytes into text with an incremental UTF-8 state machine; bad bytes give U+FFFD.

Defined results: null text is empty: no tokens, and the digest of the empty string; a very long text is read in pieces; repeated rows each get a row;
an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

CHUNK = 1 << 16
CACHE = 300_000
NONE = 1 << 30


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = _byte_chars()
        self.bytes_of: dict[int, bytes] = {i: bytes(chars[c] for c in s) for s, i in vocab.items() if all(c in chars for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = [vocab.get(next(c for c, b in chars.items() if b == x)) for x in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        pairs = []
        for r, m in enumerate(merges):
            u, v = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[u] << 32 | vocab[v], r)
            self.made.append(vocab[u + v])
            pairs.append((self.bytes_of[vocab[u]], self.bytes_of[vocab[v]]))
        self.longest = max(map(len, self.bytes_of.values()), default=1)
        self.lookahead = sufficient_lookahead(pairs) + self.longest
        self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        # the same split for text of the first 256 code points, by the faster engine; its classes are written out
        space, letter, number = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.runs = [regex.compile(p) for p in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]

    def merge(self, raw: bytes) -> list[int]:
        """Tokens of a word: the lowest rank first, leftmost first."""
        of, rank, made = self.of_byte, self.rank.get, self.made
        ids = [of[b] for b in raw]
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            new = ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, NONE)
        return ids


def sufficient_lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Longest sum of left parts over chains of merges (see the module's text)."""
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in pairs:
        far = len(u) + max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        if far > reach.get(u, 0):
            reach[u] = far
        most = max(most, far)
    return most


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Recent:
    """Tokens of words met lately, in two halves: a full young half becomes the old one, and what is met again moves to the young one."""

    def __init__(self, size: int = CACHE):
        self.half, self.young, self.old = size // 2, {}, {}

    def put(self, word: str, ids: list[int]) -> None:
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[word] = ids


class StreamEncoder:
    """feed(text) and finish() give token ids as soon as they are stable."""

    def __init__(self, vocab: Vocabulary, cache: Recent | None = None, latin: bool = False):
        """``latin``: whether all the text to come is of the first 256 code points."""
        self.v, self.cache, self.pattern = vocab, Recent() if cache is None else cache, vocab.latin if latin else vocab.pattern
        self.text, self.raw, self.open = "", b"", None

    def _word(self, w: str) -> list[int]:
        """Tokens of a word that is not among the young ones."""
        if len(w) > 64:
            return self._push(w.encode("utf-8", "replace")) + self._flush()
        got = self.cache.young.get(w) or self.cache.old.get(w) or self.v.merge(w.encode("utf-8", "replace"))
        self.cache.put(w, got)
        return got

    def _push(self, raw: bytes) -> list[int]:
        """Bytes of an unfinished word: returns the tokens that no continuation can change."""
        out, far = [], self.v.lookahead
        step = 2 * far + 64
        for at in range(0, len(raw), step):
            self.raw += raw[at : at + step]
            if len(self.raw) < step:
                continue
            ids, end = self.v.merge(self.raw), 0
            for i in ids:
                n = len(self.v.bytes_of[i])
                if end + n > len(self.raw) - far:
                    break
                end += n
                out.append(i)
            self.raw = self.raw[end:]
        return out

    def _flush(self) -> list[int]:
        ids, self.raw = self.v.merge(self.raw), b""
        return ids

    def feed(self, text: str) -> list[int]:
        return self._take(self.text + text, False)

    def finish(self) -> list[int]:
        return self._take(self.text, True)

    def _take(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        if self.open is not None:
            n = self.v.runs[self.open].match(text).end()
            ended = n < len(text) or last
            space = self.open == 0
            if ended and space and n < len(text):
                n -= 1  # the last blank goes with the word after it
            if not ended:
                n -= space
            out += self._push(text[:n].encode("utf-8", "replace"))
            text = text[n:]
            if not ended:
                self.text = text
                return out
            out += self._flush()
            self.open = None
        words = self.pattern.findall(text)
        if last:
            self.text = ""
        else:
            held = 0
            while words and held < 3:
                held += len(words.pop())
            self.text = text[len(text) - held :] if held else ""
        known = self.cache.young.get
        for w in words:
            ids = known(w)
            out += self._word(w) if ids is None else ids
        if not last and len(self.text) > CHUNK // 16:
            first = self.pattern.match(self.text)
            if first and first.end() > CHUNK // 32 and first.end() >= len(self.text) - 2:
                c = self.text[first.end() - 1]
                self.open = next(k for k, p in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}"), (3, r"")) if regex.match(p, c))
                n = first.end() - (self.open == 0)
                out += self._push(self.text[:n].encode("utf-8", "replace"))
                self.text = self.text[n:]
        return out


class StreamDecoder:
    """feed(ids) and finish() give text; bytes of an unfinished character wait."""

    def __init__(self, vocab: Vocabulary):
        self.of = vocab.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encode(vocab: Vocabulary, text: str, cache: Recent | None = None):
    """Yield lists of ids, at most about a chunk each; strings of special tokens give their ids."""
    parts = [text]
    if any(s in text for s in vocab.special):
        parts = regex.split("(" + "|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) + ")", text)
    for part in parts:
        if part in vocab.special:
            yield [vocab.special[part]]
        elif part:
            e = StreamEncoder(vocab, cache, _is_latin(part))
            for at in range(0, len(part), CHUNK):
                yield e.feed(part[at : at + CHUNK])
            yield e.finish()


_CACHES: dict[str, Recent] = {}


def coded(path: str | None = None, text: str = "text", with_ids: bool = False) -> F.Column:
    """Struct column: n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.pandas_udf(kind)
    def udf(texts):
        import pandas as pd

        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("byte_bpe_50k.json")
        vocab, cache = vocabulary(where), _CACHES.setdefault(where, Recent())
        said = [str(i) for i in range(max(vocab.bytes_of) + 1)]
        rows = []
        for t in texts:
            n, ids_sha, text_sha, decoder, kept = 0, hashlib.sha256(), hashlib.sha256(), StreamDecoder(vocab), []
            for ids in encode(vocab, t or "", cache):
                if ids:
                    ids_sha.update(("," * (n > 0) + ",".join(map(said.__getitem__, ids))).encode())
                    text_sha.update(decoder.feed(ids).encode())
                    n += len(ids)
                    if with_ids:
                        kept += ids
            text_sha.update(decoder.finish().encode())
            rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest(), *[kept] * with_ids))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return udf(F.col(text))


def op4(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", coded().alias("c")).select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


def encoded(docs: DataFrame) -> DataFrame:
    """The pipeline's end: token ids and digests of each document; other columns of the same names are replaced."""
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    names = [c for c in docs.columns if c != "text" and c.lower() not in new]
    x = packed(docs, "text").withColumn("coded", coded(with_ids=True))
    return x.select(*[F.col(f"row.`{c}`") for c in names], *[F.col(f"coded.{c}").alias(c) for c in new])
