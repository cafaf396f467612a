"""Operators on documents against brute-force versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from consensa.llm import bpe, language_id, near_copies, secret_scan, simhash, source_mix, suffix_dedup


# secret scan --------------------------------------------------------------------------------------
def brute_base(text):
    got = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            got.append((m.start(), 0, m.end()))
    got += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    got += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(got))


SECRETS = [
    "é PassWord: 'abc' token=abcdef0", "AKIA" + "A1" * 8 + " x " + "0123456789abcdef" * 2,
    "api_key = zz.yy-xx secret:\"short\" toKen='longer_1'", "ſecret=abcdefg", "deadbeef" * 3 + "g" + "f" * 23, "",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate([*SECRETS, None])), "doc_id long, text string")
    for r in secret_scan.op1(df).collect():
        said = brute_base(([*SECRETS, None])[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(said.count(k + ":") for k in ("assign", "access", "hex"))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def token(rng, name, n):
    return "".join(rng.choice(secret_scan._SYMBOLS[name]) for _ in range(n))


WORDS = "get user name from session parse the config file this is a very long identifier customer order line item http response status code read next page total number of open issues".split()


def identifier(rng):
    """Written runs: words joined in the ways of source text, numbers behind some."""
    out, joint = "", rng.choice(["", "_", "-", "/", "camel"])
    while len(out) < 20:
        w = rng.choice(WORDS)
        out += w.capitalize() if joint == "camel" else (joint if out else "") + w
    return out + rng.choice(["", "", "2", "2024", "_44"])


def brute_random(texts, q=0.01):
    """Random spans by text: the battery on every run outside base spans, then the textbook step-up within each stratum."""
    profile = secret_scan.written(secret_scan.tally(texts))
    runs = []
    for i, t in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in brute_base(t or "").split(",") if x]
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t or ""):
            got = secret_scan.battery(m[0], profile)
            if got and not any(s <= m.start() and m.end() <= e for s, e in base):
                runs.append((got[:2], 10 ** (-got[2] / 4), i, m.span()))
    found = set()
    for stratum in {r[0] for r in runs}:
        own = sorted((r for r in runs if r[0] == stratum), key=lambda r: r[1])
        last = max((n for n, r in enumerate(own, 1) if r[1] * len(own) / n <= q and r[1] < 1), default=0)
        found |= {(i, *at) for _, p, i, at in own if last and p <= own[last - 1][1]}
    return found


def test_random_runs_are_found_and_written_ones_left(spark):
    rng = random.Random(1)
    secret = [(name, n, token(rng, name, n)) for name in secret_scan.ENCODINGS for n in (20, 24, 32, 48, 64) for _ in range(25)]
    written = [identifier(rng) for _ in range(600)] + [
        "A1" * 20, "0123456789abcdefghijklmnopqrstuvwxyz", "x" * 40 + "1", "A" * 30, "Donaudampfschifffahrtsgesellschaft",
    ]
    texts = [f"see {t} there" for t in [x[2] for x in secret] + written] + ["the page is read by " + " ".join(rng.choices(WORDS, k=60)) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, *map(int, x.split(":")[1:])) for r in secret_scan.op1(df).collect() for x in r.spans.split(",") if x.startswith("random")}
    assert got == brute_random(texts)
    hit = {i for i, *_ in got}
    share = lambda names, lengths: np.mean([i in hit for i, (k, n, t) in enumerate(secret) if k in names and n in lengths and not brute_base(t)])
    assert share(("base62", "base64"), (20, 24, 32, 48, 64)) > 0.85 and share(("hex", "base36"), (32, 48, 64)) > 0.8
    assert len(hit & set(range(len(secret), len(texts)))) <= 0.02 * len(hit)


def test_nulls_of_the_battery():
    """p-values under uniform symbols are as small as they say, but no smaller."""
    rng = random.Random(3)
    for name in secret_scan.ENCODINGS:
        for n in (20, 40):
            p = np.array([secret_scan.uniform_tests(name, secret_scan.statistics(name, token(rng, name, n))) for _ in range(1500)])
            assert (p < 0.01).mean(axis=0).max() < 0.03, (name, n)


def test_secrets_of_nothing(spark, none):
    assert secret_scan.op1(none).count() == 0 and secret_scan.redact(none).count() == 0
    long = "".join(f"secret=abcdef{i:06d} é " for i in range(5000))
    df = spark.createDataFrame([(0, long, "x"), (0, long, "x"), (None, "token: abcdefg", "x")], "doc_id long, text string, row string")
    got = secret_scan.op1(df).collect()
    assert sorted((r.n_assign for r in got)) == [1, 5000, 5000]
    out = secret_scan.redact(df)
    assert out.columns == df.columns and [r.text for r in out.filter("doc_id = 0").collect()] == ["[SECRET] é " * 5000] * 2


def test_masks_join_overlaps_and_nested_runs():
    key = "deadbeef" * 3
    text = f"é token={key} {key}\x20AKIA{'A1' * 8}" + "x" * 3 + f" token={key}"
    base, _ = secret_scan.scan_text(text, secret_scan.written([0] * 4097))
    assert secret_scan.masked_text(text, [(s, e) for s, _, e in base], "#") == "é # # #xxx #"
    assert secret_scan.masked_text("abcdef", [(0, 4), (1, 2), (3, 5)], "#") == "#f" and secret_scan.masked_text("", [], "#") == ""


def test_redaction_keeps_rows_and_columns(spark, docs, rows):
    df = docs.unionByName(spark.createDataFrame([(999, "x token=abcdef1 and " + "0f" * 20 + " é", "aa", "s", 1, "r", 1)], docs.schema))
    out = secret_scan.redact(df)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got if r.doc_id != 999) == Counter((r[0], r[1]) for r in rows)
    r = next(r for r in got if r.doc_id == 999)
    assert r.text == "x [SECRET] and [SECRET] é" and r.n_chars == len(r.text)


# mixing -------------------------------------------------------------------------------------------
def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(docs, rows):
    got = source_mix.op2(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    by = {(r[0], r[1]): r for r in rows}
    taken = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5, (s, taken[s], want[s])
    assert by
    again = source_mix.op2(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def brute_copies(rows, seed=7):
    """How often each row (doc_id, text, source) is taken whole: whole epochs, then rows in the order of their keys."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    key = [md5(f"{seed}:{'' if i is None else i}:{md5(t or '')}")[:15] for i, t, _ in rows]
    sizes = Counter()
    for n, (_, _, s) in zip(size, rows):
        sizes[s] += n
    out = [0] * len(rows)
    for s, target in brute_targets(sizes).items():
        epochs, left = divmod(int(target + 1e-6), sizes[s]) if sizes[s] else (0, 0)
        own = sorted((key[i], i) for i in range(len(rows)) if rows[i][2] == s)
        for k, group in itertools.groupby(own, key=lambda x: x[0]):
            at = [i for _, i in group if size[i]]
            share = min(max(left, 0) // max(len(at), 1), max((size[i] for i in at), default=0))
            for i in at:
                out[i] = epochs + (2 * share >= size[i])
            left -= sum(size[i] for i in at)
    return out


def test_mix_stage_takes_whole_documents(docs, rows):
    want = Counter()
    for r, n in zip(rows, brute_copies([(r[0], r[1], r[3]) for r in rows])):
        want[r[0], r[1]] += n
    assert Counter((r.doc_id, r.text) for r in source_mix.mix(docs).collect()) == +want


def test_mix_rows(docs, none):
    out = source_mix.mix(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert source_mix.op2(none).count() == 0 and source_mix.mix(none).count() == 0


# language -----------------------------------------------------------------------------------------
def test_language(docs, rows, none):
    got = {(r.doc_id, r.lang_pred, r.held_out, r.score) for r in language_id.op3(docs).collect()}
    lang = {r[0]: r[2] for r in rows}
    hits = [p == lang[i] for i, p, h, _ in got if h and i is not None and i < 90]
    assert len(hits) > 15 and np.mean(hits) > 0.9
    for i, p, _, s in got:
        assert 0 <= s <= 1
        if i in (90, 91, 93):
            assert (p, s) == ("und", 0.0)
    assert language_id.op3(none).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (90, 91, 93)").count() == 0


def trigrams(text):
    """Hashed trigrams of the bytes, one by one."""
    raw = [32 if b < 128 and not chr(b).isalpha() else b for b in b" " + text.lower().encode() + b" "]
    out = Counter()
    for x, y, z in zip(raw, raw[1:], raw[2:]):
        h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        out[h >> 18] += 1
    return out


def brute_language(rows, texts):
    """[(language, score)] of ``texts`` by output codes learned from (doc_id, text, lang), bit by bit."""
    learn = [(t, k) for i, t, k in rows if k is not None and t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted({k for _, k in learn})
    mass = {k: [1e-4] * 2**14 for k in names}
    for t, k in learn:
        seen = trigrams(t)
        for g, n in seen.items():
            mass[k][g] += n / sum(seen.values())
    freq = np.array([np.array(mass[k]) / sum(mass[k]) for k in names])
    code = language_id.codewords(len(names)).astype(int)
    weight = [np.log(freq[code[:, b] > 0].mean(axis=0)) - np.log(freq[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    margins = lambda t: [sum(n * w[g] for g, n in trigrams(t).items()) / max(sum(trigrams(t).values()), 1) for w in weight]
    f = np.array([margins(t) for t, _ in learn])
    scale = np.abs(f).mean(axis=0)
    right = np.array([[np.sign(f[i, b]) == code[names.index(k), b] for b in range(len(weight))] for i, (_, k) in enumerate(learn)]).mean(axis=0)
    trust = np.log(np.clip(right, 0.501, 0.999) / (1 - np.clip(right, 0.501, 0.999)))
    trust /= trust.sum()
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        m = margins(t)
        loss = sorted((sum(trust[b] * max(0, 1 - code[k, b] * m[b] / scale[b]) for b in range(len(m))), k) for k in range(len(names)))
        (a, k), (b, _) = loss[:2]
        out.append((names[k], (b - a) / (b + a) if b > 0 else 0.0))
    return out


def test_language_equals_codes_decoded_bit_by_bit(spark, docs, rows):
    want = brute_language([r[:3] for r in rows], [r[1] for r in rows])
    got = language_id.op3(docs).collect()
    say = lambda x: sorted((-1 if i is None else i, k, round(s, 4)) for i, k, s in x)
    far = [
        (g, w) for g,
        w in zip(say((r.doc_id, r.lang_pred, r.score) for r in got), say((r[0], *w) for r, w in zip(rows, want))) if g[:2] != w[:2] or abs(g[2] - w[2]) > 2e-3
    ]
    assert not far
    kept = Counter(r.doc_id for r in language_id.keep_identified(docs).collect())
    assert kept == Counter(r[0] for r, (k, s) in zip(rows, want) if k != "und" and s >= 0.02)


def test_codewords_lie_apart():
    for n in (2, 3, 5, 7, 12, 60):
        m = language_id.codewords(n)
        gaps = [(a != b).sum() for a, b in itertools.combinations(m, 2)]
        assert min(gaps) >= (1 if n < 4 else m.shape[1] // 5)


# byte-pair encoding -------------------------------------------------------------------------------
TEXTS = [
    "", "Hello world", "don't  stop\n\n it's   ", " \t\n é<|endoftext|>x 12345 ---", "日本語 テキスト 🙂 ", "a" * 70_000, "   " * 9_000 + "x",
    "ab" * 40_000 + "'ll", "1" * 5000 + "é" * 5000, "'" * 3000 + "ll " * 3000, "<|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_matches_the_library(spark, docs, rows, library):
    texts = TEXTS + [r[1] for r in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.op4(df).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), r.doc_id
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_stage_matches_the_library(docs, rows, none, library):
    out = bpe.encoded(docs)
    assert "text" not in out.columns and {"ids", "n_tokens", "row", "scan"} <= set(out.columns)
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.op4(none).count() == bpe.encoded(none).count() == 0


def test_bpe_stream_is_stable_and_bounded(library):
    import public_tokenizers

    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(30):
        word = "".join(rng.choice(rng.choice(["ab", "the", "ation", "xyz"])) for _ in range(6000))
        e = bpe.StreamEncoder(v)
        out, most = [], 0
        for at in range(0, len(word), 500):
            out += e._push(word[at : at + 500].encode())
            most = max(most, len(e.raw))
        assert out + e._flush() == v.merge(word.encode()) and most < 4 * v.lookahead + 600


def test_bpe_random_chunks(library):
    import public_tokenizers

    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(["a", " ", "  ", "'", "'ll", "é", "1", "-", "\n", "the ", "🙂"]) for _ in range(rng.randint(1, 400)))
        e, out, at = bpe.StreamEncoder(v), [], 0
        while at < len(text):
            n = rng.randint(1, 9)
            out += e.feed(text[at : at + n])
            at += n
        out += e.finish()
        assert out == library.encode(text, add_special_tokens=False).ids
        d = bpe.StreamDecoder(v)
        assert "".join(d.feed([i]) for i in out) + d.finish() == text


def test_bpe_with_a_tiny_cache(library):
    import public_tokenizers

    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng, cache = random.Random(13), bpe.Recent(6)
    for _ in range(100):
        t = " ".join(rng.choice(["the", "of", "zebra", "quixotic", "don't", "naïve", "x" * 70]) + str(rng.randrange(9)) for _ in range(40))
        assert [i for ids in bpe.encode(v, t, cache) for i in ids] == library.encode(t, add_special_tokens=False).ids
        assert len(cache.young) <= 4 and len(cache.old) <= 4


def test_bpe_splits_latin_text_alike(library):
    import public_tokenizers

    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    for c in map(chr, range(256)):
        for t in (c, f"a{c}b", f" {c} ", f"1{c}", f"'{c}", c * 3 + "x"):
            assert v.latin.findall(t) == v.pattern.findall(t), repr(t)
    for _ in range(300):
        t = "".join(rng.choice("a é'lsvt\n\t\xa0\x1c\x1f\x85²½_-9ß×") for _ in range(rng.randint(1, 80)))
        assert v.latin.findall(t) == v.pattern.findall(t) and "".join(v.latin.findall(t)) == t
        assert [i for ids in bpe.encode(v, t) for i in ids] == library.encode(t, add_special_tokens=False).ids


# near duplicates ----------------------------------------------------------------------------------
def brute_print(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [x.lower() for x in w]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    votes = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, c in votes.items() if 2 * c > len(grams))


def brute_components(prints, budget=2):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= budget:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, rows, none):
    got = simhash.op8(docs).collect()
    prints = [brute_print(r[1]) for r in rows]
    label = brute_components(prints)
    least = {}
    for r, k in zip(rows, label):
        if r[0] is not None:
            least[k] = min(least.get(k, 1 << 60), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, label))
    assert Counter(map(tuple, got)) == want
    assert simhash.op8(none).count() == 0


@pytest.mark.parametrize("budget,unit_rows", [(0, 2000), (2, 2000), (2, 6), (3, 10)])
def test_trie_join_loses_no_link(spark, budget, unit_rows):
    rng = random.Random(budget * 100 + unit_rows)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        c = rng.getrandbits(64)
        prints |= {c, *(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(8))}
    prints |= {rng.getrandbits(12) for _ in range(60)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), budget, unit_rows).collect()
    at = {p: i for i, p in enumerate(signed)}
    for e in edges:
        assert ((e.u ^ e.v) & ((1 << 64) - 1)).bit_count() >= 1
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        a, b = find(at[e.u]), find(at[e.v])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == brute_components(prints, budget)


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    order = list(range(300))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199)] + [(order[i], order[200]) for i in range(201, 300)]
    got = {r.u: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    a, b = min(order[:200]), min(order[200:])
    assert all(got.get(x, x) == a for x in order[:200]) and all(got.get(x, x) == b for x in order[200:])


def test_separators_part_runs(spark):
    """Hyphenated hex and keys after prefixes are found; words joined by separators are not."""
    rng = random.Random(12)
    key = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    digits, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "the quick brown fox jumps over lazy dogs while seven silent readers wander through this ordinary village".split()
    plain = " ".join(words)
    made = [("-".join(key(digits, n) for n in (8, 4, 4, 4, 12)), True) for _ in range(40)] + [("ghp_" + key(letters, 36), True) for _ in range(40)]
    made += [(sep.join(rng.choice(words) for _ in range(7)), False) for sep in "-_" for _ in range(20)]
    rows = [(i, f"{plain} {s} {plain}", hit) for i, (s, hit) in enumerate(made)]
    got = {r.doc_id: r.spans for r in secret_scan.op1(spark.createDataFrame(rows, "doc_id long, text string, hit boolean")).collect()}
    at = len(plain) + 1
    found = [f"random:{at}:{at + len(made[i][0])}" in got[i].split(",") for i in range(len(made))]
    assert sum(found[:80]) >= 78 and not any(found[80:])


def test_keep_one(docs, rows, none):
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[7] == 1 and ids[5] == 1 and ids[None] == 1 and not any(ids[100 + i] for i in range(20))
    assert ids[90] == 1 and ids[91] == 0  # null and empty texts are alike
    assert near_copies.keep_one(none).count() == 0


def copies(rng, groups=30, length=200):
    """Texts in groups: a base, and copies with one to twelve words changed, partly of one another."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for g in range(groups):
        base = [word() for _ in range(length)]
        out.append((100 * g, " ".join(base)))
        for k in range(1, 13):
            t = list(base)
            for at in rng.sample(range(length), k):
                t[at] = word()
            out.append((100 * g + k, " ".join(t)))
            if g % 3 == 0:
                base = t  # a chain: its ends are not alike
    rng.shuffle(out)
    return out


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def brute_kept(rows):
    """Texts in order of their ids; one goes if one that stays is similar."""
    kept = {}
    for i, t in sorted(rows):
        s = grams(t)
        if not any(5 * len(s & k) >= 4 * len(s | k) for k in kept.values()):
            kept[i] = s
    return set(kept)


@pytest.mark.parametrize("unit_rows,group_bytes", [(2048, 32 << 20), (4, 9_000)])
def test_keep_one_drops_near_copies(spark, monkeypatch, unit_rows, group_bytes):
    rows = copies(random.Random(6), 30 if unit_rows > 4 else 7)
    if unit_rows == 4:
        monkeypatch.setattr(near_copies, "PEELS", 1)  # what is large after it goes in parts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.keep_one(df, unit_rows=unit_rows, group_bytes=group_bytes).collect()}
    assert kept == brute_kept(rows)


def test_gone_texts_have_one_that_stays(spark):
    rows = copies(random.Random(8), 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts, gone = near_copies.near_copies(df)
    of = {bytes(r.tid): r.rep for r in texts.collect()}
    by = {of[bytes(r.tid)]: of[bytes(r.by)] for r in gone.collect()}
    text = dict(rows)
    for i, j in by.items():
        a, b = grams(text[i]), grams(text[j])
        assert j not in by and 5 * len(a & b) >= 4 * len(a | b)


def test_similar_texts_meet():
    """At a similarity of 0.8 or more pairs share a root and stay within the budget; unlike texts never do."""
    rows = copies(random.Random(7), 40)
    sets = [grams(t) for _, t in rows]
    signed = [near_copies.signature(t) for _, t in rows]
    prints = [int.from_bytes(p, "big") for p, _ in signed]
    similar, unlike = [], []
    for i, j in itertools.combinations(range(len(rows)), 2):
        near = (prints[i] ^ prints[j]).bit_count() <= near_copies.SPARE_BITS and (signed[i][1] == signed[j][1]).any()
        if rows[i][0] // 100 != rows[j][0] // 100:
            unlike.append(near)
        elif 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            similar.append(near)
    assert len(similar) > 100 and np.mean(similar) > 0.995 and not any(unlike)


def test_sets_of_a_group():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = np.unique(rng.integers(0, 1 << 60, 40, np.uint64))
        kept, sets = near_copies.Kept(0.8), []
        for k in range(6):
            s = np.unique(np.concatenate((base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 60, rng.integers(0, 6), np.uint64))))
            want = next((i for i, t in enumerate(sets) if near_copies.similarity(s, t) >= 0.8), None)
            assert kept.similar(s) == want
            kept.add(k, s)
            sets.append(s)


# repeated byte strings ----------------------------------------------------------------------------
def brute_removed(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [8000, 2])
def test_suffix_dedup(spark, bucket, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefé ") for _ in range(420))
    texts = ["", None, "short", "x" * 199, "x" * 200, "y" * 1200, "ab" * 300]
    for i in range(25):
        own = lambda n: "".join(rng.choice("ghijklmnop ") for _ in range(n))
        a, b = sorted(rng.sample(range(421), 2))
        texts.append(own(rng.randint(0, 300)) + passage[a:b] + own(rng.randint(0, 300)))
    base = "".join(rng.choice("qrstuv wxyz") for _ in range(3000))
    for _ in range(8):
        t = list(base)
        for at in rng.sample(range(3000), rng.randint(0, 6)):
            t[at] = "Q"
        texts.append("".join(t))
    texts += [texts[10], texts[10], base, base[:1000] + base[:1000]]
    texts.append("".join(rng.choice("ABCDE") for _ in range(300_000)) + base[500:900])
    monkeypatch.setattr(suffix_dedup.repeated, "__defaults__", (bucket,))
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    want = brute_removed(texts)
    got = {r.doc_id if r.doc_id is not None else 3: tuple(r)[1:] for r in suffix_dedup.op10(df).collect()}
    assert got == dict(enumerate(want))


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup.op10(none).count() == 0


def test_pieces_cover_every_start(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    raw = bytes(random.Random(1).randrange(256) for _ in range(2000))
    starts = []
    for _, s, e, _, _ in suffix_dedup.segments([raw, b"x" * 100, raw[:250]]):
        starts += [p for a, b in zip(s, e) for p in range(a, b)]
    assert Counter(starts) == Counter([*range(1801), *range(51)])
