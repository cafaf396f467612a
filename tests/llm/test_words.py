"""Spelling variants, tokeniser fertility and branch merges against brute-force versions."""

import hashlib
import random
import re
import threading
import zlib
from collections import Counter

import numpy as np
import pytest

from consensa.llm import branch_merge, entry, fertility, spelling


# spelling variants --------------------------------------------------------------------------------
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, often=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                i = h % len(low)
                low = low[:i] + low[i + 1 :]
            n[low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= often}
    form, out = {}, {}
    for w in n:
        by = sorted((-n[v], v) for v in n if near(w, v))
        best = by[0] if by and -by[0][0] >= 5 * n[w] else None
        form[w] = best[1] if best else None
        out[w] = (n[w], len(by), -best[0] if best else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def word_rows(rng):
    """Words in families of slips, of repeated letters and accents, with counts that chain."""
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaab", "ababab", "bababa", "ÀÀÀÀÀÀ", "àààààà"]
    said = []
    for w in bases:
        for k in (1, 6, 36):
            v = w
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(v))
                v = rng.choice([v[:i] + v[i + 1 :], v[:i] + rng.choice("abé") + v[i:], v[:i] + rng.choice("abc") + v[i + 1 :]])
            said += [v.upper() if rng.random() < 0.1 and v.isascii() else v] * (5 * k if k < 36 else 190)
    said += ["chained"] * 200 + ["chainee"] * 30 + ["chaonee"] * 6
    rng.shuffle(said)
    out = [(i, " ".join(said[i * 40 : i * 40 + 40])) for i in range(len(said) // 40 + 1)]
    return [*out, (900, None), (901, ""), (None, "ababab ababab"), (5, out[5][1]), (902, "x" * 30_000 + " " + "x" * 29_999), *[(903 + i, "y" * 3000 + "." + "y" * 2999) for i in range(5)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling(spark, seed):
    rows = word_rows(random.Random(seed))
    df = spark.createDataFrame([(i, t, "w", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    got = spelling.op11(df).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(rows) and len(got) == len({r.word for r in got})
    assert any(r.form and r.root != r.form for r in got)  # chains


def test_spelling_of_nothing(none):
    assert spelling.op11(none).count() == 0


def test_deletion_hashes():
    words = ["abcdef", "aabbcc", "éabcde"]
    whole, less = spelling.deletion_hashes(np.array([[ord(c) for c in w] for w in words], np.uint64))
    for w, h, row in zip(words, whole, less):
        shorter = [w[:i] + w[i + 1 :] for i in range(6)]
        want, _ = spelling.deletion_hashes(np.array([[ord(c) for c in s] for s in shorter], np.uint64))
        assert (row == want).all()


# fertility ----------------------------------------------------------------------------------------
def brute_base(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, k in Counter(windows).items() if k > 1}
    inside = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_fertility_counts(spark, docs, rows, none):
    rng = random.Random(4)
    more = [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), None, "s", 0, "r", 1) for i in range(40)]
    more += [(2000, "a b\nc\n\na b\n \n \nc #<>|", "aa", "s", 0, "r", 1), (2001, " x y z\x0bq\x1cr \x85", "aa", "s", 0, "r", 1)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in fertility.op12(df).collect())
    want = Counter()
    for i, t, *_ in [*rows, *more]:
        b = brute_base(t)
        want[(i, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want
    assert fertility.op12(none).count() == 0


def test_fertility_verdicts(spark, rows):
    """Verdicts follow from the measures, computed anew text by text; gibberish in a language's clothes goes."""
    from statistics import quantiles

    rng = random.Random(5)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    common = [w for w in "the of and that with from this have which were been their would there about other".split()]
    texts = [(i, " ".join(rng.choice(common) for _ in range(60)), "en") for i in range(200)]
    texts += [(300 + i, say("qxzjkvw", 60), "en") for i in range(5)] + [(400 + i, say("éèêëàâ", 60), None) for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r.row.doc_id: r for r in fertility.rules(df, least=20).collect()}
    assert sum(got[i].kept for i in range(200)) >= 198 and not any(got[300 + i].kept for i in range(5))
    assert got[400].language == "latin" and got[0].row.text == texts[0][1]
    for name, i in zip(fertility.VOCABULARIES, (0, 3)):
        v = fertility.Vocabulary(name)
        for d in (0, 7, 302, 401):
            words = dict((t[0], t[1]) for t in texts)[d].split()
            tokens = [x for w in words for x in v.encode([w])[0]]
            share = np.array(list(Counter(tokens).values())) / len(tokens)
            want = [sum(map(len, words)) / len(tokens), np.mean([v.bytes[x] for x in tokens]), -(share * np.log2(share)).sum()]
            assert np.allclose(got[d].measures[i : i + 3], want, atol=0.06)
    cell = [r for r in got.values() if r.language == "en" and r.length == got[0].length and not r.base_failed]
    low, _, high = quantiles([r.measures[0] for r in cell], n=4, method="inclusive")
    mid = float(np.median([r.measures[0] for r in cell]))
    half = max(6 * (high - low) / 1.349, 0.12 * mid)
    assert all((0 in r.outside) == (not mid - half <= r.measures[0] <= mid + half) for r in cell)


def test_rare_cells_reject_nothing(spark):
    df = spark.createDataFrame([(1, "qx zj kv wq xz jk vw qx zz jj kk", "en")], "doc_id long, text string, lang string")
    assert [r.kept for r in fertility.op12(df).collect()] == [True]


def test_repeated_words():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert fertility.repeated_words(np.array([ord(w) for w in words], np.int64)) == brute_base(" ".join(words))[4]


# branch merge -------------------------------------------------------------------------------------
def brute_merge(rows):
    """Each branch is applied as a whole, then their states are compared."""
    out, added = [], {}
    mark = {1: "!", 2: "?", 3: "!", 4: "?"}
    for doc_id, text, lang, source in rows:
        name = "" if doc_id is None else doc_id
        code = lambda b, x: zlib.crc32(f"{b}:{name}:{x}".encode()) % 17  # noqa: E731, B023
        text, columns = text or "", {"lang": lang or "", "source": source or ""}
        lines, side = text.split("\n"), {}
        for b in "LR":
            row = code(b, "row")
            put = {k: "" if code(b, k) == 0 else v + mark.get(code(b, k), "") if code(b, k) in (1, 2) else v for k, v in columns.items()}
            at = [code(b, i) for i in range(len(lines))]
            state = [None if c == 0 else x + mark[c] if c in (1, 2) else x for c, x in zip(at, lines)]
            gaps = [mark[c] if c in (3, 4) else None for c in at]
            side[b] = (row, put, state, gaps, put != columns or state != lines or any(gaps))
            if row in (3, 4):
                new = (None if doc_id is None else (-1 if b == "L" else -5) - doc_id)
                added.setdefault(new, {}).setdefault(b, []).append((mark[row], columns["lang"], columns["source"]))
        (rl, pl, sl, gl, ml), (rr, pr, sr, gr, mr) = side["L"], side["R"]
        own = lambda s, g: "\n".join(x for pair in zip(s, g) for x in pair if x is not None)
        if rl == 0 or rr == 0:
            torn = (rl == 0 and rr != 0 and mr) or (rr == 0 and rl != 0 and ml)
            said = (None, None, None) if rl == 0 or not ml else (pl["lang"], pl["source"], own(sl, gl))
            out.append((doc_id, *said, int(not torn), 0, int(torn), 0))
            continue
        n, final = Counter(), {}
        for k, v in columns.items():
            final[k] = pl[k] if pl[k] != v else pr[k]
            if pl[k] != v or pr[k] != v:
                n["clean" if v in (pl[k], pr[k]) or pl[k] == pr[k] else "ee"] += 1
        text = []
        for x, a, b, g, h in zip(lines, sl, sr, gl, gr):
            y = a if a != x else b
            if a != x or b != x:
                n["clean" if x in (a, b) or a == b else "ed" if None in (a, b) else "ee"] += 1
            if g or h:
                n["clean" if not (g and h) or g == h else "ii"] += 1
            text += [z for z in (y, g or h) if z is not None]
        out.append((doc_id, final["lang"], final["source"], "\n".join(text), n["clean"], n["ee"], n["ed"], n["ii"]))
    for new, by in added.items():
        both = [min(by[b]) for b in "LR" if b in by]
        torn = len(set(both)) > 1
        out.append((new, both[0][1], both[0][2], both[0][0], int(not torn), 0, 0, int(torn)))
    return out


def merge_rows(rng):
    rows = [(i, "\n".join(rng.choice(["", "a", "bé c", "x" * 30]) for _ in range(rng.randint(1, 30))), rng.choice(["en", "", None]), rng.choice(["s", "t", None])) for i in range(500)]
    return [*rows, (700, None, None, None), (701, "", "", ""), (702, "\n" * 20_000, "en", "s"), (3, rows[3][1], "zz", "a"), rows[4], rows[4], (None, "p\nq", "en", "s"), (None, "p", None, None), (-30, "neg", "en", "s")]


def test_branch_merge(spark, none):
    rows = merge_rows(random.Random(9))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, l string, _id int")
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    want = Counter((a, b, c, sha(t), *n) for a, b, c, t, *n in brute_merge(rows))
    assert Counter(map(tuple, branch_merge.op13(df).collect())) == want
    assert all(sum(k[i] * v for k, v in want.items()) > 0 for i in (4, 5, 6, 7))
    assert branch_merge.op13(none).count() == 0
    texts = branch_merge.merge(df, branch_merge.hashed("L"), branch_merge.hashed("R"))
    assert Counter(r.text for r in texts.collect()) == Counter(t for _, _, _, t, *_ in brute_merge(rows))


def test_branches_that_agree(spark):
    """Equal branches never conflict, and a branch without changes takes the other's state."""
    rows = [r for r in merge_rows(random.Random(2)) if r[0] is not None and r[0] >= 0]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left, idle = branch_merge.hashed("L"), lambda name: "9"
    same = branch_merge.merge(df, left, left, right_id="-1 - doc_id")
    one = branch_merge.merge(df, left, idle)
    key = lambda r: (r.doc_id, r.text or "", r.lang or "", r.n_clean)
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert same.filter("n_edit_edit + n_edit_delete + n_insert_insert > 0").isEmpty()


@pytest.mark.parametrize("name", ["op11_spelling", "op13_branch_merge"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    df = entry.QUERIES[name](spark, where)
    rel = con.sql(entry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = Counter(map(tuple, rel.select(*df.columns).fetchall()))
    assert Counter(map(tuple, df.collect())) == want and want


# calls at the same time -----------------------------------------------------------------------------
def test_queries_run_at_the_same_time(spark):
    """Calls in threads of one session leave one another's tables alone and give what they give alone."""
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    names = ("op2_source_mix", "op5_ann_bits", "op6_url_filter", "op7_pivot_topk", "op8_simhash", "op10_suffix_dedup", "op11_spelling", "op12_fertility")
    calls = {n: (lambda n=n: entry.QUERIES[n](spark, where)) for n in names} | {"pipeline": lambda: corpus_pipeline.run(spark, where)}
    read = lambda f: Counter(str(r) for r in f().collect())
    got, failed = {}, {}

    def call(name):
        try:
            got[name] = read(calls[name])
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]

    threads = [threading.Thread(target=call, args=(n,)) for n in calls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    for name in ("op2_source_mix", "op7_pivot_topk", "op8_simhash", "op11_spelling"):
        assert got[name] == read(calls[name]), name
    assert len(got["pipeline"]) > 0
