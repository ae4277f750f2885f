"""Fingerprints, spelling variants and periodic runs against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from quarry.llm import fingerprints, periodic, spelling  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, hash string, n string, runs string"
LONG_RUN = "ab" * 700 + "c" + "xyz" * 500
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three"), (None, None), (4, "Same words here twice over"), (4, "Same words here twice over"), (4, "other text"), (5, "日本語 𝄞𝄞 é" * 9), (6, "x" * 5000), (7, "La " * 3000), (2**62, LONG_RUN), (-(2**62), LONG_RUN), (8, LONG_RUN[:900] + "q" + LONG_RUN[900:]), (9, LONG_RUN[:900] + "q" + LONG_RUN[900:])]


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "w", "h", "n", "r") for k, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# fingerprints


def brute_tuples(spark, text):
    """The tuples of k-mer hashes, from the hashes that Spark gives the k-mers and numbered pairs."""
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    if not words:
        return []
    grams = [words[i : i + 3] for i in range(max(len(words) - 2, 1))]
    own = dict(spark.createDataFrame([(str(i), *(g + [None] * 3)[:3]) for i, g in enumerate(grams)], "i string, a string, b string, c string").selectExpr("i", "xxhash64(a, b, c)").collect())
    g = [own[str(i)] for i in range(len(grams))]
    bits, seen, pairs = len(bin(len(g))) - 2, collections.Counter(), []
    upper = lambda h: (h % 2**64) >> (bits + 1)
    later = []
    for i, h in enumerate(g):
        seen[upper(h)] += 1
        (pairs if seen[upper(h)] == 1 else later).append((h, seen[upper(h)], i))
    again = dict(spark.createDataFrame([(i, h, n) for h, n, i in later], "i long, h long, n int").selectExpr("i", "xxhash64(h, n)").collect()) if later else {}
    circle = sorted([(upper(h) << bits | i) for h, _, i in pairs] + [(upper(again[i]) << bits | i) for _, _, i in later])
    out = []
    for b in range(fingerprints.BINS):
        at = sum(x < b << 58 for x in circle)
        out.append(tuple(g[i] for i in sorted({circle[(at + j) % len(circle)] & ((1 << bits) - 1) for j in range(min(2, len(circle)))})))
    return out


def test_fingerprints_take_the_first_pairs_in_text_order(spark, texts):
    docs = [*texts[:12], (10**6, "a b c a b c a b c d e f a b c"), (10**6 + 1, "one"), (10**6 + 2, "x " * 200), (10**6 + 3, "p q r s")]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, t in docs:
        tuples = brute_tuples(spark, t or "")
        width = max(map(len, tuples), default=0)
        rows = [(i, *x) for i, x in enumerate(tuples)]
        want = dict(spark.createDataFrame(rows, ", ".join(["i int", *(f"c{j} long" for j in range(width))])).selectExpr("i", f"lpad(hex(cast(hash({', '.join(f'c{j}' for j in range(width))}) as bigint) & 4294967295), 8, '0')").collect()) if rows else {}
        assert got[k] == "".join(want[i] for i in range(len(rows)))


def test_fingerprints_see_order_and_edits(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    moved = words[300:] + words[:300]
    few = list(words)
    for i in (50, 250, 450):
        few[i] = "new"
    shuffled = [x for i in range(0, 600, 3) for x in rng.sample(words[i : i + 3], 3)]
    rows = [(i, " ".join(w)) for i, w in enumerate((words, words, few, moved, shuffled))]
    a, same, b, c, d = (r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())
    pairs = spark.createDataFrame([(a, same), (a, b), (a, c), (a, d), ("", ""), (a, "")], "a string, b string")
    near = [r[0] for r in pairs.select(fingerprints.likeness(pairs.a, pairs.b)).collect()]
    assert near[0] == 1 and near[1] > 0.8 and near[3] == 0 and 0.3 < near[2] < near[1] and near[4:] == [1, 0]


def check_edits(rows, docs):
    """docs are (id, text) in any order; equal rows count once."""
    once = sorted({(k, t or "") for k, t in docs}, key=lambda x: (x[0] is None, -(x[0] or 0), common_hash(x[1], x[0] is None)))
    want = {}
    for i, (k, t) in enumerate(once):
        half = len(t) // 2
        edited = t[: len(t) - half] + once[(i + 1) % len(once)][1][:half]
        want[k, hashlib.sha256(edited.encode()).hexdigest(), len(t)] = sum((a, b or "") == (k, t) for a, b in docs)
    assert collections.Counter((r.doc_id, r.edited_sha256, r.n_chars) for r in rows) == want


def common_hash(text, no_id):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    if (text, no_id) not in _HASHES:
        _HASHES[text, no_id] = SparkSession.active().createDataFrame([(text, no_id)], "t string, n boolean").select(F.xxhash64("t", "n")).first()[0]
    return _HASHES[text, no_id]


_HASHES: dict[tuple[str, bool], int] = {}


def test_op11_edits_and_cases(spark, texts, odd, empty):
    rows = fingerprints.op11_fingerprints(spark, SF).collect()
    check_edits(rows, texts)
    by_id, order = {r.doc_id: r for r in rows}, sorted((k for k, _ in texts), reverse=True)
    for i, k in enumerate(order):
        a, b, c = (np.array([x[j : j + 8] for j in range(0, 256, 8)]) for x in (by_id[k].fingerprint, by_id[k].edited_fingerprint, by_id[order[(i + 1) % len(order)]].fingerprint))
        assert by_id[k].near_edited == (a == b).mean() and by_id[k].near_next == (a == c).mean()
    check_edits(fingerprints.edit_report(odd).collect(), ODD)
    assert fingerprints.edit_report(empty).count() == 0
    alone = fingerprints.edit_report(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert alone.near_next == 1


def test_op11_has_no_python_in_its_plan(spark):
    plan = fingerprints.op11_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# spelling variants


def brute_variants(count):
    words = {w: n for w, n in count.items() if n >= 2}
    less, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i] + "\0" + w[i + 1 :]].add(w)
            if (u := w[:i] + w[i + 1 :]) in words:
                near[w].add(u)
                near[u].add(w)
    for same in less.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: u for w in words if near[w] for u in [min(near[w], key=lambda u: (-words[u], u))] if words[u] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def brute_words(docs):
    lower, count = str.maketrans(spelling._LOWER[0], spelling._LOWER[1]), collections.Counter()
    for k, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    return count


def test_op12_equals_brute_force(spark, texts, odd, empty):
    got = [tuple(r) for r in spelling.op12_spelling_variants(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(brute_words(texts))
    rows = [tuple(r) for r in spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.letter_runs(odd)))).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_variants(brute_words(ODD)) and max(len(w) for w, *_ in rows) > 2000
    assert spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.letter_runs(empty)))).count() == 0


@pytest.mark.parametrize("long", [64, 9])
def test_variants_of_crowded_words(spark, monkeypatch, long):
    """Few letters, so that all edits at all places occur; long words from 9 letters on in one run; all nodes hot."""
    monkeypatch.setattr(spelling, "LONG", long)
    monkeypatch.setattr(spelling, "HOT_ROWS", 2)
    monkeypatch.setattr(spelling, "HOT_SHARE", 10**9)
    rng = random.Random(2)
    count = {"".join(rng.choice("aabé") for _ in range(rng.randrange(7, 13))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(700)}
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(count)


# periodic runs


def brute_runs(w):
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


@pytest.mark.parametrize(("scan", "rounds"), [(2048, 64), (0, 64), (0, 1), (40, 2)])
def test_runs_equal_all_lags(monkeypatch, scan, rounds):
    monkeypatch.setattr(periodic, "SCAN", scan)
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng = random.Random(3)
    for _ in range(120):
        n, v = rng.choice([5, 12, 30, 60, 150, 300]), rng.choice([1, 2, 3, 5, 50])
        w = [rng.randrange(v) for _ in range(n)]
        if rng.random() < 0.6 and n > 12:
            a, q = rng.randrange(n), rng.randrange(1, n // 2)
            w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)] + [rng.randrange(v) for _ in range(rng.choice([0, 20]))]
        ids, doc = np.array([*w, 0, *w]), np.array([0] * len(w) + [1] + [2] * len(w))
        got = {0: [], 1: [], 2: []}
        for at in periodic.surviving(ids, doc):
            d = int(doc[at[0]])
            got[d] += [(int(at[s]) - d * (len(w) + 1) // 2, length, q) for s, length, q in periodic.runs_in(ids[at])]
        assert sorted(got[0]) == brute_runs(w) and got[1] == [] and len(got[2]) == len(got[0])


def brute_row(k, t):
    w = words_of(t)
    h = zlib.crc32(str(k).encode())
    g, n = h // 10, len(w)
    if k is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (k, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(kept)))


def test_op13_equals_brute_force(spark, texts, odd, empty):
    small = [(k, t) for k, t in texts if len(t or "") < 20000]
    got = {r.doc_id: tuple(r) for r in periodic.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(texts) and {k: got[k] for k, _ in small} == {k: brute_row(k, t) for k, t in small}
    assert sum(r[1] > 0 for r in got.values()) > 5
    rows = periodic.periodic_runs(odd).collect()
    assert collections.Counter((r.doc_id, r.n_words) for r in rows) == collections.Counter((k, len(words_of(t))) for k, t in ODD)
    assert next(r for r in rows if r.doc_id == 7).runs[0].asDict() == {"start": 0, "length": 3000, "period": 1} and next(r for r in rows if r.doc_id == 7).collapsed == "La"
    assert periodic.periodic_runs(empty).count() == 0


def test_words_are_told_apart_by_their_bytes(spark):
    """Two long words that a polynomial hash modulo 2**64 takes for one."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, " ".join([a, b] * 7)), (2, " ".join([a] * 14))], "doc_id long, text string")
    assert {r.doc_id: r.runs[0].period for r in periodic.periodic_runs(docs).collect()} == {1: 2, 2: 1}


def test_unseen_parts_go_to_the_tokenizer_together():
    """op3's time went into one call for each unseen word."""
    import public_tokenizers
    import pyarrow as pa

    from quarry.llm.encoding import Encoder

    words = [f"{a}{b}" for a in ("alpha", "beté", "Gam", "ßö", "don't", "x9", "$$$", "日本", "é") for b in ("rol", "sun,", "'s", "&&&", " z", "7.", "\tq", "<|endoftext|>y")]
    texts = [" ".join(words), "\n".join(words[::-1]), "".join(f"{w} \n\n " for w in words), "", " ", "\t \n", "one", "<|endoftext|>", " a\t", "\n b"]
    for sizes_known in (True, False):
        encoder, alone = Encoder(public_tokenizers.path("byte_bpe_50k.json"), spaces=True), []
        if not sizes_known:  # nothing is taken from the text of all parts, unless it can be cut
            encoder.sizes[:] = 7
        make = encoder.words.make
        encoder.words.make = lambda word, make=make, alone=alone: alone.append(word) or make(word)
        assert encoder.encode_each(pa.array(texts)) == [encoder.whole(t) for t in texts]
        plain = [w for w in alone if w[:1] == " " and w[1:].isalpha()]
        assert (not plain) == sizes_known
