"""Cases that were once wrong: hashes that clash, odd white space, unique texts under a repeated id, bounds."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from quarry.llm import common, encoding, jaccard, neighbours, sentencepiece, token_counts, toxicity  # noqa: E402
from quarry.llm.encoding import Encoder  # noqa: E402

TOKENIZERS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def thue_morse():
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def library_ids(e, t):
    return e.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaces"), TOKENIZERS)
@pytest.mark.parametrize("same_hash", [False, True])
def test_words_with_one_hash_keep_their_ids(monkeypatch, name, spaces, same_hash):
    if same_hash:  # all parts of a length clash
        monkeypatch.setattr(encoding, "byte_hashes", lambda data, start, end: (end - start).astype(np.uint64))
        monkeypatch.setattr(common, "byte_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    e = Encoder(public_tokenizers.path(name), spaces)
    a, b = thue_morse()
    every = [f"{a} {b} {a}", b, f"x {b}", "the cat sat on the mat", "dog dig dug", "abcdefgh abcdefgi", f"{a[:300]} {b[:300]} {a[:300]}", a, "cat dig"]
    for _ in range(2):
        for t, got in zip(every, e.encode_each(pa.array(every)), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library_ids(e, t)


def test_pieces_with_one_hash_keep_their_ids(monkeypatch):
    import sentencepiece as library

    monkeypatch.setattr(sentencepiece, "byte_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = library.SentencePieceProcessor(model_file=path), sentencepiece.Pieces.of(path)
    monkeypatch.setattr(own, "known", encoding.Known(own.known.make))
    a, b = thue_morse()
    every = [f"{a} {b} {a}", b, "the cat sat on the mat", "dog dig dug"]
    ids, ends = own.encode(pa.array(every))
    for t, got in zip(every, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == model.encode(t) and own.decode(got) == t


def test_known_parts_are_forgotten_without_harm(monkeypatch):
    for name, value in (("MAX_PARTS", 50), ("MAX_BLOCKS", 200), ("FRESH", 20)):
        monkeypatch.setattr(encoding, name, value)
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    rng = np.random.default_rng(1)
    for _ in range(12):
        every = [" ".join(f"w{x}" * int(1 + x % 7) for x in rng.integers(0, 90, 40)) for _ in range(5)]
        for t, got in zip(every, e.encode_each(pa.array(every)), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library_ids(e, t)


def test_thue_morse_words_have_hashes_of_their_own():
    w = common.Words.of(pa.array([" ".join(thue_morse())]))
    assert w.hashes[0] != w.hashes[1]
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 3000).astype(np.uint64)
    where = [(0, 5), (7, 12), (100, 100), (0, 3000), (2999, 3000)]
    values[7:12] = values[0:5]
    got = common.range_hash(values, *(np.array(x) for x in zip(*where, strict=True)))
    for (a, b), h in zip(where, got, strict=True):
        sums = [sum((int(v) >> 31 * k & common._PRIME) * pow(base, i, common._PRIME) for i, v in enumerate(values[a:b])) % common._PRIME for k, base in enumerate(common._BASES)]
        want = (sums[0] << 31 | sums[1]) + (b - a) * common._STEP & common._MASK
        assert h == common.mix(np.array([want], np.uint64))[0]
    assert got[0] == got[1]


@pytest.mark.parametrize(("name", "spaces"), TOKENIZERS)
def test_odd_white_space(name, spaces):
    e = Encoder.of(public_tokenizers.path(name), spaces)
    odd = [" ", "\n", "\x85", "\xa0", "\x1c", "\x1d", "\x1e", "\x1f"]
    every = ["".join(x) for n in range(1, 5) for x in itertools.product(odd, repeat=n)]
    every += [f"a{x}b" for x in every if len(x) == 3]
    for t, got in zip(every, e.encode_each(pa.array(every)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library_ids(e, t), ascii(t)


def test_op10_on_words_with_one_hash(spark):
    a, b = thue_morse()
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(1, f"{a} {b}"), (2, " \x85\x1c"), (3, None), (4, b)]
    e = Encoder.of(path, True)
    got = {r.doc_id: r.length for r in token_counts.lengths(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()}
    assert got == {k: len(library_ids(e, t or "")) for k, t in docs}


def test_keep_one_loses_no_unique_text(spark):
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    a, b, c, d, e = (plain(60) for _ in range(5))
    near_b = " ".join([*b.split()[:-1], "other"])
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "y"), (9, near_b, "z"), (None, c, "n"), (None, c, "m"), (None, d, "n"), (3, d, "p"), (7, "", "q"), (7, "", "q"), (8, e, "s"), (8, e.upper(), "t"), (None, near_b, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    got = jaccard.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text, r.cls) for r in got.collect()), key=repr)
    assert len(kept) == 7 and {(k, t) for k, t, _ in kept} == {(1, a), (5, b), (None, c), (3, d), (7, ""), (8, e.upper())}
    assert jaccard.keep_one(df.limit(0)).count() == 0
    again = sorted(((r.doc_id, r.text, r.cls) for r in jaccard.keep_one(df.orderBy("cls", F_desc())).collect()), key=repr)
    assert again == kept


def F_desc():
    from pyspark.sql import functions as F

    return F.col("text").desc()


def test_samples_are_bounded_in_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(7, rng.normal(size=8).tolist()) for _ in range(3000)] + [(i, rng.normal(size=8).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert common.sampled(df, "vec_id", 500).count() == 500
    found = neighbours.nearest(df, df.where("vec_id = 100"), sample_rows=500).collect()
    assert len(found) == 10


def test_a_first_text_beyond_the_bound_is_left_out(spark):
    words = ["plain", "words", "of", "peace", "and", "quiet"]
    docs = [(i, " ".join(words[(i + j) % 6] for j in range(8)) + (" poison." if i % 2 else " honey.")) for i in range(400)]
    long = min((i for i, _ in docs), key=lambda i: spark.range(1).selectExpr(f"xxhash64({i}L)").first()[0] if i % 50 == 0 else 2**64)
    docs[long] = (long, "plain " * 3000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.train(df, labels, max_words=2900)
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert model is not None and np.mean([scores[i] for i in range(1, 400, 2)]) > 0.7 > 0.3 > np.mean([scores[i] for i in range(0, 400, 2) if i != long])


def test_op1_query_equals_the_library(spark):
    import zlib

    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = sentencepiece.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id])
        assert (r.ids, r.n_ids, r.ids_crc32, r.round_trip) == (ids, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert r.n_bytes == sum(model.is_byte(i) for i in ids)


def test_op10_query_equals_plain_counts(spark):
    e = Encoder.of(public_tokenizers.path("byte_bpe_50k.json"), True)
    sizes = [len(library_ids(e, r.text or "")) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = token_counts.op10_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.limit for r in rows} == set(sizes) and len(rows) == len(set(sizes))
    for r in rows:
        cut = sum(min(n, r.limit) for n in sizes)
        assert (r.n_docs, r.docs_at_most, r.docs_over) == (sizes.count(r.limit), sum(n <= r.limit for n in sizes), sum(n > r.limit for n in sizes))
        assert (r.tokens_at_most, r.tokens_over) == (sum(n for n in sizes if n <= r.limit), sum(n for n in sizes if n > r.limit))
        assert (r.truncated_total, r.tokens_lost) == (cut, sum(sizes) - cut) and abs(r.quantile - r.docs_at_most / len(sizes)) < 1e-12
