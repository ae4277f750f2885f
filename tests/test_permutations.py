"""The registered permutation tests run the operator's own number of shuffles and the older one; chunks change nothing."""

import hashlib
import inspect

import pytest

from quarry.operators import metrics
from quarry.plans import catalog
from quarry.sources.fixtures import scored

SF = "/root/testdata/sf0.001"


def test_permutation_test_of_500_shuffles(spark):
    n = inspect.signature(metrics.permutation_test).parameters["n"].default
    assert n == 500 and "range(500)" in catalog.oracle_sql()["permutation_test"] and "range(1000)" in catalog.oracle_sql()["permutation_test_full"]
    p = catalog.queries()["permutation_test"](spark, SF).first()["p_value"]
    assert abs(p * n - round(p * n)) < 1e-6


def test_chunks_of_a_week_change_nothing(spark, monkeypatch):
    rows = scored(spark, SF)
    whole = metrics.permutation_test(rows, 3, 40).first()
    monkeypatch.setattr(metrics, "CHUNK", 2)
    monkeypatch.setattr(metrics, "MERGED", 2)
    cut = metrics.permutation_test(rows, 3, 40).first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(whole, cut, strict=True))


@pytest.mark.parametrize("tails", [[b"1", b"", b"999", b"12345678901"], [b"x" * 43, "\u00e9\u20ac".encode()], [b"y" * 90, b"z"]])
def test_hashes_of_many_rows_are_md5(tails):
    heads = [b"17|2001-05-06|", b"18|2001-05-06|"]
    found = metrics.md5_words(heads, tails, metrics._tail_words(tails, len(heads[0]))).transpose(1, 2, 0)
    assert [[x.astype("<u4").tobytes() for x in row] for row in found] == [[hashlib.md5(h + t).digest() for t in tails] for h in heads]
