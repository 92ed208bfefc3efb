import random

import numpy as np
import pytest

from tests.llm import brute
from weftmark.llm import ngramlm


def _texts():
    r = random.Random(12)
    prose = lambda n, v: [f"w{int(v * r.random() ** 2)}" for _ in range(n)]
    out = [prose(r.randrange(1, 60), 40) for _ in range(40)]
    shared = prose(90, 60)
    out += [shared, [*prose(5, 40), *shared], [*shared[:50], *prose(10, 40), *shared[50:]], shared, shared]
    out += [["a", "b", "c"] * 30, ["a", "b"] * 25 + ["c"], ["a"] * 60, ["x"], [], ["q", "x"]]
    long = prose(300, 200)
    out += [long, [*long[:150], "zz", *long[150:]], [*long, *long]]
    return [" ".join(t) for t in out]


@pytest.mark.parametrize(("shard", "window"), [(10**7, (4, 4, 8, 64)), (100, (3, 64)), (60, (1, 2, 40))])
def test_against_every_context(spark, monkeypatch, shard, window):
    monkeypatch.setattr(ngramlm, "WINDOW", window)
    texts = _texts()
    plain = [*enumerate(texts), (3, texts[0]), (7, texts[7]), (100, None)]  # equal ids with another text and with the same one
    want = brute.ngram_scores(plain, ngramlm.ALPHA)
    docs = spark.createDataFrame(plain, "doc_id bigint, text string").repartition(3, "doc_id")
    got = {r.doc_id: r for r in ngramlm.scores(docs, shard=shard).collect()}
    assert set(got) == set(want)
    for i, (n, bits, depth) in want.items():
        assert got[i].n_tokens == n and (not n or (got[i].bits == pytest.approx(bits, abs=0.01) and got[i].mean_context * n == pytest.approx(depth)))


def test_string_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([("a", "x y z", 1), ("b", "x y z", 2), (None, "x", 3)], "doc_id string, text string, block int")
    got = {r.doc_id: r for r in ngramlm.scores(docs).collect()}
    assert set(got) == {"a", "b"} and got["a"].bits == got["b"].bits and got["a"].mean_context == 1.0


def test_groups_of_keys():
    """Keys that differ in their lowest bits only are told apart."""
    r = np.random.default_rng(4)
    for keys in (r.integers(0, 9, 300), r.integers(0, 1 << 62, 300), np.append(r.integers(0, 1 << 62, 9), [7, 6, 7]), np.zeros(0, np.int64), np.ones(1, np.int64)):
        _, want, sizes = np.unique(keys, return_inverse=True, return_counts=True)
        group, got = ngramlm._groups(keys.astype(np.uint64))
        assert group.tolist() == want.tolist() and got.tolist() == sizes.tolist()
