import math
import random

import numpy as np
import pytest

from weftmark.llm import langid, mixing


def _ppm(samples, order, least, language, text):
    """Bits of a text, byte by byte, from counts of the contexts as they are."""
    count = {x: {} for x in samples}
    for x, texts in samples.items():
        for t in texts:
            for n in range(1, order + 2):
                for i in range(len(t) - n + 1):
                    count[x][t[i : i + n]] = count[x].get(t[i : i + n], 0) + 1
    total = {}
    for c in count.values():
        for k, v in c.items():
            total[k] = total.get(k, 0) + v
    nodes = {k for k, v in total.items() if len(k) <= order and v >= least} | {b""}

    def cost(context, byte):
        seen = {k[-1:]: v for k, v in count[language].items() if k[:-1] == context and len(k) == len(context) + 1}
        shorter = context[1:]
        while shorter not in nodes:
            shorter = shorter[1:]
        if not seen:
            return cost(shorter, byte) if context else 8.0
        t, q = sum(seen.values()), len(seen)
        if byte in seen:
            return math.log2((t + q) / seen[byte])
        return math.log2((t + q) / q) + (cost(shorter, byte) if context else 8.0)

    bits = 0.0
    for i in range(len(text)):
        context = next(text[j:i] for j in range(max(i - order, 0), i + 1) if all(text[k:i] in nodes for k in range(j, i + 1)))
        bits += cost(context, text[i : i + 1])
    return bits


def test_code_lengths_against_context_trees():
    r = random.Random(16)
    samples = {x: [bytes(r.choice(a) for _ in range(60)) for _ in range(4)] for x, a in (("x", b"aab"), ("y", b"abcc"), ("z", b"cde"))}
    model = langid.train(samples, order=3, least=4)
    texts = [bytes(r.choice(b"abcdeq") for _ in range(n)) for n in (0, 1, 7, 40)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    got = langid.code_lengths(model, raw, np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        for k, x in enumerate(model.languages):
            assert got[i, k] == pytest.approx(_ppm(samples, 3, 4, x, t), rel=1e-5)
    with pytest.raises(ValueError):
        langid.train(samples, order=8)


def test_mixing_of_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i % 7}-{i}", "word " * (i % 5), f"s{i % 2}") for i in range(60)] + [(None, "x", "s0"), ("d1-1", "y", "s0")], "doc_id string, text string, source string")
    out = mixing.sample(docs)
    sizes = {r.source: r for r in mixing.expected_copies(docs).collect()}
    n = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    for s, k in {r.source: r["count"] for r in out.groupBy("source").count().collect()}.items():
        assert abs(k - n[s] * sizes[s].micro / mixing.MICRO) <= 1
