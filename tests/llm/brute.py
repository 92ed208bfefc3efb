"""Slow and plain versions of what the operators compute, for comparison."""

from __future__ import annotations

import math
import re


def words(text: str | None) -> list[str]:
    return [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(rb"[A-Za-z0-9_\x80-\xff]+", (text or "").encode())]


def ngram_scores(docs: list[tuple[int, str | None]], alpha: float) -> dict[int, tuple[int, float, int]]:
    """doc -> (tokens, bits, summed lengths of the longest matching contexts), by trying every context."""
    texts = [(i, words(t)) for i, t in docs]
    total = sum(len(w) for _, w in texts)
    places: dict[str, list[tuple[int, int]]] = {}
    for d, (_, w) in enumerate(texts):
        for i, x in enumerate(w):
            places.setdefault(x, []).append((d, i))
    out = {i: (0, 0.0, 0) for i, _ in docs}
    for d, (doc, w) in enumerate(texts):
        for i, x in enumerate(w):
            share = len(places[x]) / total
            p, depth = share, 0
            ends = [(e, j) for e, j in places[w[i - 1]] if (e, j) != (d, i - 1)] if i else []
            while ends:
                depth += 1
                found = ends
                ends = [(e, j) for e, j in ends if depth < i and j >= depth and texts[e][1][j - depth] == w[i - 1 - depth]]
            if depth:
                c = len(found)
                followed = sum(j + 1 < len(texts[e][1]) and texts[e][1][j + 1] == x for e, j in found)
                p = (followed + alpha * share) / (c + alpha)
            n, bits, s = out[doc]
            out[doc] = (n + 1, bits - math.log2(p), s + depth)
    return out
