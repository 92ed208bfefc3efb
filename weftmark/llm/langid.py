"""Language identification by prediction by partial matching (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.textbytes import pieces
from weftmark.operators.lexing import spread

#: Labelled documents that each language's model is trained on at most; those of the smallest id hashes are taken.
MAX_PER_LANGUAGE = 150
#: Bytes of context of the deepest nodes, and occurrences in all languages that a node needs.
ORDER, LEAST = 4, 8
#: Bytes that lie in one of the parallel lanes of the automaton.
LANE = 512


@dataclass(frozen=True)
class Model:
    """One automaton over the contexts of all languages.

    state * n_symbols + symbol -> following state * n_symbols (move) and bits
    for each language (cost). The state is the longest context in the trees
    that the text before ends with.
    """

    languages: tuple[str, ...]
    symbols: np.ndarray
    n_symbols: int
    move: np.ndarray
    cost: np.ndarray


def _counts(texts: list[bytes], order: int) -> dict[bytes, int]:
    """Occurrences of every string of 1 to order + 1 bytes, within texts."""
    out: dict[bytes, int] = {}
    for n in range(1, order + 2):
        keys = []
        for t in texts:
            raw = np.frombuffer(t, np.uint8).astype(np.uint64)
            if len(raw) >= n:
                k = np.zeros(len(raw) - n + 1, np.uint64)
                for j in range(n):
                    k = (k << np.uint64(8)) | raw[j : len(raw) - n + 1 + j]
                keys.append(k)
        if keys:
            values, counts = np.unique(np.concatenate(keys), return_counts=True)
            out |= {int(v).to_bytes(n, "big"): c for v, c in zip(values.tolist(), counts.tolist(), strict=True)}
    return out


def train(samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST) -> Model:
    """PPM context trees of depth ``order``, method C, with frozen counts, joined to one automaton.

    In a context seen T times with q distinct successors, a successor seen c
    times costs log2((T + q) / c) bits; any other costs the escape,
    log2((T + q) / q), and its cost in the context without the first byte. Below
    order 0 all 256 bytes cost 8 bits. Nodes are those contexts that occur
    ``least`` times in all languages together; a language without a node of the
    tree goes on with the shorter context at no cost.
    """
    if not 0 <= order <= 7:
        raise ValueError("order must be within 0 and 7, as a context and its successor are counted in 8 bytes")
    languages = tuple(sorted(samples))
    counts = [_counts(samples[x], order) for x in languages]
    used = np.unique(np.frombuffer(b"".join(t for ts in samples.values() for t in ts), np.uint8)) if any(map(len, samples.values())) else np.zeros(0, np.uint8)
    symbols = np.full(256, len(used), np.int64)  # bytes never seen share one symbol
    symbols[used] = np.arange(len(used))
    other, end = len(used), len(used) + 1
    width = len(used) + 2
    total: dict[bytes, int] = {}
    for c in counts:
        for k, v in c.items():
            if len(k) <= order:
                total[k] = total.get(k, 0) + v
    nodes = [b"", *sorted((k for k, v in total.items() if v >= least), key=lambda k: (len(k), k))]
    number = {k: i for i, k in enumerate(nodes)}
    after: list[dict[bytes, list[tuple[int, int]]]] = []
    for c in counts:
        by: dict[bytes, list[tuple[int, int]]] = {}
        for k, v in c.items():
            if k[:-1] in number:
                by.setdefault(k[:-1], []).append((k[-1], v))
        after.append(by)
    move = np.zeros((len(nodes), width), np.int64)
    cost = np.zeros((len(nodes), width, len(languages)), np.float32)
    for i, node in enumerate(nodes):
        shorter = number.get(node[1:], 0) if node else 0
        k = node[1:]
        while node and k not in number:
            k = k[1:]
        shorter = number[k] if node else 0
        move[i] = move[shorter] if node else 0
        if len(node) < order:
            for b in used.tolist():
                if (to := number.get(node + bytes([b]))) is not None:
                    move[i, symbols[b]] = to
        move[i, end] = 0
        for x in range(len(languages)):
            base = cost[shorter, :, x].astype(np.float64) if node else np.full(width, 8.0)
            seen = after[x].get(node)
            if seen:
                t, q = sum(v for _, v in seen), len(seen)
                base = base + np.log2((t + q) / q)
                for b, v in seen:
                    base[symbols[b]] = np.log2((t + q) / v)
            cost[i, :, x] = base
        cost[i, end] = 0
    return Model(languages, symbols, width, (move * width).astype(np.int32).reshape(-1), cost.reshape(len(nodes) * width, len(languages)))


def code_lengths(model: Model, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language's model; every text starts with no context.

    The symbols of all texts, an end mark between them, are laid out in lanes
    that advance together. A lane first runs over the ORDER symbols before it,
    after which its state no longer depends on anything earlier.
    """
    n_docs = len(offsets) - 1
    width = model.n_symbols
    sizes = np.diff(offsets)
    symbol = np.full(len(text) + n_docs, width - 1, np.int32)
    place = np.arange(len(text)) + np.repeat(np.arange(n_docs), sizes)
    symbol[place] = model.symbols[text]
    total, warm = len(symbol), 8
    lanes = max(1, -(-total // LANE))
    padded = np.full(warm + lanes * LANE, width - 1, np.int32)
    padded[warm : warm + total] = symbol
    grid = np.lib.stride_tricks.sliding_window_view(padded, LANE + warm)[::LANE].T.copy()
    state = np.zeros(lanes, np.int32)
    bits = np.zeros((LANE, lanes, len(model.languages)), np.float32)
    for t in range(warm + LANE):
        key = state + grid[t]
        if t >= warm:
            np.take(model.cost, key, axis=0, out=bits[t - warm])
        state = model.move[key]
    flat = bits.transpose(1, 0, 2).reshape(-1, len(model.languages))[:total]
    starts = offsets[:-1] + np.arange(n_docs)
    return np.add.reduceat(flat, starts, axis=0, dtype=np.float64) if n_docs else np.zeros((0, len(model.languages)))


def train_on(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, least: int = LEAST) -> Model:
    """``train`` on the at most ``max_per_language`` documents of each language that have the smallest id hashes."""
    from pyspark.sql import Window

    ids = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc_id).isNotNull()).select(F.col(lang).alias("_l"), F.col(doc_id).alias("_id"), F.xxhash64(doc_id).alias("_h"))
    picked = ids.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_id"))).where(F.col("_n") <= max_per_language).select("_id").distinct()
    texts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_d"), F.col(lang).alias("l"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(picked), F.col("_d") == F.col("_id")).select("l", "t").collect()
    samples: dict[str, list[bytes]] = {}
    for l, t in sorted((r.l, r.t) for r in rows):
        samples.setdefault(l, []).append(t.encode())
    return train(samples, order, least)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, language, bits (of the best), margin, n_bytes, code_lengths.

    The language is that whose model codes the text's bytes in the fewest bits;
    equal lengths go to the language that sorts first. margin: bits by which the
    second best is longer, null with one language. code_lengths: language -> bits.

    Null, empty texts and a model without languages have the null language,
    bits and margin. Repeated rows give repeated results; null ids are kept;
    other columns are left out. Whole texts are coded, of any length.
    """
    rows = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            for at, raw, offsets in pieces(batch.column(1), 1 << 20):
                n = len(offsets) - 1
                sizes = np.diff(offsets)
                none = (sizes == 0) | (len(names) == 0)
                bits = code_lengths(m, raw, offsets) if len(names) else np.zeros((n, 0))
                best = bits.argmin(axis=1) if len(names) else np.zeros(n, np.int64)
                order = np.sort(bits, axis=1)
                maps = pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), pa.array(np.tile(names, n), pa.string()), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(names[best] if len(names) else [None] * n, pa.string(), mask=none),
                        pa.array(order[:, 0] if len(names) else np.zeros(n), pa.float64(), mask=none),
                        pa.array(order[:, 1] - order[:, 0] if len(names) > 1 else np.zeros(n), pa.float64(), mask=none | (len(names) < 2)),
                        pa.array(sizes.astype(np.int64)),
                        maps,
                    ],
                    names=["_key", "language", "bits", "margin", "n_bytes", "code_lengths"],
                )

    return spread(rows).mapInArrow(run, f"_key {kind}, language string, bits double, margin double, n_bytes bigint, code_lengths map<string,double>").withColumnRenamed("_key", doc_id)
