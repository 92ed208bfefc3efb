"""k-gram hashes, winnowing and fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmark.functions.symbols import MODULUS
from weftmark.operators.lexing import Lexed, key_type, map_lexed
from weftmark.operators.normalize import redundant
from weftmark.options import Options

# -- inside a task: whole documents as arrays ---------------------------------------------------------------------


def gram_hashes(symbols: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of every k symbols in a row within a document, base 256 modulo 1e9 + 7."""
    if k <= 0:
        raise ValueError("k must be positive")
    n = len(symbols)
    hash_ = np.zeros(max(n - k + 1, 0), np.int64)
    for j in range(k if n >= k else 0):
        hash_ = (hash_ * 256 + symbols[j : n - k + 1 + j]) % MODULUS
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    first = np.repeat(bounds[:-1], counts)
    out = np.concatenate([[0], np.cumsum(counts)])
    return hash_[first + np.arange(out[-1]) - np.repeat(out[:-1], counts)], out


def winnowed(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each pick among the hashes, bounds): of every ``window`` hashes of a document the least, the last one on ties; a shorter document keeps one."""
    if window <= 0:
        raise ValueError("window must be positive")
    counts = np.diff(bounds)
    n = len(hashes)
    best = (hashes << 32) | ((1 << 32) - 1 - (np.arange(n) - np.repeat(bounds[:-1], counts)))
    span = 1
    while span < window:  # the least of ``span`` values from each on
        step = min(span, window - span)
        best = np.append(np.minimum(best[:-step], best[step:]), best[n - step :]) if n > step else best
        span += step
    whole = np.arange(n) <= np.repeat(bounds[1:] - window, counts)
    short = np.flatnonzero((counts > 0) & (counts < window))
    least = np.full(len(counts), -1)
    for d in short.tolist():
        own = hashes[bounds[d] : bounds[d + 1]]
        least[d] = bounds[d] + len(own) - 1 - int(own[::-1].argmin())
    owner = np.repeat(np.arange(len(counts)), counts)
    picked = bounds[:-1][owner] + ((1 << 32) - 1 - (best & ((1 << 32) - 1)))
    picked, owner = picked[whole], owner[whole]
    new = np.append(True, (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1]))[: len(picked)]
    at = np.union1d(picked[new], least[least >= 0])
    return at, np.searchsorted(at, bounds)


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _normalized(x: Lexed, options: Options) -> tuple[Lexed, np.ndarray]:
    """(kept tokens, parentheses collapsed in each text)."""
    if not options.normalize or options.lexer == "verbatim":
        return x, np.zeros(len(x.bounds) - 1, np.int64)
    keep, collapsed = redundant(x)
    return x.where(keep), np.diff(np.concatenate([[0], np.cumsum(collapsed)])[x.bounds])


def parse(docs: DataFrame, options: Options = Options(), key: str = "doc_id", source: str = "text", with_picks: bool = True) -> DataFrame:
    """One row a document: doc_id, tokens, kgrams, fingerprints (counts), parens_collapsed, picks and prints.

    picks: structs of pos, hash, and the bytes (offset, length) of the pick's k
    tokens, by position; prints: the distinct hashes, ascending. All of it comes
    from one pass over the text, and nothing is shuffled. ``with_picks``: False
    leaves picks null, for readers of prints alone.
    """
    k = options.k
    pick = pa.struct([("pos", pa.int64()), ("hash", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def rows(keys: pa.Array, x: Lexed) -> pa.RecordBatch:
        x, collapsed = _normalized(x, options)
        hashes, grams = gram_hashes(x.symbols(), x.bounds, k)
        at, bounds = winnowed(hashes, grams, options.window)
        pos = at - np.repeat(grams[:-1], np.diff(bounds))
        token = pos + np.repeat(x.bounds[:-1], np.diff(bounds))
        begin = x.offset[token]
        length = x.offset[token + k - 1] + x.length[token + k - 1] - begin
        owner = np.repeat(np.arange(len(keys)), np.diff(bounds))
        order = np.lexsort((hashes[at], owner))
        sorted_, by = hashes[at][order], owner[order]
        new = np.append(True, (sorted_[1:] != sorted_[:-1]) | (by[1:] != by[:-1]))[: len(at)]
        prints = np.searchsorted(by[new], np.arange(len(keys) + 1))
        places = _lists(pa.StructArray.from_arrays([pa.array(pos), pa.array(hashes[at]), pa.array(begin), pa.array(length)], fields=list(pick)), bounds) if with_picks else pa.nulls(len(keys), pa.list_(pick))
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(np.diff(x.bounds)), pa.array(np.diff(grams)), pa.array(np.diff(prints)), pa.array(collapsed), places, _lists(pa.array(sorted_[new]), prints)],
            names=["doc_id", "tokens", "kgrams", "fingerprints", "parens_collapsed", "picks", "prints"],
        )

    schema = f"doc_id {key_type(docs, key)}, tokens bigint, kgrams bigint, fingerprints bigint, parens_collapsed bigint, picks array<struct<pos:bigint,hash:bigint,offset:bigint,length:bigint>>, prints array<bigint>"
    return map_lexed(docs, options.lexer, key, source, schema, rows, named=False)


def hashes_of(docs: DataFrame, options: Options = Options(), key: str = "doc_id", source: str = "text") -> DataFrame:
    """(doc_id, pos, hash) of every k-gram of each document."""

    def rows(keys: pa.Array, x: Lexed) -> pa.RecordBatch:
        x, _ = _normalized(x, options)
        hashes, bounds = gram_hashes(x.symbols(), x.bounds, options.k)
        owner = np.repeat(np.arange(len(keys)), np.diff(bounds))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(np.arange(len(hashes)) - bounds[:-1][owner]), pa.array(hashes)], names=["doc_id", "pos", "hash"])

    return map_lexed(docs, options.lexer, key, source, f"doc_id {key_type(docs, key)}, pos bigint, hash bigint", rows, named=False)


def marked_tokens(docs: DataFrame, lexer: str = "cpp", key: str = "doc_id", source: str = "text") -> DataFrame:
    """The tokens (doc_id, pos, text) with keep and collapsed."""

    def rows(keys: pa.Array, x: Lexed) -> pa.RecordBatch:
        keep, collapsed = redundant(x)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(x.owner)), pa.array(x.pos), x.text(), pa.array(keep), pa.array(collapsed)], names=["doc_id", "pos", "text", "keep", "collapsed"])

    return map_lexed(docs, lexer, key, source, f"doc_id {key_type(docs, key)}, pos bigint, text string, keep boolean, collapsed boolean", rows)


def picks_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, pos, hash, offset, length), one row a pick."""
    return parsed.select("doc_id", F.inline("picks"))


def fingerprints(parsed: DataFrame) -> DataFrame:
    """(doc_id, hash), one row a fingerprint."""
    return parsed.select("doc_id", F.explode("prints").alias("hash"))


def profile(parsed: DataFrame) -> DataFrame:
    """tokens, kgrams and fingerprints of every document, 0 where there are none."""
    return parsed.select("doc_id", "tokens", "kgrams", "fingerprints")


# -- on tables of tokens from elsewhere ---------------------------------------------------------------------------


def kgrams(symbols: DataFrame, k: int) -> DataFrame:
    """(doc_id, pos, hash) of every k symbols in a row, of a table (doc_id, pos, sym); fewer than k give none."""
    if k <= 0:
        raise ValueError("k must be positive")
    doc = Window.partitionBy("doc_id").orderBy("pos")
    hash_ = F.lit(0).cast("bigint")
    for j in range(k):
        hash_ = (hash_ * 256 + (F.lead("sym", j).over(doc) if j else F.col("sym"))) % MODULUS
    return symbols.select("doc_id", "pos", hash_.alias("hash")).where(F.col("hash").isNotNull())


def winnow(kgrams_: DataFrame, window: int) -> DataFrame:
    """(doc_id, pos, hash): the picks of a table of k-gram hashes."""
    if window <= 0:
        raise ValueError("window must be positive")
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, window - 1)
    whole = Window.partitionBy("doc_id")
    least = kgrams_.select(
        "doc_id",
        "pos",
        F.min(F.struct("hash", (-F.col("pos")).alias("back"))).over(frame).alias("m"),
        F.count("*").over(frame).alias("n"),
        F.count("*").over(whole).alias("total"),
    )
    picked = least.where((F.col("n") == window) | ((F.col("total") < window) & (F.col("pos") == 0)))
    return picked.select("doc_id", (-F.col("m.back")).alias("pos"), F.col("m.hash").alias("hash")).distinct()
