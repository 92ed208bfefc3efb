"""Vectorised byte-level views of Arrow text columns, shared by the Python operators.

A batch's strings lie in one buffer with offsets, so tokenising, hashing and
windowing run over the buffer as numpy arrays, never string by string.
Nulls are read as empty texts.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weftmark.operators.lexing import spread

#: Bytes of text handled at a time, so that the numpy temporaries of a worker stay small.
PIECE = 1 << 18

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = 1
_WORD[128:] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_ODD_INV = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    text = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return text, offsets - first


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (index of the first text, bytes, offsets) for runs of whole texts of about ``size`` bytes."""
    text, offsets = buffer(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, text[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of a piece: maximal runs of ASCII letters, digits, _ and non-ASCII bytes, never across texts.

    start, end: byte spans; hash: 64 bits, ASCII case folded; bounds: the words
    of text i are bounds[i] .. bounds[i + 1].
    """

    def __init__(self, text: np.ndarray, offsets: np.ndarray):
        inside = _WORD[text]
        before = np.empty_like(inside)
        before[:1] = 0
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(text)]
        before[heads] = 0
        after = np.empty_like(inside)
        after[-1:] = 0
        after[:-1] = inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = 0
        self.start = np.flatnonzero(inside & (before ^ 1))
        self.end = np.flatnonzero(inside & (after ^ 1)) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum((_FOLD[text].astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(text)), out=self.sums[1:])
            self.back = powers(_ODD_INV, len(text) + 1)
            self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of any byte spans: equal for equal folded bytes."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def hash_word(word: str) -> int:
    """The hash that Words gives to this text as one span."""
    raw = np.frombuffer(word.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    return int(w.span_hash(np.array([0]), np.array([len(raw)]))[0])


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of every text, bounds); a text of 1 to n - 1 words gives one gram of all its words."""
    count = np.diff(bounds)
    with np.errstate(over="ignore"):
        total = len(hashes)
        gram = np.zeros(max(total - n + 1, 0), np.uint64)
        for j in range(n):
            gram += hashes[j : total - n + 1 + j] * powers(0xD6E8FEB86659FD93, n + 1)[n - j] if total >= n else np.uint64(0)
        grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        out_bounds = np.concatenate([[0], np.cumsum(grams)])
        out = np.empty(out_bounds[-1], np.uint64)
        long = count >= n
        if len(gram):
            valid = np.zeros(total + 1, np.int32)
            np.add.at(valid, bounds[:-1][long], 1)
            np.add.at(valid, bounds[1:][long] - n + 1, -1)
            keep = np.cumsum(valid)[: len(gram)] > 0
            spot = np.zeros(out_bounds[-1] + 1, np.int32)
            np.add.at(spot, out_bounds[:-1][long], 1)
            np.add.at(spot, out_bounds[1:][long], -1)
            out[np.cumsum(spot)[:-1] > 0] = gram[keep]
        for i in np.flatnonzero((count > 0) & ~long):
            acc = np.uint64(len(range(bounds[i], bounds[i + 1])))
            for j in range(bounds[i], bounds[i + 1]):
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j]
            out[out_bounds[i]] = acc
    return mix(out), out_bounds


def binary_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is data[bounds[i] : bounds[i + 1]], of any fixed-width type."""
    width = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    ).cast(pa.binary())


def map_rows(docs: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], added: str = "") -> DataFrame:
    """Puts every Arrow batch of whole rows through ``function``, which keeps the columns by place and appends those of ``added``.

    Inside, columns are called c0, c1, ...; so names may clash with anything.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema], *([added] if added else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    out = spread(plain).mapInArrow(run, schema)
    return out.toDF(*names, *out.columns[len(names) :])


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir. Only a local session, which has but one machine, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "weftmark-checkpoints")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


@contextmanager
def written(df: DataFrame, free: bool = False) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared folder, which goes at the end of the block.

    Later stages read only the columns that they name, and no lineage remains.
    ``free``: shuffle files that nothing needs any more go before and after the
    writing; worth its seconds where these are large.
    """
    spark = df.sparkSession
    place = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if free:
        release(spark)
    df.write.parquet(place)
    kept = df.schema
    del df
    if free:
        release(spark)
    try:
        yield spark.read.schema(kept).parquet(place)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder that the cluster shares."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(spark))
    return df.checkpoint(eager=True)
