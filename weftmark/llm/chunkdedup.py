"""Substring deduplication by content-defined chunks (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.textbytes import mix, pieces
from weftmark.operators.lexing import spread

#: A cut needs the bits MASK of the gear hash to be zero. They depend on the last WINDOW bytes only.
MASK, WINDOW = np.uint16(0xF800), 16
#: Bounds of a chunk's bytes. A chunk is WINDOW bytes at least, so that no cut depends on what lies before the text.
MIN_CHUNK, MAX_CHUNK = 16, 256
#: Bytes of a repeat that are removed, some 25 words; the parts of chunks at its edges count.
MIN_RUN = 160

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def gear(text: np.ndarray) -> np.ndarray:
    """The rolling gear hash after each byte, h = (h << 1) + gear[byte] in 16 bits, by doubling the window."""
    h = _GEAR[text]
    for s in (1, 2, 4, 8):
        shifted = h[:-s] << np.uint16(s)
        h = h.copy()
        h[s:] += shifted
    return h


def chunk_ends(text: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """(ends of the chunks of all texts, number of chunks of each text). No cut is within a character of UTF-8."""
    inner = np.append((text[1:] & 0xC0) == 0x80, False)[: len(text)]  # after these bytes a character goes on
    candidates = np.flatnonzero(((gear(text) & MASK) == 0) & ~inner).tolist() if len(text) else []
    candidates.append(1 << 62)
    raw = text.tobytes()
    ends, counts, k = [], [], 0
    bounds = offsets.tolist()
    for begin, end in zip(bounds, bounds[1:], strict=False):
        before = len(ends)
        at = begin
        while at < end:
            least = at + MIN_CHUNK - 1
            while candidates[k] < least:
                k += 1
            to = min(candidates[k] + 1, at + MAX_CHUNK)
            while to < end and raw[to] & 0xC0 == 0x80:
                to -= 1
            at = to if to < end else end
            ends.append(at)
        counts.append(len(ends) - before)
    return ends, counts


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a chunk: _key, _h (a hash of the text, which tells rows of equal id apart), start and end (bytes), d1 and d2, the halves of its 128-bit digest."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_key"), F.hash(text).alias("_h"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at, raw, offsets in pieces(batch.column(2), 1 << 20):
                ends, counts = chunk_ends(raw, offsets)
                if not ends:
                    continue
                view = raw.tobytes()
                starts = [0, *ends[:-1]]
                digests = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts, ends, strict=True)]), np.int64).reshape(-1, 2)
                base = np.repeat(offsets[:-1], counts)
                owner = pa.array(at + np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), pa.array((np.array(starts) - base).astype(np.int32)), pa.array((np.array(ends) - base).astype(np.int32)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())],
                    names=["_key", "_h", "start", "end", "d1", "d2"],
                )

    kind = rows.schema["_key"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"_key {kind}, _h int, start int, end int, d1 bigint, d2 bigint")


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    if a[:1] != b[:1]:
        return 0
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _reach(own: bytes, first: bytes, left: bool) -> int:
    """Bytes by which a run grows into ``own``, which lies before it (``left``) or after it, as far as ``first`` agrees; whole characters."""
    n = _shared(own[::-1], first[::-1]) if left else _shared(own, first)
    if left:
        while n and own[len(own) - n] & 0xC0 == 0x80:
            n -= 1
    else:
        while 0 < n < len(own) and own[n] & 0xC0 == 0x80:
            n -= 1
    return n


def repeats(docs: DataFrame, min_run: int = MIN_RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with passages that occur before: doc_id, text_hash, removed_bytes, spans (start, end; bytes), first_doc_ids.

    Texts are cut where a gear hash of the last 16 bytes has five zero bits, so
    cuts move with the text and an insertion changes the chunks around it alone.
    Of equal chunks, the first in the document of the smallest id stays. All
    others are repeats. A run of adjoining repeats grows byte by byte into the
    chunks around it, as far as they agree with those around the first; of
    ``min_run`` bytes then, it is a span to remove. Every removed byte has its
    like in a document of smaller id or further to the front. first_doc_ids
    lists the documents where the removed chunks stay. ``remove`` cuts the
    spans out. A repeat that holds no whole equal chunk isn't found.

    Null ids and null or empty texts take no part. Rows of equal id and text are
    one document and count once; rows of equal id and other texts are documents
    of their own, told apart by text_hash, the smaller hash coming first. Texts
    of any length are read whole; a repeat within one text is found too. Other
    columns are left out. An empty table gives no rows.
    """
    pieces_ = chunks(docs, doc_id, text)
    first = F.min(F.struct("_key", "_h", "start")).over(Window.partitionBy("d1", "d2"))
    repeated = pieces_.select("_key", "_h", "start", "end", first.alias("at")).where("_key != at._key or _h != at._h or start != at.start")
    repeated = repeated.select("_key", "_h", "start", "end", F.col("at._key").alias("first"), F.col("at._h").alias("first_h"), F.col("at.start").alias("first_start"))
    lists = repeated.groupBy("_key", "_h").agg(F.sort_array(F.collect_set(F.struct("start", "end", "first", "first_h", "first_start"))).alias("c"))
    kind = lists.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            bounds = np.asarray(column.offsets).astype(np.int64)
            bounds, flat = bounds - bounds[0], column.flatten()
            start, end, first_start = (flat.field(k).to_numpy() for k in (0, 1, 4))
            firsts, first_h = flat.field(2), flat.field(3)
            if not len(start):
                continue
            owner = np.repeat(np.arange(len(column)), np.diff(bounds))
            keys, hashes = batch.column(0), batch.column(1)
            joins = (start[1:] == end[:-1]) & (owner[1:] == owner[:-1])
            heads = np.flatnonzero(np.append(True, ~joins))
            head, tail = heads, np.append(heads[1:], len(start)) - 1
            a, b, who = start[head], end[tail], owner[head]
            linked = who[1:] == who[:-1]
            before = np.append(0, np.where(linked, b[:-1], 0))
            after = np.append(np.where(linked, a[1:], 1 << 30), 1 << 30)
            n = len(head)
            ids = pa.ListArray.from_arrays(pa.array(np.append(heads, len(start)).astype(np.int32)), firsts)
            ids = pa.concat_arrays([ids, pa.array([[]] * n, ids.type)])
            # the chunk after a run has MAX_CHUNK bytes at most and isn't equal as a whole; before it, cuts may have differed for longer
            size = np.append(np.maximum(a - before, 0), np.clip(after - b, 0, MAX_CHUNK))
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.append(who, who))),
                    hashes.take(pa.array(np.append(who, who))),
                    pa.array(np.append(a, a).astype(np.int32)),
                    pa.array(np.append(b, b).astype(np.int32)),
                    pa.array(np.arange(2 * n) < n),
                    pa.array(size.astype(np.int32)),
                    firsts.take(pa.array(np.append(head, tail))),
                    first_h.take(pa.array(np.append(head, tail))),
                    pa.array(np.append(first_start[head], first_start[tail] + end[tail] - start[tail]).astype(np.int32)),
                    ids,
                ],
                names=["_key", "_h", "start", "end", "left", "size", "first", "first_h", "at", "ids"],
            )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, own, first = (batch.column(k).to_pylist() for k in (4, 6, 7))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([_reach(*x) for x in zip(own, first, left, strict=True)], pa.int32())], names=["_key", "_h", "start", "end", "left", "ids", "more"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, sides in enumerate(batch.column(2).to_pylist()):
                more: dict[tuple[int, int], list] = {}
                for x in sides:
                    run_ = more.setdefault((x["start"], x["end"]), [1 << 30, 1 << 30, set()])
                    run_[not x["left"]] = min(run_[not x["left"]], x["more"])
                    run_[2].update(x["ids"])
                spans: list[list] = []
                for a, b, ids in sorted((a - left, b + right, ids) for (a, b), (left, right, ids) in more.items()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                        spans[-1][2] |= ids
                    else:
                        spans.append([a, b, set(ids)])
                if spans := [x for x in spans if x[1] - x[0] >= min_run]:
                    out.append((k, spans))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array([k for k, _ in out], pa.int64())) for c in (0, 1)],
                    pa.array([sum(b - a for a, b, _ in x) for _, x in out], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b, _ in x] for _, x in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(set().union(*[ids for _, _, ids in x])) for _, x in out], pa.list_(batch.column(0).type)),
                ],
                names=["_key", "text_hash", "removed_bytes", "spans", "first_doc_ids"],
            )

    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.hash(text).alias("_dh"), F.col(text).cast("binary").alias("_text"))
    sides = lists.mapInArrow(run, f"_key {kind}, _h int, start int, end int, left boolean, size int, first {kind}, first_h int, at int, ids array<{kind}>")
    beside = lambda place, edge: F.when(F.col("left"), F.expr(f"substring(_text, greatest({place} - size, 0) + 1, least(size, {place}))")).otherwise(F.expr(f"substring(_text, {edge} + 1, size)"))
    own = sides.join(texts, (F.col("_key") == F.col("_doc")) & (F.col("_h") == F.col("_dh"))).select("_key", "_h", "start", "end", "left", "size", "first", "first_h", "at", "ids", beside("start", "end").alias("own"))
    both = own.join(texts, (F.col("first") == F.col("_doc")) & (F.col("first_h") == F.col("_dh"))).select("_key", "_h", "start", "end", "left", "ids", "own", beside("at", "at").alias("beside_first"))
    grown = both.mapInArrow(grow, f"_key {kind}, _h int, start int, end int, left boolean, ids array<{kind}>, more int")
    runs = grown.groupBy("_key", "_h").agg(F.collect_list(F.struct("start", "end", "left", "ids", "more")).alias("sides"))
    return runs.mapInArrow(whole, f"_key {kind}, text_hash int, removed_bytes bigint, spans array<struct<start:int,end:int>>, first_doc_ids array<{kind}>").withColumnRenamed("_key", doc_id)


def remove(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the spans of ``repeats``; all columns and rows stay, and a text may become empty.

    A row loses spans only if its id and its text are those that they were found
    in, so null ids and texts, and other texts of an id, stay as they are;
    repeated rows are cut alike. An empty table gives none.
    """
    spans = found.select(F.col(doc_id).alias("_key"), F.col("text_hash").alias("_h"), F.col("spans").alias("_spans"))

    @F.pandas_udf("string")
    def clean(texts, spans):
        import pandas as pd

        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is not None and s is not None:
                raw, at, kept = t.encode(), 0, []
                for x in s:
                    kept.append(raw[at : x["start"]])
                    at = x["end"]
                t = b"".join([*kept, raw[at:]]).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    plain = [f"c{i}" for i in range(len(docs.columns))]
    id_, text_ = (plain[docs.columns.index(c)] for c in (doc_id, text))
    joined = docs.toDF(*plain).join(spans, (F.col(id_) == F.col("_key")) & (F.hash(text_) == F.col("_h")), "left")
    return joined.withColumn(text_, clean(F.col(text_), F.col("_spans"))).select(*plain).toDF(*docs.columns)
