"""Token ids in Simple-8b words (operator 7)."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.textbytes import binary_column, pieces, powers
from weftmark.operators.lexing import spread

#: Selector -> (values in a word, bits of each). 0 and 1 are runs of zeros.
LAYOUT = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Values of a block: decoding can start at any block, by its offset.
BLOCK = 1024
#: The largest packed value marks an escape: the next word holds the value raw.
ESCAPE = (1 << 60) - 1
#: Bytes of text taken at a time; distinct pieces are looked up once in each.
PIECE = 1 << 20
_COUNTS = np.array([c for c, _ in LAYOUT])
_BITS16 = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if not len(values) or int(values.max()) < 1 << 16:
        return _BITS16[values.astype(np.int64)]
    bits = np.zeros(len(values), np.uint64)
    for shift in (32, 16, 8, 4, 2, 1):
        bits += np.where(values >> (bits + np.uint64(shift)) > 0, np.uint64(shift), np.uint64(0))
    return (bits + (values > 0)).astype(np.uint8)


def encode_blocks(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word bounds) of blocks values[bounds[i] : bounds[i + 1]], each coded by itself.

    A word holds its selector in the top 4 bits and values from the low bits up.
    From every position the fullest layout that fits is taken. The last word of
    a block may hold fewer values than its layout says; zeros fill it. Any
    unsigned 64-bit value can be coded; ESCAPE and above take two words.
    """
    values = np.asarray(values, np.uint64)
    sizes = np.diff(bounds)
    n = len(values)
    packed = np.minimum(values, np.uint64(ESCAPE))
    # 60 zeros after each block let a window run over its end
    home = np.arange(n) + np.repeat(np.arange(len(sizes)) * 60, sizes)
    bits = np.zeros(n + 60 * len(sizes) + 60, np.uint8)
    bits[home] = _bit_lengths(packed)
    spans, most = {1: bits}, bits
    for k in (2, 4, 8, 16, 32):
        half = spans[k // 2]
        spans[k] = np.maximum(half, np.append(half[k // 2 :], np.zeros(k // 2, np.uint8)))
    selector = np.full(len(bits), 15, np.uint8)
    for s in range(14, 1, -1):
        count, width = LAYOUT[s]
        k = 1 << (count.bit_length() - 1)
        most = np.maximum(spans[k], np.append(spans[k][count - k :], np.zeros(count - k, np.uint8)))
        selector[most <= width] = s
    selector = selector[home]
    ends = np.repeat(bounds[1:], sizes)
    left = ends - np.arange(n)
    zeros = np.flatnonzero((selector == 2) & (packed == 0))
    if len(zeros):
        filled = np.flatnonzero(packed > 0)
        run = np.minimum(np.append(filled, n)[np.searchsorted(filled, zeros)] - zeros, left[zeros])
        selector[zeros[run >= 120]] = 1
        selector[zeros[run >= 240]] = 0
    step = np.minimum(_COUNTS[selector], left).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts, np.int64)
    chosen = selector[first] if n else selector
    held = np.array(step, np.int64)[first] if n else first
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        which = np.flatnonzero(chosen == s)
        for j in range(int(held[which].max()) if len(which) else 0):
            w = which[held[which] > j]
            words[w] |= packed[first[w] + j] << np.uint64(j * LAYOUT[s][1])
    word_bounds = np.searchsorted(first, bounds)
    raw = (chosen == 15) & (packed[first] == ESCAPE) if n else np.zeros(0, bool)
    if raw.any():
        place = np.concatenate([[0], np.cumsum(1 + raw)])
        out = np.zeros(place[-1], np.uint64)
        out[place[:-1]] = words
        out[place[:-1][raw] + 1] = values[first[raw]]
        return out, place[word_bounds]
    return words, word_bounds


def decode(words: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` values of one block's words, all words of a selector at once."""
    words = np.asarray(words, np.uint64)
    mark = np.uint64((15 << 60) | ESCAPE)
    raw: list[tuple[int, np.uint64]] = []
    if (words == mark).any():
        keep, at = [], 0
        while at < len(words):
            keep.append(at)
            if words[at] == mark:
                at += 1
                raw.append((len(keep) - 1, words[at]))
            at += 1
        words = words[keep]
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNTS[selector])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        n, width = LAYOUT[s]
        which = np.flatnonzero(selector == s)
        for j in range(n if width else 0):
            out[ends[which] - n + j] = (words[which] >> np.uint64(j * width)) & np.uint64((1 << width) - 1)
    for k, value in raw:
        out[ends[k] - 1] = value
    return out[:count]


def decode_document(words: bytes, offsets: list[int], count: int, block: int = BLOCK) -> np.ndarray:
    """The ids of one row of ``token_ids``."""
    all_words = np.frombuffer(words, "<u8")
    cuts = [*offsets, len(all_words)]
    parts = [decode(all_words[cuts[i] : cuts[i + 1]], min(block, count - i * block)) for i in range(len(offsets))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_SPACE = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


@lru_cache(1)
def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 0 other, by code point."""
    return np.array([3 if i in _SPACE else {"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def split_starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of SPLIT start in the bytes of UTF-8 texts; no piece goes across texts."""
    n = len(text)
    lead = np.flatnonzero((text & 0xC0) != 0x80)  # one entry a character from here on
    raw = text[lead].astype(np.int32)
    point = raw.copy()
    for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        which = np.flatnonzero((raw >= low) & (raw < (0xE0, 0xF0, 0xF8)[more - 1]))
        if len(which):
            value = raw[which] & mask
            for j in range(1, more + 1):
                value = (value << 6) | (text[lead[which] + j] & 0x3F)
            point[which] = value
    kind = _classes()[point]
    m = len(lead)
    heads = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    first = np.zeros(m + 1, bool)
    first[heads] = True
    first[m] = True
    change = first[:m].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    space = kind == 3
    last = space & ~first[1:]  # the last white space before another character of the text
    last[:-1] &= ~space[1:]
    if m:
        last[-1] = False
    blank = last & (point == 32)
    after = np.flatnonzero(blank) + 1
    start[after] = False
    start[blank] = True
    start[last & ~blank] = True
    quote = np.flatnonzero((point == 39) & change)
    if len(quote):
        padded = np.append(point, np.zeros(3, point.dtype))
        edge = np.append(first[:m], np.ones(4, bool))
        free = ~edge[quote + 1]
        before_blank = np.zeros(len(quote), bool)
        before_blank[quote > 0] = blank[quote[quote > 0] - 1]
        free &= ~before_blank
        a, b = padded[quote + 1], np.where(edge[quote + 2], 0, padded[quote + 2])
        one = free & np.isin(a, [ord(c) for c in "stmd"])
        two = free & ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for found, size in ((one, 1), (two, 2)):
            q = quote[found]
            start[q + 1] = False
            following = q + 1 + size
            ok = following < m
            start[following[ok]] |= kind[following[ok]] == 1
    return lead[start] if n else lead


class Tokenizer:
    """Byte-level BPE by a ranks file; equal to encoding every text by itself, but each distinct piece is merged once."""

    def __init__(self, path: str, keep: int = 1_500_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, spans: list[bytes]) -> None:
        """``keys`` ascend and are new."""
        if len(self.keys) > self.keep:  # bounds a worker's memory
            self.clear()
        encoded = [self.model.encode_ordinary(s.decode()) for s in spans]
        size = np.array([len(e) for e in encoded], np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter((i for e in encoded for i in e), np.int32, int(size.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts of a piece of a column."""
        n = len(text)
        starts = split_starts(text, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(0x9E3779B97F4A7C15, n), out=sums[1:])
            back = powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), n + 1)
            keys = (sums[ends] - sums[starts]) * back[starts] * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)
        distinct, at, where = np.unique(keys, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == distinct[inside]
        if not known.all():
            before = len(self.keys)
            new = np.flatnonzero(~known) if before <= self.keep else np.arange(len(distinct))
            raw = text.tobytes()
            self._learn(distinct[new], [raw[starts[i] : ends[i]] for i in at[new]])
            spot = np.searchsorted(self.keys, distinct)
        size, begin = self.size[spot][where], self.begin[spot][where]
        upto = np.cumsum(size)
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto + size, size)]
        cuts = np.searchsorted(starts, offsets)
        return ids, np.concatenate([[0], upto])[cuts]


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_ids(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as token ids in Simple-8b words.

    ``tokenizer`` is the path of a byte-level BPE ranks file, on every executor.
    Columns: the key; n_tokens; words, little-endian 64-bit words; and
    block_offsets, the first word of each block of ``block`` ids, so a reader can
    decode any block alone (``decode_document`` decodes a row).

    Null and empty texts give 0 tokens, no words and no blocks. Rows, repeated
    ones too, correspond one to one; null keys are kept, of any type; other
    columns are left out, whatever their names. Texts of any length are coded
    whole; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(path)
        for batch in batches:
            for at, raw, offsets in pieces(batch.column(1), PIECE):
                ids, bounds = model.encode(raw, offsets)
                counts = np.diff(bounds)
                blocks = -(-counts // block)
                owner = np.concatenate([[0], np.cumsum(blocks)])
                nth = np.arange(owner[-1]) - np.repeat(owner[:-1], blocks)
                begin = np.repeat(bounds[:-1], blocks) + nth * block
                words, word_bounds = encode_blocks(ids, np.append(begin, len(ids)))
                doc_words = word_bounds[owner]
                relative = (word_bounds[:-1] - np.repeat(doc_words[:-1], blocks)).astype(np.int32)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(counts), binary_column(words.astype("<u8"), doc_words), pa.ListArray.from_arrays(pa.array(owner, pa.int32()), pa.array(relative, pa.int32()))],
                    names=["_key", "n_tokens", "words", "block_offsets"],
                )

    kind = rows.schema["_key"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"_key {kind}, n_tokens bigint, words binary, block_offsets array<int>").withColumnRenamed("_key", key)
