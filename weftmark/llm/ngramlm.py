"""Unbounded n-gram scoring by sharded suffix arrays (operator 8).

Of every position of the corpus the longest suffix is wanted that ends there and
occurs elsewhere, and how often. All positions are sorted by the words that they
end with, last word first, which is a suffix array of the reversed corpus, cut
into shards by the last words. A shard sees WINDOW words only. Where these are
equal to others' the search goes on a level deeper: there a document is the
sequence of its repeated windows, and windows that always follow each other in
all their occurrences are one token. So a level has a small part of the tokens of
the one before it, and contexts reach back to the document's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftmark.llm.textbytes import Words, cut, mix, pieces, written
from weftmark.operators.lexing import spread

#: Tokens that a shard compares at each level; what agrees on more is compared on the next one. The last holds from there on.
WINDOW = (4, 4, 8, 16, 64, 512, 4096)
#: Weight of the word's share in the corpus against one occurrence of its context.
ALPHA = 0.75
#: Tokens that are shipped to a shard in windows, about; and words that a mapper gathers to a block before it ships them.
SHARD, GATHER = 3_500_000, 1_000_000
#: A suffix that more than this part of a shard, and of the corpus, ends with isn't sent to one shard; longer ones are.
HOT_SHARD, HOT_CORPUS = 1 / 4, 1 / (1 << 20)
#: The most frequent words are shipped as 20-bit ranks; others by the 48 bits of their hash that tell words apart.
RANKED = (1 << 20) - 1
NAME = np.uint64((1 << 48) - 1)

#: Parts of a bit in which a document's sums are rounded, so that those of equal ids add up alike in any order.
UNIT = 1 << 16

_K = np.uint64(0xD6E8FEB86659FD93)


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for _, raw, offsets in pieces(batch.column(1)):
                h = Words(raw, offsets).hash & NAME
                held.append(h)
                size += len(h)
                if size >= 4 * GATHER:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) >= 256 else b"\0" + raw


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]) if b[0] else b[1:], kind)


def _pack(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) >= 256 else b"\0" + raw


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]) if b[0] else b[1:], kind)


def _small(a: np.ndarray) -> bytes:
    """Packed numbers, none below 0, in as few bytes as the largest needs."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) <= np.iinfo(k).max)
    return kind[2].encode() + _pack(a.astype(kind))


def _numbers(b: bytes) -> np.ndarray:
    return _unpack(b[1:], f"<u{chr(b[0])}").astype(np.int64)


def _ranked(counts: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, distinct words, hashes and counts of at most RANKED frequent words, all of some count and more).

    The least count follows from how many words have each count, in steps of 9 %;
    so no more than RANKED words come to the driver, whatever the corpus.
    """
    step = F.floor(F.log("n") * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    total, distinct = sum(r.n for r in sizes), sum(r.words for r in sizes)
    taken, least = 0, None
    for r in sizes:
        if taken + r.words > RANKED:
            break
        taken, least = taken + r.words, r.step
    top = counts.where(step >= least if least is not None else F.lit(False)).select("word", "n").toArrow()
    words, n = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((words, -n))
    return total, distinct, words[order], n[order]


def _code(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a byte a rank, packed bits): ranks below 192 as they are, above by length and two leading bits, the other bits packed by length; RANKED as 255."""
    length = np.frexp(rank.astype(np.float32))[1].astype(np.int64)
    code = np.where(rank < 192, rank, 192 + (length - 8) * 4 + ((rank >> np.maximum(length - 3, 0)) & 3)).astype(np.uint8)
    code[rank == RANKED] = 255
    parts = []
    for n in range(8, 21):
        own = rank[(code >= 192 + (n - 8) * 4) & (code < 196 + (n - 8) * 4)]
        if len(own):
            parts.append(np.packbits(((own[:, None] >> np.arange(n - 3)) & 1).astype(np.uint8)))
    return code, np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _decode(code: np.ndarray, packed: np.ndarray) -> np.ndarray:
    rank = code.astype(np.int64)
    rank[code == 255] = RANKED
    at = 0
    for n in range(8, 21):
        own = np.flatnonzero((code >= 192 + (n - 8) * 4) & (code < 196 + (n - 8) * 4))
        if len(own):
            size = -(-len(own) * (n - 3) // 8)
            bits = np.unpackbits(packed[at : at + size], count=len(own) * (n - 3)).reshape(-1, n - 3).astype(np.int64)
            at += size
            head = 4 + ((code[own].astype(np.int64) - 192) & 3)
            rank[own] = (head << (n - 3)) | (bits << np.arange(n - 3)).sum(axis=1)
    return rank


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key's group in the order of keys, sizes of groups).

    Upper bits with a place in the lower ones sort faster than places by keys; if
    two keys differ in the lower bits only, places are sorted.
    """
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    packed = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    upper = packed >> np.uint64(len(keys).bit_length())
    if (new[1:] & (upper[1:] == upper[:-1])).any():
        order = np.argsort(keys)
        ordered = keys[order]
        new[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.diff(np.append(np.flatnonzero(new), len(keys)))


def _join(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(group.astype(np.uint64) * _K ^ words)


def _counts(a: np.ndarray) -> bytes:
    """Packed numbers of which few reach 255."""
    large = a[a >= 255]
    low = _pack(np.minimum(a, 255).astype(np.uint8))
    return len(low).to_bytes(4, "little") + low + _small(large)


def _counted(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    out = _unpack(b[4 : 4 + n], np.uint8).astype(np.int64)
    out[out == 255] = _numbers(b[4 + n :])
    return out


def _same(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values are among the sorted keys, where)."""
    if not len(keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    spot = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[spot] == values, spot


def _grow(gram: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of a suffix one token longer."""
    with np.errstate(over="ignore"):
        return mix(gram * _K ^ token)


HOT_NAME = 1 << 31
#: For each length from 1 on: the sorted hashes of suffixes that are hot, and their counts.
Hot = list[tuple[np.ndarray, np.ndarray]]


def _keys(tokens: np.ndarray, have: np.ndarray, hot: Hot, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the suffix that the shard follows from, its length): of each position the shortest suffix that isn't hot.

    A hot suffix from the sequence's start on has a key of its own.
    """
    with np.errstate(over="ignore"):
        gram = mix(tokens + np.uint64(1))
        size = np.ones(len(tokens), np.int64)
        left = np.arange(len(tokens))
        for n, (hashes, _) in enumerate(hot, 1):
            left = left[_same(hashes, gram[left])[0]]
            if not len(left):
                break
            size[left] = n + 1
            short = have[left] <= n
            gram[left[short]] = mix(gram[left[short]] + (left[short].astype(np.uint64) + np.uint64(1)) * _K + np.uint64(salt))
            left = left[~short]
            gram[left] = _grow(gram[left], tokens[left - n])
    return gram, size


def _key_lengths(flat: np.ndarray, offset: np.ndarray, length: np.ndarray, hot: Hot) -> np.ndarray:
    """The lengths that ``_keys`` gives, from the windows."""
    size = np.ones(len(offset), np.int64)
    with np.errstate(over="ignore"):
        gram = mix(flat[offset] + np.uint64(1))
        left = np.arange(len(offset))
        for n, (hashes, _) in enumerate(hot, 1):
            left = left[_same(hashes, gram[left])[0]]
            size[left] = n + 1
            left = left[length[left] > n]
            gram[left] = _grow(gram[left], flat[offset[left] + n])
    return size


def matches(flat: np.ndarray, offset: np.ndarray, length: np.ndarray, window: int, hot: Hot) -> tuple[np.ndarray, ...]:
    """(r, c, linked, alike, name) of the positions of a shard.

    Position i ends with flat[offset[i]], has flat[offset[i] + 1] before that, and
    so on for length[i] tokens. The array of these suffixes is sorted bucket by
    bucket, a token deeper wherever a bucket holds more than one; a bucket is the
    range of a suffix in the array, and its size the count. r is the longest suffix
    of ``window`` tokens at most that others have, c how many others, alike how
    many positions end with the same token. linked:
    r is the window, and all positions that share it have one token before it.
    name: a number of the shared window, within the shard; HOT_NAME and more
    within all shards; 0 for r below the window.
    """
    n = len(offset)
    size = _key_lengths(flat, offset, length, hot)
    with np.errstate(over="ignore"):
        r, c, alike, name = (np.zeros(n, np.int64) for _ in range(4))
        for m in range(2, len(hot) + 2):
            own = np.flatnonzero(size == m)
            if len(own):
                gram = mix(flat[offset[own]] + np.uint64(1))
                alike[own] = hot[0][1][_same(hot[0][0], gram)[1]]
                for k in range(1, m - 1):
                    gram = _grow(gram, flat[offset[own] + k])
                at = _same(hot[m - 2][0], gram)[1]
                r[own], c[own] = m - 1, hot[m - 2][1][at] - 1
                if m > window:
                    name[own] = HOT_NAME + at
        active, group = np.arange(n), np.zeros(n, np.int64)
        linked = np.zeros(n, bool)
        for depth in range(1, window + 2):
            group, sizes = _groups(_join(group, flat[offset[active] + depth - 1]))
            count = sizes[group]
            if depth == 1:
                alike[size == 1] = count[size == 1]
            if depth == window + 1:
                linked[active] = count == c[active] + 1
                break
            known = depth >= size[active]
            hit = known & (count > 1)
            r[active[hit]], c[active[hit]] = depth, count[hit] - 1
            if depth == window:
                name[active[hit]] = np.unique(group[hit], return_inverse=True)[1]
            on = (~known | (count > 1)) & (length[active] > depth)
            active, group = active[on], group[on]
            if not len(active):
                break
        linked &= r == window
    return r, c, linked, alike, name


_SHIPPED = "shard bigint, block bigint, ids array<{kind}>, sizes binary, pos binary, length binary, code binary, bits binary, rare binary"
_FOUND = "shard bigint, block bigint, ids array<{kind}>, sizes binary, pos binary, r binary, c binary, linked binary, alike binary, name binary"
_STATE = "block bigint, ids array<{kind}>, a binary, b binary, sizes binary, run_doc binary, run_next binary, run_units binary, unit_size binary, unit binary, weights binary, n_next bigint, n_ship bigint"


def _ship(block: int, ids, bounds: np.ndarray, tokens: np.ndarray, window: int, shards: int, hot: Hot, ranks: np.ndarray, rank_of: np.ndarray, list_type: pa.DataType) -> pa.RecordBatch:
    """A row for each shard that some positions of the block go to, with their windows, and one of the block's documents."""
    n = len(tokens)
    sizes = np.diff(bounds)
    have = np.arange(n) - np.repeat(bounds[:-1], sizes) + 1
    key, _ = _keys(tokens, have, hot, block)
    length = np.minimum(have, window + 1)
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    present, begin = np.unique(shard[order], return_index=True)
    cuts = np.append(begin, n)
    some, spot = _same(ranks, tokens)
    code = np.where(some, rank_of[spot], RANKED).astype(np.uint32) if len(ranks) else np.full(n, RANKED, np.uint32)
    rows: dict[str, list] = {k: [] for k in ("shard", "pos", "length", "code", "bits", "rare")}
    for s, a, b in zip(present.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at, size_ = order[a:b], length[order[a:b]]
        upto = np.cumsum(size_)
        index = np.repeat(at + upto - size_, size_) - np.arange(upto[-1])
        coded, bits = _code(code[index])
        rows["shard"].append(s)
        rows["pos"].append(_counts(np.diff(at, prepend=0)))
        rows["length"].append(_small(size_))
        rows["code"].append(_pack(coded))
        rows["bits"].append(_pack(bits))
        rare = tokens[index][code[index] == RANKED]
        rows["rare"].append(_pack(np.concatenate([(rare >> np.uint64(16 * k)).astype("<u2") for k in range(3 if len(ranks) else 4)])))
    k = len(present)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*rows["shard"], -1 - block], pa.int64()), pa.array([block] * (k + 1), pa.int64()), pa.array([None] * k + [ids], list_type), pa.array([None] * k + [_small(sizes)], pa.binary()),
            *[pa.array([*rows[c], None], pa.binary()) for c in list(rows)[1:]],
        ],
        names=["shard", "block", "ids", "sizes", *list(rows)[1:]],
    )


def _search(table: pa.Table, window: int, hot: Hot, low: np.ndarray, counts: np.ndarray, words: bool) -> pa.Table:
    """The positions of one shard; rows of documents pass. Of words, alike is told, and so c of a suffix of one word: one less."""
    names = ["shard", "block", "ids", "sizes", "pos", "r", "c", "linked", "alike", "name"]
    if table.column("pos")[0].as_py() is None:
        none = pa.nulls(table.num_rows, pa.binary())
        return pa.table([table.column(c) for c in ("shard", "block", "ids", "sizes")] + [none] * 6, names=names)
    rows = table.select(["length", "code", "bits", "rare"]).to_pylist()
    flat, own = [], []
    for x in rows:
        code = _decode(_unpack(x["code"], np.uint8), _unpack(x["bits"], np.uint8))
        rare = code == RANKED
        w = np.empty(len(code), np.uint64)
        w[~rare] = low[code[~rare]]
        for k, part in enumerate(_unpack(x["rare"], "<u2").reshape(-1, int(rare.sum())) if rare.any() else ()):
            w[rare] = (w[rare] if k else np.uint64(0)) | part.astype(np.uint64) << np.uint64(16 * k)
        flat.append(w)
        own.append(code)
    lengths = [_numbers(x["length"]) for x in rows]
    length = np.concatenate(lengths)
    offset = np.cumsum(length) - length
    r, c, linked, alike, name = matches(np.concatenate(flat), offset, length, window, hot)
    code = np.concatenate(own)[offset]
    if len(counts):
        alike = np.where(code == RANKED, alike, counts[np.minimum(code, len(counts) - 1)])
    out: list[list] = [[], [], [], [], []]
    at = 0
    for n in map(len, lengths):
        mine = slice(at, at + n)
        out[0].append(_small(r[mine]))
        out[1].append(_counts(c[mine][r[mine] > words]))
        out[2].append(_pack(np.packbits(linked[mine])))
        out[3].append(_small(alike[mine][: n * words]))
        out[4].append(_small(name[mine][r[mine] == window]))
        at += n
    return pa.table([*[table.column(c) for c in ("shard", "block", "ids", "sizes", "pos")], *[pa.array(x, pa.binary()) for x in out]], names=names)


def _bits(alike: np.ndarray, match: np.ndarray, others: np.ndarray, total: int, alpha: float) -> np.ndarray:
    """Of words that ``alike`` positions hold, after contexts that occur ``others`` times elsewhere, ``match`` times with the word."""
    p = alike / total
    return -np.log2(np.where(others > 0, (match + alpha * p) / (others + alpha), p))


def _settle(table: pa.Table, window: int, deeper: int, last: bool, total: int, alpha: float, list_type: pa.DataType) -> pa.Table:
    """A block as far as its windows tell, and the sequences of repeated windows, where they don't.

    ``last``: the level of words, whose bits are summed by document; others keep r and c.
    """
    ids = sizes = None
    found = []
    for x in table.to_pylist():
        if x["pos"] is None:
            ids, sizes = x["ids"], _numbers(x["sizes"])
        else:
            found.append(x)
    n = int(sizes.sum())
    r, c, alike = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    linked, name = np.zeros(n, bool), np.zeros(n, np.uint64)
    for x in found:
        pos = np.cumsum(_counted(x["pos"]))
        r[pos] = _numbers(x["r"])
        if last:
            alike[pos] = _numbers(x["alike"])
            c[pos] = np.where(r[pos] == 1, alike[pos] - 1, 0)
        c[pos[r[pos] > last]] = _counted(x["c"])
        linked[pos] = np.unpackbits(_unpack(x["linked"], np.uint8), count=len(pos))
        number = _numbers(x["name"])
        name[pos[r[pos] == window]] = np.where(number < HOT_NAME, number + ((x["shard"] + 1) << 32), number)  # not hashed: these pack well
    if (r < 0).any():
        raise RuntimeError("a block has lost positions: its documents came in another order when a task was run again")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    head = np.append(True, owner[1:] != owner[:-1])[:n]
    before = lambda a: np.where(head, 0, np.append(0, a[:-1])[:n])
    alive = r == window
    alive_before = before(alive).astype(bool)
    run = alive & ~alive_before
    unit = run | (alive & ~(linked & (c == before(c))))
    at = np.flatnonzero(alive)
    runs, units = np.flatnonzero(run), np.flatnonzero(unit)  # a unit: repeated windows of which none comes without the others
    place = np.append(np.flatnonzero(run[at]), len(at))
    unit_place = np.append(np.flatnonzero(unit[at]), len(at))
    unit_size = np.diff(unit_place)
    run_units = np.diff(np.searchsorted(unit_place, place))
    following = np.append(~head[1:], False)[:n] if n else head
    ends = at[place[1:] - 1] if len(runs) else at
    run_next = following[ends]
    state = [_small(owner[runs]), _pack(np.packbits(run_next)), _small(run_units), _small(unit_size)]
    if last:
        own_r, own_c = before(r), before(c)
        bits = _bits(alike, np.where(r == own_r + 1, c, 0), own_c * (own_r > 0), total, alpha)
        open_ = alive_before
        bits[open_], own_r = 0, np.where(open_, 0, own_r)
        sums = lambda v: np.bincount(owner, v, len(sizes))
        own = [_pack(sums(bits)), _small(np.rint(sums(own_r)).astype(np.int64)), _small(sizes)]
        weights = _small(alike[open_])
    else:
        own, weights = [_small(r), _small(c), _small(sizes)], _small(np.zeros(0, np.int64))
    nth = np.arange(len(units)) - np.repeat(np.cumsum(run_units) - run_units, run_units) + 1
    return pa.table(
        [
            table.column("block").slice(0, 1), pa.array([ids], list_type), *[pa.array([b], pa.binary()) for b in (*own, *state)],
            pa.array([_pack(name[units])], pa.binary()), pa.array([weights], pa.binary()), pa.array([len(units)]), pa.array([int(np.minimum(nth, deeper + 1).sum())]),
        ],
        names=["block", "ids", "a", "b", "sizes", "run_doc", "run_next", "run_units", "unit_size", "unit", "weights", "n_next", "n_ship"],
    )


def _spread(unit_size: np.ndarray, unit_r: np.ndarray, unit_c: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(r, c) of each position in the units, whose longest repeated suffix has unit_r units."""
    first = np.cumsum(unit_size) - unit_size
    back = first - first[np.arange(len(first)) - np.maximum(unit_r - 1, 0)]
    within = np.arange(int(unit_size.sum())) - np.repeat(first, unit_size)
    return window + within + np.repeat(back, unit_size), np.repeat(unit_c, unit_size)


def _finish_level(state: dict, unit_r: np.ndarray, unit_c: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    r, c = _numbers(state["a"]), _numbers(state["b"])
    at = np.flatnonzero(r == window)
    r[at], c[at] = _spread(_numbers(state["unit_size"]), unit_r, unit_c, window)
    return r, c


def _finish_words(state: dict, unit_r: np.ndarray, unit_c: np.ndarray, window: int, total: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, bits, summed contexts) of each document of a block."""
    sizes, bits, depth = _numbers(state["sizes"]), _unpack(state["a"], np.float64).copy(), _numbers(state["b"])
    unit_size, run_units, run_doc = _numbers(state["unit_size"]), _numbers(state["run_units"]), _numbers(state["run_doc"])
    if len(unit_size):
        r, c = _spread(unit_size, unit_r, unit_c, window)
        begin = np.concatenate([[0], np.cumsum(unit_size)])
        run_size = np.diff(begin[np.concatenate([[0], np.cumsum(run_units)])])
        ends = np.cumsum(run_size) - 1
        goes_on = np.unpackbits(_unpack(state["run_next"], np.uint8), count=len(ends)).astype(bool)
        inner = np.ones(len(r), bool)
        inner[ends] = False
        match = np.where(inner & (np.append(r[1:], 0) == r + 1), np.append(c[1:], 0), 0)
        some = inner.copy()
        some[ends] = goes_on
        doc = np.repeat(run_doc, run_size)[some]
        bits += np.bincount(doc, _bits(_numbers(state["weights"]), match[some], c[some], total, alpha), len(sizes))
        depth = depth + np.rint(np.bincount(doc, r[some], len(sizes))).astype(np.int64)
    return sizes, bits, depth


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, ids, bounds, words) of about GATHER words; a block is named by its partition and its place in that."""
    part = TaskContext.get().partitionId() << 24
    held: list[tuple] = []
    size = n = 0

    def block():
        sizes = np.concatenate([h[1] for h in held])
        ids = [i for h in held for i in h[0]]
        return part | n, ids, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([h[2] for h in held])

    for batch in batches:
        for at, raw, offsets in pieces(batch.column(1)):
            w = Words(raw, offsets)
            held.append((batch.column(0).slice(at, len(offsets) - 1).to_pylist(), np.diff(w.bounds), w.hash & NAME))
            size += len(w.hash)
            if size >= GATHER:
                yield block()
                held.clear()
                size, n = 0, n + 1
    if held:
        yield block()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, nothing, bounds, units) of the runs that a level leaves to the next."""
    for batch in batches:
        for x in batch.to_pylist():
            yield x["block"], None, np.concatenate([[0], np.cumsum(_numbers(x["run_units"]))]), _unpack(x["unit"], np.uint64)


def _hot_counts(rows: DataFrame, read, hot: Hot, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the suffixes one token longer than those of ``hot`` that occur ``least`` times; at most total / least of them."""
    n = len(hot) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, bounds, tokens in read(batches):
            have = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds)) + 1
            key, size = _keys(tokens, have, hot, 0)
            values, counts = np.unique(key[(size == n) & (have >= n)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["gram", "n"])

    found = rows.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    grams, counts = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy().astype(np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order]


def _settled(rows: DataFrame, read, level: int, tokens: int, shipped: int, shard: int, total: int, alpha: float, kind: str, list_type: pa.DataType, words: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All blocks of a level after its search. ``words``: frequent words by rank and their counts, for the first level."""
    window, deeper = WINDOW[min(level, len(WINDOW) - 1)], WINDOW[min(level + 1, len(WINDOW) - 1)]
    least = max(2, int(shard * HOT_SHARD), int(tokens * HOT_CORPUS))
    hot: Hot = []
    if tokens >= least:
        if level == 0 and len(words[0]) < RANKED:
            some = words[1] >= least
            order = np.argsort(mix(words[0][some] + np.uint64(1)))
            hot.append((mix(words[0][some] + np.uint64(1))[order], words[1][some][order]))
        while len(hot) <= window and (not hot or len(hot[-1][0])):
            hot.append(_hot_counts(rows, read, hot, least))
        while hot and not len(hot[-1][0]):
            hot.pop()
        hot = hot[:window]
    shards = max(1, -(-shipped // shard))
    by_hash = np.argsort(words[0])
    shared: Broadcast = rows.sparkSession.sparkContext.broadcast((hot, words[0], words[1], words[0][by_hash], by_hash.astype(np.uint32)))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, _, _, ranks, rank_of = shared.value
        for block, ids, bounds, values in read(batches):
            yield _ship(block, ids, bounds, values, window, shards, hot, ranks, rank_of, list_type)

    def search(table: pa.Table) -> pa.Table:
        hot, low, counts, *_ = shared.value
        return _search(table, window, hot, low, counts, level == 0)

    found = rows.mapInArrow(ship, _SHIPPED.format(kind=kind)).groupBy("shard").applyInArrow(search, _FOUND.format(kind=kind))
    return found.groupBy("block").applyInArrow(lambda t: _settle(t, window, deeper, level == 0, total, alpha, list_type), _STATE.format(kind=kind))


@contextmanager
def _deeper(state: DataFrame, level: int, shard: int, kind: str, list_type: pa.DataType) -> Iterator[DataFrame | None]:
    """(block, unit_r, unit_c): the longest repeated suffix of each unit of the level before, in units, and how many others have it."""
    size = state.agg(F.coalesce(F.sum("n_next"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_ship"), F.lit(0)).alias("ship")).first()
    if not size.n:
        yield None
        return
    window = WINDOW[min(level, len(WINDOW) - 1)]
    rows = state.where("n_next > 0").select("block", "run_units", "unit")
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    with written(_settled(rows, _sequences, level, size.n, size.ship, shard, 1, ALPHA, kind, list_type, none)) as mine, _deeper(mine, level + 1, shard, kind, list_type) as found:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _rows(batches):
                r, c = _finish_level(x, *_units(x), window)
                yield pa.RecordBatch.from_arrays([pa.array([x["block"]], pa.int64()), pa.array([_small(r)], pa.binary()), pa.array([_small(c)], pa.binary())], names=["block", "unit_r", "unit_c"])

        yield _with_units(mine.select("block", "a", "b", "unit_size"), found).mapInArrow(run, "block bigint, unit_r binary, unit_c binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from batch.slice(i, 1).to_pylist()


def _units(x: dict) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return (none, none) if x["unit_r"] is None else (_numbers(x["unit_r"]), _numbers(x["unit_c"]))


def _with_units(state: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return state.select("*", F.lit(None).cast("binary").alias("unit_r"), F.lit(None).cast("binary").alias("unit_c"))
    return state.join(found, "block", "left")


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, shard: int = SHARD) -> DataFrame:
    """One row a document: doc_id, n_tokens, bits, bits_per_token, mean_context.

    Every word w is predicted from the longest suffix x of the words before it,
    back to its document's start, that also occurs elsewhere in the documents:

        p(w | x) = (c(x w) + alpha c(w) / N) / (c(x) + alpha)

    with c(x) and c(x w) the other occurrences of x and of w after it, c(w) all
    occurrences of w, and N all words. Where x is empty, p is c(w) / N. x has no
    greatest length, and counts are over all documents. mean_context is the mean
    length of x. Words are runs of letters, digits, _ and non-ASCII bytes, ASCII
    case folded, told apart by a hash of 48 bits.

    Levels and shards: see the module. ``shard``: tokens shipped to a shard, so
    their number follows the corpus. A suffix that too many positions end with
    for one shard is told from others by one word more, so no shard grows
    with it; the counts of such suffixes, of which a fixed number can be, are
    broadcast. Results don't depend on ``shard``.

    Null, empty and wordless texts have 0 tokens and null figures. Null ids are
    neither scored nor counted. Rows of equal id are summed; their texts, also
    equal ones, each count as often as they occur. Very long texts are one
    context throughout. Ids may be of any type; other columns are left out. An
    empty table gives no rows.

    Runs at once; the rows returned are a checkpoint.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    list_type = pa.list_(to_arrow_type(docs.schema[doc_id].dataType))
    rows = spread(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")))
    with written(_word_counts(rows)) as counts:
        total, _, ranked, n_ranked = _ranked(counts)
    window = WINDOW[0]
    with written(_settled(rows, _documents, 0, total, total * (window + 1), shard, max(total, 1), alpha, kind, list_type, (ranked, n_ranked)), free=True) as mine, _deeper(mine, 1, shard, kind, list_type) as found:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _rows(batches):
                n, bits, depth = _finish_words(x, *_units(x), window, max(total, 1), alpha)
                units = np.rint(bits * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x["ids"], list_type.value_type), pa.array(n), pa.array(units), pa.array(depth)], names=["_id", "n", "units", "depth"])

        own = mine.select("block", "ids", "a", "b", "sizes", "run_doc", "run_next", "run_units", "unit_size", "weights")
        whole = _with_units(own, found).mapInArrow(run, f"_id {kind}, n bigint, units bigint, depth bigint")
        whole = whole.groupBy("_id").agg(F.sum("n").alias("n"), (F.sum("units") / UNIT).alias("bits"), F.sum("depth").alias("depth"))
        some = F.col("n") > 0
        return cut(whole.select(F.col("_id").alias(doc_id), F.col("n").alias("n_tokens"), F.when(some, F.col("bits")).alias("bits"), F.when(some, F.col("bits") / F.col("n")).alias("bits_per_token"), F.when(some, F.col("depth") / F.col("n")).alias("mean_context")))
