"""Benchmark decontamination by a generalised suffix automaton (operator 6)."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftmark.llm.textbytes import Words, buffer, ngrams, pieces
from weftmark.operators.lexing import spread

#: A match of this many tokens is removed whatever surrounds it.
MAX_TOKENS = 10
#: Shorter matches down to this length are removed where together they pass COVERAGE.
MIN_TOKENS = 5
#: Greatest share of a document's tokens, or of an item's, that short matches may cover.
COVERAGE = 0.5
#: Bytes of items in one automaton, so that building one takes a worker some 200 MB; more items make several, which
#: are kept in some 10 bytes for each byte of items, and of which a text is put to those that share MIN_TOKENS tokens with it.
AUTOMATON_BYTES = 1 << 20


class SuffixAutomaton:
    """All substrings of several token sequences: a unique separator, which no document holds, parts the items."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.end = [-1]  # where the first occurrence of the state's strings ends
        self.cloned = [True]  # no occurrence of its own, only those of the states that link to it
        self.begins: list[int] = []
        self._below: list[list[int]] | None = None
        self._holders: dict[int, dict[int, int]] = {}
        last = at = 0
        for i, item in enumerate(items):
            self.begins.append(at)
            for token in [*item, -1 - i]:
                last = self._extend(last, token, at)
                at += 1
        self._freeze()

    def _freeze(self) -> None:
        """Most states have one way on: it goes to two arrays, and only the others keep a dict."""
        self.token, self.to = array("i", [0]) * len(self.next), array("i", [-1]) * len(self.next)
        self.more: dict[int, dict[int, int]] = {}
        for s, ways in enumerate(self.next):
            if len(ways) == 1:
                ((self.token[s], self.to[s]),) = ways.items()
            elif ways:
                self.more[s] = ways
        self.next = []
        self.link, self.length, self.end = array("i", self.link), array("i", self.length), array("i", self.end)

    def follow(self, state: int, token: int) -> int:
        """The state after ``token``, -1 for none."""
        if (to := self.to[state]) >= 0:
            return to if self.token[state] == token else -1
        ways = self.more.get(state)
        return ways.get(token, -1) if ways else -1

    def _extend(self, last: int, token: int, at: int) -> int:
        new = self._state({}, self.length[last] + 1, at)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
            return new
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.end[q], True)
        self.link[clone] = self.link[q]
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = self.link[new] = clone
        return new

    def _state(self, following: dict[int, int], length: int, end: int, cloned: bool = False) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(-1)
        self.end.append(end)
        self.cloned.append(cloned)
        return len(self.next) - 1

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(begin, end, item, place in the item) of each longest match that can't be prolonged and has ``least`` tokens."""
        out = []
        follow, link, length, end = self.follow, self.link, self.length, self.end
        state = size = 0
        for i, t in enumerate(tokens):
            if (to := follow(state, t)) >= 0:
                state = to
                size += 1
                continue
            if size >= least:
                out.append((i - size, i, end[state], size))
            while state and follow(state, t) < 0:
                state = link[state]
            size = length[state]
            if (to := follow(state, t)) < 0:
                size = 0
            else:
                state = to
                size += 1
        if size >= least:
            out.append((len(tokens) - size, len(tokens), end[state], size))
        found = []
        for a, b, e, size in out:
            item = bisect_right(self.begins, e) - 1
            found.append((a, b, item, e + 1 - size - self.begins[item]))
        return found

    def holders(self, state: int) -> dict[int, int]:
        """item -> where the first occurrence of the state's strings in it ends, for every item that holds them."""
        if (known := self._holders.get(state)) is not None:
            return known
        if self._below is None:
            self._below = [[] for _ in self.link]
            for s, to in enumerate(self.link[1:], 1):
                self._below[to].append(s)
        found: dict[int, int] = {}
        left = [state]
        while left:
            s = left.pop()
            left += self._below[s]
            if not self.cloned[s]:
                item = bisect_right(self.begins, self.end[s]) - 1
                found[item] = min(self.end[s], found.get(item, self.end[s]))
        self._holders[state] = found
        return found

    def item_matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """As ``matches`` of each item by itself, so no item's matches depend on which others there are."""
        found = []
        follow, link, length = self.follow, self.link, self.length
        running: dict[int, tuple[int, int]] = {}  # item -> (begin, place in the item)
        state = size = 0
        for i, t in enumerate(tokens):
            while (to := follow(state, t)) < 0 and state:
                state = link[state]
                size = length[state]
            if to >= 0:
                state = to
                size += 1
            now: dict[int, tuple[int, int]] = {}
            s, n = state, size
            while n >= least:
                for item, e in self.holders(s).items():
                    if item not in now:
                        now[item] = (i + 1 - n, e + 1 - n - self.begins[item])
                s = link[s]
                n = length[s]
            found += [(a, i, item, place) for item, (a, place) in running.items() if item not in now or now[item][0] != a]
            running = now
        found += [(a, len(tokens), item, place) for item, (a, place) in running.items()]
        return found


@lru_cache(None)
def _automaton(hashes: bytes, bounds: tuple[int, ...]) -> tuple[SuffixAutomaton, np.ndarray]:
    words = np.frombuffer(hashes, np.uint64)
    vocabulary, ids = np.unique(words, return_inverse=True)
    tokens = ids.tolist()
    return SuffixAutomaton([tokens[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]), vocabulary


def spans(matches: list[tuple[int, int, int, int]], n_tokens: int, item_sizes: list[int], max_tokens: int, coverage: float) -> list[tuple[int, int, int]]:
    """The (begin, end, item) to remove, in order and apart."""
    chosen = {m for m in matches if m[1] - m[0] >= max_tokens}
    if sum(b - a for a, b in _union([(m[0], m[1]) for m in matches])) > coverage * n_tokens:
        chosen |= set(matches)
    by_item: dict[int, list[tuple[int, int, int, int]]] = {}
    for m in matches:
        by_item.setdefault(m[2], []).append(m)
    for item, own in by_item.items():
        if sum(b - a for a, b in _union([(m[3], m[3] + m[1] - m[0]) for m in own])) > coverage * item_sizes[item]:
            chosen |= set(own)
    out = []
    for a, b in _union([(m[0], m[1]) for m in chosen]):
        out.append((a, b, max((m for m in chosen if a <= m[0] and m[1] <= b), key=lambda m: (m[1] - m[0], -m[2]))[2]))
    return out


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(items: DataFrame, item_id: str, text: str, limit: int) -> list[tuple[list, bytes, tuple[int, ...]]]:
    """The items by automaton: (ids, token hashes, bounds). Items come to the driver a part at a time, cut by size."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.lower(text).alias("t")).orderBy("i", "t").toLocalIterator()
    parts, ids, texts, size = [], [], [], 0

    def close():
        if ids:
            column = pa.array(texts, pa.string())
            words = [Words(raw, offsets) for _, raw, offsets in pieces(column)]
            hashes = np.concatenate([w.hash for w in words])
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.bounds) for w in words]))])
            parts.append((list(ids), hashes.tobytes(), tuple(bounds.tolist())))

    for r in rows:
        if ids and size + len(r.t) > limit:
            close()
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
    close()
    return parts


def _matches(column: pa.Array, part: tuple[list, bytes, tuple[int, ...]], first_item: int, least: int) -> dict[int, tuple[int, list[tuple[int, int, int, int]]]]:
    """row -> (tokens, matches with the part's items, which count from ``first_item``)."""
    _, hashes, bounds = part
    automaton, vocabulary = _automaton(hashes, bounds)
    found: dict[int, tuple[int, list[tuple[int, int, int, int]]]] = {}
    if not len(vocabulary):
        return found
    for at, raw, offsets in pieces(pc.utf8_lower(column)):
        words = Words(raw, offsets)
        spot = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
        known = vocabulary[spot] == words.hash
        # a match lies within a run of known words of one text
        edge = np.zeros(len(known) + 1, bool)
        edge[words.bounds] = True
        begin = np.flatnonzero(known & (np.append(True, ~known[:-1]) | edge[:-1])) if len(known) else np.zeros(0, int)
        stop = np.flatnonzero(known & (np.append(~known[1:], True) | edge[1:])) + 1 if len(known) else begin
        long = stop - begin >= least
        begin, stop = begin[long], stop[long]
        owner = np.searchsorted(words.bounds, begin, "right") - 1
        for a, b, i in zip(begin.tolist(), stop.tolist(), owner.tolist(), strict=True):
            if m := automaton.item_matches(spot[a:b].tolist(), least):
                shift = a - int(words.bounds[i])
                own = found.setdefault(at + i, (int(words.bounds[i + 1] - words.bounds[i]), []))[1]
                own.extend((x + shift, y + shift, item + first_item, place) for x, y, item, place in m)
    return found


@dataclass
class _Items:
    """The parts, and in which of them each run of ``least`` tokens occurs: (gram, part) by gram."""

    parts: list[tuple[list, bytes, tuple[int, ...]]]
    least: int
    grams: np.ndarray
    part: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[list, bytes, tuple[int, ...]]], least: int) -> _Items:
        grams, part = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for k, (_, hashes, bounds) in enumerate(parts):
            own = np.unique(ngrams(np.frombuffer(hashes, np.uint64), np.array(bounds), least)[0])
            grams.append(own)
            part.append(np.full(len(own), k, np.int32))
        grams, part = np.concatenate(grams), np.concatenate(part)
        order = np.argsort(grams, kind="stable")
        return cls(parts, least, grams[order], part[order])

    def texts_by_part(self, column: pa.Array) -> dict[int, np.ndarray]:
        """part -> the texts that share a gram with it; no other text can have a match."""
        at_, part_ = [], []
        for at, raw, offsets in pieces(pc.utf8_lower(column)):
            words = Words(raw, offsets)
            grams, bounds = ngrams(words.hash, words.bounds, self.least)
            low = np.searchsorted(self.grams, grams)
            hit = np.flatnonzero(self.grams[np.minimum(low, len(self.grams) - 1)] == grams)
            text = at + np.searchsorted(bounds, hit, "right") - 1
            low, high = low[hit], np.searchsorted(self.grams, grams[hit], "right")
            at_.append(np.repeat(text, high - low))
            part_.append(self.part[np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())])
        text, part = np.concatenate([np.zeros(0, np.int64), *at_]), np.concatenate([np.zeros(0, np.int32), *part_])
        return {int(k): np.unique(text[part == k]) for k in np.unique(part)}


def _find(batches: Iterator[pa.RecordBatch], at: int, items: _Items, max_tokens: int, coverage: float) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, list[tuple[int, int, int, int]]]]]]:
    """Each batch with (row, tokens, [(first byte, last byte, item, tokens)]) of its texts, in column ``at``, with anything to remove.

    A text is judged by its matches with the items of all parts together.
    """
    sizes = [n for _, _, bounds in items.parts for n in np.diff(bounds).tolist()]
    first = np.cumsum([0, *[len(bounds) - 1 for _, _, bounds in items.parts]]).tolist()
    for batch in batches:
        column = batch.column(at)
        found: dict[int, tuple[int, list]] = {}
        for k, texts in (items.texts_by_part(column) if len(items.grams) else {}).items():
            for r, (n, m) in _matches(column.take(pa.array(texts)), items.parts[k], first[k], items.least).items():
                found.setdefault(int(texts[r]), (n, []))[1].extend(m)
        out = []
        for r in sorted(found):
            n, m = found[r]
            if cutting := spans(m, n, sizes, max_tokens, coverage):
                original = np.frombuffer(column[r].as_py().encode(), np.uint8)
                own = Words(original, np.array([0, len(original)]))
                out.append((r, n, [(int(own.start[a]), int(own.end[b - 1]), item, b - a) for a, b, item in cutting]))
        yield batch, out


def _without(text: str, removed: list[tuple[int, int, int, int]]) -> str:
    raw, at, kept = text.encode(), 0, []
    for a, b, *_ in removed:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def contamination(docs: DataFrame, items: DataFrame, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The contaminated documents: doc_id, item_ids, spans, n_tokens, removed_tokens, clean_text.

    Tokens are runs of letters, digits, _ and non-ASCII characters in lower
    case, so case, punctuation and white space don't matter. The items' suffix
    automaton reads each document's tokens and gives the longest match that ends
    at each. A match of ``max_tokens`` is removed; matches of ``min_tokens`` are
    removed too where they cover more than ``coverage`` of the document, or of
    one item. A span holds first and last byte (UTF-8), item and tokens.

    Items of up to ``automaton_bytes`` make one automaton, and more make several,
    all of which go to the workers, so a worker needs some 20 bytes for each byte
    of items; texts are read once, and the rows are those of a single automaton.

    Overlapping and adjoining matches make one span, which names the longest of
    them, of equal ones the smallest item. Texts of any length are read whole.
    Ids of documents and items may be of any type that sorts. Null and empty texts and items match nothing; equal items are reported by
    the smallest id. Repeated rows give repeated results, null ids are kept,
    other columns are left out. No items or no documents: no rows.
    """
    rows = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    schema = f"_key {kind}, item_ids array<{item_kind}>, spans array<struct<start:int,end:int,item_id:{item_kind},tokens:int>>, n_tokens int, removed_tokens int, clean_text string"
    parts = _parts(items, item_id, item_text, automaton_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(_Items.of(parts, max(min(min_tokens, max_tokens), 1)))
    ids = [i for part in parts for i in part[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _find(batches, 1, shared.value, max_tokens, coverage):
            keys = batch.column(0).take(pa.array([r for r, _, _ in got], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([sorted({ids[s[2]] for s in x}, key=lambda v: (v is None, v)) for _, _, x in got], pa.list_(item_type)),
                    pa.array([[{"start": a, "end": b, "item_id": ids[i], "tokens": t} for a, b, i, t in x] for _, _, x in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item_id", item_type), ("tokens", pa.int32())]))),
                    pa.array([n for _, n, _ in got], pa.int32()),
                    pa.array([sum(s[3] for s in x) for _, _, x in got], pa.int32()),
                    pa.array([_without(batch.column(1)[r].as_py(), x) for r, _, x in got], pa.string()),
                ],
                names=["_key", "item_ids", "spans", "n_tokens", "removed_tokens", "clean_text"],
            )

    return spread(rows).mapInArrow(run, schema).withColumnRenamed("_key", doc_id)


def decontaminate(docs: DataFrame, items: DataFrame, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, coverage: float = COVERAGE, text: str = "text", length: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents without the spans that ``contamination`` finds; all columns stay.

    ``length`` is set anew where the text changes, if there is such a column. A
    document of which no word is left is dropped; null, empty and wordless
    texts that hold no match stay as they are, as do null ids and repeated rows,
    each judged by itself; an empty table gives none. See ``contamination``.
    """
    at, size = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(_Items.of(_parts(items, item_id, item_text, automaton_bytes), max(min(min_tokens, max_tokens), 1)))

    def clean(batch: pa.RecordBatch, got: list) -> pa.RecordBatch:
        column = batch.column(at)
        found = {r: _without(column[r].as_py(), removed) for r, _, removed in got}
        if not found:
            return batch
        rows = np.array(sorted(found))
        changed = np.zeros(batch.num_rows, bool)
        changed[rows] = True
        texts = pa.array([found[r] for r in rows.tolist()], column.type)
        columns = list(batch.columns)
        columns[at] = pc.replace_with_mask(column, pa.array(changed), texts)
        if size is not None:
            columns[size] = pc.replace_with_mask(columns[size], pa.array(changed), pc.utf8_length(texts).cast(columns[size].type))
        keep = ~changed
        keep[rows] = [len(Words(*buffer(texts.slice(i, 1))).start) > 0 for i in range(len(rows))]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _find(batches, at, shared.value, max_tokens, coverage):
            yield clean(batch, got)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return spread(plain).mapInArrow(run, plain.schema).toDF(*docs.columns)
