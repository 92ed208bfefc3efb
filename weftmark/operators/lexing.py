"""Lexers: source text to normalised tokens with byte spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.functions.symbols import BASIS, MODULUS, PRIME, symbol

_SPACE = r"[ \t\n\x0B\f\r]+"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*(?s:.*?)(?:\*/|\Z)"
_ANY = r"(?s:.)"
_ESC = r"\\(?s:.)"
_NUMBER = r"(?:[0-9]|\.[0-9])[A-Za-z0-9._]*+"


def _one_line(q: str) -> str:
    return rf"{q}(?:[^{q}\\\n]|{_ESC}|\\\Z)*+{q}?"


def _any_lines(q: str) -> str:
    return rf"{q}(?:[^{q}\\]|{_ESC}|\\\Z)*+{q}?"


def _triple(q: str) -> str:
    return rf"{q}{q}{q}(?s:(?:\\.|(?!{q}{q}{q}).)*+)(?:{q}{q}{q})?"


def _operators(*groups: str) -> str:
    return "|".join(re.escape(o) for g in groups for o in g.split())


@dataclass(frozen=True)
class Lexer:
    """A pattern that covers every byte, and how its pieces become tokens.

    Pieces that match ``trivia`` go. Words in ``types`` become T, in ``keywords``
    stay, others become V; numbers become N and literals L; the rest is itself.
    """

    name: str
    parts: tuple[str, ...]
    trivia: str
    literal: str
    types: frozenset[str]
    keywords: frozenset[str]
    word: str = r"[A-Za-z_]"

    @property
    def pattern(self) -> str:
        return "|".join(self.parts)

    def alphabet(self) -> list[str]:
        """All tokens that the lexer can give."""
        found = {"T", "V", "N", "L", *self.keywords, *(chr(i) for i in range(256))}
        return sorted(found | {m for m in _CPP_OPS.split() + _PY_OPS.split() + _JAVA_OPS.split() + _JS_OPS.split()})


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_CPP_TYPES = _words("int void long char bool short float size_t signed double wchar_t uint8_t char8_t unsigned uint64_t uint32_t uint16_t char32_t char16_t")
_CPP_KEYWORDS = _words("or if do xor try not new for asm and true this goto enum else case auto while using union throw or_eq false const compl class catch break bitor xor_eq typeid switch struct static sizeof return public not_eq inline friend extern export delete bitand and_eq virtual typedef private nullptr mutable default concept alignof alignas volatile typename template requires register operator noexcept explicit decltype continue co_yield co_await protected namespace constinit constexpr consteval co_return const_cast static_cast thread_local dynamic_cast static_assert reinterpret_cast")
_PYTHON_TYPES = _words("str set int list dict bool None tuple float bytes")
_PYTHON_KEYWORDS = _words("or is in if as try not for del def and with pass from else elif True yield while raise class break await async False return lambda import global except assert finally nonlocal continue")
_JAVA_TYPES = _words("int void long char byte short float double boolean")
_JAVA_KEYWORDS = _words("if do var try new int for void true this null long goto enum else char case byte yield while throw super short float final false const class catch break throws switch static sealed return record public native import double assert private permits package finally extends default boolean volatile strictfp continue abstract transient protected interface instanceof implements synchronized")
_JAVASCRIPT_TYPES = _words("any void never symbol string object number bigint unknown boolean")
_JAVASCRIPT_KEYWORDS = _words("of in if do as var try new let for with void type true this null from enum else case yield while throw super false const class catch break await async typeof switch static return public import export delete private package finally extends default declare readonly override function debugger continue abstract undefined protected namespace interface instanceof implements")

_CPP_OPS = "... >>= <<= ## ^= |= &= %= /= *= -= += || && != == >= <= >> << -- ++ -> ::"
#: Only operators whose first two characters are an operator too can be reached.
_PY_OPS = "<<= **= //= << ^= |= &= %= /= *= -= += <= >= != == -> := ** //"
_JAVA_OPS = ">>>= >>> >>= <<= -> :: >> << ^= |= &= %= /= *= -= += -- ++ || && <= >= != =="
_JS_OPS = ">>>= **= ??= >>> >>= <<= !== === ** ?? ?. => >> << ^= |= &= %= /= *= -= += -- ++ || && <= >= != =="

LEXERS = {
    "cpp": Lexer(
        "cpp",
        (_SPACE, _LINE, _BLOCK, r'R"([^(]*)\((?s:.*?)\)\1"', r'R"(?s:.*)\Z', rf'"[^"\\]*+(?:{_ESC}[^"\\]*+)*+(?:"|\\?\Z)', rf"'[^'\\]*+(?:{_ESC}[^'\\]*+)*+(?:'|\\?\Z)", r"(?:[0-9]|\.[0-9])(?:[eEpP][+\-]|[A-Za-z0-9_.'])*+", r"[A-Za-z_][A-Za-z0-9_]*+", _operators(_CPP_OPS), _ANY),
        r"^(?:[ \t\n\x0B\f\r]|//|/\*)", r"""^(?:R"|"|')""", _CPP_TYPES, _CPP_KEYWORDS,
    ),
    "python": Lexer(
        "python",
        (_SPACE, r"#[^\n]*", r"""(?:[rRfFbBuU](?=['"])|[fFbBrR]{2}(?=['"]))""", _triple("'"), _triple('"'), _one_line("'"), _one_line('"'), r"[A-Za-z_][A-Za-z0-9_]*+", _NUMBER, _operators(_PY_OPS), _ANY),
        r"^(?:[ \t\n\x0B\f\r]|#)", r"""^['"]""", _PYTHON_TYPES, _PYTHON_KEYWORDS,
    ),
    "java": Lexer(
        "java",
        (_SPACE, _LINE, _BLOCK, "@", r"(?<=@)[A-Za-z0-9_$]+", r"[A-Za-z_$][A-Za-z0-9_$]*+", _triple('"'), _one_line('"'), _one_line("'"), _NUMBER, _operators(_JAVA_OPS), _ANY),
        r"^(?:[ \t\n\x0B\f\r]|//|/\*)", r"""^['"]""", _JAVA_TYPES, _JAVA_KEYWORDS, r"[A-Za-z_$]",
    ),
    "javascript": Lexer(
        "javascript",
        (_SPACE, _LINE, _BLOCK, r"[A-Za-z_$][A-Za-z0-9_$]*+", _any_lines('"'), _any_lines("'"), _any_lines("`"), _NUMBER, _operators(_JS_OPS), _ANY),
        r"^(?:[ \t\n\x0B\f\r]|//|/\*)", r"""^['"`]""", _JAVASCRIPT_TYPES, _JAVASCRIPT_KEYWORDS, r"[A-Za-z_$]",
    ),
}
#: Words as they are: for prose, where a code lexer would make nearly every word V.
VERBATIM = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]|[ \t\n\x0B\f\r]+"
#: Bytes of text that a worker lexes at a time, whole documents; and pieces that it remembers the meaning of.
SLICE, REMEMBERED = 1 << 20, 1 << 19
TRIVIA, PREFIX = -1, -2


def get_lexer(name: str) -> Lexer:
    if name not in LEXERS:
        raise ValueError(f"no lexer for {name!r}")
    return LEXERS[name]


@lru_cache(8)
def alphabet_symbols(lexer: str) -> dict[str, int]:
    return {t: symbol(t) for t in get_lexer(lexer).alphabet()}


class _Meaning(dict):
    """piece -> number: of a code lexer the index of its token in the alphabet, TRIVIA or PREFIX; of words their place in ``names``."""

    def __init__(self, lexer: str):
        super().__init__()
        self.names: list[str] = []
        if lexer == "verbatim":
            self.spec = None
            self.symbols: list[int] = []
            return
        self.spec = spec = get_lexer(lexer)
        self.names = spec.alphabet()
        self.index = {t: i for i, t in enumerate(self.names)}
        self.trivia, self.literal, self.word = re.compile(spec.trivia), re.compile(spec.literal), re.compile(spec.word)
        self.symbols = [alphabet_symbols(lexer)[t] for t in self.names]

    def __missing__(self, piece: bytes) -> int:
        text = piece.decode("latin-1")
        spec = self.spec
        if spec is None:
            if piece[0] in b" \t\n\x0b\f\r":
                if len(piece) < 9:
                    self[piece] = TRIVIA
                return TRIVIA
            found = len(self.names)
            self.names.append(text)
            self.symbols.append(symbol(piece))
        elif self.trivia.match(text):
            if len(piece) < 9:
                self[piece] = TRIVIA
            return TRIVIA
        else:
            if text in spec.types:
                token = "T"
            elif text in spec.keywords:
                token = text
            elif self.literal.match(text):
                return self.index["L"]
            elif text[0] in "0123456789" or (text[0] == "." and text[1:2].isdigit()):
                token = "N"
            elif self.word.match(text):
                token = "V"
            else:
                token = text
            found = PREFIX if spec.name == "python" and re.fullmatch("[rRfFbBuU]|[fFbBrR]{2}", text) else self.index[token]
        self[piece] = found
        return found


@lru_cache(8)
def _finder(lexer: str) -> tuple[Callable[[bytes], list[bytes]], _Meaning]:
    if lexer == "verbatim":
        return re.compile(VERBATIM.encode()).findall, _Meaning(lexer)
    pattern = re.compile(get_lexer(lexer).pattern.encode())
    if not pattern.groups:
        return pattern.findall, _Meaning(lexer)
    # a group in the pattern is for raw strings only; few texts have any, and without the group all pieces come in one call
    plain = re.compile("|".join(p for p in get_lexer(lexer).parts if not p.startswith('R"')).encode())

    def find(raw: bytes) -> list[bytes]:
        return [m.group() for m in pattern.finditer(raw)] if b'R"' in raw else plain.findall(raw)

    return find, _Meaning(lexer)


@dataclass
class Lexed:
    """The tokens of some texts: code, offset and length of each, and where each text's tokens begin (bounds, one more than texts)."""

    code: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    bounds: np.ndarray
    meaning: _Meaning

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @property
    def pos(self) -> np.ndarray:
        return np.arange(len(self.code)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def text(self) -> pa.Array:
        return pa.array(self.meaning.names, pa.string()).take(pa.array(self.code))

    def symbols(self) -> np.ndarray:
        return np.array(self.meaning.symbols, np.int64)[self.code]

    def where(self, keep: np.ndarray) -> Lexed:
        kept = np.concatenate([[0], np.cumsum(keep)])
        return Lexed(self.code[keep], self.offset[keep], self.length[keep], kept[self.bounds], self.meaning)


def lex(texts: list[bytes | None], lexer: str) -> Lexed:
    find, meaning = _finder(lexer)
    if len(meaning) > REMEMBERED:
        meaning.clear()
        if lexer == "verbatim":
            meaning.names, meaning.symbols = [], []
    pieces = [find(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = [p for own in pieces for p in own]
    code = np.fromiter(map(meaning.__getitem__, flat), np.int64, len(flat))
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    ends = np.cumsum(length)
    first = np.append(0, ends)[bounds[:-1]]
    offset = ends - length - np.repeat(first, counts)
    if lexer == "python":
        # a prefix goes where a string follows; elsewhere it's a name
        quote = np.fromiter((p[0] in b"'\"" for p in flat), bool, len(flat)) if (code == PREFIX).any() else np.zeros(len(flat), bool)
        following = np.append(quote[1:], False)
        following[bounds[1:][bounds[1:] > 0] - 1] = False
        code[(code == PREFIX) & following] = TRIVIA
        code[code == PREFIX] = meaning.index["V"]
    if lexer == "java":
        at = meaning.index["@"]
        for i in (np.flatnonzero(code[:-1] == at) + 1).tolist():
            if i not in bounds and (chr(flat[i][0]).isalnum() and flat[i][0] < 128 or flat[i][0] in b"_$"):
                code[i] = meaning.index["V"]
    return Lexed(code, offset, length, bounds, meaning).where(code != TRIVIA)


#: Of each byte: 0 space, 1 part of a word, 2 a token by itself.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = 1
#: Bytes of a token up to which those of all tokens are hashed side by side.
SIDE_BY_SIDE = 64


class Hashed(Lexed):
    """The tokens of some texts without their names: ``symbols`` are known, ``code`` and ``text`` are not."""

    def __init__(self, symbols: np.ndarray, offset: np.ndarray, length: np.ndarray, bounds: np.ndarray):
        super().__init__(np.zeros(0, np.int64), offset, length, bounds, _Meaning("verbatim"))
        self._symbols = symbols

    def symbols(self) -> np.ndarray:
        return self._symbols


def hash_words(texts: list[bytes | None]) -> Hashed:
    """As ``lex`` by VERBATIM, by arrays over the bytes of all texts; for readers that need no names."""
    raw = b"".join(t for t in texts if t)
    text = np.frombuffer(raw, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)))])
    kind = _KIND[text]
    word = kind == 1
    linked = np.zeros(len(text) + 1, bool)  # of a byte and the one before it, of one word
    linked[1:-1] = word[1:] & word[:-1]
    linked[offsets] = False
    begin = np.flatnonzero((kind != 0) & ~linked[:-1])
    length = np.flatnonzero((kind != 0) & ~linked[1:]) + 1 - begin
    bounds = np.searchsorted(begin, offsets)
    order = np.argsort(-np.minimum(length, SIDE_BY_SIDE + 1).astype(np.int16), kind="stable")
    at, hash_ = begin[order], np.full(len(begin), BASIS, np.uint64)
    longer = len(begin) - np.cumsum(np.bincount(np.minimum(length, SIDE_BY_SIDE + 1), minlength=SIDE_BY_SIDE + 2))
    with np.errstate(over="ignore"):
        for j in range(SIDE_BY_SIDE):
            n = int(longer[j])  # tokens of more than j bytes
            if not n:
                break
            hash_[:n] = (hash_[:n] ^ text[at[:n] + j]) * np.uint64(PRIME)
    symbols = np.empty(len(begin), np.int64)
    symbols[order] = (hash_ % np.uint64(MODULUS - 1)).astype(np.int64) + 1
    for i in order[: int(longer[SIDE_BY_SIDE])].tolist():
        symbols[i] = symbol(raw[begin[i] : begin[i] + length[i]])
    return Hashed(symbols, begin - np.repeat(offsets[:-1], np.diff(bounds)), length, bounds)


def map_lexed(docs: DataFrame, lexer: str, key: str, source: str, schema: str, rows: Callable[[pa.Array, Lexed], pa.RecordBatch], named: bool = True) -> DataFrame:
    """Lexes the documents and hands ``rows`` the keys and tokens of about SLICE bytes of whole texts at a time.

    Lexing is a scan with state, which column functions could only do by
    sorting one row a piece; so it runs over Arrow batches in the workers, and no
    row leaves its task. ``named``: False if ``rows`` reads no names of tokens.
    """
    if lexer != "verbatim":
        get_lexer(lexer)
    hashed = lexer == "verbatim" and not named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                end = max(int(np.searchsorted(sizes, done + SLICE, "right")), at + 1)
                part = batch.slice(at, end - at)
                texts = part.column(1).to_pylist()
                yield rows(part.column(0), hash_words(texts) if hashed else lex(texts, lexer))
                at = end

    return spread(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("binary").alias("source"))).mapInArrow(run, schema)


#: Bytes of a table, for each core, up to which it is dealt out anew if it lies in fewer files than there are cores.
SMALL = 128 << 20


def spread(docs: DataFrame) -> DataFrame:
    """A small table whose few files may not split over all cores (a row group is never split) is dealt out; others stay as they lie."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.isStreaming or not 0 < len(docs.inputFiles()) < cores:
        return docs
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * SMALL else docs


def key_type(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def tokenize(docs: DataFrame, lexer: str = "cpp", key: str = "doc_id", source: str = "text") -> DataFrame:
    """Tokens (doc_id, pos, text, offset, length) of each document; offset and length are bytes of the source.

    ``source`` is a string or binary column. "verbatim" gives the words and
    single other bytes as they are. A document without tokens has no rows;
    rows of equal id are lexed apart.
    """

    def rows(keys: pa.Array, x: Lexed) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(x.owner)), pa.array(x.pos), x.text(), pa.array(x.offset), pa.array(x.length)], names=["doc_id", "pos", "text", "offset", "length"])

    return map_lexed(docs, lexer, key, source, f"doc_id {key_type(docs, key)}, pos bigint, text string, offset bigint, length bigint", rows)
