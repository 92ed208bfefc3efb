"""Toxicity by a weighted finite-state grammar over clauses (operator 3)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.textbytes import Words, hash_word, map_rows, pieces
from weftmark.operators.lexing import spread

#: Labelled documents that the lexicon is learned from at most; those of the smallest id hashes are taken.
MAX_LABELLED = 4000
#: Summed clause score from which a document is toxic.
THRESHOLD = 1.0

INSULT = "idiot idiots moron morons imbecile fool loser losers clown scum trash scumbag bastard bitch asshole dumbass retard stupid worthless pathetic disgusting despicable idiotisch dummkopf trottel abschaum wertlos widerlich depp arschloch idiote imbécile crétin connard salope minable pathétique dégoûtant estúpido idiota imbécil escoria patético asqueroso inútil cabrón".split()
#: Insults only where they are said of someone.
WEAK = "garbage vermin filth dumb dumm ordure basura".split()
THREAT = "kill murder strangle slaughter exterminate stab hang umbringen töten abstechen erschießen tuer égorger étrangler massacrer matar asesinar degollar".split()
#: Verbs that threaten only with a particle after the person: beat you up.
PHRASAL = "beat hunt burn cut tear put mow".split()
PARTICLE = "up down apart out".split()
TARGET = "you you're youre yourself yourselves he she they them him himself herself themselves du dich dir ihr euch sie ihn ihm vous toi te il elle ils elles tú te usted ustedes vosotros ellos ella".split()
POSSESSIVE = "your his her their dein deine deinen seine votre vos ton ta tes tu tus su sus".split()
PASSIVE = "be been being get gets werden wird être sera ser será".split()
#: Words end at an apostrophe, so "isn't" is known by "isn".
NEGATION = "not no never isn isnt aren arent wasn wasnt weren don dont doesn didn won wont wouldn shouldn couldn nor without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin".split()
REPORT = "said says claimed claims wrote writes alleged alleges reported reports quoted quote quotes according called testified sagte schrieb behauptete zitierte laut dit écrit affirmé selon cita dijo escribió afirmó según".split()
#: What one may kill or hang without harm to anyone.
HARMLESS = "bacteria germs mold weeds virus viruses process processes job engine motor light lights noise pain appetite time coat coats jacket hat picture pictures poster posters curtain curtains laundry washing clothes wallpaper bakterien keime unkraut prozess zeit mantel jacke bild bilder wäsche bactéries germes processus temps manteau tableau linge bacterias gérmenes proceso tiempo abrigo cuadro ropa".split()
#: piece of ..., waste of ...
HEAD, OF, TAIL = "piece waste sack load stück bout".split(), "of de".split(), "shit crap dirt space oxygen breath scheiße merde mierda".split()

# transducers: (state, symbol) -> (state, symbol, weight); start state 0


@dataclass
class Transducer:
    arcs: dict[tuple, tuple] = field(default_factory=dict)

    def compose(self, other: Transducer) -> Transducer:
        """Runs ``other`` on this one's output; weights multiply. Only states reached from the start are built."""
        out, todo, done = Transducer(), [(0, 0)], {(0, 0): 0}
        symbols = sorted({s for _, s in self.arcs})
        while todo:
            a, b = todo.pop()
            for s in symbols:
                a2, middle, w = self.arcs[a, s]
                b2, end, v = other.arcs[b, middle]
                if (a2, b2) not in done:
                    done[a2, b2] = len(done)
                    todo.append((a2, b2))
                out.arcs[done[a, b], s] = (done[a2, b2], end, w * v)
        return out


#: Classes of words: other, insult, weak insult, threat, phrasal verb, particle, target, possessive, passive, negation, report, harmless, head, of, tail.
CLASSES = "oIJTKDYZPNRHWFX"
#: What a clause consists of after ``_following``: a threat or insult with its target behind it, and a threat to what is harmless.
MARKED = [*CLASSES, "I>", "J>", "T>", "t"]
_HURTS = ("I", "I>", "I+", "J", "J>", "J+", "T", "T>")


def _machine(symbols: list[str], start, step) -> Transducer:
    """The transducer whose states are the values that ``step(state, symbol) -> (state, symbol, weight)`` reaches from ``start``."""
    t, number, todo = Transducer(), {start: 0}, [start]
    while todo:
        state = todo.pop()
        for s in symbols:
            to, out, w = step(state, s)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            t.arcs[number[state], s] = (number[to], out, w)
    return t


def _following(scope: int = 3) -> Transducer:
    """Read from the clause's end: a person up to ``scope`` words behind a threat or insult is its target; a harmless thing, also someone's, makes a threat none.

    A phrasal verb is a threat if a person and a particle follow.
    """

    def step(state, s):
        seen, left = state
        after = (seen, left - 1) if left > 1 else ("", 0)
        if s in "IJ":
            return after, s + ">" if seen in ("Y", "YD") else s, 1.0
        if s == "T":
            return after, {"": "T", "D": "T", "H": "t"}.get(seen, "T>"), 1.0
        if s == "K":
            return after, "T>" if seen == "YD" else "K", 1.0
        if s == "Y":
            return ("YD" if seen == "D" and left == scope else "Y", scope), s, 1.0
        if s == "Z":
            return (after if seen == "H" else ("Y", scope)), s, 1.0
        if s in "HD":
            return (s, scope), s, 1.0
        return after, s, 1.0

    return _machine(list(CLASSES), ("", 0), step)


def _phrases(scope: int = 2) -> Transducer:
    """piece of (up to ``scope`` words) shit: an insult, whatever its last word is by itself."""

    def step(state, s):
        if s == "W":
            return -1, s, 1.0
        if s == "F" and state == -1:
            return scope + 1, s, 1.0
        if state > 0 and s in ("X", "J", "J>", "I"):
            return 0, "I>" if s == "J>" else "I", 1.0
        return max(state - 1, 0), s, 1.0

    return _machine(MARKED, 0, step)


def _negation(scope: int = 3) -> Transducer:
    """An insult or threat up to ``scope`` words after a negation keeps a quarter of its weight."""
    return _machine(MARKED, 0, lambda left, s: (scope if s == "N" else max(left - 1, 0), s, 0.25 if left and s in _HURTS else 1.0))


def _reported() -> Transducer:
    """After a verb of saying, insults and threats of the clause are someone's words: 0.4 of the weight."""
    return _machine(MARKED, 0, lambda on, s: (1 if s == "R" else on, s, 0.4 if on and s in _HURTS else 1.0))


def _preceding(scope: int = 4) -> Transducer:
    """A person up to ``scope`` words before an insult is its target; before a threat, if it is in the passive: you will be hanged."""

    def step(state, s):
        person, passive = state
        after = (max(person - 1, 0), max(passive - 1, 0))
        if s in ("I", "J"):
            return after, s + "+" if person else s, 1.0
        if s == "T":
            return after, "T>" if passive else s, 1.0
        if s in ("Y", "Z"):
            return (scope, after[1]), s, 1.0
        if s == "P" and person:
            return (after[0], scope), s, 1.0
        return after, s, 1.0

    return _machine(MARKED, (0, 0), step)


def _score() -> Transducer:
    worth = {"I": 1.0, "I>": 1.5, "I+": 1.5, "J": 0.5, "J>": 1.5, "J+": 1.5, "T": 0.5, "T>": 2.0}
    return _machine([*MARKED, "I+", "J+"], 0, lambda _, s: (0, "", worth.get(s, 0.0)))


@lru_cache(1)
def grammar() -> tuple[list[dict[str, tuple[int, str]]], list[dict[str, tuple[int, float]]]]:
    """(table read backwards, table read forwards): state -> class -> (state, symbol or score). The second is composed of all other transducers."""
    back = _following()
    marks: list[dict[str, tuple[int, str]]] = [{} for _ in range(1 + max(s for s, _ in back.arcs))]
    for (state, symbol), (to, out, _) in back.arcs.items():
        marks[state][symbol] = (to, out)
    whole = _phrases().compose(_negation()).compose(_reported()).compose(_preceding()).compose(_score())
    table: list[dict[str, tuple[int, float]]] = [{} for _ in range(1 + max(s for s, _ in whole.arcs))]
    for (state, symbol), (to, _, weight) in whole.arcs.items():
        table[state][symbol] = (to, weight)
    return marks, table


def clause_score(classes: str) -> float:
    """The score of a clause given as one letter of CLASSES a word."""
    marks, table = grammar()
    state, marked = 0, []
    for c in reversed(classes):
        state, m = marks[state][c]
        marked.append(m)
    state, total = 0, 0.0
    for m in reversed(marked):
        state, w = table[state][m]
        total += w
    return total


# words


@dataclass(frozen=True)
class Lexicon:
    """words: word -> class in all languages; stems: (language, stem) whose words are insults in texts of the language."""

    words: tuple[tuple[str, str], ...]
    stems: tuple[tuple[str | None, str], ...] = ()


_WORDS = (
    ("F", OF), ("W", HEAD), ("D", PARTICLE), ("P", PASSIVE), ("H", HARMLESS), ("Z", POSSESSIVE), ("Y", TARGET), ("N", NEGATION), ("R", REPORT), ("X", TAIL), ("K", PHRASAL), ("J", WEAK), ("T", THREAT), ("I", INSULT),
)
BASE = Lexicon(tuple((w, c) for c, ws in _WORDS for w in ws))


def _clusters(texts: list[str], common: set[str]) -> list[int]:
    """Texts that share a line of six words, but for common lines, count as one witness."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        for line in {x for x in re.split(r"[\n.]", t) if x.count(" ") >= 5} - common:
            parent[root(i)] = root(seen.setdefault(line, i))
    return [root(i) for i in range(len(texts))]


def learn(rows: list[tuple[str | None, str, int]], least: int = 3, share: float = 0.05, impurity: float = 0.02) -> Lexicon:
    """Adds to BASE the stems of 4 to 10 letters that mark the toxic among labelled (language, text, toxic) rows.

    A stem is taken, for its language, if words that begin with it occur in
    ``least`` and ``share`` of the unrelated toxic texts and, for each of these,
    in ``impurity`` clean texts at most. Of stems that cover the same texts the
    longest is taken, and none that another one covers.
    """
    known = {w for w, c in BASE.words if c in "IJTKX"}
    stems: list[tuple[str | None, str]] = []
    by_lang: dict[str | None, tuple[list[str], list[str]]] = defaultdict(lambda: ([], []))
    for lang, text, toxic in rows:
        by_lang[lang][1 if toxic else 0].append(text.lower())
    for lang in sorted(by_lang, key=str):
        clean, toxic = by_lang[lang]
        if len(toxic) < least or not clean:
            continue
        lines = {x for t in clean for x in re.split(r"[\n.]", t)}
        witness = _clusters(toxic, lines)

        def prefixes(text: str) -> set[str]:
            return {w[:k] for w in set(re.findall(r"\w+", text)) for k in range(4, min(len(w), 10) + 1)}

        where: dict[str, set[int]] = defaultdict(set)
        for i, t in zip(witness, toxic, strict=True):
            for p in prefixes(t):
                where[p].add(i)
        enough = max(least, share * len(set(witness)))
        where = {p: s for p, s in where.items() if len(s) >= enough}
        against: Counter[str] = Counter()
        for t in clean:
            against.update(prefixes(t) & where.keys())
        good = {p: s for p, s in where.items() if against[p] <= impurity * len(s)}
        chosen: list[str] = []
        for p in sorted(good, key=lambda p: (len(p), p)):
            if any(p.startswith(c) for c in chosen) or any(p.startswith(w) or w.startswith(p) for w in known):
                continue
            longest = p
            while more := [q for q in good if len(q) == len(longest) + 1 and q.startswith(longest) and len(good[q]) >= 0.95 * len(good[p])]:
                longest = max(more, key=lambda q: (len(good[q]), q))
            chosen.append(longest)
        stems += [(lang, c) for c in chosen]
    return Lexicon(BASE.words, tuple(stems))


def learn_from(docs: DataFrame, labels: DataFrame | None, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", label: str = "toxic") -> Lexicon:
    """``learn`` on at most ``max_labelled`` labelled documents. None, or no labels: BASE."""
    if labels is None:
        return BASE
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(max_labelled)
    language = F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_d"), language.alias("l"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(sample), F.col("_d") == F.col("_id")).select("l", "t", "_toxic").collect()
    return learn(sorted({(r.l, r.t, r._toxic) for r in rows}, key=str))


# scoring

_HURTING = np.zeros(256, bool)
_HURTING[[ord(c) for c in "IJTKX"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:\n\r"]] = True


@lru_cache(4)
def _compiled(lexicon: Lexicon):
    words = {hash_word(w.lower()): c for w, c in lexicon.words}
    keys = np.array(sorted(words), np.uint64)
    classes = np.array([ord(words[int(k)]) for k in keys], np.uint8)
    stems: dict[int, dict[int, set[str | None]]] = defaultdict(lambda: defaultdict(set))
    for lang, stem in lexicon.stems:
        raw = stem.encode()
        stems[len(raw)][hash_word(stem)].add(lang)
    return keys, classes, {n: (np.array(sorted(h), np.uint64), [h[int(k)] for k in np.array(sorted(h), np.uint64)]) for n, h in stems.items()}


def _member(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spot = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[spot] == values, spot


def score_column(column: pa.Array, langs: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """(row, [(score, first byte, last byte) of each clause that scores]) of the texts with any. Bytes are of the lower-cased text."""
    keys, classes, stems = _compiled(lexicon)
    for at, raw, offsets in pieces(pc.utf8_lower(column)):
        words = Words(raw, offsets)
        if not len(words.hash):
            continue
        hit, spot = _member(keys, words.hash)
        kind = np.where(hit, classes[spot], np.uint8(ord("o")))
        owner = None
        for n, (hashes, who) in stems.items():
            long = np.flatnonzero(words.end - words.start >= n)
            found, which = _member(hashes, words.span_hash(words.start[long], words.start[long] + n))
            if found.any():
                owner = np.searchsorted(words.bounds, np.arange(len(kind)), "right") - 1 if owner is None else owner
                for w, k in zip(long[found].tolist(), which[found].tolist(), strict=True):
                    lang = langs[at + int(owner[w])].as_py()
                    if lang is None or None in who[k] or lang in who[k]:
                        kind[w] = ord("I")
        bad = np.flatnonzero(_HURTING[kind])
        if not len(bad):
            continue
        breaks = np.union1d(np.flatnonzero(_BREAK[raw]), offsets[:-1])
        clause = np.searchsorted(breaks, words.start, "right")
        texts = np.searchsorted(words.bounds, bad, "right") - 1
        out: dict[int, list[tuple[float, int, int]]] = {}
        letters = kind.tobytes().decode()
        for c, t in dict.fromkeys(zip(clause[bad].tolist(), texts.tolist(), strict=True)):
            a, b = max(int(np.searchsorted(clause, c)), int(words.bounds[t])), min(int(np.searchsorted(clause, c, "right")), int(words.bounds[t + 1]))
            if score := clause_score(letters[a:b]):
                out.setdefault(t, []).append((score, int(words.start[a] - offsets[t]), int(words.end[b - 1] - offsets[t])))
        for t, found in out.items():
            yield at + t, found


def scores(docs: DataFrame, lexicon: Lexicon = BASE, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The documents with any scored clause: doc_id, score, clauses.

    Words become classes by the lexicon. Each clause (up to . ! ? ; : or a
    line's end) is read twice: backwards by a transducer that gives insults and
    threats the target or the harmless thing behind them, and forwards by one
    that is composed of those for phrases, negation, reported speech, targets
    before and weights. score is the sum over all clauses of a text. An insult
    counts 1, with a target on either side 1.5, a weak one 0.5 without; a threat
    to someone 2, to no one named 0.5, to a harmless thing 0; a quarter after a
    negation, 0.4 after a verb of saying.

    Null and empty texts score nothing and have no row, nor have texts in which
    every clause scores 0. Where two readings of a word tie, an insult goes before a
    threat, that before all others. Repeated rows give repeated results; null ids
    are kept, of any type; other columns are left out; an empty table gives no
    rows. Texts of any length are read whole. A null language, or no such column,
    admits the stems of all languages.
    """
    language = F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"), language.alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(score_column(batch.column(1), batch.column(2), lexicon))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r for r, _ in got], pa.int64())), pa.array([round(sum(c[0] for c in x), 6) for _, x in got], pa.float64()), pa.array([len(x) for _, x in got], pa.int32())],
                names=["_key", "score", "clauses"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"_key {kind}, score double, clauses int").withColumnRenamed("_key", doc_id)


def reject(docs: DataFrame, lexicon: Lexicon = BASE, threshold: float = THRESHOLD, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The documents that score less than ``threshold``, with all their columns.

    Null and empty texts stay, as do null ids; repeated rows are judged alike, so
    all stay or go; an empty table gives none. Columns may have any names.
    """

    where, language = docs.columns.index(text), docs.columns.index(lang) if lang and lang in docs.columns else None

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = pa.nulls(batch.num_rows, pa.string()) if language is None else batch.column(language)
        keep = np.ones(batch.num_rows, bool)
        for r, x in score_column(batch.column(where), langs, lexicon):
            keep[r] = round(sum(c[0] for c in x), 6) < threshold
        return batch.filter(pa.array(keep))

    return map_rows(docs, kept)
