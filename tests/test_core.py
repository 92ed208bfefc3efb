import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmark.functions.symbols import symbol, symbol_of
from weftmark.operators import fragments as fr
from weftmark.operators import pairs as pr
from weftmark.operators.fingerprint import hashes_of, kgrams, marked_tokens, parse, picks_of, winnow, winnowed
from weftmark.operators.lexing import tokenize
from weftmark.operators.normalize import mark_parens, normalize
from weftmark.options import Options
from weftmark.plans.analysis import analyze, compare, ranked
from weftmark.plans.report import Report, oneline, parse_format

DOCS = "doc_id bigint, text string"


def lex(spark, text, lexer="cpp"):
    return [r.text for r in tokenize(spark.createDataFrame([(1, text)], DOCS), lexer).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("text", "lexer", "expected"),
    [
        ("if (x) return y;", "cpp", ["if", "(", "V", ")", "return", "V", ";"]),
        ("42 3.14 0xFF", "cpp", ["N", "N", "N"]),
        ("+ += <<=", "cpp", ["+", "+=", "<<="]),
        ('auto s = R"(raw " string)";', "cpp", ["auto", "V", "=", "L", ";"]),
        ("a // comment\nb", "cpp", ["V", "V"]),
        ("é", "cpp", ["\xc3", "\xa9"]),
        ("x = f'a' # c", "python", ["V", "=", "L"]),
        ("a >>= 1", "python", ["V", ">", ">=", "N"]),
        ("fx = rb\'a\' + f ; f", "python", ["V", "=", "L", "+", "V", ";", "V"]),
        ("@Test int x", "java", ["@", "V", "T", "V"]),
        ("@int @1.5", "java", ["@", "V", "@", "V", "N"]),
        ('R"x(a)b)x" + R"( "', "cpp", ["L", "+", "L"]),
        ("1e+5 1'000 \'a", "cpp", ["N", "N", "L"]),
        ("`a${b}` === c", "javascript", ["L", "===", "V"]),
    ],
)
def test_lexers(spark, text, lexer, expected):
    assert lex(spark, text, lexer) == expected


def test_symbols_and_fingerprints(spark):
    assert [symbol(t) for t in ("V", "(", "hello world")] == [887279708, 399171920, 753854218]
    docs = spark.createDataFrame([(1, "int a = 1; return a;"), (2, "((a+b)*c)"), (3, ""), (4, None)], DOCS)
    assert [r.hash for r in hashes_of(docs).where("doc_id = 1").orderBy("pos").collect()] == [783863669, 282459406, 523362174, 387652609]
    parsed = parse(docs)
    assert {tuple(r)[:3] for r in picks_of(parsed).collect()} == {(1, 1, 282459406), (2, 2, 714099397)}
    assert [tuple(r)[:5] for r in parsed.orderBy("doc_id").collect()] == [(1, 8, 4, 1, 0), (2, 7, 3, 1, 1), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)]


def test_parens(spark):
    docs = spark.createDataFrame([(1, "((a+b)*c) )((d"), (2, "(("), (3, ")((a))")], DOCS)
    rows = marked_tokens(docs).orderBy("doc_id", "pos").collect()
    assert ["".join(r.text for r in rows if r.keep and r.doc_id == i) for i in (1, 2, 3)] == ["(V+V*V))(V", "(", ")(V)"]
    assert [sum(r.collapsed for r in rows if r.doc_id == i) for i in (1, 2, 3)] == [1, 0, 1]


def _picked(hashes, w):
    """Winnowing as its definition goes."""
    spots = [range(i, i + w) for i in range(len(hashes) - w + 1)] or ([range(len(hashes))] if hashes else [])
    return sorted({min(s, key=lambda i: (hashes[i], -i)) for s in spots})


def test_arrays_against_tables_and_definitions(spark):
    r = random.Random(5)
    for _ in range(60):
        sizes = [r.randrange(12) for _ in range(6)]
        lists = [[r.randrange(5) for _ in range(n)] for n in sizes]
        w = r.randrange(1, 6)
        at, bounds = winnowed(np.array(sum(lists, []), np.int64), np.concatenate([[0], np.cumsum(sizes)]), w)
        starts = np.cumsum([0, *sizes])
        assert [(at[a:b] - s).tolist() for a, b, s in zip(bounds, bounds[1:], starts)] == [_picked(x, w) for x in lists]
    texts = ["".join(r.choice(["(", ")", "x", " ", "1", "+=", "/*", "*/", "'", "é", "\n", "return ", 'R"(', ')"']) for _ in range(r.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    tokens = tokenize(docs)
    assert sorted(marked_tokens(docs).collect()) == sorted(mark_parens(tokens).select("doc_id", "pos", "text", "keep", "collapsed").collect())
    syms = normalize(tokens).select("doc_id", "pos", symbol_of(F.col("text")).alias("sym"))
    grams = kgrams(syms, 5)
    assert sorted(grams.collect()) == sorted(hashes_of(docs).collect())
    assert sorted(winnow(grams, 4).collect()) == sorted(picks_of(parse(docs)).select("doc_id", "pos", "hash").collect())
    for t in tokens.collect():
        raw = texts[t.doc_id].encode()[t.offset : t.offset + t.length].decode("latin-1")
        assert t.text in (raw, "L", "V", "T", "N")


def test_pairs_against_all_pairs(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randrange(30))) for _ in range(25)]
    texts += [texts[3], texts[3], "", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    parsed = parse(docs, Options(lexer="verbatim", k=2, window=2))
    sets = {x.doc_id: set(x.prints) for x in parsed.collect()}
    want = {(a, b): 100.0 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = {(x.lhs, x.rhs): x.similarity for x in pr.compare_indexed(parsed).collect()}
    assert got == pytest.approx(want)
    assert {(x.lhs, x.rhs) for x in pr.compare_indexed(parsed, threshold=60.0).collect()} == {p for p, s in want.items() if s + 1e-9 >= 60}
    assert pr.compare_all(parsed).count() == len(texts) * (len(texts) - 1) // 2


@pytest.mark.parametrize("top_n", [0, 3])
def test_ranks(spark, top_n):
    rows = [(i, j, float((i * j) % 7), 1) for i in range(12) for j in range(i + 1, 12)]
    held = []
    got = ranked(spark.createDataFrame(rows, "lhs bigint, rhs bigint, similarity double, shared_fingerprints bigint"), top_n, held).orderBy("rank").collect()
    want = sorted(rows, key=lambda x: (-x[2], x[0], x[1]))[: top_n or None]
    assert [(x.lhs, x.rhs, x.similarity) for x in got] == [x[:3] for x in want] and [x["rank"] for x in got] == list(range(1, len(want) + 1))


def test_analysis_and_reports(spark):
    code = "int f(int n) { int s = 0; for (int i = 0; i < n; ++i) { s += i; } return s; }"
    docs = spark.createDataFrame([(0, code), (1, code.replace("s", "t")), (2, ""), (3, "")], DOCS)
    a = analyze(docs, Options(threshold=50))
    assert [(r.lhs, r.rhs, r.similarity) for r in a.matches.orderBy("rank").collect()] == [(0, 1, 100.0), (2, 3, 100.0)]
    s = a.summary.first()
    assert (s.files, s.comparisons, s.matches_above_threshold) == (4, 6, 2)
    r = Report(a)
    assert r.render("csv").splitlines()[1].startswith("1,0,1,100.00,") and "</html>" in r.render("html")
    assert "Threads:         1 (sequential)" in r.render("text") and "(no matches" not in r.render("text")
    j = json.loads(r.render("json"))
    assert j["parameters"]["threads"] == 0 and [m["rank"] for m in j["matches"]] == [1, 2] and j["matches"][0]["fragments"][0]["a_text"] == "f(int n)"
    a.close()
    none = Report(analyze(docs, Options(threshold=50, indexed=True, min_shared=10**6)))
    assert json.loads(none.render("json"))["matches"] == [] and "(no matches above threshold)" in none.render("text")
    assert compare(spark, code, code) == 100.0 and compare(spark, "", code) == 0.0


def test_merge_and_formats(spark):
    f = spark.createDataFrame([(1, 2, 0, 5, 10, 5), (1, 2, 6, 5, 16, 5), (1, 2, 40, 5, 50, 5)], "lhs int, rhs int, a_offset bigint, a_length bigint, b_offset bigint, b_length bigint")
    assert sorted(tuple(r)[2:] for r in fr.merge_spans(f).collect()) == [(0, 11, 10, 11, 2), (40, 5, 50, 5, 1)]
    assert parse_format("HTM") == "html" and oneline("a\n b" + "x" * 90).endswith("...")
    with pytest.raises(ValueError):
        parse_format("pdf")
    with pytest.raises(ValueError):
        Options(k=0)
