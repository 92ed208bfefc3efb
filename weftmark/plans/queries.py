"""The engine's operators as queries over the test tables, with the DuckDB SQL that gives the same rows.

Documents of ASCII text are the corpus. Code lexers make prose a stream of V, so
queries on pairs take words as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.functions import text as tf
from weftmark.functions.symbols import BASIS, MODULUS, PRIME, symbol_of
from weftmark.operators import fragments as fr
from weftmark.operators import pairs as pr
from weftmark.operators.fingerprint import fingerprints, hashes_of, marked_tokens, parse, picks_of, profile
from weftmark.operators.lexing import LEXERS, _triple, alphabet_symbols, tokenize
from weftmark.operators.overlap import blocks, tallies
from weftmark.options import Options
from weftmark.sources import files as src

WORDS = Options(lexer="verbatim")
#: As the library lexes for fingerprints alone, and as whole analyses do.
CODE, NORMALIZED = Options(normalize=False), Options()
K, W = WORDS.k, WORDS.window


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def _parsed(spark, d, options: Options = WORDS) -> DataFrame:
    return parse(_docs(spark, d), options, with_picks=False)


def _code_text() -> str:
    """Made-up code from a document's columns, as SQL of both engines: strings, raw and triple-quoted ones, comments, numbers, operators."""
    t = "repeat(chr(34), 3)"
    q, b, n, i = "chr(39)", "chr(92)", "chr(10)", "cast(doc_id as string)"
    one = f"""'static const char* s' || {i} || ' = "a' || {b} || '"b' || {n} || source || '"; // it' || {q} || 's ' || lang || {n}"""
    two = f"""'auto r = R"x(raw " ' || {q} || ' )" ' || source || ')x" + ((a + b) * c' || {i} || '); '"""
    three = f"""'/* block " */ if ((x <<= 0x1F) && y->z != 1e+5 || !w) {{ ++n; f(::g, 1' || {q} || '000u, .5e-3f); }} '"""
    four = f"""'for (auto&& [k, v] : m) {{ out ^= k | v & ~' || cast(n_chars as string) || '; }} #define Z(a) a##_t ... @Over @int x >>>= $y ?? z?.w === 2 ** 3 ' || {n}"""
    five = f"""'x = rb' || {q} || 'a' || {q} || ' + f' || {t} || 'doc ' || {n} || ' ""x ' || lang || {t} || ' # c' || {n} || 'def g(u): return u // 2 `a$' || '{{b}}` ' || {n}"""
    six = f"""'char p = ' || {q} || {b} || {q} || {q} || '; template<typename T> T g(T t) {{ return ((t)); }} é ' || {n}"""
    last = f"""'open " ' || {i}"""
    return f"case doc_id % 3 when 0 then {one} || {two} || {three} when 1 then {four} || {five} || {one} else {six} || {four} || {two} end || {three} || {six} || case doc_id % 4 when 0 then {last} else '' end"


def _code(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_code_text()).alias("text"))


def lex_code(spark, d):
    return tokenize(_code(spark, d))


def lex_code_python(spark, d):
    return tokenize(_code(spark, d), "python")


def lex_code_java(spark, d):
    return tokenize(_code(spark, d), "java")


def lex_code_javascript(spark, d):
    return tokenize(_code(spark, d), "javascript")


def parsed_code(spark, d):
    return parse(_code(spark, d), NORMALIZED, with_picks=False).select("doc_id", "tokens", "kgrams", "fingerprints", "parens_collapsed")


def code_matches(spark, d):
    """The 50 most similar pairs of the made-up code, as an analysis scores them."""
    return pr.top_matches(parse(_code(spark, d), NORMALIZED, with_picks=False), 0.0, 50)


def lex_tokens(spark, d):
    return tokenize(_docs(spark, d))


def lex_token_histogram(spark, d):
    return tokenize(_docs(spark, d)).groupBy("text").agg(F.count("*").alias("n"))


def paren_normalize(spark, d):
    return marked_tokens(_docs(spark, d))


def fnv_symbol(spark, d):
    return tokenize(_docs(spark, d), "verbatim").select("text").distinct().select("text", symbol_of(F.col("text")).alias("sym"))


def kgram_hashes(spark, d):
    return hashes_of(_docs(spark, d), CODE)


def winnow_picks(spark, d):
    return picks_of(parse(_docs(spark, d), CODE)).select("doc_id", "pos", "hash")


def fingerprint_sets(spark, d):
    return fingerprints(_parsed(spark, d, CODE))


def parsed_sources(spark, d):
    """Lexed as code, normalised, hashed and winnowed, as an analysis does it."""
    return _parsed(spark, d, NORMALIZED).select("doc_id", "tokens", "kgrams", "fingerprints", "parens_collapsed")


def doc_profile(spark, d):
    return profile(_parsed(spark, d))


def inverted_index(spark, d):
    return pr.inverted_index(_parsed(spark, d)).select("hash", F.size("docs").cast("bigint").alias("n_docs"), F.element_at("docs", 1).alias("first_doc"))


def candidate_pairs(spark, d):
    return pr.candidate_pairs(_parsed(spark, d), 2)


def jaccard_indexed(spark, d):
    return pr.compare_indexed(_parsed(spark, d))


def jaccard_exhaustive(spark, d):
    return pr.compare_all(_parsed(spark, d))


def two_doc_compare(spark, d):
    return pr.compare_all(parse(_docs(spark, d).where("doc_id in (1, 2)"), WORDS))


def similarity_summary(spark, d):
    return pr.summary_of_all(_parsed(spark, d))


def threshold_matches(spark, d):
    return pr.compare_indexed(_parsed(spark, d), threshold=50.0)


def top_n_matches(spark, d, n: int = 20):
    return pr.top_matches(_parsed(spark, d), 30.0, n)


def severity_buckets(spark, d):
    edges = [30.0, 50.0, 70.0, 80.0]  # all that the severities and the counts tell apart
    m = tallies(blocks(_parsed(spark, d)), edges).withColumn("reached", F.element_at(F.array(*map(F.lit, [0.0, *edges])), F.col("at") + 1))
    reaching = lambda least: F.sum(F.when(F.col("reached") >= least, F.col("n")).otherwise(0))
    return m.groupBy(tf.severity(F.col("reached")).alias("severity")).agg(F.sum("n").alias("n"), reaching(50).alias("from_50"), reaching(80).alias("from_80"))


def matched_fragments(spark, d):
    top = top_n_matches(spark, d, 10)
    return fr.matched_fragments(top, parse(fr.documents_of(top, _docs(spark, d)), WORDS), K)


def merged_fragments(spark, d):
    return fr.filter_small(fr.merge_spans(matched_fragments(spark, d)))


def highlight_segments(spark, d):
    return fr.highlight_segments(matched_fragments(spark, d), _docs(spark, d).select("doc_id", F.octet_length("text").cast("bigint").alias("n")))


def similarity_matrix(spark, d):
    wide = pr.similarity_matrix(top_n_matches(spark, d))
    names = [F.col(c) for c in wide.columns if c != "doc_id"]
    return wide.unpivot(["doc_id"], names, "other", "similarity").select("doc_id", F.col("other").cast("bigint").alias("other"), "similarity") if names else wide


def text_functions(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("html").alias("h"))
    h = F.col("h")
    return t.select("page_id", tf.trim(h).alias("trimmed"), tf.to_lower(h).alias("lowered"), tf.html_escape(h).alias("html"), tf.csv_escape(h).alias("csv"), tf.json_escape(h).alias("json"), tf.oneline(h).alias("line"))


def extension_filter(spark, d):
    names = ["a.cpp", "A.CPP", "b.py", "c.jsx", "build/d.c", "x/.git/e.h", "f.txt", "cmake-build-x/g.ts", "out.java", "bin.d/h.js"]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 10 + 1).cast("int")).alias("name"))
    n = F.col("name")
    return docs.select("doc_id", "name", src.has_supported_extension(n).alias("supported"), src.in_ignored_directory(n).alias("ignored"), src.detect_language(n).alias("language"))


def lex_python(spark, d):
    return tokenize(_docs(spark, d), "python")


def lex_java(spark, d):
    return tokenize(_docs(spark, d), "java")


def lex_javascript(spark, d):
    return tokenize(spark.read.parquet(f"{d}/pages.parquet"), "javascript", "page_id", "html")


def synthetic_corpus(spark, d):
    return pr.compare_indexed(parse(src.synthetic(spark, 40, 30)))


QUERIES = {f.__name__: f for f in (
    lex_tokens, lex_token_histogram, paren_normalize, fnv_symbol, kgram_hashes, winnow_picks, fingerprint_sets, parsed_sources, doc_profile, inverted_index, candidate_pairs, jaccard_indexed, jaccard_exhaustive,
    two_doc_compare, similarity_summary, threshold_matches, top_n_matches, severity_buckets, matched_fragments, merged_fragments, highlight_segments, similarity_matrix, text_functions, extension_filter,
    lex_python, lex_java, lex_javascript, synthetic_corpus, lex_code, lex_code_python, lex_code_java, lex_code_javascript, parsed_code, code_matches,
)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(_q(w) for w in sorted(words))


_CPP = LEXERS["cpp"]
#: RE2 has no back-references; the only delimiter of raw strings in the made-up code is x, and prose has none.
_RE2 = "|".join([r"[ \t\n\x0B\f\r]+", r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)", r'R"x\((?s:.*?)\)x"', r'"[^"\\]*(?:\\(?s:.)[^"\\]*)*(?:"|\\?\z)', r"'[^'\\]*(?:\\(?s:.)[^'\\]*)*(?:'|\\?\z)", r"(?:[0-9]|\.[0-9])(?:[eEpP][+\-]|[A-Za-z0-9_.'])*", r"[A-Za-z_][A-Za-z0-9_]*", *_CPP.parts[-2:]])
_CODE_CORPUS = f"corpus as (select doc_id, {_code_text()} as body, source from documents)"
_CORPUS = "corpus as (select doc_id, text as body, source from documents)"


def _pieces(pattern: str, trivia: str, token: str) -> str:
    """Pieces of code points, of which those that are one non-ASCII character stand for its bytes, a token each."""
    return f"""
pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as idx from (select doc_id, regexp_extract_all(body, {_q(pattern)}) as p from corpus)),
placed as (select *, strlen(piece) as length, (sum(strlen(piece)) over (partition by doc_id order by idx) - strlen(piece))::bigint as "offset" from pieces where piece <> ''),
bytewise as (select doc_id, idx, {token} as text, "offset", length::bigint as length from placed where not (strlen(piece) > 1 and length(piece) = 1) and not regexp_matches(piece, {_q(trivia)})
 union all select doc_id, idx, chr(('0x' || substr(hex(encode(piece)), 2 * i + 1, 2))::int), "offset" + i, 1 from placed, unnest(range(strlen(piece))) as t(i) where strlen(piece) > 1 and length(piece) = 1),
tok as materialized (select doc_id, row_number() over (partition by doc_id order by "offset") - 1 as pos, text, "offset", length from bytewise)"""


_CPP_TOKEN = f"""case when piece in ({_list(_CPP.types)}) then 'T' when piece in ({_list(_CPP.keywords)}) then piece when piece[1] in ('"', '''') or piece[1:2] = 'R"' then 'L'
 when regexp_matches(piece, '^([0-9]|\\.[0-9])') then 'N' when regexp_matches(piece, '^[A-Za-z_]') then 'V' else piece end"""


def _other(name: str, corpus: str = _CORPUS) -> str:
    """The tokens of another lexer. RE2 has neither look-around nor atomic groups, so "@" and its word come as one piece and a string's prefix as a word."""
    lexer = LEXERS[name]
    pattern = "|".join(p for p in lexer.parts if "(?=" not in p and p != "@").replace("*+", "*").replace(r"\Z", r"\z")
    for q in "'\"":
        pattern = pattern.replace(_triple(q).replace("*+", "*").replace(r"\Z", r"\z"), rf"{q * 3}(?:[^{q}\\]|\\(?s:.)|{q}[^{q}\\]|{q}\\(?s:.)|{q * 2}[^{q}\\]|{q * 2}\\(?s:.))*(?:{q * 3}|{q}{{0,2}}\\?\z)")
    pattern = pattern.replace("(?<=@)[A-Za-z0-9_$]+", "@[A-Za-z0-9_$]*")
    quotes = ", ".join(map(_q, "'\"`" if name == "javascript" else "'\""))
    token = f"""case when piece in ({_list(lexer.types)}) then 'T' when piece in ({_list(lexer.keywords)}) then piece when piece[1] in ({quotes}) then 'L'
 when regexp_matches(piece, '^([0-9]|\\.[0-9])') then 'N' when regexp_matches(piece, {_q("^" + lexer.word)}) then 'V' else piece end"""
    out = f"with {corpus}, {_pieces(pattern, lexer.trivia, token)}"
    if name == "python":
        out = out.replace("from placed where not (strlen", "from prefixed where not is_prefix and not (strlen").replace(
            "bytewise as (", f"prefixed as (select *, regexp_matches(piece, '^([rRfFbBuU]|[fFbBrR]{{2}})$') and coalesce(lead(piece) over (partition by doc_id order by idx)[1] in ({quotes}), false) as is_prefix from placed),\nbytewise as (", 1
        )
    if name == "java":
        out = out.replace("from placed where not (strlen", "from noted where not (strlen").replace(
            "bytewise as (", """noted as (select doc_id, idx, case when piece[1] = '@' then '@' else piece end as piece, case when piece[1] = '@' then 1 else length end as length, "offset" from placed),
bytewise as (select doc_id, idx, 'V' as text, "offset" + 1 as "offset", (length - 1)::bigint as length from placed where piece[1] = '@' and length > 1
 union all """, 1
        )
    return f"{out} select doc_id, pos, text, \"offset\", length from tok"


_TOKENS = f"with {_CORPUS}, {_pieces(_RE2, _CPP.trivia, _CPP_TOKEN)}"
_WORD_TOKENS = f"with {_CORPUS}, {_pieces(r'[A-Za-z0-9_]+|(?s:.)', r'^[ \t\n\x0B\f\r]', 'piece')}"
_PARENS = """
pa as (select *, lag(text) over (partition by doc_id order by pos) pt, case text when '(' then 1 when ')' then -1 else 0 end s from tok),
pb as (select *, sum(s) over (partition by doc_id order by pos rows unbounded preceding) ss from pa),
pc as (select *, least(0, min(ss) over (partition by doc_id order by pos rows unbounded preceding)) m from pb),
pd as (select *, lag(m, 1, 0) over (partition by doc_id order by pos) pm from pc),
pe as (select *, text = '(' and coalesce(pt = '(', false) redo, case when text = '(' then ss - m when text = ')' and m = pm then ss - m + 1 end lvl from pd),
pf as (select *, case when lvl is not null then lag(redo) over (partition by doc_id, lvl order by pos) end mate from pe),
marked as (select doc_id, pos, text, not (redo or (text = ')' and coalesce(mate, false))) as keep, (text = ')' and coalesce(mate, false)) as collapsed from pf)"""
_FNV = f"(list_reduce(list_prepend({BASIS}::uhugeint, list_transform(string_split(text, ''), lambda c: ascii(c)::uhugeint)), lambda a, x: (xor(a, x) * {PRIME}::uhugeint) % 18446744073709551616::uhugeint) % {MODULUS - 1} + 1)::bigint"
_WORD_SYM = f"names as (select text, {_FNV} as sym from (select distinct text from tok)), stok as (select t.doc_id, pos, sym from tok t join names n on t.text = n.text)"
_CPP_SYM = "names(text, sym) as (values " + ", ".join(f"({_q(t)}, {s}::bigint)" for t, s in alphabet_symbols("cpp").items() if t != "\0") + "), stok as (select t.doc_id, pos, sym from tok t join names n on t.text = n.text)"
_horner = "0"
for _j in range(K):
    _horner = f"(({_horner}) * 256 + lead(sym, {_j}) over w) % {MODULUS}"
_GRAMS = f"grams as (select doc_id, pos, hash from (select doc_id, pos, ({_horner})::bigint as hash from stok window w as (partition by doc_id order by pos)) where hash is not null)"
_PICKS = f"""
least_ as (select doc_id, pos, min(struct_pack(h := hash, np := -pos)) over f as m, count(*) over f as n, count(*) over (partition by doc_id) as total from grams window f as (partition by doc_id order by pos rows between current row and {W - 1} following)),
picks as materialized (select distinct doc_id, -(m.np) as pos, m.h as hash from least_ where n = {W} or (total < {W} and pos = 0)),
prints as materialized (select distinct doc_id, hash from picks)"""
_CPP_ALL = f"{_TOKENS}, {_CPP_SYM}, {_GRAMS}, {_PICKS}"
_ALL = f"{_WORD_TOKENS}, {_WORD_SYM}, {_GRAMS}, {_PICKS}"
_PROFILE = """
prof as (select c.doc_id, coalesce(t.n, 0) as tokens, coalesce(g.n, 0) as kgrams, coalesce(p.n, 0) as fingerprints from corpus c
 left join (select doc_id, count(*) n from tok group by 1) t using (doc_id) left join (select doc_id, count(*) n from grams group by 1) g using (doc_id) left join (select doc_id, count(*) n from prints group by 1) p using (doc_id))"""
_SHARED = """
shared_ as (select a.doc_id as lhs, b.doc_id as rhs, count(*) as shared from prints a join prints b on a.hash = b.hash and a.doc_id < b.doc_id group by 1, 2),
scored as materialized (select lhs, rhs, 100.0::double * shared / (x.fingerprints + y.fingerprints - shared) as similarity, shared as shared_fingerprints from shared_ join prof x on x.doc_id = lhs join prof y on y.doc_id = rhs)"""
_PAIRS = f"{_ALL}, {_PROFILE}, {_SHARED}"
_EVERY = """select a.doc_id as lhs, b.doc_id as rhs, coalesce(similarity, case when a.fingerprints + b.fingerprints = 0 then 100.0 else 0.0 end)::double as similarity, coalesce(shared_fingerprints, 0) as shared_fingerprints
from prof a join prof b on a.doc_id < b.doc_id left join scored s on s.lhs = a.doc_id and s.rhs = b.doc_id"""
_TOP = "top as materialized (select * from scored where similarity + 1e-9 >= 30 order by similarity desc, lhs, rhs limit {n})"
_FRAGMENTS = f"""
fa as (select t.lhs, t.rhs, a.hash, a.pos as a_token_pos, b.pos as b_token_pos from top t join picks a on a.doc_id = t.lhs join picks b on b.doc_id = t.rhs and a.hash = b.hash),
fb as (select *, row_number() over (partition by lhs, rhs, hash order by a_token_pos, b_token_pos) as n, min(a_token_pos) over (partition by lhs, rhs, hash) as first_ from fa),
fc as (select *, row_number() over (partition by lhs, rhs order by first_, hash, a_token_pos, b_token_pos) as nth from fb where n <= 3),
own as materialized (select * from tok where doc_id in (select lhs from top union all select rhs from top)),
spans_ as materialized (select a.doc_id, a.pos, a."offset", b."offset" + b.length - a."offset" as length from own a join own b on a.doc_id = b.doc_id and b.pos = a.pos + {K - 1}),
frag as (select lhs, rhs, hash, a_token_pos, b_token_pos, x."offset" as a_offset, x.length as a_length, y."offset" as b_offset, y.length as b_length, nth from fc join spans_ x on x.doc_id = lhs and x.pos = a_token_pos join spans_ y on y.doc_id = rhs and y.pos = b_token_pos where nth <= 30)"""
_JSON = "h"
for _a, _b in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
    _JSON = f"replace({_JSON}, {'chr(' + str(ord(_a)) + ')'}, {_q(_b)})"
for _i in range(1, 32):
    if _i not in (8, 9, 10, 12, 13):
        _JSON = f"replace({_JSON}, chr({_i}), '\\u{_i:04x}')"
_HTML = "h"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
    _HTML = f"replace({_HTML}, {_q(_a)}, {_q(_b)})"

_NORMALIZED = f"""{_TOKENS}, {_PARENS}, ntok as materialized (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as pos, text from marked where keep),
{_CPP_SYM.replace("from tok t", "from ntok t")}, {_GRAMS}, {_PICKS}, {_PROFILE.replace("from tok group", "from ntok group")}"""
_PARSED = f"{_NORMALIZED} select p.*, coalesce(c.n, 0) as parens_collapsed from prof p left join (select doc_id, count(*) filter (collapsed) as n from marked group by 1) c using (doc_id)"

ORACLES = {
    "lex_tokens": f"{_TOKENS} select * from tok",
    "lex_token_histogram": f"{_TOKENS} select text, count(*) as n from tok group by 1",
    "paren_normalize": f"{_TOKENS}, {_PARENS} select * from marked",
    "fnv_symbol": f"{_WORD_TOKENS}, {_WORD_SYM} select * from names",
    "kgram_hashes": f"{_TOKENS}, {_CPP_SYM}, {_GRAMS} select * from grams",
    "winnow_picks": f"{_CPP_ALL} select * from picks",
    "fingerprint_sets": f"{_CPP_ALL} select * from prints",
    "parsed_sources": _PARSED,
    "parsed_code": _PARSED.replace(_CORPUS, _CODE_CORPUS),
    "code_matches": f"{_NORMALIZED.replace(_CORPUS, _CODE_CORPUS)}, {_SHARED} select * from scored order by similarity desc, lhs, rhs limit 50",
    "doc_profile": f"{_ALL}, {_PROFILE} select * from prof",
    "inverted_index": f"{_ALL} select hash, count(*) as n_docs, min(doc_id) as first_doc from prints group by 1",
    "candidate_pairs": f"{_PAIRS} select * from shared_ where shared >= 2",
    "jaccard_indexed": f"{_PAIRS} select * from scored",
    "jaccard_exhaustive": f"{_PAIRS} {_EVERY}",
    "two_doc_compare": f"{_PAIRS} select * from ({_EVERY}) where lhs in (1, 2) and rhs in (1, 2)",
    "similarity_summary": f"{_PAIRS} select max(files) as files, max(files * (files - 1) // 2)::bigint as comparisons, max(total)::bigint as total_fingerprints, max(greatest(similarity, case when e >= 2 then 100.0 else 0 end))::double as highest, round((sum(similarity) + max(e * (e - 1) // 2) * 100.0) / max(files * (files - 1) // 2), 6)::double as average from scored, (select count(*) as files, sum(fingerprints) as total, count(*) filter (fingerprints = 0) as e from prof)",
    "threshold_matches": f"{_PAIRS} select * from scored where similarity + 1e-9 >= 50",
    "top_n_matches": f"{_PAIRS}, {_TOP.format(n=20)} select * from top",
    "severity_buckets": f"{_PAIRS} select case when similarity >= 70 then 'hi' when similarity >= 30 then 'mid' else 'lo' end as severity, count(*) as n, count(*) filter (similarity >= 50) as from_50, count(*) filter (similarity >= 80) as from_80 from scored group by 1",
    "matched_fragments": f"{_PAIRS}, {_TOP.format(n=10)}, {_FRAGMENTS} select * from frag",
    "merged_fragments": f"""{_PAIRS.replace("with ", "with recursive ", 1)}, {_TOP.format(n=10)}, {_FRAGMENTS},
ma as materialized (select lhs, rhs, a_offset as x, a_length as xl, b_offset as y, b_length as yl, row_number() over (partition by lhs, rhs order by a_offset, b_offset, a_length, b_length) as i from frag),
mb as (select lhs, rhs, i, 1::bigint as span, x as a, xl as al, y as b, yl as bl, 1::bigint as n from ma where i = 1
 union all select lhs, rhs, i, span + case when joins then 0 else 1 end, case when joins then a else x end, case when joins then greatest(a + al, x + xl) - a else xl end,
  case when joins then least(b, y) else y end, case when joins then greatest(b + bl, y + yl) - least(b, y) else yl end, case when joins then n + 1 else 1 end
 from (select m.lhs, m.rhs, f.i, span, a, al, b, bl, n, x, xl, y, yl, x <= a + al + 3 and greatest(b + bl, y + yl) - least(b, y) <= bl + yl + 3 as joins from mb m join ma f on f.lhs = m.lhs and f.rhs = m.rhs and f.i = m.i + 1))
select lhs, rhs, a as a_offset, al as a_length, b as b_offset, bl as b_length, n as fragment_count from (select *, row_number() over (partition by lhs, rhs, span order by i desc) as latest from mb) where latest = 1 and (al >= 10 or bl >= 10)""",
    "highlight_segments": f"""{_PAIRS}, {_TOP.format(n=10)}, {_FRAGMENTS},
ha as (select lhs, rhs, a_offset as b, a_offset + a_length as e from frag),
hb as (select *, max(e) over (partition by lhs, rhs order by b, e rows between unbounded preceding and 1 preceding) as seen from ha),
hc as (select *, sum(case when seen is null or b > seen then 1 else 0 end) over (partition by lhs, rhs order by b, e rows unbounded preceding) as island from hb),
hd as (select lhs, rhs, min(b) as b, max(e) as e from hc group by lhs, rhs, island),
he as (select *, coalesce(lag(e) over (partition by lhs, rhs order by b), 0) as before_, lead(b) over (partition by lhs, rhs order by b) is null as last_ from hd)
select lhs, rhs, b as "begin", e as "end", true as marked from he union all select lhs, rhs, before_, b, false from he where before_ < b
union all select lhs, rhs, e, strlen(body), false from he join corpus on doc_id = lhs where last_ and e < strlen(body)""",
    "similarity_matrix": f"""{_PAIRS}, {_TOP.format(n=20)}, ids as (select lhs as id from top union select rhs from top)
select a.id as doc_id, b.id as other, coalesce(case when a.id = b.id then 100.0 else t.similarity end, 0.0)::double as similarity from ids a cross join ids b left join top t on t.lhs = least(a.id, b.id) and t.rhs = greatest(a.id, b.id)""",
    "text_functions": f"""select page_id, regexp_replace(h, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+\\z', '', 'g') as trimmed, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered, {_HTML} as html,
case when regexp_matches(h, '[,"\\n\\r]') then '"' || replace(h, '"', '""') || '"' else h end as csv, {_JSON} as json,
case when strlen(l) > 80 then substr(l, 1, cut) || '...' else l end as line from (select *, list_max(list_filter(range(1, 78), lambda n: strlen(substr(l, 1, n)) <= 77)) as cut from (select page_id, h, regexp_replace(h, '[ \\n\\r\\t]+', ' ', 'g') as l from (select page_id, html as h from pages)))""",
    "lex_code": f"{_TOKENS.replace(_CORPUS, _CODE_CORPUS)} select * from tok",
    "lex_code_python": _other("python", _CODE_CORPUS),
    "lex_code_java": _other("java", _CODE_CORPUS),
    "lex_code_javascript": _other("javascript", _CODE_CORPUS),
    "lex_python": _other("python"),
    "lex_java": _other("java"),
    "lex_javascript": _other("javascript", "corpus as (select page_id as doc_id, html as body from pages)"),
    "extension_filter": """select doc_id, name, regexp_matches(lower(name), '\\.(cpp|cc|cxx|h|hpp|java|py|js|ts|c)$') as supported,
regexp_matches(name, '(^|/)(\\.[^/]*|build|out|bin|cmake-build[^/]*)/') as ignored,
case when regexp_matches(lower(name), '\\.(c|h|cpp|cc|cxx|hpp)$') then 'C++' when regexp_matches(lower(name), '\\.pyw?$') then 'Python' when name like '%.java' then 'Java' when regexp_matches(lower(name), '\\.[jt]sx?$') then 'JavaScript' else 'Unknown' end as language
from (select doc_id, ['a.cpp', 'A.CPP', 'b.py', 'c.jsx', 'build/d.c', 'x/.git/e.h', 'f.txt', 'cmake-build-x/g.ts', 'out.java', 'bin.d/h.js'][doc_id % 10 + 1] as name from documents)""",
}
