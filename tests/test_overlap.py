import random

import pytest
from pyspark.sql import functions as F

from weftmark.operators import fragments as fr
from weftmark.operators import overlap
from weftmark.operators import pairs as pr
from weftmark.operators.fingerprint import parse
from weftmark.operators.lexing import hash_words, lex
from weftmark.options import Options
from weftmark.plans import queries

DOCS = "doc_id bigint, text string"
ALL = Options(lexer="verbatim", k=2, window=1)


def _texts(r, n, copies=3):
    """Texts that all share a passage, most with near and exact copies."""
    out = []
    while len(out) < n:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(20, 60))] + "the same passage in all of them".split()
        for _ in range(copies):
            out.append(" ".join(w if r.random() < 0.97 else f"x{r.randrange(10**6)}" for w in words))
        out.append(out[-1])
    return out[:n]


def _brute(sets):
    rows = [(a, b, 100.0 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]]
    return sorted(rows, key=lambda x: (-x[2], x[0], x[1]))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    parsed = parse(spark.createDataFrame([*enumerate(_texts(r, 150)), (900, ""), (901, None), (None, "w1 w2 w3")], DOCS), ALL).persist()
    return parsed, _brute({x.doc_id: set(x.prints) for x in parsed.collect() if x.doc_id is not None})


def test_words_are_hashed_as_they_are_lexed():
    r = random.Random(1)
    texts = [b"".join(r.choice([b"a", b"b_9", b" ", b"\n", b"\xc3\xa9", b"(", b"\0", b"Z" * r.randrange(90)]) for _ in range(r.randrange(40))) for _ in range(300)] + [b"", None, b"x" * 3000]
    for own in (texts, [], [None]):
        a, b = lex(own, "verbatim"), hash_words(own)
        assert all(x.tolist() == y.tolist() for x, y in ((a.symbols(), b.symbols()), (a.offset, b.offset), (a.length, b.length), (a.bounds, b.bounds)))


@pytest.mark.parametrize("threshold", [12.0, 30.0, 50.0, 90.0, 100.0])
def test_thresholds_and_what_is_compared_for_them(spark, corpus, threshold):
    parsed, want = corpus
    want = {x[:2]: x[2] for x in want if x[2] + 1e-9 >= threshold}
    assert {(x.lhs, x.rhs): x.similarity for x in pr.compare_indexed(parsed, threshold=threshold).collect()} == pytest.approx(want)
    # all 11,175 pairs share a passage, but only near copies share what is rare
    assert overlap.Sets(parsed).near(threshold).count() < 300


@pytest.mark.parametrize(("threshold", "n"), [(0.0, 5), (0.0, 60), (30.0, 200), (0.0, 400), (80.0, 10**6)])
def test_first_matches_without_all_pairs(corpus, threshold, n):
    parsed, want = corpus
    want = [x for x in want if x[2] + 1e-9 >= threshold][:n]
    got = pr.top_matches(parsed, threshold, n)
    assert [tuple(x) for x in got.collect()] == [(*x[:2], pytest.approx(x[2]), x[3]) for x in want]
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # readers don't score again


@pytest.mark.parametrize("docs", [7, 1 << 15])
def test_blocks_of_all_pairs(corpus, monkeypatch, docs):
    parsed, want = corpus
    monkeypatch.setattr(overlap, "DOCS", docs)
    found = pr.compare_indexed(parsed)
    assert sorted(tuple(x) for x in found.collect()) == [(*x[:2], pytest.approx(x[2]), x[3]) for x in sorted(want)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan  # pairs are neither shuffled nor sorted
    assert pr.candidate_pairs(parsed, 8).count() == sum(x[3] >= 8 for x in want)
    every = pr.compare_all(parsed)
    assert every.count() == 152 * 151 // 2 and [tuple(x) for x in every.where("lhs >= 900").collect()] == [(900, 901, 100.0, 0)]
    assert "Exchange" not in every._jdf.queryExecution().executedPlan().toString()


def test_figures_of_all_pairs(corpus, monkeypatch):
    parsed, want = corpus
    monkeypatch.setattr(overlap, "DOCS", 20)
    assert pr.summary_of_all(parsed).first() == pytest.approx(pr.summary(pr.compare_indexed(parsed), parsed).first())
    tallies = overlap.tallies(overlap.blocks(parsed), [30.0, 60.0]).groupBy("at").agg(F.sum("n").alias("n")).collect()
    assert {x["at"]: x.n for x in tallies} == {k: n for k in range(3) if (n := sum((x[2] >= 30) + (x[2] >= 60) == k for x in want))}


def test_text_ids_and_blocks_of_nothing(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "x y q"), (None, "x y z")], "doc_id string, text string")
    want = [("a", "b"), ("a", "c"), ("b", "c")]
    assert sorted((x.lhs, x.rhs) for x in pr.compare_indexed(parse(docs, ALL)).collect()) == want
    assert sorted((x.lhs, x.rhs) for x in pr.compare_indexed(parse(docs, ALL), threshold=10.0).collect()) == want
    for none in (docs.where("false"), docs.where("doc_id is null")):
        assert pr.compare_indexed(parse(none, ALL)).count() == pr.compare_indexed(parse(none, ALL), threshold=50.0).count() == 0


def test_texts_of_few_pairs_are_not_shuffled(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    few = fr.documents_of(spark.createDataFrame([(1, 2)], "lhs bigint, rhs bigint").repartition(2), docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert few.count() == 2 and "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_matrix_and_severities(spark, tmp_path):
    r = random.Random(9)
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(_texts(r, 24))], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    top = queries.top_n_matches(spark, str(tmp_path)).collect()
    got = {(x.doc_id, x.other): x.similarity for x in queries.similarity_matrix(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if v and k[0] < k[1]} == {(x.lhs, x.rhs): x.similarity for x in top}
    pairs = queries.jaccard_indexed(spark, str(tmp_path)).collect()
    for x in queries.severity_buckets(spark, str(tmp_path)).collect():
        own = [p.similarity for p in pairs if (p.similarity >= 30) + (p.similarity >= 70) == ["lo", "mid", "hi"].index(x.severity)]
        assert (x.n, x.from_50, x.from_80) == (len(own), sum(s >= 50 for s in own), sum(s >= 80 for s in own))
