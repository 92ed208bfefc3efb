import random

from weftmark.llm import chunkdedup


def _words(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_repeats_of_51_words_and_more(spark):
    r = random.Random(3)
    docs, planted = [], {}
    for k in range(600):
        passage = _words(r, 51 + k % 30)
        for i in (2 * k, 2 * k + 1):
            before = _words(r, r.randrange(20, 60)) + " "
            docs.append((i, before + passage + " " + _words(r, r.randrange(20, 60))))
        planted[2 * k + 1] = (len(before), len(before) + len(passage))
    found = {r.doc_id: r for r in chunkdedup.repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert set(found) <= set(planted)
    whole = [i for i, (a, b) in planted.items() if i in found and any(s.start <= a and b <= s.end and s.end - s.start < b - a + 8 for s in found[i].spans)]
    assert len(whole) >= 0.985 * len(planted)
    assert all(found[i].first_doc_ids == [i - 1] for i in whole)


def test_grown_runs_keep_whole_characters(spark):
    r = random.Random(4)
    shared = _words(r, 60)
    texts = [_words(r, 30) + "é" + shared + "é" + _words(r, 30), _words(r, 30) + "ĩ" + shared + "è" + _words(r, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    (row,) = chunkdedup.repeats(docs).collect()
    raw = texts[1].encode()
    assert [raw[s.start : s.end].decode() for s in row.spans] == [shared]
    left = {r.doc_id: r.text for r in chunkdedup.remove(docs, chunkdedup.repeats(docs)).collect()}
    assert left == {0: texts[0], 1: texts[1].replace(shared, "")}


def test_equal_ids_with_other_texts(spark):
    r = random.Random(9)
    shared, own = _words(r, 80), "ж" * 30 + _words(r, 120)
    docs = spark.createDataFrame([(1, shared), (5, _words(r, 30) + " " + shared), (5, own), (5, own), (None, shared), (6, None), (7, "")], "doc_id bigint, text string")
    found = chunkdedup.repeats(docs)
    (row,) = found.collect()
    assert row.doc_id == 5 and row.first_doc_ids == [1]
    left = sorted(((x.doc_id, x.text) for x in chunkdedup.remove(docs, found).collect()), key=str)
    assert (5, own) in left and left.count((5, own)) == 2 and (None, shared) in left and (1, shared) in left and len(left) == 7


def _brute(docs, least):
    """Bytes of each document that lie in a run of ``least`` bytes or more found in one of smaller id."""
    out = {}
    for i, t in docs:
        inside = set()
        for j, u in docs:
            grams = {u[k : k + least] for k in range(len(u) - least + 1)} if j < i else set()
            inside |= {p for k in range(len(t) - least + 1) if t[k : k + least] in grams for p in range(k, k + least)}
        out[i] = inside
    return out


def test_spans_against_brute_force(spark):
    r = random.Random(10)
    passages = [_words(r, 70) for _ in range(6)]
    docs = [(i, " ".join([_words(r, 25), passages[r.randrange(6)], _words(r, 25), passages[r.randrange(6)], _words(r, 10)])) for i in range(40)]
    want = _brute(docs, chunkdedup.MIN_RUN)
    found = {x.doc_id: {p for s in x.spans for p in range(s.start, s.end)} for x in chunkdedup.repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(found.get(i, set()) - want[i] <= {p for k, t in docs if k == i for p in range(len(t)) if t.count(t[max(p - 80, 0) : p + 80]) > 1} for i in want)
    assert sum(len(found.get(i, set()) & w) for i, w in want.items()) >= 0.97 * sum(map(len, want.values()))
