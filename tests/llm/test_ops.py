import random

import numpy as np
import pytest

import corpus_pipeline
from weftmark.llm import chunkdedup, decontam, jaccard, langid, mixing, ngramlm, ogg, secrets, tokenids, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _id int, score double"
WORDS = [a + b for a in ("ba", "lo", "ti", "ru", "ne") for b in ("ka", "mo", "si", "du", "fe", "no")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def rows():
    texts = [prose(i, 80) for i in range(12)]
    texts += [texts[0], texts[0].replace("ba", "xa", 2), None, "", " \n", "é" * 40_000, prose(99, 20_000), "you stupid idiot", "not stupid"]
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), None, 1, None) for i, t in enumerate(texts)]
    return [*out, out[3], (None, texts[1], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_secrets_ledger(spark, docs, empty):
    t = "token = '" + "a1" * 10 + "'"
    v = spark.createDataFrame([("a", t), ("b", t), ("c", "clean"), ("d", None)], "path string, text string")
    first = secrets.scan(v, path=("path",))
    assert sorted(r.path for r in first.findings.collect()) == ["a", "b"]
    more = v.union(spark.createDataFrame([("e", "AKIA" + "A" * 16)], v.schema))
    second = secrets.scan(more, first.ledger, path=("path",))
    assert sorted((r.path, r.rule_id) for r in second.findings.collect()) == [("a", "assigned_secret"), ("b", "assigned_secret"), ("e", "access_key_id")]
    assert secrets.scan(docs).findings.count() == 0 and secrets.scan(empty).findings.count() == 0


def test_chunks(spark, docs, empty):
    shared = prose(7, 60)
    d = spark.createDataFrame([(1, prose(1, 50) + shared), (2, prose(2, 43) + " " + shared + prose(3, 10)), (3, prose(4, 90))], "doc_id bigint, text string")
    found = chunkdedup.repeats(d).collect()
    assert [r.doc_id for r in found] == [2] and found[0].first_doc_ids == [1]
    assert found[0].removed_bytes == sum(s.end - s.start for s in found[0].spans)
    left = {r.doc_id: r.text for r in chunkdedup.remove(d, chunkdedup.repeats(d)).collect()}
    assert len(left[2]) < len(d.where("doc_id = 2").first().text) and len(left) == 3
    assert 12 in [r.doc_id for r in chunkdedup.repeats(docs).collect()] and chunkdedup.remove(docs, chunkdedup.repeats(docs)).count() == docs.count() and chunkdedup.repeats(empty).count() == 0


def test_toxicity(docs, empty):
    assert toxicity.clause_score("oIo") == 1.0 and toxicity.clause_score("YoI") == 1.5 and toxicity.clause_score("NoI") == 0.25
    assert toxicity.clause_score("RoI") == 0.4 and toxicity.clause_score("TY") == 2.0 and toxicity.clause_score("YPT") == 2.0 and toxicity.clause_score("YT") == 0.5
    got = {r.doc_id: r.score for r in toxicity.scores(docs).collect()}
    assert got == {19: 2.5, 20: 0.25} or set(got) == {19, 20}
    assert toxicity.reject(docs).count() == docs.count() - 1 and toxicity.reject(docs).columns == docs.columns
    assert toxicity.scores(empty).count() == 0
    lexicon = toxicity.learn([("x", f"{prose(i, 30)} zorgu{i} la", 1) for i in range(9)] + [("x", prose(50 + i, 30), 0) for i in range(40)])
    assert ("x", "zorgu") in lexicon.stems


def test_ogg(docs, empty):
    packets = [(bytes([i % 251]) * n, i) for i, n in enumerate((0, 1, 254, 255, 256, 140_000, 510))]
    pages = list(ogg.mux(5, packets))
    (s,) = ogg.demux(b"".join(pages))
    assert s["packets"] == [p for p, _ in packets] and not s["broken"]
    bad = bytearray(b"".join(pages))
    bad[len(pages[0]) + 40] ^= 1
    (s,) = ogg.demux(bytes(bad))
    assert s["broken"] and s["lost_pages"] == 1 and len(pages) == 3 and s["skipped"] == len(pages[1])
    assert ogg.demux(b"") == [] and ogg.demux(b"noise") == []
    assert ogg.streams(ogg.text_media(docs)).count() == 2 * docs.where("text is not null").count()
    assert ogg.streams(ogg.text_media(empty)).count() == 0


def test_language(docs, empty):
    model = langid.train({"a": [b"abab" * 50], "b": [b"bcbc" * 50]}, least=2)
    text = np.frombuffer(b"ababbcbcbc", np.uint8)
    bits = langid.code_lengths(model, text, np.array([0, 4, 4, 10]))
    assert bits[0].argmin() == 0 and bits[2].argmin() == 1 and (bits[1] == 0).all()
    one = langid.code_lengths(model, text[4:], np.array([0, 6]))
    assert np.allclose(one[0], bits[2])
    got = {r.doc_id: r for r in langid.identify(docs, langid.train_on(docs)).collect()}
    assert got[0].language == "en" and got[14].language is None and len(got) == 22
    assert langid.identify(empty, langid.train_on(empty)).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, None), (3, "")], "item_id bigint, text string")
    found = decontam.contamination(docs, items).collect()
    assert {r.doc_id for r in found} == {1, None} and all(r.item_ids == [1] for r in found)
    clean = decontam.decontaminate(docs, items)
    assert clean.count() == docs.count() and clean.columns == docs.columns
    assert decontam.contamination(clean, items).count() == 0 and decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).count() == 0
    r = random.Random(5)
    for _ in range(50):
        lists = [[r.randrange(4) for _ in range(r.randrange(1, 9))] for _ in range(3)]
        text = [r.randrange(5) for _ in range(20)]
        subs = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        ends = {}
        for j in range(1, 21):
            for i in range(j):
                if tuple(text[i:j]) in subs:
                    ends[j] = i
                    break
        want = {(i, j) for j, i in ends.items() if j - i >= 2 and ends.get(j + 1) != i}
        assert {(a, b) for a, b, _, _ in decontam.SuffixAutomaton(lists).matches(text, 2)} == want


def test_token_ids(docs, empty):
    model = tokenids._tokenizer(tokenids.default_tokenizer()).model
    got = {r.doc_id: r for r in tokenids.token_ids(docs).collect()}
    for i, t, *_ in rows():
        if i is not None and len(t or "") < 200_000:
            ids = tokenids.decode_document(got[i].words, got[i].block_offsets, got[i].n_tokens)
            assert ids.tolist() == model.encode_ordinary(t or "")
    assert tokenids.token_ids(empty).count() == 0
    v = np.array([0] * 300 + [1, 2**60 - 1, 2**64 - 1, 5], np.uint64)
    words, bounds = tokenids.encode_blocks(v, np.array([0, 250, len(v)]))
    assert np.concatenate([tokenids.decode(words[a:b], n) for a, b, n in zip(bounds, bounds[1:], (250, 54))]).tolist() == v.tolist()


def test_ngram_scores(docs, empty):
    got = {r.doc_id: r for r in ngramlm.scores(docs).collect()}
    assert set(got) == set(range(21)) and got[17].n_tokens == 1 and got[14].n_tokens == 0 and got[14].bits is None
    assert ngramlm.scores(empty).count() == 0


def test_jaccard(docs, empty):
    got = {(r.doc_a, r.doc_b, r.kind) for r in jaccard.pairs(docs).collect()}
    assert got == {(0, 12, "same"), (0, 13, "near")}
    kept = jaccard.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert 12 not in ids and 13 not in ids and ids.count(3) == 1 and None not in ids and {14, 15, 16} <= set(ids)
    assert kept.columns == docs.columns and jaccard.pairs(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_mixing(docs, empty):
    out = mixing.sample(docs)
    assert out.columns == docs.columns and mixing.sample(empty).count() == 0
    sizes = {r.source: r for r in mixing.expected_copies(docs).collect()}
    n = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    for s, k in {r.source: r["count"] for r in out.groupBy("source").count().collect()}.items():
        assert abs(k - n[s] * sizes[s].micro / mixing.MICRO) <= 1
    only = mixing.sample(docs, weights={"s1": 1}, default_weight=0)
    assert {r.source for r in only.select("source").distinct().collect()} <= {"s1"}


def test_pipeline_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
