import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm import brute
from weftmark.llm import jaccard, mixing, tokenids


def _grams(text):
    w = brute.words(text)
    return {tuple(w[i : i + jaccard.N]) for i in range(max(len(w) - jaccard.N + 1, 1))} if w else set()


def near_pairs(docs):
    """(a, b) of all documents with words whose n-gram sets are similar enough."""
    sets = {i: _grams(t) for i, t, *_ in docs}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= jaccard.THRESHOLD * len(sets[a] | sets[b])}


def keep_one(docs):
    root = {d[0]: d[0] for d in docs}
    for _ in docs:
        for a, b in near_pairs(docs):
            root[a] = root[b] = min(root[a], root[b])
    return [d for d in docs if root[d[0]] == d[0]]


def cut_items(text, items, most=10):
    """Without the runs of words that ``items`` hold, of ``most`` words or more; no shorter matches."""
    grams = {tuple(w[i : i + most]) for w in map(brute.words, items) for i in range(len(w) - most + 1)}
    found = list(re.finditer(r"\w+", text))
    w = [m.group().lower() for m in found]
    inside = {j for i in range(len(w)) if tuple(w[i : i + most]) in grams for j in range(i, i + most)}
    for j in sorted(inside, reverse=True):
        begin = found[j - 1].end() if j - 1 in inside else found[j].start()
        text = text[:begin] + text[found[j].end() :]
    return text


def mix(docs, seed=7):
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t)
    out = []
    for s in size:
        micro = sum(size.values()) * mixing.MICRO // (size[s] * len(size))
        at = int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:12], 16) % mixing.MICRO
        for i, t, _ in sorted(d for d in docs if d[2] == s):
            out += [(i, t)] * ((at + micro) // mixing.MICRO - at // mixing.MICRO)
            at += micro
    return out


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("bcdfghklmnprtvz") + r.choice("aeiou") for _ in range(4)) for _ in range(n))
    items = [prose(25) for _ in range(4)]
    texts = [prose(60 + 5 * (i % 7)) for i in range(24)]
    texts += [texts[3], "zu " + texts[5], texts[7] + " zu", f"{prose(40)} {items[1]}. {prose(30)}", f"{prose(50)} {items[2][:100]}", items[0], "you stupid idiot"]
    docs = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (30, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert {(p.doc_a, p.doc_b) for p in jaccard.pairs(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()} == near_pairs(docs) == {(3, 24), (5, 25), (7, 26)}
    kept = [(i, cut_items(t, items), s) for i, t, s in keep_one(docs[:-1])]  # the last one is toxic
    want = Counter(mix([d for d in kept if brute.words(d[1])]))
    model = tokenids._tokenizer(tokenids.default_tokenizer()).model
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter((x.doc_id, tuple(tokenids.decode_document(x.words, x.block_offsets, x.n_tokens).tolist())) for x in out)
    assert got == Counter({(i, tuple(model.encode_ordinary(t))): n for (i, t), n in want.items()})
