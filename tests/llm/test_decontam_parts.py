import random

from weftmark.llm import decontam


def _tables(spark):
    r = random.Random(11)
    items = [[f"w{r.randrange(4000)}" for _ in range(20)] for _ in range(12)]
    items[7][3:10] = items[2][5:12]  # a passage of two items
    filler = lambda n: [f"x{r.randrange(10**6)}" for _ in range(n)]
    fragments = [w for k in (0, 4, 8, 11) for w in [*items[k][2:9], *filler(2)]]  # short matches of four items
    docs = [fragments, [*filler(40), *items[1], *filler(30), *items[9][:12], *filler(40)], [*filler(60), *items[7][3:10], *filler(60), *items[7][12:19]], filler(50)]
    docs = spark.createDataFrame([(i, " ".join(d), len(" ".join(d))) for i, d in enumerate(docs)] * 2, "doc_id bigint, text string, n_chars bigint")
    return docs, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")


def test_parts_give_the_rows_of_one_automaton(spark):
    docs, items = _tables(spark)
    one, many = (sorted(decontam.contamination(docs, items, automaton_bytes=n).collect()) for n in (1 << 20, 1))
    assert one == many and [r.doc_id for r in one] == [0, 0, 1, 1, 2, 2]
    assert not any(w.startswith("w") for r in one for w in r.clean_text.split())
    one, many = (sorted(decontam.decontaminate(docs, items, automaton_bytes=n).collect()) for n in (1 << 20, 1))
    assert one == many and len(one) == 8


def test_short_matches_count_for_every_item_that_holds_them(spark):
    b = [f"b{i}" for i in range(15)]
    first = [*[f"a{i}" for i in range(20)], *b[:7], *[f"c{i}" for i in range(20)]]
    filler = [f"x{i}" for i in range(200)]
    text = " ".join([*filler[:70], *b[:7], *filler[70:140], *b[8:], *filler[140:]])
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(b))], "item_id bigint, text string")
    (row,) = decontam.contamination(docs, items).collect()
    assert row.item_ids == [2] and row.removed_tokens == 14


def test_item_matches_against_each_item_alone():
    r = random.Random(6)
    for _ in range(200):
        lists = [[r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(4)]
        text = [r.randrange(5) for _ in range(30)]
        got = decontam.SuffixAutomaton(lists).item_matches(text, 2)
        want = {(a, b, k, place) for k, x in enumerate(lists) for a, b, _, place in decontam.SuffixAutomaton([x]).matches(text, 2)}
        assert set(got) == want and len(got) == len(want)


def _brute(text, items, most, least, coverage):
    """Places of the tokens to cut, by comparing every pair of places."""
    marked, covered = {}, {}
    found = []  # (begin, end, item, place) of the longest matches with each item that can't be prolonged
    for k, x in enumerate(items):
        best = {}  # end -> (size, place), the longest match with the item that ends there, the first place of it
        for e in range(1, len(text) + 1):
            for size in range(min(e, len(x)), 0, -1):
                at = next((p for p in range(len(x) - size + 1) if x[p : p + size] == text[e - size : e]), None)
                if at is not None:
                    best[e] = (size, at)
                    break
        found += [(e - n, e, k, p) for e, (n, p) in best.items() if n >= least and not (e + 1 in best and best[e + 1][0] == n + 1)]
    chosen = [m for m in found if m[1] - m[0] >= most]
    if len({i for a, b, *_ in found for i in range(a, b)}) > coverage * len(text):
        chosen += found
    for k, x in enumerate(items):
        own = [m for m in found if m[2] == k]
        if len({p + j for a, b, _, p in own for j in range(b - a)}) > coverage * len(x):
            chosen += own
    return {i for a, b, *_ in chosen for i in range(a, b)}


def test_cuts_against_brute_force(spark):
    r = random.Random(13)
    items = [[f"i{r.randrange(9)}" for _ in range(r.randrange(3, 16))] for _ in range(6)]
    docs = []
    for _ in range(120):
        d = []
        while len(d) < 25:
            x = r.choice(items)
            a = r.randrange(len(x))
            d += x[a : a + r.randrange(1, 12)] if r.random() < 0.5 else [f"z{r.randrange(99)}" for _ in range(r.randrange(6))]
        docs.append(d)
    frame = spark.createDataFrame([(str(i), " ".join(d)) for i, d in enumerate(docs)], "doc_id string, text string")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    for most, least, coverage in ((10, 5, 0.5), (4, 2, 0.8), (6, 3, 0.3)):
        got = {x.doc_id: x for x in decontam.contamination(frame, table, most, least, coverage).collect()}
        for i, d in enumerate(docs):
            want = _brute(d, items, most, least, coverage)
            left = got[str(i)].clean_text.split() if str(i) in got else d
            assert left == [w for j, w in enumerate(d) if j not in want], (i, most)
