import random

import pytest

from weftmark.llm import toxicity


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("I will kill you.", 2.0), ("Go kill yourself", 2.0), ("You will be hanged, they said, hang them", 2.0 * 0.4), ("They should be strangled; we kill", 0.5), ("you shall get stab", 2.0),
        ("They kill bacteria with soap.", None), ("you can hang your coat here", None), ("kill the process", None), ("kill your brother", 2.0), ("we beat you up", 2.0), ("they beat the eggs", None),
        ("you are an idiot", 1.5), ("idiot that you are", 1.5), ("an idiot", 1.0), ("not an idiot", 0.25), ("he said you are an idiot", 0.6), ("I won't kill you", 0.5),
        ("take the garbage out", 0.5), ("you garbage", 1.5), ("a piece of utter shit", 1.0), ("you piece of garbage", 1.5), ("a waste of good space", 1.0), ("clean space", None), ("", None),
    ],
)
def test_sentences(spark, text, score):
    got = toxicity.scores(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert (got[0].score if got else None) == (pytest.approx(score) if score else None)


def _clause(classes):
    """The rules one by one, by looking around each word."""
    marked, words = [], list(classes)
    for i, c in enumerate(words):
        behind = words[i + 1 :]
        seen, left = "", 0
        for k in range(len(behind) - 1, -1, -1):
            b = behind[k]
            if b == "Y":
                seen, left = ("YD" if seen == "D" and left == 3 else "Y"), 4
            elif b == "Z" and seen != "H":
                seen, left = "Y", 4
            elif b in "HD":
                seen, left = b, 4
            left -= 1
            seen = seen if left > 0 else ""
        if c in "IJ" and seen in ("Y", "YD"):
            c += ">"
        elif c == "T":
            c = {"": "T", "D": "T", "H": "t"}.get(seen, "T>")
        elif c == "K" and seen == "YD":
            c = "T>"
        marked.append(c)
    total = 0.0
    for i, c in enumerate(marked):
        person = any(m in ("Y", "Z") for m in marked[max(i - 4, 0) : i])
        passive = any(marked[p] == "P" and any(m in ("Y", "Z") for m in marked[max(p - 4, 0) : p]) for p in range(max(i - 4, 0), i))
        worth = {"I": 1.5 if person else 1.0, "I>": 1.5, "J": 1.5 if person else 0.5, "J>": 1.5, "T": 2.0 if passive else 0.5, "T>": 2.0}.get(c, 0.0)
        total += worth * (0.25 if "N" in marked[max(i - 3, 0) : i] else 1.0) * (0.4 if "R" in marked[:i] else 1.0)
    return total


def test_grammar_against_rules():
    r = random.Random(15)
    for _ in range(3000):
        c = "".join(r.choice("oooIJTKDYZPNRH") for _ in range(r.randrange(1, 12)))
        assert toxicity.clause_score(c) == pytest.approx(_clause(c)), c
