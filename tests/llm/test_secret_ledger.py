import random
import re

from weftmark.llm import secrets

KEY, TOKEN = "AKIA" + "B" * 16, "ghp_" + "a1" * 18


def _rows():
    r = random.Random(17)
    texts = ["clean", "", None, f"{KEY} and {TOKEN}", f"{KEY} {KEY}", "x" * 50_000 + TOKEN, f"token = '{KEY}'"]
    return [(p, t, f"extra{i}", i, "c") for i, (p, t) in enumerate((r.choice(["a", "b", None]), r.choice(texts)) for _ in range(60))]


SCHEMA = "path string, text string, blob string, rule int, _text string"


def _brute(rows, rules):
    return [(p, x.rule_id, x.version, i + 1, m) for p, t, *_ in rows for x in rules for i, m in enumerate(re.findall(x.pattern, t or ""))]


def _found(scan):
    return sorted(((r.path, r.rule_id, r.rule_version, r.occurrence, r.secret) for r in scan.findings.collect()), key=str)


def test_histories_and_rule_versions(spark, monkeypatch):
    rows = _rows()
    versions = spark.createDataFrame(rows, SCHEMA)
    first = secrets.scan(versions, path=("path",))
    assert _found(first) == sorted(_brute(rows, secrets.RULES), key=str)
    raised = tuple(secrets.Rule(x.rule_id, 2, "(?:AKIA)[A-Z]{16}|LEAK[0-9]+", ("AKIA", "LEAK")) if x.rule_id == "access_key_id" else x for x in secrets.RULES)
    more = [*rows, ("d", "LEAK42", "", 0, ""), ("d", f"{TOKEN}", "", 0, "")]
    for few in (secrets.FEW, 0):
        monkeypatch.setattr(secrets, "FEW", few)
        ledger = first.ledger.persist()
        second = secrets.scan(spark.createDataFrame(more, SCHEMA), ledger, raised, path=("path",))
        assert _found(second) == sorted(_brute(more, raised), key=str)
        after = {r.blob: r for r in second.ledger.collect()}
        assert all(set(r.scanned) >= {x.key for x in raised} and len(r.scanned) == len(set(r.scanned)) for r in after.values())
        assert sum("access_key_id@1" in r.scanned for r in after.values()) == ledger.count() == len(after) - 2
        third = secrets.scan(spark.createDataFrame(more[:5], SCHEMA), second.ledger, raised, path=("path",))
        assert third.ledger.count() == len(after) and _found(third) == sorted(_brute(more[:5], raised), key=str)


def test_only_unseen_pairs_are_scanned(spark):
    """A ledger that says a blob was clean is believed for the rule versions it names."""
    versions = spark.createDataFrame([("a", KEY, "", 0, "")], SCHEMA)
    scanned = secrets.scan(versions, path=("path",)).ledger
    believed = scanned.selectExpr("blob", "scanned", f"cast(array() as {secrets.FINDING}) as hits")
    assert secrets.scan(versions, believed, path=("path",)).findings.count() == 0
    assert secrets.scan(versions, believed.limit(0), path=("path",)).findings.count() == 1
    assert secrets.scan(versions.limit(0), believed, path=("path",)).ledger.count() == 1
