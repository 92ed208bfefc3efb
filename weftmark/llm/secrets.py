"""Secret scans with an incremental blob ledger (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named pattern; raise ``version`` whenever ``pattern`` changes. ``hints``: a match contains one of these strings."""

    rule_id: str
    version: int
    pattern: str
    hints: tuple[str, ...]

    @property
    def key(self) -> str:
        return f"{self.rule_id}@{self.version}"


#: The patterns mean the same to Java and RE2.
RULES = (
    Rule("access_key_id", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("AKIA", "ASIA")),
    Rule("git_host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,72}", ("xox",)),
    Rule("cloud_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("payment_key", 1, r"[sr]k_live_[0-9A-Za-z]{24,99}", ("k_live_",)),
    Rule("json_web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("PRIVATE KEY",)),
    Rule(
        "assigned_secret", 1,
        r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)[ \t]*[:=][ \t]*[\"'][A-Za-z0-9_/+=.-]{16,128}[\"']",
        ("oken", "OKEN", "ecret", "ECRET", "assw", "ASSW", "ey", "EY"),
    ),
)

#: Unseen blobs whose hashes are broadcast, at most: some 10 MB of them.
FEW = 50_000

FINDING = "array<struct<rule:string,occurrence:int,secret:string>>"


class Scan(NamedTuple):
    findings: DataFrame
    ledger: DataFrame


def _finding(rule: Rule):
    return lambda s, i: F.struct(F.lit(rule.key).alias("rule"), (i + 1).alias("occurrence"), s.alias("secret"))


def _hits(rules: tuple[Rule, ...], text: str, unseen) -> F.Column:
    """The matches in a blob of the rules that ``unseen(rule)`` admits, in one array."""
    parts = []
    for r in rules:
        hinted = F.lit(False)
        for h in r.hints:
            hinted = hinted | F.contains(F.col(text), F.lit(h))
        found = F.transform(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)), _finding(r))
        parts.append(F.when(unseen(r) & hinted, found).otherwise(F.array().cast(FINDING)))
    return F.concat(*parts)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: tuple[str, ...] = ("doc_id",), text: str = "text") -> Scan:
    """Scans every historical version once a blob and rule version, and reports findings at all paths.

    ``versions`` holds one row for each path at each point of its history; a
    version's blob is the SHA-256 of its text. ``ledger`` is what an earlier
    scan returned: (blob, scanned, hits), with scanned the rule@version keys
    that the blob has been put to and hits what they found, an empty array for
    a clean blob. Only pairs of a blob and a rule version that it lacks are
    scanned; equal blobs are scanned once, however many paths hold them.

    With a ledger, hashes alone decide what is unseen, and only texts with an
    unseen pair are moved: if these are FEW, their hashes are broadcast and all
    other texts stay where they are read. Without one all texts are.

    Returns findings (the path columns, blob, rule_id, rule_version, occurrence,
    secret: one row a match and path, of the given rules) and the next ledger,
    which keeps blobs that no version holds any more. Matches of one rule don't
    overlap and are numbered from the text's start; those of two rules may lie at
    one place and are both reported.

    Null texts are no blobs and yield nothing; the empty text is a clean blob;
    texts of any length are scanned whole. Repeated rows yield one finding each,
    null paths are kept, and other columns of ``versions`` are left out,
    whatever their names. Empty tables, also an empty ledger, give empty results.
    """
    keys = [r.key for r in rules]
    all_keys = F.array(*map(F.lit, keys)).cast("array<string>")
    held = versions.where(F.col(text).isNotNull())
    names = [F.col(p).alias(f"_p{i}") for i, p in enumerate(path)]
    texts = held.select(F.sha2(text, 256).alias("blob"), F.col(text).alias("_text"))
    if ledger is None:
        merged = texts.groupBy("blob").agg(F.first("_text").alias("_text")).select("blob", all_keys.alias("scanned"), _hits(rules, "_text", lambda r: F.lit(True)).alias("hits"))
    else:
        old = ledger.select("blob", F.col("scanned").alias("_scanned"), F.col("hits").alias("_old"))
        none, clean = F.array().cast("array<string>"), F.array().cast(FINDING)
        known = old.select("blob", F.col("_scanned"))
        unseen = texts.select("blob").distinct().join(known, "blob", "left").select("blob", F.array_except(all_keys, F.coalesce("_scanned", none)).alias("_missing")).where(F.size("_missing") > 0)
        if unseen.limit(FEW + 1).count() <= FEW:
            unseen = F.broadcast(unseen)
        fresh = texts.join(unseen, "blob").groupBy("blob").agg(F.first("_text").alias("_text"), F.first("_missing").alias("_missing"))
        fresh = fresh.select("blob", "_missing", _hits(rules, "_text", lambda r: F.array_contains("_missing", r.key)).alias("_new"))
        merged = old.join(fresh, "blob", "full_outer").select("blob", F.concat(F.coalesce("_scanned", none), F.coalesce("_missing", none)).alias("scanned"), F.concat(F.coalesce("_old", clean), F.coalesce("_new", clean)).alias("hits"))
    found = merged.where(F.size("hits") > 0).select("blob", F.explode("hits").alias("_h")).where(F.col("_h.rule").isin(keys))
    paths = held.select(F.sha2(text, 256).alias("blob"), *names)
    findings = paths.join(found, "blob").select(
        *[F.col(f"_p{i}").alias(p) for i, p in enumerate(path)],
        "blob",
        F.substring_index("_h.rule", "@", 1).alias("rule_id"),
        F.substring_index("_h.rule", "@", -1).cast("int").alias("rule_version"),
        F.col("_h.occurrence").alias("occurrence"),
        F.col("_h.secret").alias("secret"),
    )
    return Scan(findings, merged)


def scan_sql(documents: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The findings of a first scan in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = "\nunion all\n".join(f"select doc_id, sha256(text) as blob, {quote(r.rule_id)} as rule_id, {r.version}::int as rule_version, regexp_extract_all(text, {quote(r.pattern)}) as found from {documents} where text is not null" for r in rules)
    return f"select doc_id, blob, rule_id, rule_version, i::int as occurrence, found[i] as secret from ({each}) f, unnest(range(1, len(found) + 1)) as t(i)"
