"""An analysis from documents to ranked matches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmark.operators import fragments as fr
from weftmark.operators import pairs as pr
from weftmark.operators.fingerprint import parse
from weftmark.options import Options
from weftmark.sources.files import LEXER_OF, discover


@dataclass
class Analysis:
    """Lazy results: docs (doc_id, display, source), matches (ranked), summary (one row), parsed (see ``parse``)."""

    docs: DataFrame
    matches: DataFrame
    summary: DataFrame
    parsed: DataFrame
    options: Options
    warnings: list[str] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)

    def fragments(self, first: int = 10) -> DataFrame:
        """Matched fragments with their texts of the first matches; only their documents are looked up."""
        top = self.matches.where(F.col("rank") <= first)
        found = fr.matched_fragments(top, fr.documents_of(top, self.parsed), self.options.k)
        return fr.with_text(found, fr.documents_of(top, self.docs), "doc_id", "source")

    def named(self) -> DataFrame:
        """rank, file_a, file_b, similarity, shared_fingerprints, lhs and rhs of every match."""
        names = self.docs.select("doc_id", "display")
        out = self.matches.join(names.toDF("lhs", "file_a"), "lhs").join(names.toDF("rhs", "file_b"), "rhs")
        return out.select("rank", "file_a", "file_b", "similarity", "shared_fingerprints", "lhs", "rhs")

    def close(self) -> None:
        """Frees what is cached."""
        for df in self.held:
            df.unpersist()


def parse_each(docs: DataFrame, options: Options) -> DataFrame:
    """``parse``; with the lexer "auto" each document by the lexer of its language, and by C++ rules where that is unknown."""
    if options.lexer != "auto":
        return parse(docs, options, "doc_id", "source")
    language = F.col("language") if "language" in docs.columns else F.lit(None).cast("string")
    out = None
    for lexer in sorted(set(LEXER_OF.values())):
        known = language.isin(*[k for k, v in LEXER_OF.items() if v == lexer])
        other = ~F.coalesce(language.isin(*LEXER_OF), F.lit(False))
        mine = docs.where((F.coalesce(known, F.lit(False)) | other) if lexer == "cpp" else known)
        part = parse(mine, options.using(lexer), "doc_id", "source")
        out = part if out is None else out.union(part)
    return out


def ranked(matches: DataFrame, top_n: int, held: list[DataFrame]) -> DataFrame:
    """Adds rank, in the order of similarity, lhs and rhs.

    All matches are sorted by range, and each partition's first rank follows
    from the sizes of those before it, so no task holds more than its range. The
    sorted table is cached and added to ``held``.
    """
    order = [F.desc("similarity"), F.asc("lhs"), F.asc("rhs")]
    if top_n:
        return matches.orderBy(*order).limit(top_n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    placed = matches.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    held.append(placed.persist())
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_k", within).join(F.broadcast(starts), "_part").withColumn("rank", (F.col("_before") + F.col("_k")).cast("bigint")).drop("_part", "_k", "_before")


def analyze(docs: DataFrame, options: Options = Options(), key: str = "doc_id", source: str = "text", display: str | None = None, warnings: list[str] | None = None) -> Analysis:
    """Scores all pairs of documents, filters, sorts and ranks them.

    All pairs give the summary's figures, without being enumerated: those that
    share no fingerprint score 0, or 100 if both have none. Only a threshold of 0
    asks for the rows of pairs that share nothing. Documents are parsed once,
    and what that gives is cached, as are the scored pairs, until ``close``.
    """
    language = ["language"] if "language" in docs.columns else []
    docs = docs.select(F.col(key).alias("doc_id"), (F.col(display) if display else F.col(key).cast("string")).alias("display"), F.col(source).alias("source"), *language)
    parsed = parse_each(docs, options).persist()
    indexed = pr.compare_indexed(parsed, options.min_shared if options.indexed else 1).persist()
    if options.indexed:
        rows = indexed
    elif options.threshold > 1e-9:
        rows = indexed.union(pr.empty_pairs(parsed))
    else:
        rows = pr.compare_all(parsed)
    kept = rows.where(F.col("similarity") + 1e-9 >= options.threshold)
    above = kept.agg(F.count("*").alias("matches_above_threshold"))
    collapsed = parsed.agg(F.coalesce(F.sum("parens_collapsed"), F.lit(0)).alias("parens_collapsed"))
    summary = pr.summary(indexed, parsed, options.indexed).crossJoin(above).crossJoin(collapsed)
    held = [parsed, indexed]
    matches = ranked(kept, options.top_n, held).select("rank", "lhs", "rhs", "similarity", "shared_fingerprints")
    return Analysis(docs, matches, summary, parsed, options, warnings or [], held)


def analyze_directory(spark: SparkSession, root: str, options: Options = Options()) -> Analysis:
    """``analyze`` on the source files below a directory; having none that can be read is an error."""
    files, warnings = discover(spark, root)
    if files.isEmpty():
        raise ValueError("no readable source files: " + "; ".join(warnings))
    return analyze(files, options, "doc_id", "content", "display", warnings)


def compare_sources(spark: SparkSession, left: str | bytes, right: str | bytes, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(the two profiles, the one pair with similarity and shared_fingerprints) of two sources."""
    raw = [(i, s.encode() if isinstance(s, str) else s) for i, s in enumerate((left, right))]
    parsed = parse(spark.createDataFrame(raw, "doc_id bigint, source binary"), options, "doc_id", "source")
    return parsed.select("doc_id", "tokens", "kgrams", "fingerprints", "parens_collapsed"), pr.compare_all(parsed)


def compare(spark: SparkSession, left: str | bytes, right: str | bytes, options: Options = Options(normalize=False)) -> float:
    """Similarity in percent of two sources."""
    return compare_sources(spark, left, right, options)[1].first().similarity
