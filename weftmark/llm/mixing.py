"""Mixing sources to target weights by systematic sampling (operator 10)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Expected copies are whole numbers of millionths, so prefix sums are exact in any order.
MICRO = 1_000_000
#: Consecutive ids that share one step of the prefix sum; bounds the rows that a window sorts together.
BLOCK = 4096
#: The same for string ids: the characters that they share.
PREFIX = 6


def _block(docs: DataFrame, doc_id: str) -> Column:
    """Never smaller for a greater id: ids by BLOCK, strings by their first characters."""
    if isinstance(docs.schema[doc_id].dataType, NumericType):
        return F.floor(F.col(doc_id) / F.lit(BLOCK)).cast("bigint")
    return F.substring(F.col(doc_id).cast("string"), 1, PREFIX)


def _weight(source: Column, weights: Mapping[str, int] | None, default: int) -> Column:
    if not weights:
        return F.lit(default).cast("decimal(38,0)")
    pairs = [F.lit(x) for item in weights.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[source], F.lit(default)).cast("decimal(38,0)")


def expected_copies(docs: DataFrame, weights: Mapping[str, int] | None = None, default_weight: int = 1, seed: int = 7, text: str = "text", source: str = "source") -> DataFrame:
    """One row a source: its size in characters, and the millionths of copies expected of each of its documents.

    The mixture keeps the total size; source s gets the share weight(s) / sum of
    the weights of the sources that have any text. A source without text, or of
    weight 0, expects no copies. Null is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("bigint")).alias("size"))
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, _weight(F.col("source"), weights, default_weight)).otherwise(F.lit(0)).cast("decimal(20,0)"))
    total = sizes.agg(F.sum("size").cast("decimal(20,0)").alias("total"), F.sum("weight").cast("decimal(20,0)").alias("weights"))
    offset = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 12), 16, 10).cast("bigint"), F.lit(MICRO))
    return sizes.crossJoin(F.broadcast(total)).select(
        "source",
        "size",
        F.when(F.col("weight") > 0, F.expr(f"cast(weight as decimal(38,0)) * total * {MICRO} div (cast(size as decimal(20,0)) * weights)")).otherwise(F.lit(0)).cast("bigint").alias("micro"),
        offset.alias("offset"),
    )


def sample(docs: DataFrame, weights: Mapping[str, int] | None = None, default_weight: int = 1, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each document once for every whole number that its source's running sum of expected copies crosses.

    Within a source, documents lie in the order of their id. A document covers
    [before, before + micro) of the running sum; with the source's one random
    offset u it is emitted floor((before + micro + u) / 1e6) - floor((before + u) / 1e6)
    times. So a source yields its expected number of copies to within one, and
    each document the whole part of its expectation or one more.

    The sum is taken in two steps, over blocks of ids and within a block, so a
    source of any size is spread over many tasks.

    All columns are kept and none is added. Null ids come first, in a block of
    their own; rows with one id lie in the order of a hash of text. Null and
    empty texts count nothing to the size of the source but are drawn like the
    others; a source with no text at all yields nothing, as does an empty table.
    Ids are numbers or strings. Texts of any length count whole.
    """
    rates = expected_copies(docs, weights, default_weight, seed, text, source)
    rows = docs.select(F.struct("*").alias("_row"), F.col(source).alias("_source"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_tie"))
    rows = rows.withColumn("_block", _block(rows, "_id"))
    blocks = docs.groupBy(F.col(source).alias("_source"), _block(docs, doc_id).alias("_block")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_before", before).join(rates.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).where("micro > 0").select(F.col("_source").alias("_bs"), F.col("_block").alias("_bb"), "_before", "micro", "offset")
    within = F.row_number().over(Window.partitionBy("_source", "_block").orderBy("_id", "_tie")) - 1
    placed = rows.withColumn("_k", within).join(blocks, F.col("_source").eqNullSafe(F.col("_bs")) & F.col("_block").eqNullSafe(F.col("_bb")))
    start = (F.col("_before") + F.col("_k")) * F.col("micro") + F.col("offset")
    copies = F.floor((start + F.col("micro")) / F.lit(MICRO).cast("decimal(10,0)")) - F.floor(start / F.lit(MICRO).cast("decimal(10,0)"))
    placed = placed.select("_row", copies.cast("int").alias("_copies")).where("_copies > 0")
    return placed.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")


def sample_sql(documents: str = "documents", columns: str = "doc_id, text, lang, source, n_chars", seed: int = 7) -> str:
    """The same rows in DuckDB, equal weights."""
    return f"""
with mix_sizes as (select source, sum(coalesce(length(text), 0))::hugeint as size from {documents} group by source),
mix_rates as (
  select source, (sum(size) over ())::hugeint * {MICRO} // (size * count(*) over ())::hugeint as micro,
         ('0x' || substr(md5('{seed}:' || coalesce(source, '')), 1, 12))::bigint % {MICRO} as offs
  from mix_sizes where size > 0),
mix_placed as (
  select d.*, row_number() over (partition by source order by doc_id nulls first) - 1 as mix_k from {documents} d),
mix_copies as (
  select p.*, (((mix_k + 1) * micro + offs) // {MICRO} - (mix_k * micro + offs) // {MICRO})::bigint as mix_n
  from mix_placed p join mix_rates r on p.source is not distinct from r.source)
select {columns} from mix_copies, unnest(range(mix_n)) as copies(i)"""
