"""Matched fragments of pairs, merged spans and highlighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matched_fragments(pairs: DataFrame, parsed: DataFrame, k: int, per_hash: int = 3, total: int = 30) -> DataFrame:
    """Places where both documents of a pair (lhs, rhs) have the same fingerprint.

    Hashes come by first appearance in lhs, places by position; at most
    ``per_hash`` of a hash and ``total`` of a pair. Offsets and lengths are
    bytes, and come from the picks of ``parse``.
    """
    p = pairs.select("lhs", "rhs")
    side = lambda doc, s: parsed.select(F.col("doc_id").alias(doc), F.inline("picks")).toDF(doc, f"{s}_token_pos", "hash", f"{s}_offset", f"{s}_length")
    both = p.join(side("lhs", "a"), "lhs").join(side("rhs", "b"), ["rhs", "hash"]).where(F.lit(k > 0 and total > 0))
    own = Window.partitionBy("lhs", "rhs", "hash")
    both = both.withColumn("_n", F.row_number().over(own.orderBy("a_token_pos", "b_token_pos"))).withColumn("_first", F.min("a_token_pos").over(own)).where(F.col("_n") <= per_hash)
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy("lhs", "rhs").orderBy("_first", "hash", "a_token_pos", "b_token_pos"))).where(F.col("_n") <= total)
    return both.select("lhs", "rhs", "hash", "a_token_pos", "b_token_pos", "a_offset", "a_length", "b_offset", "b_length", F.col("_n").cast("bigint").alias("nth"))


def documents_of(pairs: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that are in one of a few pairs, whose ids go to all tasks, so that no text is shuffled."""
    ids = pairs.select(F.explode(F.array("lhs", "rhs")).alias("_in")).distinct()
    return docs.join(F.broadcast(ids), F.col(key) == F.col("_in"), "left_semi")


def with_text(fragments: DataFrame, docs: DataFrame, key: str = "doc_id", source: str = "text") -> DataFrame:
    """Adds a_text and b_text, cut from the bytes."""
    raw = docs.select(F.col(key).alias("_id"), F.encode(F.col(source), "UTF-8").alias("_raw") if docs.schema[source].dataType.simpleString() == "string" else F.col(source).alias("_raw"))
    out = fragments
    for side, doc in (("a", "lhs"), ("b", "rhs")):
        out = out.join(raw, F.col(doc) == F.col("_id")).withColumn(f"{side}_text", F.decode(F.expr(f"substring(_raw, cast({side}_offset as int) + 1, cast({side}_length as int))"), "UTF-8")).drop("_id", "_raw")
    return out


def merge_spans(fragments: DataFrame, gap: int = 3) -> DataFrame:
    """Fragments of a pair that follow each other within ``gap`` bytes on both sides as one span.

    Sorted by both offsets; one joins the span before it if it begins within
    the gap in a, and the joint extent in b isn't longer than both lengths and
    the gap. The second test depends on the span so far, hence a fold.
    """
    item = F.sort_array(F.collect_list(F.struct("a_offset", "b_offset", "a_length", "b_length")))
    folded = """
      aggregate(f, cast(array() as array<struct<a:bigint,al:bigint,b:bigint,bl:bigint,n:bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.a_offset <= acc[size(acc) - 1].a + acc[size(acc) - 1].al + {gap}
           and greatest(acc[size(acc) - 1].b + acc[size(acc) - 1].bl, x.b_offset + x.b_length) - least(acc[size(acc) - 1].b, x.b_offset) <= acc[size(acc) - 1].bl + x.b_length + {gap},
           concat(slice(acc, 1, size(acc) - 1), array(named_struct(
             'a', acc[size(acc) - 1].a, 'al', greatest(acc[size(acc) - 1].a + acc[size(acc) - 1].al, x.a_offset + x.a_length) - acc[size(acc) - 1].a,
             'b', least(acc[size(acc) - 1].b, x.b_offset), 'bl', greatest(acc[size(acc) - 1].b + acc[size(acc) - 1].bl, x.b_offset + x.b_length) - least(acc[size(acc) - 1].b, x.b_offset),
             'n', acc[size(acc) - 1].n + 1))),
           concat(acc, array(named_struct('a', x.a_offset, 'al', x.a_length, 'b', x.b_offset, 'bl', x.b_length, 'n', 1L)))))"""
    spans = fragments.groupBy("lhs", "rhs").agg(item.alias("f")).select("lhs", "rhs", F.explode(F.expr(folded.format(gap=int(gap)))).alias("s"))
    return spans.select("lhs", "rhs", F.col("s.a").alias("a_offset"), F.col("s.al").alias("a_length"), F.col("s.b").alias("b_offset"), F.col("s.bl").alias("b_length"), F.col("s.n").alias("fragment_count"))


def filter_small(spans: DataFrame, least: int = 10) -> DataFrame:
    return spans.where((F.col("a_length") >= least) | (F.col("b_length") >= least))


def highlight_segments(fragments: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lhs, rhs, begin, end, marked): the lhs of each pair as runs inside and outside its fragments; ``sizes``: doc_id, n_bytes."""
    order = Window.partitionBy("lhs", "rhs").orderBy("begin", "end")
    f = fragments.select("lhs", "rhs", F.col("a_offset").alias("begin"), (F.col("a_offset") + F.col("a_length")).alias("end"))
    f = f.withColumn("_seen", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    f = f.withColumn("_island", F.sum(F.when(F.col("_seen").isNull() | (F.col("begin") > F.col("_seen")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = f.groupBy("lhs", "rhs", "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    by_pair = Window.partitionBy("lhs", "rhs").orderBy("begin")
    marked = marked.withColumn("_before", F.coalesce(F.lag("end").over(by_pair), F.lit(0))).withColumn("_last", F.lead("begin").over(by_pair).isNull()).join(sizes.toDF("lhs", "_n"), "lhs")
    inside = marked.select("lhs", "rhs", "begin", "end", F.lit(True).alias("marked"))
    gaps = marked.select("lhs", "rhs", F.col("_before").alias("begin"), F.col("begin").alias("end"), F.lit(False).alias("marked"))
    rest = marked.where("_last").select("lhs", "rhs", F.col("end").alias("begin"), F.col("_n").alias("end"), F.lit(False).alias("marked"))
    return inside.union(gaps.where("begin < end")).union(rest.where("begin < end"))
