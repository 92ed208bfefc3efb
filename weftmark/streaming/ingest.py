"""Fingerprints of documents as they arrive, and their matches with those already seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftmark.operators.fingerprint import fingerprints, parse
from weftmark.options import Options


def start(docs: DataFrame, prints_path: str, matches_path: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Reads a stream of (doc_id, text); each batch's fingerprints go to a partition of ``prints_path`` named by the batch.

    Pairs (lhs new, rhs seen before or new) with their shared fingerprints go to
    ``matches_path``. A batch that is run again replaces its own partition.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        prints = fingerprints(parse(rows, options))
        prints.write.mode("overwrite").parquet(f"{prints_path}/batch={number}")
        every = spark.read.option("basePath", prints_path).parquet(prints_path).where(F.col("batch") <= number)
        new = every.where(F.col("batch") == number).select(F.col("doc_id").alias("lhs"), "hash")
        seen = every.select(F.col("doc_id").alias("rhs"), "hash", "batch")
        pairs = new.join(seen, "hash").where((F.col("batch") < number) | (F.col("lhs") < F.col("rhs")))
        pairs.groupBy("lhs", "rhs").agg(F.count("*").alias("shared_fingerprints")).write.mode("overwrite").parquet(f"{matches_path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
