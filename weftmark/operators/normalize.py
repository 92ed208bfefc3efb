"""Dropping redundant parentheses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmark.operators.lexing import Lexed


def redundant(x: Lexed) -> tuple[np.ndarray, np.ndarray]:
    """(keep, collapsed) of each token, by the rule of ``mark_parens``."""
    keep, collapsed = np.ones(len(x.code), bool), np.zeros(len(x.code), bool)
    names = x.meaning.names
    left, right = (names.index(c) if c in names else -9 for c in "()")
    at = np.flatnonzero((x.code == left) | (x.code == right))
    if not len(at):
        return keep, collapsed
    opened, doc = x.code[at] == left, np.searchsorted(x.bounds, at, "right") - 1
    redo = opened & np.append(False, opened[:-1] & (np.diff(at) == 1) & (np.diff(doc) == 0))
    new = np.append(True, doc[1:] != doc[:-1])
    step = np.where(opened, 1, -1)
    total = np.cumsum(step)
    depth = total - np.repeat((total - step)[new], np.diff(np.append(np.flatnonzero(new), len(at))))
    # a later text lies so much lower that the running minimum starts anew with it
    drop = doc * (2 * len(at) + 1)
    low = np.minimum(np.minimum.accumulate(depth - drop) + drop, 0)
    stray = ~opened & (low < np.where(new, 0, np.append(0, low[:-1])))
    level = depth - low + ~opened
    real = np.flatnonzero(~stray)
    order = real[np.lexsort((real, level[real], doc[real]))]
    mated = (doc[order][1:] == doc[order][:-1]) & (level[order][1:] == level[order][:-1]) & ~opened[order][1:]
    closing = order[1:][mated & redo[order][:-1]]
    collapsed[at[closing]] = True
    keep[at[redo]] = False
    keep[collapsed] = False
    return keep, collapsed


def mark_parens(tokens: DataFrame) -> DataFrame:
    """Adds keep and collapsed to tokens.

    An opening parenthesis right after another is redundant and goes, matched or
    not, and its mate with it; such mates are counted (collapsed). Stray
    closing ones stay. Depth is the running sum above its running minimum, and
    within a depth opening and closing alternate, so windows find the mates.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    running = doc.rowsBetween(Window.unboundedPreceding, 0)
    opened, closed = F.col("text") == "(", F.col("text") == ")"
    t = tokens.withColumn("_redundant", opened & F.coalesce(F.lag("text").over(doc) == "(", F.lit(False)))
    t = t.withColumn("_sum", F.sum(F.when(opened, 1).when(closed, -1).otherwise(0)).over(running))
    t = t.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(running)))
    t = t.withColumn("_stray", F.col("_low") < F.lag("_low", 1, 0).over(doc))
    t = t.withColumn("_level", F.when(opened, F.col("_sum") - F.col("_low")).when(closed & ~F.col("_stray"), F.col("_sum") - F.col("_low") + 1))
    mate = F.lag("_redundant").over(Window.partitionBy("doc_id", "_level").orderBy("pos"))
    t = t.withColumn("collapsed", closed & F.col("_level").isNotNull() & F.coalesce(mate, F.lit(False)))
    return t.withColumn("keep", ~(F.col("_redundant") | F.col("collapsed"))).drop("_redundant", "_sum", "_low", "_stray", "_level")


def normalize(tokens: DataFrame) -> DataFrame:
    """The kept tokens, numbered anew; spans stay those of the source."""
    kept = mark_parens(tokens).where("keep")
    return kept.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("bigint").alias("pos"), "text", "offset", "length")
