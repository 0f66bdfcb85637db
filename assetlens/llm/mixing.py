"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected target / source_size times. Expected copies are summed along the source's
documents in order of size; with one random offset per source, a document is emitted once for every whole number its
interval crosses. Ordering by size keeps the words taken within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, store, with_row_number

WORD = r"[^\x20\x09-\x0D]+"
#: Times its source's size that a target may be.
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target: shares of all words by the weights 1, 2, 3, repeating in order of source.

    A target stops at MOST times its source's size; the excess goes to the others by weight until none is above. That
    is min(weight * level, cap), where the level makes the sum right: sources meet their caps in order of cap / weight.
    The table has one row per source; that is all that one task holds here.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    by_cap = W.orderBy("meets", F.col("source").isNull(), "source")
    whole = W.partitionBy()
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * MOST).withColumn("meets", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.col("capped")) / F.col("open"))
    # Taking out a source that meets its cap below the level lifts the level, taking out another lowers it: the highest holds.
    s = s.withColumn("final", F.max("level").over(whole))
    lifted = F.col("meets") <= F.col("final")
    return s.select("source", "source_size", F.when(lifted, F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) from the source's name: the same at every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies times size).

    Size is the number of words; a null text has none. A null source is a source of its own, last in order. Documents
    without words are never taken. Rows that repeat a key are sampled one by one. An empty table stays empty; other
    columns are ignored. A document's place in its source comes from one distributed sort: places within a
    partition, plus the counts of the partitions before; no task holds a whole source.
    """
    spark = docs.sparkSession
    rows = store(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")), "sizes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "source", "size", "doc_id").sortWithinPartitions("source", "size", "doc_id")
    placed = store(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "placed")
    parts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("place").alias("begin"), F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n"))
    sizes = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    # One row for each source and for each further partition that a source spreads over.
    parts = parts.alias("p").join(sizes.alias("s"), F.expr("p.source <=> s.source")).select("p.source", "part", "begin", "before", "source_size", "target")
    all_rows = placed.alias("d").join(parts.alias("p"), F.expr("d.part = p.part AND d.source <=> p.source"))
    at = F.col("place") - F.col("begin") + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("d.source"), seed)
    copies = F.least(F.floor((at + 1) * rate + u) - F.floor(at * rate + u), F.lit(MOST)).cast("long")
    return all_rows.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes it; a row of no words is never taken.

    Rows are told apart by a stored number, those that repeat a key or have none too; columns pass through unchanged,
    whatever their names.
    """
    docs, row = with_row_number(docs)
    copies = free_name(docs, "copies")
    taken = mix(docs.select(row, text, source), text, row, source).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copies))
    return docs.join(taken, row).drop(row, copies)
