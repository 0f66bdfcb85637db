"""Quality selection by importance resampling.

Two generative models of hashed n-grams (words and pairs of words) are counted, one over the target texts, one over
all raw texts; a document's importance is the ratio of its likelihoods. Gumbel noise is added to the log ratio and the
k greatest are taken: a draw of k documents without replacement in proportion to their importance.

The number of hash buckets grows with the square root of the input, so the score stays as fine as the counts allow. A
task holds at most PART of them at a time: more are counted, and scored, in several passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, arrow_batches, encoded, pieces, store

#: Buckets for the first BYTES of text; four times the text has twice as many.
BUCKETS, BYTES = 10_000, 1 << 20
#: Buckets of one pass: 16 MB of ratios are broadcast; SLOT of them are one row of counts.
PART, SLOT = 1 << 22, 1 << 10
#: Added to every bucket's count.
SMOOTH = 1.0
#: Tasks that count, for each core: each gives one row per SLOT buckets, so more of them would shuffle more.
TASKS = 4


def features(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and every pair of words."""
    words = Words(encoded(texts), lower=True)
    at, pairs = words.grams(2)
    return np.concatenate([words.text, words.text[at]]), (np.concatenate([words.hash, pairs]) % np.uint64(buckets)).astype(np.int64)


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return int(BUCKETS * max(1.0, (size / BYTES) ** 0.5))


def counts(docs: DataFrame, buckets: int, begin: int, text: str = "text") -> tuple[np.ndarray, int]:
    """How often each of the buckets begin, ..., begin + PART - 1 (or the last) occurs in all whole texts, and how often
    all buckets do."""
    n = min(PART, buckets - begin)
    slots = -(-n // SLOT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, every = np.zeros(slots * SLOT, np.int64), 0
        for piece in pieces(((t,) for b in batches for t in b.column(0).to_pylist()), 0):
            found = features([t for (t,) in piece], buckets)[1] - begin
            every += len(found)
            total += np.bincount(found[(found >= 0) & (found < n)], minlength=len(total))
        some = [i for i in range(slots) if total[i * SLOT : (i + 1) * SLOT].any()]
        parts = [total[i * SLOT : (i + 1) * SLOT].tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int32()), pa.array([*parts, np.array([every]).tobytes()], pa.binary())], ["slot", "n"])

    def add(slot: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in slot.column("n").to_pylist())
        return pa.table({"slot": slot.column("slot")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    tasks = TASKS * docs.sparkSession.sparkContext.defaultParallelism
    found = docs.select(text).coalesce(tasks).mapInArrow(count, "slot int, n binary").groupBy("slot").applyInArrow(add, "slot int, n binary")
    out, every = np.zeros(slots * SLOT, np.int64), 0
    for r in found.collect():  # PART buckets at most
        if r.slot < 0:
            every = int(np.frombuffer(r.n, np.int64)[0])
        else:
            out[r.slot * SLOT : (r.slot + 1) * SLOT] = np.frombuffer(r.n, np.int64)
    return out[:n], every


def log_shares(n: np.ndarray, total: int, buckets: int) -> np.ndarray:
    return np.log((n + SMOOTH) / (total + SMOOTH * buckets))


def importance(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int | None = None) -> DataFrame:
    """docs with log_weight: log of target likelihood over raw likelihood of the whole text, all its features together.

    The raw model counts all of docs, the target model all of target. A text without words has weight 0 (ratio 1). A
    column named log_weight is replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    buckets = buckets or buckets_for(docs, text)
    weight: Column = F.lit(0.0)
    for begin in range(0, buckets, PART):
        ours, theirs = (log_shares(*counts(x, buckets, begin, text), buckets) for x in (target, docs))
        weight = weight + _weigh(spark.sparkContext.broadcast((ours - theirs).astype(np.float32)), begin, buckets)(F.col(text))
    return docs.withColumn("log_weight", weight)


def _weigh(held, begin: int, buckets: int):
    """The part of the log ratio that the buckets from `begin` on give."""

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio = held.value
        for batch in batches:
            out = []
            for piece in pieces(zip(batch), 0):
                owner, bucket = features([t for (t,) in piece], buckets)
                at = bucket - begin
                own = slice(None) if len(ratio) == buckets else (at >= 0) & (at < len(ratio))
                out.append(np.bincount(owner[own], ratio[at[own]], len(piece)))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return weigh


def resample(docs: DataFrame, target: DataFrame, share: float = 0.5, scale: float = 1.0, seed: int = 11, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, log_weight, rank (1 is first drawn) and selected: rank is within share of all rows.

    The draw is Gumbel top-k: noise from a hash of the key and the seed, so that reruns agree; scale multiplies the
    log weight, which is that of the whole text, the sum over all its features. Null texts and texts without words have log weight 0; rows that repeat a key share their noise; an
    empty target gives every text its weight against a flat model. Ranks come from one distributed sort: places
    within a partition, plus the sizes of those before.
    """
    spark = docs.sparkSession
    u = (F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    rows = importance(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), target.select(F.col(text).alias("text")))
    rows = store(rows.select("doc_id", "log_weight", (F.col("log_weight") * scale - F.log(-F.log(u))).alias("draw")), "weights")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.desc("draw"), "doc_id").sortWithinPartitions(F.desc("draw"), "doc_id", "log_weight")
    placed = store(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "drawn")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("begin"))  # one row per partition
    parts = parts.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    total = rows.count()
    ranked = placed.join(F.broadcast(parts), "part").withColumn("rank", F.col("place") - F.col("begin") + F.col("before") + 1)
    return ranked.select("doc_id", "log_weight", "rank", (F.col("rank") <= int(total * share)).alias("selected"))
