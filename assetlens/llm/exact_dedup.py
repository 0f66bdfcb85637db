"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Rows that are alone at one level never reach the next. Everything is DataFrame functions; the texts themselves are
never shuffled, only their lengths and hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Characters of the normalised text whose hash makes the second level.
PREFIX = 64
#: Bits of the sketch of surviving groups that the second scan tests; its size is fixed (4 MB), whatever the input.
SKETCH_BUCKETS = 1024
SKETCH_BUCKET_BITS = 32768


def without_white(text: Column) -> Column:
    """The text without the characters space, tab, line feed, vertical tab, form feed, carriage return; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _position(size: Column, prefix: Column) -> Column:
    return F.pmod(F.xxhash64(size, prefix), F.lit(SKETCH_BUCKETS * SKETCH_BUCKET_BITS))


def _sketch(groups: DataFrame) -> DataFrame:
    """Bitmap of the groups' positions: at most SKETCH_BUCKETS rows of 4 KB."""
    at = groups.select(_position(F.col("norm_len"), F.col("prefix_hash")).alias("p"))
    bits = at.groupBy((F.col("p") / SKETCH_BUCKET_BITS).cast("int").alias("slot")).agg(
        F.bitmap_construct_agg(F.pmod("p", F.lit(SKETCH_BUCKET_BITS))).alias("bits")
    )
    return bits


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept and text_sha256 (null unless needed or digest_all).

    Texts are equal when they are identical without ASCII white space. Of a group, the row with the most code points in
    the original text stays, then the smallest key. A null text counts as empty; empty texts are equal to one another.
    Rows that repeat a key with the kept text are the same row and are all marked kept. A null key sorts last. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    norm = without_white(F.col(text))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"),
        F.length(norm).alias("norm_len"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix_hash"),
        F.col(text).alias("text"),
    )
    # Level 1: lengths that occur twice. Level 2: of those, (length, prefix hash) pairs that occur twice.
    narrow = rows.select("norm_len", "prefix_hash")
    pairs = narrow.groupBy("norm_len", "prefix_hash").agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("norm_len").agg(F.sum("n").alias("of_len")).where("of_len > 1").select("norm_len")
    survivors = store(pairs.where("n > 1").join(lengths, "norm_len", "left_semi").select("norm_len", "prefix_hash"), "survivors")
    # Level 3: full hash of rows whose pair may have survived; the sketch is a superset of the survivors, the hash decides.
    sketch = _sketch(survivors)
    at = _position(F.col("norm_len"), F.col("prefix_hash"))
    norm = without_white(F.col("text"))
    digest = F.sha2(norm.cast("binary"), 256)
    seen = rows.withColumn("p", at).withColumn("slot", (F.col("p") / SKETCH_BUCKET_BITS).cast("int"))
    seen = seen.join(F.broadcast(sketch), "slot", "left")
    within = F.pmod("p", F.lit(SKETCH_BUCKET_BITS))
    byte = F.conv(F.hex(F.substring("bits", (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), within % 8).cast("int")) != 0, F.lit(False))
    hashed = seen.select(
        "doc_id",
        "n_chars",
        "norm_len",
        hit.alias("survives"),
        (digest if digest_all else F.when(hit, digest)).alias("text_sha256"),
    )
    hashed = store(hashed, "hashed")
    again = hashed.where("survives")
    best = F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = again.groupBy("norm_len", "text_sha256").agg(best.alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # A row outside the groups joins on a key of its own, so that no join key collects them.
    own = F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = hashed.withColumn("k", F.when(F.col("survives"), F.col("text_sha256")).otherwise(own))
    joined = marked.join(groups.select(F.col("text_sha256").alias("k"), "keep_id", "group_size"), "k", "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep.eqNullSafe(F.col("doc_id")), F.lit(True)).alias("kept"),
        "text_sha256",
    )
