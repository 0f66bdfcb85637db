"""Substring deduplication by fixed-block anchors.

Every text is cut into non-overlapping blocks of BLOCK words: the anchors. Of any repeated run of 2 * BLOCK - 1 words,
each occurrence holds a whole block, so every rolling BLOCK-word window of the corpus is probed against the anchors;
what hits an anchor elsewhere is extended: the windows of `size` words around it are hashed and counted, and those
that occur twice make up the maximal repeats.

The texts are laid out once, in chunks of a few MB bucketed by chunk; all later steps read those files. Between chunks
and hash buckets go packed arrays with one entry per chunk and hash, so that a passage in a third of all documents
still costs each bucket no more than one entry per chunk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from .common import Words, encoded, mix

CHUNK_BYTES = 4 << 20
#: Entries of a hash bucket, about.
BUCKET_KEYS = 500_000
#: A probe: 30 bits of hash within its bucket, and whether the chunk has it as an anchor, and more than once.
LOW = np.uint64((1 << 30) - 1)
ANCHOR, TWICE = np.uint32(1 << 31), np.uint32(1 << 30)
PROBES = "bucket int, chunk int, payload binary"


def _split(bucket: np.ndarray, value: np.ndarray, chunk: int) -> pa.Table:
    """Rows of PROBES: the values of each bucket; bucket is sorted."""
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*begin[1:].tolist(), len(bucket)][: len(begin)]
    return pa.table(
        {"bucket": pa.array(bucket[begin], pa.int32()), "chunk": pa.array([chunk] * len(begin), pa.int32()), "payload": pa.array([value[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], pa.binary())}
    )


def _keys(grams: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket above 30 bits of hash."""
    return ((grams >> np.uint64(34)) % np.uint64(n_buckets)) << np.uint64(30) | grams & LOW


def _words(chunk: pa.Table) -> tuple[Words, list[bytes]]:
    texts = encoded(chunk.column("text").to_pylist())
    return Words(texts), texts


def _anchored(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of all rolling windows, and which of them are anchors."""
    at, grams = words.grams(block)
    return at, grams, (at - words.first[words.text[at]]) % block == 0


def _unpack(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and the row of each."""
    parts = [np.frombuffer(x, kind) for x in table.column("payload").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _groups(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by value, and the first of each group in that order."""
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(value) else np.zeros(0, np.int64)


def _reply(table: pa.Table, value: np.ndarray, row: np.ndarray) -> pa.Table:
    """PROBES rows again: to each chunk the values that it sent and that hit."""
    chunks = np.array(table.column("chunk").to_pylist(), np.int64)[row]
    order = np.lexsort((value, chunks))
    chunks, value = chunks[order], value[order]
    begin = np.flatnonzero(np.diff(chunks, prepend=-1))
    ends = [*begin[1:].tolist(), len(chunks)][: len(begin)]
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {"bucket": pa.array([bucket] * len(begin), pa.int32()), "chunk": pa.array(chunks[begin], pa.int32()), "payload": pa.array([value[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], pa.binary())}
    )


def _is_in(keys: np.ndarray, hits: np.ndarray) -> np.ndarray:
    if not len(hits):
        return np.zeros(len(keys), bool)
    hits = np.sort(hits)
    return hits[np.minimum(np.searchsorted(hits, keys), len(hits) - 1)] == keys


def _covered(at: np.ndarray, size: int, count: int) -> np.ndarray:
    """Which of count places lie in at, ..., at + size - 1."""
    step = np.zeros(count + size + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step)[:count] > 0


def _lay_out(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, int, str]:
    """The texts by chunk, in a bucketed table in the shared folder; the bytes of all; the table's name."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = int(min(2**30, max(4, -(-total // CHUNK_BYTES))))
    files = int(max(1, min(n_chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # By the text's hash too: a key that many rows repeat is spread.
    laid = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n_chunks)).cast("int"))
    name = f"assetlens_chunks_{uuid.uuid4().hex}"
    (laid.repartition(files, "chunk").write.bucketBy(files, "chunk").option("path", scratch(spark, "chunks")).option("compression", "zstd").saveAsTable(name))
    return spark.table(name), total, name


def repeats(docs: DataFrame, size: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, and kept (binary): the words that stay, joined by one space.

    Words are runs of anything but ASCII white space. A word goes if a window of `size` words over it has the word
    sequence of a window that starts anywhere else, in the same document or another; windows are judged on the input.
    A null text has no words; texts shorter than a window lose nothing; every row counts, also rows that repeat a key
    or a text. Empty tables and columns of other names are fine.
    """
    block = (size + 1) // 2
    lay, total, _ = _lay_out(docs, text, key)
    n_buckets = int(max(4, total / 6.4 / BUCKET_KEYS))

    def probe(chunk: pa.Table) -> pa.Table:
        words, _ = _words(chunk)
        _, grams, anchor = _anchored(words, block)
        k = np.sort(_keys(grams, n_buckets) << np.uint64(1) | anchor)
        last = np.flatnonzero(np.concatenate([k[1:] >> np.uint64(1) != k[:-1] >> np.uint64(1), [True]])) if len(k) else np.zeros(0, np.int64)
        count = np.diff(last, prepend=-1)
        k = k[last]
        value = ((k >> np.uint64(1)) & LOW).astype(np.uint32) | np.where(k & np.uint64(1), ANCHOR, np.uint32(0)) | np.where(count > 1, TWICE, np.uint32(0))
        return _split((k >> np.uint64(31)).astype(np.int64), value, chunk.column("chunk")[0].as_py())

    def resolve(bucket: pa.Table) -> pa.Table:
        value, row = _unpack(bucket, np.uint32)
        low = value & np.uint32(LOW)
        order, begin = _groups(low)
        flags = np.bitwise_or.reduceat(value[order], begin) if len(begin) else value
        size_ = np.diff(np.append(begin, len(low)))
        hit = np.repeat((flags & ANCHOR != 0) & ((size_ > 1) | (flags & TWICE != 0)), size_)
        some = order[hit]
        return _reply(bucket, low[some], row[some])

    def extend(chunk: pa.Table, hits: pa.Table) -> pa.Table:
        if not chunk.num_rows or not hits.num_rows:
            return _split(np.zeros(0, np.int64), np.zeros(0, np.uint64), 0)
        words, _ = _words(chunk)
        at, grams, _ = _anchored(words, block)
        low, row = _unpack(hits, np.uint32)
        found = np.array(hits.column("bucket").to_pylist(), np.uint64)[row] << np.uint64(30) | low.astype(np.uint64)
        p = at[_is_in(_keys(grams, n_buckets), found)]
        # A window that holds a hit starts up to size - block words before it.
        near = _covered(np.maximum(p - (size - block), 0), size - block + 1, len(words.hash))
        start, whole = words.grams(size)
        whole = np.sort(whole[near[start]])
        begin = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, np.int64)
        twice = np.diff(np.append(begin, len(whole))) > 1
        whole = whole[begin]
        bucket = (mix(whole) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        value = whole >> np.uint64(1) | twice.astype(np.uint64) << np.uint64(63)
        return _split(bucket[order], value[order], chunk.column("chunk")[0].as_py())

    def count(bucket: pa.Table) -> pa.Table:
        value, row = _unpack(bucket, np.uint64)
        own = value & np.uint64((1 << 63) - 1)
        order, begin = _groups(own)
        size_ = np.diff(np.append(begin, len(own)))
        twice = np.bitwise_or.reduceat(value[order], begin) >> np.uint64(63) != 0 if len(begin) else np.zeros(0, bool)
        some = order[np.repeat((size_ > 1) | twice, size_)]
        return _reply(bucket, own[some], row[some])

    def cut(chunk: pa.Table, hits: pa.Table) -> pa.Table:
        words, texts = _words(chunk)
        start, whole = words.grams(size)
        found, _ = _unpack(hits, np.uint64)
        gone = _covered(start[_is_in(whole >> np.uint64(1), found)], size, len(words.hash))
        n = np.diff(words.first)
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        kept = []
        for i, t in enumerate(texts):
            if not lost[i]:
                kept.append(b" ".join(t.split()))
            else:
                stay = np.flatnonzero(~gone[words.first[i] : words.first[i + 1]]) + words.first[i]
                kept.append(b" ".join([words.data[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
        return pa.table({"doc_id": chunk.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()), **finish(kept)})

    def finish(kept: list[bytes]) -> dict[str, pa.Array]:
        return {"kept": pa.array(kept, pa.binary())}

    return _steps(lay, probe, resolve, extend, count, cut, "doc_id long, n_words long, n_removed long, kept binary")


def _steps(lay: DataFrame, probe, resolve, extend, count, cut, result: str) -> DataFrame:
    probes = lay.select("chunk", "text").groupBy("chunk").applyInArrow(probe, PROBES)
    hits = probes.groupBy("bucket").applyInArrow(resolve, PROBES)
    windows = lay.select("chunk", "text").groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, PROBES)
    repeated = windows.groupBy("bucket").applyInArrow(count, PROBES)
    return lay.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(cut, result)


def kept_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
