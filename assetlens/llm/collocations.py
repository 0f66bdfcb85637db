"""Phrase collocations by hashed bucket counts and Apriori pruning.

Words are counted first. Each counting pass over the texts also counts the next longer runs of words into hash buckets:
a run whose bucket has fewer than LEAST occurrences can't be frequent. The next pass counts exactly, by text, only runs
whose bucket is full enough and whose two parts of one word less are frequent. Both tests are bitmaps of bounded size
that are broadcast; what they let through needlessly is counted all the same and dropped by its count, so results don't
depend on their size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, discard, encoded, store
from .runs import Runs, portions

#: Least count of a phrase, its most words, phrases reported of each language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: Score of a phrase whose parts occur nowhere else, twice.
SCALE = 2_000_000
#: A phrase goes if a longer one around it has this per cent of its count.
COVERED = 80
#: Kinds of bytes: of words, between words, between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: Bytes of text handled at once by a task.
PORTION = 4 << 20
#: Bytes of text per bucket, and the bounds of the number of buckets (32 MB of bits at most), as powers of two.
BYTES_PER_BUCKET, FEWEST, MOST = 32, 16, 28
#: Buckets of one row of bucket counts, as a power of two, and bucket numbers that a task gathers before it counts them.
CHUNK, GATHER = 16, 1 << 22
#: Parts of the rows that share a key in joins of phrases with the counts of their parts, and before the final ranks.
SALTS, RANKERS = 8, 64


def power(n: int) -> int:
    """The exponent of the power of two from n on, within the bounds of bitmaps."""
    return min(MOST, max(FEWEST, (max(1, n) - 1).bit_length()))


class Bits:
    """A bitmap over hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def packed(buckets: np.ndarray) -> list[tuple[int, bytes]]:
    """Chunk and counts of bucket numbers: places in the chunk (two bytes each), then counts (one byte each, at most 255)."""
    value, count = np.unique(buckets, return_counts=True)
    count = np.minimum(count, 255).astype(np.uint8)
    chunk = value >> np.uint32(CHUNK)
    cut = np.flatnonzero(np.diff(chunk)) + 1
    place = (value & np.uint32((1 << CHUNK) - 1)).astype("<u2")
    begins = np.concatenate([[0], cut]) if len(value) else []
    return [(int(chunk[b]), p.tobytes() + c.tobytes()) for b, p, c in zip(begins, np.split(place, cut), np.split(count, cut))]


SPOTTED = "lang string, phrase string, h long, n long, chunk int, packed binary"


def _spotted(**columns) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "phrase": pa.string(), "h": pa.int64(), "n": pa.int64(), "chunk": pa.int32(), "packed": pa.binary()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(size, t) for k, t in kinds.items()], list(kinds))


def spot(docs: DataFrame, n: int, buckets: int, frequent=None, full=None) -> DataFrame:
    """One pass over docs (lang, text): counts of runs of n words (lang, phrase, h, n), several rows for a run, and
    bucket counts of the runs of n + 1 words (chunk, packed), of those whose two parts of n words were counted.

    frequent, full: broadcast bitmaps of the frequent runs of n - 1 words and of the full buckets of n words.
    """

    def found(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        if n == 1:
            return np.arange(len(runs.hash)), runs.hash
        at, h = runs.grams(n)
        less, lower = (np.arange(len(runs.hash)), runs.hash) if n == 2 else runs.grams(n - 1)
        known = np.zeros(len(runs.hash) + 1, bool)
        known[less] = frequent.value.holds(lower)
        at, h = (x[known[at] & known[at + 1]] for x in (at, h))
        held = full.value.holds(h)
        return at[held], h[held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            rows = packed(np.concatenate(waiting)) if waiting else []
            return _spotted(chunk=pa.array([c for c, _ in rows], pa.int32()), packed=pa.array([p for _, p in rows], pa.binary()))

        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            label = np.array([number[x] for x in langs], np.int64)
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
            for which, texts in portions(encoded(batch.column(1).to_pylist()), BREAK, PORTION):
                runs = Runs(texts, KINDS, label[which], salt)
                at, h = found(runs)
                if n < LONGEST:
                    good = np.zeros(len(runs.hash) + 1, bool)
                    good[at] = True
                    longer, lh = runs.grams(n + 1)
                    waiting.append((lh[good[longer] & good[longer + 1]] & np.uint64(buckets - 1)).astype(np.uint32))
                    held += len(waiting[-1])
                if len(at):
                    at, h, count = runs.counted(at, h, n)
                    some = pa.array(names, pa.string()).take(pa.array(runs.label[at]))
                    yield _spotted(lang=some, phrase=runs.phrases(at, n), h=pa.array(h.view(np.int64)), n=pa.array(count))
                if held >= GATHER:
                    yield flush()
                    waiting, held = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, SPOTTED)


def full_buckets(spotted: DataFrame, buckets: int, least: int) -> np.ndarray:
    """The bitmap of buckets of at least so many occurrences: counts are added up chunk by chunk, and only bits (buckets / 8
    bytes, 32 MB at most) come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(data) // 3
                total = totals.setdefault(chunk, np.zeros(1 << CHUNK, np.uint16))
                at = np.frombuffer(data, "<u2", size)
                total[at] = np.minimum(total[at] + np.frombuffer(data, np.uint8, size, 2 * size), least)
        bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "bits"])

    if least > 255:
        raise ValueError("bucket counts of a task end at 255")
    out = np.zeros(buckets // 8, np.uint8)
    size = (1 << CHUNK) // 8
    for r in spotted.where("chunk IS NOT NULL").select("chunk", "packed").repartition("chunk").mapInArrow(add, "chunk int, bits binary").toLocalIterator():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def hashed_bits(counts: DataFrame) -> np.ndarray:
    """A bitmap of the hashes h, of 16 to 32 bits for each of them while that is under 32 MB."""
    size = 1 << power(16 * counts.count())
    at = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    out = np.zeros(size // 8, np.uint8)
    for r in counts.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator():
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)[: size // 8]
    return out


def frequent_runs(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """docs (lang, text) -> of 1 to `longest` words, written, all runs of at least `least` occurrences (lang, phrase, h, a), and the
    number of all words of each lang (lang, n)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1 << max(CHUNK, power(size // BYTES_PER_BUCKET))
    out: list[DataFrame] = []
    frequent = full = words = None
    for n in range(1, longest + 1):
        spotted = store(spot(docs, n, buckets, frequent, full), "spotted")
        total = spotted.where("chunk IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("a"), F.first("h").alias("h"))
        if n == 1:
            words = store(spotted.where("chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        out.append(store(total.where(F.col("a") >= least).select("lang", "phrase", "h", "a"), "runs"))
        for held in (frequent, full):
            if held is not None:
                held.destroy()
        if n < longest:
            frequent = spark.sparkContext.broadcast(Bits(hashed_bits(out[-1])))
            full = spark.sparkContext.broadcast(Bits(full_buckets(spotted, buckets, least)))
        discard(spotted)
    return out, words


def _part(words: Column, begin: int, end: int) -> Column:
    return F.array_join(F.slice(words, begin + 1, end - begin), " ")


def _covered(runs: list[DataFrame]) -> DataFrame:
    """lang, phrase, most: of every run of words inside a longer candidate, the greatest count of such a candidate."""
    inner = []
    for n, longer in enumerate(runs[2:], 3):
        words = F.split("phrase", " ")
        parts = F.array_distinct(F.array(*[_part(words, i, i + size) for size in range(2, n) for i in range(n - size + 1)]))
        inner.append(longer.select("lang", F.explode(parts).alias("phrase"), "a"))
    every = inner[0]
    for x in inner[1:]:
        every = every.union(x)
    return every.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def _with_count(rows: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    """rows with the count of the run in the column `part`. Rows of one part may be many: they are dealt to SALTS groups."""
    many = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("a").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    return rows.join(many, (F.col("lang") == F.col("_l")) & (F.col(part) == F.col("_p")) & (salt == F.col("_s"))).drop("_l", "_p", "_s")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Phrases are runs of two to four words of one piece, A-Z in lower case; a counts them, overlaps included; the score is
    that of the cut with the least of floor(SCALE * a / (l + r)), the first of equal ones; n counts all words of the
    language. Phrases inside a longer one of nearly their count are left out. A null language is `und`; null and empty
    texts have no words; repeated rows count again; an empty table gives no rows; a text of any length is counted whole
    (pieces of PORTION at a time). Ties in score and count go by the phrase's bytes. Other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs, words = frequent_runs(rows, least)
    every = runs[0].select("lang", "phrase", "a")
    phrases = None
    for longer in runs[1:]:
        some = longer.select("lang", "phrase", "a")
        every = every.union(some)
        phrases = some if phrases is None else phrases.union(some)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    inside = _covered(runs).withColumnsRenamed({"lang": "_l", "phrase": "_p"})
    kept = phrases.join(inside, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left").drop("_l", "_p")
    kept = kept.where("most IS NULL OR CAST(most AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * %d" % COVERED)
    at = F.split("phrase", " ")
    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(at) - 1)).alias("k"))
    cut = cut.withColumns({"first": F.array_join(F.slice(at, 1, F.col("k")), " "), "rest": F.array_join(F.slice(at, F.col("k") + 1, LONGEST), " ")})
    cut = _with_count(_with_count(cut, every, "first", "l"), every, "rest", "r")
    cut = cut.withColumn("both", exact("l") + exact("r")).withColumn("whole", exact("a") * F.lit(SCALE).cast("decimal(7,0)"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("whole div both").alias("score"), "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = best.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS)))
    few = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
