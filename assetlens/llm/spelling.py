"""Spelling variants: words one letter apart, found by walking tries with a Levenshtein automaton.

The sorted words are cut into shards of bounded size, each a compact trie of arrays. Groups of shards of bounded size
are broadcast one after the other; every word's automaton of distance one is walked through each of them depth-first,
many words at a time: at each depth of the words' own paths the edits possible there are followed to their ends before
the paths go deeper. A task reduces what it finds to a count and a best form of each word and group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, discard, store
from .runs import Runs, portions

#: Least letters and occurrences of a word, and how many times as frequent its form must be.
LETTERS, LEAST, TIMES = 7, 2, 10
#: Of the runs, one in so many (by hash) loses a letter.
DAMAGE = 31
#: Kinds of Latin-1 bytes: letters, all others.
KINDS = np.full(256, 2, np.uint8)
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = 0
OTHER = re.compile(rb"[^A-Za-z\xc0-\xff]")
PORTION = 4 << 20
#: Words of a shard at most, bytes of the shards that are broadcast together, words walked at a time, words of a task.
SHARD, GROUP, BLOCK, TASK = 50_000, 24 << 20, 8192, 1 << 15
#: Bytes from which the hash of a run is taken by the library.
LONG = 64

#: The table of CRC-32, by its rule.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def _fed(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & 0xFF] ^ state >> np.uint32(8)


def crcs(runs: Runs, at: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The CRC-32 of the UTF-8 bytes of the words at `at`, continued from the CRC-32 in states."""
    size = runs.end[at] - runs.start[at]
    out = states ^ np.uint32(0xFFFFFFFF)
    going, step = np.flatnonzero(size <= LONG), 0
    while len(going):
        going = going[size[going] > step]
        byte = runs.buf[runs.start[at[going]] + step].astype(np.uint32)
        state, two = out[going], byte >= 0xC0  # two bytes in UTF-8
        state[two] = _fed(state[two], 0xC3)
        out[going] = _fed(state, byte - two * np.uint32(0x40))
        step += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        word = runs.buf[runs.start[at[i]] : runs.end[at[i]]].tobytes().decode("latin-1")
        out[i] = zlib.crc32(word.encode(), int(states[i]))
    return out


def _latin(runs: Runs, at: np.ndarray) -> list[str]:
    """The words at `at`."""
    size = runs.end[at] - runs.start[at] + 1  # with the space behind each
    end = np.cumsum(size)
    data = runs.buf[np.repeat(runs.start[at] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
    return data.tobytes().decode("latin-1").split(" ")[:-1]


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n: the words of whole texts with damage, of LETTERS letters and LEAST occurrences or more.

    A run's damage is told by the hash of its row's key (a null key is the empty text) and the run, so equal runs of a
    row have the same. Null and empty texts have no words; a text of any length is read whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = np.array([zlib.crc32(f"{k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
            latin = [(t or "").encode("latin-1", "replace") for t in batch.column(1).to_pylist()]
            for which, texts in portions(latin, OTHER, PORTION):
                runs = Runs(texts, KINDS)
                at = np.flatnonzero(runs.end - runs.start >= LETTERS)
                h = crcs(runs, at, prefix[np.array(which)[runs.owner[at]]])
                hit = h % np.uint32(DAMAGE) == 0
                whole, _, n = runs.counted(at[~hit], runs.hash[at[~hit]], 1)
                cut = Counter()
                for w, x in zip(_latin(runs, at[hit]), h[hit].tolist()):
                    if len(w) > LETTERS:
                        k = x % len(w)
                        cut[w[:k] + w[k + 1 :]] += 1
                yield pa.RecordBatch.from_arrays([pa.array([*_latin(runs, whole), *cut], pa.string()), pa.array([*n.tolist(), *cut.values()], pa.int64())], ["word", "n"])

    arrow_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def codes(letters: np.ndarray) -> np.ndarray:
    """Latin-1 letters as numbers below 90, in order."""
    return np.where(letters < 0x80, letters - np.uint8(0x61), letters - np.uint8(0xC0 - 26)).astype(np.uint8)


class Packed:
    """Words one after the other: the codes of their letters, and where each begins."""

    def __init__(self, latin: list[bytes]):
        self.code = codes(np.frombuffer(b"".join(latin), np.uint8))
        self.size = np.fromiter(map(len, latin), np.int64, len(latin))
        self.begin = np.cumsum(self.size) - self.size


class Trie:
    """A shard of sorted words, with counts, as arrays over the nodes in breadth-first order: the children of a node stand
    together, and a bitmap of 90 letters with the number of bits before it tells where a child is."""

    def __init__(self, shard: list[str], n: list[int]):
        self.words, self.n = shard, np.array(n, np.int64)
        packed = Packed([w.encode("latin-1") for w in shard])
        node = np.zeros(len(shard), np.int64)
        alive, depth, total = np.arange(len(shard)), 0, 1
        letters, parents = [np.zeros(1, np.uint8)], [np.full(1, -1)]
        while len(alive := alive[packed.size[alive] > depth]):
            letter = packed.code[packed.begin[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (node[alive][1:] != node[alive][:-1]) | (letter[1:] != letter[:-1])
            letters.append(letter[new])
            parents.append(node[alive][new])
            node[alive] = total + np.cumsum(new) - 1
            total += int(new.sum())
            depth += 1
        self.letter, parent = np.concatenate(letters), np.concatenate(parents)[1:]
        children = np.bincount(parent, minlength=total)
        self.first = np.concatenate([[1], 1 + np.cumsum(children)]).astype(np.int32)
        bit = np.left_shift(np.uint64(1), (self.letter[1:] & np.uint8(63)).astype(np.uint64))
        self.bits = np.zeros((2, total), np.uint64)
        np.bitwise_or.at(self.bits, ((self.letter[1:] >> np.uint8(6)).astype(np.int64), parent), bit)
        self.ends = np.full(total, -1, np.int32)  # the word that ends at a node
        self.ends[node] = np.arange(len(shard))

    def child(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child of that letter, and those children."""
        high = letter > 63
        low, own = self.bits[0][node], self.bits[1][node]
        own = np.where(high, own, low)
        bit = np.left_shift(np.uint64(1), (letter & np.uint8(63)).astype(np.uint64))
        has = np.flatnonzero(own & bit)
        before = np.bitwise_count(own[has] & (bit[has] - np.uint64(1))) + np.where(high[has], np.bitwise_count(low[has]), 0)
        return has, self.first[node[has]] + before

    def near(self, of: Packed) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number in `of`, number in the shard) of words one edit apart, each once."""
        found = []

        def follow(q: np.ndarray, node: np.ndarray, i: np.ndarray) -> None:
            """After the edit: the rest of the word as it is."""
            while len(q):
                done = i == of.size[q]
                ends = self.ends[node[done]]
                found.append(q[done][ends >= 0] * len(self.words) + ends[ends >= 0])
                q, node, i = q[~done], node[~done], i[~done]
                has, node = self.child(node, of.code[of.begin[q] + i])
                q, i = q[has], i[has] + 1

        q, node, depth = np.arange(len(of.size)), np.zeros(len(of.size), np.int64), 0
        while len(q):
            below = self.first[node + 1] - self.first[node]
            each = np.repeat(np.arange(len(q)), below)
            kids = self.first[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(below) - below, below)
            follow(q[each], kids, np.full(len(each), depth))  # a letter more
            more = of.size[q] > depth
            q, node, each = q[more], node[more], np.flatnonzero(more[each])
            # Of words that end here only the letter more was possible.
            letter = of.code[of.begin[q] + depth]
            follow(q, node, np.full(len(q), depth + 1))  # a letter less
            owner = (np.cumsum(more) - 1)[np.repeat(np.arange(len(more)), below)[each]]
            other = self.letter[kids[each]] != letter[owner]
            follow(q[owner[other]], kids[each][other], np.full(int(other.sum()), depth + 1))  # another letter
            has, node = self.child(node, letter)
            q, depth = q[has], depth + 1
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.divmod(pairs, max(1, len(self.words)))


def shards(sorted_words: DataFrame) -> DataFrame:
    """words, n: lists of at most SHARD words in order, from the partitions of word, n."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([have[:SHARD]], pa.list_(pa.string())), pa.array([n[:SHARD]], pa.list_(pa.int64()))], ["words", "n"])

        for b in batches:
            have, n = have + b.column(0).to_pylist(), n + b.column(1).to_pylist()
            while len(have) >= SHARD:
                yield out()
                have, n = have[SHARD:], n[SHARD:]
        if have:
            yield out()

    return sorted_words.mapInArrow(cut, "words array<string>, n array<long>")


def groups(lists: DataFrame, most: int) -> Iterator[list[Trie]]:
    """Tries, of about `most` bytes together, one group after the other."""
    out, size = [], 0
    for r in lists.toLocalIterator():
        out.append(Trie(r.words, r.n))
        size += out[-1].letter.nbytes + out[-1].first.nbytes + out[-1].bits.nbytes + out[-1].ends.nbytes
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _walk(held):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def found(some: list[str]) -> pa.RecordBatch:
            some.sort()  # neighbours share their way through a trie
            of = Packed([w.encode("latin-1") for w in some])
            count = np.zeros(len(some), np.int64)
            best = np.zeros(len(some), np.int64)
            form: list[str | None] = [None] * len(some)
            for trie in held.value:
                q, w = trie.near(of)
                count += np.bincount(q, minlength=len(some))
                n = trie.n[w]
                order = np.lexsort((w, -n, q))  # the shard's words are sorted, so the first of equal counts is the smallest
                q, w, n = q[order], w[order], n[order]
                top = np.flatnonzero(np.diff(q, prepend=-1))
                for k, x, c in zip(q[top].tolist(), w[top].tolist(), n[top].tolist()):
                    if c > best[k] or c == best[k] and trie.words[x] < form[k]:
                        best[k], form[k] = c, trie.words[x]
            at = np.flatnonzero(count)
            columns = [pa.array([some[i] for i in at], pa.string()), pa.array(count[at]), pa.array([form[i] for i in at], pa.string()), pa.array(best[at])]
            return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near", "near_n"])

        for b in batches:
            waiting += b.column(0).to_pylist()
            while len(waiting) >= BLOCK:
                yield found(waiting[:BLOCK])
                waiting = waiting[BLOCK:]
        if waiting:
            yield found(waiting)

    return walk


def neighbours(counted: DataFrame) -> DataFrame:
    """counted (word, n; written, each word once) -> word, n_near, near, near_n of words that have a word one letter apart:
    how many, and the one of the greatest count (of equal ones the smallest) with its count."""
    spark = counted.sparkSession
    total = counted.count()
    ordered = counted.repartitionByRange(max(1, -(-total // SHARD)), "word").sortWithinPartitions("word")
    lists = store(shards(ordered), "shards")
    asked = counted.select("word").repartition(max(spark.sparkContext.defaultParallelism, -(-total // TASK)), "word")
    out = None
    for group in groups(lists, GROUP):
        held = spark.sparkContext.broadcast(group)
        part = store(asked.mapInArrow(_walk(held), "word string, n_near long, near string, near_n long"), "near")
        held.destroy()
        out = part if out is None else out.union(part)
    discard(lists)
    if out is None:
        return spark.createDataFrame([], "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", (-F.col("b.less")).alias("near_n"))


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see words): its near words are one letter inserted, deleted or
    replaced away; the form is the most frequent of them (of equal ones the first in code point order) if it is TIMES as
    frequent, else null; the root is where forms lead in the end.

    Counts grow TIMES along forms, so there is no circle and a way of 19 steps at most: doubling finds its end in five
    joins of the words that have a form. Rows that repeat a key count again; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    counted = store(words(docs, text, key), "words")
    joined = counted.join(neighbours(counted), "word", "left")
    has = F.col("near_n") >= TIMES * F.col("n")
    all_ = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    all_ = store(all_, "forms")
    roots = all_.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = all_.agg(F.max("n")).first()[0] or 1
    for _ in range((len(str(most)) - 1).bit_length()):
        further = roots.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        roots = store(roots.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root")), "roots")
    return all_.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
