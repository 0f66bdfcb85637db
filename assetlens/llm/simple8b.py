"""Token ids as files of Simple-8b words, and reading them back.

File format: Parquet, one row per block of whole documents in ascending key order.

    shard        number of the key range the block belongs to
    block_start  ids of the shard before this block (a block is found without decoding those before it)
    doc_ids      keys of the block's documents
    doc_lens     ids of each of them, the end id included
    words        64-bit little-endian words: selector in the top 4 bits, then as many ids as the selector says
    escape_at, escape_value   ids of over 60 bits, which no selector holds: their places and values; 0 stands in words

Every block decodes alone, all words of one selector at once.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from .common import Words, arrow_batches, encoded, pieces

#: Fixed values of the coding: selector, ids per word, bits per id.
SELECTORS = ((2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60))
#: Ids in a block at least, but for the last of a shard.
BLOCK_IDS = 1 << 16
#: Words kept by a Python worker.
CACHE = 1_500_000
#: A byte between words that the tokenizer gets in one text, and how many those are.
MARK, TOGETHER = b"\x01", 256
#: Last bytes of words that surely end in a letter or digit: ASCII, and the letters of U+00C0 to U+00FF.
ALNUM = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: All ASCII punctuation.
MARKS = bytes(i for i in range(0x21, 0x7F) if i not in ALNUM)
ACCENTED = {chr(i).encode() for i in range(0xC0, 0x100) if chr(i).isalpha()}

BLOCKS = "shard int, block_start long, doc_ids array<long>, doc_lens array<int>, words binary, escape_at binary, escape_value binary"
_loaded: dict[str, WordIds] = {}


def encode(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """words, escape_at and escape_value of unsigned ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    far = np.flatnonzero(ids >> np.uint64(60))
    escapes = far.astype("<u4").tobytes(), ids[far].astype("<u8").tobytes()
    if len(far):
        ids = ids.copy()
        ids[far] = 0
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    # Rank of the narrowest selector that holds the id.
    widths = np.searchsorted(np.array([1 << bits for _, _, bits in SELECTORS], np.uint64), padded, side="right").astype(np.uint8)
    best = np.full(n, len(SELECTORS) - 1, np.uint8)
    for k in range(len(SELECTORS) - 2, -1, -1):
        count, wide = SELECTORS[k][1], widths > k
        if np.count_nonzero(wide[:n]) == n and k < len(SELECTORS) - 2:
            break  # no id is so narrow, so none is narrower
        over = np.concatenate([[0], np.cumsum(wide, dtype=np.int32)])
        best[over[count : count + n] == over[:n]] = k
    steps = np.array([c for _, c, _ in SELECTORS])[best].tolist()
    at, i = [], 0
    add = at.append
    while i < n:
        add(i)
        i += steps[i]
    at = np.array(at, np.int64)
    chosen = best[at]
    words = np.zeros(len(at), np.uint64)
    for k, (selector, count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == k)
        if len(own):
            w = np.full(len(own), selector << 60, np.uint64)
            for j in range(count):
                w |= padded[at[own] + j] << np.uint64(j * bits)
            words[own] = w
    return words.astype("<u8").tobytes(), *escapes


def decode(words: bytes, n: int, escape_at: bytes = b"", escape_value: bytes = b"") -> np.ndarray:
    """The n ids that encode() packed."""
    w = np.frombuffer(words, "<u8")
    selector = (w >> np.uint64(60)).astype(np.int64)
    held = np.zeros(16, np.int64)
    for s, count, _ in SELECTORS:
        held[s] = count
    counts = held[selector]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, count, bits in SELECTORS:
        own = np.flatnonzero(selector == s)
        if len(own):
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                out[start[own] + j] = (w[own] >> np.uint64(j * bits)) & mask
    out = out[:n]
    if escape_at:
        out[np.frombuffer(escape_at, "<u4")] = np.frombuffer(escape_value, "<u8")
    return out


#: How a tokenizer has to treat text, so that the words between white space can be encoded alone.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordIds:
    """Ids of words by word. Words of up to 16 bytes are kept in arrays: the bytes themselves, and where in `pool` their ids
    stand. `hash` is in order, `place` is where in the arrays its words are. A word is known only if its bytes agree."""

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        made = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in made["added_tokens"]]
        splits = made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        #: Whether words can be encoded alone; texts are encoded whole by any other tokenizer.
        self.by_word = made["normalizer"] == NORMALIZER and splits and made["post_processor"] is None and not any(t.split() != [t] or not t.startswith("<|") for t in added)
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        #: The id of the mark, if words can be parted by it.
        self.mark = mark[0] if self.by_word and len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.hash, self.place, self.low, self.high, self.size, self.begin, self.count = (np.zeros(0, k) for k in ("u8", "i8", "u8", "u8", "i8", "i8", "i8"))
        self.pool = np.zeros(0, "<u4")

    def find(self, words: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of these words in the arrays, and whether they are there."""
        h = words.hash[some]
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        near = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        at = self.place[near]
        same = (self.hash[near] == h) & (self.size[at] == words.end[some] - words.start[some])
        return at, same & (self.low[at] == words.eights(some, 0)) & (self.high[at] == words.eights(some, 8))

    def keep(self, words: Words, some: np.ndarray, ids: list[bytes]) -> None:
        """Add words that are not known, but for long ones and those whose hash is taken."""
        size = words.end[some] - words.start[some]
        at = np.minimum(np.searchsorted(self.hash, words.hash[some]), max(0, len(self.hash) - 1))
        free = size <= 16 if not len(self.hash) else (size <= 16) & (self.hash[at] != words.hash[some])
        mine = np.flatnonzero(free)
        some = some[mine]
        count = np.fromiter((len(ids[i]) // 4 for i in mine), np.int64, len(mine))
        begin = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids[i] for i in mine), "<u4")])
        new = words.eights(some, 0), words.eights(some, 8), size[mine], begin, count
        place = len(self.low) + np.arange(len(mine))
        self.low, self.high, self.size, self.begin, self.count = (np.concatenate(x) for x in zip((self.low, self.high, self.size, self.begin, self.count), new, strict=True))
        order = np.argsort(words.hash[some], kind="stable")
        h = words.hash[some][order]
        at = np.searchsorted(self.hash, h)
        self.hash, self.place = np.insert(self.hash, at, h), np.insert(self.place, at, place[order])

    def tokenized(self, parts: list[bytes]) -> list[bytes]:
        """Ids of words by the tokenizer: many in one text, parted by a mark that none of them has and that has one id."""
        out: list[bytes] = [b""] * len(parts)
        if self.mark is None:
            alone, joined = range(len(parts)), []
        else:
            alone, joined = [i for i, x in enumerate(parts) if MARK in x], [i for i, x in enumerate(parts) if MARK not in x]
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        found = self.tokenizer.encode_batch_fast([(b" " + MARK + b" ").join([parts[i] for i in g]).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            begin, data = 0, ids.tobytes()
            for i, end in zip(group, ends, strict=True):
                out[i] = data[4 * begin : 4 * end]
                begin = end + 1
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([parts[i].decode() for i in alone], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def encoded_alone(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different words: known ones, and by the tokenizer."""
        if not parts:
            return []
        words, every = Words([b" ".join(parts)]), np.arange(len(parts))
        at, known = self.find(words, every)
        begin, end = self.begin[at[known]], self.begin[at[known]] + self.count[at[known]]
        out: list[bytes] = [b""] * len(parts)
        for i, a, b in zip(every[known].tolist(), begin.tolist(), end.tolist(), strict=True):
            out[i] = self.pool[a:b].tobytes()
        new = every[~known]
        for i, ids in zip(new.tolist(), self.tokenized([parts[i] for i in new]), strict=True):
            out[i] = ids
        self.keep(words, new, [out[i] for i in new])
        return out

    def learn(self, some: list[bytes]) -> list[bytes]:
        """Ids of different words that are not known. Punctuation after a letter or digit is a piece of its own, so such
        words are put together from two."""
        alone: dict[bytes, int] = {}
        number = alone.setdefault
        made = []
        for w in some:
            core = w.rstrip(MARKS)
            if len(core) != len(w) and core and (core[-1] in ALNUM or core[-2:] in ACCENTED) and b"<|" not in w:
                made.append((number(core, len(alone)), number(w[len(core) :], len(alone))))
            else:
                made.append((number(w, len(alone)), -1))
        ids = [*self.encoded_alone(list(alone)), b""]
        return [ids[a] + ids[b] for a, b in made]

    def encode_texts(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id behind it, and how many each has."""
        if self.by_word:
            flat, lens = self.by_words(texts)
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            flat, lens = np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)
        out = np.full(len(flat) + len(texts), end, "<u4")
        mask = np.ones(len(out), bool)
        mask[np.cumsum(lens + 1) - 1] = False
        out[mask] = flat
        return out, lens + 1

    def by_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each different word is looked up once; equal hashes count as equal words only if the bytes agree."""
        # The tokenizer lowers case, which is done here where no special token can stand in the text.
        data = [d if b"<|" in d else d.lower() for d in encoded(texts)]
        words = Words(data)
        _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        if words.differ(np.arange(len(which)), first[which]).any():
            number: dict[bytes, int] = {}
            spelled = [words.data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
            which = np.array([number.setdefault(w, len(number)) for w in spelled])
            first = np.unique(which, return_index=True)[1]
        at, known = self.find(words, first)
        new = first[~known]
        ids = self.learn([words.data[a:b] for a, b in zip(words.start[new].tolist(), words.end[new].tolist(), strict=True)])
        sizes = np.zeros(len(first), np.int64)
        sizes[known] = self.count[at[known]]
        sizes[~known] = [len(x) // 4 for x in ids]
        begin = np.zeros(len(first), np.int64)
        begin[known] = self.begin[at[known]]
        begin[~known] = len(self.pool) + np.cumsum(sizes[~known]) - sizes[~known]
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        of_word = sizes[which]
        so_far = np.concatenate([[0], np.cumsum(of_word)])
        flat = pool[np.repeat(begin[which] - so_far[:-1], of_word) + np.arange(so_far[-1])]
        if len(self.hash) + len(new) > CACHE:  # only words met just now stay
            kept = [pool[a : a + n].tobytes() for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
            self.forget()
            self.keep(words, first, kept)
        else:
            self.keep(words, new, ids)
        return flat, np.diff(so_far[words.first])


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Tokenize whole texts and write their ids, in ascending key order, as blocks of the file format at `path`.

    A null or empty text has the end id only. Null keys come first; rows that repeat a key follow each other by text.
    An empty table writes an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = TaskContext.get().partitionId(), 0
        known = word_ids(tokenizer_path)
        keys, lens, parts, size = [], [], [], 0

        def block():
            ids = np.concatenate(parts)
            row = [[shard], [seen], [keys], [lens], *([x] for x in encode(ids))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        names = [c.split()[0] for c in BLOCKS.split(", ")]
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        rows = ((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for piece in pieces(rows, 1):
            ids, counts = known.encode_texts([t for _, t in piece], end_id)
            at = 0
            for (k, _), n in zip(piece, counts.tolist(), strict=True):
                keys.append(k)
                lens.append(n)
                parts.append(ids[at : at + n])
                at += n
                size += n
                if size >= BLOCK_IDS:
                    yield block()
                    seen += size
                    keys, lens, parts, size = [], [], [], 0
        if keys:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).repartitionByRange(n, "k").sortWithinPartitions("k", "t")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read files of the format: doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document.

    The crc32 is that of the document's ids as little-endian unsigned 32-bit integers.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lens = np.array(r["doc_lens"], np.int64)
                ids = decode(r["words"], int(lens.sum()), r["escape_at"], r["escape_value"]).astype("<u4")
                begin = np.cumsum(lens) - lens
                crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(begin.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(lens), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(begin + r["block_start"]), pa.array(lens), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    stored = spark.read.schema(BLOCKS).parquet(path)
    total = F.max(F.col("block_start") + F.aggregate("doc_lens", F.lit(0).cast("long"), lambda a, n: a + n))
    # One row per shard; their number is the number of partitions that wrote, whatever the number of documents.
    shards = stored.groupBy("shard").agg(total.alias("ids"))
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    found = stored.mapInArrow(documents, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(shards), "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """write_ids() to the shared folder, then read_ids() from there."""
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(docs.sparkSession, path)
