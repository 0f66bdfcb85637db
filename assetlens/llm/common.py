"""Shared pieces of the document operators: shared-folder scratch tables, Arrow batching, vectorised word hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.among import among  # noqa: F401
from ..functions.scratch import delete, scratch

#: ASCII white space, as the bytes that separate words.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Odd multipliers of the hashes below.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)
#: The low 0 to 8 bytes of a number.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes from which a word is hashed alone, by BLAKE2b.
LONG_WORD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The job under way, and paths of the tables that each job has stored.
_job = [""]
_made: dict[str, list[str]] = {}


@contextmanager
def job(docs: DataFrame, name: str) -> Iterator[None]:
    """Tables stored inside are this job's. Those of other jobs go first, as their results are written by now, unless docs
    reads one of them itself."""
    read = set(_roots(docs))
    for other in [j for j in _made if j != name]:
        if read.isdisjoint(p.split("/")[-1] for p in _made[other]):
            for path in _made.pop(other):
                delete(docs.sparkSession, path)
    _job[0] = name
    try:
        yield
    finally:
        _job[0] = ""


def _roots(df: DataFrame) -> list[str]:
    """Last parts of the paths of the file tables that df reads."""
    out, leaves = [], df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(i).getName() for i in range(paths.size())]
    return out


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from the files, whichever executor is lost."""
    path = scratch(df.sparkSession, name)
    if _job[0]:
        _made.setdefault(_job[0], []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what store() wrote for df, which nothing reads any more."""
    delete(df.sparkSession, df.stored_at)


def with_row_number(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written, with a number of each row, and that column's name, which docs doesn't have.

    Written first, so that a row keeps its number whatever is computed again.
    """
    row = free_name(docs, "row")
    return store(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound the Arrow batches that go to Python workers by rows and bytes, so that long texts can't fill one.

    These are settings of the session: queries that it plans later have the same bounds.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs: for either part given, different other parts give different hashes."""
    x = a * _A
    x += b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


class Words:
    """The words of some texts: hash, start and end byte in buf, text number; first[i] is the first word of text i.

    A word is hashed eight bytes at a time, each step a multiplication and a shift; a long one by BLAKE2b. So no
    pattern of repeated letters makes different words collide, as in hashes that are sums of powers.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join([*texts, b" " * 16])
        buf = np.frombuffer(self.data, np.uint8)
        if lower:
            buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
        self.buf = buf
        inside = (buf != 32) & ((buf < 9) | (buf > 13))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = self._hashes()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, begins)  # of every text, and the number of all words
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def eights(self, some: np.ndarray | slice, step: int) -> np.ndarray:
        """Bytes step to step + 7 of some of the words, as one number each; zeros beyond the end."""
        at = np.ndarray((max(0, len(self.buf) - 7),), "<u8", self.buf, strides=(1,))
        start = self.start[some]
        return at[start + step] & _MASK[np.clip(self.end[some] - start - step, 0, 8)]

    def _hashes(self) -> np.ndarray:
        size = self.end - self.start
        h = join(size.astype(np.uint64) * _C, self.eights(slice(None), 0))
        more, step = np.flatnonzero(size > 8), 8
        while len(more) and step < LONG_WORD:
            h[more] = join(h[more], self.eights(more, step))
            step += 8
            more = more[size[more] > step]
        for i in more.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return mix(h)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the words a and b (numbers of words of equal hash) are not equal byte by byte."""
        size = self.end[a] - self.start[a]
        out = size != self.end[b] - self.start[b]
        more, step = np.flatnonzero(~out), 0
        while len(more) and step < LONG_WORD:
            out[more] = self.eights(a[more], step) != self.eights(b[more], step)
            step += 8
            more = more[size[more] > step]
        for i in more.tolist():
            x, y = (self.buf[self.start[k[i]] : self.end[k[i]]] for k in (a, b))
            out[i] |= not np.array_equal(x, y)
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one text start, and the hashes of those n words: joined in halves."""
        count = len(self.hash)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: count - n + 1] == self.text[n - 1 :])
        runs = {1: self.hash}
        size = 1
        while 2 * size <= n:
            runs[2 * size] = join(runs[size][:-size], runs[size][size:])
            size *= 2
        out, have = runs[size], size
        while have < n:
            size = 1 << (n - have).bit_length() - 1
            out, have = join(out[: len(out) - size], runs[size][have:]), have + size
        return at, mix(out[at])


def encoded(texts: list[str | None]) -> list[bytes]:
    return [t.encode() if t else b"" for t in texts]


def pieces(rows: Iterator[tuple], text_at: int, most: int = 2 << 20) -> Iterator[list[tuple]]:
    """Lists of rows whose texts have about `most` bytes together; a longer text stands alone."""
    out, size = [], 0
    for row in rows:
        n = len(row[text_at] or "")
        if out and size + n > most:
            yield out
            out, size = [], 0
        out.append(row)
        size += n
    if out:
        yield out
