"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word n-grams. Its sketch has one lane for each of `lanes` parts of the hash space; a
lane is the exclusive or of the hashes that fall into it, so two sketches differ in at most as many lanes as the sets
differ in elements. A set differs from those that it links to in at most D elements, D following from its size; so of
more than D lanes in use, one at least is equal (pigeonhole). The number of lanes is that of a size band. Equal lanes
meet in a bucket and give candidate pairs; a bit-wise parity sketch, whose Hamming distance bounds the symmetric
difference from below too, drops most wrong pairs; the rest are verified on the sets themselves.

Documents with the same set are one class, so copies never meet as pairs. A lane that many classes share gives no
pairs. Two classes that link and meet in no other lane have at least `spare` lanes of that kind; the classes with so
many are the crowd. For them there is an exact way beside the lanes: elements in order of how many crowd classes
have them, rarest first. Sets that link share one of their first few (prefix filter), and how far down it stands in
both bounds what they share (positional filter). Each such element hangs its classes on the one where it stands
highest; only classes that are then in different components, and that sizes and places allow to link, meet as pairs.
That gives the components. Links lie inside components only, so those with crowd classes have their links counted
block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, arrow_batches, discard, encoded, mix, pieces, store, with_row_number
from .components import components

#: Classes of a lane up to which all of its pairs are candidates at once.
ALL_PAIRS = 8
#: Lanes for each hundred elements of a band's smallest set.
LANES = 60
#: Keys of a bucket, about; the number of buckets follows from the size of the input.
BUCKET_KEYS = 400_000
#: Keys that a task holds until it deals them into buckets.
HELD_KEYS = 2_000_000
#: Elements of a chunk of crowd sets, about.
CHUNK = 400_000
#: Classes and hashes of a block, about, in which the links of a component are counted.
BLOCK, BLOCK_HASHES = 2048, 500_000
#: Fewest and most bits of a parity sketch.
SKETCH_BITS = 512, 32768
BINARY = pa.binary()


@lru_cache(maxsize=None)
def bands(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(first size, last size, D, lanes) of each size band up to size `most`.

    Sets of sizes a <= b link only if 100 * a >= percent * b, and differ then in at most (a + b)(100 - p)/(100 + p).
    A pair belongs to the band of its smaller set.
    """
    out, low = [], 1
    while low <= most:
        high = max(low, low * 3 // 2 - 1)
        partner = high * 100 // percent
        d = (high + partner) * (100 - percent) // (100 + percent)
        out.append((low, high, d, max(d + 1, -(-low * LANES // 100))))
        low = high + 1
    return out


def roles(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, D, lanes) in which a set of this size looks for partners: its own band, as the smaller set (or an equal
    one), and the lower bands that may hold its smaller partner. D is how many elements it may differ in from those."""
    table = bands(percent, 1 << max(10, int(size).bit_length() + 1))
    out = []
    for k in range(len(table) - 1, -1, -1):
        low, high, _, lanes = table[k]
        if low <= size and 100 * high >= percent * size:
            partner = size * 100 // percent if size <= high else high
            out.append((k, (size + partner) * (100 - percent) // (100 + percent), lanes))
        elif low <= size:
            break
    return out


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a text of fewer words has one, of all of them."""
    words = Words(encoded(texts), lower=True)
    at, grams = words.grams(n)
    cut = np.searchsorted(at, words.first)
    for i in range(len(texts)):
        first, last = words.first[i], words.first[i + 1]
        if last - first >= n:
            yield np.unique(grams[cut[i] : cut[i + 1]])
        elif last > first:
            yield mix(np.array([int.from_bytes(hashlib.blake2b(words.hash[first:last].tobytes(), digest_size=8).digest(), "little")], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_class(h: np.ndarray) -> int:
    """A number that only equal sets share."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def lane_keys(h: np.ndarray, band: int, d: int, lanes: int) -> np.ndarray:
    """Keys of the lanes in use; of the empty ones too, if those in use are too few for the pigeonhole."""
    lane = ((h >> np.uint64(33)) % np.uint64(lanes)).astype(np.int64)
    order = np.argsort(lane, kind="stable")
    lane = lane[order]
    begin = np.flatnonzero(np.diff(lane, prepend=-1))
    used, value = lane[begin], np.bitwise_xor.reduceat(h[order], begin)
    if len(used) <= d:
        value = np.concatenate([value, np.zeros(lanes - len(used), np.uint64)])
        used = np.concatenate([used, np.setdiff1d(np.arange(lanes), used)])
    return mix(value ^ mix(used.astype(np.uint64) + np.uint64((band + 1) << 40)))


def overlap(a, b, percent: int):
    """Elements that sets of sizes a and b have in common at least, if they link."""
    return -(-percent * (a + b) // (100 + percent))


class Keys:
    """Lane keys of a task's classes, held until they are dealt into buckets."""

    def __init__(self, n_buckets: int, percent: int):
        self.n_buckets, self.percent = n_buckets, percent
        self.clear()

    def clear(self) -> None:
        self.seen, self.size = set(), 0
        self.of: list[tuple[int, int, int]] = []  # class, band, D
        self.parts: list[np.ndarray] = []

    def add(self, cls: int, h: np.ndarray) -> None:
        if len(h) <= 3 or cls in self.seen:  # such small sets link only if they are equal
            return
        self.seen.add(cls)
        for band, d, lanes in roles(len(h), self.percent):
            k = lane_keys(h, band, d, lanes)
            bucket = (k >> np.uint64(32)) % np.uint64(self.n_buckets)
            self.parts.append(bucket << np.uint64(32) | (k & np.uint64(0xFFFFFF)) << np.uint64(8) | np.uint64(band & 0xFF))
            self.of.append((cls, band, d))
            self.size += len(k)

    def deal(self) -> tuple[list, list]:
        """Rows (bucket, lane_keys, classes), and rows (class, band, spare, n_large) of all classes; then none is held.

        A class has `spare` lanes in common at least with each one that it links to: its different keys less D. Of a
        key that more than ALL_PAIRS + 1 classes of this task have, so many go to the bucket; the others are counted.
        """
        if not self.parts:
            return [], []
        key = np.concatenate(self.parts)
        owner = np.repeat(np.arange(len(self.of)), [len(x) for x in self.parts])
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        begin = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        more = nth > ALL_PAIRS
        distinct, large = (np.bincount(x, minlength=len(self.of)).tolist() for x in (owner, owner[more]))
        counts = [(c, band, max(1, n - d), m) for (c, band, d), n, m in zip(self.of, distinct, large, strict=True)]
        key, owner = key[~more], owner[~more]
        bucket, classes = key >> np.uint64(32), np.array([c for c, _, _ in self.of], np.int64)[owner]
        low = key.astype("<u4")
        begin = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
        ends = [*begin[1:].tolist(), len(bucket)]
        rows = [(n, low[a:b].tobytes(), classes[a:b].tobytes()) for n, a, b in zip(bucket[begin].tolist(), begin.tolist(), ends, strict=True)]
        self.clear()
        return rows, counts


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the set in as many bits as it has elements (the next power of two, within SKETCH_BITS)."""
    bits = min(max(1 << (len(h) - 1).bit_length() if len(h) else 0, SKETCH_BITS[0]), SKETCH_BITS[1])
    parity = (np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


#: What the first pass writes: rows of documents, of dealt keys, and of counted lanes.
FIRST = "doc_id long, n_shingles long, cls long, sketch array<long>, bucket int, lane_keys binary, classes binary, band int, spare int, n_large int"


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_copies (documents of the same set), n_links (all other classes it links
    to; left out unless count_links) and component_id, the smallest doc_id that links reach, itself included.

    Two documents link when 100 * intersection >= percent * union of their sets. Documents without words, or with a
    null text, have an empty set and link with nothing. Rows that repeat a key are members like any other. A null key
    is never the smallest; a row of null key alone in its group has a null component_id. Empty tables and columns of
    other names are fine.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    stored: list[DataFrame] = []

    def keep(df: DataFrame, name: str | None = None) -> DataFrame:
        """df, written (but if that is done), until the result is."""
        stored.append(store(df, name) if name else df)
        return stored[-1]

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, int(total / 6 * 0.45 / BUCKET_KEYS))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FIRST.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), BINARY, BINARY, pa.int32(), pa.int32(), pa.int32()]

        def out(n: int, **columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

        def dealt() -> Iterator[pa.RecordBatch]:
            keyed, counts = keys.deal()
            if keyed:
                bucket, lanes, classes = zip(*keyed, strict=True)
                yield out(len(bucket), bucket=bucket, lane_keys=lanes, classes=classes)
                cls, band, spare, large = zip(*counts, strict=True)
                yield out(len(cls), cls=cls, band=band, spare=spare, n_large=large)

        keys = Keys(n_buckets, percent)
        for piece in pieces((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), 1):
            sets = list(shingle_sets([t for _, t in piece], n))
            cls = [set_class(h) if len(h) else None for h in sets]
            yield out(len(piece), doc_id=[k for k, _ in piece], n_shingles=[len(h) for h in sets], cls=cls, sketch=[parity_sketch(h).tolist() for h in sets])
            for c, h in zip(cls, sets, strict=True):
                keys.add(c, h)
            if keys.size > HELD_KEYS:
                yield from dealt()
        yield from dealt()

    def meet(bucket: pa.Table) -> pa.Table:
        """Candidate pairs of a bucket (u, v), and for each class (u) how many of its lanes of a band many classes share."""
        k = np.frombuffer(b"".join(bucket.column("lane_keys").to_pylist()), "<u4")
        c = np.frombuffer(b"".join(bucket.column("classes").to_pylist()), np.int64)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[new], c[new]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(k)))
        few = (size > 1) & (size <= ALL_PAIRS)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(1, ALL_PAIRS):  # all pairs at distance j in groups of few
            m = np.where(few, np.maximum(size - j, 0), 0)
            some = np.repeat(begin - np.cumsum(m) + m, m) + np.arange(m.sum())
            us.append(c[some])
            vs.append(c[some + j])
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
        many = np.repeat(size > ALL_PAIRS, size)
        large, times = np.unique(np.stack([c[many], (k[many] & 0xFF).astype(np.int64)]), axis=1, return_counts=True)
        nothing = [None] * pairs.shape[1]
        return pa.table(
            {
                "u": pa.array(np.concatenate([pairs[0], large[0]]), pa.int64()),
                "v": pa.array([*pairs[1].tolist(), *[None] * len(times)], pa.int64()),
                "band": pa.array([*nothing, *large[1].tolist()], pa.int32()),
                "n_large": pa.array([*nothing, *times.tolist()], pa.int32()),
            }
        )

    first = keep(rows.mapInArrow(describe, FIRST), "sets")
    described = first.where("bucket IS NULL AND band IS NULL").select("doc_id", "n_shingles", "cls", "sketch")
    keyed = first.where("bucket IS NOT NULL").select("bucket", "lane_keys", "classes")
    met = keep(keyed.groupBy("bucket").applyInArrow(meet, "u long, v long, band int, n_large int"), "met")
    reps = described.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    reps = keep(reps, "classes")

    lanes = first.where("band IS NOT NULL").select("cls", "band", "spare", "n_large")
    lanes = lanes.union(met.where("v IS NULL").select("u", "band", F.lit(None).cast("int"), "n_large"))
    lanes = lanes.groupBy("cls", "band").agg(F.min("spare").alias("spare"), F.sum("n_large").alias("n_large"))
    crowd = keep(lanes.where("n_large >= spare").select("cls").distinct().join(reps.select("cls", "size"), "cls"), "crowd")
    near = keep(_near(met.where("v IS NOT NULL").select("u", "v").distinct(), reps, percent), "near-pairs")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(((t,) for b in batches for t in b.column(0).to_pylist()), 0):
            sets = [h for h in shingle_sets([t for (t,) in piece], n) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([set_class(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], BINARY)], ["cls", "hashes"])

    # Contents of the classes that may link, from the text of the least document of each.
    wanted = near.select(F.col("u").alias("cls")).union(near.select("v")).union(crowd.select("cls")).distinct()
    holders = reps.join(wanted, "cls", "left_semi").select(F.col("rep").alias("doc_id"))
    held = rows.join(holders, rows.doc_id.eqNullSafe(holders.doc_id), "left_semi").select("text")
    sets = held.mapInArrow(contents, "cls long, hashes binary")
    sets = keep(sets, "contents")  # twice, or with others, where rows repeat a key

    some = not crowd.isEmpty()
    if some:
        prefix = keep(_prefixes(crowd, sets, percent))
        pivot = prefix.groupBy("e").agg(F.min(F.struct("at", "cls", "size")).alias("p"), F.count("*").alias("n")).where("n > 1").select("e", "p")
        stars = prefix.join(pivot, "e").where("cls <> p.cls AND " + _allowed("size", "at", "p.size", "p.at", percent))
        stars = stars.select(F.least("cls", "p.cls").alias("u"), F.greatest("cls", "p.cls").alias("v")).distinct()
        near = near.union(_near(stars, reps, percent)).distinct()
    found = keep(_verify(near, sets, percent), "links")
    group = keep(components(found))
    if some:
        placed = keep(_placed(prefix, group), "placed")
        more = _apart(placed, percent)
        more = keep(_verify(_near(more, reps, percent), sets, percent), "links")
        if not more.isEmpty():
            found = found.union(more)
            group = keep(components(found))
    group = group.select(F.col("node").alias("cls"), "component")
    of_component = reps.select("cls", "rep").join(group, "cls")
    least = of_component.groupBy("component").agg(F.min("rep").alias("least"))
    named = reps.join(of_component.join(least, "component").select("cls", "least"), "cls", "left")
    named = named.select("cls", "n_copies", F.coalesce("least", "rep").alias("component_id"))
    columns = ["doc_id", "n_shingles", "n_copies", "component_id"]
    if count_links:
        degree = found.union(found.select("v", "u")).groupBy(F.col("u").alias("cls")).agg(F.count("*").alias("n_links"))
        if some:
            of = group.join(crowd.select("cls"), "cls").groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
            crowded = keep(group.join(of, "component", "left_semi"), "crowded")
            degree = degree.join(crowded, "cls", "left_anti").union(_count_links(crowded.join(reps.select("cls", "size"), "cls"), sets, percent))
        named = named.join(degree, "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
        columns.insert(3, "n_links")
    alone = described.where("cls IS NULL").withColumns({"n_copies": F.lit(1).cast("long"), "n_links": F.lit(0).cast("long"), "component_id": F.col("doc_id")})
    out = store(described.join(named, "cls").select(columns).union(alone.select(columns)), "groups")
    for df in stored:
        discard(df)
    return out


def _allowed(a: str, at: str, b: str, bt: str, percent: int) -> str:
    """SQL: sets of sizes a and b may link that have nothing in common before places `at` and `bt`."""
    both = f"ceil({percent} * ({a} + {b}) / {100 + percent})"
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b}) AND least({a} - {at}, {b} - {bt}) >= {both}"


def _prefixes(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """crowd (cls, size), sets (cls, hashes) -> e, cls, size, at: the elements of each class, rarest first, of which any
    class that it links to has one; `at` is the element's place in that order. Those of one class alone are left out.

    Chunks of classes and buckets of elements exchange one entry per chunk and element, however common that is.
    """
    total = crowd.agg(F.sum("size")).first()[0] or 0
    n_chunks = max(4, int(total / CHUNK))
    laid = sets.join(crowd.select("cls"), "cls", "left_semi").select(F.pmod(F.xxhash64("cls"), F.lit(n_chunks)).cast("int").alias("chunk"), "cls", "hashes")
    laid = store(laid, "chunks")

    def elements(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, np.uint64) for x in chunk.column("hashes").to_pylist()]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def tally(chunk: pa.Table) -> pa.Table:
        e, n = np.unique(elements(chunk)[0], return_counts=True)
        bucket = (e >> np.uint64(34)) % np.uint64(n_chunks)
        order = np.argsort(bucket, kind="stable")
        e, n, bucket = e[order], n[order].astype("<u4"), bucket[order].astype(np.int64)
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*begin[1:].tolist(), len(e)]
        number = chunk.column("chunk")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(bucket[begin], pa.int32()),
                "chunk": pa.array([number] * len(begin), pa.int32()),
                "e": pa.array([e[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], BINARY),
                "n": pa.array([n[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], BINARY),
            }
        )

    def add_up(bucket: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in bucket.column("e").to_pylist()]
        every, which = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(which, np.frombuffer(b"".join(bucket.column("n").to_pylist()), "<u4")).astype("<u8")
        e, times, at = [], [], 0
        for part in parts:
            own = n[which[at : at + len(part)]]
            at += len(part)
            e.append(part[own > 1].tobytes())
            times.append(own[own > 1].tobytes())
        return pa.table({"chunk": bucket.column("chunk"), "e": pa.array(e, BINARY), "n": pa.array(times, BINARY)})

    def first_few(chunk: pa.Table, shared: pa.Table) -> pa.Table:
        if not chunk.num_rows or not shared.num_rows:
            return pa.table({"e": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "size": pa.array([], pa.int32()), "at": pa.array([], pa.int32())})
        e, sizes = elements(chunk)
        known = np.frombuffer(b"".join(shared.column("e").to_pylist()), np.uint64)
        times = np.frombuffer(b"".join(shared.column("n").to_pylist()), "<u8")
        order = np.argsort(known)
        known, times = known[order], times[order]
        found = np.minimum(np.searchsorted(known, e), len(known) - 1)
        n = np.where(known[found] == e, times[found], np.uint64(1))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((e, n, owner))
        e, n = e[order], n[order]
        at = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = sizes - overlap(sizes, -(-percent * sizes // 100), percent)
        keep = np.flatnonzero((n > 1) & (at <= last[owner]))
        cls = np.array(chunk.column("cls").to_pylist(), np.int64)
        return pa.table({"e": pa.array(e[keep].view(np.int64)), "cls": pa.array(cls[owner[keep]]), "size": pa.array(sizes[owner[keep]], pa.int32()), "at": pa.array(at[keep], pa.int32())})

    tallies = laid.groupBy("chunk").applyInArrow(tally, "bucket int, chunk int, e binary, n binary")
    shared = tallies.groupBy("bucket").applyInArrow(add_up, "chunk int, e binary, n binary")
    out = store(laid.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(first_few, "e long, cls long, size int, at int"), "prefixes")
    discard(laid)
    return out


def _placed(prefix: DataFrame, group: DataFrame) -> DataFrame:
    """prefix with the component of each class."""
    where = prefix.join(group, F.col("cls") == F.col("node"), "left")
    return where.select("e", "cls", "size", "at", F.coalesce("component", "cls").alias("component"))


def _apart(where: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that share an element of prefix, may link, and are in different components.

    Of an element's classes, those of its most frequent component meet only the others.
    """
    counts = where.groupBy("e", "component").agg(F.count("*").alias("n")).groupBy("e").agg(F.count("*").alias("k"), F.max_by("component", "n").alias("most"))
    left = where.join(counts.where("k > 1"), "e")
    one, other = left.where("component <> most").alias("a"), left.alias("b")
    apart = F.expr("a.e = b.e AND a.component <> b.component AND (a.cls < b.cls OR b.component = b.most) AND " + _allowed("a.size", "a.at", "b.size", "b.at", percent))
    return one.join(other, apart).select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v")).distinct()


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sizes and parity sketches allow to link."""
    a = classes.select(F.col("cls").alias("u"), F.col("size").alias("nu"), F.col("sketch").alias("su"))
    b = classes.select(F.col("cls").alias("v"), F.col("size").alias("nv"), F.col("sketch").alias("sv"))
    near = pairs.join(a, "u").join(b, "v").where(F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"))
    # Linked sets differ in size by less than two, so in sketch by one halving at most: the longer is folded.
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2 + 1).cast("int"), F.size(c)), lambda x, y: x.bitwiseXOR(y))
    fold = lambda c, other: F.when(F.size(c) > F.size(other), half(F.col(c))).otherwise(F.col(c))
    near = near.withColumn("fu", fold("su", "sv")).withColumn("fv", fold("sv", "su"))
    distance = F.aggregate(F.zip_with("fu", "fv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return near.where(distance * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent)).select("u", "v")


def _verify(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose contents link."""
    full = near.join(sets.select(F.col("cls").alias("u"), F.col("hashes").alias("hu")), "u")
    full = full.join(sets.select(F.col("cls").alias("v"), F.col("hashes").alias("hv")), "v").select("u", "v", "hu", "hv")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["hu"], np.uint64), np.frombuffer(r["hv"], np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    u.append(r["u"])
                    v.append(r["v"])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return full.mapInArrow(check, "u long, v long").distinct()


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets on the right (columns) each one on the left (rows) links to; no set is empty."""
    _, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = np.array([len(h) for h in [*left, *right]])
    end = np.cumsum(sizes)
    split = end[len(left) - 1]
    theirs, begin, n = ids[split:], end[len(left) :] - sizes[len(left) :] - split, sizes[len(left) :]
    out, mark = np.zeros((len(left), len(right)), bool), np.zeros(ids.max() + 1, np.int32)
    for i in range(len(left)):
        mine = ids[end[i] - sizes[i] : end[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[theirs], begin)
        mark[mine] = 0
        out[i] = 100 * both >= percent * (sizes[i] + n - both)
    return out


def _count_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (cls, component, size), sets (cls, hashes) -> (cls, n_links): the links of each class inside its component.

    A component is dealt into blocks by hash; each two of its blocks meet once, so a pair of classes is looked at once.
    Components of one block share their groups with others.
    """
    total = members.agg(F.sum("size")).first()[0] or 0
    n_shared = max(8, int(total / BLOCK_HASHES))
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_HASHES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    dealt = dealt.join(sets, "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("block", "other"), F.greatest("block", "other")
    shared = F.pmod(F.xxhash64("component"), F.lit(n_shared))
    dealt = dealt.select(F.when(F.col("blocks") == 1, shared).otherwise(F.xxhash64("component", a, b)).alias("meeting"), "component", a.alias("a"), b.alias("b"), "block", "cls", "hashes")

    def count(meeting: pa.Table) -> pa.Table:
        groups: dict[tuple, dict[int, dict[int, np.ndarray]]] = {}
        for r in meeting.to_pylist():
            groups.setdefault((r["component"], r["a"], r["b"]), {}).setdefault(r["block"], {})[r["cls"]] = np.frombuffer(r["hashes"], np.uint64)
        cls, n = [], []
        for (_, a, b), held in groups.items():
            if a not in held or b not in held:
                continue
            found = linked(list(held[a].values()), list(held[b].values()), percent)
            cls += held[a]
            n += (found.sum(1) - (a == b)).tolist()  # a set links to itself
            if a != b:
                cls += held[b]
                n += found.sum(0).tolist()
        return pa.table({"cls": pa.array(cls, pa.int64()), "n": pa.array(n, pa.int64())})

    return dealt.groupBy("meeting").applyInArrow(count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n_links"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the smallest key, null keys last, then of the smallest text hash.

    Rows are told apart by a stored number under a name that docs doesn't have, so each row stays that links with no
    other, whatever its key; columns pass through unchanged.
    """
    docs, row = with_row_number(docs)
    own = docs.select(F.col(row).alias("doc_id"), F.col(text).alias("text"), F.col(key).alias("key"))
    member = similar_groups(own, n, percent, count_links=False).select("doc_id", F.col("component_id").alias("component"))
    first = F.struct(F.col("key").isNull().alias("none"), "key", F.xxhash64("text").alias("hash"), "doc_id")
    stay = own.select("doc_id", first.alias("first")).join(member, "doc_id").groupBy("component").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.doc_id").alias(row))
    return docs.join(stay, row, "left_semi").drop(row)
