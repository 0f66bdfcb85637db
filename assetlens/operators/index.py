"""The stored search index: segments of postings, written by the commits that change documents, merged by size.

A segment holds the documents of one change: `docs` (what each is made of, its length and its terms), `postings` (positions
by term and document, sorted by term and block), `blocks` (for each term and block of documents: how many hold it, the
greatest count and the least length), `dead` (documents of earlier segments that this one replaces or deletes) and
`dead_terms` (their terms, so that document counts stay exact). When the segment before the last is not much larger, both
become one, without reading any text; so there are about as many segments as the logarithm of the documents.

A block is a set of documents of similar length. Greatest count and least length bound the score of its documents for
whatever mean length and document counts there are by then, so a query for the best few reads the blocks of the highest
bounds first and then only those that can still hold a better document.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.among import among
from ..functions.scratch import written
from .search import K1, LEAST_IDF, B, grouped_tokens, phrases, starts_of

#: The text columns of documents.
COLUMNS = ("title", "body")
#: Documents of a block, about, and of one file; blocks read first; how much larger than the last a segment is that is left alone.
BLOCK, FILE, FIRST, RATIO = 128, 50_000, 64, 2
PARTS = {
    "docs": "id string, fp string, dl bigint, block int, terms array<string>",
    "postings": "term string, block int, id string, dl bigint, f int, title array<int>, body array<int>",
    "blocks": "term string, block int, n bigint, most int, least bigint",
    "dead": "seq bigint, id string",
    "dead_terms": "seq bigint, term string, n bigint",
}


class Index:
    """One index as of a pointer: the segments (oldest first) of an archive's tables."""

    def __init__(self, tables, name: str):
        self.tables, self.name, self.store = tables, name, tables.store
        self.segments: list[dict] = list(tables.segments(name) or [])
        self.exists = tables.segments(name) is not None

    def _path(self, segment: dict, part: str) -> str:
        return f"{self.store.path}/{segment['path']}/{part}"

    def part(self, part: str, segments: list[dict] | None = None) -> DataFrame:
        """A part of all segments, with seq, the number of the segment (of dead parts: `by`)."""
        spark = self.store.spark
        number = "by" if part.startswith("dead") else "seq"
        frames = [spark.read.schema(PARTS[part]).parquet(self._path(s, part)).withColumn(number, F.lit(s["seq"]).cast("bigint")) for s in (self.segments if segments is None else segments)]
        empty = spark.createDataFrame([], f"{PARTS[part]}, {number} bigint")
        return reduce(DataFrame.unionByName, frames) if frames else empty

    def alive(self, rows: DataFrame, segments: list[dict] | None = None) -> DataFrame:
        """rows (seq, id) without those that a later segment replaces."""
        return rows.join(self.part("dead", segments).select("seq", "id"), ["seq", "id"], "left_anti")

    @property
    def documents(self) -> int:
        return sum(s["n"] for s in self.segments)

    @property
    def tokens(self) -> int:
        return sum(s["tokens"] for s in self.segments)

    # Maintenance

    def update(self, ids: DataFrame | None, docs: DataFrame) -> int:
        """Make the documents `ids` (id; None: all) be as docs (id, title, body) has them: those that docs lacks are deleted.
        Returns how many were tokenized: only new documents and those whose text has changed."""
        new = docs.select("id", *COLUMNS, F.sha2(F.to_json(F.array(*COLUMNS)), 256).alias("fp"))
        if self.segments:
            have = self.alive(self.part("docs") if ids is None else among(self.part("docs"), ids, "id"))
            old = have.select("id", "seq", "dl", "terms", F.col("fp").alias("was"))
            both = written(new.join(old, "id", "full_outer").where("fp IS NULL OR was IS NULL OR fp <> was"), "documents")
            fresh, dead = both.where("fp IS NOT NULL"), both.where("seq IS NOT NULL").select("seq", "id", "dl", "terms")
        else:  # all are new: texts are neither joined nor written again
            fresh, dead = new, self.store.spark.createDataFrame([], "seq bigint, id string, dl bigint, terms array<string>")
        tokens = [T.search_tokens(F.col(c)).alias(f"_{c}") for c in COLUMNS]
        rows = written(fresh.select("id", "fp", *tokens), "tokens").withColumn("dl", (F.size("_title") + F.size("_body")).cast("bigint"))
        made, gone = rows.count(), dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        if not made and not gone.n:
            if not self.exists:
                self.tables.put_segments(self.name, [])
            return 0
        spread = max(1, made // (BLOCK * 8))
        block = F.floor(F.log2(F.col("dl") + 1) * 4).cast("int") * spread + F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
        rows = rows.withColumn("block", block)
        segment = self._new()
        self._write(segment, "docs", rows.select("id", "fp", "dl", "block", F.array_distinct(F.concat("_title", "_body")).alias("terms")), made)
        held = rows.select("block", "id", "dl", F.col("_title").alias("title"), F.col("_body").alias("body"))
        self._write_postings(segment, held.mapInArrow(grouped_tokens(["block", "id", "dl"], list(COLUMNS), "f"), PARTS["postings"]), made)
        self._write(segment, "dead", dead.select("seq", "id"), gone.n)
        self._write(segment, "dead_terms", dead.select("seq", F.explode("terms").alias("term")).groupBy("seq", "term").agg(F.count("*").alias("n")), gone.n)
        added = rows.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first().t
        self.segments.append({**segment, "docs": made + gone.n, "n": made - gone.n, "tokens": added - gone.t})
        self._merge()
        self.tables.put_segments(self.name, self.segments)
        return made

    def _new(self) -> dict:
        seq = 1 + max([s["seq"] for s in self.segments], default=0)
        return {"seq": seq, "path": f"index/{self.name}/v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"}

    def _write(self, segment: dict, part: str, df: DataFrame, documents: int) -> None:
        df.coalesce(max(1, documents // FILE)).write.parquet(self._path(segment, part))

    def _write_postings(self, segment: dict, rows: DataFrame, documents: int) -> None:
        """Blocks are kept with the first posting of each while the postings are in order, and read from there."""
        files = max(1, documents // FILE)
        ordered = rows.repartitionByRange(files, "term", "block").sortWithinPartitions("term", "block", "id")
        one = W.partitionBy("term", "block").orderBy("id")
        whole = one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        of = {"n": F.count("*").over(whole), "most": F.max("f").over(whole), "least": F.min("dl").over(whole)}
        known = ordered.withColumns({"_first": F.row_number().over(one) == 1, **of}).withColumns({c: F.when(F.col("_first"), F.col(c)) for c in of})
        known.drop("_first").write.parquet(self._path(segment, "postings"))
        stored = self.store.spark.read.schema(PARTS["blocks"]).parquet(self._path(segment, "postings"))
        self._write(segment, "blocks", stored.where("n IS NOT NULL"), documents)

    def _merge(self) -> None:
        """While the segment before the last ones is not RATIO as large, they become one: the largest such run at once."""
        take, size = 1, self.segments[-1]["docs"]
        while take < len(self.segments) and self.segments[-take - 1]["docs"] < RATIO * size:
            size += self.segments[-take - 1]["docs"]
            take += 1
        if take == 1:
            return
        some, rest = self.segments[-take:], self.segments[:-take]
        inside = [s["seq"] for s in some]
        merged = self._new()
        docs = self.alive(self.part("docs", some), some)
        n = docs.count()
        spread = max(1, n // (BLOCK * 8))
        block = F.floor(F.log2(F.col("dl") + 1) * 4).cast("int") * spread + F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
        self._write(merged, "docs", docs.withColumn("block", block).drop("seq"), n)
        self._write_postings(merged, self.alive(self.part("postings", some), some).withColumn("block", block).drop("seq"), n)
        for part in ("dead", "dead_terms"):
            left = self.part(part, some).where(~F.col("seq").isin(inside)).drop("by")
            self._write(merged, part, left if part == "dead" else left.groupBy("seq", "term").agg(F.sum("n").alias("n")), n)
        gone = self.part("dead", some).where(~F.col("seq").isin(inside)).count()
        self.segments = [*rest, {**merged, "docs": n + gone, "n": sum(s["n"] for s in some), "tokens": sum(s["tokens"] for s in some)}]

    # Queries

    def _terms(self, part: str, terms: list[str]) -> DataFrame:
        return self.part(part).where(F.col("term").isin(terms))

    def matches(self, query: str) -> DataFrame:
        """id and rank of all documents that hold every phrase, lower first; reads all postings of the query's terms."""
        wanted = phrases(query)
        found = self.alive(self._terms("postings", sorted({t for p in wanted for t in p})))
        at = {c: F.map_from_entries(F.collect_list(F.struct("term", c))).alias(c) for c in COLUMNS}
        by = found.groupBy("id", "dl").agg(*at.values())
        held = by.select("id", "dl", *[sum((starts_of(F.col(c), p) for c in COLUMNS), F.lit(0)).alias(f"f{i}") for i, p in enumerate(wanted)])
        held = written(held, "held")
        df = held.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"f{i}") for i in range(len(wanted))]).first()
        return held.where(" AND ".join(f"f{i} > 0" for i in range(len(wanted)))).select("id", self._rank([(F.col(f"f{i}"), df[i]) for i in range(len(wanted))], F.col("dl")).alias("rank"))

    def _rank(self, of: list[tuple[Column, int]], dl: Column) -> Column:
        rank, mean, n = F.lit(0.0), self.tokens / max(1, self.documents), self.documents
        for f, df in of:
            idf = max(log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
            f = f.cast("double")
            rank = rank - F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * dl / F.lit(float(mean))))
        return rank

    def best(self, query: str, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, counts: dict | None = None) -> DataFrame:
        """The first `limit` of keep(matches(query)) by rank, then id. counts, if given, gets `read` and `all`: the postings
        that were read and those of the query's terms.

        Phrases of several words need the positions of all their postings; for others, blocks are read by their bounds.
        """
        wanted = phrases(query)
        if any(len(p) != 1 for p in wanted) or not self.segments:
            return keep(self.matches(query)).orderBy("rank", "id").limit(limit)
        terms = [p[0] for p in wanted]
        distinct = sorted(set(terms))
        blocks = written(self._terms("blocks", distinct), "blocks")
        held = {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        lost = {r.term: r.n for r in self._terms("dead_terms", distinct).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        df = {t: held.get(t, 0) - lost.get(t, 0) for t in distinct}
        if not all(df.values()):
            return keep(self.matches(query).limit(0)).limit(0)
        times = {t: terms.count(t) for t in distinct}
        bound = F.lit(0.0)
        for t in distinct:
            bound = bound + F.when(F.col("term") == t, times[t] * self._rank([(F.col("most"), df[t])], F.col("least"))).otherwise(0.0)
        bounds = blocks.groupBy("seq", "block").agg(F.sum(bound).alias("bound"), F.count("*").alias("terms"), F.sum("n").alias("n")).where(F.col("terms") == len(distinct))
        bounds = written(bounds.select("seq", "block", "bound", "n"), "bounds")

        def read(chosen: DataFrame) -> DataFrame:
            some = self.alive(self._terms("postings", distinct).join(chosen.select("seq", "block"), ["seq", "block"], "left_semi"))
            by = some.groupBy("id", "dl").agg(*[F.sum(F.when(F.col("term") == t, F.col("f"))).alias(f"f{i}") for i, t in enumerate(distinct)])
            full = by.where(" AND ".join(f"f{i} > 0" for i in range(len(distinct))))
            return keep(full.select("id", self._rank([(F.col(f"f{distinct.index(t)}"), df[t]) for t in terms], F.col("dl")).alias("rank"))).orderBy("rank", "id").limit(limit)

        first = bounds.orderBy("bound", "seq", "block").limit(FIRST)
        first = written(first, "first")
        top = written(read(first), "top")
        seen = top.agg(F.count("*").alias("n"), F.max("rank").alias("worst")).first()
        rest = bounds.join(first.select("seq", "block"), ["seq", "block"], "left_anti")
        if seen.n >= limit:
            rest = rest.where(F.col("bound") <= seen.worst + 1e-9)
        if counts is not None:
            total = lambda rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            counts |= {"read": total(first) + total(rest), "all": sum(held.values())}
        return top.unionByName(read(rest)).orderBy("rank", "id").limit(limit)
