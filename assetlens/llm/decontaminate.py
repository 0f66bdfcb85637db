"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every WINDOW consecutive words, the GRAM-word run with the smallest hash is kept. A shared run of WINDOW words has
the same smallest hash in the document and in the benchmark item, so joining the kept hashes misses none; around each
hit the windows themselves are compared, as text. Items with fewer words than a window are one window of their own
length, and every run of that length is a fingerprint (winnowing with a window of one run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store, with_row_number

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window, words of a hashed run, runs in a window.
WINDOW, GRAM = 10, 5
#: A kept run is one number: 33 bits of hash above 30 bits of place.
PLACE_BITS = 30
#: 64-bit words of the filter that documents' fingerprints meet first: 512 KB, whatever the size of the benchmark.
FILTER_WORDS = 1 << 16
#: Rows of benchmark windows (about 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 300_000


def word_array(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _after(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a), F.lit(1)))




def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def with_kept(df: DataFrame, words: str, out: str) -> DataFrame:
    """df with the kept runs of the array column `words` (empty below WINDOW words), step by step in named columns."""
    step = df.withColumn("_h", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    step = step.withColumn("_h2", F.zip_with("_h", _after(F.col("_h"), 1), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h4", F.zip_with("_h2", _after(F.col("_h2"), 2), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h5", F.zip_with("_h4", _after(F.col("_h"), 4), lambda a, b: F.xxhash64(a, b)))
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 33), PLACE_BITS).bitwiseOR(i.cast("long"))
    step = step.withColumn("_v", F.transform("_h5", pack))
    step = step.withColumn("_m2", F.zip_with("_v", _after(F.col("_v"), 1), _least))
    step = step.withColumn("_m4", F.zip_with("_m2", _after(F.col("_m2"), 2), _least))
    step = step.withColumn("_m6", F.zip_with("_m4", _after(F.col("_m2"), 4), _least))
    whole = F.size(words) - (WINDOW - 1)
    kept = F.when(whole > 0, F.array_distinct(F.slice("_m6", 1, F.greatest(whole, F.lit(1))))).otherwise(F.array().cast("array<bigint>"))
    return step.withColumn(out, kept).drop("_h", "_h2", "_h4", "_h5", "_v", "_m2", "_m4", "_m6")


def run_hash(kept: Column) -> Column:
    return F.shiftright(kept, PLACE_BITS)


def place(kept: Column) -> Column:
    return kept.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _filter_bit(h: Column) -> tuple[Column, Column]:
    """Word of the filter, and bit in it, of a hash."""
    return h.bitwiseAND(F.lit(FILTER_WORDS - 1)), F.shiftright(h, 16).bitwiseAND(F.lit(63)).cast("int")


def _filter(hashes: DataFrame) -> DataFrame:
    """One row: the filter as an array of FILTER_WORDS numbers."""
    word, bit = _filter_bit(F.col("h"))
    bits = hashes.select(word.alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    full = hashes.sparkSession.range(FILTER_WORDS).join(bits, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("x"))
    return full.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("f"))


def _passes(bits: Column, h: Column) -> Column:
    word, bit = _filter_bit(h)
    return F.call_function("shiftright", F.get(bits, word.cast("int")), bit).bitwiseAND(F.lit(1).cast("long")) != 0


def _text(words: Column, at: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def benchmark_windows(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """w (words joined by a space), size, item_id: every window of every item, once."""
    words = items.select(F.col(key).cast("string").alias("item_id"), word_array(F.col(text)).alias("a")).where(F.size("a") > 0)
    size = F.least(F.size("a"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("a") - size)
    spans = words.select("item_id", size.alias("size"), "a", F.explode(starts).alias("s"))
    return spans.select(_text(F.col("a"), F.col("s"), F.col("size")).alias("w"), "size", "item_id").distinct()


def hits(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (row, doc_id, n_words), spans (row, s, size, w: occurrences of windows) and windows (w, size, item_id)."""
    spark = docs.sparkSession
    windows = store(benchmark_windows(items, item_text, item_key), "bench-windows")
    short = [r.size for r in windows.where(F.col("size") < WINDOW).select("size").distinct().collect()]  # nine at most
    long = with_kept(windows.where(F.col("size") == WINDOW).select(F.split("w", " ").alias("a")), "a", "kept")
    prints = long.select(F.explode("kept").alias("kept")).select(run_hash(F.col("kept")).alias("h"))
    prints = prints.union(windows.where(F.col("size") < WINDOW).select(F.shiftrightunsigned(F.xxhash64("w"), 1)))
    bits = store(_filter(prints.distinct()), "bench-filter").scalar()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), word_array(F.col(text)).alias("a"))
    rows = with_kept(rows.withColumn("n", F.size("a")).withColumn("bits", bits), "a", "kept")
    found = F.filter("kept", lambda v: _passes(F.col("bits"), run_hash(v)))
    starts = lambda v: F.sequence(
        F.greatest(place(v).cast("int") - (WINDOW - GRAM), F.lit(0)), F.least(place(v).cast("int"), F.col("n") - WINDOW)
    )

    def span(n: int):
        return lambda s: F.struct(s.alias("s"), F.lit(n).alias("size"), _text(F.col("a"), s, n).alias("w"))

    near = F.transform(F.array_distinct(F.flatten(F.transform("found", starts))), span(WINDOW))
    parts = [near]
    for n in short:
        every = F.when(F.col("n") >= n, F.sequence(F.lit(0), F.col("n") - n)).otherwise(F.array().cast("array<int>"))
        own = F.transform(every, span(n))
        parts.append(F.filter(own, lambda x: _passes(F.col("bits"), F.shiftrightunsigned(F.xxhash64(x["w"]), 1))))
    rows = rows.withColumn("found", found).select("row", "doc_id", F.col("n").cast("long").alias("n_words"), F.concat(*parts).alias("spans"))
    rows = store(rows, "doc-spans")
    spans = rows.select("row", F.explode("spans").alias("x")).select("row", "x.s", "x.size", "x.w")
    texts = windows.select("w", "size").distinct()
    if windows.count() <= BROADCAST_ROWS:
        texts, windows = F.broadcast(texts), F.broadcast(windows)
    return rows.select("row", "doc_id", "n_words"), spans.join(texts, ["w", "size"], "left_semi"), windows


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted as strings) and contaminated.

    A word is hit if it lies inside any occurrence of a window. Rows are judged one by one, those that repeat a key too.
    A null or empty text has no words and no hits; an empty benchmark hits nothing; items without words are ignored;
    items that repeat a key count once. Other columns are ignored, whatever their names.
    """
    rows, spans, windows = hits(docs, items, text, key, item_text, item_key)
    spans = store(spans, "hit-spans")
    by_row = W.partitionBy("row").orderBy("s", "size")
    end = F.col("s") + F.col("size")
    covered = F.max(end).over(by_row.rowsBetween(W.unboundedPreceding, -1))
    cover = spans.select("row", F.greatest(end - F.greatest(F.coalesce(covered, F.lit(0)), F.col("s")), F.lit(0)).alias("new"))
    n_hit = cover.groupBy("row").agg(F.sum("new").alias("n_hit"))
    per_item = spans.select("row", "w", "size").distinct().join(windows, ["w", "size"]).select("row", "item_id").distinct()
    of_items = per_item.groupBy("row").agg(F.array_sort(F.collect_list(F.coalesce("item_id", F.lit("")))).alias("item_ids"))
    out = rows.join(n_hit, "row", "left").join(of_items, "row", "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark window, told apart by a stored number: other rows of their key stay.

    Columns pass through unchanged, whatever their names.
    """
    docs, row = with_row_number(docs)
    bad = contamination(docs.select(row, "text"), items, key=row).where("contaminated").select(F.col("doc_id").alias(row))
    return docs.join(bad, row, "left_anti").drop(row)
