"""Personal data and the terms that give it away, in DataFrame functions only.

Patterns find the protected entities: addresses, cards and phone numbers. How strongly a term near an entity reveals it is
estimated from the corpus: with co documents in which they stand near each other, df(e) and df(t) documents that hold the
entity and the term, and N documents, their pointwise mutual information is log(co N / (df(e) df(t))), of which an entity
has -log(df(e) / N) in all. A term that gives THRESHOLD of that or more, in LEAST documents at least, discloses the entity;
in documents with that entity it is generalised to the longest prefix class that doesn't, or else removed.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, store, with_row_number
from .decontaminate import LOWER, UPPER, _filter, _passes

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the kinds. Possessive quantifiers and starts at the edge of a run find the same matches as plain ones, in
#: linear time and without recursion.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters without which a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words of contexts, A-Z in lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Code points of a context on either side of an entity.
REACH = 60
#: Share of an entity's information (the code has its complement to one, 1 / 4, as a fourth power), least documents.
THRESHOLD, LEAST = 0.75, 3
#: Lengths of the prefixes to which a term is generalised.
PREFIXES = (4, 2)
#: Parts of the rows that share an entity and a term.
SALTS = 8
SPAN = "struct<start:int,end:int,value:string,left:string,right:string>"


def placed(text: Column, pattern: str, reach: int = 0) -> Column:
    """The matches of the pattern, in order: start, end (code points, end exclusive), value, and what stands left and right
    of it up to the next match, `reach` code points at most."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    zipped = F.arrays_zip(values.alias("v"), F.slice(gaps, 1, F.size(values)).alias("g"), F.slice(gaps, 2, F.size(values)).alias("h"))

    def step(have: Column, x: Column) -> Column:
        start = have["at"] + F.length(x["g"])
        end = start + F.length(x["v"])
        span = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), F.right(x["g"], F.lit(reach)).alias("left"), F.left(x["h"], F.lit(reach)).alias("right"))
        return F.struct(end.alias("at"), F.concat(have["spans"], F.array(span)).alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(values) > 0, F.aggregate(zipped, zero, step)["spans"]).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def entities(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row (a number), doc_id, and an array of spans with their contexts for each kind; written."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("any", F.col("text").rlike("[0-9@]"))
    for kind in KINDS:
        may = F.col("any") & F.col("text").contains(NEEDS[kind]) if kind in NEEDS else F.col("any")
        found = placed(F.when(may, F.col("text")).otherwise(F.lit("")), PATTERNS[kind], REACH + 1)
        rows = rows.withColumn(kind, F.filter(found, partial(valid, kind)))
    return store(rows.drop("text", "any"), "entities")


def base_spans(rows: DataFrame) -> Column:
    """start, place of the kind, end of every span, in that order."""
    def of(number: int, span: Column) -> Column:
        return F.struct(span["start"].alias("start"), F.lit(number).alias("kind"), span["end"].alias("end"))

    each = [F.transform(k, partial(of, i)) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def written_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def contexts(rows: DataFrame) -> DataFrame:
    """row, entity, term, start, end: the words near every entity. A word cut by the end of the reach is none."""
    spans = None
    for kind in KINDS:
        one = rows.select("row", F.explode(kind).alias("s")).select("row", "s.*")
        value = lower(F.col("value")) if kind in ("email", "ip") else digits(F.col("value"))
        one = one.select("row", F.concat(F.lit(f"{kind}:"), value).alias("entity"), "start", "end", "left", "right")
        spans = one if spans is None else spans.union(one)
    before = F.filter(placed(F.col("left"), TERM), lambda t: (t["start"] > 0) | (F.length("left") <= REACH))
    after = F.filter(placed(F.col("right"), TERM), lambda t: (t["end"] <= REACH) | (F.length("right") <= REACH))
    moved = lambda terms, by: F.transform(terms, lambda t: F.struct((t["start"] + by).alias("start"), (t["end"] + by).alias("end"), lower(t["value"]).alias("term")))
    terms = F.concat(moved(before, F.col("start") - F.length("left")), moved(after, F.col("end")))
    return spans.select("row", "entity", F.explode(terms).alias("t")).select("row", "entity", "t.term", "t.start", "t.end")


def shape(term: Column, prefix: int | None) -> Column:
    return term if prefix is None else F.substring(term, 1, prefix)


def term_documents(docs: DataFrame, wanted: DataFrame, text: str = "text", prefix: int | None = None) -> DataFrame:
    """term, df: in how many of all documents each term of wanted (term) occurs.

    A filter of bounded size keeps most other words from being counted; the rest are left out by the join.
    """
    bits = store(_filter(wanted.select(F.shiftrightunsigned(F.xxhash64("term"), 1).alias("h")).distinct()), "term-filter").scalar()
    split = F.split(lower(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    rows = docs.select(split.alias("w")).withColumn("bits", bits)
    some = F.filter(F.transform("w", lambda w: shape(w, prefix)), lambda w: (w != "") & _passes(F.col("bits"), F.shiftrightunsigned(F.xxhash64(w), 1)))
    counted = rows.select(F.explode(F.array_distinct(some)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return wanted.join(counted, "term")


def disclosures(near: DataFrame, docs: DataFrame, documents: int, text: str = "text", prefix: int | None = None) -> DataFrame:
    """entity, term, co, entity_df, df: the terms (or prefixes of terms) that disclose an entity; near are contexts().

    p(e|t) >= p(e) ** (1 - THRESHOLD), so co^4 N >= df(t)^4 df(e) for three quarters.
    """
    pairs = near.select("row", "entity", shape(F.col("term"), prefix).alias("term"))
    co = store(pairs.distinct().groupBy("entity", "term").agg(F.count("*").alias("co")).where(F.col("co") >= LEAST), "co-occurrence")
    of_entity = near.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("entity_df"))
    of_term = term_documents(docs, co.select("term").distinct(), text, prefix)
    both = co.join(of_entity, "entity").join(of_term, "term")
    fourth = lambda c: F.col(c).cast("double") * F.col(c).cast("double") * F.col(c).cast("double") * F.col(c).cast("double")
    return both.where(fourth("co") * F.lit(float(documents)) >= fourth("df") * F.col("entity_df").cast("double")).select("entity", "term", "co", "entity_df", "df")


def flagged(near: DataFrame, found: DataFrame, prefix: int | None = None) -> DataFrame:
    """Rows of contexts() whose term discloses their entity. Rows of one pair may be many: they are dealt to SALTS groups."""
    many = found.select(F.col("entity").alias("_e"), F.col("term").alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    return near.join(many, (F.col("entity") == F.col("_e")) & (shape(F.col("term"), prefix) == F.col("_t")) & (salt == F.col("_s"))).drop("_e", "_t", "_s")


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """row, start, kind, end, each once, of terms (row, start, end) that overlap no span of a pattern."""
    base = rows.select("row", F.explode(base_spans(rows)).alias("s")).select("row", "s.start", "s.kind", "s.end")
    terms = terms.select("row", "start", F.lit(len(KINDS)).alias("kind"), "end").distinct()
    base = base.join(terms.select("row").distinct(), "row", "left_semi")
    by = W.partitionBy("row").orderBy("start")
    firm = F.col("kind") < len(KINDS)
    reached = F.max(F.when(firm, F.col("end"))).over(by.rangeBetween(W.unboundedPreceding, W.currentRow))
    follows = F.min(F.when(firm, F.col("start"))).over(by.rangeBetween(W.currentRow, W.unboundedFollowing))
    marked = base.union(terms).withColumns({"reached": reached, "follows": follows})
    return marked.where(~firm & (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("follows", F.col("end")) >= F.col("end"))).select("row", "start", "kind", "end")


def personal_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base (array of start, kind, end of the patterns' spans,
    in order) and spans (those and the terms that disclose an entity of the document).

    Rows that repeat a key are judged by themselves, and each counts as a document. A null or empty text has no spans; an
    empty table gives no rows. Only documents with an entity get terms. Other columns are ignored, whatever their names.
    """
    rows = entities(docs, text, key)
    near = store(contexts(rows), "contexts")
    found = disclosures(near, docs, rows.count(), text)
    terms = term_spans(rows, flagged(near, found)).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    out = rows.select("row", "doc_id", *counts, base_spans(rows).alias("base")).join(terms, "row", "left")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with spans of patterns replaced by their kind in angle brackets and disclosing terms by the
    longest prefix (and a star) of PREFIXES that discloses no entity of the document, or by nothing.

    Spans that overlap are replaced as one, by the kind of the first. A null text stays null.
    """
    docs, number = with_row_number(docs)
    rows = entities(docs, text, number)
    near = store(contexts(rows), "contexts")
    n = rows.count()
    terms = store(flagged(near, disclosures(near, docs, n, text)), "flagged")
    places = terms.select("row", "term", "start", "end", F.lit(0).alias("level"))
    for level, prefix in enumerate(PREFIXES, 1):
        bad = flagged(terms, disclosures(near, docs, n, text, prefix), prefix)
        places = places.union(bad.select("row", "term", "start", "end", F.lit(level).alias("level")))
    places = places.groupBy("row", "term", "start", "end").agg(F.max("level").alias("level"))
    # Of nested classes, a coarser one may disclose where a finer one doesn't; the longest of those that don't is taken.
    less = F.lit("")
    for level, prefix in reversed(list(enumerate(PREFIXES))):
        less = F.when((F.col("level") <= level) & (F.length("term") > prefix), F.concat(F.substring("term", 1, prefix), F.lit("*"))).otherwise(less)
    firm = term_spans(rows, places)
    new = firm.join(places.select("row", "start", "end", less.alias("new")), ["row", "start", "end"]).select("row", "start", "end", "new")
    names = F.array(*map(F.lit, KINDS))
    base = rows.select("row", F.explode(base_spans(rows)).alias("s")).select("row", "s.start", "s.end", F.concat(F.lit("<"), F.get(names, F.col("s.kind")), F.lit(">")).alias("new"))
    # Base spans that overlap are one.
    by = W.partitionBy("row").orderBy("start", "end")
    behind = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    base = base.withColumn("begins", (F.coalesce(behind, F.lit(0)) <= F.col("start")).cast("int"))
    base = base.withColumn("nth", F.sum("begins").over(by)).groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("new", F.struct("start", "end")).alias("new")).drop("nth")
    parts = base.unionByName(new).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("parts"))
    key, added = free_name(docs, "key"), free_name(docs, "parts")
    parts = rows.select("row", F.col("doc_id").alias(key)).join(parts, "row").select(key, F.col("parts").alias(added))
    t = F.col(text)

    def step(have: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(have["text"], F.substring(t, have["at"] + 1, s["start"] - have["at"]), s["new"]).alias("text"))

    built = F.aggregate(added, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step, lambda x: F.concat(x["text"], F.substring(t, x["at"] + 1, F.length(t))))
    out = docs.join(parts, docs[number] == parts[key], "left")
    return out.withColumn(text, F.when(F.col(added).isNull(), t).otherwise(built)).drop(number, key, added)
