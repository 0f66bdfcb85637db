"""Search does its work once: texts are tokenized in one pass, words grouped where they are read, snippets made of hits."""

import random

from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.operators import search
from assetlens.plans.more import REGISTRY

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, n=200):
    rng = random.Random(n)
    words = ["the", "of", "Écran", "menu", "x_y", "..", "日本"]
    rows = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(30)))])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, body string").repartition(3)


def test_texts_are_tokenized_once(spark):
    df = docs(spark)
    ranked = search.bm25(df, "the menu", ("body",))
    assert "regexp" not in plan(ranked)
    want = {r.id for r in df.collect() if r.body and {"the", "menu"} <= set(r.body.split())}
    assert {r.id for r in ranked.collect()} == want and want
    assert search.bm25(df, "the", ("body",), keep=("id",)).columns == ["id", "rank"]


def test_words_are_counted_as_tokens(spark):
    rows = docs(spark).select(T.word_count(T.search_text(F.col("body"))).alias("n"), F.size(T.search_tokens(F.col("body"))).alias("m")).collect()
    assert all(r.n == r.m for r in rows)


def test_postings_are_grouped_without_an_exchange(spark):
    df = docs(spark).localCheckpoint()
    p = search.postings(df, ("body",))
    assert "Exchange" not in plan(p)
    want = set()
    for r in df.select("id", T.search_tokens(F.col("body")).alias("t")).collect():
        want |= {(t, r.id, tuple(i for i, x in enumerate(r.t) if x == t)) for t in r.t}
    got = p.collect()
    assert {(r.term, r.id, tuple(r.positions)) for r in got} == want and len(got) == len(want)


def test_snippets_are_made_of_the_first_hits_only(spark):
    p = plan(REGISTRY["search_snippets"][0](spark, SF))
    assert "regexp" not in p.split("TakeOrderedAndProject", 1)[1].split("\n", 1)[1]


def test_evidence_is_derived_once(spark):
    assert "/resource:" not in plan(REGISTRY["evidence_lookup"][0](spark, SF))
