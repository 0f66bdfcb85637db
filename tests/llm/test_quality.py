import random
import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from assetlens.llm import quality
from assetlens.llm.quality import buckets_for, importance, resample


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, draw double")


def corpus(n=300):
    rng = random.Random(1)
    good, bad = "clear river stone morning quiet letter".split(), "win cash now click free prize".split()
    return [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randint(5, 30)))) for i in range(n)]


def ngrams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [*w, *zip(w, w[1:])]


def brute_weights(rows, target, buckets):
    """Log likelihood ratios by the n-grams themselves; with so many buckets no two of them share one."""
    ours, theirs = (Counter(g for _, t in some for g in ngrams(t)) for some in (target, rows))
    share = lambda n, g: (n[g] + 1) / (sum(n.values()) + buckets)
    return {k: sum(log(share(ours, g)) - log(share(theirs, g)) for g in ngrams(t)) for k, t in rows}


def brute_ranks(spark, rows, weights, seed=11, scale=1.0):
    """Ranks by weight and Gumbel noise, the noise from the key's hash as the docstring says."""
    keys = spark.createDataFrame([(k,) for k, _ in rows], "k long")
    noise = {r.k: (r.h % (1 << 52) + 0.5) / (1 << 52) for r in keys.select("k", F.xxhash64(F.col("k").cast("string"), F.lit(seed)).alias("h")).collect()}
    order = sorted(weights, key=lambda k: (-(weights[k] * scale - log(-log(noise[k]))), k))
    return {k: i + 1 for i, k in enumerate(order)}


@pytest.mark.parametrize("part", [1 << 22, 1 << 17])
def test_weights_and_draw_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)  # the smaller one makes eight passes
    monkeypatch.setattr(quality, "BUCKETS", 1 << 20)
    rows = [*corpus(60), (100, "Clear  RIVER\tstone"), (101, None)]
    target = [r for r in rows if r[0] % 3][:20]
    want = brute_weights(rows, target, 1 << 20)
    got = {r.doc_id: r for r in resample(docs_of(spark, rows), docs_of(spark, target)).collect()}
    assert all(abs(got[k].log_weight - want[k]) < 1e-4 for k in want)
    assert {k: r.rank for k, r in got.items()} == brute_ranks(spark, rows, {k: r.log_weight for k, r in got.items()})
    assert {k for k, r in got.items() if r.selected} == {k for k, r in got.items() if r.rank <= len(rows) // 2}


def test_the_model_grows_with_the_input(spark):
    sizes = [buckets_for(spark.range(n).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))) for n in (1, 4, 16)]
    assert sizes == [10_000, 20_000, 40_000]


def test_draw_favours_the_target_and_repeats(spark):
    rows = corpus()
    docs, target = docs_of(spark, rows), docs_of(spark, [r for r in rows if r[0] % 3][:50])
    got = resample(docs, target, scale=5.0).collect()
    assert sorted(r.rank for r in got) == list(range(1, len(rows) + 1))
    taken = {r.doc_id for r in got if r.selected}
    assert len(taken) == len(rows) // 2 and sum(k % 3 > 0 for k in taken) > 0.9 * len(taken)
    again = resample(docs.repartition(3), target, scale=5.0).collect()
    assert {r.doc_id for r in again if r.selected} == taken


def test_the_draw_of_the_query_weighs_whole_texts(spark):
    rng = random.Random(4)
    words = "clear river stone morning quiet letter".split()
    # Both kinds share their words and differ in how often they use them.
    rows = [(i, " ".join(rng.choices(words, [3, 3, 3, 2, 2, 2] if i % 2 else [2, 2, 2, 3, 3, 3], k=400))) for i in range(300)]
    docs, target = docs_of(spark, rows), docs_of(spark, [r for r in rows if r[0] % 2][:60])
    got = resample(docs, target).collect()
    weights = {r.doc_id: r.log_weight for r in importance(docs, target).collect()}
    assert all(abs(r.log_weight - weights[r.doc_id]) < 1e-6 for r in got)
    taken = [r.doc_id for r in got if r.selected]
    assert sum(k % 2 for k in taken) > 0.9 * len(taken)


def test_odd_rows(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, "x " * 30000), (3, "y"), (None, "z")])
    got = {r.doc_id: r.log_weight for r in resample(docs, docs.where("false")).collect()}
    assert got[1] == got[2] == 0
    tied = resample(docs_of(spark, [(5, "a b"), (5, "a b"), (5, "a b"), (6, None)]), docs_of(spark, [(1, None)])).collect()
    assert sorted(r.rank for r in tied) == [1, 2, 3, 4] and sum(r.selected for r in tied) == 2
    assert resample(docs.where("false"), docs).count() == 0


def test_target_is_joined_the_same_way_at_every_size(spark, monkeypatch):
    """The target's texts are not shuffled all at one size and broadcast at another; few others are exchanged with them."""
    from assetlens.llm import common, quality, queries

    seen = {}
    monkeypatch.setattr(quality, "resample", lambda docs, target: seen.update(target=target) or docs)
    queries.op3_quality_resampling(spark, "/root/testdata/sf0.001")
    plan = seen["target"]._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("SortMergeJoin") < plan.find("BroadcastHashJoin")  # exact join behind the bitmap, also for tiny labels
    docs = spark.createDataFrame([(i if i % 10 else None, f"t{i}") for i in range(3000)], "doc_id long, text string")
    keys = spark.createDataFrame([(i,) for i in [*range(0, 3000, 7), 7, 14, None]], "doc_id long")
    got = sorted(r.text for r in common.among(docs, keys, "doc_id").collect())
    assert got == sorted(f"t{i}" for i in range(3000) if i % 10 and i % 7 == 0)
    assert common.among(docs, keys.where("false"), "doc_id").count() == 0
