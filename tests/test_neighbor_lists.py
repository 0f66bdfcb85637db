"""Neighbors from lists of groups: no pairs are exchanged, no other kind is computed, and the same first ones result."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.operators import meeting
from assetlens.operators import neighbors as N
from assetlens.operators import range_join
from assetlens.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def tables(spark, seed, n=90):
    rng = random.Random(seed)
    ids = [f"a{i:03}" for i in range(n)]
    second = [0] * 4 + [1] * 5 + [2] * 6 + [3] * 30
    assets = [(a, f"l{a}", f"2026-01-01T00:{(rng.choice(second) if i % 3 else i % 60):02}:00Z", rng.choice(["", "b1", "b2"]), None if i % 11 else "2026-02-01T00:00:00Z") for i, a in enumerate(ids)]
    some = lambda k: [x for a in ids for x in rng.sample(range(6), rng.randrange(k)) for x in [(a, x)]]
    frame = spark.createDataFrame
    return {
        "asset": frame(assets, "id string, local_identifier string, creation_date string, burst_identifier string, deleted_at string"),
        "album_membership": frame([(a, f"album{x}", f"T{x}") for a, x in some(4)], "asset_id string, album_id string, album_title string"),
        "asset_resource": frame([(a, f"h{x}", None) for a, x in some(3)], "asset_id string, sha256 string, deleted_at string"),
        "location_observation": frame([(a, 52 + rng.randrange(3) * 0.004, 4.0, f"e{a}") for a in ids], "asset_id string, latitude double, longitude double, evidence_id string"),
        "visual_observation": frame([(a, "document_signal", f"o{x}", rng.choice([0.5, 0.75]), f"v{a}{x}") for a, x in some(4)], "asset_id string, observation_type string, label string, confidence double, evidence_id string"),
    }


def direct(t, limit):
    """All pairs of all kinds, ranked as they are."""
    live = t["asset"].where("deleted_at IS NULL").select(F.col("id").alias("source_id"))
    w = W.partitionBy("source_id").orderBy("k1", "creation_date", "target_id", "detail")
    out = None
    for of, beside in N.KINDS.values():
        k = of(t["asset"], *([t[beside]] if beside else [])).join(live, "source_id", "left_semi")
        k = k.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 4 * limit)
        out = k if out is None else out.unionByName(k)
    return out


@pytest.mark.parametrize("seed,limit", [(1, 1), (2, 3)])
def test_lists_give_the_first_pairs_and_the_best(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(range_join, "BLOCK", 8)
    t = tables(spark, seed)
    rows = lambda df: sorted(map(str, df.collect()))
    want = direct(t, limit).localCheckpoint()
    # Equal albums of a pair differ in detail only by the hash of the bare form: compare the full one.
    assert rows(N.candidates(t, limit)) == rows(want)
    w = W.partitionBy("source_id").orderBy(F.desc("score"), F.desc("n_reasons"), "creation_date", "target_id")
    best = N.score(want).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)
    assert rows(N.neighbors(t, limit)) == rows(best)


def test_only_the_best_pairs_get_their_reasons(spark):
    t = tables(spark, 3)
    full, best = N._best(t, 2)
    pairs = N.candidates(full, 2, scope=N.Scope(best)).select("source_id", "target_id").distinct()
    assert pairs.groupBy("source_id").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("kind", ["nearby_time", "nearby_location", "same_burst"])
def test_no_pairs_are_ranked_for_sources_of_one_group(spark, kind):
    rows = N.candidates(tables(spark, 4), 2, kinds=(kind,))
    if kind == "nearby_location":  # one location each: what would be ranked is empty
        assert rows.count() > 0
    else:
        assert "windowspecdefinition(source_id" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["neighbors_album", "neighbors_hash", "neighbors_observation", "neighbors_one"])
def test_no_other_kind_is_computed(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("a table of another kind was written")

    monkeypatch.setattr(N, "written", refused)
    monkeypatch.setattr(range_join, "written", refused)
    assert REGISTRY[name][0](spark, SF).limit(1).count() == 1


@pytest.mark.parametrize("seed,n,most", [(6, 150, 2), (7, 60, 20)])
def test_the_best_are_chosen_in_blocks_without_rows_of_pairs(spark, monkeypatch, seed, n, most):
    """Many small blocks, crowded instants, confidences that may be null; no pairs are ranked, nor brought to their source."""
    for of, name, value in ((meeting, "BLOCK", 16), (meeting, "LEAST", 4), (range_join, "BLOCK", 8)):
        monkeypatch.setattr(of, name, value)
    t = tables(spark, seed, n)
    t["visual_observation"] = t["visual_observation"].withColumn("confidence", F.when(F.col("label") != "o5", F.col("confidence")))
    t["album_membership"] = t["album_membership"].withColumn("album_title", F.concat("album_title", F.substring("asset_id", 4, 1)))
    got = N.neighbors(t, most)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(source_id" not in plan and "RepartitionByExpression [source_id" not in plan
    w = W.partitionBy("source_id").orderBy(F.desc("score"), F.desc("n_reasons"), "creation_date", "target_id")
    best = N.score(direct(t, most)).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(best.select(got.columns))


def test_assets_alone_have_neighbors_in_time(spark):
    t = tables(spark, 8, 12)
    t = {"asset": t["asset"], **{k: v.where("false") for k, v in t.items() if k != "asset"}}
    t["asset"] = t["asset"].withColumn("burst_identifier", F.lit(""))
    assert {r.reasons[0]["type"] for r in N.neighbors(t, 3).collect()} == {"nearby_time"}
    assert N.neighbors(t | {"asset": t["asset"].where("false")}, 3).count() == 0


def test_scores_are_rounded_as_decimals():
    assert meeting._round(np.array([0.1 + 0.2, 0.4500000005, 0.75, 1.0])).tolist() == [300000000, 450000001, 750000000, 10**9]
