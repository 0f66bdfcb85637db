"""Neighbors in time and place: bounded pairs against all pairs, also where everything is at one place or instant."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.operators import neighbors as N
from assetlens.operators import place_tree, range_join, search

MOST = 6


def library(spark, seed, hot):
    rng = random.Random(seed)
    assets, places = [], []
    for i in range(160):
        minute = 600 if i < hot else rng.randrange(0, 1440)
        lat, lon = (52.0, 4.0) if i < hot else (round(52 + rng.randrange(12) * 0.003, 6), round(4 + rng.randrange(6) * 0.004, 6))
        assets.append((f"a{i:03}", f"l{i}", f"2026-01-01T{minute // 60:02}:{minute % 60:02}:{rng.choice([0, 0, 30]):02}Z" if i % 19 else "", None if i % 23 else "2026-02-01T00:00:00Z"))
        places.append((f"a{i:03}", lat, lon, f"e{i}"))
    a = spark.createDataFrame(assets, "id string, local_identifier string, creation_date string, deleted_at string")
    return a, spark.createDataFrame(places, "asset_id string, latitude double, longitude double, evidence_id string")


def top(rows):
    w = W.partitionBy("source_id").orderBy("k1", "creation_date", "target_id", "detail")
    first = rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= MOST)
    return sorted(map(str, first.collect()))


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 70)])
def test_bounded_pairs_give_the_same_first_ones(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(range_join, "BLOCK", 16)
    a, loc = library(spark, seed, hot)
    assert top(N.nearby_time(a, MOST)) == top(N.nearby_time(a))
    bounded = N.nearby_location(a, loc, MOST)
    assert top(bounded) == top(N.nearby_location(a, loc))
    assert bounded.count() <= 160 * (MOST + 1) and N.nearby_time(a, MOST).count() <= 160 * (MOST + 1)
    assert N.nearby_time(a.where("false"), MOST).count() == 0 and N.nearby_location(a.where("false"), loc, MOST).count() == 0


def dense(seed, n):
    """Different places: some spread out, a crowd, a denser one in its middle, rows of equal distance, and places apart."""
    rng = random.Random(seed)
    at = lambda x, y, d: (round(x + rng.uniform(-d, d), 9), round(y + rng.uniform(-d, d), 9))
    spots = {at(*rng.choice([(52, 4, 0.03), (52, 4, 0.003), (52.001, 4.001, 0.00004), (-0.0001, 0.0, 0.0004)])) for _ in range(n)}
    return sorted(spots | {(52.0 + i * 0.0005, 4.0) for i in range(40)} | {(10.0, 10.0), (10.0099, 10.0), (-33.0, 151.0)})


@pytest.mark.parametrize("crowd,most", [(1, 6), (1, 2), (6, 6)])
def test_crowded_places_give_the_same_first_ones(spark, monkeypatch, crowd, most):
    monkeypatch.setattr(place_tree, "CROWD", crowd)
    monkeypatch.setitem(globals(), "MOST", most)
    places = dense(crowd + most, 260)
    rng = random.Random(most)
    rows = [(f"a{i:04}", *places[i % len(places)], f"e{i}") for i in range(int(len(places) * 1.3))] + [("null1", None, 4.0, "e"), ("null2", 52.0, None, "e"), ("nan", float("nan"), 4.0, "e"), ("inf", 52.0, float("inf"), "e")]
    a = spark.createDataFrame([(r[0], r[0], f"2026-01-01T00:00:{rng.randrange(20):02}Z", "2026-02-01T00:00:00Z" if i % 5 == 2 else None) for i, r in enumerate(rows)], "id string, local_identifier string, creation_date string, deleted_at string")
    loc = spark.createDataFrame(rows, "asset_id string, latitude double, longitude double, evidence_id string")
    assert top(N.nearby_location(a, loc, most)) == top(N.nearby_location(a, loc))


def test_a_place_in_a_crowd_meets_few_others(spark):
    met = {}
    for n in (4000, 16000):
        rng = random.Random(n)
        crowd = {(52 + rng.uniform(0, 0.01), 4 + rng.uniform(0, 0.01)) for _ in range(n)}
        df = spark.createDataFrame([(*p, 1) for p in crowd], "lat double, lon double, n int")
        met[n] = place_tree.met(df, 81, N.DEGREES, N.DEGREE_CELL).count() / len(crowd)
    assert max(met.values()) < 500, met


def test_places_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(5)
    assert {(r.v, r._index) for r in range_join.in_order(df, "v").collect()} == {(i, i) for i in range(1000)}


def test_phrases_are_counted_wherever_they_start(spark):
    hits = lambda text, *p: spark.range(1).select(search.phrase_hits(T.search_tokens(F.lit(text)), list(p))).first()[0]
    assert [hits("a a a b a a", "a", "a"), hits("a a a b a a", "a", "b"), hits("ab a b", "b"), hits("of the of the", "of", "the", "of"), hits("", "a"), hits("a", "b", "a")] == [3, 1, 1, 1, 0, 0]
    assert hits("of the " * 20000, "of", "the") == 20000


def test_texts_are_cut_by_bytes(spark):
    cut = lambda text, n: spark.range(1).select(T.cut(F.lit(text), n)).first()[0]
    assert [cut("ab  cd", 4), cut("é" * 4, 5), cut("a🙂b", 4), cut("日本", 6), cut("a b", 2)] == ["ab c", "éé", "a", "日本", "a"]


def test_a_stored_index_ranks_like_the_documents(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["of", "the", "menu", "trip", "É."], k=rng.randrange(6))), " ".join(rng.choices(["of", "the", "ecran", "x_y"], k=rng.randrange(40)))) for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None, None)], "id long, title string, body string")
    search.write_index(docs, ("title", "body"), str(tmp_path / "i"))
    for q in ("of", "of.the", "of.of.the menu", "écran", "x_y the", "absent", "--", "of --"):
        want = sorted((r.id, round(r["rank"], 9)) for r in search.bm25(docs, q, ("title", "body")).collect())
        assert sorted((r.id, round(r["rank"], 9)) for r in search.indexed_bm25(spark, str(tmp_path / "i"), q).collect()) == want, q
