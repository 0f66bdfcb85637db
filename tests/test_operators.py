"""Small literal cases of the operators, beside the comparison of the registered queries with SQL."""

import math
import random

from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.functions.ids import stable_id
from assetlens.functions.times import core_data_time, julian_day
from assetlens.operators import classify, place, place_card, search
from assetlens.operators.merge import first_wins, keep_old, merge
from assetlens.operators.range_join import within_1d


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vectors(spark):
    assert one(spark, stable_id("asset", "a", "é"))[0] == "asset:0e9c47b6877125305a26b20e97e5ff44"
    days = ("2026-05-27T10:00:00Z", "2026-05-27T10:00:00.123Z", "2026-05-27T10:00:00.123456Z", "1969-12-31T23:59:59Z", "", "nope")
    assert list(one(spark, *[julian_day(F.lit(d)) for d in days])) == [2461187.9166666665, 2461187.9166680905, 2461187.9166680905, 2440587.499988426, None, None]
    assert list(one(spark, core_data_time(F.lit(60.9)), core_data_time(F.lit(None).cast("double")))) == ["2001-01-01T00:01:00Z", ""]
    assert one(spark, T.search_tokens(F.lit("Screenshot_Beach public.heic Écran")))[0] == ["screenshot", "beach", "public", "heic", "ecran"]
    assert list(one(spark, T.count_id(F.lit(" A-b ")), T.count_id(F.lit("--")), T.term(F.lit("x")), T.numeric_prefix(F.lit("7x")))) == ["a_b", "unknown", None, 7]
    assert one(spark, T.terms(F.lit("Red Door, red")))[0] == ["red", "door", "red_door_red"]
    assert list(one(spark, *[place.valid_location(F.lit(a), F.lit(b)) for a, b in ((-180.0, -180.0), (0.0, 0.0), (12.34, 56.78))])) == [False, False, True]


def test_key_text_rounds_half_even(spark):
    df = spark.createDataFrame([(1.0, 2.0, 8.25), (1.0, 2.0, 8.35)], "a double, b double, c double")
    assert [r[0][-3:] for r in df.select(place.coordinate_key("a", "b", "c")).collect()] == ["8.2", "8.3"]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a", "b c"), (2, "a", "a"), (3, "x a", "y")], "id long, title string, body string")
    got = {r.id: r["rank"] for r in search.bm25(docs, "a", ("title", "body")).collect()}
    avg = 8 / 3
    want = lambda f, dl: -1e-6 * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg))
    assert all(math.isclose(got[i], want(f, dl)) for i, f, dl in ((1, 1, 3), (2, 2, 2), (3, 1, 3)))
    assert search.bm25(docs, "---", ("title", "body")).count() == 0 and search.bm25(docs, "a ---", ("title",)).count() == 0
    assert one(spark, search.snippet(F.lit("one two Three four"), "three"))[0] == "one two [Three] four"


def test_range_join_equals_nested_loop(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(i, rng.uniform(-50, 50)) for i in range(80)], "i int, x double")
    b = spark.createDataFrame([(i, rng.uniform(-50, 50)) for i in range(80)], "j int, y double")
    near = F.abs(F.col("x") - F.col("y")) <= 3
    assert sorted(map(tuple, within_1d(a, b, "x", "y", 3.01, near).select("i", "j").collect())) == sorted(map(tuple, a.join(b, near).select("i", "j").collect()))


def test_merge_policies_are_idempotent(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "t1")], "id string, v string, t string")
    new = spark.createDataFrame([("b", "z", "t2"), ("c", "w", None)], "id string, v string, t string")
    once = merge(old, new, ("id",), {"t": first_wins, "v": keep_old})
    assert sorted(map(tuple, once.collect()), key=str) == [("a", "x", None), ("b", "y", "t1"), ("c", "w", None)]
    assert sorted(map(tuple, merge(once, new, ("id",), {"t": first_wins, "v": keep_old}).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_model_payloads(spark):
    rows = [("1", 'ok {"scene_summary": " a  b ", "cluster_terms": ["x", {"name": "n"}, "x"], "people_presence": null}'), ("2", "no json"), ("3", '{"visible_text_summary": "Return only valid compact JSON"}')]
    got = classify.observations(spark.createDataFrame(rows, "k string, r string"), "r").collect()
    assert {(r.k, r.observation_type, r.value_text) for r in got} == {
        ("1", "scene_summary", "a b"), ("1", "cluster_feature", "x"), ("1", "cluster_feature", "n"), ("3", "visible_text_summary", "Return only valid compact JSON"), ("3", "quality_issue", "model_prompt_leakage"),
    }
    deep = spark.createDataFrame([('[null, true, 2.5, "a", ["b", {"label": "c"}], {"z": 1}]',), (None,), ("bad",)], "j string")
    assert [r[0] for r in deep.select(classify.value_texts("j")).collect()] == [["true", "2.5", "a", "b", "c", '{"z":1}'], None, []]


def test_place_card(spark):
    address = {"formatted": "Dam 1, Dam 1, 1012 Amsterdam, Amsterdam 1012", "country": "NL", "locality": "Amsterdam", "postal_code": "1012", "areas_of_interest": ["Old Center"]}
    pois = [{"name": n, "category": c, "distance_m": d} for n, c, d in (("Grand Hotel", "MKPOICategoryHotel", 30.0), ("Other Hotel", "MKPOICategoryHotel", 20.0), ("EV Charging", "store", 1.0), ("Dam Station", "MKPOICategoryPublicTransport", 5.0), ("Dam Stop", "MKPOICategoryPublicTransport", 6.0), ("Book Shop", "store", 2.0))]
    import json

    doc = json.dumps({"address": address, "map_features": [{"name": "Dam Bridge", "kind": "bridge", "relation": "near", "distance_m": 12.5}, {"name": "", "kind": "bench"}], "poi_candidates": pois, "radius_meters": 150.0})
    card = one(spark, place_card.render(F.from_json(F.lit(doc), place_card.RESULT)))[0]
    assert card.split("\n") == [
        "## Place Context", "", "Address:", "- Full: Dam 1, 1012 Amsterdam", "- Area: NL > Amsterdam", "- Postal code: 1012", "", "Map context:", "- Dam Bridge (bridge, near, 12m)", "- Old Center (area, area)", "",
        "Nearby POIs:", "- Dam Station (public transport, 5m)", "- Other Hotel (hotel, 20m)",
    ]
    empty = one(spark, place_card.render(F.from_json(F.lit('{"radius_meters": 150}'), place_card.RESULT)))[0]
    assert empty == "## Place Context\n\nAddress: unavailable\n\nNearby POIs:\n- No named nearby POIs within 150m"


def test_bundles_hold_only_what_is_asked_for(spark):
    from assetlens.operators import detail
    from assetlens.plans.queries import Tables
    from assetlens.sources.views import Views

    b = detail.bundles(Tables(Views(spark, "/root/testdata/sf0.001")), only={"evidence_ref": ("id",)})
    assert set(b.schema["evidence_ref"].dataType.elementType.fieldNames()) == {"evidence_kind", "id"}
    assert "uti" in b.schema["asset_resource"].dataType.elementType.fieldNames()


def test_the_keyword_text_is_put_together_once(spark):
    from assetlens.sources.views import Views

    plan = Views(spark, "/root/testdata/sf0.001").visual_observation()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws(") == 1


def test_evidence_rows_are_exchanged_once(spark):
    """Of an asset, of itself, and of what refers to it: each row once, whoever asks."""
    from assetlens.operators import detail

    rng = random.Random(4)
    refs = [(f"e{i}", rng.choice(["a1", "a2", f"e{i}"]), "k", "s", f"p{i}", "{}") for i in range(12)] + [("e90", None, "k", "s", "p", "{}")]
    named = [(rng.choice(["l1", "l2", "a1", "e3", None]), rng.choice(["e1", "e2", "e3", "e90", "gone", None])) for _ in range(40)]
    t = {n: spark.createDataFrame(named if n in ("location_observation", "edge") else [], "id string, evidence_id string") for n in detail.EVIDENCED}
    t["evidence_ref"] = spark.createDataFrame(refs, "id string, asset_id string, evidence_kind string, source string, pointer string, value_json string")
    want = {(r[1], r[0]) for r in refs if r[1]} | {(r[0], r[0]) for r in refs} | {(x, e) for x, e in named if x and e and e != "gone"}
    key = lambda df: sorted((r.row_id, r.id) for r in df.collect())
    ids = spark.createDataFrame([("a1",), ("e3",), ("l1",), ("l1",), ("none",)], "row_id string")
    assert key(detail.evidence(t)) == sorted(want)
    assert key(detail.evidence(t, of=("edge",))) == sorted(want) and key(detail.evidence(t, of=("face_observation",))) == sorted({w for w in want if w[0] in (w[1], "a1", "a2") and w in {(r[1], r[0]) for r in refs} | {(r[0], r[0]) for r in refs}})
    assert key(detail.evidence(t, ids)) == sorted(w for w in want if w[0] in ("a1", "e3", "l1"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert detail.evidence(t)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
