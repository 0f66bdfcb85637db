"""Place lookups behind a cache and in rounds, evaluation runs, paths and prompts."""

import json
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetlens import paths
from assetlens.__main__ import function, main, parser
from assetlens.operators import evaluation, place_run
from assetlens.prompts import prompt
from assetlens.schemas import TABLES

RESULT = {"address": {"country": "NL", "locality": "Amsterdam"}, "poi_candidates": [{"name": f"p{i:02}", "category": "", "distance_m": float(50 - i)} for i in range(20)]}


def lookup(latitude, longitude, accuracy, radius):
    if latitude < 0:
        raise RuntimeError("Too many requests")
    return json.dumps({**RESULT, "radius_meters": radius})


def test_a_place_is_looked_up_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", 52.0, 4.0, 5.0), ("b", 52.0, 4.0, 5.0), ("c", 53.0, 4.0, 5.0), ("d", 0.0, 0.0, 1.0)], "id string, latitude double, longitude double, accuracy double")
    first = place_run.run_places(rows.where("id <> 'c'"), cache, lookup, every=0.0).collect()
    assert [(r.id, r.cached) for r in sorted(first)] == [("a", False), ("b", False)]
    assert spark.read.parquet(cache).count() == 1
    second = {r.id: r for r in place_run.run_places(rows, cache, lookup, every=0.0).collect()}
    assert {k: r.cached for k, r in second.items()} == {"a": True, "b": True, "c": False}
    got = json.loads(second["a"].result)
    assert got["poi_status"] == "found" and [p["name"] for p in got["poi_candidates"]] == [f"p{i:02}" for i in range(19, 7, -1)]
    assert [x["name"] for x in got["area"]] == ["NL", "Amsterdam"]
    with pytest.raises(Exception, match="place lookup failed"):
        place_run.run_places(rows.withColumn("latitude", F.lit(-1.0)), cache, lookup, every=0.0, cooldown=0.0).collect()


def test_results_of_unknown_status_are_refused(spark):
    rows = lambda s: spark.createDataFrame([(json.dumps({"poi_status": s}),)], "result string")
    assert place_run.load_results(rows("none")).first().result.poi_status == "none"
    with pytest.raises(Exception, match="unknown place status"):
        place_run.load_results(rows("maybe")).collect()


def test_starts_are_spaced_and_a_throttled_provider_rests():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    calls = place_run.paced(lookup, every=6.0, cooldown=120.0, clock=lambda: now[0], sleep=sleep)
    rows = pd.DataFrame({"latitude": [1.0, 1.0, -1.0, 1.0], "longitude": 2.0, "accuracy": 3.0})
    out = pd.concat(calls(iter([rows])))
    assert slept == [6.0, 6.0, 120.0] and out.error.tolist() == [None, None, "Too many requests", None]


def archive(spark, places):
    asset = spark.createDataFrame([(f"a{i}", "2026-01-0%dT00:00:00Z" % (i + 1)) for i in range(len(places))], "id string, creation_date string").withColumn("deleted_at", F.lit(None).cast("string"))
    rows = [(f"l{i}", f"a{i}", la, lo, None, 5.0, "s", "e") for i, (la, lo) in enumerate(places)]
    return asset, spark.createDataFrame(rows, TABLES["location_observation"])


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    out, waits = str(tmp_path / "out"), []
    a, loc = archive(spark, [(52.0, 4.0), (52.0, 4.0), (53.0, 4.0), (-5.0, 4.0)])
    s = place_run.backfill(a, loc, out, lookup, wait=waits.append, every=0.0, cooldown=0.0)
    assert (s["located_assets"], s["location_keys"], s["existing_successes"], s["successes"], s["final_failures"]) == (4, 3, 0, 2, 1)
    assert (s["provider_attempts"], s["attempt_failures"], s["provider_cooldowns"]) == (6, 4, 4) and waits == [120.0, 600.0, 1800.0]
    assert spark.read.json(f"{out}/outputs").count() == 2 and spark.read.json(f"{out}/errors").count() == 1
    assert spark.read.json(f"{out}/progress").count() == 4
    assert json.loads(spark.read.text(f"{out}/summary").first()[0])["successes"] == 2
    again = place_run.backfill(a, loc, out, lookup, wait=waits.append, every=0.0)
    assert (again["existing_successes"], again["provider_attempts"]) == (2, 6)


def test_evaluation_run(spark, tmp_path):
    names = ["id", "media_type", "creation_date", "deleted_at"]
    assets = spark.createDataFrame([(f"a{i}", "image" if i != 3 else "video", f"2026-01-{10 + i}", None) for i in range(8)], ", ".join(f"{n} string" for n in names))
    originals = spark.createDataFrame([(f"a{i}", f"/o/{i}.heic") for i in (0, 2, 5, 6)], "asset_id string, path string")

    def call(model, text, path):
        if model == "bad":
            raise RuntimeError("no")
        return f"{path} {len(text)}"

    s = evaluation.run(assets, originals, originals.limit(0), str(tmp_path / "e"), ["good/one", "bad"], call, limit=3)
    assert (s["assets_seen"], s["assets_prepared"], s["assets_skipped"]) == (7, 3, {"original_not_available": 2})
    assert (s["model_calls_attempted"], s["model_calls_succeeded"], s["model_calls_failed"]) == (6, 3, 3)
    rows = sorted(spark.read.json(str(tmp_path / "e" / "manifest")).collect(), key=lambda r: r.eval_id)
    assert [(r.eval_id, r.asset_id) for r in rows] == [("E001", "a6"), ("E002", "a5"), ("E003", "a2")]
    raw = spark.read.json(str(tmp_path / "e" / "raw"))
    assert {r.model for r in raw.collect()} == {"good_one", "bad"}
    drawn = [evaluation.run(assets, originals, originals.limit(0), str(tmp_path / "r"), [], sample="random", seed=k)["assets_skipped"] for k in (1, 1)]
    assert drawn[0] == drawn[1]
    with pytest.raises(ValueError, match="unsupported sample"):
        evaluation.ordered_images(assets, "first")
    assert evaluation.sampled(assets, 3, 7).count() == 3


def test_paths(tmp_path):
    p = paths.RuntimePaths.default("x", {"HOME": "/h", "XDG_CACHE_HOME": "/c"})
    assert (p.data, p.place_cache, p.originals_cache) == ("/h/.local/share/x", "/c/x/place-context", "/c/x/originals")
    assert p.evaluations.startswith(p.data) and p.place_backfill.startswith(p.data) and p.archive.startswith(p.data)
    for given, want in (("", paths.GENERATE_URL), ("http://a/", "http://a/api/generate"), ("http://a/api", "http://a/api/generate"), (" http://a/api/generate ", "http://a/api/generate")):
        assert paths.generate_url(given) == want
    for given, want in (("", paths.CHAT_URL), ("http://a", "http://a/v1/chat/completions"), ("http://a/v1/", "http://a/v1/chat/completions"), ("http://a/chat/completions", "http://a/chat/completions")):
        assert paths.chat_url(given) == want
    assert paths.output_dir("", "/r", datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)) == "/r/2026-01-02-030405-photo-card"
    assert paths.cache_dir("", "/d") == "/d" and paths.safe_name(" a/b:c\\d ") == "a_b_c_d" and paths.safe_name(" ") == "default"
    for f in (paths.output_dir, paths.cache_dir):
        with pytest.raises(ValueError):
            f("", " ")
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    with pytest.raises(ValueError, match="inside repo"):
        paths.reject_repository_path(str(tmp_path / "repo" / "new" / "x"), str(tmp_path / "repo"))
    paths.reject_repository_path(str(tmp_path / "other"), str(tmp_path / "repo"))
    assert "{{metadata}}" in prompt() and "scene_summary" in prompt()


def test_commands(capsys):
    assert {"place-context", "place-card", "place-backfill", "export", "eval-card"} <= set(parser()._subparsers._group_actions[0].choices)
    assert function("json:dumps") is json.dumps and function(None) is None
    with pytest.raises(ValueError):
        function("json")
    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
