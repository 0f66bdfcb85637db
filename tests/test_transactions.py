"""Writers that meet: nothing that one has committed is lost, and failed model calls delete nothing."""

import json
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetlens.api import Archive
from assetlens.operators import classify
from assetlens.operators import crawl as crawling
from assetlens.operators.crawl import crawl
from assetlens.schemas import TABLES
from assetlens.store import ConflictError, Store
from tests.test_crawl import ONE, T0, TWO, asset, resource, snapshot

THREE = asset("three", "11:00", resources=[resource("r3", "Three.jpg", local=True, local_path="/pics/three.jpg")])
FOUR = asset("four", "11:30", resources=[resource("r4", "Four.jpg", local=True, local_path="/pics/four.jpg")])


@pytest.fixture
def take(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "archive"))

    def run(assets, hours):
        return crawl(store, snapshot(spark, tmp_path / "in", assets), "lib", "fake", T0, T0 + timedelta(hours=hours))

    run.store = store
    return run


def names(store):
    return sorted(r[0] for r in store.table("asset").select("local_identifier").collect())


def once(monkeypatch, module, name, meddle):
    """Before the first run of a function, after its tables were opened, something else happens. Returns the calls."""
    real, calls = getattr(module, name), []

    def wrapped(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            meddle()
        return real(*a, **k)

    monkeypatch.setattr(module, name, wrapped)
    return calls


def test_two_crawls_that_overlap_lose_nothing(take, monkeypatch):
    take([ONE], 0)
    calls = once(monkeypatch, crawling, "_merge_snapshots", lambda: take([ONE, TWO], 1))
    got = take([ONE, THREE], 2)
    assert names(take.store) == ["one", "three", "two"] and len(calls) == 3  # its own try, the other crawl, its second try
    assert got.counters["previously_seen_missing"] == 1 and got.fields()["assets_new"] == 1
    assert take.store.table("crawl_snapshot").count() == 3


def test_a_crawl_during_a_run_of_the_classifier(take, monkeypatch):
    take([ONE, TWO], 0)
    meddle = lambda: take([{**ONE, "favorite": True}, THREE], 1)
    once(monkeypatch, classify, "_classify", meddle)
    done = classify.drain(take.store)
    ids = {r.local_identifier: r.id for r in take.store.table("asset").collect()}
    states = {r.asset_id: r.state for r in take.store.table("classification_queue").collect()}
    # `one` was queued anew meanwhile and waits for the next run; `three` came too late.
    assert {k: states[i] for k, i in ids.items()} == {"one": "pending", "two": "metadata_classified", "three": "pending"}
    assert done["processed"] == 1
    assert {r.asset_id for r in take.store.table("visual_observation").collect()} == {ids["two"]}
    assert take.store.table("asset").where("favorite").count() == 1


def test_commits_to_other_tables_are_put_on_top(spark, take, monkeypatch):
    take([ONE], 0)
    row = spark.createDataFrame([("e", "t", "a", "b", "m", 1.0, "{}", "x")], TABLES["edge"])
    calls = once(monkeypatch, classify, "_classify", lambda: take.store.commit({"edge": row}))
    assert classify.drain(take.store)["processed"] == 1 and len(calls) == 1
    assert take.store.table("edge").count() == 1 and take.store.table("visual_observation").count() > 0


def test_a_commit_over_a_changed_table_is_refused(spark, take):
    take.store.init()
    row = lambda k: spark.createDataFrame([(k, "t", "a", "b", "m", 1.0, "{}", "x")], TABLES["edge"])
    seen = take.store.tables()
    seen["edge"]
    take.store.commit({"edge": row("first")})
    with pytest.raises(ConflictError, match="edge"):
        take.store.commit({"model_run": take.store.table("model_run")}, seen)
    # Work that meets another commit every time gives up.
    n = iter(range(99))

    def never(t):
        take.store.commit({"edge": row(f"other {next(n)}")})
        t.put("edge", t["edge"].union(row("mine")))

    with pytest.raises(ConflictError):
        take.store.transact(never)
    assert take.store.vacuum() == 0 and take.store.vacuum(grace=-1) > 0
    assert [r.id for r in take.store.table("edge").collect()] == ["other 7"]


def answering(fails, said="satay"):
    def call(batches):
        for b in batches:
            rows = []
            for a, p in zip(b["asset_id"], b["path"]):
                bad = any(f in p for f in fails)
                rows.append((a, None if bad else json.dumps({"scene_summary": f"{said} stall"}), "timeout" if bad else None, "http://127.0.0.1/x", 5, "ab", 1, 0 if bad else 1))
            yield pd.DataFrame(rows, columns=["asset_id", "response", "error", "endpoint", "image_bytes", "image_sha256", "requests", "responses"])

    return call


def test_failed_calls_keep_earlier_answers_and_observations_have_evidence(spark, take):
    take([ONE, THREE, FOUR], 0)
    archive = Archive(spark, take.store.path)
    other = archive.classify(None, call=answering([], "noodle"), model_id="other")
    assert (other["content_classified"], other["content_classification_failures"], other["processed"]) == (2, 0, 3)
    assert other["states"]["content_classified"] == 2
    ids = {r.local_identifier: r.id for r in take.store.table("asset").collect()}
    store = take.store
    store.commit({"classification_queue": store.table("classification_queue").withColumn("state", F.lit("pending"))})
    archive.classify(None, call=answering([]), model_id="m")
    store.commit({"classification_queue": store.table("classification_queue").withColumn("state", F.lit("pending"))})
    third = archive.classify(None, call=answering(["three"], "changed"), model_id="m")
    assert (third["content_classified"], third["content_classification_failures"], third["local_model_http_request_attempts"], third["local_model_http_responses"]) == (1, 1, 2, 1)
    said = {(r.asset_id, r.model_id): r.value_text for r in store.table("model_observation").where("observation_type = 'scene_summary'").collect()}
    assert said == {(ids["three"], "other"): "noodle stall", (ids["four"], "other"): "noodle stall", (ids["three"], "m"): "satay stall", (ids["four"], "m"): "changed stall"}
    assert {r.term for r in store.table("observation_term").where("model_id = 'm'").collect()} >= {"satay", "changed"}
    runs = {r.id: json.loads(r.metadata_json) for r in store.table("model_run").collect()}
    assert len(runs) == 3 and runs[third["model_run_id"]]["failures"] == 1 and runs[third["model_run_id"]]["response_endpoints"] == ["http://127.0.0.1/x"]
    # Every observation leads to its evidence.
    found = archive.search("satay").first()
    evidence = archive.evidence(found.observation_id).collect()
    assert [r.evidence_kind for r in evidence] == ["content_classification"] and json.loads(evidence[0].value_json)["image_transmitted"] is True
    for name in ("visual_observation", "model_observation"):
        lost = store.table(name).join(store.table("evidence_ref").select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")
        assert lost.count() == 0
    assert archive.evidence(store.table("visual_observation").first().id).first().evidence_kind == "classification_input"
