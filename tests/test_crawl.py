"""The merge path end to end: crawl, search, timeline, neighbors, classify, tombstones and restores."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from assetlens.api import Archive
from assetlens.operators.crawl import crawl
from assetlens.schemas import SNAPSHOT
from assetlens.store import ArchiveError, Store

T0 = datetime(2026, 5, 28, 12, tzinfo=timezone.utc)


def resource(sid, name, local=False, **over):
    base = {"source_identifier": sid, "type": "photo", "uti": "public.heic", "original_filename": name, "local_path": "/x.heic" if local else "", "availability": "", "file_size": 10, "stable_hash": "h", "available_locally": local, "needs_download": not local, "metadata": "{}"}
    return {**base, **over}


def asset(name, hour, **over):
    base = {
        "local_identifier": name, "media_type": "image", "media_subtypes": "", "creation_date": f"2026-05-27T{hour}:00Z", "modification_date": "", "added_date": "", "timezone_name": "UTC", "width": 4032, "height": 3024, "duration_seconds": 0.0,
        "favorite": False, "hidden": False, "burst_identifier": "b1", "represents_burst": False, "deleted_at": "", "deletion_source": "", "deletion_reason": "", "location": None, "resources": [], "albums": [{"album_id": "al", "album_title": "Beach", "album_kind": "user"}], "metadata": '{"source_type":2}',
    }
    return {**base, **over}


def snapshot(spark, tmp_path, assets):
    path = tmp_path / f"s{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps({"library_path": "lib", "provider": "fake", "photos_version": "1", "authorization_status": "ok", "metadata": "{}", "assets": assets}))
    return spark.read.schema(SNAPSHOT).json(str(path), multiLine=True)


GPS = {"latitude": 52.3676, "longitude": 4.9041, "altitude": 12.5, "horizontal_accuracy": 8.25}
ONE = asset("one", "10:00", location=GPS, resources=[resource("r1", "Screenshot Beach.heic")])
TWO = asset("two", "10:05", location={**GPS, "latitude": 52.3677, "longitude": 4.9042}, resources=[resource("r2", "Screenshot Two.heic", local=True)])


def test_end_to_end(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    (tmp_path / "in").mkdir()
    take = lambda assets, hours: crawl(archive.store, snapshot(spark, tmp_path / "in", assets), "lib", "fake", T0, T0 + timedelta(hours=hours)).counters
    c = take([ONE, TWO], 0)
    assert (c["assets_seen"], c["assets_new"], c["resources_seen"], c["queued_for_classify"], c["queued_needs_download"]) == (2, 2, 2, 2, 1)
    t = archive.store.tables()
    ids = {r.local_identifier: r.id for r in t["asset"].collect()}
    assert [r.asset_id for r in archive.search("beach two").collect()] == [ids["two"]]
    rows = archive.timeline("2026-05-27T12:00:00+02:00", "2026-05-27T10:05:00Z").collect()
    assert [(r.asset_id, r.source_type, r.is_precise) for r in rows] == [(ids["one"], 2, True)]
    counts = archive.classify(None)
    assert counts["processed"] == 2
    n = archive.neighbors(ids["one"]).collect()
    assert [(r.target_id, r.score, r.n_reasons) for r in n] == [(ids["two"], 1.0, 6)]
    assert archive.search("screenshot_candidate").count() == 2
    # The same again changes nothing.
    c = take([ONE, TWO], 1)
    assert (c["assets_unchanged"], c["queued_for_classify"]) == (2, 0)
    # A partial snapshot with a changed asset: the other is missing, not deleted.
    c = take([{**ONE, "favorite": True}], 2)
    assert (c["assets_changed"], c["previously_seen_missing"], c["assets_deleted"]) == (1, 1, 0)
    dead = {**ONE, "deleted_at": "2026-06-01T00:00:00Z", "deletion_reason": "user"}
    assert take([dead], 3)["assets_deleted"] == 1
    assert take([{**dead, "deleted_at": "2026-07-01T00:00:00Z"}], 4)["assets_deleted"] == 0
    t = archive.store.tables()
    one = t["asset"].where(F.col("id") == ids["one"]).first()
    assert (one.deleted_at, one.favorite) == ("2026-06-01T00:00:00Z", True)
    assert t["classification_queue"].where(F.col("asset_id") == ids["one"]).first().state == "deleted"
    assert t["asset_resource"].where(F.col("asset_id") == ids["one"]).first().deletion_reason == "parent_asset_deleted"
    with pytest.raises(ArchiveError):
        archive.neighbors(ids["one"])
    c = take([{**ONE, "resources": [resource("r9", "New.heic")]}], 5)
    assert c["assets_restored"] == 1
    t = archive.store.tables()
    assert t["asset"].where(F.col("id") == ids["one"]).first().deleted_at is None
    kept = t["asset_resource"].where(F.col("asset_id") == ids["one"])
    assert (kept.count(), kept.where("deleted_at IS NULL").count()) == (2, 1)
    bundle = archive.open(ids["one"]).first()
    assert len(bundle.asset_resource) == 2 and len(bundle.album_membership) == 1
    assert archive.evidence(ids["one"]).count() >= 5
    assert archive.status()["state"] == "ready"


def test_bad_snapshots_change_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "none"))
    for bad in ([resource("", "a")], [resource("r", "a"), resource("r", "b")]):
        with pytest.raises(ValueError):
            crawl(store, snapshot(spark, tmp_path / "in", [asset("x", "10:00", resources=bad)]), "lib", "fake", T0, T0)
    with pytest.raises(ValueError):
        crawl(store, snapshot(spark, tmp_path / "in", [asset("x", "10:00", deleted_at="2026-06-01T00:00:00Z")]), "lib", "fake", T0, T0)
    assert not (tmp_path / "none").exists()


def test_guards(spark, tmp_path):
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x.txt").write_text("x")
    with pytest.raises(ArchiveError):
        Store(spark, str(tmp_path / "foreign")).init()
    with pytest.raises(ArchiveError):
        Store(spark, str(tmp_path / "absent")).tables()
    archive = Archive(spark, str(tmp_path / "a"))
    assert archive.status()["state"] == "missing"
    for start, end in (("", "2026-01-02T00:00:00Z"), ("2026-01-01", "2026-01-02T00:00:00Z"), ("2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z")):
        with pytest.raises(ValueError):
            archive.timeline(start, end)
    with pytest.raises(ValueError, match="query is required"):
        from assetlens.operators.search import phrases

        phrases("  ")
