"""Snapshot sources, local media and upgrades, by small cases."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from assetlens.api import Archive
from assetlens.operators.crawl import crawl
from assetlens.schemas import SNAPSHOT_ASSET
from assetlens.sources import library as L
from assetlens.store import ArchiveError, Store

U1, U2 = "11111111-2222-3333-4444-555555555555", "AAAAAAAA-2222-3333-4444-555555555555"
TABLES = {
    "ZASSET": "Z_PK bigint, ZUUID string, ZKIND int, ZKINDSUBTYPE int, ZDATECREATED double, ZMODIFICATIONDATE double, ZADDEDDATE double, ZWIDTH bigint, ZHEIGHT bigint, ZDURATION double, ZFAVORITE int, ZHIDDEN int, ZAVALANCHEUUID string, ZLATITUDE double, ZLONGITUDE double, ZUNIFORMTYPEIDENTIFIER string, ZFILENAME string, ZTRASHEDSTATE int",
    "ZADDITIONALASSETATTRIBUTES": "ZASSET bigint, ZTIMEZONENAME string, ZGPSHORIZONTALACCURACY double, ZORIGINALFILENAME string",
    "ZINTERNALRESOURCE": "Z_PK bigint, ZASSET bigint, ZRESOURCETYPE int, ZCOMPACTUTI string, ZDATALENGTH bigint, ZSTABLEHASH string, ZFINGERPRINT string, ZLOCALAVAILABILITY int, ZREMOTEAVAILABILITY int",
    "ZGENERICALBUM": "Z_PK bigint, ZUUID string, ZTITLE string, ZKIND int, ZTRASHEDSTATE int",
    "Z_33ASSETS": "Z_33ALBUMS bigint, Z_3ASSETS bigint",
}
ROWS = {
    "ZASSET": [(1, U1, 0, 0, 801_655_200.0, None, None, 10, 20, None, 1, 0, None, 52.0, 4.0, "public.heic", "a.heic", 0), (2, U2, 1, 0, 0.0, None, None, 1, 1, 2.5, 0, 0, None, 0.0, 0.0, None, "b.mov", 1), (3, "", 0, 0, 0.0, None, None, 1, 1, None, 0, 0, None, None, None, None, None, 0)],
    "ZADDITIONALASSETATTRIBUTES": [(1, "UTC", 8.25, "orig.heic")],
    "ZINTERNALRESOURCE": [(100, 1, 0, "public.heic", 7, "h", None, 0, 1)],
    "ZGENERICALBUM": [(5, "al", "Trip", 2, 0), (6, "gone", "Bin", 2, 1)],
    "Z_33ASSETS": [(5, 1), (6, 1)],
}


@pytest.fixture
def exported(spark, tmp_path):
    for name, schema in TABLES.items():
        spark.createDataFrame(ROWS[name], schema).write.parquet(str(tmp_path / "lib" / name))
    return str(tmp_path / "lib")


def test_library_tables_make_one_snapshot(spark, exported):
    snap = L.provider("tables").snapshot(spark, exported).first()
    got = {a.local_identifier: a for a in snap.assets}
    assert set(got) == {U1, U2} and (snap.provider, snap.library_path) == ("tables", exported)
    a = got[U1]
    assert (a.media_type, a.creation_date, a.favorite, a.location.horizontal_accuracy, a.deleted_at) == ("image", "2026-05-28T10:00:00Z", True, 8.25, "")
    assert [(r.uti, r.needs_download, r.available_locally) for r in a.resources] == [("public.heic", True, False)]
    assert [(m.album_id, m.album_title) for m in a.albums] == [("al", "Trip")]
    assert (got[U2].location, got[U2].deletion_reason, got[U2].deleted_at) == (None, "trashed", "")


def test_library_tables_are_crawled_asset_by_asset(spark, exported, tmp_path, monkeypatch):
    """The same archive as from the one snapshot row, which isn't made."""
    at, one, rows = datetime(2026, 6, 1, tzinfo=timezone.utc), Archive(spark, str(tmp_path / "one")), Archive(spark, str(tmp_path / "rows"))
    want = crawl(one.store, L.TablesProvider().snapshot(spark, exported), exported, "tables", at, at)
    monkeypatch.setattr(L, "assemble", None)
    got = rows.crawl(exported, "tables", at)
    assert got.counters == want.counters and got.counters["assets_new"] == 2
    for name in ("asset", "asset_resource", "album_membership", "location_observation", "evidence_ref", "classification_queue"):
        assert sorted(map(str, rows.store.table(name).collect())) == sorted(map(str, one.store.table(name).collect())), name
    assert rows.store.table("source_library").first().metadata_json == one.store.table("source_library").first().metadata_json


def test_the_second_provider_says_why_it_was_asked(spark, exported):
    snap = L.provider("auto").snapshot(spark, exported).first()
    assert len(snap.assets) == 2 and "primary_error" in json.loads(snap.metadata)
    with pytest.raises(ValueError, match="unknown provider"):
        L.provider("other")


def test_media_files_and_attachment(spark, tmp_path):
    for path, size in ((f"derivatives/{U1}_1.jpeg", 5), (f"derivatives/{U1}_2.jpeg", 9), (f"originals/{U1}.heic", 50), (f"originals/{U2}.mov", 3), ("originals/none.jpeg", 1)):
        at = tmp_path / path
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(b"x" * size)
    index = L.scan_media(spark, [str(tmp_path / "derivatives"), str(tmp_path / "originals")])
    rows = sorted((r.uuid, r.n, r.path.rsplit("/", 1)[1], r.uti) for r in index.collect())
    assert rows == [(U1, 1, f"{U1}_2.jpeg", "public.jpeg"), (U1, 2, f"{U1}_1.jpeg", "public.jpeg"), (U1, 3, f"{U1}.heic", "public.heic"), (U2, 1, f"{U2}.mov", "com.apple.quicktime-movie")]
    r = {"source_identifier": "r", "type": "photo", "uti": "public.heic", "original_filename": "x", "local_path": "", "availability": "", "file_size": 1, "stable_hash": "", "available_locally": False, "needs_download": True, "metadata": "{}"}
    full = {**r, "local_path": "/there"}
    assets = [{"local_identifier": U1, "media_type": "image", "resources": [full, r]}, {"local_identifier": f"{U1}/L0/001", "media_type": "image", "resources": []}, {"local_identifier": U2, "media_type": "video", "resources": []}, {"local_identifier": "x", "media_type": "image", "resources": [r]}]
    frame = spark.createDataFrame([(json.dumps(a),) for a in assets], "j string").select(F.from_json("j", SNAPSHOT_ASSET).alias("a")).select("a.*")
    got = {a.local_identifier: a.resources for a in L.attach_media(frame, index).collect()}
    assert [(x.local_path.rsplit("/", 1)[-1], x.available_locally, x.needs_download) for x in got[U1]] == [("there", False, True), (f"{U1}_2.jpeg", True, False)]
    assert [(x.source_identifier, x.uti) for x in got[f"{U1}/L0/001"]] == [(f"local_media:{U1}", "public.jpeg")]
    assert got[U2] == [] and [x.local_path for x in got["x"]] == [""]


def test_an_old_archive_is_upgraded_in_one_commit(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([("a", "x", "2026-01-01", "t", "r")], "id string, local_identifier string, deleted_at string, deletion_source string, deletion_reason string").write.parquet(f"{path}/asset/v1")
    spark.createDataFrame([("r", "a")], "id string, asset_id string").write.parquet(f"{path}/asset_resource/v1")
    store = Store(spark, path)
    store._write_meta({"version": 1, "tables": {"asset": "asset/v1", "asset_resource": "asset_resource/v1"}})
    with pytest.raises(ArchiveError, match="needs an upgrade"):
        store.tables()
    store.init()
    r = store.table("asset_resource").first()
    assert (r.deleted_at, r.deletion_source, r.deletion_reason, r.source_identifier) == ("2026-01-01", "t", "parent_asset_deleted", None)
    assert store._pointers() == [1, 2] and store.check()["version"] == 2
    store._write_meta({**store.check(), "version": 99})
    with pytest.raises(ArchiveError, match="newer"):
        store.init()
