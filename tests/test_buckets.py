"""Tables in buckets of the asset's id: a merge rewrites what it touches and carries the rest on."""

from datetime import timedelta

from assetlens.api import Archive
from assetlens.operators.crawl import crawl
from assetlens.schemas import BUCKETED
from assetlens.store import Store
from tests.test_crawl import ONE, T0, asset, resource, snapshot


def test_a_small_snapshot_rewrites_few_buckets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "archive"))
    take = lambda assets, hours: crawl(store, snapshot(spark, tmp_path / "in", assets), "lib", "fake", T0, T0 + timedelta(hours=hours))
    many = [asset(f"a{i}", "10:00", resources=[resource(f"r{i}", f"Name {i}.heic")]) for i in range(80)]
    take(many, 0)
    before = store.check()["tables"]
    assert len(before["asset"]) > 30
    take([{**many[3], "favorite": True}, ONE], 1)
    after = store.check()["tables"]
    for name in ("asset", "asset_resource", "evidence_ref", "classification_queue", "crawl_seen_asset"):
        new = {k for k, v in after[name].items() if before[name].get(k) != v}
        assert 1 <= len(new) <= 2 and set(before[name]) <= set(after[name])
    assert store.table("asset").count() == 81 and store.table("asset").where("favorite").count() == 1
    # One asset is read from one bucket of each table.
    id_ = store.table("asset").where("local_identifier = 'a3'").first().id
    archive = Archive(spark, store.path)
    some = archive._bucket_of(id_)
    assert all(len({f.rsplit("/", 1)[0] for f in some[n].inputFiles()}) <= 1 for n in BUCKETED)
    assert archive.open(id_).first().asset_resource[0].original_filename == "Name 3.heic"
    assert [r.original for r in archive.export_choice(id_).collect()] == ["Name 3.heic"]
    rows = {n: sorted(map(str, store.table(n).collect())) for n in BUCKETED}
    store.rebucket(5)
    assert store.check()["buckets"] == 5 and len(store.check()["tables"]["asset"]) == 5
    assert {n: sorted(map(str, store.table(n).collect())) for n in BUCKETED} == rows
    assert take([{**many[3], "favorite": True}, ONE], 2).counters["assets_unchanged"] == 2
    archive.classify(10)
    assert store.table("asset").count() == 81 and store.vacuum(-1) > 0
    assert {n: sorted(map(str, store.table(n).collect())) for n in ("asset", "asset_resource")} == {n: rows[n] for n in ("asset", "asset_resource")}
