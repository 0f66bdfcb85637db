"""The maintained index: equal to a full search after every change, only changed documents tokenized, blocks skipped."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from assetlens.api import Archive
from assetlens.operators import index as ix
from assetlens.operators import search as S
from assetlens.operators.crawl import crawl
from assetlens.operators.index import Index
from assetlens.store import Store
from tests.test_crawl import ONE, T0, TWO, asset, resource, snapshot

WORDS = ["beach", "menu", "trip", "sunset", "blue", "café", "x1", "long-tail", "rare"]


def full(docs, query, limit):
    rows = S.bm25(docs, query, ix.COLUMNS).select("id", "rank").orderBy("rank", "id").limit(limit).collect()
    return [(r.id, round(r.rank, 9)) for r in rows]


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()) and [(k, t, b) for k, (t, b) in docs.items()], "id string, title string, body string")


@pytest.mark.parametrize("block,first", [(128, 64), (1, 2)])
def test_updates_against_a_full_search(spark, tmp_path, monkeypatch, block, first):
    monkeypatch.setattr(ix, "BLOCK", block)
    monkeypatch.setattr(ix, "FIRST", first)
    rng = random.Random(block)
    store = Store(spark, str(tmp_path / "a"))
    store.init()
    docs = {}
    for step in range(3):
        changed = {f"d{rng.randrange(150)}" for _ in range(120 if step == 0 else 25)}
        for k in changed:
            if k in docs and rng.random() < 0.3:
                del docs[k]
            elif rng.random() < 0.9:
                docs[k] = (rng.choice(WORDS), " ".join(rng.choices(WORDS, [9, 8, 5, 4, 3, 2, 2, 2, 1], k=rng.choice([1, 3, 10, 60]))))
        t = store.tables()
        index = Index(t, "asset_documents")
        before = {r.id: r.fp for r in index.alive(index.part("docs")).collect()}
        ids = spark.createDataFrame([(k,) for k in changed], "id string")
        now = frame(spark, docs)
        made = index.update(ids if step else None, now.join(ids, "id", "left_semi") if step else now)
        store.commit({}, t)
        index = Index(store.tables(), "asset_documents")
        after = {r.id: r.fp for r in index.alive(index.part("docs")).collect()}
        assert set(after) == set(docs) and made == sum(before.get(k) != v for k, v in after.items())
        assert (index.documents, index.tokens) == (len(docs), now.select(F.sum(F.size(S.T.search_tokens(F.col("title"))) + F.size(S.T.search_tokens(F.col("body"))))).first()[0])
    sizes = [s["docs"] for s in index.segments]
    assert all(a >= ix.RATIO * b for a, b in zip(sizes, sizes[1:]))
    skipped = 0
    for query, limit in (("beach", 5), ("menu beach", 5), ("long-tail", 20), ("rare", 3), ("beach beach trip", 7), ("none", 5), ("beach none", 5)):
        counts = {}
        got = [(r.id, round(r.rank, 9)) for r in index.best(query, limit, counts=counts).collect()]
        assert got == full(now, query, limit), query
        skipped += counts.get("all", 0) - counts.get("read", 0)
    assert skipped > 0 or block == 128


def test_the_archive_keeps_its_indexes(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    archive = Archive(spark, str(tmp_path / "archive"))
    take = lambda assets, hours: crawl(archive.store, snapshot(spark, tmp_path / "in", assets), "lib", "fake", T0, T0 + timedelta(hours=hours))
    more = [asset(f"m{i}", f"1{i}:00", resources=[resource(f"s{i}", f"Beach menu {i}.heic", local=True)]) for i in range(5)]
    made = []
    real = Index.update
    monkeypatch.setattr(Index, "update", lambda self, ids, docs: made.append((self.name, real(self, ids, docs))))

    def same():
        for query in ("beach", "two.heic", "screenshot_candidate", "geometry"):
            key = lambda rows: [(r.asset_id, r.hit_type, r.observation_id, round(r["rank"], 9), r.snippet) for r in rows.collect()]
            assert key(archive.search(query)) == key(S.search(archive.store.tables(), query)), query

    take([ONE, TWO, *more], 0)
    archive.classify(None)
    same()
    dead = {**TWO, "deleted_at": "2026-06-01T00:00:00Z", "deletion_reason": "user"}
    take([{**ONE, "burst_identifier": "b9"}, dead, *more], 1)
    same()
    assert made[:3] == [("asset_documents", 7), ("observation_documents", made[1][1]), ("asset_documents", 1)]
    take([{**TWO, "resources": [resource("r7", "Two again.heic")]}], 2)  # restored
    archive.classify(None)
    same()
    assert made[3] == ("asset_documents", 1) and 0 < made[4][1] < made[1][1]


def test_a_first_index_joins_and_writes_no_texts(spark, tmp_path, monkeypatch):
    """Nothing is compared with an index that isn't there; blocks are those of the postings, without another exchange."""
    names = []
    real = ix.written
    monkeypatch.setattr(ix, "written", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(ix, "BLOCK", 1)
    store = Store(spark, str(tmp_path / "a"))
    store.init()
    rng = random.Random(3)
    docs = frame(spark, {f"d{i}": (rng.choice(WORDS), " ".join(rng.choices(WORDS, k=rng.choice([0, 5, 40])))) for i in range(90)} | {"none": (None, None)})
    t = store.tables()
    index = Index(t, "asset_documents")
    assert index.update(None, docs) == 91 and names == ["tokens"]
    got = sorted(map(str, index.part("blocks").collect()))
    want = index.part("postings").groupBy("term", "block", "seq").agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("dl").alias("least"))
    assert len(got) > 100 and got == sorted(map(str, want.select(index.part("blocks").columns).collect()))
    assert index.update(None, docs) == 0 and names == ["tokens", "documents", "tokens"]


def test_an_update_compares_only_the_documents_it_names(spark, tmp_path, monkeypatch):
    """Others are left where they are by a bitmap, with their terms, and not exchanged."""
    seen = []
    real = ix.written
    monkeypatch.setattr(ix, "written", lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    store = Store(spark, str(tmp_path / "a"))
    store.init()
    docs = frame(spark, {f"d{i}": ("menu", f"beach x{i}") for i in range(40)})
    t = store.tables()
    index = Index(t, "asset_documents")
    index.update(None, docs)
    some = docs.where("id IN ('d1', 'd2')")
    assert index.update(some, some.withColumn("body", F.lit("blue"))) == 2
    assert "bitmap_construct_agg" in dict(seen)["documents"] and index.documents == 40
