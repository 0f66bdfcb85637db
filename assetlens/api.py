"""The archive as an object: one method for each thing that can be asked of it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify, detail, evaluation, neighbors, place, place_card, place_run, search, status, timeline
from .operators.crawl import CrawlResult, Header, crawl, crawl_assets
from .sources.library import TablesProvider
from .sources.library import provider as provider_of
from .schemas import BUCKETED
from .store import ArchiveError, Store

VERSION = "0.1.0"
CAPABILITIES = ("init", "status", "crawl", "classify", "search", "timeline", "open", "evidence", "neighbors", "export", "place-context", "place-card", "place-backfill", "eval-card")


def manifest() -> dict:
    """What the engine can do, and what it doesn't: nothing leaves the cluster unless a provider or model is injected."""
    return {"name": "assetlens", "version": VERSION, "capabilities": list(CAPABILITIES), "privacy": {"network": "none", "providers": "injected"}}


class Archive:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def init(self) -> dict:
        self.store.init()
        return {"database": self.store.path}

    def status(self) -> dict:
        if not self.store.exists():
            return {"state": "missing", "counts": [], "warnings": []}
        return {"state": "ready", "bytes": self.store.size(), **status.summary(self.store.tables())}

    def crawl(self, library_path: str, provider: str = "auto", at: datetime | None = None) -> CrawlResult:
        started = at or datetime.now(timezone.utc)
        source = provider_of(provider)
        if isinstance(source, TablesProvider):
            return crawl_assets(self.store, source.assets(self.spark, library_path), Header("", "", "{}"), library_path, provider, started, at)
        snapshot = source.snapshot(self.spark, library_path)
        name = snapshot.select("provider").first()[0] or provider
        return crawl(self.store, snapshot, library_path, name, started, at)

    def classify(self, limit: int | None = 100, with_model: bool = False, call: classify.Call | None = None, model_id: str = "local", prompt_version: str = "v1") -> dict:
        return {"database": self.store.path, "limit": limit or 0, **classify.drain(self.store, with_model, limit, call, model_id, prompt_version)}

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.indexed_search(self.store.tables(), query, limit)

    def timeline(self, start: str, end: str, include_unlocated: bool = False) -> DataFrame:
        timeline.bounds(start, end)  # arguments are checked before the archive is opened
        return timeline.timeline(self.store.tables(), start, end, include_unlocated)

    def _bucket_of(self, asset_id: str) -> dict[str, DataFrame]:
        """The tables, those in buckets with the bucket of one asset alone."""
        t = self.store.tables()
        touched = t.touched(self.spark.createDataFrame([(asset_id,)], "asset_id string"))
        return {name: t.part(name, touched) if name in BUCKETED else t[name] for name in t}

    def open(self, asset_id: str) -> DataFrame:
        if not asset_id.strip():
            raise ValueError("id is required")
        found = detail.bundles(self._bucket_of(asset_id.strip()), asset_id.strip())
        if found.isEmpty():
            raise ArchiveError(f"asset not found: {asset_id}")
        return found

    def evidence(self, row_id: str) -> DataFrame:
        if not row_id.strip():
            raise ValueError("row id is required")
        ids = self.spark.createDataFrame([(row_id.strip(),)], "row_id string")
        return detail.evidence(self.store.tables(), ids).drop("row_id").orderBy("evidence_kind", "id")

    def neighbors(self, asset_id: str, limit: int = 20) -> DataFrame:
        if not asset_id.strip():
            raise ValueError("id is required")
        t = self.store.tables()
        if classify.live(t["asset"]).where(F.col("id") == asset_id.strip()).isEmpty():
            raise ArchiveError(f"asset not found: {asset_id}")
        return neighbors.neighbors(t, limit, asset_id.strip()).orderBy("rank")

    def export_choice(self, asset_id: str) -> DataFrame:
        return detail.export_choice(self._bucket_of(asset_id)["asset_resource"].where(F.col("asset_id") == asset_id))

    def backfill_keys(self) -> DataFrame:
        t = self.store.tables()
        return place.indexed_keys(place.backfill_keys(t["asset"], t["location_observation"]))

    @staticmethod
    def place_cards(results: DataFrame, result: str = "result") -> DataFrame:
        return results.withColumn("card", place_card.render(F.col(result)))

    def place_context(self, documents: DataFrame, cache: str, lookup: place_run.Lookup, radius: float = place_run.RADIUS, **pace) -> DataFrame:
        """Place results of input documents (a column of JSON text named value)."""
        read = documents.select(place.parse_input(F.col("value")).alias("p")).select("p.*").withColumnRenamed("accuracy_meters", "accuracy")
        return place_run.run_places(read, cache, lookup, radius, **pace)

    def place_backfill(self, out: str, lookup: place_run.Lookup, **pace) -> dict:
        t = self.store.tables()
        return place_run.backfill(t["asset"], t["location_observation"], out, lookup, **pace)

    def eval_card(self, out: str, models: list[str], call: evaluation.Call | None = None, **options) -> dict:
        """An evaluation of the archive's images that are on this file system."""
        t = self.store.tables()
        here = classify.live(t["asset_resource"]).where("available_locally AND trim(local_path) <> ''")
        originals = here.groupBy("asset_id").agg(F.min_by("local_path", F.struct("resource_type", "id")).alias("path"))
        return evaluation.run(t["asset"], originals, originals.limit(0), out, models, call, **options)
