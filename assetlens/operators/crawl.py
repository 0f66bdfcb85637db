"""Snapshot merge: a nested snapshot into the archive tables, with deltas, tombstones and provenance.

The per-asset loop of an importer becomes set operations: explode, join with the previous state, classify the delta,
and one keyed merge per table. Duplicates of an asset within a snapshot count once, the last wins.

Several snapshots are merged at once, in one commit, to what merging them in order leaves: an asset's last live row counts,
then the first tombstone after it; each row's delta is that to the row before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import fingerprint, stable_id
from ..functions.scratch import written
from ..functions.times import instant
from ..schemas import key_of
from ..store import ArchiveError, Tables
from .index import Index
from .merge import first_wins, keep_old, last_of_each, merge, take_new
from .migrate import PARENT_DELETED
from .search import asset_documents

TOMB = ("deleted_at", "deletion_source", "deletion_reason")
DELTAS = ("new", "changed", "unchanged")


@dataclass
class CrawlResult:
    provider: str
    snapshot_id: str
    source_library_id: str
    counters: dict[str, int] = field(default_factory=dict)
    database: str = ""

    def fields(self) -> dict:
        """The result as one flat record."""
        return {"database": self.database, "provider": self.provider, "snapshot_id": self.snapshot_id, "source_library_id": self.source_library_id, **self.counters}


class Header(NamedTuple):
    """What a snapshot says besides its assets."""

    photos_version: str | None
    authorization_status: str | None
    metadata: str | None


def iso(at: datetime) -> str:
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ").replace(".000000Z", "Z")


def explode_assets(snapshot: DataFrame) -> DataFrame:
    """One row per asset of the snapshot, with its place in it."""
    return snapshot.select(F.posexplode("assets").alias("ord", "a")).select("ord", "a.*")


def invalid_resources(assets: DataFrame, *also: str) -> DataFrame:
    """Assets with a resource that has no source identifier, or the one of another resource."""
    r = assets.select(*also, "ord", "local_identifier", F.explode("resources").alias("r"))
    sid = T.trim_white(F.coalesce("r.source_identifier", F.lit("")))
    return r.groupBy(*also, "ord", "local_identifier", sid.alias("source_identifier")).agg(F.count("*").alias("n")).where("source_identifier = '' OR n > 1")


def normalize_deletion(assets: DataFrame, provider: str, completed_at: str | Column) -> DataFrame:
    """Tombstone fields trimmed and completed, null for live assets; error says what is wrong with a row."""
    at, source, reason = (T.trim_white(F.coalesce(F.col(c), F.lit(""))) for c in TOMB)
    gone = (at != "") | (source != "") | (reason != "")
    error = F.when(gone & (reason == ""), "tombstone has no deletion reason").when(gone & (at != "") & (instant(at).isNull() | ~at.contains("T")), "tombstone deleted_at is no timestamp")
    return assets.withColumns(
        {
            "error": error,
            "deleted_at": F.when(gone, F.when(at == "", F.lit(completed_at)).otherwise(at)),
            "deletion_source": F.when(gone, F.when(source == "", F.lit(provider)).otherwise(source)),
            "deletion_reason": F.when(gone, reason),
        }
    )


def delta(incoming: DataFrame, seen: DataFrame, assets: DataFrame) -> DataFrame:
    """incoming (asset_id, source_fingerprint, deleted_at) -> also delta, was_deleted, newly_deleted, restored, classify."""
    before = seen.select(F.col("asset_id").alias("_seen"), F.col("source_fingerprint").alias("_before"))
    old = assets.where("deleted_at IS NOT NULL").select(F.col("id").alias("_gone"))
    j = incoming.join(before, F.col("asset_id") == F.col("_seen"), "left").join(old, F.col("asset_id") == F.col("_gone"), "left")
    was = F.col("_seen").isNotNull() & F.col("_gone").isNotNull()
    is_new, same = F.col("_seen").isNull(), F.col("_before") == F.col("source_fingerprint")
    gone = F.col("deleted_at").isNotNull()
    kind = F.when(is_new, "new").when(same, "unchanged").otherwise("changed")
    return j.withColumns({"delta": kind, "was_deleted": was, "newly_deleted": gone & ~was, "restored": ~gone & was, "classify": ~gone & (is_new | ~same | was)}).drop("_seen", "_before", "_gone")


def deltas(incoming: DataFrame, seen: DataFrame, assets: DataFrame) -> DataFrame:
    """delta() for rows of several snapshots (n): each is compared with the asset's row before it, the first with the archive.

    Also live_n, the asset's last live snapshot (-1: none); dead_n, its first tombstone after that; last_n, its last row; deads,
    its tombstones (n, at, source) in order: as many as snapshots at most.
    """
    asset, before = W.partitionBy("asset_id"), W.partitionBy("asset_id").orderBy("n")
    gone, first = F.col("deleted_at").isNotNull(), F.col("_n").isNull()
    rows = delta(incoming, seen, assets).withColumns({"_n": F.lag("n").over(before), "_print": F.lag("source_fingerprint").over(before), "_gone": F.lag("deleted_at").over(before).isNotNull()})
    kind = F.when(first, F.col("delta")).when(F.col("_print") == F.col("source_fingerprint"), "unchanged").otherwise("changed")
    rows = rows.withColumns({"delta": kind, "was_deleted": F.when(first, F.col("was_deleted")).otherwise(F.col("_gone"))})
    was, same = F.col("was_deleted"), F.col("delta") == "unchanged"
    rows = rows.withColumns({"newly_deleted": gone & ~was, "restored": ~gone & was, "classify": ~gone & (~same | was), "live_n": F.coalesce(F.max(F.when(~gone, F.col("n"))).over(asset), F.lit(-1))})
    tomb = F.when(gone, F.struct("n", F.col("deleted_at").alias("at"), F.col("deletion_source").alias("source")))
    ends = {"dead_n": F.min(F.when(gone & (F.col("n") > F.col("live_n")), F.col("n"))).over(asset), "last_n": F.max("n").over(asset), "deads": F.array_sort(F.collect_list(tomb).over(asset))}
    return rows.withColumns(ends).drop("_n", "_print", "_gone")


def merge_assets(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Live rows replace all content and clear the tombstone; a tombstone changes nothing but the tombstone, the first wins."""
    gone = incoming.deleted_at.isNotNull()
    live, dead = incoming.where(~gone), incoming.where(gone)
    content = {c: keep_old for c in existing.columns if c not in keys}
    tomb = {"deleted_at": lambda o, n: F.coalesce(o, n), "deletion_source": first_wins, "deletion_reason": first_wins}
    return merge(merge(existing, live, keys), dead, keys, {**content, **tomb})


def resolve_resource_ids(resources: DataFrame, existing: DataFrame) -> DataFrame:
    """resources (asset_id, source_identifier, position, resource_type, uti, original_filename) -> also id.

    In this order: the row of the same source identifier; the old positional id; an old row without source identifier
    of the same type, uti and name (old and new paired by place, so that each is adopted once); a new id.
    """
    named = existing.where("coalesce(source_identifier, '') <> ''").select("asset_id", "source_identifier", F.col("id").alias("_by_name"))
    named = named.groupBy("asset_id", "source_identifier").agg(F.min("_by_name").alias("_by_name"))
    old = existing.where("coalesce(source_identifier, '') = ''")
    r = resources.join(named, ["asset_id", "source_identifier"], "left")
    legacy = stable_id("asset_resource", F.col("asset_id"), F.lpad(F.col("position").cast("string"), 6, "0"), F.col("resource_type"), F.col("uti"), F.col("original_filename"))
    r = r.withColumn("_legacy", legacy)
    at = old.select(F.col("id").alias("_by_place"), F.col("asset_id").alias("_of"))
    r = r.join(at, (F.col("_legacy") == F.col("_by_place")) & (F.col("asset_id") == F.col("_of")) & F.col("_by_name").isNull(), "left").drop("_of")
    like = ["asset_id", "resource_type", "uti", "original_filename"]
    adopted = r.where("_by_place IS NOT NULL").select(F.col("_by_place").alias("id"))
    free = old.join(adopted, "id", "left_anti").withColumn("_k", F.row_number().over(W.partitionBy(*like).orderBy("id"))).select(*like, "_k", F.col("id").alias("_by_like"))
    open_ = F.col("_by_name").isNull() & F.col("_by_place").isNull()
    r = r.withColumn("_open", open_).withColumn("_k", F.when(F.col("_open"), F.row_number().over(W.partitionBy(*like, "_open").orderBy("position"))))
    r = r.join(free, [*like, "_k"], "left")
    fresh = stable_id("asset_resource", F.col("asset_id"), F.col("source_identifier"))
    return r.withColumn("id", F.coalesce("_by_name", "_by_place", "_by_like", fresh)).drop("_by_name", "_legacy", "_by_place", "_k", "_open", "_by_like")


def merge_resources(existing: DataFrame, incoming: DataFrame, gone_assets: DataFrame) -> DataFrame:
    """Upsert resources, then tombstone all resources of deleted assets (asset_id, deleted_at, deletion_source); the first tombstone wins."""
    dead = incoming.deleted_at.isNotNull()
    content = {c: take_new for c in existing.columns if c != "id"}
    kept = {**{c: keep_old for c in content}, "source_identifier": first_wins, "deleted_at": lambda o, n: F.coalesce(o, n), "deletion_source": first_wins, "deletion_reason": first_wins}
    out = merge(merge(existing, incoming.where(~dead), ("id",), content), incoming.where(dead), ("id",), kept)
    return tombstone_subordinates(out, gone_assets)


def merge_resource_rows(existing: DataFrame, rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """merge_resources() for rows of several snapshots: existing's columns and n; tombstones: asset_id, deads (see deltas).

    A resource's last live row counts, then its asset's first tombstone after that, even one that doesn't list it. One that
    only tombstones list is added as the first of them has it.
    """
    live, dead = rows.where("deleted_at IS NULL"), rows.where("deleted_at IS NOT NULL")
    live = last_of_each(live, ("id",), F.col("n"))
    out = merge(existing, live.select(existing.columns), ("id",))
    since = live.select(F.col("id").alias("_id"), F.col("n").alias("_since"))
    gone = tombstones.select(F.col("asset_id").alias("_asset"), "deads")
    hit = out.join(since, out.id == F.col("_id"), "left").join(gone, out.asset_id == F.col("_asset"), "left")
    hit = hit.withColumn("_t", F.get(F.filter("deads", lambda d: d["n"] > F.coalesce("_since", F.lit(-1))), F.lit(0)))
    fill = {"deleted_at": F.coalesce("deleted_at", "_t.at"), "deletion_source": first_wins(F.col("deletion_source"), F.col("_t.source")), "deletion_reason": first_wins(F.col("deletion_reason"), F.lit(PARENT_DELETED))}
    out = hit.withColumns({c: F.when(F.col("_t").isNull(), F.col(c)).otherwise(v) for c, v in fill.items()}).select(*existing.columns)
    first = last_of_each(dead, ("id",), -F.col("n")).join(live.select("id"), "id", "left_anti")
    kept = {**{c: keep_old for c in existing.columns if c != "id"}, "source_identifier": first_wins}
    return merge(out, first.select(existing.columns), ("id",), kept)


def tombstone_subordinates(resources: DataFrame, gone_assets: DataFrame) -> DataFrame:
    g = gone_assets.select(F.col("asset_id").alias("_of"), F.col("deleted_at").alias("_at"), F.col("deletion_source").alias("_src"))
    j = resources.join(g, resources.asset_id == F.col("_of"), "left")
    hit = F.col("_of").isNotNull()
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return j.withColumns(
        {
            "deleted_at": F.when(hit, F.coalesce("deleted_at", "_at")).otherwise(F.col("deleted_at")),
            "deletion_source": F.when(hit, F.coalesce(blank("deletion_source"), "_src")).otherwise(F.col("deletion_source")),
            "deletion_reason": F.when(hit, F.coalesce(blank("deletion_reason"), F.lit(PARENT_DELETED))).otherwise(F.col("deletion_reason")),
        }
    ).select(*resources.columns)


def requeue(assets: DataFrame, resources: DataFrame, at: str | Column) -> DataFrame:
    """Queue rows of assets (asset_id) to classify: needs a download if a merged live resource does and none has content here."""
    r = resources.where("deleted_at IS NULL").groupBy("asset_id").agg(
        F.bool_or(F.col("available_locally") | (T.trim_white(F.coalesce("local_path", F.lit(""))) != "")).alias("local"), F.bool_or("needs_download").alias("needs")
    )
    j = assets.select("asset_id", F.lit(at).alias("_at") if isinstance(at, str) else at.alias("_at")).join(r, "asset_id", "left")
    needs = F.coalesce(F.col("needs") & ~F.col("local"), F.lit(False))
    return j.select(stable_id("classification_queue", F.col("asset_id")).alias("id"), "asset_id", F.lit("pending").alias("state"), F.lit("metadata_ingested").alias("reason"), needs.alias("needs_download"), F.col("_at").alias("updated_at"))


def missing(seen: DataFrame, library_id: str, snapshot_id: str) -> DataFrame:
    """Rows of the library that this snapshot didn't show. They stay: only tombstones delete."""
    return seen.where((F.col("source_library_id") == library_id) & (F.col("last_seen_snapshot_id") != snapshot_id))


def evidence_rows(rows: DataFrame, kind: str | Column, provider: str, pointer: Column, value: Column, *also: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(stable_id("evidence", F.col("asset_id"), kind, pointer).alias("id"), "asset_id", kind.alias("evidence_kind"), F.lit(provider).alias("source"), pointer.alias("pointer"), value.alias("value_json"), *also)


class Snapshot(NamedTuple):
    """One of the snapshots that are merged at once; n is its place among them."""

    n: int
    header: Header
    started: str
    completed: str


#: Told of a snapshot (n) that isn't merged, and why.
Refuse = Callable[[int, str], None]


def crawl(store, snapshot: DataFrame, library_path: str, provider: str, started_at: datetime, completed_at: datetime | None = None) -> CrawlResult:
    """Merge one snapshot row into the archive and commit all tables at once."""
    head = snapshot.select("photos_version", "authorization_status", "metadata").first()
    header = Header(head.photos_version, head.authorization_status, head.metadata)
    return crawl_assets(store, explode_assets(snapshot), header, library_path, provider, started_at, completed_at)


def crawl_assets(store, assets: DataFrame, header: Header, library_path: str, provider: str, started_at: datetime, completed_at: datetime | None = None) -> CrawlResult:
    """Merge a snapshot given as one row per asset, with its place (ord) in an order in which the last row of a repeated
    identifier counts: no task holds all assets."""
    one = Snapshot(0, header, iso(started_at), iso(completed_at or datetime.now(timezone.utc)))
    return crawl_many(store, assets.withColumn("n", F.lit(0)), [one], library_path, provider)[0]


def crawl_many(store, assets: DataFrame, snapshots: list[Snapshot], library_path: str, provider: str, refuse: Refuse | None = None) -> list[CrawlResult]:
    """Merge snapshots in order of n, in one commit; assets: one row per asset, as for crawl_assets, with the snapshot's n.

    Snapshots are validated before the archive is touched or created. One that is wrong, or in the archive already, is an
    error; with `refuse` it is left out and the others are merged. If another commit changes the tables meanwhile, the merge
    is made again on them. The list of snapshots, and their counters, are on the driver; their assets aren't.
    """
    spark = store.spark
    times = spark.createDataFrame([(s.n, s.completed) for s in snapshots], "n int, completed string")
    flat = written(assets.join(times, "n"), "assets")
    dated = normalize_deletion(flat.where(T.trim_white(F.coalesce("local_identifier", F.lit(""))) != ""), provider, F.col("completed"))
    wrong = {r.n: r.error for r in _errors(flat, dated).collect()}  # one row a snapshot at most
    for n, error in sorted(wrong.items()):
        if refuse is None:
            raise ValueError(error)
        refuse(n, error)
    snapshots = sorted(s for s in snapshots if s.n not in wrong)
    if not snapshots:
        return []
    store.init()
    library = spark.range(1).select(stable_id("source_library", library_path).alias("library")).first().library
    totals = {s.n: dict.fromkeys(("assets_seen", "resources_seen", "album_memberships_seen", "locations_seen"), 0) for s in snapshots}
    found = flat.groupBy("n").agg(
        F.count("*").alias("assets_seen"), _count("greatest(size(resources), 0)").alias("resources_seen"), _count("greatest(size(albums), 0)").alias("album_memberships_seen"), _count("location IS NOT NULL").alias("locations_seen"), digest().alias("digest")
    )
    digests = {}
    for r in found.collect():  # one row a snapshot
        totals[r.n], digests[r.n] = {c: r[c] for c in found.columns if c not in ("n", "digest")}, r.digest
    named_by = spark.createDataFrame([(s.n, s.completed, digests.get(s.n, "0:0:0")) for s in snapshots], "n int, completed string, digest string")
    ids = {r.n: r.id for r in named_by.select("n", stable_id("crawl_snapshot", library, F.col("completed"), F.col("digest")).alias("id")).collect()}
    content = [c for c in dated.columns if c not in ("n", "ord", "error", "completed")]
    named = dated.withColumn("asset_id", stable_id("asset", library, F.col("local_identifier"))).withColumn("source_fingerprint", fingerprint(*[F.col(c) for c in content]))
    named = named.join(spark.createDataFrame([(s.n, ids[s.n]) for s in snapshots], "n int, snapshot_id string"), "n")
    # Each merge, and each further try, starts from here and not from the provider again.
    incoming = written(last_of_each(named, ("n", "asset_id"), F.col("ord")), "incoming")

    def work(t: Tables) -> tuple[dict[int, dict[str, int]], list[int]]:
        known = {r.id for r in t["crawl_snapshot"].where(F.col("id").isin(list(ids.values()))).select("id").collect()}
        new, again = [], []
        for s in snapshots:
            (again if ids[s.n] in known else new).append(s)
            known.add(ids[s.n])
        if again and refuse is None:
            raise ArchiveError("this snapshot is in the archive already")
        counters = {}
        for some in _together(t, incoming, new):
            counters |= _merge_snapshots(t, incoming.where(F.col("n").isin([s.n for s in some])), library, library_path, some, ids, provider, totals)
        return counters, [s.n for s in again]

    counters, again = store.transact(work)
    for n in again:
        refuse(n, "this snapshot is in the archive already")
    return [CrawlResult(provider, ids[n], library, {**totals[n], **c}, store.path) for n, c in sorted(counters.items())]


def _errors(flat: DataFrame, dated: DataFrame) -> DataFrame:
    """n, error: what is wrong with each snapshot, if anything is. Resources come before tombstones, else the first asset."""
    quoted = F.concat(F.lit("asset '"), F.coalesce("local_identifier", F.lit("")), F.lit("'"))
    what = F.when(F.col("source_identifier") == "", " has a resource without a stable source identifier").otherwise(F.concat(F.lit(" has duplicate resource source identifier '"), "source_identifier", F.lit("'")))
    bad = invalid_resources(flat.withColumnRenamed("n", "_of"), "_of").select(F.col("_of").alias("n"), F.struct(F.lit(0).alias("kind"), "ord", F.concat(quoted, what).alias("error")).alias("e"))
    tomb = dated.where("error IS NOT NULL").select("n", F.struct(F.lit(1).alias("kind"), "ord", F.concat(quoted, F.lit(": "), "error").alias("error")).alias("e"))
    return bad.union(tomb).groupBy("n").agg(F.min("e").alias("e")).select("n", "e.error")


def digest() -> Column:
    """Of the assets' places and names: sums of hashes, so that no task sees them all."""
    at = (F.col("ord").cast("string"), F.coalesce("local_identifier", F.lit("")))
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *at).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), total(1), total(2))


def _count(condition: str) -> Column:
    return F.coalesce(F.sum(F.expr(condition).cast("bigint")), F.lit(0))


def _together(t: Tables, incoming: DataFrame, snapshots: list[Snapshot]) -> list[list[Snapshot]]:
    """All snapshots at once, or one after another while stored resources of their assets lack source identifiers: those
    of old archives are adopted by place, which depends on what the snapshots before have adopted."""
    if len(snapshots) > 1:
        old = t.part("asset_resource", t.touched(incoming)).where("coalesce(source_identifier, '') = ''")
        if not old.join(incoming, "asset_id", "left_semi").isEmpty():
            return [[s] for s in snapshots]
    return [snapshots] if snapshots else []


def _merge_snapshots(t: Tables, incoming: DataFrame, library: str, library_path: str, snapshots: list[Snapshot], ids: dict[int, str], provider: str, totals: dict[int, dict[str, int]]) -> dict[int, dict[str, int]]:
    """Put new versions of the tables that snapshots change; the counters of each. queued_needs_download counts the assets
    whose row in the queue is the snapshot's."""
    spark = incoming.sparkSession
    touched = t.touched(incoming)
    old = {name: t.latest_part(name, touched) for name in ("crawl_seen_asset", "asset", "asset_resource", "album_membership", "location_observation", "evidence_ref", "classification_queue")}
    rows = written(deltas(incoming, old["crawl_seen_asset"].where(F.col("source_library_id") == library), old["asset"]), "delta")

    asset_rows = rows.where("n = live_n OR n = dead_n").withColumns({"id": F.col("asset_id"), "source_library_id": F.lit(library), "metadata_json": F.coalesce("metadata", F.lit("{}"))})
    assets = t.put("asset", merge_assets(old["asset"], asset_rows.select(old["asset"].columns)), touched)
    res = rows.select("n", "asset_id", "local_identifier", *TOMB, F.posexplode("resources").alias("position", "r"))
    res = res.select(
        "n", "asset_id", "local_identifier", "deleted_at", "deletion_source", F.when(F.col("deleted_at").isNotNull(), PARENT_DELETED).alias("deletion_reason"), "position",
        T.trim_white(F.col("r.source_identifier")).alias("source_identifier"), F.col("r.type").alias("resource_type"), "r.uti", "r.original_filename", "r.local_path", "r.availability", "r.file_size", F.col("r.stable_hash").alias("sha256"),
        "r.available_locally", "r.needs_download", F.coalesce("r.metadata", F.lit("{}")).alias("metadata_json"),
    )
    of = ("asset_id", "source_identifier")
    found = resolve_resource_ids(last_of_each(res, of, -F.col("n")), old["asset_resource"]).select(*of, "id")
    res = written(res.join(found, [*of]), "resources")
    tombstones = rows.where("n = last_n AND size(deads) > 0").select("asset_id", "deads")
    resources = t.put("asset_resource", merge_resource_rows(old["asset_resource"], res.select("n", *old["asset_resource"].columns), tombstones), touched)
    here = rows.where("deleted_at IS NULL")
    albums = here.select("n", "asset_id", F.explode("albums").alias("m")).select("n", "asset_id", "m.*")
    albums = albums.withColumn("id", stable_id("album_membership", F.col("asset_id"), F.col("album_id")))
    albums = last_of_each(albums, ("id",), F.col("n"), F.col("album_title"), F.col("album_kind"))
    members = t.put("album_membership", merge(old["album_membership"], albums.select(old["album_membership"].columns), ("id",)), touched)
    places = last_of_each(here.where("location IS NOT NULL").select("n", "asset_id", "local_identifier", "location"), ("asset_id",), F.col("n")).select("n", "asset_id", "local_identifier", "location.*")
    loc = places.select(stable_id("location_observation", F.col("asset_id"), F.col("local_identifier")).alias("id"), "asset_id", "latitude", "longitude", "altitude", "horizontal_accuracy", F.lit(provider).alias("source"), stable_id("evidence", F.col("asset_id"), "location", F.col("local_identifier")).alias("evidence_id"))
    t.put("location_observation", merge(old["location_observation"], loc, ("id",)), touched)

    dead = F.col("deleted_at").isNotNull()
    pointer = F.concat(F.lit("asset:"), F.col("local_identifier"))
    tail = F.when(dead, F.concat(F.lit("/tombstone:"), F.col("deleted_at"))).otherwise("")
    meta = F.to_json(F.struct("media_type", "media_subtypes", "creation_date", "modification_date", "favorite", "hidden", "width", "height", *TOMB))
    evidence = evidence_rows(rows, F.when(dead, "asset_tombstone").otherwise("asset_metadata"), provider, F.concat(pointer, tail), meta, "n")
    of_res = F.to_json(F.struct("availability", "available_locally", "needs_download", "file_size", "sha256", "local_path"))
    evidence = evidence.union(evidence_rows(res, F.when(dead, "asset_resource_tombstone").otherwise("asset_resource"), provider, F.concat(pointer, F.lit("/resource:"), F.col("id"), tail), of_res, "n"))
    evidence = evidence.union(evidence_rows(albums, "album_membership", provider, F.concat(F.lit("album:"), F.col("album_id")), F.to_json(F.struct("album_id", "album_title", "album_kind")), "n"))
    spots = places.select(stable_id("evidence", F.col("asset_id"), "location", F.col("local_identifier")).alias("id"), "asset_id", F.lit("location").alias("evidence_kind"), F.lit(provider).alias("source"), F.concat(pointer, F.lit("/location")).alias("pointer"), F.to_json(F.struct("latitude", "longitude", "altitude", "horizontal_accuracy")).alias("value_json"), "n")
    evidence = last_of_each(evidence.union(spots), ("id",), F.col("n"), F.col("value_json"))
    t.put("evidence_ref", merge(old["evidence_ref"], evidence.select(old["evidence_ref"].columns), ("id",)), touched)

    index = Index(t, "asset_documents")
    changed = rows.where("n = last_n").select(F.col("asset_id").alias("id"))
    if index.exists:
        only = lambda df, c: df.join(changed.select(F.col("id").alias(c)), c, "left_semi")
        index.update(changed, asset_documents(only(assets, "id"), only(resources, "asset_id"), only(members, "asset_id")))
    else:
        index.update(None, asset_documents(t.latest("asset"), t.latest("asset_resource"), t.latest("album_membership")))

    events = last_of_each(rows.where(F.col("classify") | dead).select("asset_id", "n", "completed", dead.alias("gone")), ("asset_id",), F.col("n"))
    queued = written(requeue(events.where("NOT gone"), resources, F.col("completed")), "queued")
    retired = events.where("gone").select(stable_id("classification_queue", F.col("asset_id")).alias("id"), "asset_id", F.lit("deleted").alias("state"), F.lit(PARENT_DELETED).alias("reason"), F.lit(False).alias("needs_download"), F.col("completed").alias("updated_at"))
    t.put("classification_queue", merge(old["classification_queue"], queued.union(retired), key_of("classification_queue"), {"id": keep_old}), touched)
    ends = rows.groupBy("asset_id").agg(*[F.min_by("snapshot_id", "n").alias("first_seen_snapshot_id"), *[F.max_by(c, "n").alias(a) for c, a in (("snapshot_id", "last_seen_snapshot_id"), ("source_fingerprint", "source_fingerprint"), ("completed", "last_seen_at"))]])
    t.put("crawl_seen_asset", merge(old["crawl_seen_asset"], ends.withColumn("source_library_id", F.lit(library)), key_of("crawl_seen_asset"), {"first_seen_snapshot_id": keep_old}), touched)

    tally = rows.groupBy("n").agg(
        F.count("*").alias("rows"), *[_count(f"delta = '{d}'").alias(f"assets_{d}") for d in DELTAS], _count("newly_deleted").alias("assets_deleted"), _count("restored").alias("assets_restored"), _count("classify").alias("queued_for_classify")
    )
    by_n = {r.n: r.asDict() for r in tally.collect()}  # one row a snapshot
    down = dict(queued.where("needs_download").join(events, "asset_id").groupBy("n").count().collect())
    known = t.latest("crawl_seen_asset").where(F.col("source_library_id") == library).count() - sum(c["assets_new"] for c in by_n.values())
    counters: dict[int, dict[str, int]] = {}
    for s in snapshots:
        c = by_n.get(s.n, dict.fromkeys(tally.columns, 0))
        known += c["assets_new"]
        counters[s.n] = {**{k: v for k, v in c.items() if k not in ("n", "rows")}, "queued_needs_download": down.get(s.n, 0), "previously_seen_missing": known - c["rows"]}

    last = snapshots[-1]
    said = {"provider": provider, "authorization_status": last.header.authorization_status, "snapshot_metadata": last.header.metadata}
    meta_json = json.dumps({k: v for k, v in said.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)
    lib = spark.createDataFrame([(library, library_path, f"archive:crawl_snapshot/{ids[last.n]}", last.completed, last.header.photos_version, meta_json)], t.latest("source_library").schema)
    t.put("source_library", merge(t.latest("source_library"), lib, ("id",)))
    sizes = ("assets_seen", "resources_seen", "album_memberships_seen", "locations_seen")
    snaps = spark.createDataFrame([(ids[s.n], library, s.started, s.completed, provider, *[totals[s.n][c] for c in sizes]) for s in snapshots], t.latest("crawl_snapshot").schema)
    t.put("crawl_snapshot", t.latest("crawl_snapshot").union(snaps))
    cursor = spark.createDataFrame([(provider, "source_library", library, ids[last.n], last.completed)], t.latest("sync_state").schema)
    t.put("sync_state", merge(t.latest("sync_state"), cursor, key_of("sync_state")))
    return counters
