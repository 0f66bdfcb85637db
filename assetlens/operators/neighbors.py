"""Scored neighbors: six kinds of reason, cut per reason, then merged per pair.

Everything works on all sources at once; one source is a filter. A kind whose order of targets doesn't depend on the
source keeps, of each group, only the targets that can still be among the first 4 * limit of any source, as one sorted list
of the group. Each source meets the list of its group and leaves itself out, so its places are known without any exchange
of pairs; only sources of several groups have their pairs ranked. Neighbors in time are found within blocks of the
order of time (`instants`); neighbors in place once for each place that has assets, of which only as many first ones stay,
through cells that get smaller where places are dense.

The best of all kinds are chosen where the lists of a source's groups meet, without rows of pairs (`meeting`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.scratch import written
from ..functions.times import julian_day, seconds_apart
from . import meeting
from .classify import live
from .instants import nearest_instants
from .place_tree import finite, nearest
from .range_join import in_order, within_1d, within_2d

LIMIT, MOST = 20, 100
#: Seconds and degrees within which assets are near, and metres of a degree.
TIME_WINDOW, DEGREES, METRES = 3600.0, 0.01, 111000.0
#: Cells a little wider than the windows, because the exact test is in doubles.
TIME_CELL, DEGREE_CELL = 3601.0, 0.0101

CANDIDATE = ("source_id", "target_id", "creation_date", "ord", "type", "method", "weight", "detail", "evidence_ids", "k1")


def clamp(limit: int) -> int:
    return LIMIT if limit <= 0 else min(limit, MOST)


def _rows(df: DataFrame, ord_: int, type_: str, method: str, weight: Column, detail: Column, evidence: list[Column], k1: Column) -> DataFrame:
    ids = F.filter(F.array(*evidence), lambda e: e.isNotNull() & (e != ""))
    if len(evidence) == 2:
        one, two = evidence
        ids = F.when((F.coalesce(one, F.lit("")) != "") & (F.coalesce(two, F.lit("")) != ""), F.array(one, two)).otherwise(ids)
    return df.select(
        "source_id", "target_id", "creation_date", F.lit(ord_).alias("ord"), F.lit(type_).alias("type"), F.lit(method).alias("method"), weight.cast("double").alias("weight"), detail.alias("detail"), ids.alias("evidence_ids"), k1.cast("double").alias("k1"),
        *(["pos"] if "pos" in df.columns else []),
    )


def _few_targets(df: DataFrame, group: list[str], most: int | None, *order: str) -> DataFrame:
    if most is None:
        return df
    w = W.partitionBy(*group).orderBy(*(order or ("creation_date", "target_id")))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1).drop("_n")


def _lists(t: DataFrame, group: list[str], most: int, *item: str) -> DataFrame:
    """The first targets of each group as one list `best`, in the order of the columns `item`."""
    return _few_targets(t, group, most, *item[:3]).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*item))).alias("best"))


def _others(s: DataFrame, lists: DataFrame, group: list[str], most: int) -> DataFrame:
    """Each source with the first targets of its group's list but itself, and their places from 1."""
    met = s.join(lists, group)
    others = F.slice(F.filter("best", lambda x: x["target_id"] != F.col("source_id")), 1, most)
    pairs = met.select(*s.columns, F.posexplode(others).alias("_at", "x")).select(*s.columns, "x.*", (F.col("_at") + 1).alias("pos"))
    return pairs.where(F.array_contains("keep", F.col("ti"))) if "keep" in s.columns and "ti" in pairs.columns else pairs


def _ranked(s: DataFrame, lists: DataFrame, group: list[str], most: int, k1: str, detail: Column | None = None) -> DataFrame:
    """_others for sources that may be in several groups: those alone have their pairs ranked over all of them. Without
    detail, a pair counts once."""
    fields = [c for c in s.columns if c != "source_id"]
    held = s.groupBy("source_id").agg(F.collect_list(F.struct(*fields)).alias("_in"))
    once = _others(held.where(F.size("_in") == 1).select("source_id", F.inline("_in")), lists, group, most)
    more = _others(held.where(F.size("_in") > 1).select("source_id", F.inline("_in")).drop("keep"), lists, group, most).drop("pos")
    more = more.withColumn("_detail", F.lit("") if detail is None else detail)
    if detail is None:
        more = more.dropDuplicates(["source_id", "target_id"])
    w = W.partitionBy("source_id").orderBy(k1, "creation_date", "target_id", "_detail")
    more = more.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).drop("_detail")
    if "keep" in s.columns:
        more = more.join(s.select("source_id", "keep").distinct(), "source_id").where(F.array_contains("keep", F.col("ti")))
    return once.unionByName(more.select(*once.columns))


def _metadata_evidence(asset_id: str, local: str) -> Column:
    return stable_id("evidence", F.col(asset_id), "asset_metadata", F.concat(F.lit("asset:"), F.col(local)))


class Scope:
    """Which sources count: all (of), those of a frame (source_id, and `keep`, numbers of the targets that count), or one
    id, for which no group has to be cut. bare: only what weights need, no evidence, and hashes instead of details."""

    def __init__(self, of: DataFrame | None = None, one: str | None = None, bare: bool = False):
        self.of, self.one, self.bare = of, one, bare

    def sources(self, s: DataFrame) -> DataFrame:
        if self.one is not None:
            return F.broadcast(s.where(F.col("source_id") == self.one))
        return s if self.of is None else s.join(self.of, "source_id")

    def detail(self, text: Column, *parts: Column | str) -> Column:
        return F.xxhash64(*parts) if self.bare else text

    def evidence(self, e: Column) -> Column:
        return F.lit("") if self.bare else e


ALL = Scope()


def _targets(assets: DataFrame) -> DataFrame:
    """Live assets as targets, with their number ti where they have one."""
    return live(assets).select(F.col("id").alias("target_id"), "creation_date", *_number(assets))


def _number(assets: DataFrame) -> list[str]:
    return ["ti"] if "ti" in assets.columns else []


def same_burst(assets: DataFrame, most: int | None = None, scope: Scope = ALL) -> DataFrame:
    a = live(assets).where(F.trim("burst_identifier") != "").withColumn("e", scope.evidence(_metadata_evidence("id", "local_identifier")))
    s = scope.sources(a.select(F.col("id").alias("source_id"), F.col("burst_identifier").alias("b"), F.col("e").alias("se")))
    t = a.select(F.col("id").alias("target_id"), F.col("burst_identifier").alias("b"), "creation_date", F.col("e").alias("te"), F.lit(0.0).alias("k1"), *_number(assets))
    pairs = s.join(t, "b").where("source_id <> target_id") if most is None else _others(s, _lists(t, ["b"], most, "k1", "creation_date", "target_id", "te", *_number(assets)), ["b"], most)
    detail = scope.detail(F.lit('{"burst_identifier_present":true}'), F.lit(0))
    return _rows(pairs, 1, "same_burst", "asset.burst_identifier", F.lit(0.95), detail, [F.col("se"), F.col("te")], F.lit(0))


def same_album(assets: DataFrame, albums: DataFrame, most: int | None = None, scope: Scope = ALL) -> DataFrame:
    """One row for each shared album."""
    ref = lambda c: scope.evidence(stable_id("evidence", F.col(c), "album_membership", F.concat(F.lit("album:"), F.col("album_id"))))
    s = scope.sources(albums.select(F.col("asset_id").alias("source_id"), "album_id", "album_title")).withColumn("se", ref("source_id"))
    t = albums.select(F.col("asset_id").alias("target_id"), "album_id")
    detail = scope.detail(F.to_json(F.struct("album_id", "album_title")), "album_id", "album_title")
    if most is None:
        pairs = s.join(t, "album_id").where("source_id <> target_id").join(_targets(assets), "target_id").withColumn("te", ref("target_id"))
    else:
        t = t.join(_targets(assets), "target_id").withColumn("te", ref("target_id")).withColumn("k1", F.lit(0.0))
        pairs = _ranked(s, _lists(t, ["album_id"], most, "k1", "creation_date", "target_id", "te", *_number(assets)), ["album_id"], most, "k1", detail)
    return _rows(pairs, 2, "same_album", "album_membership.album_id", F.lit(0.8), detail, [F.col("se"), F.col("te")], F.lit(0))


def same_hash(assets: DataFrame, resources: DataFrame, most: int | None = None, scope: Scope = ALL) -> DataFrame:
    r = live(resources).where(F.trim("sha256") != "").select("asset_id", "sha256").distinct()
    s = scope.sources(r.select(F.col("asset_id").alias("source_id"), "sha256"))
    t = r.select(F.col("asset_id").alias("target_id"), "sha256")
    if most is None:
        pairs = s.join(t, "sha256").where("source_id <> target_id").select("source_id", "target_id").distinct().join(_targets(assets), "target_id")
    else:
        t = t.join(_targets(assets), "target_id").withColumn("k1", F.lit(0.0))
        pairs = _ranked(s, _lists(t, ["sha256"], most, "k1", "creation_date", "target_id", *_number(assets)), ["sha256"], most, "k1")
    return _rows(pairs, 3, "same_resource_hash", "asset_resource.sha256", F.lit(1.0), scope.detail(F.lit('{"hash_present":true}'), F.lit(0)), [], F.lit(0))


def nearby_time(assets: DataFrame, most: int | None = None, scope: Scope = ALL) -> DataFrame:
    a = live(assets).withColumn("jd", F.col("jd") if "jd" in assets.columns else julian_day(F.col("creation_date"))).where("jd IS NOT NULL")
    a = a.withColumn("e", scope.evidence(_metadata_evidence("id", "local_identifier")))
    s = scope.sources(a.select(F.col("id").alias("source_id"), F.col("e").alias("se"), F.col("jd").alias("sj")))
    t = a.select(F.col("id").alias("target_id"), F.col("e").alias("te"), F.col("jd").alias("tj"), "creation_date", *_number(assets))
    if most is None:
        pairs = within_1d(s.withColumn("ss", F.col("sj") * 86400.0), t.withColumn("ts", F.col("tj") * 86400.0), "ss", "ts", TIME_CELL, seconds_apart(F.col("sj"), F.col("tj")) <= TIME_WINDOW)
        pairs = pairs.withColumn("seconds", seconds_apart(F.col("sj"), F.col("tj"))).where("source_id <> target_id")
    else:
        # Of one instant, its first targets. An instant of more than a list holds has no others in it.
        first = _few_targets(t, ["tj"], most + 1)
        first = in_order(first.withColumn("over", F.count("*").over(W.partitionBy("tj")) > most + 1), "tj", "creation_date", "target_id")
        crowds = first.where("over").select(F.col("tj").alias("sj"), F.lit(0.0).alias("seconds"), "creation_date", "target_id", "te", *_number(assets))
        pairs = _others(s, _lists(crowds, ["sj"], most, "seconds", "creation_date", "target_id", "te", *_number(assets)), ["sj"], most)
        if scope.of is not None:
            first = first.join(scope.of.withColumnRenamed("source_id", "target_id"), "target_id", "left")
        apart = nearest_instants(first, most, TIME_WINDOW)
        pairs = pairs.select(apart.columns).union(apart)
    weight = F.when(F.col("seconds") <= 60, 0.75).when(F.col("seconds") <= 600, 0.65).otherwise(0.45)
    detail = scope.detail(F.to_json(F.struct(F.round("seconds", 3).alias("seconds_apart"), F.lit(3600).alias("window_seconds"))), F.lit(0))
    return _rows(pairs, 4, "nearby_time", "asset.creation_date", weight, detail, [F.col("se"), F.col("te")], F.col("seconds"))


def nearby_location(assets: DataFrame, locations: DataFrame, most: int | None = None, scope: Scope = ALL) -> DataFrame:
    """An asset has one location, as the merge writes it. Places that are null or not finite are near nothing."""
    locations = locations.where(finite("latitude", "longitude"))
    e = scope.evidence(F.col("evidence_id"))
    s = scope.sources(locations.select(F.col("asset_id").alias("source_id"), F.col("latitude").alias("slat"), F.col("longitude").alias("slon"), e.alias("se")))
    t = locations.select(F.col("asset_id").alias("target_id"), F.col("latitude").alias("tlat"), F.col("longitude").alias("tlon"), e.alias("te"))
    metres = (F.col("dlat") + F.col("dlon")) * METRES
    numbers = [F.round("dlat", 9).alias("latitude_delta"), F.round("dlon", 9).alias("longitude_delta"), F.round(metres, 3).alias("approx_distance_meters")]
    detail = scope.detail(F.to_json(F.struct(*numbers)), *numbers)
    if most is None:
        dlat, dlon = F.abs(F.col("slat") - F.col("tlat")), F.abs(F.col("slon") - F.col("tlon"))
        pairs = within_2d(s, t, ("slat", "slon"), ("tlat", "tlon"), DEGREE_CELL, (dlat <= DEGREES) & (dlon <= DEGREES))
        pairs = pairs.withColumn("dlat", dlat).withColumn("dlon", dlon).withColumn("apart", dlat + dlon)
        pairs = pairs.where("source_id <> target_id").join(_targets(assets), "target_id")
    else:
        # Of one place, its first targets; around each place, the nearest places that hold all that count.
        t = t.join(_targets(assets), "target_id")
        item = ["creation_date", "target_id", "te", *_number(assets)]
        first = _few_targets(t, ["tlat", "tlon"], most).groupBy("tlat", "tlon").agg(F.collect_list(F.struct(*item)).alias("ts")).toDF("lat", "lon", "ts")
        places = s.select(F.col("slat").alias("lat"), F.col("slon").alias("lon")).distinct().join(first, ["lat", "lon"], "left")
        places = written(places.withColumn("n", F.coalesce(F.size("ts"), F.lit(0))), "places")
        near = nearest(places.select("lat", "lon", "n"), most + 1, DEGREES, DEGREE_CELL)
        rows = near.join(places.select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), F.explode("ts").alias("x")), ["tlat", "tlon"]).select("*", "x.*").drop("x")
        pairs = _ranked(s, _lists(rows, ["slat", "slon"], most, "apart", *item[:2], "dlat", "dlon", *item[2:]), ["slat", "slon"], most, "apart", detail)
    weight = F.when(metres <= 100, 0.75).when(metres <= 500, 0.65).otherwise(0.5)
    return _rows(pairs, 5, "nearby_location", "location_observation.raw_gps_window", weight, detail, [F.col("se"), F.col("te")], F.col("apart"))


def shared_observation(assets: DataFrame, visual: DataFrame, most: int | None = None, scope: Scope = ALL) -> DataFrame:
    v = visual.where("observation_type = 'document_signal'").select("asset_id", "observation_type", "label", "confidence", scope.evidence(F.col("evidence_id")).alias("e"))
    s = scope.sources(v.select(F.col("asset_id").alias("source_id"), "observation_type", "label", F.col("confidence").alias("c1"), F.col("e").alias("se")))
    t = v.select(F.col("asset_id").alias("target_id"), "observation_type", "label", F.col("confidence").alias("c2"), F.col("e").alias("te"))
    k1 = -F.least("c1", "c2")
    detail = scope.detail(F.to_json(F.struct("observation_type", "label")), "observation_type", "label")
    if most is None:
        pairs = s.join(t, ["observation_type", "label"]).where("source_id <> target_id").withColumn("k1", k1).join(_targets(assets), "target_id")
    else:
        # Targets of one confidence are in an order that no source changes; there are few confidences.
        t = _few_targets(t.join(_targets(assets), "target_id"), ["observation_type", "label", "c2"], most)
        group = ["observation_type", "label", "c1"]
        met = s.select(*group).distinct().join(t, group[:2]).withColumn("k1", k1)
        pairs = _ranked(s, _lists(met, group, most, "k1", "creation_date", "target_id", "te", *_number(assets)), group, most, "k1", detail)
    weight = F.least(F.lit(0.75), F.lit(-0.75) * F.col("k1"))
    return _rows(pairs, 6, "shared_observation", "visual_observation.type_label", weight, detail, [F.col("se"), F.col("te")], F.col("k1"))


#: Each kind of reason with its table beside the assets.
KINDS = {
    "same_burst": (same_burst, None),
    "same_album": (same_album, "album_membership"),
    "same_resource_hash": (same_hash, "asset_resource"),
    "nearby_time": (nearby_time, None),
    "nearby_location": (nearby_location, "location_observation"),
    "shared_observation": (shared_observation, "visual_observation"),
}


def candidates(tables: dict[str, DataFrame], limit: int = LIMIT, source: str | None = None, kinds: tuple[str, ...] = tuple(KINDS), scope: Scope | None = None) -> DataFrame:
    """Rows of all six kinds (or some), at most 4 * limit per source and kind, in each kind's own order."""
    most = 4 * clamp(limit)
    ids = live(tables["asset"]).select(F.col("id").alias("source_id"))
    if source is not None:
        scope, ids = Scope(one=source), ids.where(F.col("source_id") == source)
    out = None
    for kind in kinds:
        of, beside = KINDS[kind]
        given = [tables["asset"]] + ([] if beside is None else [tables[beside]])
        if source is None:
            k = of(*given, most, scope or Scope(ids if beside else None))
        else:
            w = W.partitionBy("source_id").orderBy("k1", "creation_date", "target_id", "detail")
            k = of(*given, None, scope).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
        out = k if out is None else out.unionByName(k)
    return out if source is None else out.join(F.broadcast(ids), "source_id", "left_semi")


def score(rows: DataFrame) -> DataFrame:
    """candidates() -> one row per pair: score, reasons and evidence.

    A reason of the same type, method and detail counts once: the first; the evidence of the others is dropped.
    """
    w = W.partitionBy("source_id", "target_id", "type", "method", "detail").orderBy("ord", "pos")
    kept = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    reason = F.struct((-F.col("weight")).alias("w"), "type", "method", "detail")
    g = kept.groupBy("source_id", "target_id").agg(
        F.first("creation_date").alias("creation_date"),
        F.round(F.least(F.lit(1.0), F.sum("weight")), 9).alias("score"),
        F.array_sort(F.collect_list(reason)).alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
    )
    reasons = F.transform("r", lambda r: F.struct(r["type"].alias("type"), r["method"].alias("method"), (-r["w"]).alias("weight"), r["detail"].alias("detail")))
    return g.select("source_id", "target_id", "creation_date", "score", F.size("r").cast("bigint").alias("n_reasons"), reasons.alias("reasons"), "evidence_ids")


#: Columns of the tables beside the assets that reasons are made of.
FIELDS = {"album_membership": ("album_id", "album_title"), "asset_resource": ("sha256",), "location_observation": ("latitude", "longitude", "evidence_id"), "visual_observation": ("observation_type", "label", "confidence", "evidence_id")}


def _chosen(tables: dict[str, DataFrame], limit: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Live assets and what belongs to them by numbers, and the best targets of each asset with their reasons as numbers."""
    a = live(tables["asset"]).select("id", "creation_date", "local_identifier", "burst_identifier", julian_day(F.col("creation_date")).alias("jd"))
    beside = {name: tables[name] for name in FIELDS}
    beside["asset_resource"] = live(beside["asset_resource"]).where(F.trim("sha256") != "")
    beside["visual_observation"] = beside["visual_observation"].where("observation_type = 'document_signal'")
    rows = {name: t.select("asset_id", *FIELDS[name]) for name, t in beside.items()}
    n = meeting.numbered(a, rows | {"asset_resource": rows["asset_resource"].distinct()})
    return n, meeting.best(n, 4 * clamp(limit), clamp(limit), TIME_WINDOW, DEGREES, DEGREE_CELL)


def _best(tables: dict[str, DataFrame], limit: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables with the numbers of assets, and the best targets of each asset: source_id and `keep`, their numbers. That
    is a scope: candidates() gives the reasons of these pairs."""
    n, best = _chosen(tables, limit)
    number = n["asset"].select(F.col("id").alias("asset_id"), "ti")
    full = tables | {"asset": n["asset"].withColumn("deleted_at", F.lit(None).cast("string"))}
    return full, best.join(number, F.col("s") == F.col("ti")).select(F.col("asset_id").alias("source_id"), F.col("t").alias("keep"))


def neighbors(tables: dict[str, DataFrame], limit: int = LIMIT, source: str | None = None) -> DataFrame:
    """The best neighbors of every live asset (or of one): rank by score, number of reasons, date, id."""
    if source is None:
        return meeting.pairs(*_chosen(tables, limit))
    w = W.partitionBy("source_id").orderBy(F.desc("score"), F.desc("n_reasons"), "creation_date", "target_id")
    ranked = score(candidates(tables, limit, source)).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.where(F.col("rank") <= clamp(limit))
