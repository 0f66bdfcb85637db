"""Timeline: assets of a half-open span of time, with places and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import JULIAN_EPOCH_MS, julian_day, parse_bound

#: Metres of accuracy up to which a place is precise.
PRECISE = 100.0


def _julian(name: str, text: str) -> float:
    at = parse_bound(name, text)
    return (int(at.timestamp() * 1000) + JULIAN_EPOCH_MS) / 86400000.0


def bounds(start: str, end: str) -> tuple[float, float]:
    a, b = _julian("from", start), _julian("to", end)
    if not a < b:
        raise ValueError("from must be before to")
    return a, b


def timeline(tables: dict[str, DataFrame], start: str, end: str, include_unlocated: bool = False) -> DataFrame:
    """One row per asset and location in [start, end); assets that the queue holds as deleted are left out."""
    low, high = bounds(start, end)
    a = tables["asset"].withColumn("jd", julian_day(F.col("creation_date"))).where((F.col("jd") >= low) & (F.col("jd") < high))
    gone = tables["classification_queue"].where("state = 'deleted'").select("asset_id")
    a = a.join(gone, a.id == gone.asset_id, "left_anti")
    m = tables["album_membership"].groupBy("asset_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("album_id").alias("id"), F.col("album_title").alias("title"), F.col("album_kind").alias("kind"))))).alias("albums"))
    loc = tables["location_observation"].select(F.col("id").alias("location_observation_id"), F.col("asset_id").alias("l_asset"), "latitude", "longitude", "horizontal_accuracy")
    rows = a.join(loc, a.id == loc.l_asset, "left" if include_unlocated else "inner").join(m, a.id == m.asset_id, "left")
    source = F.get_json_object("metadata_json", "$.source_type")
    acc = F.col("horizontal_accuracy")
    return rows.select(
        F.col("id").alias("asset_id"),
        "location_observation_id",
        F.col("creation_date").alias("created_at"),
        "media_type",
        F.coalesce(F.regexp_extract(source, r"^[+-]?\d+", 0).try_cast("bigint"), F.lit(0)).alias("source_type"),
        F.coalesce("albums", F.lit("[]")).alias("albums"),
        F.coalesce("location_observation_id", "id").alias("source_ref"),
        "latitude",
        "longitude",
        acc.alias("accuracy_meters"),
        F.when(acc.isNotNull(), (acc >= 0) & (acc <= PRECISE)).alias("is_precise"),
        "jd",
    ).orderBy("jd", "created_at", "asset_id", "location_observation_id").drop("jd")
