"""Coverage counts of an archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .classify import live


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("id"), F.count("*").alias("value")) for name, df in tables.items()]
    return reduce(DataFrame.union, parts)


def availability() -> Column:
    return F.when(F.col("available_locally"), "local").when(F.col("needs_download"), "remote_needs_download").otherwise("unknown")


def _grouped(prefix: str, df: DataFrame, key: Column) -> DataFrame:
    g = df.groupBy(key.alias("key")).agg(F.count("*").alias("value"))
    return g.select(F.concat(F.lit(prefix + "."), T.count_id(F.col("key"))).alias("id"), F.coalesce(T.non_blank(F.col("key")), F.lit("unknown")).alias("key"), "value")


def grouped_counts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The six grouped counts, each id, key, value."""
    ids = live(tables["asset"]).select(F.col("id").alias("asset_id"))
    of_live = lambda name: tables[name].join(ids, "asset_id", "left_semi")
    return {
        "asset.media_type": _grouped("asset.media_type", live(tables["asset"]), F.col("media_type")),
        "resource.availability": _grouped("resource.availability", live(of_live("asset_resource")), availability()),
        "classification_queue.state": _grouped("classification_queue.state", tables["classification_queue"], F.col("state")),
        "observation.type": _grouped("observation.type", of_live("visual_observation"), F.col("observation_type")),
        "model_observation.type": _grouped("model_observation.type", of_live("model_observation"), F.col("observation_type")),
        "observation_term.type": _grouped("observation_term.type", of_live("observation_term"), F.col("term_type")),
    }


def scalar_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """The nine coverage counts, id and value."""
    a, r = tables["asset"], tables["asset_resource"]
    ids = live(a).select(F.col("id").alias("asset_id"))
    located = tables["location_observation"].select("asset_id").distinct()
    seen = tables["visual_observation"].select("asset_id").union(tables["model_observation"].select("asset_id")).distinct()
    of_live = live(r).join(ids, "asset_id", "left_semi")
    one = lambda id_, df: df.agg(F.lit(id_).alias("id"), F.count("*").alias("value"))
    parts = [
        one("asset.deleted", a.where("deleted_at IS NOT NULL")),
        one("asset.active", live(a)),
        one("resource.deleted", r.where("deleted_at IS NOT NULL")),
        one("asset.with_location", ids.join(located, "asset_id", "left_semi")),
        one("asset.without_location", ids.join(located, "asset_id", "left_anti")),
        one("asset.with_observation", ids.join(seen, "asset_id", "left_semi")),
        one("asset.without_observation", ids.join(seen, "asset_id", "left_anti")),
        one("asset.with_local_resource", of_live.where("available_locally").select("asset_id").distinct()),
        one("asset.needing_download", of_live.where("needs_download").select("asset_id").distinct()),
    ]
    return reduce(DataFrame.union, parts)


def summary(tables: dict[str, DataFrame]) -> dict:
    """Counts, a sentence, the last import and warnings."""
    scalars = {r.id: r.value for r in scalar_counts(tables).collect()}
    counts = [{"id": f"table.{r.id}", "value": r.value} for r in table_counts(tables).collect()]
    for df in grouped_counts(tables).values():
        counts += [{"id": r.id, "value": r.value} for r in df.orderBy(F.desc("value"), "key").collect()]
    counts += [{"id": k, "value": v} for k, v in scalars.items()]
    pending = tables["classification_queue"].where("state = 'pending'").count()
    last = tables["crawl_snapshot"].agg(F.max("completed_at")).first()[0]
    text = "the archive is initialized but has no active crawled assets"
    if scalars["asset.active"]:
        text = f"{scalars['asset.active']} assets; {scalars['asset.with_location']} with raw GPS; {scalars['asset.with_observation']} with local observations; {pending} pending classification"
    return {"counts": counts, "summary": text, "last_import_at": last or "", "warnings": ["classification queue has pending assets"] if pending else []}
