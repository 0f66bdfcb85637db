"""Schema upgrades: version 1 had no tombstones and no source identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION, TABLES
from ..store import Store, Tables

PARENT_DELETED = "parent_asset_deleted"


def add_missing(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of the schema, null where it has none."""
    columns = [c.split(None, 1) for c in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in columns])


def normalize_tombstones(resources: DataFrame, assets: DataFrame) -> DataFrame:
    """Blank tombstone fields become null; a resource of a deleted asset takes over what it lacks from the asset."""
    parent = assets.where("deleted_at IS NOT NULL").select(F.col("id").alias("asset_id"), F.col("deleted_at").alias("_at"), F.col("deletion_source").alias("_source"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    joined = resources.join(parent, "asset_id", "left")
    gone = F.col("_at").isNotNull()
    return joined.select(
        *[c for c in resources.columns if c not in ("deleted_at", "deletion_source", "deletion_reason")],
        F.coalesce(blank("deleted_at"), "_at").alias("deleted_at"),
        F.coalesce(blank("deletion_source"), "_source").alias("deletion_source"),
        F.coalesce(blank("deletion_reason"), F.when(gone, F.lit(PARENT_DELETED))).alias("deletion_reason"),
    ).select(*resources.columns)


def migrate(store: Store, meta: dict) -> None:
    """New table versions and the new schema version, in one commit."""
    read = lambda name: add_missing(store.spark.read.parquet(f"{store.path}/{meta['tables'][name]}"), TABLES[name])
    changed = {name: read(name) for name in ("asset", "asset_resource") if name in meta["tables"]}
    if "asset_resource" in changed and "asset" in changed:
        changed["asset_resource"] = normalize_tombstones(changed["asset_resource"], changed["asset"])
    tables = Tables(store, {**meta, "version": SCHEMA_VERSION})
    tables.read |= set(changed)
    store.commit(changed, tables)
