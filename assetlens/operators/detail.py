"""Detail bundles, evidence, edges and the choice of an original to export, for one id or for all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Child lists of a bundle: columns, and order (a leading - is descending).
CHILDREN = {
    "asset_resource": ("resource_type", "original_filename", "id"),
    "album_membership": ("album_title", "album_id"),
    "location_observation": ("id",),
    "visual_observation": ("observation_type", "-confidence", "label"),
    "text_observation": ("-confidence", "id"),
    "face_observation": ("-confidence", "id"),
    "model_observation": ("observation_type", "-confidence", "value_text"),
    "observation_term": ("term_type", "term"),
    "evidence_ref": ("evidence_kind", "id"),
}
EVIDENCED = ("location_observation", "visual_observation", "text_observation", "face_observation", "model_observation", "edge")


def _order(c: str) -> Column:
    return (-F.col(c[1:])).alias("_" + c[1:]) if c.startswith("-") else F.col(c)


def bundles(tables: dict[str, DataFrame], asset_id: str | None = None, only: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Each asset, deleted ones too, with its child rows as sorted arrays; one grouped join per child.

    only: of some children, the columns that are asked for; those and the columns of their order are all that is exchanged.
    """
    out = tables["asset"] if asset_id is None else tables["asset"].where(F.col("id") == asset_id)
    for name, order in CHILDREN.items():
        child = tables[name] if asset_id is None else tables[name].where(F.col("asset_id") == asset_id)
        asked = child.columns if name not in (only or {}) else only[name]
        rest = [c for c in child.columns if c in asked and c != "asset_id" and c not in order]
        grouped = child.groupBy(F.col("asset_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct(*[_order(c) for c in order], *rest))).alias(name))
        out = out.join(grouped, out.id == F.col("_of"), "left").drop("_of").withColumn(name, F.coalesce(name, F.array()))
    both = edges_of(tables["edge"]) if asset_id is None else edges_of(tables["edge"]).where(F.col("node") == asset_id)
    linked = both.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("_confidence"), "edge_type", "id", "from_id", "to_id"))).alias("edge"))
    return out.join(linked, out.id == linked.node, "left").drop("node").withColumn("edge", F.coalesce("edge", F.array()))


def edges_of(edges: DataFrame) -> DataFrame:
    """Each edge at both of its ends (once for a loop): node and the edge."""
    a = edges.withColumn("node", F.col("from_id"))
    return a.unionByName(edges.where("from_id <> to_id").withColumn("node", F.col("to_id")))


def evidence(tables: dict[str, DataFrame], row_ids: DataFrame | None = None, of: tuple[str, ...] = EVIDENCED) -> DataFrame:
    """Evidence of each row_id (None: of all assets, evidence rows and rows of the tables `of`): of an asset, of an evidence
    row itself, or of what an observation or edge of those tables refers to.

    Evidence rows meet the names of what refers to them, and say themselves of which rows they are: they are exchanged once.
    """
    refs = tables["evidence_ref"]
    named = reduce(DataFrame.union, [tables[n].select(F.col("id").alias("name"), F.col("evidence_id").alias("_of")) for n in of]).where("name IS NOT NULL AND _of IS NOT NULL")
    if row_ids is not None:
        row_ids = row_ids.select("row_id").distinct()
        named = named.join(row_ids, named.name == row_ids.row_id, "left_semi")
    w = W.partitionBy("_of").orderBy("name")
    named = named.withColumns({"_n": F.row_number().over(w), "_again": F.lag("name").over(w) == F.col("name")}).where("_again IS NULL OR NOT _again")
    named = named.drop("_again") if row_ids is not None else named.drop("_again").hint("merge")  # of all, too many for a broadcast
    met = refs.join(named, refs.id == named["_of"], "left")
    # Its own names are said with the first of the others only.
    first = F.coalesce(F.col("_n"), F.lit(1)) == 1
    names = F.array(F.when(first, F.col("asset_id")), F.when(first & ~F.col("id").eqNullSafe(F.col("asset_id")), F.col("id")), F.when((F.col("name") != F.col("id")) & (F.col("name") != F.coalesce("asset_id", F.lit(""))), F.col("name")))
    found = met.select(F.explode(names).alias("row_id"), "id", "asset_id", "evidence_kind", "source", "pointer", "value_json").where("row_id IS NOT NULL")
    return found if row_ids is None else found.join(row_ids, "row_id", "left_semi")


def export_choice(resources: DataFrame) -> DataFrame:
    """asset_id, original: the preferred live resource's name, made a safe file name. Whether the asset lives is not asked."""
    rank = F.when(F.col("resource_type") == "original", 0).when(F.col("resource_type") == "photo", 1).when(F.col("resource_type") == "full_size_video", 2).when(F.col("resource_type") == "video", 3)
    named = resources.where("deleted_at IS NULL").where(F.trim("original_filename") != "").withColumn("rank", rank).where("rank IS NOT NULL")
    w = W.partitionBy("asset_id").orderBy("rank", "id")
    best = named.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select("asset_id", safe_file_name("original_filename", "asset_id").alias("original"))


def safe_file_name(name: str, asset_id: str) -> Column:
    base = F.trim(F.regexp_extract(F.replace(F.col(name), F.lit("\\"), F.lit("/")), r"[^/]*$", 0))
    fallback = F.concat(F.regexp_extract(F.col(asset_id), r"[^:]*$", 0), F.lit(".bin"))
    return F.when(base.isin("", ".", ".."), fallback).otherwise(base)
