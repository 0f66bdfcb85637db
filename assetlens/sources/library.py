"""Snapshot sources: exported documents, library tables, local media files, and a fallback between providers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.times import core_data_time
from ..operators.place import valid_location
from ..schemas import SNAPSHOT

UUID = "[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}"
#: Uniform types of file extensions, and the extensions of images that can be classified.
UTI = {
    "jpg": "public.jpeg", "jpeg": "public.jpeg", "png": "public.png", "heic": "public.heic", "heif": "public.heif", "gif": "com.compuserve.gif",
    "tif": "public.tiff", "tiff": "public.tiff", "webp": "org.webmproject.webp", "mov": "com.apple.quicktime-movie", "mp4": "public.mpeg-4",
}
IMAGES = ("jpg", "jpeg", "png", "heic", "heif", "gif", "tif", "tiff", "webp")
PATH_CLASSES = ("derivative", "render", "original", "local_media")
#: The columns of an asset in a snapshot, in order.
ASSET_FIELDS = (
    "local_identifier", "media_type", "media_subtypes", "creation_date", "modification_date", "added_date", "timezone_name", "width", "height", "duration_seconds", "favorite",
    "hidden", "burst_identifier", "represents_burst", "deleted_at", "deletion_source", "deletion_reason", "location", "resources", "albums", "metadata",
)


class Provider(Protocol):
    """Gives one snapshot row (schemas.SNAPSHOT) of a library."""

    def snapshot(self, spark: SparkSession, library_path: str) -> DataFrame: ...


class JsonProvider:
    """An exported snapshot document."""

    def snapshot(self, spark: SparkSession, library_path: str) -> DataFrame:
        return spark.read.schema(SNAPSHOT).json(library_path, multiLine=True)


class TablesProvider:
    """Library tables exported as Parquet, one folder per table."""

    NAMES = ("ZASSET", "ZADDITIONALASSETATTRIBUTES", "ZINTERNALRESOURCE", "ZGENERICALBUM", "Z_33ASSETS")

    def tables(self, spark: SparkSession, library_path: str) -> dict[str, DataFrame]:
        return {n: spark.read.parquet(f"{library_path.rstrip('/')}/{n}") for n in self.NAMES}

    def snapshot(self, spark: SparkSession, library_path: str) -> DataFrame:
        return assemble(self.tables(spark, library_path), library_path)

    def assets(self, spark: SparkSession, library_path: str) -> DataFrame:
        """The same assets, one row each."""
        return nested_assets(self.tables(spark, library_path))


class FallbackProvider:
    """The primary provider, or the secondary with the primary's error in the metadata."""

    def __init__(self, primary: Provider, secondary: Provider):
        self.primary, self.secondary = primary, secondary

    def snapshot(self, spark: SparkSession, library_path: str) -> DataFrame:
        try:
            found = self.primary.snapshot(spark, library_path)
            if not found.take(1):
                raise ValueError(f"no snapshot in {library_path}")
            return found
        except Exception as e:  # any failure of a source is what the fallback is for
            found = self.secondary.snapshot(spark, library_path)
            return found.withColumn("metadata", F.to_json(F.create_map(F.lit("primary_error"), F.lit(str(e)[:500]), F.lit("snapshot"), F.col("metadata"))))


PROVIDERS: dict[str, Callable[[], Provider]] = {
    "": lambda: FallbackProvider(JsonProvider(), TablesProvider()),
    "auto": lambda: FallbackProvider(JsonProvider(), TablesProvider()),
    "json": JsonProvider,
    "tables": TablesProvider,
}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name]()


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or null where a source's version lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def media_kind(kind: Column) -> Column:
    return F.when(kind == 0, "image").when(kind == 1, "video").otherwise(F.concat(F.lit("kind:"), F.coalesce(kind, F.lit(-1))))


def library_assets(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Assets with attributes, defaults for what is missing; those without an identifier are left out."""
    x = attributes.select(F.col("ZASSET").alias("_of"), F.col("ZTIMEZONENAME").alias("tz"), F.col("ZGPSHORIZONTALACCURACY").alias("acc"))
    j = assets.join(x, assets.Z_PK == F.col("_of"), "left").where(T.non_blank(F.col("ZUUID")).isNotNull())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    trashed = whole("ZTRASHEDSTATE") != 0
    at = core_data_time(optional(assets, "ZTRASHEDDATE", "double"))
    place = F.when(
        valid_location(F.col("ZLATITUDE"), F.col("ZLONGITUDE")),
        F.struct(F.col("ZLATITUDE").alias("latitude"), F.col("ZLONGITUDE").alias("longitude"), F.lit(None).cast("double").alias("altitude"), F.when(F.col("acc") >= 0, F.col("acc")).alias("horizontal_accuracy")),
    )
    return j.select(
        F.col("Z_PK").alias("pk"),
        F.col("ZUUID").alias("local_identifier"),
        media_kind(F.col("ZKIND")).alias("media_type"),
        F.when(F.coalesce("ZKINDSUBTYPE", F.lit(0)) == 0, "").otherwise(F.concat(F.lit("subtype:"), F.col("ZKINDSUBTYPE"))).alias("media_subtypes"),
        core_data_time(F.col("ZDATECREATED")).alias("creation_date"),
        core_data_time(F.col("ZMODIFICATIONDATE")).alias("modification_date"),
        core_data_time(F.col("ZADDEDDATE")).alias("added_date"),
        text("tz").alias("timezone_name"),
        whole("ZWIDTH").alias("width"),
        whole("ZHEIGHT").alias("height"),
        F.coalesce(F.col("ZDURATION").cast("double"), F.lit(0.0)).alias("duration_seconds"),
        (whole("ZFAVORITE") != 0).alias("favorite"),
        (whole("ZHIDDEN") != 0).alias("hidden"),
        text("ZAVALANCHEUUID").alias("burst_identifier"),
        F.lit(False).alias("represents_burst"),
        F.when(trashed, at).otherwise("").alias("deleted_at"),
        F.when(trashed, "library_trash").otherwise("").alias("deletion_source"),
        F.when(trashed, "trashed").otherwise("").alias("deletion_reason"),
        place.alias("location"),
        F.when(trashed & (at == ""), F.lit('{"deletion_timestamp_source":"crawl_observed_at"}')).otherwise("{}").alias("metadata"),
    )


def library_resources(resources: DataFrame, assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per asset (pk) its resources as a list by source key. Local if the local state is positive; else to download if remote is."""
    a = assets.select(F.col("Z_PK").alias("pk"), "ZFILENAME", "ZUNIFORMTYPEIDENTIFIER")
    x = attributes.select(F.col("ZASSET").alias("_of"), "ZORIGINALFILENAME")
    j = resources.where("ZASSET IS NOT NULL").join(a, F.col("ZASSET") == F.col("pk"), "left").join(x, F.col("ZASSET") == F.col("_of"), "left")
    here, there = F.coalesce("ZLOCALAVAILABILITY", F.lit(0)) > 0, F.coalesce("ZREMOTEAVAILABILITY", F.lit(0)) > 0
    item = F.struct(
        F.col("Z_PK").alias("_pk"),
        F.concat(F.lit("resource:"), F.col("Z_PK")).alias("source_identifier"),
        F.concat(F.lit("type:"), F.coalesce("ZRESOURCETYPE", F.lit(-1))).alias("type"),
        F.coalesce("ZCOMPACTUTI", "ZUNIFORMTYPEIDENTIFIER", F.lit("")).alias("uti"),
        F.coalesce("ZORIGINALFILENAME", "ZFILENAME", F.lit("")).alias("original_filename"),
        F.lit("").alias("local_path"),
        F.when(here, "local").when(there, "remote").otherwise("unknown").alias("availability"),
        F.coalesce("ZDATALENGTH", F.lit(0).cast("bigint")).alias("file_size"),
        F.coalesce("ZSTABLEHASH", "ZFINGERPRINT", F.lit("")).alias("stable_hash"),
        here.alias("available_locally"),
        (~here & there).alias("needs_download"),
        F.lit("{}").alias("metadata"),
    )
    return j.groupBy(F.col("ZASSET").alias("pk")).agg(F.array_sort(F.collect_list(item)).alias("r")).select("pk", F.transform("r", lambda r: r.dropFields("_pk")).alias("resources"))


def library_albums(bridge: DataFrame, albums: DataFrame) -> DataFrame:
    """Per asset (pk) its albums that aren't in the trash, by title; an album without identifier is named by its key."""
    j = bridge.join(albums, bridge.Z_33ALBUMS == albums.Z_PK).where("coalesce(ZTRASHEDSTATE, 0) = 0")
    item = F.struct(
        F.coalesce(T.non_blank(F.col("ZUUID")), F.concat(F.lit("sqlite_album:"), F.col("Z_PK"))).alias("album_id"), F.coalesce("ZTITLE", F.lit("")).alias("album_title"), F.concat(F.lit("kind:"), F.coalesce("ZKIND", F.lit(0))).alias("album_kind")
    )
    ordered = F.array_sort(F.collect_list(F.struct(item["album_title"].alias("t"), item["album_id"].alias("i"), item.alias("m"))))
    return j.groupBy(F.col("Z_3ASSETS").alias("pk")).agg(ordered.alias("a")).select("pk", F.transform("a", lambda a: a["m"]).alias("albums"))


def nested_assets(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per asset of library tables, as a snapshot lists them (schemas.SNAPSHOT_ASSET); ord is the asset's key."""
    a = library_assets(tables["ZASSET"], tables["ZADDITIONALASSETATTRIBUTES"])
    r = library_resources(tables["ZINTERNALRESOURCE"], tables["ZASSET"], tables["ZADDITIONALASSETATTRIBUTES"])
    m = library_albums(tables["Z_33ASSETS"], tables["ZGENERICALBUM"])
    nested = a.join(r, "pk", "left").join(m, "pk", "left")
    filled = nested.withColumn("resources", F.coalesce("resources", F.array())).withColumn("albums", F.coalesce("albums", F.array()))
    return filled.select(F.col("pk").alias("ord"), *ASSET_FIELDS)


def assemble(tables: dict[str, DataFrame], library_path: str) -> DataFrame:
    """One snapshot row from library tables. It holds all assets: crawl takes nested_assets instead."""
    rows = nested_assets(tables).agg(F.array_sort(F.collect_list(F.struct(*ASSET_FIELDS))).alias("assets"))
    return rows.select(F.lit(library_path).alias("library_path"), F.lit("tables").alias("provider"), F.lit("").alias("photos_version"), F.lit("").alias("authorization_status"), F.lit("{}").alias("metadata"), "assets")


# Local media


def path_class(path: Column) -> Column:
    from ..operators.classify import path_class as of

    return of(path)


def media_index(files: DataFrame) -> DataFrame:
    """path, length of files -> uuid, path, file_size, class, extension, uti; per uuid in order of class, size, path (n from 1)."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    rows = files.select(
        F.nullif(F.regexp_extract(F.upper(name), UUID, 0), F.lit("")).alias("uuid"), "path", F.col("length").cast("bigint").alias("file_size"), path_class(F.col("path")).alias("class"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension")
    ).where("uuid IS NOT NULL")
    priority = F.array_position(F.array(*[F.lit(c) for c in PATH_CLASSES]), F.col("class"))
    kind = F.create_map(*[F.lit(x) for p in UTI.items() for x in p])
    w = W.partitionBy("uuid").orderBy(priority, F.desc("file_size"), "path")
    return rows.withColumn("uti", F.coalesce(F.try_element_at(kind, F.col("extension")), F.lit(""))).withColumn("n", F.row_number().over(w).cast("bigint"))


def scan_media(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Index of the media files under the roots; only names and sizes are read."""
    return media_index(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length"))


def attach_media(assets: DataFrame, index: DataFrame) -> DataFrame:
    """assets (local_identifier, media_type, resources) with the best local file: on the first image resource without a
    path, or as a further resource of an image."""
    best = index.where(F.col("extension").isin(*IMAGES)).withColumn("_n", F.row_number().over(W.partitionBy("uuid").orderBy("n"))).where("_n = 1")
    best = best.select("uuid", F.struct("path", "file_size", "uti", "class").alias("_f"))
    j = assets.withColumn("_u", F.regexp_extract(F.upper("local_identifier"), UUID, 0)).join(best, F.col("_u") == F.col("uuid"), "left")
    fits = lambda r: (T.trim_white(F.coalesce(r["local_path"], F.lit(""))) == "") & (r["uti"].contains("image") | r["uti"].contains("jpeg") | r["uti"].contains("heic") | r["uti"].contains("png") | (r["type"].isin("photo", "original")))
    at = F.get(F.filter(F.sequence(F.lit(0), F.size("resources")), lambda i: F.coalesce(fits(F.get(F.col("resources"), i)), F.lit(False))), 0)
    filled = F.transform("resources", lambda r, i: F.when(i == F.col("_at"), r.withField("local_path", F.col("_f.path")).withField("available_locally", F.lit(True)).withField("needs_download", F.lit(False))).otherwise(r))
    extra = F.struct(
        F.concat(F.lit("local_media:"), F.col("uuid")).alias("source_identifier"), F.lit("photo").alias("type"), F.col("_f.uti").alias("uti"), F.regexp_extract(F.col("_f.path"), r"[^/]*$", 0).alias("original_filename"), F.col("_f.path").alias("local_path"),
        F.lit("local").alias("availability"), F.col("_f.file_size").alias("file_size"), F.lit("").alias("stable_hash"), F.lit(True).alias("available_locally"), F.lit(False).alias("needs_download"), F.lit("{}").alias("metadata"),
    )
    j = j.withColumn("_at", at)
    new = F.when(F.col("_f").isNull(), F.col("resources")).when(F.col("_at").isNotNull(), filled).when(F.col("media_type") == "image", F.concat("resources", F.array(extra))).otherwise(F.col("resources"))
    return j.withColumn("resources", new).select(*assets.columns)
