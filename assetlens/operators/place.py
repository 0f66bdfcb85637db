"""Place context: inputs, backfill keys and jobs, candidate ranking, and the rendered card."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.scratch import scratch
from .classify import live
from .range_join import in_order

CANDIDATES, FEATURES, POIS = 12, 2, 4
RETRY_MINUTES = {2: 2, 3: 10, 4: 30}
FOUND, NONE, PROVIDER_ERROR = "found", "none", "provider_error"

#: Map kinds in order of evaluation; how the words are tested (is, has, starts), the words, the kind they mean.
MAP_KINDS = (
    ("has", ("telephone",), ""),
    ("has", ("waste",), ""),
    ("has", ("bench",), ""),
    ("has", ("atm",), ""),
    ("has", ("drinking water",), ""),
    ("has", ("parking",), ""),
    ("has", ("information", "guidepost"), ""),
    ("has", ("house", "building", "apartment"), ""),
    ("starts", ("shop",), ""),
    ("has", ("aeroway gate",), "airport gate"),
    ("has", ("aeroway terminal",), "airport terminal"),
    ("has", ("airport",), "airport"),
    ("has", ("aeroway apron",), ""),
    ("is", ("path", "track", "footway", "cycleway", "bridleway"), "trail"),
    ("has", ("highway path", "highway footway", "highway track", "highway cycleway", "highway bridleway"), "trail"),
    ("starts", ("highway",), "road"),
    ("has", ("road",), "road"),
    ("has", ("railway station",), "rail station"),
    ("has", ("public transport", "bus stop", "tram stop"), "transit stop"),
    ("has", ("ferry",), "ferry route"),
    ("has", ("tourism viewpoint",), "viewpoint"),
    ("has", ("tourism hotel",), "hotel"),
    ("has", ("cave",), "cave"),
    ("has", ("cliff",), "cliff"),
    ("has", ("beach",), "beach"),
    ("has", ("peak",), "peak"),
    ("has", ("waterfall",), "waterfall"),
    ("has", ("water",), "water"),
    ("has", ("bridge",), "bridge"),
    ("has", ("tunnel",), "tunnel"),
    ("has", ("pier",), "pier"),
    ("has", ("national park",), "national park"),
    ("has", ("park",), "park"),
    ("has", ("boundary", "administrative"), "area"),
    ("has", ("neighbourhood", "neighborhood", "suburb", "quarter"), "area"),
    ("starts", ("place city", "place town", "place village"), "area"),
    ("has", ("area of interest",), "area"),
)
#: Categories that a name suggests, in order.
NAME_CATEGORIES = (
    (("airport",), "airport"),
    (("terminal",), "terminal"),
    (("railway station", "train station"), "rail station"),
    (("station", " stop "), "public transport"),
    (("hotel",), "hotel"),
    (("trail",), "trail"),
    (("falls",), "waterfall"),
    (("bridge",), "bridge"),
)
#: Word lists of the card.
USEFUL_CATEGORIES = (
    "airport", "hotel", "restaurant", "cafe", "landmark", "public transport", "museum", "park", "national park", "beach", "campground", "marina",
    "theater", "music venue", "stadium", "university", "school", "nightlife", "terminal", "rail station", "trail", "waterfall", "bridge",
)
RELEVANT_NAMES = ("airport", "terminal", "station", "pier", "gate", "security", "baggage", "lounge", "trail", "falls", "bridge", "hotel")
LOW_VALUE_POIS = ("charging", "ev charger", "atm", "cash machine")
LOW_VALUE_KINDS = ("", "house", "building", "apartment building", "bench", "parking", "telephone", "waste basket", "atm", "drinking water", "guidepost", "shop")
LOW_VALUE_NAMES = ("guidepost", "information", "telephone", "waste basket", "drinking water", "atm", "bench")
UNNAMED_KINDS = ("trail", "road", "bridge", "tunnel", "viewpoint", "beach", "cliff", "cave", "airport gate", "airport terminal", "pier", "park", "national park", "ferry route")
RELATIONS = ("contains", "on", "on/near", "near", "nearby", "nearest", "area")
REPLACED_CATEGORIES = ("", "parking", "store", "shop", "atm")
CATEGORY_CAPS = {"hotel": 1, "public transport": 1, "restaurant": 2, "cafe": 2, "": POIS}
STATION_WORDS = ("bus", "stop", "station", "platform", "tram", "metro", "underground")


# Inputs

ALIASES = ("$.{}", "$.location.{}", "$.asset.{}", "$.asset.location.{}")


def _first_text(json: Column, *names: str) -> Column:
    return T.first_non_blank(*[F.get_json_object(json, a.format(n)) for n in names for a in ALIASES])


def _first_number(json: Column, *names: str) -> Column:
    """The first that is a number other than 0."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, a.format(n)).try_cast("double"), F.lit(0.0)) for n in names for a in ALIASES], F.lit(0.0))


def parse_input(json: Column) -> Column:
    """Tolerant place input: fields at the top, under location or under asset."""
    return F.struct(
        _first_text(json, "local_identifier", "id").alias("local_identifier"),
        _first_text(json, "creation_date", "taken_at").alias("creation_date"),
        _first_number(json, "latitude", "lat").alias("latitude"),
        _first_number(json, "longitude", "lon", "lng").alias("longitude"),
        _first_number(json, "horizontal_accuracy", "accuracy_meters", "accuracy").alias("accuracy_meters"),
    )


def valid_location(latitude: Column, longitude: Column) -> Column:
    return latitude.between(-90, 90) & longitude.between(-180, 180) & ~((latitude == 0) & (longitude == 0))


def area_levels(address: Column) -> Column:
    """Names of the area from country to quarter, blanks left out."""
    names = ("country", "administrative_area", "sub_administrative_area", "locality", "sub_locality")
    items = [F.struct(F.lit(n).alias("level"), T.non_blank(address[n]).alias("name")) for n in names]
    return F.filter(F.array(*items), lambda x: x["name"].isNotNull())


def nearest_candidates(rows: DataFrame, key: str, most: int = CANDIDATES) -> DataFrame:
    """The nearest candidates of each key, ties by name."""
    w = W.partitionBy(key).orderBy("distance_m", "name")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)


def poi_status(error: Column, count: Column) -> Column:
    return F.when(T.non_blank(error).isNotNull(), PROVIDER_ERROR).when(count > 0, FOUND).otherwise(NONE)


# Backfill


def backfill_keys(assets: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per exact place of live assets: counts, first and last date, representative, and index in order of key text.

    The representative is the asset of the latest date (the smallest id of those); blank dates count as unknown. The
    index is a rank over the places, one row each.
    """
    a = live(assets).select(F.col("id").alias("asset_id"), "creation_date")
    rows = locations.where("latitude <> 0 OR longitude <> 0").join(a, "asset_id").withColumn("accuracy", F.coalesce("horizontal_accuracy", F.lit(0.0)))
    g = rows.groupBy("latitude", "longitude", "accuracy").agg(
        F.count("*").alias("asset_count"),
        F.coalesce(F.min(F.nullif("creation_date", F.lit(""))), F.lit("")).alias("first_seen"),
        F.max("creation_date").alias("last_seen"),
        F.min(F.struct("asset_id")).alias("_any"),
        F.max_by("asset_id", F.struct("creation_date", F.lit(0))).alias("_last"),
    )
    best = rows.join(g.select("latitude", "longitude", "accuracy", "last_seen"), ["latitude", "longitude", "accuracy"]).where("creation_date = last_seen")
    best = best.groupBy("latitude", "longitude", "accuracy").agg(F.min("asset_id").alias("representative_asset_id"))
    return g.drop("_any", "_last").join(best, ["latitude", "longitude", "accuracy"])


@F.pandas_udf(StringType())
def coordinate_key(latitude: pd.Series, longitude: pd.Series, accuracy: pd.Series) -> pd.Series:
    """Text of a place: eight, eight and one decimals, rounded half to even as C does."""
    return pd.Series([f"{a:.8f}|{b:.8f}|{c:.1f}" for a, b, c in zip(latitude, longitude, accuracy, strict=True)], dtype=object)


def indexed_keys(keys: DataFrame) -> DataFrame:
    k = keys.withColumn("key", coordinate_key(F.col("latitude"), F.col("longitude"), F.col("accuracy")))
    return in_order(k, "key").withColumnRenamed("_index", "index")


def backfill_jobs(keys: DataFrame, outputs: DataFrame, attempts: DataFrame, attempt: int) -> DataFrame:
    """Keys without an output of the same place and with exactly attempt - 1 attempts so far.

    outputs: latitude, longitude, accuracy of complete results; attempts: key columns, one row each try.
    """
    cell = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    near = outputs.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("accuracy").alias("_acc"))
    near = near.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell("_lat") + d)))
    same = (F.abs(F.col("latitude") - F.col("_lat")) < 1e-8) & (F.abs(F.col("longitude") - F.col("_lon")) < 1e-8) & (F.abs(F.col("accuracy") - F.col("_acc")) < 0.1)
    todo = keys.join(near, (cell("latitude") == F.col("_cell")) & same, "left_anti")
    on = ["latitude", "longitude", "accuracy"]
    tried = attempts.groupBy(*on).agg(F.count("*").alias("tries"))
    j = todo.join(tried, on, "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    return j.where(F.col("tries") == attempt - 1)


def attempt_ledger(attempts: DataFrame, last_round: int = 4) -> DataFrame:
    """Latest attempt of each key, and whether it is final: a success, or an error of the last round."""
    w = W.partitionBy("key").orderBy(F.desc("attempt"))
    latest = attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return latest.withColumn("final", F.col("error").isNull() | (F.col("attempt") >= last_round))


def run_rounds(keys: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], rounds: int = 4, workers: int = 4, wait: Callable[[float], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Call the provider for every key, again for those that failed, in rounds; (outputs, attempts).

    provider maps (latitude, longitude, accuracy) to also (result, error) as mapInPandas does, at most `workers` at a
    time. wait(seconds) stands between the rounds.
    """
    on = ["latitude", "longitude", "accuracy"]
    spark = keys.sparkSession
    base = scratch(spark, "backfill")
    schema = "latitude double, longitude double, accuracy double, result string, error string"
    done = spark.createDataFrame([], schema + ", attempt int")
    for n in range(1, rounds + 1):
        todo = backfill_jobs(keys.select(*on), done.where("error IS NULL").select(*on), done.select(*on), n)
        if todo.isEmpty():
            break
        if n > 1 and wait is not None:
            wait(60.0 * RETRY_MINUTES.get(n, 30))
        tried = todo.select(*on).repartition(workers).mapInPandas(provider, schema).withColumn("attempt", F.lit(n))
        tried.write.parquet(f"{base}/{n}")
        done = done.unionByName(spark.read.schema(schema + ", attempt int").parquet(f"{base}/{n}"))
    return done.where("error IS NULL"), done


def cached_results(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """inputs (key) split into complete cached results and misses. Only complete ones are used again."""
    good = cache.where(F.col("status").isin(FOUND, NONE))
    return inputs.join(good, "key").withColumn("cached", F.lit(True)), inputs.join(good, "key", "left_anti")


def cache_key(latitude: Column, longitude: Column, accuracy: Column, radius: Column) -> Column:
    return F.sha2(F.to_json(F.struct(latitude.alias("latitude"), longitude.alias("longitude"), accuracy.alias("accuracy"), radius.alias("radius"))), 256)


# Names and kinds


def map_kind(kind: Column) -> Column:
    k = T.collapse_white(F.translate(F.lower(F.coalesce(kind, F.lit(""))), "_-", "  "))
    test = {"is": lambda w: k == w, "has": lambda w: k.contains(w), "starts": lambda w: k.startswith(w)}
    out = F.when(k == "", "")
    for how, words, meaning in MAP_KINDS:
        out = out.when(reduce(lambda a, b: a | b, [test[how](w) for w in words]), meaning)
    return out.otherwise("")


def short_category(category: Column) -> Column:
    c = F.regexp_replace(T.trim_white(F.coalesce(category, F.lit(""))), "^MKPOICategory", "")
    return F.lower(T.collapse_white(F.translate(F.regexp_replace(c, "(?<=.)([A-Z])", " $1"), "_-", "  ")))


def inferred_category(name: Column) -> Column:
    n = F.lower(T.trim_white(F.coalesce(name, F.lit(""))))
    out = None
    for words, meaning in NAME_CATEGORIES:
        test = T.contains_any(n, words)
        out = F.when(test, meaning) if out is None else out.when(test, meaning)
    return out.otherwise("")


def poi_category(category: Column, name: Column) -> Column:
    c = short_category(category)
    keep = ~c.isin(*REPLACED_CATEGORIES) & c.isin(*USEFUL_CATEGORIES)
    return F.when(keep, c).otherwise(inferred_category(name))


def useful_poi(category: Column, name: Column) -> Column:
    n, c = F.lower(T.trim_white(F.coalesce(name, F.lit("")))), poi_category(category, name)
    relevant = T.contains_any(n, RELEVANT_NAMES)
    return (n != "") & ~T.contains_any(n, LOW_VALUE_POIS) & F.when(c == "", relevant).otherwise(c.isin(*USEFUL_CATEGORIES) | relevant)


def distance_label(distance: Column) -> Column:
    return F.when(distance > 0, F.concat(F.bround(distance, 0).cast("bigint").cast("string"), F.lit("m"))).otherwise("")
