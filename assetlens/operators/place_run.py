"""Places looked up by an injected provider: one by one behind a cache, or all places of an archive in rounds.

A provider is a Python function (latitude, longitude, accuracy, radius) -> JSON text of a result; what it raises is an
error of that attempt. It runs in Spark tasks, `workers` of them at a time, each with its share of the allowed rate.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from . import place as P
from . import place_card

Lookup = Callable[[float, float, float, float], str]
#: Metres around a place, rounds, tasks at a time, seconds between starts, seconds of rest when throttled.
RADIUS, ROUNDS, WORKERS, START_EVERY, COOLDOWN = 150.0, 4, 4, 1.5, 120.0
#: Words of an error that ask for a rest.
THROTTLED = ("throttl", "rate limit", "too many requests")
_TRIED = "latitude double, longitude double, accuracy double, result string, error string, started_at string"


def paced(lookup: Lookup, radius: float = RADIUS, every: float = START_EVERY * WORKERS, cooldown: float = COOLDOWN, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A mapInPandas function that calls lookup for every row, at most once in `every` seconds of its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = clock()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if (wait := free - clock()) > 0:
                    sleep(wait)
                free = clock() + every
                started, result, error = datetime.now(timezone.utc).isoformat(), None, None
                try:
                    result = lookup(r.latitude, r.longitude, r.accuracy, radius)
                    json.loads(result)
                except Exception as e:  # noqa: BLE001  whatever the provider raises is the error of this attempt
                    result, error = None, str(e) or type(e).__name__
                    if any(w in error.lower() for w in THROTTLED):
                        free = clock() + cooldown
                out.append((r.latitude, r.longitude, r.accuracy, result, error, started))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _TRIED.split(", ")])

    return run


def complete(raw: Column) -> Column:
    """The provider's JSON as a result struct with area and status, its nearest candidates alone kept."""
    r = F.from_json(raw, place_card.RESULT)
    found = F.coalesce(r["poi_candidates"], F.array().cast("array<struct<name:string,category:string,distance_m:double>>"))
    nearest = F.transform(F.slice(F.array_sort(F.transform(found, lambda c: F.struct(c["distance_m"].alias("d"), c["name"].alias("n"), c.alias("c")))), 1, P.CANDIDATES), lambda x: x["c"])
    area = F.when(F.size(F.coalesce(r["area"], F.array())) > 0, r["area"]).otherwise(P.area_levels(r["address"]))
    status = P.poi_status(r["provider_error"], F.size(found))
    return r.withField("area", area).withField("poi_candidates", nearest).withField("poi_status", status)


def load_results(rows: DataFrame, raw: str = "result") -> DataFrame:
    """rows with the result struct parsed from JSON text; a status that is none of the three is an error."""
    r = F.from_json(F.col(raw), place_card.RESULT)
    status = r["poi_status"]
    known = F.coalesce(status.isin(P.FOUND, P.NONE, P.PROVIDER_ERROR), F.lit(False))
    checked = F.when(known, r).otherwise(F.raise_error(F.concat(F.lit("unknown place status: "), F.coalesce(status, F.lit("none given")))))
    return rows.withColumn(raw, checked)


def run_places(inputs: DataFrame, cache: str, lookup: Lookup, radius: float = RADIUS, workers: int = WORKERS, **pace) -> DataFrame:
    """inputs (latitude, longitude, accuracy, and columns of their own) with result and cached.

    The cache is a Parquet folder by key of place and radius; only complete results are used again. Each place that is
    not there is looked up once, however many inputs have it; what the provider can't say raises here.
    """
    spark = inputs.sparkSession
    radius = radius if radius > 0 else RADIUS
    on = ["latitude", "longitude", "accuracy"]
    keyed = inputs.where(P.valid_location(F.col("latitude"), F.col("longitude"))).withColumn("key", P.cache_key(*[F.col(c) for c in on], F.lit(radius)))
    try:
        known = spark.read.schema("key string, status string, result string").parquet(cache)
        known.take(1)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "key string, status string, result string")
    hits, misses = P.cached_results(keyed, known.dropDuplicates(["key"]))
    asked = misses.select("key", *on).dropDuplicates(["key"]).repartition(workers)
    tried = written(asked.select(*on).mapInPandas(paced(lookup, radius, **pace), _TRIED), "place-run")
    failed = F.raise_error(F.concat(F.lit("place lookup failed: "), F.col("error")))
    fresh = tried.withColumn("result", F.when(F.col("error").isNull(), F.to_json(complete(F.col("result")))).otherwise(failed))
    fresh = fresh.select(P.cache_key(*[F.col(c) for c in on], F.lit(radius)).alias("key"), F.get_json_object("result", "$.poi_status").alias("status"), "result")
    fresh = written(fresh, "place-fresh")
    fresh.where(F.col("status").isin(P.FOUND, P.NONE)).write.mode("append").parquet(cache)
    new = misses.join(fresh, "key").withColumn("cached", F.lit(False))
    return hits.unionByName(new).drop("key", "status")


def backfill(assets: DataFrame, locations: DataFrame, out: str, lookup: Lookup, rounds: int = ROUNDS, workers: int = WORKERS, wait: Callable[[float], None] = time.sleep, **pace) -> dict:
    """Look up every place of the archive's live assets once; again, in rounds, what failed. Returns the summary.

    Below `out` as JSON: manifest (the places), outputs (complete results), attempts (every try), errors (places that
    failed to the end), progress (a line a round) and summary. A later run begins with the outputs and attempts that are
    there: places that have an output are not asked again.
    """
    spark = assets.sparkSession
    began = datetime.now(timezone.utc)
    on = ["latitude", "longitude", "accuracy"]
    keys = P.indexed_keys(P.backfill_keys(assets, locations))
    keys.write.mode("overwrite").json(f"{out}/manifest")
    keys = spark.read.schema(keys.schema).json(f"{out}/manifest")
    schema = f"{_TRIED}, attempt int"

    def attempts() -> DataFrame:
        try:
            found = spark.read.schema(schema).json(f"{out}/attempts")
            found.take(1)
            return found
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    existing = keys.count() - P.backfill_jobs(keys.select(*on), attempts().where("error IS NULL").select(*on), attempts().limit(0).select(*on), 1).count()
    for n in range(1, rounds + 1):
        done = attempts()
        todo = P.backfill_jobs(keys.select(*on), done.where("error IS NULL").select(*on), done.select(*on), n)
        if todo.isEmpty():
            continue
        if n > 1:
            wait(60.0 * P.RETRY_MINUTES.get(n, 30))
        tried = written(todo.select(*on).repartition(workers).mapInPandas(paced(lookup, **pace), _TRIED), "backfill-round").withColumn("attempt", F.lit(n))
        ok = tried.where("error IS NULL").withColumn("result", F.to_json(complete(F.col("result"))))
        ok.select(*on, "result").write.mode("append").json(f"{out}/outputs")
        tried.write.mode("append").json(f"{out}/attempts")
        seconds = (datetime.now(timezone.utc) - began).total_seconds()
        count = tried.agg(F.count("*").alias("attempts"), F.count("result").alias("ok"), F.count("error").alias("attempt_failures"))
        count.withColumns({"round": F.lit(n), "per_second": F.round(F.col("attempts") / F.lit(max(seconds, 1e-3)), 2)}).write.mode("append").json(f"{out}/progress")
    every = attempts()
    ledger = P.attempt_ledger(every.withColumn("key", P.coordinate_key(*[F.col(c) for c in on])), rounds)
    ledger.where("error IS NOT NULL AND final").write.mode("overwrite").json(f"{out}/errors")
    got = ledger.agg(F.count_if(F.col("error").isNull()).alias("successes"), F.count_if(F.col("error").isNotNull() & F.col("final")).alias("final_failures"))
    sums = every.agg(F.count("*").alias("provider_attempts"), F.count("error").alias("attempt_failures"), F.count_if(F.lower("error").rlike("|".join(THROTTLED))).alias("provider_cooldowns"))
    place = keys.agg(F.coalesce(F.sum("asset_count"), F.lit(0)).alias("located_assets"), F.count("*").alias("location_keys"))
    summary = {k: v for df in (place, got, sums) for k, v in df.first().asDict().items()}  # one row each
    summary |= {"output_dir": out, "existing_successes": existing, "radius_meters": RADIUS, "max_attempts_per_key": rounds, "workers": workers, "provider_start_every": START_EVERY, "started_at": began.isoformat(), "finished_at": datetime.now(timezone.utc).isoformat()}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    return summary
