"""Evaluation sets: which assets, which original, which model, and why some are left out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..paths import safe_name
from ..prompts import PHOTO_CARD_VERSION, prompt
from .classify import live

#: (prompt text, image path) -> answer, for one model.
Call = Callable[[str, str, str], str]


def latest(assets: DataFrame, limit: int = 15) -> DataFrame:
    return live(assets).where("media_type = 'image'").orderBy(F.desc("creation_date"), "id").limit(limit)


def sampled(assets: DataFrame, limit: int = 15, seed: int = 1) -> DataFrame:
    """A random sample that the seed fixes."""
    return live(assets).where("media_type = 'image'").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit)


def resolve_originals(assets: DataFrame, originals: DataFrame, cache: DataFrame) -> DataFrame:
    """asset id -> path and origin: the library's original, else the cached file, else to be exported."""
    o = originals.select(F.col("asset_id").alias("_o"), F.col("path").alias("_op"))
    c = cache.select(F.col("asset_id").alias("_c"), F.col("path").alias("_cp"))
    j = assets.join(o, assets.id == F.col("_o"), "left").join(c, assets.id == F.col("_c"), "left")
    origin = F.when(F.col("_op").isNotNull(), "library").when(F.col("_cp").isNotNull(), "cache").otherwise("export")
    return j.select("id", F.coalesce("_op", "_cp").alias("path"), origin.alias("origin"))


def skip_histogram(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def pairs(inputs: DataFrame, models: list[str]) -> DataFrame:
    """Every input with every model of a fixed, short list."""
    return inputs.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def run_models(inputs: DataFrame, models: list[str], call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, concurrency: int = 4) -> DataFrame:
    """call over all pairs, at most `concurrency` at a time."""
    return pairs(inputs, models).repartition(max(1, concurrency)).mapInPandas(call, schema)


def cache_name(asset_id: Column, extension: Column) -> Column:
    return F.concat(F.substring(F.sha2(asset_id, 256), 1, 32), F.lit("."), extension)


def prompt_with_metadata(template: str, metadata: str) -> str:
    return template.replace("{{metadata}}", metadata) if "{{metadata}}" in template else f"{template.rstrip()}\n\n{metadata}"


def ordered_images(assets: DataFrame, sample: str = "latest", seed: int = 1) -> tuple[DataFrame, list[Column]]:
    """Live images, and the order in which an evaluation takes them."""
    if sample not in ("latest", "random"):
        raise ValueError(f'unsupported sample "{sample}"')
    images = live(assets).where("media_type = 'image'")
    return images, [F.desc("creation_date"), F.col("id")] if sample == "latest" else [F.xxhash64("id", F.lit(seed)), F.col("id")]


def prepare(assets: DataFrame, originals: DataFrame, cache: DataFrame, limit: int = 15, sample: str = "latest", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first `limit` images that have an original, named E001 and on; and the images passed over before the last of
    them, with the reason."""
    images, order = ordered_images(assets, sample, seed)
    found = resolve_originals(images, originals, cache)
    every = written(images.join(found, "id").withColumn("reason", F.when(F.col("path").isNull(), "original_not_available")), "images")
    chosen = [r.id for r in every.where("reason IS NULL").orderBy(*order).limit(limit).select("id").collect()]  # `limit` ids
    named = every.sparkSession.createDataFrame([(k, f"E{i:03}") for i, k in enumerate(chosen, 1)], "id string, eval_id string")
    passed = every.where("reason IS NOT NULL")
    if len(chosen) == limit:
        last = every.where(F.col("id") == chosen[-1])
        if sample == "latest":
            last = last.select(F.col("creation_date").alias("_d"), F.col("id").alias("_i"))
            before = (F.col("creation_date") > F.col("_d")) | ((F.col("creation_date") == F.col("_d")) & (F.col("id") < F.col("_i")))
        else:
            last = last.select(F.xxhash64("id", F.lit(seed)).alias("_d"), F.col("id").alias("_i"))
            own = F.xxhash64("id", F.lit(seed))
            before = (own < F.col("_d")) | ((own == F.col("_d")) & (F.col("id") < F.col("_i")))
        passed = passed.join(F.broadcast(last), before, "left_semi")
    return every.join(F.broadcast(named), "id"), passed


def run(assets: DataFrame, originals: DataFrame, cache: DataFrame, out: str, models: list[str], call: Call | None = None, template: str | None = None, limit: int = 15, sample: str = "latest", seed: int = 1, concurrency: int = 4) -> dict:
    """An evaluation: manifest, metadata, raw answers and summary as JSON below `out`; returns the summary.

    call(model, prompt, image path) answers for one image; what it raises counts as a failed call.
    """
    spark = assets.sparkSession
    limit = limit if limit > 0 else 15
    template = prompt() if template is None else template
    chosen, passed = prepare(assets, originals, cache, limit, sample, seed)
    manifest = chosen.select("eval_id", F.col("path").alias("image_path"), F.col("id").alias("asset_id"), F.col("origin").alias("original_mode"))
    manifest.coalesce(1).sortWithinPartitions("eval_id").write.mode("overwrite").json(f"{out}/manifest")
    metadata = F.to_json(F.struct("eval_id", F.lit(PHOTO_CARD_VERSION).alias("prompt_version"), F.struct(*[c for c in assets.columns]).alias("asset"), F.struct("origin", "path").alias("original")))
    inputs = written(chosen.select("eval_id", "path", metadata.alias("metadata")), "eval-inputs")
    inputs.select("eval_id", "metadata").write.mode("overwrite").json(f"{out}/metadata")
    summary = {
        "output_dir": out, "prompt_sha256": hashlib.sha256(template.encode()).hexdigest(), "prompt_version": PHOTO_CARD_VERSION, "models": models, "limit": limit, "sample": sample, "assets_seen": ordered_images(assets, sample, seed)[0].count(), "assets_prepared": inputs.count(),
        "assets_skipped": {r.reason: r.n for r in skip_histogram(passed).collect()}, "model_calls_attempted": 0, "model_calls_succeeded": 0, "model_calls_failed": 0,
    }
    if models and call is not None:

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    answer, error = None, None
                    try:
                        answer = call(r.model, prompt_with_metadata(template, r.metadata), r.path)
                    except Exception as e:  # noqa: BLE001  a failed call is counted, the others go on
                        error = str(e) or type(e).__name__
                    rows.append((r.eval_id, safe_name(r.model), answer, error))
                yield pd.DataFrame(rows, columns=["eval_id", "model", "answer", "error"])

        asked = written(run_models(inputs, models, ask, "eval_id string, model string, answer string, error string", concurrency), "eval-answers")
        asked.write.mode("overwrite").partitionBy("model").json(f"{out}/raw")
        n = asked.agg(F.count("*").alias("a"), F.count("answer").alias("s"), F.count("error").alias("f")).first()
        summary |= {"model_calls_attempted": n.a, "model_calls_succeeded": n.s, "model_calls_failed": n.f}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    return summary
