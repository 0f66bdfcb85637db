"""Derivation: the rule classifier, the queue, and observations from model payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.ids import stable_id
from ..functions.scratch import written
from .merge import keep_old, replace_scope

RULE_SOURCE, RULE_MODEL = "archive_metadata", "metadata_rules_v1"
#: Fixed values of evidence rows: kinds, and the version of what the rules are given.
RULE_EVIDENCE, MODEL_EVIDENCE, INPUT_VERSION = "classification_input", "content_classification", "asset-resource-album.v1"
#: Fixed values of the rule classifier: label, confidence, words that any of must occur in the keyword text.
SIGNALS = (
    ("screenshot_candidate", 0.75, ("screenshot", "screen shot")),
    ("receipt_candidate", 0.65, ("receipt", "invoice", "bill", "statement")),
    ("document_candidate", 0.6, ("document", "passport", "ticket", "boarding pass", "menu")),
)
#: Fixed values of model payloads: JSON key, observation type, confidence, term type.
PAYLOAD_KEYS = (
    ("scene_summary", "scene_summary", 0.65, "scene"),
    ("visible_text_summary", "visible_text_summary", 0.6, "visible_text"),
    ("place_candidates", "place_type_candidate", 0.45, "place_type_candidate"),
    ("landmark_candidates", "landmark_or_place_name_candidate", 0.45, "landmark_or_place_name_candidate"),
    ("merchant_or_venue_candidates", "merchant_or_venue_name_candidate", 0.45, "merchant_or_venue_name_candidate"),
    ("food_or_objects", "object_or_food", 0.55, "object_or_food"),
    ("people_presence", "people_presence", 0.55, "people_presence"),
    ("privacy_sensitivity", "privacy_sensitivity", 0.6, "privacy_sensitivity"),
    ("cluster_terms", "cluster_feature", 0.55, "cluster_feature"),
    ("uncertainties", "model_uncertainty", 0.5, "model_uncertainty"),
)
#: Fragments of the prompt that betray a leak, the first found counts.
LEAKS = ("return only valid compact", "do not use markdown fences", "use candidates, not truth", "keys:")
LEAK = "model_prompt_leakage"
TEXT_LIMIT, REASON_LIMIT = 500, 200


def live(df: DataFrame) -> DataFrame:
    return df.where("deleted_at IS NULL")


def inputs(assets: DataFrame, resources: DataFrame, albums: DataFrame) -> DataFrame:
    """Each live asset with its live resources and its albums as sorted arrays, and its keyword text."""
    r = live(resources).groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("resource_type", "original_filename", "uti", "local_path", "available_locally", "needs_download"))).alias("resources")
    )
    m = albums.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("album_title", "album_id", "album_kind"))).alias("albums"))
    a = live(assets).withColumnRenamed("id", "asset_id").join(r, "asset_id", "left").join(m, "asset_id", "left")
    of = lambda c, f: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), f), " ")
    words = F.concat_ws(
        " ",
        "media_type",
        "media_subtypes",
        "metadata_json",
        of("resources", lambda x: F.concat_ws(" ", x["resource_type"], x["uti"], x["original_filename"])),
        of("albums", lambda x: F.concat_ws(" ", x["album_title"], x["album_kind"])),
    )
    return a.withColumn("keywords", F.lower(words))


def has_local_content(resources: Column) -> Column:
    return F.coalesce(F.exists(resources, lambda r: r["available_locally"] | (F.trim(r["local_path"]) != "")), F.lit(False))


def rules(rows: DataFrame) -> DataFrame:
    """inputs() -> asset_id, observation_type, label, confidence; each (type, label) once per asset, sent through explode."""
    item = lambda kind, label, confidence: F.struct(F.lit(kind).alias("observation_type"), label.alias("label"), F.lit(float(confidence)).alias("confidence"))
    w, h = F.col("width"), F.col("height")
    local = F.when(has_local_content(F.col("resources")), "local_content_available").otherwise("local_content_unavailable")
    single = [
        item("media_type", T.non_blank(F.col("media_type")), 1),
        item("content_availability", local, 1),
        item("geometry", F.when((w > 0) & (h > 0), F.when(w > h, "landscape").when(h > w, "portrait").otherwise("square")), 1),
        item("capture_mode", F.when(T.non_blank(F.col("burst_identifier")).isNotNull(), "burst_member"), 1),
    ]
    # The text is put together once, not for every word that is sought in it.
    signals = F.flatten(F.transform(F.array("keywords"), lambda text: F.array(*[item("document_signal", F.when(T.contains_any(text, words), label), confidence) for label, confidence, words in SIGNALS])))
    each = lambda kind, field: F.transform(F.coalesce(F.col("resources"), F.array()), lambda r: item(kind, T.non_blank(r[field]), 1))
    every = F.concat(F.array(*single), signals, each("resource_type", "resource_type"), each("resource_uti", "uti"))
    found = F.array_distinct(F.filter(every, lambda o: o["label"].isNotNull()))
    # No list is empty; of explode, Spark would make each list once more to see that.
    return rows.select("asset_id", F.explode_outer(found).alias("o")).select("asset_id", "o.*")


def classify_rules(assets: DataFrame, resources: DataFrame, albums: DataFrame) -> DataFrame:
    """visual_observation rows of the rule classifier."""
    return rule_rows(inputs(assets, resources, albums))


def rule_rows(rows: DataFrame) -> DataFrame:
    return rules(rows).select(
        stable_id("visual_observation", F.col("asset_id"), RULE_SOURCE, F.col("observation_type"), F.col("label")).alias("id"),
        "asset_id",
        "observation_type",
        "label",
        "confidence",
        F.lit("{}").alias("bounding_box_json"),
        F.lit(RULE_SOURCE).alias("source"),
        F.lit(RULE_MODEL).alias("model_id"),
        rule_evidence_id().alias("evidence_id"),
    )


def rule_evidence_id() -> Column:
    return stable_id("evidence", F.col("asset_id"), RULE_EVIDENCE, RULE_SOURCE, INPUT_VERSION)


def rule_evidence(rows: DataFrame, at: str | Column) -> DataFrame:
    """evidence_ref rows of inputs() rows (with needs_download, if the queue's is known): what the rules have seen of each asset."""
    needs = F.col("needs_download") if "needs_download" in rows.columns else F.lit(False)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    seen = {
        "album_count": size("albums"), "classified_at": F.lit(at) if isinstance(at, str) else at, "classifier": F.lit(RULE_SOURCE), "content_not_opened": F.lit(True), "creation_date": F.col("creation_date"), "favorite": F.col("favorite"),
        "has_local_content": has_local_content(F.col("resources")), "height": F.col("height"), "hidden": F.col("hidden"), "input_version": F.lit(INPUT_VERSION), "media_subtypes": F.col("media_subtypes"), "media_type": F.col("media_type"),
        "metadata_only": F.lit(True), "model_id": F.lit(RULE_MODEL), "needs_download": needs, "resource_count": size("resources"), "width": F.col("width"),
    }
    value = F.to_json(F.struct(*[v.alias(k) for k, v in seen.items()]))
    return rows.select(rule_evidence_id().alias("id"), "asset_id", F.lit(RULE_EVIDENCE).alias("evidence_kind"), F.lit(RULE_SOURCE).alias("source"), F.concat("asset_id", F.lit("/classification/archive_metadata")).alias("pointer"), value.alias("value_json"))


def queue(queue_rows: DataFrame, assets: DataFrame, with_model: bool = False, limit: int | None = 100) -> DataFrame:
    """What a run takes: pending rows first, then newest, then by id; with a model also rows that failed or lack content."""
    if limit is not None:
        limit = min(limit if limit > 0 else 100, 1000)
    states = ["pending", "metadata_classified", "content_failed"] if with_model else ["pending"]
    a = live(assets).select(F.col("id").alias("asset_id"), "creation_date")
    rows = queue_rows.where(F.col("state").isin(states)).join(a, "asset_id")
    rows = rows.orderBy(F.when(F.col("state") == "pending", 0).otherwise(1), F.desc("creation_date"), "id")
    return rows.limit(limit) if limit is not None else rows


def next_states(rows: DataFrame, with_model: bool, outcome: Column | None = None) -> DataFrame:
    """Queue state and reason of inputs() rows after a run; outcome is null, or the model's error, or '' for success.

    After the rule pass an asset is metadata_classified. With a model: assets without an image are content_unavailable
    if no image can come, a failed call is content_failed, a good one content_classified.
    """
    local = has_local_content(F.col("resources"))
    state, reason = F.lit("metadata_classified"), F.when(local, "local_metadata_observations").otherwise("local_metadata_observations_waiting_for_content")
    if with_model:
        none = content_image(F.col("resources")).isNull() & unavailable(F.col("media_type"), F.col("resources"))
        outcome = F.lit(None).cast("string") if outcome is None else outcome
        state = F.when(none, "content_unavailable").when(outcome == "", "content_classified").when(outcome.isNotNull(), "content_failed").otherwise(state)
        reason = F.when(none, "local_model_no_image_content").when(outcome == "", "local_model_observations").when(outcome.isNotNull(), T.cut(outcome, REASON_LIMIT)).otherwise(reason)
    return rows.select("asset_id", state.alias("state"), reason.alias("reason"))


IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "gif", "tif", "tiff", "webp")


def content_image(resources: Column) -> Column:
    """Path of the first resource, by type and name, that is a local image a model can read."""
    images = F.filter(resources, lambda r: F.lower(F.regexp_extract(r["local_path"], r"\.([^./]*)$", 1)).isin(*IMAGE_EXTENSIONS))
    return F.get(F.transform(images, lambda r: r["local_path"]), 0)


def unavailable(media_type: Column, resources: Column) -> Column:
    """No content will ever come: not an image, or an image of which nothing is to be downloaded and nothing is here."""
    return F.when(media_type != "image", F.lit(True)).otherwise(~F.coalesce(F.exists(resources, lambda r: r["needs_download"]), F.lit(False)))


#: What a model call answers for an image; a column that it leaves out is null.
ANSWER = "asset_id string, response string, error string, endpoint string, image_bytes bigint, image_sha256 string, requests bigint, responses bigint"
Call = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def answers(rows: DataFrame, call: Call) -> DataFrame:
    """ANSWER rows, and path, of the images among inputs() rows; written, as a model that is asked again may answer otherwise.

    An answer without a JSON object is an error.
    """
    names = [c.split()[0] for c in ANSWER.split(", ")]

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in call(batches):
            yield found.reindex(columns=names)

    images = rows.where("media_type = 'image'").select("asset_id", content_image(F.col("resources")).alias("path")).where("path IS NOT NULL")
    got = images.mapInPandas(asked, ANSWER)
    bad = F.col("error").isNull() & payload_json(F.col("response")).isNull()
    got = written(got.withColumn("error", F.when(bad, "the model's answer holds no JSON object").otherwise(F.col("error"))), "answers")
    return got.join(images, "asset_id")


def drain(store, with_model: bool = False, limit: int | None = 100, call: Call | None = None, model_id: str = "local", prompt_version: str = "v1", at: datetime | None = None) -> dict:
    """Classify what the queue holds; commit observations, their evidence, the model run and states at once. Returns counters.

    call, if given, is a mapInPandas function from (asset_id, path) to columns of ANSWER: asset_id, response and error at
    least. Models are asked once. If other commits come between, the rest is made again on the new tables, without the
    assets that were deleted, queued anew or classified meanwhile: those wait for the next run.
    Only answers without error replace earlier observations, and only those of the same model.
    """
    now = (at or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    model = with_model or call is not None
    t = store.tables()
    taken = queue(t["classification_queue"], t["asset"], model, limit)
    taken = written(taken.select("asset_id", F.col("state").alias("_state"), F.col("updated_at").alias("_at"), "needs_download"), "taken")
    given = None
    if call is not None:
        chosen = t["asset"].join(taken, t["asset"].id == taken.asset_id, "left_semi")
        given = written(answers(inputs(chosen, t["asset_resource"], t["album_membership"]), call), "answers")
    return store.transact(lambda tables: _classify(tables, taken, given, model, model_id, prompt_version, now))


def _classify(t, taken: DataFrame, given: DataFrame | None, model: bool, model_id: str, prompt_version: str, now: str) -> dict:
    """Put new versions of the tables that a run over the taken assets changes; its counters."""
    from .index import Index
    from .merge import merge
    from .search import observation_documents

    touched = t.touched(taken)
    old = {name: t.part(name, touched) for name in ("classification_queue", "asset", "asset_resource", "album_membership", "visual_observation", "model_observation", "observation_term", "evidence_ref")}
    q = old["classification_queue"]
    same = q.join(taken, (q.asset_id == taken.asset_id) & q.state.eqNullSafe(taken._state) & q.updated_at.eqNullSafe(taken._at), "left_semi").select("asset_id")
    chosen = live(old["asset"]).join(same, F.col("id") == F.col("asset_id"), "left_semi")
    rows = written(inputs(chosen, old["asset_resource"], old["album_membership"]).join(taken.select("asset_id", "needs_download"), "asset_id"), "rows")
    found = written(rule_rows(rows), "found")
    scope = rows.select("asset_id", F.lit(RULE_SOURCE).alias("source"), F.lit(RULE_MODEL).alias("model_id"))
    visual, modelled = t.put("visual_observation", replace_scope(old["visual_observation"], found, scope, ["asset_id", "source", "model_id"]), touched), old["model_observation"]
    evidence = rule_evidence(rows, now)
    out: dict = {"classifier": RULE_SOURCE, "model_id": RULE_MODEL, "input_version": INPUT_VERSION, "visual_observations_written": found.count()}
    outcome, states_of = None, rows
    if given is not None:
        known = given.join(rows.select("asset_id"), "asset_id", "left_semi")
        good = known.where("error IS NULL")
        contents = observations(good.select("asset_id", "response"), "response")
        made = written(model_rows(contents, model_id, prompt_version), "model")
        scope = good.select("asset_id", F.lit(MODEL_SOURCE).alias("source"), F.lit(model_id).alias("model_id"))
        on = ["asset_id", "source", "model_id"]
        modelled = t.put("model_observation", replace_scope(old["model_observation"], made, scope, on), touched)
        t.put("observation_term", replace_scope(old["observation_term"], term_rows(contents, model_id, prompt_version), scope, on), touched)
        evidence = evidence.union(model_evidence(good, model_id, prompt_version, now))
        run = written(model_run(known, rows.count(), model_id, prompt_version, now), "run")
        t.put("model_run", merge(t["model_run"], run, ("id",), {"started_at": keep_old}))
        states_of = rows.join(known.select("asset_id", F.coalesce("error", F.lit("")).alias("outcome")), "asset_id", "left")
        outcome = F.col("outcome")
        met = known.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("content_classified", F.col("error").isNull().cast("bigint")), ("content_classification_failures", F.col("error").isNotNull().cast("bigint")), ("requests", F.col("requests")), ("responses", F.col("responses")))]).first()
        out |= {"local_model": model_id, "model_run_id": run.first().id, "content_classified": met.content_classified, "content_classification_failures": met.content_classification_failures, "content_observations_written": made.count(), "local_model_http_request_attempts": met.requests, "local_model_http_responses": met.responses}
    t.put("evidence_ref", merge(old["evidence_ref"], evidence, ("id",)), touched)
    index = Index(t, "observation_documents")
    if index.exists:
        of = lambda df: df.join(same, "asset_id", "left_semi")
        ids = reduce(DataFrame.union, [of(df).select("id") for df in (old["visual_observation"], old["model_observation"], visual, modelled)])
        index.update(ids, observation_documents(of(visual), of(modelled)))
    else:
        index.update(None, observation_documents(t.latest("visual_observation"), t.latest("model_observation")))
    states = written(next_states(states_of, model, outcome).join(rows.select("asset_id", has_local_content(F.col("resources")).alias("local")), "asset_id"), "states")
    new = q.drop("state", "reason", "updated_at").join(states.drop("local"), "asset_id").withColumn("updated_at", F.lit(now))
    t.put("classification_queue", merge(q, new.select(q.columns), ("asset_id",)), touched)
    counts = {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    waiting = states.where("NOT local AND state <> 'content_unavailable'").count()
    return {"processed": total, "metadata_classified": total, "waiting_for_local_content": waiting, **out, "states": counts}


# Model payloads

MODEL_SOURCE = "local_model"


def payload_json(response: Column) -> Column:
    """From the first brace to the last, if that is JSON; else null."""
    inner = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def simple_texts(value: Column) -> Column:
    """Texts of a JSON value that is a string, or a list of strings and of objects with a name (one level)."""
    listed = F.from_json(value, "array<string>")
    own = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")
    each = F.when(value.startswith("["), listed).otherwise(own)
    named = lambda x: F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("name", "label", "text", "value", "candidate")], x)
    each = F.transform(F.filter(each, lambda x: x.isNotNull()), lambda x: T.cut(F.when(x.startswith("{"), named(x)).otherwise(x), TEXT_LIMIT))
    return F.filter(each, lambda x: x != "")


def observations(rows: DataFrame, response: str) -> DataFrame:
    """rows (keyed by their other columns) -> observation_type, value_text, confidence, term_type of the JSON answer.

    Each (type, text) once. A leaked prompt gives one quality_issue.
    """
    keys = [c for c in rows.columns if c != response]
    parsed = rows.withColumn("_json", payload_json(F.col(response))).where("_json IS NOT NULL")
    raw = F.from_json("_json", "map<string,string>")
    parts = [_typed(F.col("_map")[key], kind, c, tt) for key, kind, c, tt in PAYLOAD_KEYS]
    leaked = T.contains_any(F.lower("_json"), LEAKS)
    issue = F.struct(F.lit("quality_issue").alias("observation_type"), F.lit(LEAK).alias("value_text"), F.lit(1.0).alias("confidence"), F.lit("quality_issue").alias("term_type"))
    parts.append(F.when(leaked, F.array(issue)).otherwise(F.array().cast("array<struct<observation_type:string,value_text:string,confidence:double,term_type:string>>")))
    found = parsed.withColumn("_map", raw).select(*keys, F.explode(F.array_distinct(F.concat(*parts))).alias("o"))
    return found.select(*keys, "o.*")


def _typed(value: Column, kind: str, confidence: float, term_type: str) -> Column:
    def item(t: Column) -> Column:
        return F.struct(F.lit(kind).alias("observation_type"), t.alias("value_text"), F.lit(float(confidence)).alias("confidence"), F.lit(term_type).alias("term_type"))

    texts = simple_texts(F.when(value.startswith("[") | value.startswith("{"), value).otherwise(F.to_json(F.array(value))))
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), item)


def model_evidence_id(model_id: str, prompt_version: str) -> Column:
    return stable_id("evidence", F.col("asset_id"), MODEL_EVIDENCE, MODEL_SOURCE, model_id, prompt_version)


def model_evidence(given: DataFrame, model_id: str, prompt_version: str, at: str) -> DataFrame:
    """evidence_ref rows of answers() without error: what was sent where, and what came back."""
    known = F.col("endpoint").isNotNull()
    seen = {
        "classified_at": F.lit(at), "classifier": F.lit(MODEL_SOURCE), "endpoint": F.col("endpoint"), "image_extension": F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)), "image_path_class": path_class(F.col("path")),
        "image_sha256": F.col("image_sha256"), "image_transmitted": known, "model_id": F.lit(model_id), "parsed_response": payload_json(F.col("response")), "prompt_version": F.lit(prompt_version), "raw_response": F.col("response"),
        "transmitted_image_bytes": F.col("image_bytes"),
    }
    value = F.to_json(F.struct(*[v.alias(k) for k, v in seen.items()]))
    return given.select(model_evidence_id(model_id, prompt_version).alias("id"), "asset_id", F.lit(MODEL_EVIDENCE).alias("evidence_kind"), F.lit(MODEL_SOURCE).alias("source"), F.concat("asset_id", F.lit("/classification/local_multimodal")).alias("pointer"), value.alias("value_json"))


def model_run(given: DataFrame, inputs_taken: int, model_id: str, prompt_version: str, at: str) -> DataFrame:
    """The model_run row of a run: its answers and failures, the requests they took and the endpoints that answered."""
    number = lambda c: F.coalesce(F.sum(F.expr(c).cast("bigint")), F.lit(0))
    met = given.agg(
        number("error IS NULL").alias("content_classified"), number("error IS NOT NULL").alias("failures"), number("requests").alias("http_request_attempts"), number("responses").alias("http_responses_received"),
        F.array_sort(F.collect_set("endpoint")).alias("response_endpoints"),
    )
    value = F.to_json(F.struct("content_classified", "failures", "http_request_attempts", "http_responses_received", "response_endpoints", F.col("content_classified").alias("successful_classifications")))
    return met.select(
        stable_id("model_run", MODEL_SOURCE, model_id, prompt_version, at).alias("id"), F.lit(model_id).alias("model_id"), F.lit(MODEL_SOURCE).alias("source"), F.lit(prompt_version).alias("prompt_version"),
        F.lit(at).alias("started_at"), F.lit(at).alias("completed_at"), F.lit(inputs_taken).cast("bigint").alias("input_count"), value.alias("metadata_json"),
    )


def model_observation_id(model_id: str, prompt_version: str) -> Column:
    return stable_id("model_observation", F.col("asset_id"), MODEL_SOURCE, model_id, prompt_version, F.col("observation_type"), F.col("value_text"))


def model_rows(contents: DataFrame, model_id: str = "local", prompt_version: str = "v1") -> DataFrame:
    return contents.select(
        model_observation_id(model_id, prompt_version).alias("id"),
        "asset_id",
        "observation_type",
        "value_text",
        F.to_json(F.struct(F.col("value_text").alias("text"))).alias("value_json"),
        "confidence",
        F.lit(MODEL_SOURCE).alias("source"),
        F.lit(model_id).alias("model_id"),
        F.lit(prompt_version).alias("prompt_version"),
        model_evidence_id(model_id, prompt_version).alias("evidence_id"),
    )


def term_rows(contents: DataFrame, model_id: str = "local", prompt_version: str = "v1") -> DataFrame:
    rows = contents.select("asset_id", model_observation_id(model_id, prompt_version).alias("observation_id"), "term_type", F.explode(T.terms(F.col("value_text"))).alias("term"))
    at = stable_id("observation_term", F.col("asset_id"), F.col("observation_id"), F.col("term"))
    return rows.select(at.alias("id"), "asset_id", "observation_id", "term", "term_type", F.lit(MODEL_SOURCE).alias("source"), F.lit(model_id).alias("model_id"))


@F.pandas_udf(ArrayType(StringType()))
def value_texts(values: pd.Series) -> pd.Series:
    """All texts of a JSON value, at any depth: strings, list members, the naming field of objects, booleans, numbers."""
    import json

    def walk(v) -> list[str]:
        if v is None:
            return []
        if isinstance(v, list):
            return [t for x in v for t in walk(x)]
        if isinstance(v, bool):
            return ["true" if v else "false"]
        if isinstance(v, (int, float)):
            return [f"{float(v):g}"]
        if isinstance(v, dict):
            named = next((v[k] for k in ("name", "label", "text", "value", "candidate") if isinstance(v.get(k), str)), None)
            v = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if named is None else named
        t = " ".join(v.split()).encode()[:TEXT_LIMIT].decode(errors="ignore").strip()
        return [t] if t else []

    def texts(raw):
        try:
            return None if raw is None else walk(json.loads(raw))
        except ValueError:
            return []

    return values.map(texts)


def path_class(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("derivative"), "derivative").when(p.contains("render"), "render").when(p.contains("original"), "original").otherwise("local_media")


def dedupe_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
