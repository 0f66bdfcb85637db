"""Registered queries of the archive operators: name -> (Spark function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import stable_id
from ..functions.scratch import scratch
from ..functions.times import instant, julian_day, millis
from ..operators import classify as C
from ..operators import crawl as G
from ..operators import detail, evaluation, place, place_card, search, status
from ..operators import migrate as M
from ..operators import neighbors as N
from ..operators import timeline as TL
from ..operators.merge import merge
from ..sources import library as L
from ..sources.views import Views
from .oracle import JD, sid, with_tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Query]:
    def add(f: Callable[[Views], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        REGISTRY[name] = (run, sql)
        return run

    return add


class Tables(dict):
    """The archive tables by name, built from views when first asked for."""

    def __init__(self, v: Views):
        super().__init__()
        self.v = v

    def __missing__(self, name: str) -> DataFrame:
        made = getattr(self.v, name)() if hasattr(self.v, name) else self.v.empty(name)
        self[name] = made
        return made


# Timeline (H6)

FROM, TO = "2024-01-03T02:00:00+02:00", "2024-01-20T00:00:00Z"
_TIMELINE = (
    with_tables("asset", "album_membership", "location_observation", "classification_queue")
    + f"""SELECT a.id AS asset_id, l.id AS location_observation_id, creation_date AS created_at, media_type,
  coalesce(TRY_CAST(json_extract_string(metadata_json, '$.source_type') AS BIGINT), 0) AS source_type,
  coalesce((SELECT '[' || string_agg('{{"id":"' || album_id || '","title":"' || album_title || '","kind":"' || album_kind || '"}}', ',' ORDER BY album_id) || ']' FROM album_membership m WHERE m.asset_id = a.id), '[]') AS albums,
  coalesce(l.id, a.id) AS source_ref, latitude, longitude, horizontal_accuracy AS accuracy_meters,
  CASE WHEN horizontal_accuracy IS NOT NULL THEN horizontal_accuracy >= 0 AND horizontal_accuracy <= 100 END AS is_precise
FROM asset a {{join}} JOIN location_observation l ON l.asset_id = a.id
WHERE {JD.format("creation_date")} >= {JD.format("'2024-01-03 00:00:00'")} AND {JD.format("creation_date")} < {JD.format("'2024-01-20 00:00:00'")}
  AND NOT EXISTS (SELECT 1 FROM classification_queue q WHERE q.asset_id = a.id AND q.state = 'deleted')"""
).replace("{{", "{").replace("}}", "}")


@query("timeline_located", _TIMELINE.replace("{join}", ""))
def timeline_located(v: Views) -> DataFrame:
    return TL.timeline(Tables(v), FROM, TO)


@query("timeline_all", _TIMELINE.replace("{join}", "LEFT"))
def timeline_all(v: Views) -> DataFrame:
    return TL.timeline(Tables(v), FROM, TO, include_unlocated=True)


# Status (H2 to H5)

_GROUPED = {
    "asset_media_type": ("asset.media_type", ("asset",), "SELECT media_type AS k FROM asset WHERE deleted_at IS NULL"),
    "resource_availability": (
        "resource.availability",
        ("asset", "asset_resource"),
        "SELECT CASE WHEN available_locally THEN 'local' WHEN needs_download THEN 'remote_needs_download' ELSE 'unknown' END AS k FROM asset_resource WHERE deleted_at IS NULL AND asset_id IN (SELECT id FROM asset WHERE deleted_at IS NULL)",
    ),
    "queue_state": ("classification_queue.state", ("classification_queue",), "SELECT state AS k FROM classification_queue"),
    "observation_type": ("observation.type", ("visual_observation",), "SELECT observation_type AS k FROM visual_observation JOIN asset ON asset.id = asset_id AND deleted_at IS NULL"),
}


def _add_grouped(name: str, prefix: str, tables: tuple[str, ...], rows: str) -> None:
    sql = with_tables(*tables) + f"SELECT '{prefix}.' || regexp_replace(lower(trim(k)), '[^a-z0-9]', '_', 'g') AS id, k AS key, count(*) AS value FROM ({rows}) GROUP BY k"
    query(f"status_{name}", sql)(lambda v: status.grouped_counts(Tables(v))[prefix])


for _name, _spec in _GROUPED.items():
    _add_grouped(_name, *_spec)

_ALL = ("asset", "asset_resource", "album_membership", "location_observation", "classification_queue", "evidence_ref", "visual_observation")


@query("status_table_counts", with_tables(*_ALL) + " UNION ALL ".join(f"SELECT '{t}' AS id, count(*) AS value FROM {t}" for t in _ALL))
def status_table_counts(v: Views) -> DataFrame:
    t = Tables(v)
    return status.table_counts({n: t[n] for n in _ALL})


@query(
    "status_scalars",
    with_tables("asset", "asset_resource", "location_observation", "visual_observation")
    + """, live AS (SELECT id FROM asset WHERE deleted_at IS NULL)
SELECT 'asset.deleted' AS id, count(*) AS value FROM asset WHERE deleted_at IS NOT NULL
UNION ALL SELECT 'asset.active', count(*) FROM live
UNION ALL SELECT 'resource.deleted', count(*) FROM asset_resource WHERE deleted_at IS NOT NULL
UNION ALL SELECT 'asset.with_location', count(DISTINCT asset_id) FROM location_observation WHERE asset_id IN (SELECT id FROM live)
UNION ALL SELECT 'asset.without_location', count(*) FROM live WHERE id NOT IN (SELECT asset_id FROM location_observation)
UNION ALL SELECT 'asset.with_observation', count(DISTINCT asset_id) FROM visual_observation WHERE asset_id IN (SELECT id FROM live)
UNION ALL SELECT 'asset.without_observation', count(*) FROM live WHERE id NOT IN (SELECT asset_id FROM visual_observation)
UNION ALL SELECT 'asset.with_local_resource', count(DISTINCT asset_id) FROM asset_resource WHERE deleted_at IS NULL AND available_locally AND asset_id IN (SELECT id FROM live)
UNION ALL SELECT 'asset.needing_download', count(DISTINCT asset_id) FROM asset_resource WHERE deleted_at IS NULL AND needs_download AND asset_id IN (SELECT id FROM live)""",
)
def status_scalars(v: Views) -> DataFrame:
    return status.scalar_counts(Tables(v))


# Classification


@query("classify_rules", with_tables("visual_observation") + "SELECT DISTINCT id, asset_id, observation_type, label, confidence, evidence_id FROM visual_observation")
def classify_rules(v: Views) -> DataFrame:
    return v.visual_observation().select("id", "asset_id", "observation_type", "label", "confidence", "evidence_id")


@query(
    "classify_queue_order",
    with_tables("asset", "classification_queue")
    + "SELECT q.id, q.asset_id, q.state FROM classification_queue q JOIN asset a ON a.id = q.asset_id AND a.deleted_at IS NULL WHERE state IN ('pending', 'metadata_classified', 'content_failed') ORDER BY state <> 'pending', creation_date DESC, q.id LIMIT 250",
)
def classify_queue_order(v: Views) -> DataFrame:
    return C.queue(v.classification_queue(), v.asset(), with_model=True, limit=250).select("id", "asset_id", "state")


@query(
    "queue_states",
    with_tables("asset")
    + """, r AS (SELECT asset_id, event_id % 3 = 0 AS has_local, event_id % 3 <> 0 AND event_id % 2 = 0 AS needs_download
  FROM ev WHERE event_id % 89 <> 0 AND event_id % (SELECT count(*) FROM documents) IN (SELECT doc_id FROM documents))
SELECT a.id AS asset_id, CASE WHEN media_type <> 'image' OR NOT coalesce(needs_download, false) THEN 'content_unavailable' ELSE 'metadata_classified' END AS state,
  CASE WHEN media_type <> 'image' OR NOT coalesce(needs_download, false) THEN 'local_model_no_image_content' WHEN has_local THEN 'local_metadata_observations' ELSE 'local_metadata_observations_waiting_for_content' END AS reason
FROM asset a LEFT JOIN r ON r.asset_id = a.id WHERE a.deleted_at IS NULL""",
)
def queue_states(v: Views) -> DataFrame:
    return C.next_states(C.inputs(v.asset(), v.asset_resource(), v.album_membership()), with_model=True)


_EVIDENCE = sid("evidence", "asset_id", "'classification_input'", "'archive_metadata'", "'asset-resource-album.v1'")


@query(
    "rule_evidence",
    with_tables("inputs")
    + f"""SELECT {_EVIDENCE} AS id, asset_id, 'classification_input' AS evidence_kind, asset_id || '/classification/archive_metadata' AS pointer, media_type, CAST(width AS VARCHAR) AS width,
  CAST(CAST(resource_type IS NOT NULL AS INTEGER) AS VARCHAR) AS resource_count, '1' AS album_count, CAST(has_local AS VARCHAR) AS has_local_content FROM inputs""",
)
def rule_evidence(v: Views) -> DataFrame:
    e = C.rule_evidence(C.inputs(v.asset(), v.asset_resource(), v.album_membership()), "2024-01-01T00:00:00Z")
    return e.select("id", "asset_id", "evidence_kind", "pointer", *[F.get_json_object("value_json", f"$.{k}").alias(k) for k in ("media_type", "width", "resource_count", "album_count", "has_local_content")])


@query(
    "keyword_flags",
    """SELECT page_id, contains(k, 'screenshot') OR contains(k, 'screen shot') AS screenshot, regexp_matches(k, 'receipt|invoice|bill|statement') AS receipt, regexp_matches(k, 'document|passport|ticket|boarding pass|menu') AS document
FROM (SELECT page_id, lower(html) AS k FROM pages)""",
)
def keyword_flags(v: Views) -> DataFrame:
    k = F.lower("html")
    words = {label.split("_")[0]: w for label, _, w in C.SIGNALS}
    return v.raw("pages").select("page_id", *[T.contains_any(k, w).alias(n) for n, w in words.items()])


# Model payloads

_PAYLOAD = """SELECT conv_id, turn, 'Sure: {"scene_summary": ' || to_json(text) || ', "cluster_terms": [' || to_json(role) || ', "keys: a", ' || to_json(role) || '], "people_presence": null} done' AS response,
  text AS scene, role FROM conversations"""


#: The longest part of t within 500 bytes that splits no character.
CUT_SQL = "trim(CASE WHEN strlen({t}) <= 500 THEN {t} ELSE substr({t}, 1, list_max(list_filter(range(125, 501), lambda n: strlen(substr({t}, 1, n)) <= 500))) END)"


def _payload(v: Views) -> DataFrame:
    js = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    c = v.raw("conversations")
    text = F.concat(F.lit('Sure: {"scene_summary": '), js(F.col("text")), F.lit(', "cluster_terms": ['), js(F.col("role")), F.lit(', "keys: a", '), js(F.col("role")), F.lit('], "people_presence": null} done'))
    return c.select("conv_id", "turn", text.alias("response"))


_ANSWERS = f"SELECT conv_id || '/' || turn AS asset_id, response, CASE WHEN turn % 3 = 2 THEN 'refused' END AS error, 'http://' || role AS endpoint, turn + 1 AS requests FROM ({_PAYLOAD})"


def _answers(v: Views) -> DataFrame:
    """Answers of a model, one for each turn; every third call fails."""
    made = _payload(v).join(v.raw("conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return made.select(
        F.concat_ws("/", "conv_id", "turn").alias("asset_id"), "response", F.when(F.col("turn") % 3 == 2, "refused").alias("error"), F.concat(F.lit("http://"), "role").alias("endpoint"),
        F.lit(7).cast("bigint").alias("image_bytes"), F.lit("x").alias("image_sha256"), (F.col("turn") + 1).cast("bigint").alias("requests"), F.lit(1).cast("bigint").alias("responses"), F.lit("/a/derivatives/b.JPG").alias("path"),
    )


@query(
    "model_evidence",
    f"""SELECT {sid("evidence", "asset_id", "'content_classification'", "'local_model'", "'m'", "'v1'")} AS id, asset_id, asset_id || '/classification/local_multimodal' AS pointer, endpoint, '.jpg' AS image_extension, 'derivative' AS image_path_class,
  '7' AS transmitted_image_bytes, md5(response) AS raw, md5(regexp_extract(response, '(?s)\\{{.*\\}}')) AS parsed FROM ({_ANSWERS}) WHERE error IS NULL""",
)
def model_evidence(v: Views) -> DataFrame:
    e = C.model_evidence(_answers(v).where("error IS NULL"), "m", "v1", "2024-01-01T00:00:00Z")
    of = lambda k: F.get_json_object("value_json", f"$.{k}")
    fields = [of(k).alias(k) for k in ("endpoint", "image_extension", "image_path_class", "transmitted_image_bytes")]
    return e.select("id", "asset_id", "pointer", *fields, F.md5(of("raw_response")).alias("raw"), F.md5(of("parsed_response")).alias("parsed"))


@query(
    "model_run",
    f"""SELECT 'm' AS model_id, CAST(9 AS BIGINT) AS input_count, CAST(count(*) FILTER (error IS NULL) AS VARCHAR) AS content_classified, CAST(count(error) AS VARCHAR) AS failures,
  CAST(sum(requests) AS VARCHAR) AS http_request_attempts, CAST(count(*) AS VARCHAR) AS http_responses_received, '["' || array_to_string(list_sort(list(DISTINCT endpoint)), '","') || '"]' AS response_endpoints FROM ({_ANSWERS})""",
)
def model_run(v: Views) -> DataFrame:
    r = C.model_run(_answers(v), 9, "m", "v1", "2024-01-01T00:00:00Z")
    return r.select("model_id", "input_count", *[F.get_json_object("metadata_json", f"$.{k}").alias(k) for k in ("content_classified", "failures", "http_request_attempts", "http_responses_received", "response_endpoints")])


@query(
    "model_payload",
    f"""WITH p AS ({_PAYLOAD})
SELECT DISTINCT * FROM (SELECT conv_id, turn, 'scene_summary' AS observation_type, {CUT_SQL.format(t="trim(regexp_replace(scene, '[[:space:]]+', ' ', 'g'))")} AS value_text, 0.65::DOUBLE AS confidence, 'scene' AS term_type FROM p
UNION ALL SELECT conv_id, turn, 'cluster_feature', x, 0.55, 'cluster_feature' FROM (SELECT conv_id, turn, unnest([role, 'keys: a']) AS x FROM p)
UNION ALL SELECT conv_id, turn, 'quality_issue', 'model_prompt_leakage', 1.0, 'quality_issue' FROM p) WHERE value_text <> ''""",
)
def model_payload(v: Views) -> DataFrame:
    return C.observations(_payload(v), "response")


@query(
    "terms",
    """WITH w AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
x AS (SELECT conv_id, turn, unnest(list_concat(string_split(t, ' '), [t])) AS p FROM w),
n AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS term FROM x)
SELECT DISTINCT conv_id, turn, term FROM n WHERE length(term) BETWEEN 2 AND 80""",
)
def terms(v: Views) -> DataFrame:
    return v.raw("conversations").select("conv_id", "turn", F.explode(T.terms(F.col("text"))).alias("term"))


@query("prompt_leak", "SELECT conv_id, turn, regexp_matches(lower(text), 'return only valid compact|do not use markdown fences|use candidates, not truth|keys:') AS leaked FROM conversations")
def prompt_leak(v: Views) -> DataFrame:
    return v.raw("conversations").select("conv_id", "turn", T.contains_any(F.lower("text"), C.LEAKS).alias("leaked"))


@query("value_texts")
def value_texts(v: Views) -> DataFrame:
    p = _payload(v).select("conv_id", "turn", C.payload_json(F.col("response")).alias("j"))
    return p.select("conv_id", "turn", F.explode(C.value_texts(F.get_json_object("j", "$.cluster_terms"))).alias("text"))


# Neighbors

_LIVE = "SELECT * FROM asset WHERE deleted_at IS NULL"
_META = lambda a: sid("evidence", f"{a}.id", "'asset_metadata'", f"'asset:' || {a}.local_identifier")
_KINDS = {
    "burst": (
        ("asset",),
        f"SELECT s.id AS source_id, t.id AS target_id, t.creation_date, 1 AS ord, 'same_burst' AS type, 'asset.burst_identifier' AS method, 0.95::DOUBLE AS weight, '{{\"burst_identifier_present\":true}}' AS detail, [{_META('s')}, {_META('t')}] AS evidence, 0.0::DOUBLE AS k1 FROM ({_LIVE}) s JOIN ({_LIVE}) t ON s.burst_identifier = t.burst_identifier AND s.id <> t.id WHERE s.burst_identifier <> ''",
    ),
    "album": (
        ("asset", "album_membership"),
        f"""SELECT s.asset_id AS source_id, t.asset_id AS target_id, a.creation_date, 2 AS ord, 'same_album' AS type, 'album_membership.album_id' AS method, 0.8::DOUBLE AS weight, '{{"album_id":"' || s.album_id || '","album_title":"' || s.album_title || '"}}' AS detail,
 [{sid("evidence", "s.asset_id", "'album_membership'", "'album:' || s.album_id")}, {sid("evidence", "t.asset_id", "'album_membership'", "'album:' || s.album_id")}] AS evidence, 0.0::DOUBLE AS k1
 FROM album_membership s JOIN album_membership t ON s.album_id = t.album_id AND s.asset_id <> t.asset_id JOIN asset a ON a.id = t.asset_id AND a.deleted_at IS NULL""",
    ),
    "hash": (
        ("asset", "asset_resource"),
        """SELECT DISTINCT s.asset_id AS source_id, t.asset_id AS target_id, a.creation_date, 3 AS ord, 'same_resource_hash' AS type, 'asset_resource.sha256' AS method, 1.0::DOUBLE AS weight, '{"hash_present":true}' AS detail, CAST([] AS VARCHAR[]) AS evidence, 0.0::DOUBLE AS k1
 FROM asset_resource s JOIN asset_resource t ON s.sha256 = t.sha256 AND s.asset_id <> t.asset_id AND s.deleted_at IS NULL AND t.deleted_at IS NULL JOIN asset a ON a.id = t.asset_id AND a.deleted_at IS NULL""",
    ),
    "time": (
        ("asset",),
        f"""SELECT source_id, target_id, creation_date, 4 AS ord, 'nearby_time' AS type, 'asset.creation_date' AS method, CASE WHEN sec <= 60 THEN 0.75 WHEN sec <= 600 THEN 0.65 ELSE 0.45 END::DOUBLE AS weight, CAST(round(sec, 3) AS VARCHAR) AS detail, evidence, sec AS k1
 FROM (SELECT s.id AS source_id, t.id AS target_id, t.creation_date, abs((s.jd - t.jd) * 86400.0::DOUBLE) AS sec, [{_META('s')}, {_META('t')}] AS evidence
  FROM (SELECT *, {JD.format("creation_date")} AS jd FROM ({_LIVE})) s JOIN (SELECT *, {JD.format("creation_date")} AS jd FROM ({_LIVE})) t ON t.jd BETWEEN s.jd - 0.05 AND s.jd + 0.05 AND s.id <> t.id) WHERE sec <= 3600""",
    ),
    "location": (
        ("asset", "location_observation"),
        f"""SELECT source_id, target_id, creation_date, 5 AS ord, 'nearby_location' AS type, 'location_observation.raw_gps_window' AS method, CASE WHEN (x + y) * 111000.0::DOUBLE <= 100 THEN 0.75 WHEN (x + y) * 111000.0::DOUBLE <= 500 THEN 0.65 ELSE 0.5 END::DOUBLE AS weight, CAST(round(x, 9) AS VARCHAR) || ' ' || CAST(round(y, 9) AS VARCHAR) AS detail, evidence, x + y AS k1
 FROM (SELECT s.asset_id AS source_id, t.asset_id AS target_id, a.creation_date, abs(s.latitude - t.latitude) AS x, abs(s.longitude - t.longitude) AS y, [s.evidence_id, t.evidence_id] AS evidence
  FROM location_observation s JOIN location_observation t ON abs(s.latitude - t.latitude) <= 0.01::DOUBLE AND abs(s.longitude - t.longitude) <= 0.01::DOUBLE AND s.asset_id <> t.asset_id JOIN ({_LIVE}) a ON a.id = t.asset_id)""",
    ),
    "observation": (
        ("asset", "visual_observation"),
        f"""SELECT s.asset_id AS source_id, t.asset_id AS target_id, a.creation_date, 6 AS ord, 'shared_observation' AS type, 'visual_observation.type_label' AS method, least(0.75::DOUBLE, 0.75::DOUBLE * least(s.confidence, t.confidence)) AS weight, '{{"observation_type":"' || s.observation_type || '","label":"' || s.label || '"}}' AS detail, [s.evidence_id, t.evidence_id] AS evidence, -least(s.confidence, t.confidence) AS k1
 FROM (SELECT DISTINCT * FROM visual_observation) s JOIN (SELECT DISTINCT * FROM visual_observation) t ON s.observation_type = t.observation_type AND s.label = t.label AND s.asset_id <> t.asset_id AND s.observation_type = 'document_signal' JOIN ({_LIVE}) a ON a.id = t.asset_id""",
    ),
}
_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k1, creation_date, target_id, detail) AS pos FROM ({rows}) WHERE source_id IN (SELECT id FROM asset WHERE deleted_at IS NULL)) WHERE pos <= {most}"
PER_KIND, BEST = N.LIMIT, N.LIMIT


def _add_kind(name: str, tables: tuple[str, ...], rows: str) -> None:
    numbers = "round(k1, 6) AS measure"
    sql = with_tables(*tables) + f"SELECT source_id, target_id, weight, {numbers}, pos AS position, array_to_string(list_sort(list_distinct(evidence)), ',') AS evidence_ids FROM ({_TOP.format(rows=rows, most=4 * PER_KIND)})"
    type_ = {"burst": "same_burst", "album": "same_album", "hash": "same_resource_hash", "time": "nearby_time", "location": "nearby_location", "observation": "shared_observation"}[name]

    def run(v: Views) -> DataFrame:
        c = N.candidates(Tables(v), PER_KIND, kinds=(type_,))
        return c.select("source_id", "target_id", "weight", F.round("k1", 6).alias("measure"), F.col("pos").cast("bigint").alias("position"), F.array_join(F.sort_array(F.array_distinct("evidence_ids")), ",").alias("evidence_ids"))

    query(f"neighbors_{name}", sql)(run)


for _name, _spec in _KINDS.items():
    _add_kind(_name, *_spec)

_CANDIDATES = ", ".join(f"c_{n} AS ({_TOP.format(rows=rows, most=4 * BEST)})" for n, (_, rows) in _KINDS.items())
_SCORED = (
    with_tables("asset", "asset_resource", "album_membership", "location_observation", "visual_observation")
    + f""", {_CANDIDATES},
u AS ({" UNION ALL ".join(f"SELECT * FROM c_{n}" for n in _KINDS)}),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type, method, detail ORDER BY ord, pos) AS n FROM u) WHERE n = 1),
g AS (SELECT source_id, target_id, min(creation_date) AS creation_date, round(least(1.0::DOUBLE, sum(weight ORDER BY ord, pos)), 9) AS score, count(*) AS n_reasons, string_agg(type, ',' ORDER BY weight DESC, type) AS reasons,
  array_to_string(list_sort(list_distinct(flatten(list(evidence)))), ',') AS evidence_ids FROM k GROUP BY source_id, target_id)
SELECT source_id, target_id, score, n_reasons, reasons, evidence_ids, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, n_reasons DESC, creation_date, target_id) AS rank FROM g) WHERE rank <= {BEST}"""
)


def _scored(v: Views, source: str | None = None) -> DataFrame:
    n = N.neighbors(Tables(v), BEST, source)
    return n.select("source_id", "target_id", "score", "n_reasons", F.array_join(F.transform("reasons", lambda r: r["type"]), ",").alias("reasons"), F.array_join("evidence_ids", ",").alias("evidence_ids"), "rank")


@query("neighbors_scored", _SCORED)
def neighbors_scored(v: Views) -> DataFrame:
    return _scored(v)


@query("neighbors_one", _SCORED + f" AND source_id = (SELECT {sid('asset', chr(39) + 'src' + chr(39), '1')})")
def neighbors_one(v: Views) -> DataFrame:
    one = v.spark.range(1).select(stable_id("asset", "src", "1").alias("s")).first().s
    return _scored(v, one)


# Search (D1 to D11)

_TOK = "list_filter(string_split(regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _phrase_sql(tokens: str, phrase: list[str]) -> str:
    want = "[" + ", ".join(f"'{w}'" for w in phrase) + "]"
    n = len(phrase)
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda i: list_slice({tokens}, i, i + {n - 1}) = {want}))"


def bm25_sql(docs: str, text: str, columns: tuple[str, ...], keep: str) -> str:
    """SELECT keep, rank over a table expression `docs`."""
    wanted = search.phrases(text)
    toks = ", ".join(f"{_TOK.format(c)} AS t_{c}" for c in columns)
    fs = ", ".join(" + ".join(_phrase_sql(f"t_{c}", p) for c in columns) + f" AS f{i}" for i, p in enumerate(wanted))
    dl = " + ".join(f"len(t_{c})" for c in columns)
    idf = lambda i: f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6)"
    score = " ".join(f"- {idf(i)} * (f{i} * 2.2) / (f{i} + 1.2 * (1 - 0.75 + 0.75 * dl / av))" for i in range(len(wanted)))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(wanted)))
    return f"""SELECT {keep}, 0.0 {score} AS rank FROM
 (SELECT *, {dl} AS dl, {fs} FROM (SELECT *, {toks} FROM {docs})) x,
 (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS av, {stats} FROM (SELECT {dl} AS dl, {fs} FROM (SELECT {toks} FROM {docs}))) s
 WHERE {" AND ".join(f"f{i} > 0" for i in range(len(wanted)))}"""


TERMS = "the and"


@query("bm25_documents", f"SELECT doc_id, round(rank, 9) AS rank FROM ({bm25_sql('documents', TERMS, ('text',), 'doc_id')})")
def bm25_documents(v: Views) -> DataFrame:
    return search.bm25(v.raw("documents"), TERMS, ("text",), "doc_id", ("doc_id",)).select("doc_id", F.round("rank", 9).alias("rank"))


@query("search_indexed", f"SELECT doc_id AS id, round(rank, 9) AS rank FROM ({bm25_sql('documents', TERMS, ('text',), 'doc_id')})")
def search_indexed(v: Views) -> DataFrame:
    """bm25_documents from an index that is written first."""
    path = scratch(v.spark, "index")
    search.write_index(v.raw("documents"), ("text",), path, "doc_id")
    return search.indexed_bm25(v.spark, path, TERMS).select("id", F.round("rank", 9).alias("rank"))


@query("search_top", f"SELECT CAST(doc_id AS VARCHAR) AS id, round(bm.rank, 9) AS rank FROM ({bm25_sql('documents', TERMS, ('text',), 'doc_id')}) bm ORDER BY bm.rank, CAST(doc_id AS VARCHAR) LIMIT 20")
def search_top(v: Views) -> DataFrame:
    """The first 20 of bm25_documents from a kept index, in which the French documents were others before."""
    from ..operators.index import Index
    from ..store import Store

    store = Store(v.spark, scratch(v.spark, "archive"))
    store.init()
    docs = v.raw("documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("title"), F.col("text").alias("body"), "lang")
    french = docs.where("lang = 'fr'")
    earlier = docs.withColumn("body", F.when(F.col("lang") == "fr", F.concat(F.lit("the "), "body")).otherwise(F.col("body")))
    for ids, now in ((None, earlier), (french, french)):
        t = store.tables()
        Index(t, "asset_documents").update(ids, now.drop("lang"))
        store.commit({}, t)
    return Index(store.tables(), "asset_documents").best(TERMS, 20).select("id", F.round("rank", 9).alias("rank"))


@query("phrase_match", f"SELECT doc_id, CAST({_phrase_sql('t', ['of', 'the'])} AS BIGINT) AS hits FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)")
def phrase_match(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", search.phrase_hits(T.search_tokens(F.col("text")), ["of", "the"]).cast("bigint").alias("hits"))


@query("search_postings", f"SELECT term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT page_id, term, count(*) AS n FROM (SELECT page_id, unnest({_TOK.format('html')}) AS term FROM pages) GROUP BY page_id, term) GROUP BY term")
def search_postings(v: Views) -> DataFrame:
    p = search.postings(v.raw("pages"), ("html",), "page_id")
    return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).cast("bigint").alias("occurrences"))


_DOCS = """, docs AS (SELECT a.id, media_type || ' ' || creation_date AS title, concat_ws(' ', media_type, nullif(media_subtypes, ''), creation_date, nullif(burst_identifier, ''), width || 'x' || height, resource_type, uti, original_filename, album_title, album_kind) AS body
 FROM (SELECT * FROM asset WHERE deleted_at IS NULL) a LEFT JOIN (SELECT * FROM asset_resource WHERE deleted_at IS NULL) r ON r.asset_id = a.id LEFT JOIN album_membership m ON m.asset_id = a.id),
obs AS (SELECT id, asset_id, label AS title, observation_type || ' ' || label || ' archive_metadata' AS body FROM (SELECT DISTINCT * FROM visual_observation))
"""


@query("search_asset_documents", with_tables("asset", "asset_resource", "album_membership", "visual_observation") + _DOCS + "SELECT id, title, body FROM docs")
def search_asset_documents(v: Views) -> DataFrame:
    return search.asset_documents(v.asset(), v.asset_resource(), v.album_membership())


def _add_search(name: str, text: str) -> None:
    first = f"SELECT 0 AS pass, rank, id AS asset_id, CAST(NULL AS VARCHAR) AS observation_id FROM ({bm25_sql('docs', text, ('title', 'body'), 'id')})"
    second = f"SELECT 1, rank, asset_id, o.id FROM ({bm25_sql('obs', text, ('title', 'body'), 'id, asset_id')}) o JOIN asset a ON a.id = o.asset_id AND a.deleted_at IS NULL"
    sql = with_tables("asset", "asset_resource", "album_membership", "visual_observation") + _DOCS + f"SELECT pass, round(rank, 9) AS rank, asset_id, observation_id FROM ({first} UNION ALL {second}) ORDER BY pass, rank, asset_id, observation_id NULLS FIRST LIMIT 50"
    query(name, sql)(lambda v: search.search(Tables(v), text, 50).select("pass", F.round("rank", 9).alias("rank"), "asset_id", "observation_id"))


_add_search("search_assets", "menu trip")
_add_search("search_observations", "screenshot_candidate")
_add_search("search_two_pass", "receipt")


@query("search_snippets")
def search_snippets(v: Views) -> DataFrame:
    return search.search(Tables(v), "menu", 50).select("asset_id", "hit_type", "title", "snippet")
