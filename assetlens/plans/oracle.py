"""SQL of the archive tables for DuckDB: the same projections as sources.views, written independently."""

from __future__ import annotations

SID = "'{kind}:' || substr(sha256({parts}), 1, 32)"


def sid(kind: str, *parts: str) -> str:
    return SID.format(kind=kind, parts=" || ".join(f"CAST({p} AS VARCHAR) || chr(0)" for p in parts))


ASSET_ID = sid("asset", "'src'", "event_id")
LOCAL = "'evt-' || event_id"


def with_tables(*names: str) -> str:
    """A WITH clause that defines the named archive tables, and what they need, in order."""
    need: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in need) + "\n"


NEEDS = {
    **{n: ("ev",) for n in ("asset", "album_membership", "location_observation", "classification_queue", "prev", "next")},
    "asset_resource": ("ev",),
    "evidence_ref": ("asset", "asset_resource", "album_membership", "location_observation"),
    "inputs": ("asset", "asset_resource", "album_membership"),
    "visual_observation": ("inputs",),
    "tok": (),
}

#: Julian day of ISO text, from whole milliseconds.
JD = "((CAST(floor(epoch_us(CAST({} AS TIMESTAMP)) / 1000.0) AS BIGINT) + 210866760000000) / 86400000.0::DOUBLE)"

TABLES = {
    "ev": f"SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, {ASSET_ID} AS asset_id FROM events",
    "asset": f"""
SELECT asset_id AS id, {LOCAL} AS local_identifier,
  CASE event_type WHEN 'purchase' THEN 'video' WHEN 'error' THEN 'kind:2' ELSE 'image' END AS media_type,
  CASE WHEN event_id % 13 = 0 THEN 'screenshot' WHEN event_id % 17 = 0 THEN 'receipt' ELSE '' END AS media_subtypes,
  iso AS creation_date, '' AS modification_date, event_id % 7 * 100 AS width, event_id % 5 * 100 AS height, event_id % 10 = 0 AS favorite,
  CASE WHEN event_id % 20 < 3 THEN 'burst-' || (event_id // 20) ELSE '' END AS burst_identifier,
  '{{"source_type":' || json_extract_string(props, '$.k') || '}}' AS metadata_json, CASE WHEN event_id % 97 = 0 THEN iso END AS deleted_at
FROM ev""",
    "asset_resource": f"""
SELECT {sid("asset_resource", "asset_id", "'res-' || event_id")} AS id, asset_id, 'res-' || event_id AS source_identifier,
  CASE event_id % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'photo' WHEN 2 THEN 'video' ELSE 'full_size_video' END AS resource_type,
  CASE WHEN event_id % 4 < 2 THEN 'public.heic' ELSE 'public.mpeg-4' END AS uti,
  CASE WHEN event_id % 11 = 0 THEN 'nested/Menu ' || event_id || '.heic' ELSE 'IMG_' || event_id || '.heic' END AS original_filename,
  CASE WHEN event_id % 3 = 0 THEN '/library/originals/' || event_id ELSE '' END AS local_path, sha256(text) AS sha256,
  event_id % 3 = 0 AS available_locally, event_id % 3 <> 0 AND event_id % 2 = 0 AS needs_download,
  CASE WHEN event_id % 89 = 0 THEN iso END AS deleted_at
FROM ev JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)""",
    "album_membership": f"""
SELECT {sid("album_membership", "asset_id", "'album-' || user_id % 30")} AS id, asset_id, 'album-' || user_id % 30 AS album_id, 'Trip ' || user_id % 30 AS album_title, 'user' AS album_kind FROM ev""",
    "location_observation": f"""
SELECT {sid("location_observation", "asset_id", LOCAL)} AS id, asset_id, 50.0::DOUBLE + (user_id % 50) * 0.002::DOUBLE AS latitude, 4.0::DOUBLE + (event_id % 40) * 0.002::DOUBLE AS longitude,
  CASE WHEN event_id % 11 <> 0 THEN CAST(value AS DOUBLE) END AS horizontal_accuracy, {sid("evidence", "asset_id", "'location'", LOCAL)} AS evidence_id
FROM ev""",
    "classification_queue": f"""
SELECT {sid("classification_queue", "asset_id")} AS id, asset_id,
  CASE WHEN event_id % 97 = 0 THEN 'deleted' WHEN event_id % 4 = 0 THEN 'metadata_classified' WHEN event_id % 23 = 0 THEN 'content_failed' ELSE 'pending' END AS state
FROM ev""",
    "evidence_ref": f"""
SELECT {sid("evidence", "id", "'asset_metadata'", "'asset:' || local_identifier")} AS id, id AS asset_id, 'asset_metadata' AS evidence_kind, 'asset:' || local_identifier AS pointer FROM asset
UNION ALL SELECT {sid("evidence", "r.asset_id", "'asset_resource'", "'asset:' || local_identifier || '/resource:' || r.id")}, r.asset_id, 'asset_resource', 'asset:' || local_identifier || '/resource:' || r.id FROM asset_resource r JOIN asset a ON a.id = r.asset_id
UNION ALL SELECT {sid("evidence", "asset_id", "'album_membership'", "'album:' || album_id")}, asset_id, 'album_membership', 'album:' || album_id FROM album_membership
UNION ALL SELECT evidence_id, asset_id, 'location', 'asset:' || local_identifier || '/location' FROM location_observation l JOIN asset a ON a.id = l.asset_id""",
    "inputs": """
SELECT a.id AS asset_id, media_type, width, height, burst_identifier, r.resource_type, r.uti, r.original_filename, coalesce(r.available_locally OR r.local_path <> '', false) AS has_local,
  lower(concat_ws(' ', media_type, media_subtypes, metadata_json, r.resource_type, r.uti, r.original_filename, m.album_title, m.album_kind)) AS keywords
FROM asset a LEFT JOIN (SELECT * FROM asset_resource WHERE deleted_at IS NULL) r ON r.asset_id = a.id LEFT JOIN album_membership m ON m.asset_id = a.id
WHERE a.deleted_at IS NULL""",
    "visual_observation": f"""
SELECT {sid("visual_observation", "asset_id", "'archive_metadata'", "observation_type", "label")} AS id, asset_id, observation_type, label, CAST(confidence AS DOUBLE) AS confidence,
  {sid("evidence", "asset_id", "'classification_input'", "'archive_metadata'", "'asset-resource-album.v1'")} AS evidence_id
FROM (SELECT asset_id, 'media_type' AS observation_type, media_type AS label, 1 AS confidence FROM inputs
  UNION ALL SELECT asset_id, 'content_availability', CASE WHEN has_local THEN 'local_content_available' ELSE 'local_content_unavailable' END, 1 FROM inputs
  UNION ALL SELECT asset_id, 'geometry', CASE WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END, 1 FROM inputs WHERE width > 0 AND height > 0
  UNION ALL SELECT asset_id, 'capture_mode', 'burst_member', 1 FROM inputs WHERE burst_identifier <> ''
  UNION ALL SELECT asset_id, 'resource_type', resource_type, 1 FROM inputs WHERE resource_type IS NOT NULL
  UNION ALL SELECT asset_id, 'resource_uti', uti, 1 FROM inputs WHERE uti IS NOT NULL
  UNION ALL SELECT asset_id, 'document_signal', 'screenshot_candidate', 0.75 FROM inputs WHERE contains(keywords, 'screenshot') OR contains(keywords, 'screen shot')
  UNION ALL SELECT asset_id, 'document_signal', 'receipt_candidate', 0.65 FROM inputs WHERE regexp_matches(keywords, 'receipt|invoice|bill|statement')
  UNION ALL SELECT asset_id, 'document_signal', 'document_candidate', 0.6 FROM inputs WHERE regexp_matches(keywords, 'document|passport|ticket|boarding pass|menu'))""",
    "prev": "SELECT asset_id, event_type AS media_type, iso AS creation_date, '' AS modification_date, event_id % 10 = 0 AS favorite, CAST(NULL AS VARCHAR) AS deleted_at FROM ev WHERE event_id % 10 <> 0",
    "next": "SELECT asset_id, event_type AS media_type, iso AS creation_date, CASE WHEN event_id % 5 = 0 THEN '2024-06-01T00:00:00Z' ELSE '' END AS modification_date, event_id % 10 = 0 AS favorite, CASE WHEN event_id % 97 = 0 THEN '2024-06-02T00:00:00Z' END AS deleted_at FROM ev WHERE event_id % 7 <> 0",
}
