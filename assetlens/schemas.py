"""Explicit schemas of the archive tables and of nested snapshots."""

from __future__ import annotations

SCHEMA_VERSION = 2

TOMBSTONE = "deleted_at string, deletion_source string, deletion_reason string"
ASSET_CONTENT = (
    "local_identifier string, media_type string, media_subtypes string, creation_date string, modification_date string, added_date string, "
    "timezone_name string, width bigint, height bigint, duration_seconds double, favorite boolean, hidden boolean, burst_identifier string, "
    "represents_burst boolean, source_library_id string, metadata_json string"
)
RESOURCE_CONTENT = (
    "asset_id string, source_identifier string, resource_type string, uti string, original_filename string, local_path string, availability string, "
    "file_size bigint, sha256 string, available_locally boolean, needs_download boolean, metadata_json string"
)

TABLES: dict[str, str] = {
    "source_library": "id string, library_path string, snapshot_path string, snapshot_created_at string, photos_version string, metadata_json string",
    "crawl_snapshot": "id string, source_library_id string, started_at string, completed_at string, provider string, asset_count bigint, resource_count bigint, album_count bigint, location_count bigint",
    "crawl_seen_asset": "source_library_id string, asset_id string, first_seen_snapshot_id string, last_seen_snapshot_id string, source_fingerprint string, last_seen_at string",
    "sync_state": "source string, entity_type string, entity_id string, cursor string, synced_at string",
    "classification_queue": "id string, asset_id string, state string, reason string, needs_download boolean, updated_at string",
    "asset": f"id string, {ASSET_CONTENT}, {TOMBSTONE}",
    "asset_resource": f"id string, {RESOURCE_CONTENT}, {TOMBSTONE}",
    "album_membership": "id string, asset_id string, album_id string, album_title string, album_kind string",
    "location_observation": "id string, asset_id string, latitude double, longitude double, altitude double, horizontal_accuracy double, source string, evidence_id string",
    "visual_observation": "id string, asset_id string, observation_type string, label string, confidence double, bounding_box_json string, source string, model_id string, evidence_id string",
    "text_observation": "id string, asset_id string, text string, confidence double, bounding_box_json string, language string, source string, evidence_id string",
    "face_observation": "id string, asset_id string, face_local_id string, person_label string, confidence double, bounding_box_json string, source string, evidence_id string",
    "model_run": "id string, model_id string, source string, prompt_version string, started_at string, completed_at string, input_count bigint, metadata_json string",
    "model_observation": "id string, asset_id string, observation_type string, value_text string, value_json string, confidence double, source string, model_id string, prompt_version string, evidence_id string",
    "observation_term": "id string, asset_id string, observation_id string, term string, term_type string, source string, model_id string",
    "evidence_ref": "id string, asset_id string, evidence_kind string, source string, pointer string, value_json string",
    "edge": "id string, edge_type string, from_id string, to_id string, method string, confidence double, reason_json string, evidence_id string",
}

KEYS: dict[str, tuple[str, ...]] = {
    "crawl_seen_asset": ("source_library_id", "asset_id"),
    "sync_state": ("source", "entity_type", "entity_id"),
    "classification_queue": ("asset_id",),
}

#: Tables that are stored in buckets of the asset's id, and the column that has it.
BUCKETED: dict[str, str] = {
    "asset": "id",
    **dict.fromkeys(("crawl_seen_asset", "classification_queue", "asset_resource", "album_membership", "location_observation", "visual_observation", "text_observation", "face_observation", "model_observation", "observation_term", "evidence_ref"), "asset_id"),
}

SNAPSHOT_ASSET = (
    "struct<local_identifier: string, media_type: string, media_subtypes: string, creation_date: string, modification_date: string, added_date: string, "
    "timezone_name: string, width: bigint, height: bigint, duration_seconds: double, favorite: boolean, hidden: boolean, burst_identifier: string, "
    "represents_burst: boolean, deleted_at: string, deletion_source: string, deletion_reason: string, "
    "location: struct<latitude: double, longitude: double, altitude: double, horizontal_accuracy: double>, "
    "resources: array<struct<source_identifier: string, type: string, uti: string, original_filename: string, local_path: string, availability: string, "
    "file_size: bigint, stable_hash: string, available_locally: boolean, needs_download: boolean, metadata: string>>, "
    "albums: array<struct<album_id: string, album_title: string, album_kind: string>>, metadata: string>"
)
SNAPSHOT = f"library_path string, provider string, photos_version string, authorization_status string, metadata string, assets array<{SNAPSHOT_ASSET}>"


def key_of(table: str) -> tuple[str, ...]:
    return KEYS.get(table, ("id",))
