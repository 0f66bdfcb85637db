"""Registered queries of merges, details, sources, places, evaluation sets and plain relational primitives."""

from __future__ import annotations

from ..functions.scratch import written
from .queries import *  # noqa: F403
from .queries import JD, REGISTRY, C, DataFrame, F, G, L, M, T, Tables, Views, detail, evaluation, instant, julian_day, merge, millis, place, place_card, query, sid, stable_id, with_tables

# Snapshot merge

_FIELDS = ("media_type", "creation_date", "modification_date", "favorite", "deleted_at")


def _states(v: Views) -> tuple[DataFrame, DataFrame]:
    """The earlier state as seen rows, and the later snapshot with fingerprints."""
    prev, next_ = v.snapshot("prev"), v.snapshot("next")
    mark = F.sha2(F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}), 256)
    return prev.withColumn("source_fingerprint", mark), next_.withColumn("source_fingerprint", mark)


_SAME = " AND ".join(f"p.{c} IS NOT DISTINCT FROM n.{c}" for c in _FIELDS)


@query(
    "crawl_delta",
    with_tables("prev", "next")
    + f"""SELECT n.asset_id, CASE WHEN p.asset_id IS NULL THEN 'new' WHEN {_SAME} THEN 'unchanged' ELSE 'changed' END AS delta, n.deleted_at IS NOT NULL AS newly_deleted, false AS restored,
 n.deleted_at IS NULL AND (p.asset_id IS NULL OR NOT ({_SAME})) AS classify FROM next n LEFT JOIN prev p ON p.asset_id = n.asset_id""",
)
def crawl_delta(v: Views) -> DataFrame:
    prev, next_ = _states(v)
    old = prev.select(F.col("asset_id").alias("id"), "deleted_at")
    return G.delta(next_, prev, old).select("asset_id", "delta", "newly_deleted", "restored", "classify")


@query("crawl_missing", with_tables("prev", "next") + "SELECT asset_id FROM prev WHERE asset_id NOT IN (SELECT asset_id FROM next)")
def crawl_missing(v: Views) -> DataFrame:
    prev, next_ = _states(v)
    row = lambda df, s: df.select(F.lit("lib").alias("source_library_id"), "asset_id", F.lit(s).alias("first_seen_snapshot_id"), F.lit(s).alias("last_seen_snapshot_id"))
    seen = merge(row(prev, "s1"), row(next_, "s2"), ("source_library_id", "asset_id"), {"first_seen_snapshot_id": lambda o, n: o})
    return G.missing(seen, "lib", "s2").select("asset_id")


@query(
    "merge_seen",
    with_tables("prev", "next") + "SELECT coalesce(p.asset_id, n.asset_id) AS asset_id, CASE WHEN p.asset_id IS NULL THEN 's2' ELSE 's1' END AS first_seen_snapshot_id, CASE WHEN n.asset_id IS NULL THEN 's1' ELSE 's2' END AS last_seen_snapshot_id FROM prev p FULL JOIN next n ON p.asset_id = n.asset_id",
)
def merge_seen(v: Views) -> DataFrame:
    prev, next_ = _states(v)
    row = lambda df, s: df.select("asset_id", F.lit(s).alias("first_seen_snapshot_id"), F.lit(s).alias("last_seen_snapshot_id"))
    return merge(row(prev, "s1"), row(next_, "s2"), ("asset_id",), {"first_seen_snapshot_id": lambda o, n: o})


@query(
    "merge_asset",
    with_tables("prev", "next")
    + """SELECT coalesce(p.asset_id, n.asset_id) AS id, """
    + ", ".join(f"CASE WHEN p.asset_id IS NOT NULL AND (n.asset_id IS NULL OR n.deleted_at IS NOT NULL) THEN p.{c} ELSE n.{c} END AS {c}" for c in _FIELDS[:-1])
    + ", n.deleted_at, CASE WHEN n.deleted_at IS NOT NULL THEN 'user_deleted' END AS deletion_reason FROM prev p FULL JOIN next n ON p.asset_id = n.asset_id",
)
def merge_asset(v: Views) -> DataFrame:
    keep = ["asset_id", *_FIELDS, "deletion_source", "deletion_reason"]
    a, b = (v.snapshot(w).select(keep).withColumnRenamed("asset_id", "id") for w in ("prev", "next"))
    return G.merge_assets(a, b).drop("deletion_source")


_NEXT_GONE = "SELECT asset_id, deleted_at FROM next WHERE deleted_at IS NOT NULL"


@query(
    "merge_resource_tombstone",
    with_tables("asset_resource", "next") + f"SELECT r.id, coalesce(r.deleted_at, g.deleted_at) AS deleted_at, CASE WHEN r.deleted_at IS NOT NULL THEN 'user_deleted' WHEN g.asset_id IS NOT NULL THEN 'parent_asset_deleted' END AS deletion_reason FROM asset_resource r LEFT JOIN ({_NEXT_GONE}) g ON g.asset_id = r.asset_id",
)
def merge_resource_tombstone(v: Views) -> DataFrame:
    gone = v.snapshot("next").where("deleted_at IS NOT NULL")
    return G.tombstone_subordinates(v.asset_resource(), gone).select("id", "deleted_at", "deletion_reason")


@query(
    "requeue",
    with_tables("asset", "asset_resource") + f"SELECT {sid('classification_queue', 'a.id')} AS id, a.id AS asset_id, 'pending' AS state, coalesce(bool_or(needs_download) AND NOT bool_or(available_locally OR local_path <> ''), false) AS needs_download FROM asset a LEFT JOIN (SELECT * FROM asset_resource WHERE deleted_at IS NULL) r ON r.asset_id = a.id WHERE a.deleted_at IS NULL GROUP BY a.id",
)
def requeue(v: Views) -> DataFrame:
    live = v.asset().where("deleted_at IS NULL").select(F.col("id").alias("asset_id"))
    return G.requeue(live, v.asset_resource(), "2024-06-01T00:00:00Z").select("id", "asset_id", "state", "needs_download")


def _legacy(v: Views) -> DataFrame:
    """Resources as an old archive holds them: by source identifier, by place, by likeness, or not at all."""
    r = v.asset_resource().withColumn("n", F.regexp_extract("source_identifier", r"\d+", 0).cast("long"))
    positional = stable_id("asset_resource", F.col("asset_id"), "000000", F.col("resource_type"), F.col("uti"), F.col("original_filename"))
    old = r.where("n % 4 < 3").withColumn("id", F.when(F.col("n") % 4 == 0, F.concat(F.lit("old:"), F.col("n"))).when(F.col("n") % 4 == 1, positional).otherwise(F.concat(F.lit("like:"), F.col("n"))))
    return old.withColumn("source_identifier", F.when(F.col("n") % 4 == 0, F.col("source_identifier"))).drop("n")


@query(
    "resource_id_ladder",
    with_tables("asset_resource")
    + f"""SELECT asset_id, source_identifier, CASE n % 4 WHEN 0 THEN 'old:' || n WHEN 1 THEN {sid("asset_resource", "asset_id", "'000000'", "resource_type", "uti", "original_filename")} WHEN 2 THEN 'like:' || n ELSE id END AS id
FROM (SELECT *, CAST(substr(source_identifier, 5) AS BIGINT) AS n FROM asset_resource)""",
)
def resource_id_ladder(v: Views) -> DataFrame:
    new = v.asset_resource().select("asset_id", "source_identifier", F.lit(0).alias("position"), "resource_type", "uti", "original_filename")
    return G.resolve_resource_ids(new, _legacy(v)).select("asset_id", "source_identifier", "id")


@query(
    "migrate_tombstones",
    with_tables("asset", "asset_resource") + "SELECT r.id, coalesce(r.deleted_at, a.deleted_at) AS deleted_at, CASE WHEN r.deleted_at IS NOT NULL THEN 'user_deleted' WHEN a.deleted_at IS NOT NULL THEN 'parent_asset_deleted' END AS deletion_reason FROM asset_resource r JOIN asset a ON a.id = r.asset_id",
)
def migrate_tombstones(v: Views) -> DataFrame:
    return M.normalize_tombstones(v.asset_resource(), v.asset()).select("id", "deleted_at", "deletion_reason")


# Details (H8 to H11)


@query(
    "open_bundle",
    with_tables("asset", "asset_resource", "album_membership", "location_observation", "visual_observation", "evidence_ref")
    + """SELECT a.id, (SELECT string_agg(id, ',' ORDER BY resource_type, original_filename, id) FROM asset_resource r WHERE r.asset_id = a.id) AS resources, (SELECT string_agg(album_id, ',' ORDER BY album_title, album_id) FROM album_membership m WHERE m.asset_id = a.id) AS albums,
 (SELECT string_agg(id, ',' ORDER BY id) FROM location_observation l WHERE l.asset_id = a.id) AS locations, (SELECT string_agg(label, ',' ORDER BY observation_type, confidence DESC, label) FROM (SELECT DISTINCT * FROM visual_observation) o WHERE o.asset_id = a.id) AS labels,
 (SELECT string_agg(id, ',' ORDER BY evidence_kind, id) FROM evidence_ref e WHERE e.asset_id = a.id) AS evidence FROM asset a""",
)
def open_bundle(v: Views) -> DataFrame:
    only = {"asset_resource": ("id",), "album_membership": ("album_id",), "location_observation": ("id",), "visual_observation": ("label",), "evidence_ref": ("id",)}
    b = detail.bundles(Tables(v), only=only)
    ids = lambda c, f: F.nullif(F.array_join(F.transform(c, lambda x: x[f]), ","), F.lit(""))
    return b.select("id", ids("asset_resource", "id").alias("resources"), ids("album_membership", "album_id").alias("albums"), ids("location_observation", "id").alias("locations"), ids("visual_observation", "label").alias("labels"), ids("evidence_ref", "id").alias("evidence"))


@query(
    "evidence_lookup",
    with_tables("asset", "location_observation", "evidence_ref")
    + "SELECT row_id, id, evidence_kind, pointer FROM (SELECT asset_id AS row_id, id, evidence_kind, pointer FROM evidence_ref UNION SELECT id, id, evidence_kind, pointer FROM evidence_ref UNION SELECT l.id, e.id, evidence_kind, pointer FROM location_observation l JOIN evidence_ref e ON e.id = l.evidence_id) WHERE row_id IN (SELECT id FROM asset UNION SELECT id FROM location_observation UNION SELECT id FROM evidence_ref)",
)
def evidence_lookup(v: Views) -> DataFrame:
    t = Tables(v)
    t["evidence_ref"] = written(t["evidence_ref"], "evidence_ref")  # as an archive has it
    return detail.evidence(t, of=("location_observation",)).select("row_id", "id", "evidence_kind", "pointer")


@query("edge_lookup", "SELECT node, count(*) AS n, min(id) AS first FROM (SELECT o_custkey AS node, o_orderkey AS id FROM orders UNION ALL SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey <> o_custkey) GROUP BY node")
def edge_lookup(v: Views) -> DataFrame:
    e = v.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id"))
    return detail.edges_of(e).groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("export_choice", with_tables("asset_resource") + "SELECT asset_id, regexp_extract(original_filename, '[^/]*$') AS original FROM asset_resource WHERE deleted_at IS NULL")
def export_choice(v: Views) -> DataFrame:
    return detail.export_choice(v.asset_resource())


# Sources (A4 to A6, A10): library tables made of orders, customers and parts


def _library(v: Views) -> dict[str, DataFrame]:
    o, c, p, li = v.raw("orders"), v.raw("customer"), v.raw("part"), v.raw("lineitem")
    k = F.col("o_orderkey")
    asset = o.select(
        k.alias("Z_PK"), F.when(k % 50 != 0, F.concat(F.lit("U"), k)).alias("ZUUID"), (k % 3).cast("int").alias("ZKIND"), (k % 4).cast("int").alias("ZKINDSUBTYPE"), (F.col("o_totalprice") * 1000).alias("ZDATECREATED"), F.lit(None).cast("double").alias("ZMODIFICATIONDATE"),
        F.lit(0.0).alias("ZADDEDDATE"), (k % 4000).alias("ZWIDTH"), (k % 3000).alias("ZHEIGHT"), F.lit(None).cast("double").alias("ZDURATION"), (k % 2).cast("int").alias("ZFAVORITE"), F.lit(0).alias("ZHIDDEN"), F.lit(None).cast("string").alias("ZAVALANCHEUUID"),
        (k % 200 - 100).cast("double").alias("ZLATITUDE"), (k % 370 - 185).cast("double").alias("ZLONGITUDE"), F.lit("public.heic").alias("ZUNIFORMTYPEIDENTIFIER"), F.concat(k, F.lit(".heic")).alias("ZFILENAME"), (k % 40 == 0).cast("int").alias("ZTRASHEDSTATE"), F.when(k % 80 == 0, 60.5).alias("ZTRASHEDDATE"),
    )
    attributes = o.where(k % 3 != 0).select(k.alias("ZASSET"), F.col("o_orderpriority").alias("ZTIMEZONENAME"), (k % 9 - 1).cast("double").alias("ZGPSHORIZONTALACCURACY"), F.when(k % 2 == 0, F.concat(F.lit("orig"), k)).alias("ZORIGINALFILENAME"))
    n = F.col("p_partkey")
    resource = p.select(n.alias("Z_PK"), (n % 500 + 1).alias("ZASSET"), (n % 5).cast("int").alias("ZRESOURCETYPE"), F.when(n % 3 == 0, F.col("p_type")).alias("ZCOMPACTUTI"), F.col("p_size").cast("long").alias("ZDATALENGTH"), F.when(n % 2 == 0, F.col("p_name")).alias("ZSTABLEHASH"), F.col("p_brand").alias("ZFINGERPRINT"), (n % 2).cast("int").alias("ZLOCALAVAILABILITY"), (n % 4 - 1).cast("int").alias("ZREMOTEAVAILABILITY"))
    album = c.select(F.col("c_custkey").alias("Z_PK"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("ZUUID"), F.col("c_mktsegment").alias("ZTITLE"), F.col("c_nationkey").alias("ZKIND"), (F.col("c_custkey") % 10 == 0).cast("int").alias("ZTRASHEDSTATE"))
    bridge = o.select(F.col("o_custkey").alias("Z_33ALBUMS"), k.alias("Z_3ASSETS"))
    return {"asset": asset, "attributes": attributes, "resource": resource, "album": album, "bridge": bridge, "lineitem": li}


@query(
    "source_assets",
    """SELECT o_orderkey AS pk, 'U' || o_orderkey AS local_identifier, CASE o_orderkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'kind:2' END AS media_type, strftime(to_timestamp(978307200 + CAST(trunc(o_totalprice * 1000) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS creation_date,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS timezone_name, CASE WHEN o_orderkey % 40 <> 0 THEN '' WHEN o_orderkey % 80 = 0 THEN '2001-01-01T00:01:00Z' ELSE '' END AS deleted_at, CASE WHEN o_orderkey % 40 = 0 THEN 'trashed' ELSE '' END AS deletion_reason,
 CASE WHEN v THEN CAST(o_orderkey % 200 - 100 AS DOUBLE) END AS latitude, CASE WHEN v AND o_orderkey % 3 <> 0 AND o_orderkey % 9 >= 1 THEN CAST(o_orderkey % 9 - 1 AS DOUBLE) END AS accuracy
FROM (SELECT *, o_orderkey % 200 - 100 BETWEEN -90 AND 90 AND o_orderkey % 370 - 185 BETWEEN -180 AND 180 AND NOT (o_orderkey % 200 = 100 AND o_orderkey % 370 = 185) AS v FROM orders) WHERE o_orderkey % 50 <> 0""",
)
def source_assets(v: Views) -> DataFrame:
    t = _library(v)
    a = L.library_assets(t["asset"], t["attributes"])
    return a.select("pk", "local_identifier", "media_type", "creation_date", "timezone_name", "deleted_at", "deletion_reason", F.col("location.latitude").alias("latitude"), F.col("location.horizontal_accuracy").alias("accuracy"))


@query(
    "source_resources",
    """SELECT p_partkey % 500 + 1 AS pk, count(*) AS n, string_agg(CASE WHEN p_partkey % 2 > 0 THEN 'local' WHEN p_partkey % 4 - 1 > 0 THEN 'remote' ELSE 'unknown' END || ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN o_orderkey IS NOT NULL THEN 'public.heic' ELSE '' END || ' '
 || coalesce(CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN 'orig' || o_orderkey END, o_orderkey || '.heic', '') || ' ' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END, ';' ORDER BY p_partkey) AS resources
FROM part LEFT JOIN orders ON o_orderkey = p_partkey % 500 + 1 GROUP BY 1""",
)
def source_resources(v: Views) -> DataFrame:
    t = _library(v)
    r = L.library_resources(t["resource"], t["asset"], t["attributes"])
    return r.select("pk", F.size("resources").cast("bigint").alias("n"), F.array_join(F.transform("resources", lambda x: F.concat_ws(" ", x["availability"], x["uti"], x["original_filename"], x["stable_hash"])), ";").alias("resources"))


@query(
    "source_albums",
    "SELECT o_orderkey AS pk, string_agg(c_mktsegment || '/' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'sqlite_album:' || c_custkey END || '/kind:' || c_nationkey, ';' ORDER BY c_mktsegment) AS albums FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 10 <> 0 GROUP BY o_orderkey",
)
def source_albums(v: Views) -> DataFrame:
    t = _library(v)
    m = L.library_albums(t["bridge"], t["album"])
    return m.select("pk", F.array_join(F.transform("albums", lambda x: F.concat_ws("/", x["album_title"], x["album_id"], x["album_kind"])), ";").alias("albums"))


_UUID_SQL = "'00000000-0000-0000-0000-' || lpad(CAST(p_partkey % 300 AS VARCHAR), 12, '0')"


@query(
    "local_media_priority",
    f"""SELECT uuid, path, class, n FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY CASE class WHEN 'derivative' THEN 1 WHEN 'render' THEN 2 WHEN 'original' THEN 3 ELSE 4 END, p_size DESC, path) AS n FROM
 (SELECT p_partkey, p_size, {_UUID_SQL} AS uuid, '/lib/' || k || '/' || {_UUID_SQL} || '_' || p_partkey || '.jpeg' AS path, CASE k WHEN 'derivatives' THEN 'derivative' WHEN 'renders' THEN 'render' WHEN 'originals' THEN 'original' ELSE 'local_media' END AS class
  FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'derivatives' WHEN 1 THEN 'renders' WHEN 2 THEN 'originals' ELSE 'other' END AS k FROM part)))""",
)
def local_media_priority(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    uuid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((k % 300).cast("string"), 12, "0"))
    folder = F.element_at(F.array(*map(F.lit, ("derivatives", "renders", "originals", "other"))), (k % 4 + 1).cast("int"))
    files = v.raw("part").select(F.concat(F.lit("/lib/"), folder, F.lit("/"), uuid, F.lit("_"), k, F.lit(".jpeg")).alias("path"), F.col("p_size").alias("length"))
    return L.media_index(files).select("uuid", "path", "class", "n")


# Places (I1 to I11, I14 to I19)


@query(
    "place_keys",
    with_tables("asset", "location_observation")
    + """, r AS (SELECT latitude, longitude, coalesce(horizontal_accuracy, 0.0) AS accuracy, a.id, creation_date FROM location_observation l JOIN asset a ON a.id = l.asset_id AND a.deleted_at IS NULL)
SELECT latitude, longitude, accuracy, count(*) AS asset_count, min(creation_date) AS first_seen, max(creation_date) AS last_seen, arg_min(id, (-epoch_us(CAST(creation_date AS TIMESTAMP)), id)) AS representative_asset_id FROM r GROUP BY ALL""",
)
def place_keys(v: Views) -> DataFrame:
    return place.backfill_keys(v.asset(), v.location_observation())


_KEYS = "SELECT DISTINCT latitude, longitude, coalesce(horizontal_accuracy, 0.0) AS accuracy FROM location_observation"


@query(
    "backfill_jobs",
    with_tables("location_observation")
    + f""", k AS ({_KEYS}), o AS (SELECT latitude + 1e-10 AS latitude, longitude, accuracy FROM k WHERE floor(accuracy) % 3 = 0), t AS (SELECT * FROM k WHERE floor(accuracy) % 2 = 0)
SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE abs(o.latitude - k.latitude) < 1e-8 AND abs(o.longitude - k.longitude) < 1e-8 AND abs(o.accuracy - k.accuracy) < 0.1) AND EXISTS (SELECT 1 FROM t WHERE t.latitude = k.latitude AND t.longitude = k.longitude AND t.accuracy = k.accuracy)""",
)
def backfill_jobs(v: Views) -> DataFrame:
    k = v.location_observation().select("latitude", "longitude", F.coalesce("horizontal_accuracy", F.lit(0.0)).alias("accuracy")).distinct()
    done = k.where("floor(accuracy) % 3 = 0").withColumn("latitude", F.col("latitude") + F.lit(1e-10))
    return place.backfill_jobs(k, done, k.where("floor(accuracy) % 2 = 0"), 2).select("latitude", "longitude", "accuracy")


@query("poi_topk", "SELECT s_nationkey AS key, s_name AS name, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_name) AS rank FROM supplier) WHERE rank <= 12")
def poi_topk(v: Views) -> DataFrame:
    rows = v.raw("supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("distance_m"))
    return place.nearest_candidates(rows, "key").select("key", "name", "rank")


@query("normalized_key", "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS key FROM documents")
def normalized_key(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", T.key(F.col("text")).alias("key"))


def _case_sql(value: str, rules: tuple, words_first: bool = False) -> str:
    out = []
    for rule in rules:
        how, words, meaning = ("has", *rule) if words_first else rule
        test = {"is": "{v} = '{w}'", "has": "contains({v}, '{w}')", "starts": "starts_with({v}, '{w}')"}[how]
        out.append("WHEN " + " OR ".join(test.format(v=value, w=w) for w in words) + f" THEN '{meaning}'")
    return "CASE " + " ".join(out) + " ELSE '' END"


_KIND_WORDS = ("highway_path", "Highway-Primary", "tourism viewpoint", "waterfall", "Water", "national  park", "park", "shop", "aeroway_gate", "boundary", "suburb", "bench", "peak", "place town", "x")


@query("map_kind", f"SELECT p_partkey, {_case_sql('k', (('is', ('',), ''), *place.MAP_KINDS))} AS kind FROM (SELECT p_partkey, trim(regexp_replace(translate(lower(list_extract({list(_KIND_WORDS)}, CAST(p_partkey % 15 + 1 AS BIGINT)) || CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_type ELSE '' END), '_-', '  '), '\\s+', ' ', 'g')) AS k FROM part)")
def map_kind(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    word = F.concat(F.element_at(F.array(*map(F.lit, _KIND_WORDS)), (k % 15 + 1).cast("int")), F.when(k % 7 == 0, F.concat(F.lit(" "), F.col("p_type"))).otherwise(""))
    return v.raw("part").select("p_partkey", place.map_kind(word).alias("kind"))


_NAMES = ("Grand Hotel", "North Station", "City Airport", "Ridge Trail", "Falls View", "Corner Shop", "Train Station")
_CATEGORIES = ("MKPOICategoryHotel", "MKPOICategoryPublicTransport", "store", "MKPOICategoryNationalPark", "")
_SHORT = ("hotel", "public transport", "store", "national park", "")


@query("poi_category", f"SELECT p_partkey, CASE WHEN c IN ('hotel', 'public transport', 'national park') THEN c ELSE {_case_sql('n', place.NAME_CATEGORIES, True)} END AS category FROM (SELECT p_partkey, lower(list_extract({list(_NAMES)}, CAST(p_partkey % 7 + 1 AS BIGINT))) AS n, list_extract({list(_SHORT)}, CAST(p_partkey % 5 + 1 AS BIGINT)) AS c FROM part)")
def poi_category(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    name, category = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 7 + 1).cast("int")), F.element_at(F.array(*map(F.lit, _CATEGORIES)), (k % 5 + 1).cast("int"))
    return v.raw("part").select("p_partkey", place.poi_category(category, name).alias("category"))


@query("area_trail", "SELECT n_nationkey, concat_ws(' > ', r_name, n_name) AS trail FROM nation JOIN region ON r_regionkey = n_regionkey")
def area_trail(v: Views) -> DataFrame:
    j = v.raw("nation").join(v.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    address = F.struct(F.col("r_name").alias("country"), F.lit(" ").alias("administrative_area"), F.lit(None).cast("string").alias("sub_administrative_area"), F.col("n_name").alias("locality"), F.lit("").alias("sub_locality"))
    return j.select("n_nationkey", F.array_join(F.transform(place.area_levels(address), lambda a: a["name"]), " > ").alias("trail"))


@query("input_alias", "SELECT s_suppkey, s_name AS local_identifier, round(s_acctbal / 100, 6) AS latitude, 7.5::DOUBLE AS longitude, 0.0::DOUBLE AS accuracy_meters FROM supplier")
def input_alias(v: Views) -> DataFrame:
    where = F.struct(F.round(F.col("s_acctbal") / 100, 6).alias("latitude"), F.lit("7.5").alias("longitude"))
    asset = F.struct(F.col("s_name").alias("local_identifier"), where.alias("location"))
    got = v.raw("supplier").select("s_suppkey", place.parse_input(F.to_json(F.struct(asset.alias("asset")))).alias("i")).select("s_suppkey", "i.*")
    return got.select("s_suppkey", "local_identifier", F.round("latitude", 6).alias("latitude"), "longitude", "accuracy_meters")


@query("valid_location", "SELECT o_orderkey, x BETWEEN -90 AND 90 AND y BETWEEN -180 AND 180 AND NOT (x = 0 AND y = 0) AS valid FROM (SELECT o_orderkey, o_orderkey % 200 - 100 AS x, o_orderkey % 400 - 200 AS y FROM orders)")
def valid_location(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return v.raw("orders").select("o_orderkey", place.valid_location((k % 200 - 100).cast("double"), (k % 400 - 200).cast("double")).alias("valid"))


@query("render_card")
def render_card(v: Views) -> DataFrame:
    poi = F.struct(F.col("s_name").alias("name"), F.lit("MKPOICategoryCafe").alias("category"), F.abs("s_acctbal").alias("distance_m"))
    pois = v.raw("supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(poi)).alias("poi_candidates"))
    n = v.raw("nation").join(pois, F.col("n_nationkey") == F.col("s_nationkey"), "left").withColumn("r", F.from_json(F.to_json(F.struct(F.struct(F.col("n_name").alias("locality")).alias("address"), "poi_candidates", F.lit(150.0).alias("radius_meters"))), place_card.RESULT))
    return n.select("n_nationkey", place_card.render(F.col("r")).alias("card"))


# Evaluation sets


@query("eval_latest", with_tables("asset") + "SELECT id FROM asset WHERE deleted_at IS NULL AND media_type = 'image' ORDER BY creation_date DESC, id LIMIT 15")
def eval_latest(v: Views) -> DataFrame:
    return evaluation.latest(v.asset()).select("id")


@query("eval_pairs", "SELECT n_nationkey, unnest(['m1', 'm2', 'm3']) AS model FROM nation")
def eval_pairs(v: Views) -> DataFrame:
    return evaluation.pairs(v.raw("nation").select("n_nationkey"), ["m1", "m2", "m3"])


@query("skip_histogram", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'no_original' ELSE 'too_large' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def skip_histogram(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return evaluation.skip_histogram(v.raw("orders").select(F.when(k % 2 == 0, F.when(k % 3 == 0, "no_original").otherwise("too_large")).alias("reason")))


@query("resolve_originals", with_tables("asset", "asset_resource") + "SELECT a.id, CASE WHEN r.local_path <> '' THEN r.local_path WHEN r.needs_download THEN '/cache/' || a.id END AS path, CASE WHEN r.local_path <> '' THEN 'library' WHEN r.needs_download THEN 'cache' ELSE 'export' END AS origin FROM asset a JOIN asset_resource r ON r.asset_id = a.id")
def resolve_originals(v: Views) -> DataFrame:
    r = v.asset_resource()
    return evaluation.resolve_originals(v.asset(), r.where("local_path <> ''").select("asset_id", F.col("local_path").alias("path")), r.where("needs_download").select("asset_id", F.concat(F.lit("/cache/"), F.col("asset_id")).alias("path")))


# Primitives on the native tables


@query("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(v: Views) -> DataFrame:
    big = v.raw("orders").where("o_totalprice > 400000")
    return v.raw("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_not_in(v: Views) -> DataFrame:
    return v.raw("orders").join(v.raw("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("union_distinct", "SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal < 0 UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def union_distinct(v: Views) -> DataFrame:
    return v.raw("supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation")).union(v.raw("customer").where("c_acctbal < 0").select("c_nationkey")).distinct()


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(v: Views) -> DataFrame:
    return v.raw("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("case_group", "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, count(DISTINCT l_partkey) AS parts, max(l_linenumber) AS most FROM lineitem GROUP BY 1")
def case_group(v: Views) -> DataFrame:
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    return v.raw("lineitem").groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.max("l_linenumber").alias("most"))


@query("grouped_json", "SELECT r_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def grouped_json(v: Views) -> DataFrame:
    n = v.raw("nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("nations"))
    return v.raw("region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "nations")


@query("julian_days", f"SELECT event_id, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, round({JD.format('ts')}, 6) AS jd FROM events")
def julian_days(v: Views) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return v.raw("events").where(instant(iso).isNotNull()).select("event_id", millis(iso).alias("ms"), F.round(julian_day(iso), 6).alias("jd"))


@query("path_class", "SELECT p_partkey, CASE WHEN contains(k, 'derivative') THEN 'derivative' WHEN contains(k, 'render') THEN 'render' WHEN contains(k, 'original') THEN 'original' ELSE 'local_media' END AS class FROM (SELECT p_partkey, lower('/Lib/' || list_extract(['Derivatives', 'Renders', 'Originals', 'x'], CAST(p_partkey % 4 + 1 AS BIGINT)) || '/a') AS k FROM part)")
def path_class(v: Views) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("Derivatives", "Renders", "Originals", "x"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return v.raw("part").select("p_partkey", C.path_class(F.concat(F.lit("/Lib/"), folder, F.lit("/a"))).alias("class"))
