"""The best neighbors of all kinds, chosen where lists of targets meet: no pair is exchanged.

Assets are numbers in the order of date and id, and dealt into blocks of that order. A group (album, hash, burst, place, label
with its confidence, crowded instant) has one list of its first targets, which goes once to each block that has sources of the
group; an asset's nearest in time are a list of its own. Within a block the lists of each source are put together, cut as each
kind is, scored, and the best targets stay with their reasons as numbers. Then sources are dealt anew, each block gets one record of each asset that is
named in it, and the texts are put in.

A row of a table beside the assets is `k` among the rows of its asset (2^20 at most); number and k in one are a target's `tr`.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.scratch import written
from .instants import instant_lists, restored, time_weights
from .place_tree import finite, nearest
from .range_join import in_order

#: Sources of a block at most and at least, those that are scored at once, and bits of `tr` for the row of an asset.
BLOCK, LEAST, CHUNK, ROW = 8192, 256, 1024, 20
BURST, ALBUM, HASH, TIME, PLACE, SEEN = range(1, 7)
#: Added to the kind of the first reason of each target, and to the kinds (as bits) of an asset that is a source.
FIRST, SOURCE = 8, 128
#: Fixed weights of kinds whose reasons all weigh the same.
FIXED = {BURST: 0.95, ALBUM: 0.8, HASH: 1.0}
TYPES = ("same_burst", "same_album", "same_resource_hash", "nearby_time", "nearby_location", "shared_observation")
METHODS = ("asset.burst_identifier", "album_membership.album_id", "asset_resource.sha256", "asset.creation_date", "location_observation.raw_gps_window", "visual_observation.type_label")

LIST = "block bigint, ord int, gid binary, s bigint, tr array<bigint>, k1 array<double>, w array<double>, dh array<bigint>"
BEST = "block bigint, s bigint, t array<bigint>, m array<tinyint>, ord array<tinyint>, sk array<int>, tk array<int>"
REASON = "struct<ord:tinyint, w:double, d:string, x:double, y:double>"
PAIR = f"source_id string, target_id string, creation_date string, score double, n_reasons bigint, rank bigint, r array<{REASON}>, e array<string>"


def numbered(assets: DataFrame, beside: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Live assets (asset) with their number ti, and the rows of the tables beside them by ti and k, written."""
    a = in_order(assets, "creation_date", "id").withColumnRenamed("_index", "ti")
    out = {"asset": a}
    for name, rows in beside.items():
        kept = rows.join(a.select(F.col("id").alias("asset_id"), "ti"), "asset_id")
        columns = [c for c in rows.columns if c != "asset_id"]
        k = F.row_number().over(W.partitionBy("asset_id").orderBy(*columns)).cast("bigint") - 1
        out[name] = written(kept.withColumn("k", k).select("ti", "k", *columns), name)
    return out


def _gid(ord_: int, *key: Column | str) -> Column:
    """A group of a kind by its key, null if a part is: 16 bytes."""
    parts = [c for p in key for c in (F.lit("\0"), (F.col(p) if isinstance(p, str) else p).cast("string"))]
    return F.unhex(F.md5(F.concat(F.lit(str(ord_)), *parts)))


def _tr(k: Column | str = "k") -> Column:
    return F.shiftleft(F.col("ti"), ROW) + (F.col(k) if isinstance(k, str) else k)


def groups(n: dict[str, DataFrame], most: int, box: float, width: float) -> tuple[DataFrame, DataFrame]:
    """Which groups each source is in (ti, k, ord, gid, d: what tells reasons of one kind apart), and the groups' targets
    (ord, gid, k1, tr, dh: the same of places), of those whose order no source changes. Crowded instants come from nearest_lists."""
    none, zero = F.lit(0).cast("bigint"), F.lit(0.0)
    ref = lambda df, ord_, gid, d=F.lit(""): df.select("ti", "k", F.lit(ord_).alias("ord"), gid.alias("gid"), d.alias("d"))
    target = lambda df, ord_, gid, k1=zero, dh=none: df.select(F.lit(ord_).alias("ord"), gid.alias("gid"), k1.alias("k1"), _tr().alias("tr"), dh.alias("dh"))
    burst = n["asset"].where(F.trim("burst_identifier") != "").withColumn("k", none)
    album, hash_, place, seen = (n[t] for t in ("album_membership", "asset_resource", "location_observation", "visual_observation"))
    place = place.where(finite("latitude", "longitude")).withColumn("latitude", F.col("latitude") + zero).withColumn("longitude", F.col("longitude") + zero)
    at = ["latitude", "longitude"]
    by_label, sure = ["observation_type", "label"], lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    refs = [
        ref(burst, BURST, _gid(BURST, "burst_identifier")),
        ref(album, ALBUM, _gid(ALBUM, "album_id"), F.to_json(F.struct("album_id", "album_title"))),
        ref(hash_, HASH, _gid(HASH, "sha256")),
        ref(place, PLACE, _gid(PLACE, *at)),
        ref(seen, SEEN, _gid(SEEN, *by_label, sure("confidence")), F.to_json(F.struct(*by_label))),
    ]
    # Of one place, its first targets; around each place, the nearest places that hold all that count.
    w = W.partitionBy(*at).orderBy("ti", "k")
    first = place.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1).groupBy(*at).agg(F.collect_list(_tr()).alias("trs"))
    places = written(first.toDF("lat", "lon", "trs").withColumn("n", F.size("trs")), "places")
    near = nearest(places.select("lat", "lon", "n"), most + 1, box, width)
    met = near.join(places.select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), "trs"), ["tlat", "tlon"])
    # Targets of one confidence are in an order that no source changes; there are few confidences.
    w = W.partitionBy(*by_label, "confidence").orderBy("ti", "k")
    few = seen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1).withColumnRenamed("confidence", "c2")
    labels = seen.select(*by_label, F.col("confidence").alias("c1")).distinct().join(few, by_label)
    targets = [
        target(burst, BURST, _gid(BURST, "burst_identifier")),
        target(album, ALBUM, _gid(ALBUM, "album_id")),
        target(hash_, HASH, _gid(HASH, "sha256")),
        met.select(F.lit(PLACE).alias("ord"), _gid(PLACE, "slat", "slon").alias("gid"), F.col("apart").alias("k1"), F.explode("trs").alias("tr"), F.xxhash64(*_place_numbers(F.col("dlat"), F.col("dlon"))).alias("dh")),
        target(labels, SEEN, _gid(SEEN, *by_label, sure("c1")), F.coalesce(-F.least("c1", "c2"), F.lit(float("-inf")))),
    ]
    return reduce(DataFrame.union, refs).where("gid IS NOT NULL"), reduce(DataFrame.union, targets).where("gid IS NOT NULL")


def _place_numbers(dlat: Column, dlon: Column) -> list[Column]:
    from .neighbors import METRES

    return [F.round(dlat, 9).alias("latitude_delta"), F.round(dlon, 9).alias("longitude_delta"), F.round((dlat + dlon) * METRES, 3).alias("approx_distance_meters")]


def instants(assets: DataFrame, most: int, window: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crowded instants as groups (their sources and targets, as of groups()), and the lists of all other assets.

    Of one instant, its first targets. An instant of more than a list holds has no others in it.
    """
    a = assets.where("jd IS NOT NULL").select("ti", "jd")
    w = W.partitionBy("jd").orderBy("ti")
    first = a.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 2).withColumn("over", F.count("*").over(W.partitionBy("jd")) > most + 1)
    first = in_order(first.select("ti", "jd", "over"), "jd", "ti")
    crowds = first.where("over")
    none, gid = F.lit(0).cast("bigint"), _gid(TIME, "jd").alias("gid")
    refs = a.join(crowds.select("jd").distinct(), "jd", "left_semi").select("ti", none.alias("k"), F.lit(TIME).alias("ord"), gid, F.lit("").alias("d"))
    targets = crowds.select(F.lit(TIME).alias("ord"), gid, F.lit(0.0).alias("k1"), _tr(none).alias("tr"), none.alias("dh"))
    return refs, targets, instant_lists(first, most, window)


def best(n: dict[str, DataFrame], most: int, limit: int, window: float, box: float, width: float) -> DataFrame:
    """The first `limit` targets of each source by score, number of reasons and number (BEST): the reasons of all its targets
    follow each other; sk and tk are the rows of source and target that make a reason, m the kinds of a target's reasons. What else a reason holds, its weight
    too, is in those rows."""
    parts = int(n["asset"].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(LEAST, min(BLOCK, n["asset"].count() // (4 * parts)))
    block = lambda c: F.floor(F.col(c) / F.lit(size)).cast("bigint").alias("block")
    refs, targets = groups(n, most, box, width)
    crowd_refs, crowd_targets, own = instants(n["asset"], most, window)
    refs = refs.union(crowd_refs).select(block("ti"), "*")
    w = W.partitionBy("gid").orderBy("k1", "tr", "dh")
    first = targets.union(crowd_targets).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    items = F.sort_array(F.collect_list(F.struct("k1", "tr", "dh"))).alias("i")
    lists = first.groupBy("gid").agg(F.first("ord").alias("ord"), items).where(F.size("i") > 1)  # none has but its source
    sent = refs.groupBy("gid").agg(F.collect_set("block").alias("blocks"))
    lists = lists.join(sent, "gid").withColumn("dh", F.when(F.col("ord") == PLACE, F.col("i.dh"))).select(F.explode("blocks").alias("block"), "ord", "gid", F.col("i.tr").alias("tr"), F.col("i.k1").alias("k1"), "dh")
    lists = lists.unionByName(own.select(block("s"), F.lit(TIME).alias("ord"), "s", "tr", "w"), allowMissingColumns=True).select(*[c.split()[0] for c in LIST.split(", ")])
    chosen = refs.select("block", "ti", "k", "ord", "gid", "d").groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(_choose(most, limit), BEST)
    return written(chosen, "best")


def _weights(ord_: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """By the kinds and what orders their targets: seconds, degrees, or confidence (negative)."""
    from .neighbors import METRES

    metres = k1 * METRES
    w = np.where(ord_ == PLACE, np.where(metres <= 100, 0.75, np.where(metres <= 500, 0.65, 0.5)), time_weights(k1))
    w = np.where(ord_ == SEEN, np.fmin(0.75, -0.75 * k1), w)
    for o, fixed in FIXED.items():
        w[ord_ == o] = fixed
    return w


def _round(x: np.ndarray) -> np.ndarray:
    """Billionths, halves of the shortest decimal away from zero."""
    scaled = x * 1e9
    out = np.rint(scaled).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = int((Decimal(repr(float(x[i]))) * 10**9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _flat(lists: pa.ChunkedArray, of: type) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy().astype(of)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each of so many items, and its place among them."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _places(owner: np.ndarray) -> np.ndarray:
    """The place of each among those of the same owner; owners follow each other."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))


def _choose(most: int, limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("block", pa.int64()), ("s", pa.int64()), ("t", pa.list_(pa.int64())), ("m", pa.list_(pa.int8())), ("ord", pa.list_(pa.int8())), ("sk", pa.list_(pa.int32())), ("tk", pa.list_(pa.int32()))])

    def of_block(refs: pa.Table, lists: pa.Table) -> pa.Table:
        if not len(lists):
            return schema.empty_table()
        alone = pc.is_valid(lists["s"])
        own, rest = lists.filter(alone), lists.filter(pc.invert(alone))
        place = pc.equal(rest["ord"], PLACE)
        rest = pa.concat_tables([rest.filter(place), rest.filter(pc.invert(place))])
        length = lambda x: pc.list_value_length(x["tr"]).to_numpy().astype(np.int64)
        long = np.concatenate([length(own), length(rest)])
        tr = np.concatenate([restored(_flat(own["tr"], np.int64), length(own)) << ROW, _flat(rest["tr"], np.int64)])
        k1 = _flat(rest["k1"], np.float64)
        w = np.concatenate([_flat(own["w"], np.float64), _weights(np.repeat(rest["ord"].to_numpy(), length(rest)), k1)])
        k1 = np.concatenate([np.zeros(len(tr) - len(k1)), k1])
        told = _flat(rest["dh"], np.int64)
        dh = np.zeros(len(tr), np.int64)
        before = int(length(own).sum())
        dh[before : before + len(told)] = told
        met = pc.index_in(refs["gid"], value_set=rest["gid"].combine_chunks())
        refs = refs.append_column("li", met).filter(pc.is_valid(met))
        col = lambda c, of_own: np.concatenate([of_own, refs[c].to_numpy()]).astype(np.int64)
        zeros = np.zeros(len(own), np.int64)
        details = refs["d"].combine_chunks().dictionary_encode()
        place_of = pc.sort_indices(details.dictionary).to_numpy().argsort()  # details as numbers in their order
        refs = refs.append_column("dn", pa.array(place_of[details.indices.to_numpy()]))
        rs, rk, ro, rd = col("ti", own["s"].to_numpy()), col("k", zeros), col("ord", zeros + TIME), col("dn", zeros)
        li = np.concatenate([np.arange(len(own)), refs["li"].to_numpy() + len(own)]).astype(np.int64)
        order = np.lexsort((rk, ro, rs))
        rs, rk, ro, rd, li = (x[order] for x in (rs, rk, ro, rd, li))
        begin = np.cumsum(long) - long
        number = (lists if len(lists) else refs)["block"][0].as_py()
        out = []
        sources = np.flatnonzero(np.concatenate([[True], rs[1:] != rs[:-1]]))
        for at in range(0, len(sources), CHUNK):
            end = sources[at + CHUNK] if at + CHUNK < len(sources) else len(rs)
            some = slice(sources[at], end)
            out.append(_of_sources(number, rs[some], rk[some], ro[some], rd[some], begin[li[some]], long[li[some]], tr, k1, w, dh, most, limit, schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return of_block


def _of_sources(block, rs, rk, ro, rd, begin, long, tr, k1, w, dh, most, limit, schema) -> pa.Table:
    """The best targets of some sources, whose groups (by source and kind) name pieces of the lists tr, k1, w and dh."""
    local = np.cumsum(np.concatenate([[False], rs[1:] != rs[:-1]]))  # the number of each source here
    ref, within = _spread(long)
    item = begin[ref] + within
    other = (tr[item] >> ROW) != rs[ref]
    ref, item = ref[other], item[other]
    kind = local * 8 + ro
    several = np.bincount(kind, minlength=kind.max() + 1)[kind] > 1
    # A source in one group of a kind has its targets in order; those of several groups are ranked together.
    single = ~several[ref]
    single[single] = _places(ref[single]) < most
    more = several[ref]
    if more.any():
        r, i = ref[more], item[more]
        told = np.where(ro[r] == PLACE, dh[i], rd[r])
        order = np.lexsort((rk[r], tr[i], told, tr[i] >> ROW, k1[i], kind[r]))
        r, i = r[order], i[order]
        t, of = tr[i] >> ROW, kind[r]
        again = np.concatenate([[False], (t[1:] == t[:-1]) & (of[1:] == of[:-1])]) & (ro[r] == HASH)
        r, i = r[~again], i[~again]
        first = _places(kind[r]) < most
        ref, item = np.concatenate([ref[single], r[first]]), np.concatenate([item[single], i[first]])
    else:
        ref, item = ref[single], item[single]
    key = (local[ref] << 40) | (tr[item] >> ROW)
    order = np.argsort(key, kind="stable")
    ref, item, key = ref[order], item[order], key[order]
    ord_ = ro[ref]
    twice = np.concatenate([[False], (key[1:] == key[:-1]) & (ord_[1:] == ord_[:-1])]) if len(key) else np.zeros(0, bool)
    if twice.any():  # of a pair, a reason of the same kind and detail counts once: the first
        told = np.where(ord_ == PLACE, dh[item], rd[ref])
        by = np.lexsort((np.arange(len(key)), told, ord_, key))
        same = np.concatenate([[False], (key[by][1:] == key[by][:-1]) & (ord_[by][1:] == ord_[by][:-1]) & (told[by][1:] == told[by][:-1])])
        left = np.ones(len(key), bool)
        left[by[same]] = False
        ref, item, key, ord_ = ref[left], item[left], key[left], ord_[left]
    if not len(key):
        return schema.empty_table()
    pair = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(pair, len(key)))
    score = _round(np.minimum(1.0, np.add.reduceat(w[item], pair)))
    source = key[pair] >> 40
    by = np.lexsort((-n, -score, source))  # stable: pairs are in the order of source and target
    by = by[_places(source[by]) < limit]
    of, at = _spread(n[by])
    reason = pair[by][of] + at
    kinds = np.bitwise_or.reduceat(1 << ord_, pair)[by]
    begins = np.flatnonzero(np.concatenate([[True], source[by][1:] != source[by][:-1]]))
    name = rs[np.flatnonzero(np.concatenate([[True], rs[1:] != rs[:-1]]))][source[by][begins]]
    pairs_end = np.append(begins, len(by))
    reasons_end = np.concatenate([[0], np.cumsum(n[by])])[pairs_end]
    each = lambda x, ends, type_: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(type_)))
    return pa.table(
        [
            pa.array(np.full(len(name), block, np.int64)), pa.array(name), each(key[pair][by] & (2**40 - 1), pairs_end, np.int64), each(kinds, pairs_end, np.int8),
            each(ord_[reason] + FIRST * (at == 0), reasons_end, np.int8), each(rk[ref[reason]], reasons_end, np.int32), each(tr[item[reason]] & (2**ROW - 1), reasons_end, np.int32),
        ],
        schema=schema,
    )


def _records(n: dict[str, DataFrame]) -> DataFrame:
    """One row of each asset with what its reasons may name: rows (ord, k) with evidence or what it is made of (e), detail (d)
    and numbers: a place, a confidence."""
    row = lambda df, ord_, e, d, x="NULL", y="NULL": df.select("ti", F.struct(F.lit(ord_).alias("ord"), "k", F.col(e).alias("e"), d.alias("d"), F.expr(f"CAST({x} AS DOUBLE)").alias("x"), F.expr(f"CAST({y} AS DOUBLE)").alias("y")).alias("row"))
    rows = [
        row(n["album_membership"], ALBUM, "album_id", F.to_json(F.struct("album_id", "album_title"))),
        row(n["location_observation"], PLACE, "evidence_id", F.lit(None).cast("string"), "latitude", "longitude"),
        row(n["visual_observation"], SEEN, "evidence_id", F.to_json(F.struct("observation_type", "label")), "confidence"),
    ]
    held = reduce(DataFrame.union, rows).groupBy("ti").agg(F.collect_list("row").alias("rows"))
    return n["asset"].select("ti", "id", "creation_date", "local_identifier", "jd").join(held, "ti", "left")


def pairs(n: dict[str, DataFrame], chosen: DataFrame) -> DataFrame:
    """best() with ids, reasons and evidence: one row per pair.

    Sources go to new blocks in the order of their first targets: those of a block share most of the assets that they name.
    """
    chosen = in_order(chosen.drop("block").withColumn("first", F.col("t")[0]), "first", "s").drop("first")
    chosen = chosen.withColumn("block", F.floor(F.col("_index") / F.lit(BLOCK)).cast("bigint")).drop("_index")
    zipped = chosen.select("block", F.inline(F.arrays_zip("t", F.transform("m", lambda m: m.cast("int")).alias("m"))))
    every = F.aggregate("m", F.lit(SOURCE), lambda a, m: a.bitwiseOR(m.cast("int")))
    named = zipped.union(chosen.select("block", "s", every)).toDF("in", "ti", "m").groupBy("in", "ti").agg(F.bit_or("m").alias("m"))
    of_kinds = lambda *kinds: F.col("m").bitwiseAND(F.lit(sum(1 << o for o in kinds))) > 0
    wanted = F.filter("rows", lambda r: F.getbit("m", r["ord"]) == 1)
    rows = F.transform(wanted, lambda r: F.struct(r["ord"].alias("ord"), r["k"].alias("k"), r["e"].alias("e"), F.when(F.col("m") >= SOURCE, r["d"]).alias("d"), r["x"].alias("x"), r["y"].alias("y")))
    local, day = F.when(of_kinds(BURST, TIME), F.col("local_identifier")), F.when(of_kinds(TIME), F.col("jd"))
    records = named.join(_records(n), "ti").select("in", "ti", "id", "creation_date", local.alias("local_identifier"), day.alias("jd"), rows.alias("rows")).repartition("in")
    of = lambda *parts: stable_id("evidence", F.col("id"), *parts)
    meta = of("asset_metadata", F.concat(F.lit("asset:"), F.col("local_identifier"))).alias("meta")
    album = lambda r: F.when(r["ord"] == ALBUM, of("album_membership", F.concat(F.lit("album:"), r["e"]))).otherwise(r["e"])
    fields = {f: (lambda f: lambda r: album(r) if f == "e" else r[f])(f) for f in ("ord", "k", "e", "d", "x", "y")}
    parts = [F.transform(F.coalesce("rows", F.array()), of_row).alias(f) for f, of_row in fields.items()]
    records = records.select("in", "ti", "id", "creation_date", "jd", meta, *parts)
    made = chosen.groupBy("block").cogroup(records.groupBy("in")).applyInArrow(_put_together, PAIR)

    def reason(r: Column) -> Column:
        pick = lambda texts: F.element_at(F.array(*[F.lit(t) for t in texts]), r["ord"].cast("int"))
        detail = F.when(r["ord"] == BURST, '{"burst_identifier_present":true}').when(r["ord"] == HASH, '{"hash_present":true}')
        detail = detail.when(r["ord"] == TIME, F.to_json(F.struct(F.round(r["x"], 3).alias("seconds_apart"), F.lit(3600).alias("window_seconds"))))
        detail = detail.when(r["ord"] == PLACE, F.to_json(F.struct(*_place_numbers(r["x"], r["y"])))).otherwise(r["d"])
        return F.struct((-r["w"]).alias("w"), pick(TYPES).alias("type"), pick(METHODS).alias("method"), detail.alias("detail"))

    reasons = F.transform(F.array_sort(F.transform("r", reason)), lambda r: F.struct(r["type"].alias("type"), r["method"].alias("method"), (-r["w"]).alias("weight"), r["detail"].alias("detail")))
    evidence = F.array_sort(F.array_distinct(F.filter("e", lambda e: e.isNotNull() & (e != ""))))
    return made.select("source_id", "target_id", "creation_date", "score", "n_reasons", reasons.alias("reasons"), evidence.alias("evidence_ids"), "rank")


def _put_together(chosen: pa.Table, records: pa.Table) -> pa.Table:
    """The pairs of a block by the records of its assets."""
    records = records.sort_by("ti").combine_chunks()
    ti = records["ti"].to_numpy()
    texts = lambda c: pc.list_flatten(records[c]).combine_chunks() if len(records) else pc.list_flatten(records[c])
    holder = np.repeat(np.arange(len(ti)), pc.list_value_length(records["ord"]).to_numpy())
    row_key = (holder << (ROW + 3)) | (_flat(records["k"], np.int64) << 3) | _flat(records["ord"], np.int64)
    order = np.argsort(row_key)
    row_key = row_key[order]
    row_x, row_y = (texts(c).to_numpy(zero_copy_only=False).astype(np.float64)[order] for c in ("x", "y"))
    take = lambda c, at: texts(c).take(pa.array(order)).take(at)
    n_pairs = pc.list_value_length(chosen["t"]).to_numpy().astype(np.int64)
    source, place = _spread(n_pairs)
    s, t = np.searchsorted(ti, chosen["s"].to_numpy())[source], np.searchsorted(ti, _flat(chosen["t"], np.int64))
    ord_, sk, tk = (_flat(chosen[c], np.int64) for c in ("ord", "sk", "tk"))
    pair = np.flatnonzero(ord_ >= FIRST)
    n = np.diff(np.append(pair, len(ord_)))
    of, _ = _spread(n)
    ord_ %= FIRST
    rs, rt = s[of], t[of]
    has_row = np.isin(ord_, (ALBUM, PLACE, SEEN))
    at = lambda holder, k: np.minimum(np.searchsorted(row_key, (holder << (ROW + 3)) | (k << 3) | ord_), max(len(row_key) - 1, 0))
    s_row, t_row = at(rs, sk), at(rt, tk)
    seen = pa.concat_arrays([records["meta"].combine_chunks().cast(pa.string()), texts("e").take(pa.array(order)).cast(pa.string())])
    evidence = np.empty(2 * len(of), np.int64)
    evidence[0::2], evidence[1::2] = np.where(has_row, len(ti) + s_row, rs), np.where(has_row, len(ti) + t_row, rt)
    evidence = seen.take(pa.array(evidence, mask=np.repeat(ord_ == HASH, 2)))
    day = records["jd"].to_numpy(zero_copy_only=False).astype(np.float64)
    x, y = np.zeros(len(of)), np.zeros(len(of))
    timed, placed, labelled = ord_ == TIME, ord_ == PLACE, ord_ == SEEN
    x[timed] = np.abs((day[rs[timed]] - day[rt[timed]]) * 86400.0)
    x[placed], y[placed] = np.abs(row_x[s_row[placed]] - row_x[t_row[placed]]), np.abs(row_y[s_row[placed]] - row_y[t_row[placed]])
    k1 = x + y
    k1[labelled] = -np.fmin(row_x[s_row[labelled]], row_x[t_row[labelled]])
    w = _weights(ord_, k1)
    score = _round(np.minimum(1.0, np.add.reduceat(w, pair))) / 1e9 if len(pair) else np.zeros(0)
    detail = take("d", pa.array(s_row, mask=~has_row)).cast(pa.string())
    reasons = pa.StructArray.from_arrays([pa.array(ord_.astype(np.int8)), pa.array(w), detail, pa.array(x), pa.array(y)], ["ord", "w", "d", "x", "y"])
    ends = np.concatenate([[0], np.cumsum(n)])
    each = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
    return pa.table({
        "source_id": records["id"].take(pa.array(s)), "target_id": records["id"].take(pa.array(t)), "creation_date": records["creation_date"].take(pa.array(t)),
        "score": pa.array(score), "n_reasons": pa.array(n), "rank": pa.array(place + 1), "r": each(reasons, ends), "e": each(evidence, 2 * ends),
    })
