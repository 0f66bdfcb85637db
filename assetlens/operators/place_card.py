"""The place card: deterministic Markdown of a place result, put together by array folds on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import place as P

RESULT = (
    "struct<address: struct<formatted: string, name: string, thoroughfare: string, sub_thoroughfare: string, sub_locality: string, locality: string, "
    "sub_administrative_area: string, administrative_area: string, country: string, postal_code: string, time_zone: string, areas_of_interest: array<string>>, "
    "area: array<struct<level: string, name: string>>, map_features: array<struct<name: string, kind: string, relation: string, distance_m: double>>, "
    "poi_status: string, poi_candidates: array<struct<name: string, category: string, distance_m: double>>, provider_error: string, radius_meters: double>"
)


def fold(items: Column, kind: str, accept: Callable[[Column, Column], Column]) -> Column:
    """The items, in order, that accept(those taken so far, item)."""
    start = F.array().cast(f"array<{kind}>")
    return F.aggregate(items, start, lambda taken, x: F.when(F.coalesce(accept(taken, x), F.lit(False)), F.concat(taken, F.array(x))).otherwise(taken))


def same_part(a: Column, b: Column) -> Column:
    """Address parts (key, tokens) that say the same: equal, one the start of the other, or the same words."""
    return (a["key"] != "") & (b["key"] != "") & ((a["key"] == b["key"]) | a["key"].startswith(b["key"]) | b["key"].startswith(a["key"]) | (a["tokens"] == b["tokens"]))


def _part(text: Column) -> Column:
    return F.struct(T.trim_white(text).alias("text"), T.key(text).alias("key"), T.token_set(T.key(text)).alias("tokens"))


def dedupe_parts(text: Column) -> Column:
    parts = F.transform(F.split(text, ","), _part)
    kept = fold(parts, "struct<text:string,key:string,tokens:string>", lambda taken, x: (x["text"] != "") & (x["key"] != "") & ~F.exists(taken, lambda y: same_part(y, x)))
    return F.array_join(F.transform(kept, lambda x: x["text"]), ", ")


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def display_address(address: Column) -> Column:
    street = T.join_non_blank(" ", address["sub_thoroughfare"], address["thoroughfare"])
    name = T.non_blank(address["name"])
    own = F.when(~F.coalesce(same_part(_part(_or_blank(name)), _part(_or_blank(street))), F.lit(False)), name)
    parts = T.join_non_blank(", ", own, street, address["sub_locality"], address["locality"], address["administrative_area"], address["country"])
    return dedupe_parts(F.coalesce(T.non_blank(address["formatted"]), parts))


def area_trail(result: Column) -> Column:
    given = F.filter(F.transform(F.coalesce(result["area"], F.array()), lambda a: T.non_blank(a["name"])), lambda n: n.isNotNull())
    own = F.transform(P.area_levels(result["address"]), lambda a: a["name"])
    return F.array_join(F.when(F.size(F.coalesce(result["area"], F.array())) > 0, given).otherwise(own), " > ")


def choose_features(features: Column, no_pois: Column, address_text: Column) -> Column:
    """At most FEATURES map features: by rank and distance, normalised, each name and kind once."""
    kind_of = lambda f: P.map_kind(f["kind"])

    def ranked(f: Column, i: Column) -> Column:
        kind, named = kind_of(f), T.non_blank(f["name"]).isNotNull()
        rank = F.when(named & (kind != "area"), 0).when(kind == "area", 1).when(named, 2).otherwise(3)
        name = F.when(F.lower(T.trim_white(_or_blank(f["name"]))) == "yes", "").otherwise(T.trim_white(_or_blank(f["name"])))
        low = T.contains_any(F.lower(name), P.LOW_VALUE_NAMES)
        drop = low | ((kind == "") & ((name == "") | ~no_pois)) | ((name == "") & ~kind.isin(*P.UNNAMED_KINDS))
        shown = F.when(name == "", kind).otherwise(name)
        left = F.when(name == "", "").otherwise(kind)
        drop = drop | (~no_pois & left.isin(*P.LOW_VALUE_KINDS))
        left = F.when(F.lower(shown) == F.lower(left), "").otherwise(left)
        relation = F.lower(T.trim_white(_or_blank(f["relation"])))
        relation = F.when(relation.isin(*P.RELATIONS), relation).otherwise("")
        needle = T.key(shown)
        inside = (left == "area") & (needle != "") & F.contains(T.key(address_text), needle)
        return F.struct(rank.alias("rank"), F.coalesce(f["distance_m"], F.lit(0.0)).alias("distance_m"), i.alias("i"), shown.alias("name"), left.alias("kind"), relation.alias("relation"), T.key(F.concat(shown, F.lit("|"), left)).alias("key"), (drop | inside).alias("drop"))

    ordered = F.array_sort(F.transform(features, ranked))
    kind = "struct<rank:int,distance_m:double,i:int,name:string,kind:string,relation:string,key:string,drop:boolean>"
    return fold(ordered, kind, lambda taken, x: ~x["drop"] & (x["key"] != "") & (F.size(taken) < P.FEATURES) & ~F.exists(taken, lambda y: y["key"] == x["key"]))


def poi_stem(name: Column, category: Column) -> Column:
    key = T.key(name)
    bare = F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(*P.STATION_WORDS)), " ")
    return F.when(category.isin("public transport", "rail station"), bare).otherwise(key)


def choose_pois(candidates: Column) -> Column:
    """At most POIS candidates, nearest first: each stem once, a cap per category. What a cap turned away doesn't count as seen."""

    def item(c: Column) -> Column:
        category = P.poi_category(c["category"], c["name"])
        return F.struct(
            F.coalesce(c["distance_m"], F.lit(0.0)).alias("distance_m"), _or_blank(c["name"]).alias("name"), category.alias("category"), poi_stem(T.trim_white(_or_blank(c["name"])), category).alias("stem"), P.useful_poi(c["category"], c["name"]).alias("useful")
        )

    cap = F.create_map(*[F.lit(x) for pair in P.CATEGORY_CAPS.items() for x in pair])
    ordered = F.array_sort(F.transform(candidates, item))
    kind = "struct<distance_m:double,name:string,category:string,stem:string,useful:boolean>"

    def accept(taken: Column, x: Column) -> Column:
        of_category = F.size(F.filter(taken, lambda y: y["category"] == x["category"]))
        return x["useful"] & (x["stem"] != "") & (F.size(taken) < P.POIS) & ~F.exists(taken, lambda y: y["stem"] == x["stem"]) & (of_category < F.coalesce(F.try_element_at(cap, x["category"]), F.lit(2)))

    return fold(ordered, kind, accept)


def _line(name: Column, *details: Column) -> Column:
    detail = T.join_non_blank(", ", *details)
    return F.concat(F.lit("- "), name, F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))


def render(result: Column) -> Column:
    """Markdown card of a result struct (RESULT)."""
    address, blank = result["address"], F.lit(None).cast("string")
    full, trail = display_address(address), area_trail(result)
    status = F.coalesce(T.non_blank(result["poi_status"]), P.poi_status(result["provider_error"], F.size(F.coalesce(result["poi_candidates"], F.array()))))
    entry = lambda label, value: F.when(T.non_blank(value).isNotNull(), F.concat(F.lit(f"- {label}: "), T.trim_white(value))).otherwise(blank)
    head = F.when(address.isNull(), "Address: unavailable").otherwise(
        F.concat_ws("\n", F.lit("Address:"), entry("Full", full), entry("Area", trail), entry("Postal code", address["postal_code"]), entry("Time zone", address["time_zone"]))
    )
    areas = F.transform(
        F.filter(F.coalesce(address["areas_of_interest"], F.array().cast("array<string>")), lambda n: T.non_blank(n).isNotNull()),
        lambda n: F.struct(T.trim_white(n).alias("name"), F.lit("area of interest").alias("kind"), F.lit("area").alias("relation"), F.lit(0.0).alias("distance_m")),
    )
    features = F.concat(F.coalesce(result["map_features"], F.array().cast("array<struct<name:string,kind:string,relation:string,distance_m:double>>")), areas)
    chosen = choose_features(features, status == P.NONE, T.join_non_blank(" ", full, trail))
    lines = F.transform(chosen, lambda f: _line(f["name"], f["kind"], f["relation"], P.distance_label(f["distance_m"])))
    context = F.when(F.size(lines) > 0, F.concat(F.lit("Map context:\n"), F.array_join(lines, "\n")))
    pois = choose_pois(F.coalesce(result["poi_candidates"], F.array().cast("array<struct<name:string,category:string,distance_m:double>>")))
    found = F.array_join(F.transform(pois, lambda c: _line(T.trim_white(c["name"]), c["category"], P.distance_label(c["distance_m"]))), "\n")
    none = F.concat(F.lit("- No named nearby POIs within "), F.bround(result["radius_meters"], 0).cast("bigint").cast("string"), F.lit("m"))
    nearby = F.when(status != P.PROVIDER_ERROR, F.concat(F.lit("Nearby POIs:\n"), F.when(status == P.NONE, none).when(F.size(pois) == 0, "- No useful named nearby POIs").otherwise(found)))
    return F.concat_ws("\n\n", F.lit("## Place Context"), head, context, nearby)
