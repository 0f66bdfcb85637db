"""The nearest places within a box, also where very many different ones lie close together.

Places are dealt into the cells of a grid as wide as the box; a cell with more than CROWD times as many as are wanted is
split into four, and so on: the leaves of a quadtree. How far a place's nearest ones can be is bounded by its own leaf, by
the smallest cell around it that holds enough, and by the sizes of the leaves about it. Only leaves within that bound are
visited, so a place meets some leaves' worth of others however many lie in the box. Distances are sums of both
differences (as the scores use them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import written

#: A leaf has at most CROWD times as many places as are wanted (so that most hold enough themselves), but those within one
#: cell of the deepest level (about a millimetre) stay together.
CROWD, DEPTH = 8, 20
#: More than the rounding of a coordinate or a cell's edge.
SLACK = 1e-12

LEAF_KEY = ["level", "cx", "cy"]


def finite(lat: str, lon: str) -> Column:
    return (F.abs(F.col(lat)) < 1e6) & (F.abs(F.col(lon)) < 1e6)


def split(places: DataFrame, enough: int, width: float) -> tuple[DataFrame, int]:
    """places (lat, lon, n) with their leaf (level, cx, cy), their cell of the deepest level (ix, iy) and `reach`: the
    nearest `enough` targets are not farther. And the deepest level used: one round for each, of the crowded cells only."""
    finest = width / 2**DEPTH
    rest = places.withColumn("ix", F.floor(F.col("lat") / finest)).withColumn("iy", F.floor(F.col("lon") / finest)).withColumn("reach", F.lit(2 * width))
    leaves: list[DataFrame] = []
    for level in range(DEPTH + 1):
        keyed = rest.withColumn("cx", F.shiftright("ix", DEPTH - level)).withColumn("cy", F.shiftright("iy", DEPTH - level))
        sizes = keyed.groupBy("cx", "cy").agg(F.count("*").alias("_places"), F.sum("n").alias("_targets"))
        reach = F.when(F.col("_targets") >= enough, 2 * width / 2**level).otherwise(F.col("reach"))
        sized = written(keyed.join(sizes, ["cx", "cy"]).withColumn("reach", reach).drop("_targets"), "cells")
        leaf = F.lit(level == DEPTH) | (F.col("_places") <= CROWD * enough)
        leaves.append(sized.where(leaf).drop("_places").withColumn("level", F.lit(level)))
        rest = sized.where(~leaf).drop("_places", "cx", "cy")
        if level == DEPTH or rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, leaves), len(leaves) - 1


def _meet(visits: DataFrame, leaves: DataFrame, box: float) -> DataFrame:
    """Places that visit leaves (slat, slon, reach and a leaf) with the targets there that count."""
    targets = leaves.where("n > 0").select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), "n", *LEAF_KEY)
    dlat, dlon = F.abs(F.col("slat") - F.col("tlat")), F.abs(F.col("slon") - F.col("tlon"))
    met = visits.join(targets, LEAF_KEY).where((dlat <= box) & (dlon <= box) & (dlat + dlon <= F.col("reach") + SLACK))
    return met.select("slat", "slon", "tlat", "tlon", "n", dlat.alias("dlat"), dlon.alias("dlon"), (dlat + dlon).alias("apart"))


def _edge(pairs: DataFrame, enough: int) -> DataFrame:
    """pairs with `_edge`: how far the nearest `enough` targets reach, null where there are fewer."""
    one = W.partitionBy("slat", "slon")
    total = pairs.withColumn("_total", F.sum("n").over(one.orderBy("apart").rangeBetween(W.unboundedPreceding, 0)))
    return total.withColumn("_edge", F.min(F.when(F.col("_total") >= enough, F.col("apart"))).over(one)).drop("_total")


def _reaches(x: Column, cell: Column, side: Column) -> tuple[Column, Column]:
    """How far the nearest and the farthest edge of a cell are."""
    low, high = cell * side - x, (cell + 1) * side - x
    return F.greatest(F.lit(0.0), low, -high), F.greatest(-low, high)


def _visits(sources: DataFrame, leaves: DataFrame, enough: int, box: float, width: float) -> DataFrame:
    """Each source with the leaves that touch what it reaches.

    That lies within the nine cells around it of the level whose cells are as wide as its reach. Leaves are found there
    under the key of a cell above them, and wider leaves under their own key. Leaves that hold enough bound the reach again.
    """
    level = F.greatest(F.lit(0), F.least(F.lit(DEPTH), F.floor(F.log2(F.lit(width) / (F.col("reach") + 2 * SLACK))))).cast("int")
    probe = sources.withColumn("v", level)
    cell = f"named_struct('at', v, 'kx', shiftright(ix, {DEPTH} - v) + i, 'ky', shiftright(iy, {DEPTH} - v) + j, 'wide', false)"
    probe = probe.withColumn("nine", F.expr(f"flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> {cell})))"))
    above = "transform(sequence(0, v - 1), a -> transform(nine, c -> named_struct('at', a, 'kx', shiftright(c.kx, v - a), 'ky', shiftright(c.ky, v - a), 'wide', true)))"
    probe = probe.withColumn("k", F.explode(F.expr(f"if(v > 0, concat(nine, array_distinct(flatten({above}))), nine)")))
    probe = probe.select("slat", "slon", "reach", F.col("k.at").alias("at"), F.col("k.kx").alias("kx"), F.col("k.ky").alias("ky"), F.col("k.wide").alias("wide"))
    keys = leaves.where("n > 0").groupBy(*LEAF_KEY).agg(F.sum("n").alias("held")).withColumn("at", F.explode(F.sequence(F.lit(0), "level")))
    keys = keys.withColumn("kx", F.expr("shiftright(cx, level - at)")).withColumn("ky", F.expr("shiftright(cy, level - at)"))
    side = F.lit(width) / F.pow(F.lit(2.0), F.col("level"))
    (near_x, far_x), (near_y, far_y) = _reaches(F.col("slat"), F.col("cx"), side), _reaches(F.col("slon"), F.col("cy"), side)
    found = probe.join(keys, ["at", "kx", "ky"]).where(~F.col("wide") | (F.col("at") == F.col("level")))
    found = found.where((near_x <= box + SLACK) & (near_y <= box + SLACK)).withColumn("near", near_x + near_y)
    # Only leaves that lie wholly in the box hold targets for sure.
    found = found.withColumn("far", F.when((far_x <= box - SLACK) & (far_y <= box - SLACK), far_x + far_y)).where(F.col("near") <= F.col("reach") + SLACK)
    one = W.partitionBy("slat", "slon")
    held = F.sum(F.when(F.col("far").isNotNull(), F.col("held"))).over(one.orderBy(F.col("far").asc_nulls_last(), *LEAF_KEY).rowsBetween(W.unboundedPreceding, 0))
    bound = F.min(F.when(F.col("held_within") >= enough, F.col("far"))).over(one)
    found = found.withColumn("held_within", held).withColumn("reach", F.least("reach", bound)).where(F.col("near") <= F.col("reach") + SLACK)
    return found.select("slat", "slon", "reach", *LEAF_KEY)


def met(places: DataFrame, enough: int, box: float, width: float) -> DataFrame:
    """The pairs that `nearest` ranks: of each place, all targets that can be among the nearest, and some more."""
    leaves, depth = split(places, enough, width)
    sources = leaves.withColumnsRenamed({"lat": "slat", "lon": "slon"}).drop("n")
    if depth == 0:
        around = F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> named_struct('cx', cx + i, 'cy', cy + j))))")
        visits = sources.withColumn("k", F.explode(around)).select("slat", "slon", "reach", "level", F.col("k.cx").alias("cx"), F.col("k.cy").alias("cy"))
        return _meet(visits, leaves, box)
    own = _meet(sources.where("level > 0").select("slat", "slon", "reach", *LEAF_KEY), leaves, box)
    bound = _edge(own, enough).groupBy("slat", "slon").agg(F.min("_edge").alias("_edge"))
    sources = sources.join(bound, ["slat", "slon"], "left").withColumn("reach", F.least("reach", "_edge")).drop("_edge")
    return _meet(_visits(sources, leaves, enough, box, width), leaves, box)


def nearest(places: DataFrame, enough: int, box: float, width: float) -> DataFrame:
    """places (different lat, lon; n targets there) -> slat, slon, tlat, tlon, dlat, dlon, apart: of each place, the
    nearest places with `enough` targets in all, itself included, those that tie with the last too. width is a little
    more than box; places are finite."""
    ranked = _edge(met(places, enough, box, width), enough)
    return ranked.where(F.col("_edge").isNull() | (F.col("apart") <= F.col("_edge"))).drop("_edge", "n")
