"""The nearest rows in time, block by block of the order of time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import range_join


def nearest_instants(first: DataFrame, most: int, window: float) -> DataFrame:
    """Of each row but those of crowds: the first `most` others within `window` seconds, by seconds, date and id.

    first: rows (tj, creation_date, target_id, te, over; with ti and keep, only targets whose number is in keep are given)
    with their _index in the order of the first three, at most most + 2 of an instant; over: an instant of more than most + 1,
    whose rows are targets only. Such a block has all rows that can count: most + 1 rows on either side of an instant, and the
    rest of the instants they are in.
    """
    dealt = _dealt(first, most)
    of = dict(first.dtypes)
    schema = f"source_id {of['target_id']}, target_id {of['target_id']}, creation_date string, se string, te string, seconds double, pos int"
    used = ["_block", "_own", "tj", "creation_date", "target_id", "te", *(["ti", "keep"] if "keep" in of else [])]
    return dealt.select(*used).groupBy("_block").applyInArrow(_block_pairs(most, window), schema)


def time_weights(seconds: np.ndarray) -> np.ndarray:
    return np.where(seconds <= 60, 0.75, np.where(seconds <= 600, 0.65, 0.45))


def restored(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ascending numbers of lists from their steps."""
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
    return total - np.repeat(before, counts)


def instant_lists(first: DataFrame, most: int, window: float) -> DataFrame:
    """The same as one row of each: s, and the numbers of its nearest ones, ascending, as steps tr, with their weights w.

    first: rows (jd, ti, over) with their _index in the order of the first two.
    """
    dealt = _dealt(first, most).select("_block", "_own", F.col("jd").alias("tj"), "ti")
    return dealt.groupBy("_block").applyInArrow(_block_lists(most, window), "s bigint, tr array<bigint>, w array<double>")


def _dealt(first: DataFrame, most: int) -> DataFrame:
    size, reach = range_join.BLOCK, 3 * (most + 2)
    block = lambda at: F.floor(at / F.lit(size))
    dealt = first.withColumn("_block", F.explode(F.sequence(block(F.col("_index") - reach), block(F.col("_index") + reach))))
    return dealt.withColumn("_own", (F.col("_block") == block(F.col("_index"))) & ~F.col("over"))


def _block_lists(most: int, window: float) -> Callable[[pa.Table], pa.Table]:
    def lists(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tj", "ascending"), ("ti", "ascending")])
        number = t["ti"].to_numpy()
        source, target, apart, counts, _ = _nearest(t["tj"].to_numpy(), number.argsort().argsort(), t["_own"].to_numpy(zero_copy_only=False), most, window)
        found = np.where(counts, number[target], np.iinfo(np.int64).max)
        order = np.argsort(found, axis=1)
        found, apart, counts = (np.take_along_axis(x, order, axis=1) for x in (found, apart, counts))
        steps = np.diff(found, axis=1, prepend=0)[counts]  # neighbors in time follow each other: most steps are alike
        ends = pa.array(np.concatenate([[0], np.cumsum(counts.sum(axis=1))]).astype(np.int32))
        return pa.table({"s": pa.array(number[source]), "tr": pa.ListArray.from_arrays(ends, pa.array(steps)), "w": pa.ListArray.from_arrays(ends, pa.array(time_weights(apart[counts])))})

    return lists


def _nearest(day: np.ndarray, rank: np.ndarray, own: np.ndarray, most: int, window: float) -> tuple[np.ndarray, ...]:
    """Of the own rows of a block in the order of day and rank: the rows, for each the most + 1 nearest ones and how many
    seconds they are away, which of those count, and their places."""
    n = len(day)
    of = np.cumsum(np.concatenate([[False], day[1:] != day[:-1]]))  # the instant of each row
    begin = np.flatnonzero(np.concatenate([[True], day[1:] != day[:-1]]))
    end = np.append(begin[1:], n)
    asked = np.unique(of[own])
    parts = [_of_instants(some, day, rank, of, begin, end, most, window) for some in np.array_split(asked, max(1, len(asked) * (most + 1) // 200_000))]
    best, seconds = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    source = np.flatnonzero(own)
    at = np.searchsorted(asked, of[source])
    target, apart = best[at], seconds[at]
    counts = (apart <= window) & (target != source[:, None])
    pos = np.cumsum(counts, axis=1)
    counts &= pos <= most
    return source, target, apart, counts, pos


def _block_pairs(most: int, window: float) -> Callable[[pa.Table], pa.Table]:
    def pairs(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("tj", "ascending"), ("creation_date", "ascending"), ("target_id", "ascending")])
        day, own = t["tj"].to_numpy(), t["_own"].to_numpy(zero_copy_only=False)
        rank = np.empty(len(day), dtype=np.int64)
        rank[pc.sort_indices(t, sort_keys=[("creation_date", "ascending"), ("target_id", "ascending")]).to_numpy()] = np.arange(len(day))
        source, target, apart, counts, pos = _nearest(day, rank, own, most, window)
        if "keep" in t.column_names:
            numbers, kept = t["ti"].to_numpy(), [k or [] for k in t["keep"].take(pa.array(source)).to_pylist()]
            wanted = np.full((len(source), max(map(len, kept), default=0) or 1), -1, dtype=np.int64)
            for i, k in enumerate(kept):
                wanted[i, : len(k)] = k
            found = np.zeros_like(counts)
            for j in range(wanted.shape[1]):
                found |= numbers[target] == wanted[:, j : j + 1]
            counts &= found
        row, column = np.nonzero(counts)
        s, x = pa.array(source[row]), pa.array(target[row, column])
        return pa.table({
            "source_id": t["target_id"].take(s), "target_id": t["target_id"].take(x), "creation_date": t["creation_date"].take(x), "se": t["te"].take(s), "te": t["te"].take(x),
            "seconds": pa.array(apart[row, column]), "pos": pa.array(pos[row, column].astype(np.int32)),
        })

    return pairs


def _of_instants(asked, day, rank, of, begin, end, most, window):
    """The most + 1 nearest rows of each asked instant, its own included, and how many seconds away they are."""
    width = most + 1
    low = begin[of[np.maximum(begin[asked] - width, 0)]]
    high = end[of[np.minimum(end[asked] - 1 + width, len(day) - 1)]]
    at = low[:, None] + np.arange(max(int((high - low).max()) if len(asked) else 0, width))
    inside = at < high[:, None]
    at = np.minimum(at, len(day) - 1)
    seconds = np.where(inside, np.abs((day[begin[asked]][:, None] - day[at]) * 86400.0), np.inf)
    order = np.lexsort((rank[at], seconds), axis=-1)[:, :width]
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(seconds, order, axis=1)
