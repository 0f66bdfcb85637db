"""Keyed merges without MERGE: full outer join of old and new, and a policy for every column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (old, new) -> value for a row that both sides have.
Policy = Callable[[Column, Column], Column]


def take_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def first_wins(old: Column, new: Column) -> Column:
    """The old value unless it is null or blank."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def merge(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...], policies: dict[str, Policy] | None = None, default: Policy = take_new) -> DataFrame:
    """existing with incoming upserted by keys; rows of one side only stay as they are.

    incoming must have each key once (see last_of_each). One shuffle on the keys.
    """
    policies = policies or {}
    columns = [c for c in existing.columns if c not in keys]
    mark = "_here"
    a = existing.withColumn(mark, F.lit(True)).alias("a")
    b = incoming.select(*existing.columns).withColumn(mark, F.lit(True)).alias("b")
    condition = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, condition, "full_outer")
    only_old, only_new = F.col(f"b.{mark}").isNull(), F.col(f"a.{mark}").isNull()
    out = {k: F.coalesce(f"a.{k}", f"b.{k}") for k in keys}
    for c in columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        out[c] = F.when(only_old, old).when(only_new, new).otherwise(policies.get(c, default)(old, new))
    return joined.select(*[out[c].alias(c) for c in existing.columns])


def last_of_each(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row per key: the last in order, as sequential upserts would leave it."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def replace_scope(existing: DataFrame, incoming: DataFrame, scope: DataFrame, on: list[str]) -> DataFrame:
    """Delete the rows of existing whose columns `on` are in scope, then add incoming: an idempotent replacement."""
    return existing.join(scope.select(*on).distinct(), on, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))
