"""Ordered operations per group that stay parallel when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null, with one copy of them."""
    marked = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(marked, same, how).drop(*[f"_right_{k}" for k in keys])


def top_k(df: DataFrame, part: Sequence[str | Column], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group.

    The rank filter is planned as a WindowGroupLimit: every map task keeps at most ``k`` rows
    of a group before the shuffle, so a hot group sends few rows.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def dedupe_first(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order."""
    return top_k(df, key, order, 1)


def split_rank(
    df: DataFrame, part: Sequence[str], levels: Sequence[Sequence[Column]], order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """1-based rank of every row in its group, with the group split over many tasks.

    ``levels`` are lists of ascending sort expressions, each a finer form of ``order`` than the
    one before: rows of an earlier bucket must sort before rows of a later one.  A row's rank is
    its rank in the finest bucket plus the sizes of the earlier buckets of every level, so a
    window holds the rows of one bucket or the bucket sizes of one coarser bucket.
    """
    names, keyed = [], df
    for i, level in enumerate(levels):
        names.append([f"_b{i}_{j}" for j in range(len(level))])
        keyed = keyed.withColumns(dict(zip(names[-1], level)))
    finest = [*part, *(n for level in names for n in level)]
    sizes = offsets = keyed.groupBy(*finest).agg(F.count(F.lit(1)).alias("_n"))
    total, outer = F.lit(0), list(part)
    for i, level in enumerate(names):
        inner = [*outer, *level]
        bucket = sizes if inner == finest else sizes.groupBy(*inner).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*outer).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        earlier = bucket.select(*inner, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_o{i}"))
        offsets = join_same(offsets, earlier, inner)
        total, outer = total + F.col(f"_o{i}"), inner
    local = Window.partitionBy(*finest).orderBy(*order)
    return (
        join_same(keyed, offsets.select(*finest, total.alias("_offset")), finest)
        .withColumn(out, F.row_number().over(local) + F.col("_offset"))
        .drop("_offset", *finest[len(part):])
    )


def fill_forward(
    df: DataFrame, part: Sequence[str], order: str, value: str, out: str, span: int = 4096, ties: Sequence[str] = ()
) -> DataFrame:
    """Last non-null ``value`` up to and including each row, ordered by the integer ``order``.

    Rows of one order number follow each other by ``ties``.  Null parts are a group and null
    order numbers come first, like any other value.

    The group is cut into runs of ``span`` order numbers.  Each run's last value is found by a
    plain aggregate, carried over the (few) runs, and completed inside the run.
    """
    keyed = df.withColumn("_run", F.floor(F.col(order) / span))
    last_of_run = (
        keyed.filter(F.col(value).isNotNull())
        .groupBy(*part, "_run")
        .agg(F.max(F.struct(order, *ties, value)).alias("_last"))
    )
    runs = join_same(keyed.select(*part, "_run").distinct(), last_of_run, [*part, "_run"], "left")
    earlier = Window.partitionBy(*part).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(*part, "_run", F.last(f"_last.{value}", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*part, "_run").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_same(keyed, carried, [*part, "_run"])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_run", "_carry")
    )
