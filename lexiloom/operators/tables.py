"""Snapshot forms of insert, upsert and delete: each returns the table's next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import dedupe_first


def insert_absent(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add rows whose key the target lacks; the first new row per key wins, old rows stay."""
    fresh = dedupe_first(new, key, order).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert(
    target: DataFrame, changes: DataFrame, key: Sequence[str], keep_old: Sequence[str] = ()
) -> DataFrame:
    """Update matched rows, insert the others.

    ``changes`` has one row per key.  Columns in ``keep_old`` hold on to a stored non-null
    value; the others take the change, null or not.  Columns that ``changes`` lacks stay.
    """
    t, c = target.alias("t"), changes.withColumn("_changed", F.lit(True)).alias("c")
    joined = t.join(c, [F.col(f"t.{k}") == F.col(f"c.{k}") for k in key], "full_outer")
    out = []
    for name in target.columns:
        old = F.col(f"t.{name}")
        if name not in changes.columns:
            out.append(old.alias(name))
        elif name in keep_old:
            out.append(F.coalesce(old, F.col(f"c.{name}")).alias(name))
        else:
            changed = F.col("c._changed") if name not in key else F.col(f"c.{name}").isNotNull()
            out.append(F.when(changed, F.col(f"c.{name}")).otherwise(old).alias(name))
    return joined.select(*out)


def delete_where(
    target: DataFrame,
    predicate: Column,
    key: str,
    cascade: dict[str, tuple[DataFrame, str]] | None = None,
    set_null: dict[str, tuple[DataFrame, str]] | None = None,
) -> dict[str, DataFrame]:
    """Delete rows and follow the references to them.

    ``cascade`` and ``set_null`` map a child's name to (child, foreign key column).  The result
    holds the target under ``"target"`` and every child under its name.
    """
    gone = target.filter(predicate).select(F.col(key).alias("_gone"))
    result = {"target": target.filter(~F.coalesce(predicate, F.lit(False)))}
    for name, (child, fk) in (cascade or {}).items():
        result[name] = child.join(gone, child[fk] == gone["_gone"], "left_anti")
    for name, (child, fk) in (set_null or {}).items():
        joined = child.join(gone, child[fk] == gone["_gone"], "left")
        result[name] = joined.withColumn(
            fk, F.when(F.col("_gone").isNull(), child[fk])
        ).select(*child.columns)
    return result
