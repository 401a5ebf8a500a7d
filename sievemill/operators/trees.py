"""Message trees and ordered carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.session import stored


def roots(messages: DataFrame) -> DataFrame:
    """message_id, root and depth of every message that hangs on a root, by pointer jumping: each round doubles how far a
    message looks up, so a chain of n messages takes log2(n) rounds. Messages under a missing parent or in a ring have no
    root and are left out. Rows delivered twice count once."""
    m = messages.where("message_id IS NOT NULL").select("message_id", "parent_id").distinct()
    done = None
    todo = m.select("message_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(64):
        todo = stored(todo, "tree")
        there = todo.where("up IS NULL").select("message_id", F.col("message_id").alias("root"), "depth") if done is None else None
        if done is None:
            done, todo = there, todo.where("up IS NOT NULL")
        known = done.select(F.col("message_id").alias("up"), "root", F.col("depth").alias("more"))
        far = todo.select(F.col("message_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("step"))
        step = stored(todo.join(known, "up", "left").join(far, "up", "left"), "tree")
        reached = step.where("root IS NOT NULL").select("message_id", "root", (F.col("depth") + F.col("more")).cast("int").alias("depth"))
        left = step.where("root IS NULL AND next IS NOT NULL").select("message_id", F.col("next").alias("up"), (F.col("depth") + F.col("step")).alias("depth"))
        if reached.isEmpty():
            # Nobody arrived: the rest hangs on no root, unless its jumps are still short of one.
            if left.isEmpty() or left.join(done.select(F.col("message_id").alias("up")), "up", "left_semi").isEmpty():
                break
        done, todo = stored(done.unionByName(reached), "tree"), left
    return done


def carry_forward(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, coarse: Column) -> DataFrame:
    """rows with the last value that isn't null among the rows before each, in order within a group.

    `coarse` cuts a group into ranges that follow each other in the same order, such as hours of a time: a range's last value is carried over
    the ranges of its group first, a row for each, then within the range, so that a task sorts a range and never a whole group."""
    r = rows.withColumn("_v", value).withColumn("_range", coarse)
    keys = [F.col(c) for c in by]
    at = F.struct(*order)
    last = r.groupBy(*by, "_range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), at)).alias("_last"))
    over = W.partitionBy(*by).orderBy(F.col("_range").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*by, "_range", F.last("_last", ignorenulls=True).over(over).alias("_carried"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_range")]
    joined = r.alias("a").join(carried.alias("b"), same[0] if len(same) == 1 else _all(same)).select("a.*", "b._carried")
    within = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(within), F.col("_carried"))).drop("_v", "_range", "_carried")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
