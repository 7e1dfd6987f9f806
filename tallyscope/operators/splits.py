"""Temporal and group-disjoint splits, and guards that keep partitions pure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_position
from .validation import require_empty


def paper_split(day: Column) -> Column:
    return F.when(day < 7, "train_candidate").otherwise("evaluation_candidate")


def strict_split(day: Column) -> Column:
    """Training rows whose 24-hour label matures after the split day are purged."""
    return (
        F.when(day + 1 <= 7, "train_candidate")
        .when(day < 7, "purged_label_overlap")
        .otherwise("evaluation_candidate")
    )


def inner_split(day: Column) -> Column:
    return F.when(day + 1 <= 4, "fit").when((day >= 4) & (day < 6), "validation").otherwise("purged")


def outside_coverage(day: Column) -> Column:
    return day.isNull() | F.isnan(day) | ~((day >= 0) & (day < 15))


def label_blind(raw: DataFrame, label_columns: Sequence[str], day: str = "post_time_day") -> tuple[DataFrame, DataFrame]:
    """Admit rows by posting day while labels are still text; only admitted labels are parsed.

    Returns (training rows with parsed labels, per-reason counts of skipped rows).
    """
    dated = raw.withColumn("_day", F.col(day).try_cast("double"))
    admitted = dated.filter(~outside_coverage(F.col("_day")) & (F.col("_day") + 1 <= 7))
    parsed = admitted.select(
        *[
            (F.col(c).try_cast("bigint") if c in label_columns else F.col(c)).alias(c)
            for c in raw.columns
            if c != day
        ],
        F.col("_day").alias(day),
    )
    skipped = (
        dated.select("_day")
        .withColumn(
            "reason",
            F.when(outside_coverage(F.col("_day")), "day_outside_coverage").when(
                F.col("_day") + 1 > 7, "not_training_day"
            ),
        )
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return parsed, skipped


def hash_split(
    groups: DataFrame, group: str, seed: int | str, cuts: Sequence[tuple[str, float]] = (("train", 0.70), ("validation", 0.85), ("test", 1.0))
) -> DataFrame:
    """Assign distinct groups to splits by the order of their seeded digest.

    The global order is cut at floor(n * fraction). Positions come from digest-prefix bins, which
    a digest fills evenly, so nothing is sorted in one partition.
    """
    distinct = groups.select(group).distinct()
    keyed = distinct.withColumn(
        "_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256)
    ).withColumn("_bin", F.substring("_h", 1, 3)).withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_position(keyed, [], "_bin", ["_h"], {"_position": "_one"})
    total = distinct.agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(F.broadcast(total), F.lit(True))
    name = F
    for label, fraction in cuts[:-1]:
        name = name.when(F.col("_position") < F.floor(F.col("_n") * F.lit(fraction)), label)
    return placed.select(group, name.otherwise(cuts[-1][0]).alias("split"))


def straddling_groups(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that occur on two sides of a split; must be empty."""
    return (
        rows.groupBy(group)
        .agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
        .filter(F.col("_a") != F.col("_b"))
        .select(group)
    )


def only(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """Guard: every row must satisfy the condition before it may reach an optimiser."""
    require_empty(rows.filter(~F.coalesce(condition, F.lit(False))), message)
    return rows


def same_members(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side; empty means exact coverage."""
    a, b = left.select(*keys), right.select(*keys)
    return (
        a.join(b, list(keys), "left_anti").withColumn("only_in", F.lit("left"))
        .unionByName(b.join(a, list(keys), "left_anti").withColumn("only_in", F.lit("right")))
    )
