"""Per-post statistics: version lineage, age clocks, captures per surface and paired intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import post_id
from ..functions.times import seconds_between
from ..session import cut_lineage
from .intervals import OWNER_COUNTERS, PUBLIC_COUNTERS, latest_capture, paired_counter_intervals, with_event_ratios
from .ordered import HOT_ROWS
from .validation import attribution


def age_clocks(posts: DataFrame) -> DataFrame:
    """Publication clock of every post: its own, its original version's, or the retained one.

    Adds the clock's provenance and flags a retained clock that contradicts the original post.
    """
    own = posts.withColumn("post_id", post_id(F.col("url"))).withColumn(
        "_original_id", post_id(F.col("original_version_url"))
    )
    originals = own.select(
        F.col("post_id").alias("_original_id"),
        F.col("url").alias("_original_url"),
        F.col("published_at").alias("_looked_up"),
    )
    # A self-join on the status id. Posts without an original carry a null key, which never meets
    # a partner and would pile up in one task, so they go around the join.
    linked = own.filter(F.col("_original_id").isNotNull()).join(originals, "_original_id", "left")
    plain = own.filter(F.col("_original_id").isNull())
    rows = linked.unionByName(plain, allowMissingColumns=True)
    direct, retained, looked = F.col("published_at"), F.col("original_published_at"), F.col("_looked_up")
    return rows.select(
        *posts.columns,
        "post_id",
        F.coalesce(direct, looked, retained).alias("age_publication_at"),
        F.when(direct.isNotNull(), "publication")
        .when(looked.isNotNull() | retained.isNotNull(), "original_publication")
        .alias("age_basis"),
        F.when(direct.isNotNull(), F.col("url"))
        .when(looked.isNotNull(), F.col("_original_url"))
        .when(retained.isNotNull(), F.col("url"))
        .alias("age_source_url"),
        F.when(direct.isNotNull() | looked.isNotNull(), "published_at")
        .when(retained.isNotNull(), "original_published_at")
        .alias("age_source_field"),
        F.coalesce(direct.isNull() & (retained != looked), F.lit(False)).alias("conflicting_original_clock"),
    )


def _facts(observations: DataFrame, surface: str) -> list[str]:
    counters = OWNER_COUNTERS if surface == "owner_analytics" else PUBLIC_COUNTERS
    extra = [c for c in ("follows_attributed", "follows_attributed_evidence") if c in observations.columns]
    return ["source", *counters, *extra]


def _instants(observations: DataFrame, surface: str) -> DataFrame:
    """One row per post and instant with the smallest and largest version of its facts.

    A url that names no post belongs to no series; ``foreign_urls`` lists those rows.
    """
    facts = F.struct(*_facts(observations, surface))
    return (
        observations.withColumn("post_id", post_id(F.col("url")))
        .filter(F.col("post_id").isNotNull())
        .groupBy("post_id", "observed_at")
        .agg(F.min("url").alias("url"), F.min(facts).alias("_low"), F.max(facts).alias("_high"))
    )


def foreign_urls(observations: DataFrame) -> DataFrame:
    """Observations whose url names no post."""
    return observations.filter(post_id(F.col("url")).isNull())


def capture_conflicts(observations: DataFrame, surface: str) -> DataFrame:
    """Instants of a post with two different captures; they must be reconciled first."""
    rows = _instants(observations, surface)
    return rows.filter(F.col("_low") != F.col("_high")).select("post_id", "observed_at")


def captures(observations: DataFrame, clocks: DataFrame, surface: str) -> DataFrame:
    """Captures of one surface with the post's age; public and owner clocks are never pooled.

    Identical repeats collapse here, so no zero-length interval can arise; conflicting ones are
    left to ``capture_conflicts``.
    """
    names = _facts(observations, surface)
    extra = names[1 + len(OWNER_COUNTERS) :]
    single = (
        _instants(observations, surface)
        .filter(F.col("_low") == F.col("_high"))
        .select("post_id", "observed_at", "url", *[F.col(f"_low.{c}").alias(c) for c in names])
    )
    ages = clocks.select("post_id", "age_publication_at", "age_basis")
    rows = single.join(ages, "post_id", "left")
    rows = rows.withColumn("surface", F.lit(surface)).withColumn(
        "age_seconds", seconds_between(F.col("age_publication_at"), F.col("observed_at"))
    )
    if surface == "owner_analytics":
        rows = with_event_ratios(rows)
        if extra == ["follows_attributed", "follows_attributed_evidence"]:
            value, reason, _ = attribution(
                F.col("url"), F.col("observed_at"), F.col("follows_attributed"), F.col("follows_attributed_evidence")
            )
            rows = rows.withColumn("follows_attributed_reason", reason).withColumn("follows_attributed", value)
            rows = rows.drop("follows_attributed_evidence")
    return rows


def per_post_latest(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("post_id", "surface", "observed_at")]
    return latest_capture(rows, ["post_id", "surface"], columns)


def surface_intervals(rows: DataFrame, surface: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    counters = OWNER_COUNTERS if surface == "owner_analytics" else PUBLIC_COUNTERS
    # Hot posts are counted before the intervals are taken: two passes, so the captures are written once.
    captured = cut_lineage(rows.select("post_id", "surface", "observed_at", "source", *counters))
    return paired_counter_intervals(captured, ["post_id", "surface"], counters, hot_rows=hot_rows)


def availability(checks: DataFrame, follow_ups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest verified status per url; pending follow-ups of unavailable posts are cancelled."""
    latest = checks.groupBy("url").agg(
        F.max("verified_at").alias("verified_at"), F.max_by("status", F.struct("verified_at", "status")).alias("status")
    )
    planned = follow_ups.join(latest.select("url", F.col("status").alias("post_status")), "url", "left")
    gone = F.col("post_status") == "unavailable_confirmed"
    return latest, planned.withColumn(
        "plan_status", F.when(gone & F.col("result").isNull(), "cancelled").otherwise(F.col("plan_status"))
    )
