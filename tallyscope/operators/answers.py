"""Question and answer corpora: occurrences, duplicate graph, de-duplication and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_ratio
from ..functions.text import fingerprint, normalise_all
from ..session import cut_lineage
from .components import connected_components
from .splits import hash_split

LABELS = ("human_written", "ai_generated")
SIDES = ("human_answers", "chatgpt_answers")  # labels 0 and 1


def occurrences(qa: DataFrame) -> DataFrame:
    """One row per answer occurrence with the question's group and the answer's fingerprint.

    ``qa`` has question, human_answers and chatgpt_answers. Null and blank answers are kept as
    rows with a reason, so they can be counted before they are dropped.
    """
    # Question and answers of a row are normalised in one step, before they become rows.
    named = qa.withColumn("_all", normalise_all(F.concat(F.array("question"), *[F.coalesce(c, F.array()) for c in SIDES])))
    humans = F.greatest(F.size(SIDES[0]), F.lit(0))
    rows = named.select(F.element_at("_all", 1).alias("question"), humans.alias("_n"), F.posexplode(F.slice("_all", 2, F.size("_all"))).alias("_at", "text"))
    rows = rows.withColumn("label", F.when(F.col("_at") < F.col("_n"), 0).otherwise(1))
    return rows.select(
        F.concat(F.lit("q-"), fingerprint(F.col("question"))).alias("group"),
        "label",
        F.when(F.col("text") != "", fingerprint(F.col("text"))).alias("answer_sha256"),
        F.when(F.col("text") != "", F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), "missing_answer")
        .when(F.col("text") == "", "empty_answer")
        .alias("excluded_reason"),
    )


def occurrence_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", F.coalesce("excluded_reason", F.lit("usable")).alias("state")).agg(
        F.count(F.lit(1)).alias("n_occurrences")
    )


def question_groups(rows: DataFrame) -> DataFrame:
    """Component of every question group, built from all source edges before any exclusion.

    Groups that share an answer are linked to the smallest of them, so an answer of one group, as most are, gives no edge.
    A component is named by its smallest question.
    """
    usable = rows.filter(F.col("answer_sha256").isNotNull() & F.col("group").isNotNull())
    held = cut_lineage(usable.select("group", "answer_sha256").distinct())
    shared = held.groupBy("answer_sha256").agg(F.min("group").alias("lowest"), F.max("group").alias("_highest"))
    shared = shared.filter("lowest <> _highest").select("answer_sha256", "lowest")
    edges = held.join(shared, "answer_sha256").filter(F.col("group") != F.col("lowest")).select("group", "lowest")
    # Written once: the components read their edges for stars and for nodes.
    found = connected_components(cut_lineage(edges), "group", "lowest").withColumnRenamed("node", "group")
    return (
        held.select("group")
        .distinct()
        .join(found, "group", "left")
        .select("group", F.coalesce("component", "group").alias("group_id"))
    )


def answer_status(rows: DataFrame) -> DataFrame:
    """Per distinct answer: occurrences and whether its labels conflict."""
    usable = rows.filter(F.col("answer_sha256").isNotNull())
    text = ["text"] if "text" in rows.columns else []
    return usable.groupBy("answer_sha256").agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.min("label").alias("label"),
        F.max("label").alias("_other"),
        F.min("group").alias("group"),
        *[F.first(c).alias(c) for c in text],
    ).select(
        "answer_sha256",
        "n_occurrences",
        "label",
        "group",
        *text,
        F.when(F.col("label") != F.col("_other"), "conflicting_labels")
        .when(F.col("n_occurrences") > 1, "same_label_duplicates")
        .otherwise("single")
        .alias("status"),
    )


def answer_texts(rows: DataFrame) -> DataFrame:
    """Text of every distinct answer."""
    usable = rows.filter(F.col("answer_sha256").isNotNull())
    return usable.groupBy("answer_sha256").agg(F.first("text").alias("text"))


def retained_answers(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per answer without conflicting labels, with its component."""
    kept = answer_status(rows).filter(F.col("status") != "conflicting_labels")
    return kept.join(groups, "group").drop("group", "status")


def split_answers(retained: DataFrame, seed: int) -> DataFrame:
    """Attach the 70/15/15 group split; groups never straddle."""
    assigned = hash_split(retained, "group_id", seed)
    return retained.join(assigned, "group_id")


def split_summary(rows: DataFrame) -> DataFrame:
    """Answers, groups and class counts of every split, from one row per group first."""
    per_group = rows.groupBy("split", "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n1")
    )
    return per_group.groupBy("split").agg(
        F.sum("n").alias("answers"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(F.col("n") - F.col("n1")).alias("human_written"),
        F.sum("n1").alias("ai_generated"),
        F.max("n").alias("largest_group_answers"),
    )


def occurrence_coverage(rows: DataFrame, retained: DataFrame) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("n_occurrences"))
    kept = retained.agg(F.count(F.lit(1)).alias("n_retained"))
    return total.join(F.broadcast(kept), F.lit(True)).withColumn(
        "coverage", safe_ratio(F.col("n_retained"), F.col("n_occurrences"))
    )
