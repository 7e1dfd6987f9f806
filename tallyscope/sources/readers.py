"""Readers for the JSON, JSONL and CSV contracts. Bad records go to a quarantine frame."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.links import post_id
from ..functions.text import canonical_json
from ..functions.times import seconds_instant, strict_instant, zoned_instant
from ..operators.splits import label_blind


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")
    )


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-blank line."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")
    ).filter(F.trim("raw") != "")


def strict_json(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw JSON text into valid and rejected rows.

    The variant parser rejects repeated keys at any depth and non-finite constants, which the
    schema parser silently accepts.
    """
    checked = raw.withColumn("_ok", F.try_parse_json("raw").isNotNull())
    return (
        checked.filter("_ok").drop("_ok"),
        checked.filter("NOT _ok").drop("_ok").withColumn("rule", F.lit("not_strict_json")),
    )


def key_set_ok(raw: Column, allowed: Sequence[str], required: Sequence[str]) -> Column:
    """The object's keys are within the allowed set and include every required one."""
    keys = F.json_object_keys(raw)
    extra = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys))
    return F.coalesce((extra == 0) & (missing == 0), F.lit(False))


def parse(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("doc", F.from_json("raw", schema)).select("file", "doc.*")


def instants(df: DataFrame, columns: Sequence[str], parser=zoned_instant) -> DataFrame:
    """Replace text clocks by instants; a present text that does not parse stays visible as raw."""
    for c in columns:
        if c in df.columns:
            df = df.withColumn(f"{c}_raw", F.col(c)).withColumn(c, parser(F.col(c)))
    return df


CLOCKS = (
    "observed_at",
    "published_at",
    "original_published_at",
    "window_started_at",
    "window_ended_at",
    "classified_at",
    "reported_profile_observation",
    "verified_at",
)


def metrics_documents(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by collection plus ``documents``, rejected files).

    A missing collection is an empty list. Every row keeps its position as ``index``.
    """
    valid, rejected = strict_json(raw_documents(spark, path))
    docs = parse(valid, schemas.METRICS_DOCUMENT)
    tables = {"documents": docs}
    for name in schemas.COLLECTIONS:
        rows = docs.select("account", "launch_post", F.posexplode(name).alias("index", "row"))
        flat = rows.select("account", "launch_post", "index", "row.*")
        tables[name] = instants(flat, CLOCKS, seconds_instant if "post" in name else zoned_instant)
    cohort = docs.filter(F.col("blue_cohort").isNotNull()).select("account", "blue_cohort.*")
    tables["blue_cohort"] = instants(cohort, CLOCKS)
    return tables, rejected


def snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(snapshot, member, post tables, rejected files)."""
    valid, rejected = strict_json(raw_documents(spark, path))
    docs = instants(parse(valid, schemas.SNAPSHOT), ["observed_at", "collection_started_at"])
    docs = docs.withColumn("snapshot_id", F.sha2(F.concat_ws("|", "account", "observed_at_raw", "file"), 256))
    members = docs.select("snapshot_id", F.explode("followers").alias("m")).select(
        "snapshot_id", "m.*", F.coalesce(F.col("m.quality.status"), F.lit("unknown")).alias("quality_status")
    )
    posts = docs.select("snapshot_id", "observed_at", F.explode("posts").alias("url", "m")).select(
        "snapshot_id",
        "observed_at",
        "url",
        post_id(F.col("url")).alias("post_id"),
        zoned_instant(F.col("m.observed_at")).alias("post_observed_at"),
        *[F.col(f"m.{c}").alias(c) for c in ("replies", "likes", "reposts", "bookmarks", "views")],
    )
    return docs, members, posts, rejected


def strict_csv(spark: SparkSession, path: str, schema: str, ordinals: bool = False) -> DataFrame:
    """CSV with a pinned header; a different header or order fails the read."""
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return add_ordinals(rows) if ordinals else rows


def add_ordinals(rows: DataFrame) -> DataFrame:
    """Number rows from 1 in file order without moving them to one partition.

    Ids grow within a file block as it is read, so only the per-block counts are ordered.
    """
    columns = rows.columns
    marked = rows.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = marked.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_low"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file block: about 800,000 rows for a hundred terabytes in 128 MB splits.
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        marked.join(offsets, ["_file", "_block"])
        .withColumn("ordinal", F.col("_offset") + F.col("_id") - F.col("_low") + 1)
        .select(*columns, "ordinal")
    )


def cascade_index(spark: SparkSession, path: str) -> DataFrame:
    return strict_csv(spark, path, schemas.CASCADE_INDEX, ordinals=True).withColumnRenamed("ordinal", "sequence")


def cascade_events(spark: SparkSession, path: str) -> DataFrame:
    """Events in file order; the time stays text for the anomaly counters."""
    return strict_csv(spark, path, schemas.CASCADE_EVENTS, ordinals=True).select("relative_time_second", "ordinal")


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    return strict_csv(spark, path, schemas.FEATURE_ROWS)


def label_blind_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Training rows only; label cells of other rows are never parsed."""
    raw = strict_csv(spark, path, schemas.FEATURE_ROWS_TEXT)
    rows, skipped = label_blind(raw, schemas.FEATURE_LABELS)
    typed = rows.select(
        "cascade_id",
        "post_time_day",
        F.col("cutoff_seconds").try_cast("int").alias("cutoff_seconds"),
        "paper_day_split",
        "strict_label_available_split",
        F.col("observed_retweet_count").try_cast("bigint").alias("observed_retweet_count"),
        *[
            F.col(c).try_cast("double").alias(c)
            for c in ("first_observed_retweet_seconds", "last_observed_retweet_seconds")
        ],
        *schemas.FEATURE_LABELS,
        F.col("label_available_day").try_cast("double").alias("label_available_day"),
    )
    return typed, skipped


def question_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): strict JSON, exactly the three keys, lists on both sides."""
    valid, rejected = strict_json(raw_lines(spark, path))
    keys = ("question", "human_answers", "chatgpt_answers")
    shaped = valid.withColumn("_keys", key_set_ok(F.col("raw"), keys, keys)).withColumn(
        "doc", F.from_json("raw", schemas.QUESTION_ANSWERS)
    )
    good = (
        F.col("_keys")
        & F.col("doc.human_answers").isNotNull()
        & F.col("doc.chatgpt_answers").isNotNull()
        & (F.coalesce(F.trim("doc.question"), F.lit("")) != "")
    )
    rows = shaped.filter(good).select("doc.*")
    bad = shaped.filter(~good).select("file", "raw", F.lit("question_answer_shape").alias("rule"))
    return rows, rejected.unionByName(bad)


def keyed_records(
    spark: SparkSession, path: str, schema: str, allowed: Sequence[str], required: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """JSONL records with an allow-list and a required list of top-level fields."""
    valid, rejected = strict_json(raw_lines(spark, path))
    shaped = valid.withColumn("_keys", key_set_ok(F.col("raw"), allowed, required))
    bad = shaped.filter("NOT _keys").select("file", "raw", F.lit("record_fields").alias("rule"))
    return parse(shaped.filter("_keys"), schema), rejected.unionByName(bad)


def origin_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return keyed_records(
        spark, path, schemas.ORIGIN_RECORD, schemas.ORIGIN_RECORD_KEYS, schemas.ORIGIN_RECORD_REQUIRED
    )


def origin_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return keyed_records(spark, path, schemas.ORIGIN_LABEL, schemas.ORIGIN_LABEL_KEYS, schemas.ORIGIN_LABEL_KEYS)


def sealed_forecasts(spark: SparkSession, path: str, pinned: DataFrame, contract: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(forecasts, inputs, predictions; rejected files).

    ``pinned`` holds the independently kept digest of every file as ``file_sha256``.
    """
    valid, rejected = strict_json(raw_documents(spark, path))
    hashed = valid.withColumn("file_sha256", F.sha2("raw", 256)).join(
        pinned.select(F.lower("file_sha256").alias("file_sha256"), F.lit(True).alias("_pinned")).distinct(),
        "file_sha256",
        "left",
    )
    docs = hashed.withColumn("doc", F.from_json("raw", schemas.SEALED_FORECAST)).withColumn(
        "_snapshot_sha", F.sha2(canonical_json(F.get_json_object("raw", "$.input_snapshot")), 256)
    )
    d = F.col("doc")
    snap = d["input_snapshot"]
    rule = (
        F.when(F.col("_pinned").isNull(), "file_digest_not_pinned")
        .when(~d["contract_version"].eqNullSafe(F.lit(contract)), "unsupported_contract")
        .when(~F.col("_snapshot_sha").eqNullSafe(d["input_snapshot_sha256"]), "input_snapshot_digest")
        .when(
            ~(
                snap["post_url"].eqNullSafe(d["post_url"])
                & snap["source"].eqNullSafe(d["source"])
                & snap["metric"].eqNullSafe(d["metric"])
                & snap["published_at"].eqNullSafe(d["published_at"])
            ),
            "input_snapshot_identity",
        )
        .when(d["outcome"].isNull() | F.exists(F.map_values(d["outcome"]), lambda v: v.isNotNull()), "outcome_not_null")
        .when(d["future_verification"].isNotNull(), "future_verification_not_null")
        .when(F.coalesce(F.size(F.map_keys(d["predictions"])), F.lit(0)) == 0, "predictions_required")
    )
    tagged = docs.withColumn("rule", rule)
    ok = tagged.filter(F.col("rule").isNull())
    bad = tagged.filter(F.col("rule").isNotNull()).select("file", "raw", "rule")
    clocks = ("published_at", "origin_at", "input_cutoff_at", "generated_at", "frozen_at", "target_at")
    policy = d["observation_policy"]
    forecasts = ok.select(
        "file_sha256",
        *[d[c].alias(c) for c in ("forecast_id", "status", "post_url", "post_id", "version", "source", "metric", "n_numeric_points")],
        *[strict_instant(d[c]).alias(c) for c in clocks],
        policy["early_tolerance_seconds"].alias("early_tolerance_seconds"),
        policy["late_tolerance_seconds"].alias("late_tolerance_seconds"),
        strict_instant(policy["accepted_observed_at_start"]).alias("accepted_from"),
        strict_instant(policy["accepted_observed_at_end"]).alias("accepted_to"),
    )
    o = F.col("o")
    inputs = ok.select(
        d["forecast_id"].alias("forecast_id"), d["metric"].alias("metric"),
        F.posexplode(snap["numeric_observations"]).alias("index", "o"),
    ).select(
        "forecast_id",
        "index",
        o["source"].alias("source"),
        strict_instant(o["observed_at"]).alias("observed_at"),
        strict_instant(o["observation_started_at"]).alias("started_at"),
        strict_instant(o["observation_completed_at"]).alias("completed_at"),
        strict_instant(o["available_at"]).alias("available_at"),
        F.when(F.col("metric") == "views", o["views"]).otherwise(o["impressions"]).alias("value"),
    )
    predictions = ok.select(d["forecast_id"].alias("forecast_id"), F.explode(d["predictions"]).alias("model", "p")).select(
        "forecast_id", "model", F.col("p.point_prediction").alias("point_prediction")
    )
    return {"forecasts": forecasts, "inputs": inputs, "predictions": predictions}, rejected.unionByName(bad)


def forecast_actuals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(captures, declarations, rejected files)."""
    valid, rejected = strict_json(raw_documents(spark, path))
    docs = parse(valid, schemas.FORECAST_ACTUAL)
    identity = ["forecast_id", "post_url", "version", "source", "metric"]
    o = F.col("o")
    captures = docs.select(*identity, F.explode("observations").alias("o")).select(
        *identity,
        o["actual"].alias("actual"),
        *[
            strict_instant(o[c]).alias(c)
            for c in ("observed_at", "observation_started_at", "observation_completed_at", "available_at")
        ],
    )
    declarations = docs.select(
        "forecast_id",
        F.col("first_successful_numeric_read_at_or_after_target").alias("first_read_declared"),
        F.col("observation_history_complete_since_target").alias("history_complete_declared"),
    )
    return captures, declarations, rejected


def rolling_counters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(captures with their targets, rejected files)."""
    valid, rejected = strict_json(raw_documents(spark, path))
    docs = parse(valid, schemas.ROLLING_COUNTER)
    rows = docs.select(
        "file",
        "metric",
        "window_days",
        "impression_target",
        "verified_follower_target",
        F.explode("observations").alias("o"),
    ).select("file", "metric", "window_days", "impression_target", "verified_follower_target", "o.*")
    return instants(rows, ["observed_at"], strict_instant), rejected


# Files up to this many bytes are hashed as one value; larger ones are streamed.
WHOLE_FILE = 64 << 20
CHUNK = 4 << 20


def _streamed_digests(frames):
    """Digest of each named file, read in chunks through the store's own reader."""
    from pyarrow import fs

    for frame in frames:
        found = []
        for path in frame["path"]:
            # Spark lists plain paths, Arrow reads addresses.
            local = path.startswith("file:")
            system, name = (fs.LocalFileSystem(), path.removeprefix("file:")) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
            total = hashlib.sha256()
            with system.open_input_stream(name) as source:
                while chunk := source.read(CHUNK):
                    total.update(chunk)
            found.append(total.hexdigest())
        yield frame.assign(sha256=found)


def file_fingerprints(spark: SparkSession, path: str, whole_file: int = WHOLE_FILE) -> DataFrame:
    """Digest and size of every file under a path, whatever its size.

    The listing and small files come from Spark's binary reader, which filters by length before it reads. A
    larger file is one row of the listing and one task streams it: a digest is sequential, so its memory is one
    chunk. Streaming needs a store that Arrow can open by the same address.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= whole_file).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    large = files.filter(F.col("length") > whole_file).select("path", F.col("length").alias("bytes"))
    tasks = spark.sparkContext.defaultParallelism
    streamed = large.repartition(tasks, "path").mapInPandas(_streamed_digests, "path string, bytes bigint, sha256 string")
    return small.unionByName(streamed)


def manifest_diff(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """UNCHANGED, CHANGED or DELETED for every pinned path."""
    found = current.select("path", F.col("sha256").alias("new_sha256"))
    return pinned.select("path", "sha256").join(found, "path", "left").withColumn(
        "status",
        F.when(F.col("new_sha256").isNull(), "DELETED")
        .when(F.col("new_sha256") == F.col("sha256"), "UNCHANGED")
        .otherwise("CHANGED"),
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))
