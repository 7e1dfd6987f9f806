from pyspark.sql import functions as F

from tallyscope.operators import snapshots, validation
from tallyscope.plans import reports

from .conftest import at, rows


def snaps(spark, complete=True, scope="all_followers", started=(None, None)):
    data = [("b", "Acct", at(0), at(started[0]), scope, complete, None, 3), ("f", "acct", at(3600), at(started[1]), scope, complete, None, 4)]
    return spark.createDataFrame(data, "snapshot_id string, account string, observed_at timestamp, collection_started_at timestamp, scope string, complete boolean, quality_rubric string, total_followers bigint")


def people(spark, before, after):
    data = [("b", *m) for m in before] + [("f", *m) for m in after]
    return spark.createDataFrame(data, "snapshot_id string, id string, handle string, badge string, quality_status string")


BEFORE = [("1", "a", "blue", None), ("2", "b", "none", None)]
AFTER = [("2", "b", "blue", None), ("3", "c", "blue", "high"), ("4", "d", "blue", "unknown"), ("5", "e", "gold", None)]


def test_growth_of_the_worked_example(spark):
    out = reports.compare_snapshots(snaps(spark), people(spark, BEFORE, AFTER))
    g = out["growth"].first()
    assert (g.observed_blue_arrivals, g.quality_share, g.quality_lower, g.quality_upper) == (2, 0.5, 0.5, 1.0)
    assert (g.existing_became_blue, g.observed_blue_departures, g.wilson_low, g.quality_share_status) == (1, 1, None, "lower_bound")
    assert g.exact_follower_comparison and g.confirmed_new_blue == 2 and g.blue_membership_net == 2
    assert {r.warning for r in out["warnings"].collect()} == {"collection_start_missing", "quality_classification_incomplete"}


def test_partial_and_overlapping_lists_are_not_exact(spark):
    partial = reports.compare_snapshots(snaps(spark, complete=False), people(spark, BEFORE, AFTER))["growth"].first()
    assert partial.confirmed_new_blue is None and partial.observed_blue_arrivals == 2
    overlap = reports.compare_snapshots(snaps(spark, started=(-10, -5)), people(spark, BEFORE, AFTER))
    assert not overlap["growth"].first().coverage_complete
    assert "collection_windows_overlap" in {r.warning for r in overlap["warnings"].collect()}


def test_settled_quality_has_interval_and_full_share(spark):
    after = [("2", "b", "none", None), ("3", "c", "blue", "high"), ("4", "d", "blue", "not_high")]
    g = reports.compare_snapshots(snaps(spark, started=(-10, 10)), people(spark, BEFORE, after))["growth"].first()
    assert g.full_window_quality_share == 0.5 and 0 < g.wilson_low < 0.5 < g.wilson_high < 1


def test_mixed_identity_modes_are_refused(spark):
    out = reports.compare_snapshots(snaps(spark), people(spark, BEFORE, [(None, "b", "blue", None)]))
    assert out["growth"].isEmpty() and out["refused"].first().reason == "mixed_identity_modes"


def test_post_feedback_reasons(spark):
    cols = "snapshot_id string, url string, post_id string, post_observed_at timestamp, replies bigint, likes bigint, reposts bigint, bookmarks bigint, views bigint"
    data = [("b", "https://x.com/acct/status/9", "9", None, 5, 7, None, 1, 10), ("f", "https://twitter.com/acct/status/9", "9", None, 6, 3, 2, 1, 20)]
    pairs = snapshots.consecutive_pairs(snaps(spark))
    row = snapshots.post_feedback(pairs, spark.createDataFrame(data, cols)).first()
    assert (row.replies_delta, row.likes_delta, row.reposts_delta, row.bookmarks_delta, row.views_delta) == (1, None, None, 0, 10)
    assert row.likes_reason.startswith("counter decreased") and row.reposts_reason == "unavailable or missing baseline"


def test_contract_rules(spark):
    members = spark.createDataFrame(
        [("s", "1", "ok", "blue", ("high", True, True, True, ["https://x.com/a"])), ("s", "01", "x", "blue", None), ("s", "3", "bad-handle", "none", None),
         ("s", "4", "h", "blue", ("high", True, False, True, ["https://x.com/a"])), ("s", "5", "i", "blue", ("high", True, True, True, ["https://evil"])), ("s", "6", "OK", "red", None)],
        "snapshot_id string, id string, handle string, badge string, quality struct<status:string,relevant:boolean,original:boolean,substantive:boolean,evidence:array<string>>",
    )
    _, bad = validation.split(members, validation.member_rules())
    assert rows(bad.select("id", "rule"), "id") == [
        ("01", "invalid_id"), ("3", "invalid_handle"), ("4", "high_without_three_criteria"), ("5", "high_without_public_evidence"), ("6", "badge_not_allowed")]
    assert [r.rule for r in validation.repeated_members(members).collect()] == ["duplicate_handle"]
    docs = spark.createDataFrame(
        [("a", at(0), None, "all_followers", True, "proof", 2, ["x"]), ("a", at(0), at(5), "all_followers", False, None, None, ["x"]), ("a", at(0), None, "other", True, "p", 1, ["x"])],
        "account string, observed_at timestamp, collection_started_at timestamp, scope string, complete boolean, evidence string, total_followers bigint, followers array<string>",
    )
    _, bad = validation.split(docs, validation.snapshot_rules())
    assert sorted(r.rule for r in bad.collect()) == ["collection_starts_after_observation", "complete_total_mismatch", "scope_not_allowed"]


def test_retention_needs_a_complete_later_list(spark):
    cohort = spark.createDataFrame([("a", "1", at(0)), ("a", "2", at(0)), ("z", "1", at(0))], "account string, id string, cohort_at timestamp")
    lists = spark.createDataFrame(
        [("a", "p", at(86400), False, "all_followers"), ("a", "q", at(90000), True, "all_followers"), ("a", "r", at(99999), True, "all_followers")],
        "account string, snapshot_id string, observed_at timestamp, complete boolean, scope string",
    )
    m = spark.createDataFrame([("q", "1"), ("q", "9"), ("r", "1"), ("r", "2")], "snapshot_id string, id string")
    a, z = snapshots.retention(cohort, lists, m, 24).orderBy("account").collect()
    assert (a.n_initial, a.n_retained, a.retention) == (2, 1, 0.5) and z.reason == "no_complete_later_list"


def test_headline_percentages(spark):
    cohort = spark.createDataFrame([("a", 5, 2, 1, 2)], "account string, observed_arrivals bigint, high bigint, not_high bigint, unknown bigint").select(
        "*", F.lit(None).cast("bigint").alias("confirmed_new_followers"), F.lit(at(0)).alias("window_started_at"), F.lit(None).cast("timestamp").alias("window_ended_at"),
        F.lit(False).alias("complete"), F.lit("all_followers").alias("scope"), F.lit(7).alias("captured_list_count"), F.lit(None).cast("bigint").alias("end_profile_total"))
    f = spark.createDataFrame([("a", 0, at(0), 10), ("a", 1, at(9), 14)], "account string, index int, observed_at timestamp, total bigint")
    b = spark.createDataFrame([("a", at(3), 1)], "account string, observed_at timestamp, count bigint")
    got = {r.metric: r.value for r in reports.metric_rows({"follower_observations": f, "blue_cohort": cohort, "blue_observations": b}).collect()}
    assert got["total_followers"] == "10 -> 14 (+4)" and got["quality_bounds"] == "40.0%-80.0%" and got["list_coverage"] == "7/unknown"
