import math

from pyspark.sql import functions as F

from tallyscope.functions import numeric
from tallyscope.operators import documented, intervals, validation
from tallyscope.plans import reports

from .conftest import at, rows


def follower_rows(spark, pairs):
    data = [("a", i, at(t), v) for i, (t, v) in enumerate(pairs)]
    return spark.createDataFrame(data, "account string, index int, observed_at timestamp, total bigint")


def test_rates_acceleration_and_weighted_mean(spark):
    obs = follower_rows(spark, [(t, t * t + 3 * t + 100) for t in (0, 10, 30, 60)])
    out = reports.count_dynamics(obs, "total")
    assert [r.net_rate_per_second for r in out["intervals"].orderBy("ended_at").collect()] == [13, 43, 93]
    assert [r.acceleration_per_second_squared for r in out["accelerations"].orderBy("ended_at").collect()] == [2, 2]
    assert out["weighted_average"].first().net_rate_per_second == 63
    assert out["disorder"].isEmpty()


def test_missing_rows_are_skipped_not_zero(spark):
    obs = follower_rows(spark, [(0, 100), (None, 150), (10, None), (20, 120)])
    out = reports.count_dynamics(obs, "total")
    assert [(r.net_delta, r.interval_seconds) for r in out["intervals"].collect()] == [(20, 20.0)]
    assert sorted(r.skip_reason for r in out["skipped"].collect()) == ["missing_count", "missing_exact_timestamp"]


def test_last_two_rates(spark):
    obs = follower_rows(spark, [(0, 200), (600, 210), (1200, 212)])
    out = reports.diagnose_rates(obs, spark.createDataFrame([("a", at(700)), ("a", at(1200)), ("a", at(600))], "account string, observed_at timestamp"))
    row = out["comparison"].first()
    assert (row.previous_rate_per_minute, row.latest_rate_per_minute, row.net_rate_direction) == (1.0, 0.2, "decreased")
    assert row.within_duration_budget and row.duration_relative_difference == 0
    assert rows(out["captures_in_window"].select("points_in_window"), "points_in_window") == [(1,), (2,)]
    lone = reports.diagnose_rates(follower_rows(spark, [(0, 1), (60, 2)]))["comparison"].first()
    assert lone.status == "insufficient_intervals" and lone.net_rate_direction is None


def test_reversed_clock_is_reported(spark):
    assert validation.out_of_order(follower_rows(spark, [(10, 1), (5, 2), (20, 3)]), ["account"], "index").count() == 1


def analytics(spark, data):
    return spark.createDataFrame(
        [("p", at(t), s, *c) for t, s, c in data],
        "series string, observed_at timestamp, source string, impressions bigint, engagements bigint, detail_expands bigint, profile_visits bigint, link_clicks bigint",
    )


def test_event_ratios_and_paired_interval(spark):
    df = analytics(spark, [(60, "x", (100, 20, 10, 4, 2)), (180, "x", (140, 28, 14, 6, 3))])
    first = intervals.with_event_ratios(df).orderBy("observed_at").first()
    assert [first[n] for n in intervals.EVENT_RATIOS] == [0.2, 0.1, 0.04, 0.02]
    row = intervals.paired_counter_intervals(df, ["series"]).first()
    assert (row.delta_impressions, row.elapsed_seconds, row.engagements_per_1000_impressions, row.profile_visits_per_1000_impressions) == (40, 120.0, 200.0, 50.0)


def test_any_fall_suppresses_the_whole_interval(spark):
    df = analytics(spark, [(0, "x", (100, 20, 10, None, 2)), (60, "x", (150, 19, 12, 5, 3)), (120, "x", (160, 25, 13, 6, 4)), (180, "y", (170, 26, 14, 7, 5))])
    a, b = intervals.paired_counter_intervals(df, ["series"]).orderBy("ended_at").collect()
    assert a.status == "counter_revision" and a.revised_counters == ["engagements"] and a.delta_impressions is None
    assert a.delta_link_clicks_reason == "counter_revision"
    assert b.status == "paired" and b.delta_profile_visits == 1


def test_zero_and_unknown_denominators(spark):
    df = analytics(spark, [(0, "x", (0, 1, None, 2, 3)), (1, "x", (None, 1, 1, 1, 1)), (2, "x", (4, None, 8, 1, 1))])
    got = intervals.with_event_ratios(df).orderBy("observed_at").collect()
    assert [r.engagement_events_per_impression_reason for r in got] == ["zero_impressions", "unknown_impressions", "unknown_counter"]
    assert got[2].detail_expands_per_impression == 2.0


def test_scalars(spark):
    one = spark.range(1)
    low, high = numeric.wilson(F.lit(1), F.lit(2))
    row = one.select(
        low.alias("a"), high.alias("b"), numeric.count_bucket(F.lit(2**40 - 1).cast("bigint")).alias("c"),
        numeric.count_bucket(F.lit(0).cast("bigint")).alias("d"), numeric.popular_score(F.lit(100), F.lit(86400.0)).alias("e"),
        numeric.popular_score(F.lit(100), F.lit(86401.0)).alias("f"), numeric.symmetric_percent(F.lit(20), F.lit(14)).alias("g"),
        numeric.symmetric_percent(F.lit(0), F.lit(0)).alias("h"), numeric.saturation_value(F.lit(5.0), F.lit(10.0), F.lit(60.0), F.lit(60.0)).alias("i"),
        numeric.safe_ratio(F.lit(1), F.lit(0)).alias("j"),
    ).first()
    z = 1.959963984540054
    center, den = (0.5 + z * z / 4) / (1 + z * z / 2), 1 + z * z / 2
    radius = z * math.sqrt(0.125 + z * z / 16) / den
    assert abs(row.a - (center - radius)) < 1e-12 and abs(row.b - (center + radius)) < 1e-12
    assert (row.c, row.d, row.f, row.h, row.j) == (40, 0, None, 0.0, None)
    assert abs(row.e - 100) < 1e-9 and abs(row.g - 1200 / 34) < 1e-12 and abs(row.i - (5 + 10 * (1 - math.exp(-1)))) < 1e-12


def test_task_costs_of_the_written_example(spark):
    data = [("A", "T1", "autonomous", 0.30, True), ("A", "T2", "autonomous", 0.20, False), ("A", "T2", "autonomous", 0.35, True),
            ("A", "T3", "autonomous", 0.40, False), ("A", "T3", "rescue", 0.10, True),
            ("B", "T1", "autonomous", 0.20, True), ("B", "T2", "autonomous", 0.15, False), ("B", "T2", "autonomous", 0.25, False), ("B", "T3", "autonomous", 0.30, True)]
    df = spark.createDataFrame(data, "g string, t string, phase string, cost double, passed boolean")
    a, b = documented.task_costs(df, "g", "t").orderBy("g").collect()
    assert [round(x, 3) for x in (a.total_spend, a.spend_per_autonomous_success, a.spend_per_success)] == [1.35, 0.625, 0.45]
    assert [round(x, 3) for x in (b.total_spend, b.spend_per_autonomous_success, b.spend_per_success)] == [0.9, 0.45, 0.45]
    unknown = documented.task_costs(df.withColumn("cost", F.when(F.col("t") != "T3", F.col("cost"))), "g", "t")
    assert unknown.filter("spend_per_success is not null").isEmpty()


def test_rolling_progress(spark):
    data = [(at(0), 534, 167), (at(3600), 500, 170)]
    obs = spark.createDataFrame(data, "observed_at timestamp, verified_home_impressions_90d bigint, verified_followers bigint").select(
        F.lit("a").alias("account"), "*", F.lit("s").alias("source"), F.lit(True).alias("replies_excluded"), F.lit(None).cast("bigint").alias("payout_qualified_impressions")
    )
    goals = spark.createDataFrame([(90, 500000, 500)], "window_days int, impression_target bigint, verified_follower_target bigint")
    first = reports.rolling_progress(obs.filter("verified_followers = 167"), goals, ["account"], "s")["latest"].first()
    assert (first.impression_deficit, first.verified_follower_deficit, first.status) == (499466, 333, "measured_baseline_only")
    assert abs(first.impression_progress_fraction - 0.001068) < 1e-12
    out = reports.rolling_progress(obs, goals, ["account"], "s")
    assert out["intervals"].first().impression_change_status == "rolling_net_decline_possible_expiry"
    assert reports.rolling_progress(obs, goals, ["account"], "other")["rejected"].count() == 2


def test_post_views_revision_and_duplicates(spark):
    u = "https://x.com/a/status/7"
    data = [(u, 0, at(0), 10), ("https://twitter.com/i/web/status/7", 1, at(60), 25), (u, 2, at(60), 25), (u, 3, at(120), 20), (u, 4, None, 9)]
    df = spark.createDataFrame(data, "url string, index int, observed_at timestamp, views bigint")
    for c in ("replies", "likes", "reposts", "bookmarks"):
        df = df.withColumn(c, F.lit(None).cast("bigint"))
    out = reports.post_views(df)
    assert [(r.net_delta, r.status, r.observed_rate_per_second) for r in out["intervals"].orderBy("ended_at").collect()] == [
        (15, "observed_counter_change", 0.25), (-5, "counter_revision", None)]
    assert out["skipped"].count() == 1 and out["conflicts"].isEmpty()


def test_post_statistics_lists_conflicts_and_ages(spark):
    u = "https://x.com/a/status/7"
    catalog = spark.createDataFrame([(u, at(0), None, None), ("https://x.com/a/status/8", None, u, None)], "url string, published_at timestamp, original_version_url string, original_published_at timestamp")
    cols = "url string, observed_at timestamp, source string, impressions bigint, engagements bigint, detail_expands bigint, profile_visits bigint, link_clicks bigint"
    own = spark.createDataFrame([(u, at(60), "s", 100, 20, 10, 4, 2), (u, at(60), "s", 100, 20, 10, 4, 2), (u, at(180), "s", 140, 28, 14, 6, 3), (u, at(300), "s", 1, 1, 1, 1, 1), (u, at(300), "s", 2, 1, 1, 1, 1)], cols)
    pub = spark.createDataFrame([("https://x.com/a/status/8", at(90), "s", 5, None, None, None, None)], cols.replace("impressions", "views").replace("engagements", "replies").replace("detail_expands", "likes").replace("profile_visits", "reposts").replace("link_clicks", "bookmarks"))
    out = reports.post_statistics(catalog, own, pub)
    assert [r.age_seconds for r in out["owner_analytics_captures"].orderBy("observed_at").collect()] == [60.0, 180.0]
    assert out["owner_analytics_conflicts"].count() == 1 and out["owner_analytics_intervals"].first().delta_impressions == 40
    row = out["public_surface_latest"].first()
    assert (row.age_seconds, row.age_basis) == (90.0, "original_publication")


def test_surface_intervals_stand_on_written_captures(spark):
    from tallyscope.operators import posts

    counters = "impressions bigint, engagements bigint, detail_expands bigint, profile_visits bigint, link_clicks bigint"
    data = [(f"https://x.com/a/status/{p}", at(60 * k), "export", 10 * k, k, None, None, None) for p in (1, 2) for k in range(3)]
    seen = spark.createDataFrame(data, f"url string, observed_at timestamp, source string, {counters}")
    catalog = spark.createDataFrame([(u, at(0), None, None) for u in sorted({d[0] for d in data})], "url string, published_at timestamp, original_version_url string, original_published_at timestamp")
    captured = posts.captures(seen, posts.age_clocks(catalog), "owner_analytics")
    out = posts.surface_intervals(captured, "owner_analytics")
    assert rows(out.select("post_id", "elapsed_seconds", "delta_impressions"), "post_id", "started_at") == [(p, 60.0, 10) for p in "1122"]
    # The hot posts are counted before: neither pass may take the clocks' join again.
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
