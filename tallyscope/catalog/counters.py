"""Queries over counter histories, owner analytics and exposure series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import seconds_between
from ..operators import exposure, intervals, progress, sealed, validation
from ..plans import reports
from .registry import R, query, r6, us
from .views import (
    ANALYTICS,
    BASE,
    DAY,
    EXPOSURE,
    IV,
    OBS,
    analytics,
    counter_obs,
    events,
    exposure_collections,
)

KEYS, TIE = ["series"], ["event_id"]


@query(
    "interval_deltas",
    f"""WITH {IV} SELECT series, started_us, ended_us, {R('secs')} AS interval_seconds, net_delta,
    {R('net_delta / nullif(secs, 0)')} AS net_rate_per_second, {R('net_delta / nullif(secs, 0) * 3600')} AS net_rate_per_hour,
    CASE WHEN net_delta < 0 THEN 'counter_revision' ELSE 'observed_counter_change' END AS status,
    CASE WHEN net_delta >= 0 THEN {R('net_delta / nullif(secs, 0)')} END AS observed_rate_per_second FROM iv""",
)
def interval_deltas(spark, folder):
    rows = intervals.counter_intervals(counter_obs(spark, folder), KEYS, "total", tie=TIE)
    return rows.select(
        "series",
        us("started_at").alias("started_us"),
        us("ended_at").alias("ended_us"),
        r6("interval_seconds").alias("interval_seconds"),
        "net_delta",
        r6("net_rate_per_second").alias("net_rate_per_second"),
        r6("net_rate_per_hour").alias("net_rate_per_hour"),
        "status",
        r6("observed_rate_per_second").alias("observed_rate_per_second"),
    )


@query(
    "weighted_rate",
    f"""WITH {OBS}, e AS (SELECT series, min(us) AS a, max(us) AS b, arg_min(total, (us, event_id)) AS va, arg_max(total, (us, event_id)) AS vb
    FROM obs WHERE total IS NOT NULL GROUP BY 1) SELECT series, a AS started_us, b AS ended_us, vb - va AS net_delta,
    {R('(vb - va) / ((b - a) / 1e6)')} AS net_rate_per_second FROM e WHERE b > a""",
)
def weighted_rate(spark, folder):
    rows = intervals.weighted_rate(counter_obs(spark, folder), KEYS, "total", tie=TIE)
    return rows.select(
        "series",
        us("started_at").alias("started_us"),
        us("ended_at").alias("ended_us"),
        "net_delta",
        r6("net_rate_per_second").alias("net_rate_per_second"),
    )


@query(
    "acceleration",
    f"""WITH {IV}, r AS (SELECT *, net_delta / nullif(secs, 0) AS rate FROM iv), p AS (SELECT *, lag(secs) OVER w AS ps, lag(rate) OVER w AS pr
    FROM r WINDOW w AS (PARTITION BY series ORDER BY ended_us)) SELECT series, ended_us, {R('ps + secs')} AS both_intervals_seconds,
    {R('(rate - pr) / nullif((ps + secs) / 2, 0) * 12960000')} AS acceleration_per_hour_squared FROM p WHERE ps IS NOT NULL""",
)
def acceleration(spark, folder):
    rates = intervals.intervals(counter_obs(spark, folder), KEYS, "total", tie=TIE)
    rows = intervals.accelerations(rates, KEYS)
    return rows.select(
        "series",
        us("ended_at").alias("ended_us"),
        r6(F.col("midpoint_interval_seconds") * 2).alias("both_intervals_seconds"),
        r6("acceleration_per_hour_squared").alias("acceleration_per_hour_squared"),
    )


LAST_TWO = f"""{IV}, m AS (SELECT *, secs / 60 AS minutes, net_delta / nullif(secs / 60, 0) AS rate, row_number() OVER (PARTITION BY series ORDER BY ended_us DESC) AS rn FROM iv),
lt AS (SELECT a.series, b.started_us AS ps, b.ended_us AS pe, a.started_us AS ls, a.ended_us AS le, b.rate AS pr, a.rate AS lr, a.minutes AS am, b.minutes AS bm
    FROM m a LEFT JOIN m b ON b.series = a.series AND b.rn = 2 WHERE a.rn = 1)"""


@query(
    "last_two_rates",
    f"""WITH {LAST_TWO} SELECT series, {R('pr')} AS previous_rate, {R('lr')} AS latest_rate,
    CASE WHEN bm IS NULL THEN 'insufficient_intervals' ELSE 'observed_net_rates_only' END AS status, {R('abs(am - bm) / bm')} AS duration_difference,
    abs(am - bm) / bm <= 0.2 AS within_budget, CASE WHEN lr > pr THEN 'increased' WHEN lr < pr THEN 'decreased' WHEN lr = pr THEN 'unchanged' END AS direction FROM lt""",
)
def last_two_rates(spark, folder):
    rows = intervals.last_two_rates(counter_obs(spark, folder), KEYS, "total", tie=TIE)
    return rows.select(
        "series",
        r6("previous_rate_per_minute").alias("previous_rate"),
        r6("latest_rate_per_minute").alias("latest_rate"),
        "status",
        r6("duration_relative_difference").alias("duration_difference"),
        F.col("within_duration_budget").alias("within_budget"),
        F.col("net_rate_direction").alias("direction"),
    )


@query(
    "skipped_observations",
    f"WITH {OBS} SELECT series, 'missing_count' AS skip_reason, count(*) AS n_skipped FROM obs WHERE total IS NULL GROUP BY 1",
)
def skipped_observations(spark, folder):
    return intervals.skip_summary(counter_obs(spark, folder), KEYS, "total")


@query(
    "window_containment",
    f"""WITH {LAST_TWO}, s AS (SELECT series, ps AS started_us, pe AS ended_us FROM lt WHERE ps IS NOT NULL UNION ALL SELECT series, ls, le FROM lt),
    p AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error')
    SELECT s.series, started_us, ended_us, count(p.t) AS points_in_window FROM s LEFT JOIN p ON p.user_id = s.series AND t > started_us AND t <= ended_us GROUP BY 1, 2, 3""",
)
def window_containment(spark, folder):
    obs = counter_obs(spark, folder)
    last = intervals.last_two_rates(obs, KEYS, "total", tie=TIE)
    sides = last.select("series", F.col("latest_started_at").alias("started_at"), F.col("latest_ended_at").alias("ended_at")).unionByName(
        last.filter(F.col("previous_started_at").isNotNull()).select(
            "series", F.col("previous_started_at").alias("started_at"), F.col("previous_ended_at").alias("ended_at")
        )
    )
    points = obs.filter(F.col("total").isNull()).select("series", "observed_at")
    rows = intervals.containment_counts(sides, points, KEYS, "started_at", "ended_at", "observed_at")
    return rows.select("series", us("started_at").alias("started_us"), us("ended_at").alias("ended_us"), "points_in_window")


@query(
    "relative_growth",
    f"""WITH {IV} SELECT series, ended_us, {R('net_delta / (nullif(count_before, 0) * (nullif(secs, 0) / 3600))')} AS relative_growth_per_hour FROM iv""",
)
def relative_growth(spark, folder):
    rows = intervals.relative_growth(intervals.intervals(counter_obs(spark, folder), KEYS, "total", tie=TIE))
    return rows.select("series", us("ended_at").alias("ended_us"), r6("relative_growth_per_hour").alias("relative_growth_per_hour"))


# --- rolling eligibility counters -------------------------------------------------------------

ROLL = """ro AS (SELECT user_id AS series, epoch_us(ts) AS us, CAST(floor(value * 10) AS BIGINT) AS home, event_id % 700 AS fol FROM events)"""


def rolling_obs(spark, folder):
    return events(spark, folder).select(
        F.col("user_id").alias("series"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("metric"),
        "observed_at",
        F.floor(F.col("value") * 10).cast("bigint").alias("verified_home_impressions_90d"),
        (F.col("event_id") % 700).alias("verified_followers"),
        F.lit("eligibility_export").alias("source"),
        F.lit(True).alias("replies_excluded"),
        F.lit(None).cast("bigint").alias("payout_qualified_impressions"),
    )


def rolling_report(spark, folder):
    # Two metrics with targets of their own.
    odd = F.col("id") == 1
    targets = spark.range(2).select(
        F.when(odd, "odd").otherwise("even").alias("metric"),
        F.lit(90).alias("window_days"),
        F.when(odd, 620).otherwise(500).cast("bigint").alias("impression_target"),
        F.when(odd, 410).otherwise(350).cast("bigint").alias("verified_follower_target"),
    )
    return reports.rolling_progress(rolling_obs(spark, folder), targets, KEYS, "eligibility_export")


@query(
    "rolling_net_status",
    f"""WITH {ROLL}, p AS (SELECT *, lag(us) OVER w AS pus, lag(home) OVER w AS ph, lag(fol) OVER w AS pf FROM ro WINDOW w AS (PARTITION BY series ORDER BY us))
    SELECT series, us AS ended_us, home - ph AS home_delta, {R('(home - ph) / nullif((us - pus) / 1e6, 0)')} AS per_second,
    CASE WHEN home < ph THEN 'rolling_net_decline_possible_expiry' WHEN home > ph THEN 'rolling_net_increase' ELSE 'rolling_net_unchanged' END AS status,
    fol - pf AS follower_delta FROM p WHERE pus IS NOT NULL""",
)
def rolling_net_status(spark, folder):
    rows = rolling_report(spark, folder)["intervals"]
    return rows.select(
        "series",
        us("ended_at").alias("ended_us"),
        F.col("rolling_net_impression_delta").alias("home_delta"),
        r6("rolling_net_impressions_per_second").alias("per_second"),
        F.col("impression_change_status").alias("status"),
        F.col("verified_follower_net_delta").alias("follower_delta"),
    )


@query(
    "rolling_progress",
    f"""WITH {ROLL}, l AS (SELECT series, count(*) AS n, arg_max(home, us) AS home, arg_max(fol, us) AS fol,
        CASE WHEN series % 2 = 0 THEN 500 ELSE 620 END AS ht, CASE WHEN series % 2 = 0 THEN 350 ELSE 410 END AS ft FROM ro GROUP BY 1)
    SELECT series, n AS observation_count, greatest(0, ht - home) AS impression_deficit, greatest(0, ft - fol) AS follower_deficit,
    {R('home / ht::DOUBLE')} AS impression_fraction, {R('fol / ft::DOUBLE')} AS follower_fraction, home >= ht AND fol >= ft AS both_met FROM l""",
)
def rolling_progress(spark, folder):
    rows = rolling_report(spark, folder)["latest"]
    return rows.select(
        "series",
        "observation_count",
        "impression_deficit",
        F.col("verified_follower_deficit").alias("follower_deficit"),
        r6("impression_progress_fraction").alias("impression_fraction"),
        r6("verified_follower_progress_fraction").alias("follower_fraction"),
        F.col("both_thresholds_met").alias("both_met"),
    )


# --- owner analytics --------------------------------------------------------------------------


@query(
    "event_ratios",
    f"""WITH {ANALYTICS} SELECT series, us, {R('engagements / nullif(impressions, 0)::DOUBLE')} AS engagement_ratio,
    {R('detail_expands / nullif(impressions, 0)::DOUBLE')} AS detail_ratio,
    CASE WHEN impressions = 0 THEN 'zero_impressions' WHEN detail_expands IS NULL THEN 'unknown_counter' END AS detail_reason,
    {R('profile_visits / nullif(impressions, 0)::DOUBLE * 1000')} AS profile_visits_per_1000 FROM an""",
)
def event_ratios(spark, folder):
    rows = intervals.with_event_ratios(analytics(spark, folder))
    return rows.select(
        "series",
        us("observed_at").alias("us"),
        r6("engagement_events_per_impression").alias("engagement_ratio"),
        r6("detail_expands_per_impression").alias("detail_ratio"),
        F.col("detail_expands_per_impression_reason").alias("detail_reason"),
        r6("profile_visits_per_1000").alias("profile_visits_per_1000"),
    )


PAIRED = f"""{ANALYTICS}, pa AS (SELECT *, lag(us) OVER w AS pus, lag(source) OVER w AS psrc, lag(impressions) OVER w AS pi, lag(engagements) OVER w AS pe,
    lag(detail_expands) OVER w AS pd, lag(profile_visits) OVER w AS pp, lag(link_clicks) OVER w AS pl FROM an WINDOW w AS (PARTITION BY series ORDER BY us)),
pr AS (SELECT *, concat_ws(',', CASE WHEN impressions < pi THEN 'impressions' END, CASE WHEN engagements < pe THEN 'engagements' END,
    CASE WHEN detail_expands < pd THEN 'detail_expands' END, CASE WHEN profile_visits < pp THEN 'profile_visits' END, CASE WHEN link_clicks < pl THEN 'link_clicks' END) AS revised
    FROM pa WHERE pus IS NOT NULL AND psrc = source)"""


@query(
    "paired_intervals",
    f"""WITH {PAIRED} SELECT series, pus AS started_us, us AS ended_us, {R('(us - pus) / 1e6')} AS elapsed_seconds,
    CASE WHEN revised <> '' THEN 'counter_revision' ELSE 'paired' END AS status, revised AS revised_counters,
    CASE WHEN revised = '' THEN impressions - pi END AS delta_impressions, CASE WHEN revised = '' THEN detail_expands - pd END AS delta_detail_expands,
    CASE WHEN revised <> '' THEN 'counter_revision' WHEN detail_expands IS NULL OR pd IS NULL THEN 'unknown_counter' END AS delta_detail_expands_reason,
    CASE WHEN revised = '' THEN {R('(engagements - pe) / nullif(impressions - pi, 0)::DOUBLE * 1000')} END AS engagements_per_1000
    FROM pr""",
)
def paired_intervals(spark, folder):
    rows = intervals.paired_counter_intervals(analytics(spark, folder), KEYS)
    return rows.select(
        "series",
        us("started_at").alias("started_us"),
        us("ended_at").alias("ended_us"),
        r6("elapsed_seconds").alias("elapsed_seconds"),
        "status",
        F.array_join("revised_counters", ",").alias("revised_counters"),
        "delta_impressions",
        "delta_detail_expands",
        "delta_detail_expands_reason",
        r6("engagements_per_1000_impressions").alias("engagements_per_1000"),
    )


@query(
    "latest_capture",
    f"""WITH {ANALYTICS} SELECT series, max(us) AS us, arg_max(impressions, us) AS impressions, arg_max(source, us) AS source FROM an GROUP BY 1""",
)
def latest_capture(spark, folder):
    rows = intervals.latest_capture(analytics(spark, folder), KEYS, ["impressions", "source"])
    return rows.select("series", us("observed_at").alias("us"), "impressions", "source")


@query(
    "last_six_captures",
    f"""WITH {ANALYTICS} SELECT * FROM (SELECT series, us, impressions, row_number() OVER (PARTITION BY series ORDER BY us DESC) AS recency FROM an) WHERE recency <= 6""",
)
def last_six_captures(spark, folder):
    rows = intervals.last_captures(analytics(spark, folder), KEYS, ["impressions"], 6)
    return rows.select("series", us("observed_at").alias("us"), "impressions", "recency")


@query(
    "same_instant_stock",
    """WITH t AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view')
    SELECT t.user_id AS series, epoch_us(t.ts) AS us, b.event_id AS blue_count FROM t LEFT JOIN b ON b.user_id = t.user_id AND b.ts = t.ts""",
)
def same_instant_stock(spark, folder):
    obs = events(spark, folder)
    latest = obs.groupBy("user_id").agg(F.max("observed_at").alias("observed_at"))
    blues = obs.filter(F.col("event_type") == "view").select("user_id", "observed_at", F.col("event_id").alias("blue_count"))
    rows = latest.join(blues, ["user_id", "observed_at"], "left")
    return rows.select(F.col("user_id").alias("series"), us("observed_at").alias("us"), "blue_count")


# --- capture checks ---------------------------------------------------------------------------


@query(
    "capture_conflicts",
    """SELECT user_id AS series, epoch_us(date_trunc('hour', ts)) AS us, count(*) AS n_captures,
    CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate_identical_counter_snapshot' ELSE 'single' END AS capture_status
    FROM events GROUP BY 1, 2""",
)
def capture_conflicts(spark, folder):
    hourly = events(spark, folder).select(
        F.col("user_id").alias("series"),
        F.timestamp_micros(F.floor(F.unix_micros("observed_at") / 3600000000) * 3600000000).alias("observed_at"),
        "event_type",
    )
    rows = validation.capture_conflicts(hourly, KEYS, ["event_type"])
    return rows.select("series", us("observed_at").alias("us"), "n_captures", "capture_status")


@query(
    "clock_disorder",
    """WITH x AS (SELECT user_id AS series, event_id, ts, event_id - 149 * (event_id % 5) AS i FROM events)
    SELECT series, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY i) AS p FROM x) WHERE ts <= p""",
)
def clock_disorder(spark, folder):
    rows = events(spark, folder).select(
        F.col("user_id").alias("series"),
        "event_id",
        "observed_at",
        (F.col("event_id") - F.col("event_id") % 5 * 149).alias("index"),
    )
    return validation.out_of_order(rows, KEYS, "index").select("series", "event_id")


@query(
    "publication_conflicts",
    """SELECT o_custkey AS key FROM orders GROUP BY 1 HAVING min(o_orderdate) <> max(o_orderdate)""",
)
def publication_conflicts(spark, folder):
    from .registry import table

    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("published_at"))
    return validation.publication_conflicts(orders, "key")


# --- exposure ---------------------------------------------------------------------------------


def exposure_points(spark, folder):
    return exposure.load_series(exposure.stack_collections(exposure_collections(spark, folder)))[0]


def exposure_rows(spark, folder):
    """Unrevised points; large series are looked for on the raw captures."""
    stacked = exposure.stack_collections(exposure_collections(spark, folder))
    hot = exposure.hot_series(stacked)
    return exposure.unrevised(exposure.load_series(stacked)[0], hot=hot)


@query(
    "exposure_skipped",
    """WITH r AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'post_observations' ELSE 'analytics_observations' END AS collection FROM events)
    SELECT collection, 'missing_published_at' AS skip_reason, count(*) AS n FROM r WHERE user_id % 10 = 9 GROUP BY 1
    UNION ALL SELECT 'posts', 'missing_observed_at', count(DISTINCT user_id) FROM events WHERE user_id % 10 <> 9""",
)
def exposure_skipped(spark, folder):
    _, skipped, _ = exposure.load_series(exposure.stack_collections(exposure_collections(spark, folder)))
    return skipped.groupBy("collection", "skip_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "series_status",
    f"""WITH {EXPOSURE} SELECT url, source, count(*) AS n_points, count(*) FILTER (value < v1) AS n_revisions,
    CASE WHEN count(*) FILTER (value < v1) > 0 THEN 'counter_revision' WHEN count(*) < 3 THEN 'insufficient_data' ELSE 'usable' END AS status FROM lagged GROUP BY 1, 2""",
)
def series_status(spark, folder):
    return exposure.series_status(exposure_points(spark, folder))


@query(
    "rolling_origin",
    f"""WITH {EXPOSURE} SELECT url, source, model, origin_us, target_us, training_points, actual, {R('prediction')} AS prediction, horizon_bucket,
    is_last AS latest_holdout, {R('signed_error')} AS signed_error, {R('smape')} AS smape_percent FROM preds""",
)
def rolling_origin(spark, folder):
    rows = exposure.rolling_predictions(exposure_rows(spark, folder))
    return rows.select(
        "url",
        "source",
        "model",
        us("origin_at").alias("origin_us"),
        us("target_at").alias("target_us"),
        "training_points",
        "actual",
        r6("prediction").alias("prediction"),
        "horizon_bucket",
        "latest_holdout",
        r6("signed_error").alias("signed_error"),
        r6("smape_percent").alias("smape_percent"),
    )


def backtest(spark, folder):
    return exposure.rolling_predictions(exposure_rows(spark, folder))


@query(
    "backtest_summary",
    f"""WITH {EXPOSURE} SELECT source, model, horizon_bucket, n_predictions, n_posts, {R('mae')} AS mae, {R('rmse')} AS rmse, {R('bias')} AS bias,
    {R('smape')} AS smape_percent, latest_n, {R('latest_mae')} AS latest_mae FROM summ""",
)
def backtest_summary(spark, folder):
    rows = exposure.error_summary(backtest(spark, folder))
    return rows.select(
        "source",
        "model",
        "horizon_bucket",
        "n_predictions",
        "n_posts",
        r6("mae").alias("mae"),
        r6("rmse").alias("rmse"),
        r6("bias_predicted_minus_actual").alias("bias"),
        r6("smape_percent").alias("smape_percent"),
        F.col("latest_n_predictions").alias("latest_n"),
        r6("latest_mae").alias("latest_mae"),
    )


@query(
    "model_error_table",
    f"""WITH {EXPOSURE} SELECT source, horizon_bucket, {R("max(mae) FILTER (model = 'constant')")} AS constant, {R("max(mae) FILTER (model = 'recent_rate')")} AS recent_rate,
    CASE horizon_bucket WHEN '0_to_15_minutes' THEN 0 WHEN '15_to_60_minutes' THEN 1 WHEN '1_to_6_hours' THEN 2 WHEN '6_to_24_hours' THEN 3 ELSE 4 END AS horizon_rank
    FROM summ GROUP BY 1, 2""",
)
def model_error_table(spark, folder):
    rows = exposure.model_table(exposure.error_summary(backtest(spark, folder)), ["constant", "recent_rate"])
    return rows.select("source", "horizon_bucket", r6("constant").alias("constant"), r6("recent_rate").alias("recent_rate"), "horizon_rank")


@query(
    "equal_sample_guard",
    f"""WITH {EXPOSURE} SELECT source, horizon_bucket, count(*) AS n_models, count(DISTINCT (n_predictions, n_posts)) = 1 AS equal_samples FROM summ GROUP BY 1, 2""",
)
def equal_sample_guard(spark, folder):
    return validation.equal_sample_guard(exposure.error_summary(backtest(spark, folder)))


@query(
    "matched_origins",
    f"""WITH {EXPOSURE}, t AS (SELECT url, source, target_us FROM preds WHERE model = 'recent_rate' AND training_points >= 6),
    k AS (SELECT * FROM preds p WHERE EXISTS (SELECT 1 FROM t WHERE t.url = p.url AND t.source = p.source AND t.target_us = p.target_us))
    SELECT source, model, count(*) AS n_predictions, count(DISTINCT url) AS n_posts, {R('avg(abs(signed_error))')} AS mae FROM k GROUP BY 1, 2""",
)
def matched_origins(spark, folder):
    rows = backtest(spark, folder)
    eligible = (F.col("model") == "recent_rate") & (F.col("training_points") >= 6)
    trained = rows.filter(eligible).withColumn("model", F.lit("gated"))
    kept = exposure.matched_origins(rows.unionByName(trained), "gated").filter(F.col("model") != "gated")
    out = exposure.error_summary(kept, ["source", "model"])
    return out.select("source", "model", "n_predictions", "n_posts", r6("mae").alias("mae"))


@query(
    "extrapolation",
    f"""WITH {EXPOSURE} SELECT url, source, us AS origin_us, pub_us + 2592000000000 AS target_us, {R('2592000 - age')} AS horizon_seconds, value::DOUBLE AS constant,
    {R('CASE WHEN age > age1 THEN value + (value - v1) / (age - age1) * (2592000 - age) END')} AS recent_rate FROM good WHERE is_last AND us1 IS NOT NULL AND 2592000 > age""",
)
def extrapolation(spark, folder):
    rows = exposure.extrapolate(exposure_rows(spark, folder), 720.0)
    return rows.select(
        "url",
        "source",
        us("origin_at").alias("origin_us"),
        us("target_at").alias("target_us"),
        r6("forecast_horizon_seconds").alias("horizon_seconds"),
        "constant",
        r6("recent_rate").alias("recent_rate"),
    )


POOL = """pl AS (SELECT 'https://x.com/acct/status/' || (user_id + 1) AS url, 'a' || (user_id % 12) AS author, max(event_id) AS value,
    (user_id % 30) * 3600.0::DOUBLE + 60 AS age FROM events GROUP BY user_id),
ps AS (SELECT *, CASE WHEN age <= 86400 THEN value * (1 - pow(2, -3.0::DOUBLE)) / (1 - pow(2, -greatest(age / 3600, 0.5::DOUBLE) / 8)) END AS score FROM pl)"""


def pool_scores(spark, folder):
    points = events(spark, folder).select(
        F.concat(F.lit("https://x.com/acct/status/"), F.col("user_id") + 1).alias("url"),
        F.lit("public_views").alias("source"),
        "observed_at",
        (F.col("user_id") % 30 * F.lit(3600.0) + 60).alias("age_seconds"),
        F.col("event_id").alias("value"),
    )
    author = F.concat(F.lit("a"), (F.regexp_extract("url", r"(\d+)$", 1).cast("bigint") - 1) % 12)
    return exposure.popular_scores(points).withColumn("author", author)


@query(
    "popular_pool",
    f"""WITH {POOL} SELECT url, author, value, {R('score')} AS score,
    CASE WHEN age <= 86400 THEN 'candidate_pool_score' ELSE 'outside_official_selection_window' END AS status FROM ps""",
)
def popular_pool(spark, folder):
    return pool_scores(spark, folder).select("url", "author", "value", r6("score").alias("score"), "status")


@query(
    "popular_pool_topk",
    f"""WITH {POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, url) AS author_rank FROM ps WHERE score IS NOT NULL)
    SELECT url, author, {R('score')} AS score, author_rank FROM r WHERE author_rank <= 5 ORDER BY r.score DESC, url LIMIT 40""",
)
def popular_pool_topk(spark, folder):
    rows = exposure.popular_pool(pool_scores(spark, folder), "author", 5, 40)
    return rows.select("url", "author", r6("score").alias("score"), "author_rank")


# --- sealed forecasts -------------------------------------------------------------------------

SEALED = f"""fc AS (SELECT user_id, {BASE} + (10 + user_id % 10) * {DAY} AS cut FROM (SELECT DISTINCT user_id FROM events)),
fin AS (SELECT f.user_id, cut, max(epoch_us(ts)) AS origin_us, count(*) AS n_in, arg_max(f.user_id * 1000 + event_id % 500, event_id) AS origin_count
    FROM fc f JOIN events e ON e.user_id = f.user_id AND epoch_us(e.ts) <= cut AND event_type = 'view' GROUP BY 1, 2),
cap AS (SELECT user_id, {BASE} + d * {DAY} + (event_id % 5) * 100000000 AS end_us, (d % 3) * 30000000 AS dur,
    CASE WHEN (user_id + d) % 6 <> 0 THEN user_id * 1000 + d * 40 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END END AS actual
    FROM (SELECT *, (epoch_us(ts) - {BASE}) // {DAY} AS d FROM events)),
capg AS (SELECT user_id, end_us, count(*) AS n, count(DISTINCT (dur, coalesce(actual, -1))) AS k, min(actual) AS actual, max(dur) AS dur FROM cap GROUP BY 1, 2),
bad AS (SELECT DISTINCT user_id FROM capg WHERE k > 1 AND n > 1),
num AS (SELECT c.user_id, end_us, end_us - dur AS start_us, actual FROM capg c WHERE k = 1 AND actual IS NOT NULL),
pick AS (SELECT f.user_id, f.cut + {DAY} AS target, f.origin_count, coalesce(arg_min(struct_pack(e := end_us, s := start_us, a := actual), end_us) FILTER (end_us >= f.cut + {DAY}),
    arg_min(struct_pack(e := end_us, s := start_us, a := actual), end_us)) AS sel FROM fin f LEFT JOIN num USING (user_id) GROUP BY 1, 2, 3),
ev2 AS (SELECT user_id, target, origin_count, sel.a AS actual, sel.e AS e, sel.s AS s, CASE WHEN sel.e IS NULL THEN 'pending' WHEN sel.e < target THEN 'early' WHEN sel.s < target THEN 'early_or_straddling_capture'
    WHEN sel.e > target + 300000000 THEN 'outside_window' WHEN sel.e = target THEN 'exact_target_observation' ELSE 'delayed_proxy' END AS status FROM pick)"""


def sealed_tables(spark, folder):
    e = events(spark, folder)
    cut = (F.col("user_id") % 10 + 10) * DAY + BASE
    at = F.timestamp_micros
    inputs = e.filter((F.col("event_type") == "view") & (F.unix_micros("observed_at") <= cut))
    sizes = inputs.groupBy("user_id").agg(
        F.max("observed_at").alias("origin_at"), F.count(F.lit(1)).alias("n_numeric_points")
    )
    fid = F.concat(F.lit("f-"), F.col("user_id")).alias("forecast_id")
    url = F.concat(F.lit("https://x.com/acct/status/"), F.col("user_id") + 1).alias("post_url")
    identity = [fid, url, F.lit("v1").alias("version"), F.lit("public_views").alias("source"), F.lit("views").alias("metric")]
    forecasts = sizes.select(
        "user_id",
        *identity,
        (F.col("user_id") + 1).cast("string").alias("post_id"),
        F.lit("frozen_before_target").alias("status"),
        at(F.lit(BASE - 3600000000)).alias("published_at"),
        "origin_at",
        at(cut).alias("input_cutoff_at"),
        at(cut + 60000000).alias("generated_at"),
        at(cut + 120000000).alias("frozen_at"),
        at(cut + DAY).alias("target_at"),
        at(cut + DAY).alias("accepted_from"),
        at(cut + DAY + 300000000).alias("accepted_to"),
        F.lit(0).alias("early_tolerance_seconds"),
        F.lit(300).alias("late_tolerance_seconds"),
        "n_numeric_points",
    ).drop("user_id")
    numbered = inputs.select(
        fid,
        F.col("event_id").alias("index"),
        F.lit("public_views").alias("source"),
        "observed_at",
        *[F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "completed_at", "available_at")],
        (F.col("user_id") * 1000 + F.col("event_id") % 500).alias("value"),
    )
    day = F.floor((F.unix_micros("observed_at") - BASE) / DAY)
    end = day * DAY + BASE + F.col("event_id") % 5 * 100000000
    count = F.col("user_id") * 1000 + day * 40 + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    captures = e.select(
        *identity,
        F.when((F.col("user_id") + day) % 6 != 0, count).alias("actual"),
        at(end).alias("observed_at"),
        at(end - day % 3 * 30000000).alias("observation_started_at"),
        at(end).alias("observation_completed_at"),
        F.lit(None).cast("timestamp").alias("available_at"),
    )
    users = e.select("user_id").distinct()
    declarations = users.select(
        fid, (F.col("user_id") % 8 != 0).alias("first_read_declared"), F.lit(None).cast("boolean").alias("history_complete_declared")
    )
    value = F.col("user_id") * 1000 + F.col("event_id") % 500
    last = inputs.groupBy("user_id").agg(F.max_by(value, "event_id").alias("origin_count"))
    predictions = last.select(
        fid,
        F.explode(
            F.array(
                F.struct(F.lit("constant").alias("model"), F.col("origin_count").cast("double").alias("point_prediction")),
                F.struct(F.lit("rate").alias("model"), (F.col("origin_count") + 500).cast("double").alias("point_prediction")),
            )
        ).alias("p"),
    ).select("forecast_id", "p.*")
    return forecasts, numbered, predictions, captures, declarations


@query(
    "sealed_choice",
    f"""WITH {SEALED} SELECT 'f-' || user_id AS forecast_id, status AS evaluation_status, actual, e AS selected_us, {R('(e - target) / 1e6')} AS lateness_seconds,
    status IN ('exact_target_observation', 'delayed_proxy') AS target_window_eligible, actual < origin_count AS apparent_revision FROM ev2""",
)
def sealed_choice(spark, folder):
    forecasts, inputs, _, captures, _ = sealed_tables(spark, folder)
    chosen, _ = sealed.choose_captures(forecasts, captures)
    rows = sealed.evaluate(forecasts, sealed.input_audit(forecasts, inputs), chosen)
    return rows.select(
        "forecast_id",
        "evaluation_status",
        "actual",
        us("selected_at").alias("selected_us"),
        r6("lateness_seconds").alias("lateness_seconds"),
        "target_window_eligible",
        "apparent_revision",
    )


@query(
    "sealed_scores",
    f"""WITH {SEALED}, k AS (SELECT * FROM ev2 WHERE user_id NOT IN (SELECT user_id FROM bad) AND NOT (status IN ('exact_target_observation', 'delayed_proxy') AND user_id % 8 = 0)),
    m AS (SELECT *, 'constant' AS model, origin_count::DOUBLE AS p FROM k UNION ALL SELECT *, 'rate', origin_count + 500.0 FROM k)
    SELECT 'f-' || user_id AS forecast_id, model, p AS point_prediction, {R('abs(p - actual)')} AS absolute_error,
    {R('CASE WHEN abs(p) + abs(actual) = 0 THEN 0 ELSE 200 * abs(p - actual) / (abs(p) + abs(actual)) END')} AS smape_percent FROM m""",
)
def sealed_scores(spark, folder):
    rows = reports.evaluate_forecasts(*sealed_tables(spark, folder))["models"]
    return rows.select(
        "forecast_id", "model", "point_prediction", r6("absolute_error").alias("absolute_error"), r6("smape_percent").alias("smape_percent")
    )


# --- lineage and ages -------------------------------------------------------------------------


@query(
    "post_ages",
    """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_us(o_orderdate) END AS pub,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_orderkey + 1 END AS orig, CASE WHEN o_orderkey % 9 = 0 THEN epoch_us(o_orderdate) END AS kept FROM orders)
    SELECT CAST(p.k + 1 AS VARCHAR) AS post_id, coalesce(p.pub, q.pub, p.kept) AS age_us,
    CASE WHEN p.pub IS NOT NULL THEN 'publication' WHEN coalesce(q.pub, p.kept) IS NOT NULL THEN 'original_publication' END AS age_basis,
    coalesce(p.pub IS NULL AND p.kept <> q.pub, false) AS conflicting_clock FROM p LEFT JOIN p q ON q.k = p.orig""",
)
def post_ages(spark, folder):
    from ..operators.posts import age_clocks
    from .registry import table
    from .views import instant

    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders").withColumn("at", instant("o_orderdate"))
    prefix = F.lit("https://x.com/acct/status/")
    catalog = orders.select(
        F.concat(prefix, k + 1).alias("url"),
        F.when(k % 3 != 0, F.col("at")).alias("published_at"),
        F.when((k % 3 == 0) & (k % 2 == 0), F.concat(prefix, k + 2)).alias("original_version_url"),
        F.when(k % 9 == 0, F.col("at")).alias("original_published_at"),
    )
    rows = age_clocks(catalog)
    return rows.select("post_id", us("age_publication_at").alias("age_us"), "age_basis", F.col("conflicting_original_clock").alias("conflicting_clock"))


@query(
    "asof_baseline",
    f"""WITH {OBS}, u AS (SELECT series, max(us) - 86400000000 AS reported_us FROM obs GROUP BY 1)
    SELECT u.series, reported_us, max(o.us) AS baseline_us, arg_max(total, (o.us, event_id)) AS baseline_total FROM u JOIN obs o ON o.series = u.series AND o.us <= reported_us AND total IS NOT NULL GROUP BY 1, 2""",
)
def asof_baseline(spark, folder):
    obs = counter_obs(spark, folder)
    newest = obs.groupBy("series").agg(F.max("observed_at").alias("m"))
    updates = newest.select(
        F.col("series").alias("account"),
        F.timestamp_micros(F.unix_micros("m") - 86400000000).alias("reported_at"),
        F.col("m").alias("verified_at"),
    )
    followers = obs.filter(F.col("total").isNotNull()).withColumnRenamed("series", "account")
    rows = progress.legacy_baseline(updates, followers)
    return rows.select(
        F.col("account").alias("series"),
        us("reported_at").alias("reported_us"),
        us("baseline_at").alias("baseline_us"),
        F.col("total_followers").alias("baseline_total"),
    )
