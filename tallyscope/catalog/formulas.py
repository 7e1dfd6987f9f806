"""Queries for the written formulas, post statistics on orders, and the curve fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documented, exposure, validation
from ..operators.posts import availability, captures, surface_intervals
from ..plans import fitting
from ..session import cut_lineage
from .counters import exposure_rows
from .registry import R, query, r6, table, us
from .views import BASE, DAY, IV, counter_obs, events, instant


@query(
    "co_observed_rate",
    f"""WITH {IV}, d AS (SELECT i.series, i.started_us, i.ended_us, i.net_delta, count(e.event_id) AS impressions FROM iv i LEFT JOIN events e ON e.user_id = i.series AND event_type = 'error'
    AND epoch_us(e.ts) > i.started_us AND epoch_us(e.ts) <= i.ended_us GROUP BY 1, 2, 3, 4)
    SELECT series, ended_us, net_delta, impressions, {R('net_delta * 1000 / nullif(impressions, 0)::DOUBLE')} AS net_followers_per_1000 FROM d""",
)
def co_observed_rate(spark, folder):
    from ..operators import intervals

    obs = counter_obs(spark, folder)
    rates = intervals.intervals(obs, ["series"], "total", tie=["event_id"])
    points = obs.filter(F.col("total").isNull()).select("series", "observed_at")
    rows = intervals.containment_counts(rates, points, ["series"], "started_at", "ended_at", "observed_at")
    rate = documented.co_observed_rate(F.col("net_delta"), F.col("points_in_window"))
    return rows.select(
        "series", us("ended_at").alias("ended_us"), "net_delta", F.col("points_in_window").alias("impressions"), r6(rate).alias("net_followers_per_1000")
    )


TASKS = """atp AS (SELECT o_orderpriority AS grp, o_custkey AS task, CASE WHEN o_orderkey % 4 = 0 THEN 'rescue' ELSE 'autonomous' END AS phase, o_totalprice AS cost, o_orderstatus = 'F' AS passed FROM orders),
tk AS (SELECT grp, task, sum(cost) FILTER (phase = 'autonomous') AS ac, sum(cost) AS tc, coalesce(bool_or(passed) FILTER (phase = 'autonomous'), false) AS ap, bool_or(passed) AS anyp FROM atp GROUP BY 1, 2)"""


@query(
    "task_costs",
    f"""WITH {TASKS} SELECT grp AS o_orderpriority, count(*) AS n_tasks, count(*) FILTER (ap) AS n_autonomous, count(*) FILTER (NOT ap AND anyp) AS n_rescued, count(*) FILTER (NOT anyp) AS n_failed,
    round(sum(ac), 2) AS autonomous_spend, round(sum(tc), 2) AS total_spend, round(sum(ac) / count(*) FILTER (ap), 4) AS spend_per_autonomous_success,
    round(sum(tc) / count(*) FILTER (anyp), 4) AS spend_per_success, round(max(tc), 2) AS max_task_cost FROM tk GROUP BY 1""",
)
def task_costs(spark, folder):
    attempts = table(spark, folder, "orders").select(
        "o_orderpriority",
        F.col("o_custkey").alias("task"),
        F.when(F.col("o_orderkey") % 4 == 0, "rescue").otherwise("autonomous").alias("phase"),
        F.col("o_totalprice").alias("cost"),
        (F.col("o_orderstatus") == "F").alias("passed"),
    )
    rows = documented.task_costs(attempts, "o_orderpriority", "task")
    return rows.select(
        "o_orderpriority",
        "n_tasks",
        "n_autonomous",
        "n_rescued",
        "n_failed",
        F.round("autonomous_spend", 2).alias("autonomous_spend"),
        F.round("total_spend", 2).alias("total_spend"),
        F.round("spend_per_autonomous_success", 4).alias("spend_per_autonomous_success"),
        F.round("spend_per_success", 4).alias("spend_per_success"),
        F.round("max_task_cost", 2).alias("max_task_cost"),
    )


@query(
    "pause_rule",
    """WITH r AS (SELECT user_id, event_id, ts, event_type <> 'error' AS completed, CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 2 END AS feedback, event_id % 2 AS visits FROM events),
    z AS (SELECT *, coalesce(completed AND feedback = 0 AND visits = 0, false) AS zero FROM r) SELECT user_id, event_id, zero AND coalesce(lag(zero) OVER (PARTITION BY user_id ORDER BY ts), false) AS pause FROM z""",
)
def pause_rule(spark, folder):
    kind = F.col("event_type")
    rounds = events(spark, folder).select(
        "user_id",
        "event_id",
        "observed_at",
        (kind != "error").alias("completed"),
        F.when(kind != "signup", F.floor("value").cast("bigint") % 2).alias("feedback"),
        (F.col("event_id") % 2).alias("profile_visits"),
    )
    return documented.pause_rule(rounds, ["user_id"], "observed_at").select("user_id", "event_id", "pause")


@query(
    "weighted_score",
    f"""WITH q AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 500 END AS fav, (event_id % 100) / 100.0::DOUBLE AS rep, (event_id % 7) / 1000.0::DOUBLE AS bad, user_id % 2 = 0 AS mutual, event_type = 'click' AS is_reply FROM events),
    s AS (SELECT event_id, coalesce(fav, 0) * 0.5::DOUBLE + rep * CASE WHEN mutual AND NOT is_reply THEN 20 ELSE 5 END + bad * -234 AS q FROM q)
    SELECT event_id, {R('q')} AS raw_score, {R('CASE WHEN q < 0 THEN (q + 371.54::DOUBLE) * 0.001::DOUBLE / 414.78::DOUBLE ELSE q + 0.001::DOUBLE END')} AS offset_score FROM s""",
)
def weighted_score(spark, folder):
    e = events(spark, folder)
    heads = {
        "favorite": F.when(F.col("event_type") != "error", F.col("value") / 500),
        "reply": F.col("event_id") % 100 / F.lit(100.0),
        "report": F.col("event_id") % 7 / F.lit(1000.0),
    }
    reply = documented.reply_weight(F.col("user_id") % 2 == 0, F.col("event_type") == "click", F.lit(False))
    weights = {"favorite": documented.POSITIVE_WEIGHTS["favorite"], "reply": reply, "report": documented.NEGATIVE_WEIGHTS["report"]}
    q = documented.weighted_score(heads, weights)
    positive, negative = sum(documented.POSITIVE_WEIGHTS.values()), -sum(documented.NEGATIVE_WEIGHTS.values())
    rows = e.select("event_id", q.alias("q"))
    return rows.select(
        "event_id", r6("q").alias("raw_score"), r6(documented.offset_score(F.col("q"), positive, negative)).alias("offset_score")
    )


@query(
    "diversity_factor",
    f"""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY epoch_us(ts) // {DAY}, user_id % 20 ORDER BY value DESC, event_id) - 1 AS k, user_id FROM events)
    SELECT event_id, k AS earlier_same_author, {R('pow(0.5::DOUBLE, k) * 0.75::DOUBLE + 0.25::DOUBLE')} AS diversity_factor, CASE user_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END ELSE 1.0::DOUBLE END AS network_factor FROM r""",
)
def diversity_factor(spark, folder):
    candidates = events(spark, folder).select(
        "event_id",
        "user_id",
        F.floor(F.unix_micros("observed_at") / DAY).alias("pool"),
        (F.col("user_id") % 20).alias("author"),
        F.col("value").alias("score"),
    )
    rows = documented.diversity_factor(candidates, "pool", "author", "score", "event_id")
    known = F.when(F.col("user_id") % 3 == 0, F.lit(True)).when(F.col("user_id") % 3 == 1, F.lit(False))
    return rows.select(
        "event_id",
        "earlier_same_author",
        r6("diversity_factor").alias("diversity_factor"),
        documented.network_factor(known, F.col("event_id") % 2 == 0).alias("network_factor"),
    )


@query(
    "exploration_threshold",
    f"""WITH t AS (SELECT event_id, value AS views, user_id AS f, (event_id % 40) * 0.75::DOUBLE AS age FROM events), x AS (SELECT *, f * 0.03::DOUBLE * (1 - pow(2.0::DOUBLE, -least(greatest(age, 0), 24) / 8)) / 0.875::DOUBLE AS thr FROM t)
    SELECT event_id, {R('thr')} AS threshold, CASE WHEN age <= 24 THEN views < thr END AS unexplored FROM x""",
)
def exploration_threshold(spark, folder):
    age = F.col("event_id") % 40 * F.lit(0.75)
    return events(spark, folder).select(
        "event_id",
        r6(documented.exploration_threshold(F.col("user_id"), age)).alias("threshold"),
        documented.is_unexplored(F.col("value"), F.col("user_id"), age, F.lit(False)).alias("unexplored"),
    )


@query(
    "availability",
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) SELECT event_id, CASE WHEN last = 'error' AND event_id % 3 <> 0 THEN 'cancelled' ELSE 'planned' END AS plan_status
    FROM events JOIN l USING (user_id) WHERE event_type = 'view'""",
)
def post_availability(spark, folder):
    e = events(spark, folder)
    checks = e.select(
        F.col("user_id").alias("url"),
        F.col("observed_at").alias("verified_at"),
        F.when(F.col("event_type") == "error", "unavailable_confirmed").otherwise("available_confirmed").alias("status"),
    )
    plans = e.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("url"), "event_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).alias("result"), F.lit("planned").alias("plan_status")
    )
    return availability(checks, plans)[1].select("event_id", "plan_status")


ORDER_CAPTURES = f"""cp AS (SELECT l_orderkey AS k, epoch_us(date_trunc('day', l_shipdate)) AS us, CAST(floor(max(l_extendedprice)) AS BIGINT) AS impressions, CAST(floor(max(l_quantity)) AS BIGINT) AS engagements FROM lineitem GROUP BY 1, 2),
cq AS (SELECT *, lag(us) OVER w AS pus, lag(impressions) OVER w AS pi, lag(engagements) OVER w AS pe FROM cp WINDOW w AS (PARTITION BY k ORDER BY us))"""


def order_captures(spark, folder):
    """Line items of an order as owner captures of one post."""
    items = table(spark, folder, "lineitem").select("l_orderkey", instant("l_shipdate").alias("at"), "l_extendedprice", "l_quantity")
    day = F.timestamp_micros(F.floor(F.unix_micros("at") / DAY) * DAY)
    return (
        items.groupBy("l_orderkey", day.alias("observed_at"))
        .agg(
            F.floor(F.max("l_extendedprice")).cast("bigint").alias("impressions"),
            F.floor(F.max("l_quantity")).cast("bigint").alias("engagements"),
        )
        .select(
            F.concat(F.lit("https://x.com/acct/status/"), F.col("l_orderkey") + 1).alias("url"),
            "observed_at",
            "impressions",
            "engagements",
            *[F.lit(None).cast("bigint").alias(c) for c in ("detail_expands", "profile_visits", "link_clicks")],
            F.lit("export").alias("source"),
        )
    )


@query(
    "post_intervals",
    f"""WITH {ORDER_CAPTURES} SELECT CAST(k + 1 AS VARCHAR) AS post_id, us AS ended_us, {R('(us - pus) / 1e6')} AS elapsed_seconds, CASE WHEN impressions < pi OR engagements < pe THEN 'counter_revision' ELSE 'paired' END AS status,
    CASE WHEN impressions >= pi AND engagements >= pe THEN impressions - pi END AS delta_impressions, CASE WHEN impressions > pi AND engagements >= pe THEN {R('(engagements - pe) / (impressions - pi)::DOUBLE')} END AS engagement_ratio FROM cq WHERE pus IS NOT NULL""",
)
def post_intervals(spark, folder):
    from ..operators.posts import age_clocks

    # Read for the clocks and for the captures.
    rows = cut_lineage(order_captures(spark, folder))
    catalog = rows.groupBy("url").agg(F.min("observed_at").alias("published_at")).select(
        "url", "published_at", F.lit(None).cast("string").alias("original_version_url"), F.lit(None).cast("timestamp").alias("original_published_at")
    )
    captured = captures(rows, age_clocks(catalog), "owner_analytics")
    out = surface_intervals(captured, "owner_analytics")
    return out.select(
        "post_id",
        us("ended_at").alias("ended_us"),
        r6("elapsed_seconds").alias("elapsed_seconds"),
        "status",
        "delta_impressions",
        r6("engagement_events_per_impression").alias("engagement_ratio"),
    )


@query(
    "capture_ages",
    f"""WITH {ORDER_CAPTURES}, p AS (SELECT k, min(us) AS pub FROM cp GROUP BY 1) SELECT CAST(k + 1 AS VARCHAR) AS post_id, us, {R('(us - pub) / 1e6')} AS age_seconds, {R('engagements / nullif(impressions, 0)::DOUBLE')} AS engagement_ratio FROM cp JOIN p USING (k)""",
)
def capture_ages(spark, folder):
    from ..operators.posts import age_clocks

    rows = cut_lineage(order_captures(spark, folder))
    catalog = rows.groupBy("url").agg(F.min("observed_at").alias("published_at")).select(
        "url", "published_at", F.lit(None).cast("string").alias("original_version_url"), F.lit(None).cast("timestamp").alias("original_published_at")
    )
    captured = captures(rows, age_clocks(catalog), "owner_analytics")
    return captured.select(
        "post_id", us("observed_at").alias("us"), r6("age_seconds").alias("age_seconds"), r6("engagement_events_per_impression").alias("engagement_ratio")
    )


@query(
    "attributed_follows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 NOT IN (0, 1, 2) THEN o_orderkey % 50 END AS follows, CASE o_orderkey % 5 WHEN 0 THEN 'not_measured' WHEN 1 THEN 'attribution_evidence_missing' WHEN 2 THEN 'attribution_evidence_invalid' END AS reason FROM orders""",
)
def attributed_follows(spark, folder):
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://x.com/acct/status/"), k + 1)
    at = instant("o_orderdate")
    proof = F.when(
        k % 5 != 1,
        F.struct(
            F.lit("owner_analytics").alias("source"),
            F.lit("follows_attributed").alias("field"),
            F.when(k % 5 == 2, F.lit("https://x.com/acct/status/0")).otherwise(url).alias("url"),
            at.alias("observed_at"),
            F.lit("https://help.x.com/en/metric").alias("official_metric_documentation"),
            F.lit("export row").alias("capture_evidence"),
        ),
    )
    rows = table(spark, folder, "orders").select("o_orderkey", url.alias("url"), at.alias("at"), F.when(k % 5 != 0, k % 50).alias("v"), proof.alias("proof"))
    value, reason, _ = validation.attribution(F.col("url"), F.col("at"), F.col("v"), F.col("proof"))
    return rows.select("o_orderkey", value.alias("follows"), reason.alias("reason"))


@query(
    "following_signal",
    f"""SELECT c_custkey, {R('ln((c_custkey % 97 + 1.0::DOUBLE) / (c_nationkey + 1))')} AS network_signal, CASE WHEN c_nationkey > 0 THEN {R('(c_custkey % 97) / c_nationkey::DOUBLE')} END AS ratio FROM customer""",
)
def following_signal(spark, folder):
    from ..functions.numeric import stock_ratio

    followers, following = F.col("c_custkey") % 97, F.col("c_nationkey").cast("bigint")
    return table(spark, folder, "customer").select(
        "c_custkey",
        r6(documented.network_signal(followers, following)).alias("network_signal"),
        r6(stock_ratio(followers, following)).alias("ratio"),
    )


@query(
    "cohort_partition_faults",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'cohort_partition' ELSE 'confirmed_exceeds_arrivals' END AS rule FROM customer WHERE c_custkey % 4 IN (1, 2)""",
)
def cohort_partition_faults(spark, folder):
    i = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        (i + F.when(i % 4 == 1, 1).otherwise(0)).alias("observed_arrivals"),
        F.floor(i / 2).alias("high"),
        (i - F.floor(i / 2)).alias("not_high"),
        F.lit(0).cast("bigint").alias("unknown"),
        F.when(i % 4 == 2, i + 1).alias("confirmed_new_followers"),
        F.timestamp_micros(F.lit(BASE)).alias("window_started_at"),
        F.timestamp_micros(F.lit(BASE + DAY)).alias("window_ended_at"),
    )
    return validation.split(rows, validation.cohort_rules())[1].select("c_custkey", "rule")


@query("saturation_fit")
def saturation_fit(spark, folder):
    """Matched errors of the curve and the baselines over the origins the curve can score."""
    rows = cut_lineage(exposure_rows(spark, folder))
    fits = cut_lineage(fitting.saturation_fits(rows))
    predictions = exposure.rolling_predictions(rows).unionByName(fitting.curve_predictions(rows, fits))
    matched = exposure.matched_origins(predictions, fitting.CURVE_MODEL)
    return exposure.error_summary(matched)
