"""Queries over follower snapshots and update planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import progress, snapshots
from ..plans import reports
from .registry import R, query, r6, us
from .views import BASE, DAY, SIX_HOURS, SNAP, events, members, snapshot_posts, snapshot_table

IDS = ["account", "before_snapshot_id", "after_snapshot_id"]


def report(spark, folder):
    people = members(spark, folder)
    return reports.compare_snapshots(snapshot_table(people), people)


@query(
    "snapshot_diff",
    f"""WITH {SNAP} SELECT account, b AS before_snapshot_id, a AS after_snapshot_id, identity, ob AS badge_before, nb AS badge_after, nq AS quality_after, change FROM cc""",
)
def snapshot_diff(spark, folder):
    return report(spark, folder)["changes"]


@query(
    "key_coverage",
    f"""WITH {SNAP} SELECT account, b AS before_snapshot_id, a AS after_snapshot_id, count(*) AS n_union, count(*) FILTER (ob IS NOT NULL AND nb IS NOT NULL) AS n_both,
    count(*) FILTER (ob IS NULL) AS n_only_after, count(*) FILTER (nb IS NULL) AS n_only_before FROM cc GROUP BY 1, 2, 3""",
)
def key_coverage(spark, folder):
    return snapshots.key_coverage(report(spark, folder)["changes"])


QUALITY = f"""{SNAP}, g AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(unk, 0) AS unk, coalesce(dep, 0) AS dep, coalesce(up, 0) AS up, coalesce(down, 0) AS down,
    coalesce(unres, 0) AS unres, coalesce(oblue, 0) AS oblue, coalesce(nblue, 0) AS nblue, coalesce(ubadge, 0) AS ubadge,
    coalesce(a_start, a_us) < b_us AS overlap FROM pairs p LEFT JOIN (SELECT account, b, a, count(*) FILTER (change = 'arrival') AS n,
      count(*) FILTER (change = 'arrival' AND nq = 'high') AS high, count(*) FILTER (change = 'arrival' AND nq = 'unknown') AS unk,
      count(*) FILTER (change = 'departure') AS dep, count(*) FILTER (change = 'upgrade') AS up, count(*) FILTER (change = 'downgrade') AS down,
      count(*) FILTER (change = 'unresolved') AS unres, count(*) FILTER (ob = 'blue') AS oblue, count(*) FILTER (nb = 'blue') AS nblue,
      count(*) FILTER (ob = 'unknown' OR nb = 'unknown') AS ubadge FROM cc GROUP BY 1, 2, 3) c USING (account, b, a)),
q AS (SELECT *, b_complete AND a_complete AND NOT overlap AS covered, b_complete AND a_complete AND NOT overlap AND scope = 'all_followers' AND account <> 'acct_5' AS exact FROM g),
w AS (SELECT *, high / nullif(n, 0)::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM q)"""


@query(
    "arrival_quality",
    f"""WITH {QUALITY} SELECT account, b AS before_snapshot_id, a AS after_snapshot_id, exact AS exact_follower_comparison, n AS observed_blue_arrivals,
    CASE WHEN exact THEN n END AS confirmed_new_blue, dep AS observed_blue_departures, up AS existing_became_blue, down AS existing_no_longer_blue, unres AS unresolved,
    CASE WHEN exact AND ubadge = 0 THEN nblue - oblue END AS blue_membership_net, unk AS unknown_quality_arrivals,
    CASE WHEN n = 0 THEN 'undefined' WHEN unk > 0 THEN 'lower_bound' ELSE 'complete' END AS quality_share_status, {R('p')} AS quality_share,
    {R('(high + unk) / nullif(n, 0)::DOUBLE')} AS quality_upper, covered AS coverage_complete,
    CASE WHEN exact AND ubadge = 0 AND unk = 0 AND b_start IS NOT NULL AND a_start IS NOT NULL THEN {R('p')} END AS full_window_quality_share,
    CASE WHEN exact AND unk = 0 AND n > 0 THEN {R('greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n))')} END AS wilson_low,
    CASE WHEN exact AND unk = 0 AND n > 0 THEN {R('least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n))')} END AS wilson_high FROM w""",
)
def arrival_quality(spark, folder):
    rows = report(spark, folder)["growth"]
    return rows.select(
        *IDS,
        "exact_follower_comparison",
        "observed_blue_arrivals",
        "confirmed_new_blue",
        "observed_blue_departures",
        "existing_became_blue",
        "existing_no_longer_blue",
        F.col("unresolved_existing_badge_transitions").alias("unresolved"),
        "blue_membership_net",
        "unknown_quality_arrivals",
        "quality_share_status",
        r6("quality_share").alias("quality_share"),
        r6("quality_upper").alias("quality_upper"),
        "coverage_complete",
        r6("full_window_quality_share").alias("full_window_quality_share"),
        r6("wilson_low").alias("wilson_low"),
        r6("wilson_high").alias("wilson_high"),
    )


@query(
    "snapshot_warnings",
    f"""WITH {QUALITY}, x AS (SELECT account, b, a, unnest([CASE WHEN NOT (b_complete AND a_complete) THEN 'partial_lists' END, CASE WHEN NOT covered THEN 'incomplete_coverage' END,
    CASE WHEN overlap THEN 'collection_windows_overlap' END, CASE WHEN n > 0 AND (b_start IS NULL OR a_start IS NULL) THEN 'collection_start_missing' END,
    CASE WHEN scope = 'verified_followers' THEN 'verified_only_lists' END, CASE WHEN account = 'acct_5' THEN 'handle_only_identity' END,
    CASE WHEN unk > 0 THEN 'quality_classification_incomplete' END, CASE WHEN unres > 0 THEN 'unknown_badges' END]) AS warning FROM q)
    SELECT account, b AS before_snapshot_id, a AS after_snapshot_id, warning FROM x WHERE warning IS NOT NULL""",
)
def snapshot_warnings(spark, folder):
    return report(spark, folder)["warnings"]


@query(
    "post_feedback",
    f"""WITH {SNAP}, po AS (SELECT 'acct_' || (user_id % 7) || ':' || ((epoch_us(ts) - {BASE}) // {SIX_HOURS}) AS sid, CAST(user_id % 50 + 1000 AS VARCHAR) AS post_id,
      count(*) FILTER (event_type = 'click') AS replies, nullif(count(*) FILTER (event_type = 'signup'), 0) AS reposts, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS views,
      max(epoch_us(ts)) AS mx FROM events GROUP BY 1, 2),
    t AS (SELECT *, CASE WHEN CAST(post_id AS BIGINT) % 2 = 0 THEN mx END AS at FROM po),
    k AS (SELECT p.account, p.b, p.a, x.post_id FROM pairs p JOIN t x ON x.sid = p.b UNION SELECT p.account, p.b, p.a, x.post_id FROM pairs p JOIN t x ON x.sid = p.a),
    j AS (SELECT k.*, o.replies AS r0, n.replies AS r1, o.reposts AS s0, n.reposts AS s1, o.views AS v0, n.views AS v1, CASE WHEN o.sid IS NOT NULL THEN coalesce(o.at, p.b_us) END AS t0,
      CASE WHEN n.sid IS NOT NULL THEN coalesce(n.at, p.a_us) END AS t1
      FROM k JOIN pairs p USING (account, b, a) LEFT JOIN t o ON o.sid = k.b AND o.post_id = k.post_id LEFT JOIN t n ON n.sid = k.a AND n.post_id = k.post_id)
    SELECT account, b AS before_snapshot_id, a AS after_snapshot_id, post_id, t0 AS from_us, t1 AS to_us,
      CASE WHEN t1 > t0 AND r1 >= r0 THEN r1 - r0 END AS replies_delta, CASE WHEN t1 > t0 AND s1 >= s0 THEN s1 - s0 END AS reposts_delta, CASE WHEN t1 > t0 AND v1 >= v0 THEN v1 - v0 END AS views_delta,
      CASE WHEN s0 IS NULL OR s1 IS NULL THEN 'unavailable or missing baseline' WHEN NOT t1 > t0 THEN 'post observation time did not advance'
           WHEN s1 < s0 THEN 'counter decreased; reconcile observations' END AS reposts_reason FROM j""",
)
def post_feedback(spark, folder):
    people = members(spark, folder)
    pairs = snapshots.consecutive_pairs(snapshot_table(people))
    rows = snapshots.post_feedback(pairs, snapshot_posts(spark, folder))
    return rows.select(
        *IDS,
        "post_id",
        us("window_from").alias("from_us"),
        us("window_to").alias("to_us"),
        "replies_delta",
        "reposts_delta",
        "views_delta",
        "reposts_reason",
    )


@query(
    "stock_density",
    f"""WITH {SNAP}, d AS (SELECT snapshot_id, count(*) AS n_members, count(*) FILTER (badge = 'blue' AND quality = 'high') AS high,
    count(*) FILTER (badge = 'blue' AND quality = 'unknown') AS unk, count(*) FILTER (badge = 'unknown') AS ub FROM sm GROUP BY 1)
    SELECT account, snapshot_id, n_members, high, unk AS unknown, CASE WHEN complete AND scope = 'all_followers' AND ub = 0 THEN {R('high / n_members::DOUBLE')} END AS density_lower,
    CASE WHEN complete AND scope = 'all_followers' AND ub = 0 THEN {R('(high + unk) / n_members::DOUBLE')} END AS density_upper FROM sn JOIN d USING (snapshot_id)""",
)
def stock_density(spark, folder):
    people = members(spark, folder)
    rows = snapshots.stock_density(snapshot_table(people), people)
    return rows.withColumn("density_lower", r6("density_lower")).withColumn("density_upper", r6("density_upper"))


@query(
    "cohort_retention",
    f"""WITH {SNAP}, co AS (SELECT account, identity, {BASE} + (win + 1) * {SIX_HOURS} AS born FROM sm WHERE win % 16 = 1 AND badge = 'blue'),
    sz AS (SELECT account, born, count(DISTINCT identity) AS n_initial FROM co GROUP BY 1, 2),
    ck AS (SELECT z.account, z.born, min(s.observed_us) AS checked_us FROM sz z JOIN sn s ON s.account = z.account AND s.complete AND s.scope = 'all_followers' AND s.observed_us >= z.born + {DAY} GROUP BY 1, 2),
    kp AS (SELECT c.account, c.born, count(*) AS kept FROM co c JOIN ck USING (account, born) JOIN sn s ON s.account = c.account AND s.observed_us = ck.checked_us JOIN sm m ON m.snapshot_id = s.snapshot_id AND m.identity = c.identity GROUP BY 1, 2)
    SELECT account, born AS cohort_us, n_initial, checked_us, CASE WHEN checked_us IS NOT NULL THEN coalesce(kept, 0) END AS n_retained,
    {R('CASE WHEN checked_us IS NOT NULL THEN coalesce(kept, 0) / n_initial::DOUBLE END')} AS retention, CASE WHEN checked_us IS NULL THEN 'no_complete_later_list' END AS reason
    FROM sz LEFT JOIN ck USING (account, born) LEFT JOIN kp USING (account, born)""",
)
def cohort_retention(spark, folder):
    people = members(spark, folder).withColumn("id", snapshots.member_key(F.col("id"), F.col("handle")))
    first = people.filter((F.col("win") % 16 == 1) & (F.col("badge") == "blue")).select(
        "account", "id", F.timestamp_micros((F.col("win") + 1) * SIX_HOURS + BASE).alias("cohort_at")
    )
    rows = snapshots.retention(first, snapshot_table(people), people, 24.0)
    return rows.select(
        "account",
        us("cohort_at").alias("cohort_us"),
        "n_initial",
        us("checked_at").alias("checked_us"),
        "n_retained",
        r6("retention").alias("retention"),
        "reason",
    )


COHORT = f"""co AS (SELECT 'acct_' || (user_id % 7) AS account, epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS n, count(*) FILTER (value > 60) AS high,
    count(*) FILTER (value <= 60 AND value > 15) AS not_high, count(*) FILTER (value <= 15) AS unknown, count(DISTINCT user_id) AS confirmed FROM events GROUP BY 1, 2)"""


def cohorts(spark, folder):
    """One arrival cohort per account and day."""
    day = F.timestamp_micros(F.floor(F.unix_micros("observed_at") / DAY) * DAY)
    value = F.col("value")
    return (
        events(spark, folder)
        .groupBy(F.concat(F.lit("acct_"), F.col("user_id") % 7).alias("account"), day.alias("window_started_at"))
        .agg(
            F.count(F.lit(1)).alias("observed_arrivals"),
            F.count_if(value > 60).alias("high"),
            F.count_if((value <= 60) & (value > 15)).alias("not_high"),
            F.count_if(value <= 15).alias("unknown"),
            F.count_distinct("user_id").alias("confirmed_new_followers"),
        )
        .withColumn("window_ended_at", F.timestamp_micros(F.unix_micros("window_started_at") + DAY))
    )


@query(
    "cohort_bounds",
    f"""WITH {COHORT} SELECT account, day_us, CASE WHEN unknown > 0 THEN 'classification_incomplete' ELSE 'classified' END AS status,
    {R('high / n::DOUBLE')} AS lower_bound, {R('(high + unknown) / n::DOUBLE')} AS upper_bound FROM co""",
)
def cohort_bounds(spark, folder):
    rows = reports.cohort_quality(cohorts(spark, folder))
    return rows.select(
        "account",
        us("window_started_at").alias("day_us"),
        "status",
        r6("lower_bound").alias("lower_bound"),
        r6("upper_bound").alias("upper_bound"),
    )


@query(
    "wilson_interval",
    f"""WITH {COHORT}, w AS (SELECT *, high / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM co) SELECT account, day_us,
    {R('greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n))')} AS wilson_low,
    {R('least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n))')} AS wilson_high FROM w""",
)
def wilson_interval(spark, folder):
    low, high = numeric.wilson(F.col("high"), F.col("observed_arrivals"))
    return cohorts(spark, folder).select(
        "account", us("window_started_at").alias("day_us"), r6(low).alias("wilson_low"), r6(high).alias("wilson_high")
    )


@query(
    "following_ratios",
    f"""WITH {COHORT} SELECT account, day_us, CASE WHEN high > 0 THEN {R('confirmed / high::DOUBLE')} END AS ratio,
    CASE WHEN high = 0 THEN 'zero_denominator' END AS reason, {R('ln((high + 1.0::DOUBLE) / (confirmed + 1))')} AS network_signal FROM co""",
)
def following_ratios(spark, folder):
    from ..operators.documented import network_signal

    rows = cohorts(spark, folder).withColumnRenamed("high", "total").withColumnRenamed("confirmed_new_followers", "following")
    rows = reports.following_ratios(rows)
    return rows.select(
        "account",
        us("window_started_at").alias("day_us"),
        r6("following_to_total_ratio").alias("ratio"),
        "reason",
        r6(network_signal(F.col("total"), F.col("following"))).alias("network_signal"),
    )


# --- headline table and update planning -------------------------------------------------------


def account_tables(spark, folder):
    e = events(spark, folder).withColumn("account", F.concat(F.lit("acct_"), F.col("user_id") % 7))
    followers = e.filter(F.col("event_type") == "view").select(
        "account", "observed_at", F.col("event_id").alias("index"), (F.col("event_id") % 1000).alias("total")
    )
    blues = e.filter(F.col("event_type") == "signup").select("account", "observed_at", (F.col("event_id") % 90).alias("count"))
    cohort = e.groupBy("account").agg(
        F.count(F.lit(1)).alias("observed_arrivals"),
        F.count_if(F.col("value") > 60).alias("high"),
        F.count_if((F.col("value") <= 60) & (F.col("value") > 15)).alias("not_high"),
        F.count_if(F.col("value") <= 15).alias("unknown"),
        F.min("observed_at").alias("window_started_at"),
        F.max("observed_at").alias("window_ended_at"),
    ).select(
        "*",
        F.lit(None).cast("bigint").alias("confirmed_new_followers"),
        F.lit(None).cast("timestamp").alias("classified_at"),
        F.when(F.col("account") == "acct_2", F.lit(False)).otherwise(F.lit(True)).alias("complete"),
        F.lit("all_followers").alias("scope"),
        F.col("high").alias("captured_list_count"),
        F.lit(None).cast("bigint").alias("end_profile_total"),
    )
    return {"follower_observations": followers, "blue_observations": blues, "blue_cohort": cohort}


ACCOUNTS = f"""ev AS (SELECT *, 'acct_' || (user_id % 7) AS account FROM events),
fo AS (SELECT account, arg_min(event_id % 1000, event_id) AS a, arg_max(event_id % 1000, event_id) AS b, min(ts) AS at0, max(ts) AS at1 FROM ev WHERE event_type = 'view' GROUP BY 1),
bl AS (SELECT account, max(ts) AS blue_at, arg_max(event_id % 90, event_id) AS blue FROM ev WHERE event_type = 'signup' GROUP BY 1),
co AS (SELECT account, count(*) AS n, count(*) FILTER (value > 60) AS high, count(*) FILTER (value <= 60 AND value > 15) AS not_high, count(*) FILTER (value <= 15) AS unknown,
    min(ts) AS w0, max(ts) AS w1 FROM ev GROUP BY 1)"""
PERCENT = "(((2000 * {x} + n) // (2 * n)) // 10) || '.' || (((2000 * {x} + n) // (2 * n)) % 10) || '%'"
STAMP = "strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "metric_rows",
    f"""WITH {ACCOUNTS}, m AS (SELECT account, unnest([
    struct_pack(position := 0, metric := 'total_followers', value := CAST(a AS VARCHAR) || ' -> ' || b || ' (' || CASE WHEN b >= a THEN '+' ELSE '' END || (b - a) || ')'),
    struct_pack(position := 1, metric := 'newly_observed_blue', value := n || '; confirmed new followers: unknown'),
    struct_pack(position := 2, metric := 'quality_classification', value := high || ' high / ' || not_high || ' not matched / ' || unknown || ' unclassified'),
    struct_pack(position := 3, metric := 'high_quality_share', value := 'Pending classification; unknown is not zero'),
    struct_pack(position := 4, metric := 'quality_bounds', value := {PERCENT.format(x='high')} || '-' || {PERCENT.format(x='(high + unknown)')}),
    struct_pack(position := 5, metric := 'cohort_window', value := {STAMP.format(x='w0')} || ' -> ' || {STAMP.format(x='w1')}),
    struct_pack(position := 6, metric := 'latest_profile_observation', value := {STAMP.format(x='at1')}),
    struct_pack(position := 7, metric := 'first_profile_observation', value := {STAMP.format(x='at0')}),
    struct_pack(position := 8, metric := 'blue_count_observation', value := {STAMP.format(x='blue_at')}),
    struct_pack(position := 9, metric := 'list_coverage', value := CASE WHEN account = 'acct_2' THEN high || '/unknown' END)]) AS s FROM co JOIN fo USING (account) JOIN bl USING (account))
    SELECT account, s.position AS position, s.metric AS metric, s.value AS value FROM m WHERE s.value IS NOT NULL""",
)
def metric_rows(spark, folder):
    return reports.metric_rows(account_tables(spark, folder))


def update_inputs(spark, folder):
    tables = account_tables(spark, folder)
    number = F.regexp_extract("account", r"(\d+)$", 1).cast("bigint")
    accounts = tables["blue_cohort"].select(
        "account",
        F.concat(F.lit("https://x.com/"), "account", F.lit("/status/1")).alias("launch_post"),
        F.lit("public-v1").alias("quality_rubric"),
        F.when(number == 3, F.array(F.lit(" b "), F.lit("a"), F.lit("a "), F.lit("")))
        .otherwise(F.array().cast("array<string>"))
        .alias("changes"),
    )
    return tables, accounts, number


@query(
    "change_notes",
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct([x for x in [trim(n) for n in [' ' || o_orderpriority, o_orderstatus || ' ', o_orderstatus, ' ']] if x <> ''])), '|') AS notes FROM orders""",
)
def change_notes(spark, folder):
    from .registry import table

    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    notes = F.array(F.concat(F.lit(" "), priority), F.concat(status, F.lit(" ")), status, F.lit(" "))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.array_join(progress.clean_changes(notes), "|").alias("notes")
    )


@query(
    "material_change",
    f"""WITH {ACCOUNTS}, s AS (SELECT account, CAST(regexp_extract(account, '([0-9]+)$', 1) AS BIGINT) AS k, b AS total, at1, blue, blue_at, n, high, not_high, unknown, w1 FROM co JOIN fo USING (account) JOIN bl USING (account)),
    r AS (SELECT *, k >= 1 AS has_last, k = 4 AS regressed, k = 6 AS foreign_state, concat_ws(',', CASE WHEN k = 0 THEN 'account' END, CASE WHEN k IN (0, 6) THEN 'launch_post' END,
      CASE WHEN k = 0 OR k % 2 = 0 THEN 'total_followers' END, CASE WHEN k = 0 THEN 'observed_blue_count' END, CASE WHEN k = 0 THEN 'quality' END, CASE WHEN k = 0 THEN 'quality_rubric' END,
      CASE WHEN k IN (0, 3) THEN 'changes' END) AS changed FROM s)
    SELECT account, changed AS changed_fields, changed <> '' AND NOT regressed AND NOT foreign_state AND k <> 2 AS should_update,
    CASE WHEN foreign_state THEN 'state_of_another_entrance' WHEN regressed THEN 'observation_older_than_published' WHEN changed <> '' AND k <> 2 THEN 'material_change' WHEN changed <> '' THEN 'operating_interval' ELSE 'no_material_change' END AS reason,
    sha256('{{"account":"' || account || '","changes":' || CASE WHEN k = 3 THEN '["a","b"]' ELSE '[]' END || ',"launch_post":"https://x.com/' || account || '/status/1","observed_blue_count":' || blue ||
      ',"quality":{{"confirmed_new_followers":null,"high":' || high || ',"not_high":' || not_high || ',"observed_arrivals":' || n || ',"unknown":' || unknown || '}},"quality_rubric":"public-v1","total_followers":' || total || '}}') AS fingerprint FROM r""",
)
def material_change(spark, folder):
    tables, accounts, number = update_inputs(spark, folder)
    state = progress.material_state(
        accounts, tables["follower_observations"], tables["blue_observations"], tables["blue_cohort"]
    )
    now = F.timestamp_micros(F.lit(BASE + 40 * DAY))
    later = F.timestamp_micros(F.unix_micros("followers_at") + DAY)
    published = state.filter(number >= 1).select(
        "account",
        F.when(number == 6, F.lit("https://x.com/other/status/9")).otherwise(F.col("launch_post")).alias("launch_post"),
        F.when(number % 2 == 0, F.col("total_followers") - 1).otherwise(F.col("total_followers")).alias("total_followers"),
        "observed_blue_count",
        "quality",
        "quality_rubric",
        F.array().cast("array<string>").alias("changes"),
        F.when(number == 4, later).otherwise(F.col("followers_at")).alias("followers_at"),
        "blue_at",
        "quality_at",
        "cohort_window_at",
        F.timestamp_micros(F.lit(BASE + 40 * DAY) - F.when(number == 2, 60000000).otherwise(7200000000)).alias("verified_at"),
    )
    rows = progress.plan_updates(state, published, now, 60)
    return rows.select(
        "account", F.array_join("changed_fields", ",").alias("changed_fields"), "should_update", "reason", "fingerprint"
    )
