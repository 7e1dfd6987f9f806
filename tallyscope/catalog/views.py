"""Observation tables derived from the given tables, as DataFrames and as SQL fragments.

The SQL fragments are the bodies of common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..session import spread
from .registry import table

BASE = 1704067200000000  # 2024-01-01T00:00:00Z in microseconds
SIX_HOURS = 21600000000
DAY = 86400000000
SEED = 20261010


def instant(name: str):
    """An instant from a zone-less UTC timestamp, whatever the session zone is."""
    return F.timestamp_micros(
        F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("observed_at", instant("ts")).drop("ts")


# --- counter histories ------------------------------------------------------------------------


def counter_obs(spark: SparkSession, folder: str) -> DataFrame:
    """One cumulative counter per user; error events carry no count, some counts are revised."""
    total = F.when(
        F.col("event_type") != "error", F.col("event_id") * 3 + F.floor("value").cast("bigint")
    )
    return events(spark, folder).select(
        F.col("user_id").alias("series"), "event_id", "observed_at", total.alias("total")
    )


OBS = """obs AS (SELECT user_id AS series, event_id, ts, epoch_us(ts) AS us,
  CASE WHEN event_type <> 'error' THEN event_id * 3 + CAST(floor(value) AS BIGINT) END AS total FROM events)"""
IV = (
    OBS
    + """, iv AS (SELECT series, pus AS started_us, us AS ended_us, (us - pus) / 1e6 AS secs,
  total - ptotal AS net_delta, ptotal AS count_before, total AS count_after
  FROM (SELECT *, lag(us) OVER w AS pus, lag(total) OVER w AS ptotal FROM obs WHERE total IS NOT NULL
        WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)) WHERE pus IS NOT NULL)"""
)


def analytics(spark: SparkSession, folder: str) -> DataFrame:
    """Owner counters per user and day; the export source alternates by day."""
    e = events(spark, folder).withColumn("day", F.floor((micros(F.col("observed_at")) - BASE) / DAY))

    def n(kind: str):
        return F.count_if(F.col("event_type") == kind)

    daily = e.groupBy("user_id", "day").agg(
        n("view").alias("impressions"),
        n("click").alias("engagements"),
        F.nullif(n("error"), F.lit(0)).alias("detail_expands"),
        n("signup").alias("profile_visits"),
        n("purchase").alias("link_clicks"),
    )
    return daily.select(
        F.col("user_id").alias("series"),
        F.timestamp_micros(F.col("day") * DAY + BASE).alias("observed_at"),
        F.when(F.col("day") % 4 == 3, "export_b").otherwise("export_a").alias("source"),
        "impressions",
        "engagements",
        "detail_expands",
        "profile_visits",
        "link_clicks",
    )


ANALYTICS = f"""an AS (SELECT user_id AS series, {BASE} + d * {DAY} AS us,
  CASE WHEN d % 4 = 3 THEN 'export_b' ELSE 'export_a' END AS source, impressions, engagements,
  nullif(errs, 0) AS detail_expands, profile_visits, link_clicks
  FROM (SELECT user_id, (epoch_us(ts) - {BASE}) // {DAY} AS d,
    count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS engagements,
    count(*) FILTER (event_type = 'error') AS errs, count(*) FILTER (event_type = 'signup') AS profile_visits,
    count(*) FILTER (event_type = 'purchase') AS link_clicks FROM events GROUP BY 1, 2))"""


# --- snapshots --------------------------------------------------------------------------------


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Users active in a six-hour window are the members of one of seven accounts."""
    e = events(spark, folder).withColumn("win", F.floor((micros(F.col("observed_at")) - BASE) / SIX_HOURS))
    last = e.groupBy(F.concat(F.lit("acct_"), F.col("user_id") % 7).alias("account"), "win", "user_id").agg(
        F.max_by(F.struct("event_type", "value"), "event_id").alias("l")
    )
    kind, value = F.col("l.event_type"), F.col("l.value")
    badge = (
        F.when(kind == "view", "blue").when(kind == "signup", "gold").when(kind == "error", "gray")
        .when(kind == "click", "none").otherwise("unknown")
    )
    quality = F.when(value > 60, "high").when(value > 15, "not_high").otherwise("unknown")
    uid = F.col("user_id").cast("string")
    return last.select(
        "account",
        "win",
        F.concat("account", F.lit(":"), "win").alias("snapshot_id"),
        F.when(F.col("account") != "acct_5", uid).alias("id"),
        F.concat(F.lit("User_"), uid).alias("handle"),
        badge.alias("badge"),
        quality.alias("quality_status"),
    )


def snapshot_table(member_rows: DataFrame) -> DataFrame:
    """Contract columns of every snapshot."""
    per = member_rows.groupBy("account", "win", "snapshot_id").agg(F.count(F.lit(1)).alias("total_followers"))
    end = (F.col("win") + 1) * SIX_HOURS + BASE
    start = F.when(F.col("win") % 5 == 0, F.lit(None)).otherwise(
        F.col("win") * SIX_HOURS + BASE + F.when(F.col("win") % 11 == 0, F.lit(-3600000000)).otherwise(F.lit(1000000))
    )
    return per.select(
        "account",
        "snapshot_id",
        F.timestamp_micros(end).alias("observed_at"),
        F.timestamp_micros(start.cast("bigint")).alias("collection_started_at"),
        F.when(F.col("account") == "acct_3", "verified_followers").otherwise("all_followers").alias("scope"),
        (F.col("win") % 3 != 0).alias("complete"),
        F.lit("public-v1").alias("quality_rubric"),
        "total_followers",
    )


SNAP = f"""sm AS (SELECT account, win, account || ':' || win AS snapshot_id,
    CASE WHEN account <> 'acct_5' THEN 'id:' || uid ELSE 'handle:user_' || uid END AS identity,
    CASE et WHEN 'view' THEN 'blue' WHEN 'signup' THEN 'gold' WHEN 'error' THEN 'gray' WHEN 'click' THEN 'none' ELSE 'unknown' END AS badge,
    CASE WHEN v > 60 THEN 'high' WHEN v > 15 THEN 'not_high' ELSE 'unknown' END AS quality
  FROM (SELECT 'acct_' || (user_id % 7) AS account, (epoch_us(ts) - {BASE}) // {SIX_HOURS} AS win, CAST(user_id AS VARCHAR) AS uid,
    arg_max(event_type, event_id) AS et, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2, 3)),
sn AS (SELECT account, win, snapshot_id, count(*) AS n, {BASE} + (win + 1) * {SIX_HOURS} AS observed_us,
    CASE WHEN win % 5 = 0 THEN NULL ELSE {BASE} + win * {SIX_HOURS} + CASE WHEN win % 11 = 0 THEN -3600000000 ELSE 1000000 END END AS started_us,
    CASE WHEN account = 'acct_3' THEN 'verified_followers' ELSE 'all_followers' END AS scope, win % 3 <> 0 AS complete
  FROM sm GROUP BY 1, 2, 3),
pairs AS (SELECT * FROM (SELECT account, lag(snapshot_id) OVER w AS b, snapshot_id AS a, lag(observed_us) OVER w AS b_us, observed_us AS a_us,
    lag(started_us) OVER w AS b_start, started_us AS a_start, scope, lag(complete) OVER w AS b_complete, complete AS a_complete
  FROM sn WINDOW w AS (PARTITION BY account ORDER BY win)) WHERE b IS NOT NULL),
ch AS (SELECT account, b, a, identity, max(CASE side WHEN 0 THEN badge END) AS ob, max(CASE side WHEN 1 THEN badge END) AS nb,
    max(CASE side WHEN 1 THEN quality END) AS nq
  FROM (SELECT p.account, p.b, p.a, s.identity, s.badge, s.quality, 0 AS side FROM pairs p JOIN sm s ON s.snapshot_id = p.b
        UNION ALL SELECT p.account, p.b, p.a, s.identity, s.badge, s.quality, 1 FROM pairs p JOIN sm s ON s.snapshot_id = p.a) GROUP BY 1, 2, 3, 4),
cc AS (SELECT *, CASE WHEN ob IS NULL AND nb = 'blue' THEN 'arrival' WHEN nb IS NULL AND ob = 'blue' THEN 'departure'
    WHEN nb = 'blue' AND ob NOT IN ('blue', 'unknown') THEN 'upgrade' WHEN ob = 'blue' AND nb NOT IN ('blue', 'unknown') THEN 'downgrade'
    WHEN (ob = 'unknown' AND nb = 'blue') OR (ob = 'blue' AND nb = 'unknown') THEN 'unresolved' END AS change FROM ch)"""


def snapshot_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of fifty posts inside every snapshot."""
    e = events(spark, folder).withColumn("win", F.floor((micros(F.col("observed_at")) - BASE) / SIX_HOURS))
    account = F.concat(F.lit("acct_"), F.col("user_id") % 7)
    pid = (F.col("user_id") % 50 + 1000).cast("string")

    def n(kind: str):
        return F.count_if(F.col("event_type") == kind)

    per = e.groupBy(account.alias("account"), "win", pid.alias("post_id")).agg(
        n("click").alias("replies"),
        n("view").alias("likes"),
        F.nullif(n("signup"), F.lit(0)).alias("reposts"),
        n("purchase").alias("bookmarks"),
        F.sum(F.floor("value").cast("bigint")).alias("views"),
        F.max("observed_at").alias("_max"),
    )
    return per.select(
        F.concat("account", F.lit(":"), "win").alias("snapshot_id"),
        F.concat(F.lit("https://x.com/"), "account", F.lit("/status/"), "post_id").alias("url"),
        "post_id",
        F.when(F.col("post_id") % 2 == 0, F.col("_max")).alias("post_observed_at"),
        "replies",
        "likes",
        "reposts",
        "bookmarks",
        "views",
    )


# --- exposure ---------------------------------------------------------------------------------


def exposure_collections(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Posts, public captures and owner captures; a tenth of the posts has no publication clock."""
    e = events(spark, folder)
    url = F.concat(F.lit("https://x.com/acct/status/"), F.col("user_id") + 1).alias("url")
    noise = F.when(F.col("user_id") % 5 == 0, F.floor("value").cast("bigint") * 20).otherwise(F.lit(0))
    value = (F.col("event_id") + noise).alias("value")
    rows = e.select(
        F.col("event_id").alias("index"), url, "event_type", "observed_at", value, F.lit(None).cast("timestamp").alias("published_at")
    )
    public = rows.filter(F.col("event_type").isin("view", "click", "signup"))
    owner = rows.filter(F.col("event_type").isin("purchase", "error"))
    posts = e.filter(F.col("user_id") % 10 != 9).groupBy("user_id").agg(F.min("observed_at").alias("first"))
    posts = posts.select(
        F.col("user_id").alias("index"),
        url,
        F.timestamp_micros(F.unix_micros("first") - 60000000).alias("published_at"),
        F.lit(None).cast("timestamp").alias("observed_at"),
        F.lit(None).cast("bigint").alias("views"),
    )
    return {
        "posts": posts,
        "post_observations": public.withColumnRenamed("value", "views"),
        "analytics_observations": owner.withColumnRenamed("value", "impressions"),
    }


EXPOSURE = """pub AS (SELECT 'https://x.com/acct/status/' || (user_id + 1) AS url, min(epoch_us(ts)) - 60000000 AS pub_us
    FROM events WHERE user_id % 10 <> 9 GROUP BY user_id),
raw AS (SELECT 'https://x.com/acct/status/' || (user_id + 1) AS url,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'public_views' ELSE 'owner_impressions' END AS source, epoch_us(ts) AS us,
    event_id + CASE WHEN user_id % 5 = 0 THEN CAST(floor(value) AS BIGINT) * 20 ELSE 0 END AS value FROM events),
pts AS (SELECT r.url, r.source, r.us, (r.us - p.pub_us) / 1e6 AS age, min(r.value) AS value, p.pub_us FROM raw r JOIN pub p USING (url)
    GROUP BY r.url, r.source, r.us, p.pub_us HAVING min(r.value) = max(r.value)),
lagged AS (SELECT *, lag(us) OVER w AS us1, lag(age) OVER w AS age1, lag(value) OVER w AS v1, lag(age, 2) OVER w AS age2, lag(value, 2) OVER w AS v2,
    row_number() OVER w AS pos, lead(us) OVER w IS NULL AS is_last FROM pts WINDOW w AS (PARTITION BY url, source ORDER BY us)),
good AS (SELECT * FROM lagged WHERE (url, source) NOT IN (SELECT (url, source) FROM lagged WHERE value < v1)),
wide AS (SELECT url, source, us1 AS origin_us, us AS target_us, pos - 1 AS training_points, value AS actual, age - age1 AS horizon, is_last,
    CAST(v1 AS DOUBLE) AS constant, CASE WHEN age1 > age2 AND age > age1 THEN v1 + (v1 - v2) / (age1 - age2) * (age - age1) END AS recent_rate
    FROM good WHERE age2 IS NOT NULL),
preds AS (SELECT *, prediction - actual AS signed_error,
    CASE WHEN horizon <= 900 THEN '0_to_15_minutes' WHEN horizon <= 3600 THEN '15_to_60_minutes' WHEN horizon <= 21600 THEN '1_to_6_hours'
         WHEN horizon <= 86400 THEN '6_to_24_hours' ELSE 'over_24_hours' END AS horizon_bucket,
    CASE WHEN abs(prediction) + abs(actual) = 0 THEN 0.0 ELSE 200 * abs(prediction - actual) / (abs(prediction) + abs(actual)) END AS smape
    FROM (SELECT url, source, origin_us, target_us, training_points, actual, horizon, is_last, 'constant' AS model, constant AS prediction FROM wide
          UNION ALL SELECT url, source, origin_us, target_us, training_points, actual, horizon, is_last, 'recent_rate', recent_rate FROM wide)),
summ AS (SELECT source, model, horizon_bucket, count(*) AS n_predictions, count(DISTINCT url) AS n_posts, avg(abs(signed_error)) AS mae,
    sqrt(avg(signed_error * signed_error)) AS rmse, avg(signed_error) AS bias, avg(smape) AS smape, count(*) FILTER (is_last) AS latest_n,
    avg(abs(signed_error)) FILTER (is_last) AS latest_mae FROM preds GROUP BY 1, 2, 3)"""


# --- cascades ---------------------------------------------------------------------------------


def cascade_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifty consecutive events form one segment; some raw ids repeat or are not canonical."""
    blocks = events(spark, folder).groupBy((F.floor(F.col("event_id") / 50) + 1).alias("sequence")).agg(
        (F.min("event_id") + 1).alias("start_ind"),
        (F.max("event_id") + 1).alias("end_ind"),
        F.min_by("observed_at", "event_id").alias("first_at"),
    )
    seq = F.col("sequence")
    tweet = (
        F.when(seq % 41 == 0, F.concat(F.lit("0"), seq))
        .when(seq % 37 == 0, F.lit("777"))
        .otherwise((seq + 100000).cast("string"))
    )
    return blocks.select(
        "sequence",
        tweet.alias("tweet_id"),
        ((micros(F.col("first_at")) - BASE) / F.lit(2.0 * DAY)).alias("post_time_day"),
        "start_ind",
        "end_ind",
        "first_at",
    )


def cascade_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events in ordinal order with their relative time as source text."""
    index = cascade_index(spark, folder).select("sequence", "start_ind", "first_at")
    e = events(spark, folder).withColumn("sequence", F.floor(F.col("event_id") / 50) + 1)
    joined = e.join(index, "sequence")
    seconds = F.floor((micros(F.col("observed_at")) - micros(F.col("first_at"))) / 1000000) * (F.col("sequence") % 61 + 1)
    late = F.when(F.col("event_type") == "error", F.floor("value").cast("bigint") * 100).otherwise(F.lit(0))
    t = F.greatest(F.lit(0), seconds - late).cast("bigint").cast("string")
    kind = F.col("event_type")
    raw = (
        F.when(F.col("event_id") + 1 == F.col("start_ind"), "0")
        .when(kind == "click", F.concat(t, F.lit(".5")))
        .when(kind == "signup", F.concat(t, F.lit("e0")))
        .otherwise(t)
    )
    return joined.select((F.col("event_id") + 1).alias("ordinal"), raw.alias("relative_time_second"))


CASCADES = f"""blocks AS (SELECT event_id // 50 + 1 AS sequence, min(event_id) + 1 AS start_ind, max(event_id) + 1 AS end_ind,
    arg_min(epoch_us(ts), event_id) AS first_us FROM events GROUP BY 1),
idx AS (SELECT *, CASE WHEN sequence % 41 = 0 THEN '0' || sequence WHEN sequence % 37 = 0 THEN '777' ELSE CAST(sequence + 100000 AS VARCHAR) END AS tweet_id,
    (first_us - {BASE}) / {2.0 * DAY}::DOUBLE AS day FROM blocks),
ev AS (SELECT e.event_id + 1 AS ordinal, b.sequence AS own, CASE WHEN e.event_id + 1 = b.start_ind THEN '0'
      WHEN event_type = 'click' THEN t || '.5' WHEN event_type = 'signup' THEN t || 'e0' ELSE CAST(t AS VARCHAR) END AS raw
    FROM (SELECT x.*, greatest(0, ((epoch_us(x.ts) - y.first_us) // 1000000) * (y.sequence % 61 + 1)
        - CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) * 100 ELSE 0 END) AS t FROM events x JOIN blocks y ON y.sequence = x.event_id // 50 + 1) e
    JOIN blocks b ON b.sequence = e.event_id // 50 + 1),
asg AS (SELECT i.sequence, e.ordinal, e.raw, CAST(e.raw AS DOUBLE) AS t, e.ordinal = i.start_ind AS is_origin FROM ev e JOIN idx i
    ON e.ordinal BETWEEN i.start_ind AND i.end_ind),
rep AS (SELECT tweet_id FROM idx GROUP BY 1 HAVING count(*) > 1),
fl AS (SELECT *, NOT regexp_full_match(tweet_id, '[1-9][0-9]*') AS noncanonical, tweet_id IN (SELECT tweet_id FROM rep) AS repeated FROM idx),
cnt AS (SELECT sequence, count(*) FILTER (t <= 900) AS n1, min(t) FILTER (t <= 900) AS f1, max(t) FILTER (t <= 900) AS l1,
    count(*) FILTER (t <= 3600) AS n2, min(t) FILTER (t <= 3600) AS f2, max(t) FILTER (t <= 3600) AS l2, count(*) FILTER (t <= 86400) AS n3
    FROM asg WHERE NOT is_origin GROUP BY 1),
base AS (SELECT u.sequence, u.day, coalesce(n1, 0) AS n1, f1, l1, coalesce(n2, 0) AS n2, f2, l2, coalesce(n3, 0) AS n3
    FROM fl u LEFT JOIN cnt c USING (sequence) WHERE NOT noncanonical AND NOT repeated),
feat AS (SELECT 'cascade-' || lpad(CAST(sequence AS VARCHAR), 6, '0') AS cascade_id, sequence, day, cutoff, observed, first_at, last_at, n3 - observed AS future, n3 AS total,
    CASE WHEN day < 7 THEN 'train_candidate' ELSE 'evaluation_candidate' END AS paper,
    CASE WHEN day + 1 <= 7 THEN 'train_candidate' WHEN day < 7 THEN 'purged_label_overlap' ELSE 'evaluation_candidate' END AS strict
    FROM (SELECT sequence, day, n3, 900 AS cutoff, n1 AS observed, f1 AS first_at, l1 AS last_at FROM base
          UNION ALL SELECT sequence, day, n3, 3600, n2, f2, l2 FROM base)),
train AS (SELECT *, CAST(floor(log2(observed + 1)) AS INT) AS bucket FROM feat WHERE strict = 'train_candidate'),
med AS (SELECT cutoff, median(future) AS m FROM train GROUP BY 1),
bmed AS (SELECT cutoff, bucket, median(future) AS bm, count(*) AS bn FROM train GROUP BY 1, 2),
basep AS (SELECT f.*, CAST(floor(log2(f.observed + 1)) AS INT) AS bucket FROM feat f WHERE strict = 'evaluation_candidate'),
wide AS (SELECT p.*, 0.0::DOUBLE AS zero_p, CAST(med.m AS DOUBLE) AS const_p, observed * (86400 - p.cutoff) / p.cutoff::DOUBLE AS rate_p, CAST(coalesce(bm, med.m) AS DOUBLE) AS bucket_p
    FROM basep p JOIN med USING (cutoff) LEFT JOIN bmed ON bmed.cutoff = p.cutoff AND bmed.bucket = p.bucket),
long AS (SELECT cascade_id, cutoff, observed, future AS actual, 'zero_additional_keep_last_count' AS model, zero_p AS p FROM wide
    UNION ALL SELECT cascade_id, cutoff, observed, future, 'constant_train_median', const_p FROM wide
    UNION ALL SELECT cascade_id, cutoff, observed, future, 'early_constant_rate', rate_p FROM wide
    UNION ALL SELECT cascade_id, cutoff, observed, future, 'train_log_count_bucket_median', bucket_p FROM wide)"""


# --- text corpus ------------------------------------------------------------------------------


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per labelled document; its lines are the answers on the labelled side."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id")
    lines, none = F.split("text", "\n"), F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("doc "), "doc_id").alias("question"),
        F.when(F.col("quality") == 0, lines).otherwise(none).alias("human_answers"),
        F.when(F.col("quality") == 1, lines).otherwise(none).alias("chatgpt_answers"),
    )


def N(x: str) -> str:
    """Text normalisation in SQL; it equals the compatibility form on the given texts."""
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


QA = f"""occ AS (SELECT 'q-' || sha256('doc ' || doc_id) AS grp, quality AS label, {N("line")} AS text
    FROM (SELECT d.doc_id, l.quality, unnest(string_split(d.text, chr(10))) AS line FROM documents d JOIN labels l USING (doc_id))),
ans AS (SELECT sha256(text) AS answer_sha256, count(*) AS n, min(label) AS lo, max(label) AS hi, min(grp) AS grp FROM occ WHERE text <> '' GROUP BY 1)"""
COMPONENTS = (
    QA
    + """, adj AS (SELECT DISTINCT a.grp AS x, b.g AS y FROM (SELECT DISTINCT grp, sha256(text) AS f FROM occ WHERE text <> '') a
    JOIN (SELECT sha256(text) AS f, min(grp) AS g FROM occ WHERE text <> '' GROUP BY 1) b USING (f)),
edges AS (SELECT x, y FROM adj UNION SELECT y, x FROM adj),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
comp AS (SELECT x AS grp, min(y) AS group_id FROM reach GROUP BY 1)"""
)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with a deterministic score."""
    labels = table(spark, folder, "labels")
    p = F.pmod(F.col("doc_id") * 7919 + F.col("quality") * 350 + F.col("toxic") * 77, F.lit(1000)) / F.lit(1000.0)
    return labels.select(
        "doc_id", F.col("quality").alias("label"), "toxic", p.alias("probability")
    ).withColumn("logit", F.log((F.col("probability") + 0.001) / (F.lit(1.001) - F.col("probability"))))


SCORES = """sc AS (SELECT doc_id, quality AS label, toxic, ((doc_id * 7919 + quality * 350 + toxic * 77) % 1000) / 1000.0::DOUBLE AS p FROM labels),
sl AS (SELECT *, ln((p + 0.001::DOUBLE) / (1.001::DOUBLE - p)) AS logit, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS guess FROM sc)"""
