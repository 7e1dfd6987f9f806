"""Explicit schemas of the input contracts as DDL text; nothing is inferred."""

from __future__ import annotations

SNAPSHOT = """
account string, observed_at string, collection_started_at string, scope string, complete boolean,
evidence string, quality_rubric string, total_followers bigint,
followers array<struct<id: string, handle: string, badge: string,
  quality: struct<status: string, relevant: boolean, original: boolean, substantive: boolean,
                  evidence: array<string>>>>,
posts map<string, struct<replies: bigint, likes: bigint, reposts: bigint, bookmarks: bigint,
                         views: bigint, observed_at: string>>
"""

COHORT = """struct<observed_arrivals: bigint, confirmed_new_followers: bigint, high: bigint,
  not_high: bigint, unknown: bigint, window_started_at: string, window_ended_at: string,
  classified_at: string, scope: string, complete: boolean, captured_list_count: bigint,
  end_profile_total: bigint>"""

PROOF = """struct<source: string, field: string, url: string, observed_at: string,
  official_metric_documentation: string, capture_evidence: string>"""

METRICS_DOCUMENT = f"""
account string, launch_post string, quality_rubric string,
follower_observations array<struct<observed_at: string, total: bigint, following: bigint>>,
blue_observations array<struct<observed_at: string, count: bigint>>,
blue_cohort {COHORT},
blue_cohort_history array<{COHORT}>,
posts array<struct<url: string, kind: string, published_at: string, observed_at: string,
  original_version_url: string, original_published_at: string, published_at_source: string,
  views: bigint, replies: bigint, likes: bigint, reposts: bigint, bookmarks: bigint>>,
post_observations array<struct<url: string, kind: string, source: string, published_at: string,
  observed_at: string, views: bigint, replies: bigint, likes: bigint, reposts: bigint,
  bookmarks: bigint>>,
analytics_observations array<struct<url: string, kind: string, source: string, published_at: string,
  observed_at: string, impressions: bigint, engagements: bigint, detail_expands: bigint,
  profile_visits: bigint, link_clicks: bigint, follows_attributed: bigint,
  follows_attributed_evidence: {PROOF}>>,
progress_updates array<struct<url: string, parent: string, reported_profile_observation: string,
  verified_at: string>>,
github struct<url: string, stars: bigint, forks: bigint, observed_at: string>
"""

# Collections of the metrics document that are fanned out to tables.
COLLECTIONS = (
    "follower_observations",
    "blue_observations",
    "blue_cohort_history",
    "posts",
    "post_observations",
    "analytics_observations",
    "progress_updates",
)

CASCADE_INDEX = "tweet_id string, post_time_day double, start_ind bigint, end_ind bigint"
CASCADE_EVENTS = "relative_time_second string, number_of_followers string"

FEATURE_COLUMNS = (
    "cascade_id",
    "post_time_day",
    "cutoff_seconds",
    "paper_day_split",
    "strict_label_available_split",
    "observed_retweet_count",
    "first_observed_retweet_seconds",
    "last_observed_retweet_seconds",
    "future_retweets_to_24h",
    "total_retweets_at_24h",
    "label_available_day",
)
FEATURE_ROWS = """
cascade_id string, post_time_day double, cutoff_seconds int, paper_day_split string,
strict_label_available_split string, observed_retweet_count bigint,
first_observed_retweet_seconds double, last_observed_retweet_seconds double,
future_retweets_to_24h bigint, total_retweets_at_24h bigint, label_available_day double
"""
FEATURE_ROWS_TEXT = ", ".join(f"{c} string" for c in FEATURE_COLUMNS)
FEATURE_LABELS = ("future_retweets_to_24h", "total_retweets_at_24h")

QUESTION_ANSWERS = "question string, human_answers array<string>, chatgpt_answers array<string>"

SEALED_FORECAST = """
contract_version string, forecast_id string, status string, post_url string, post_id string,
version string, source string, metric string, published_at string, origin_at string,
input_cutoff_at string, generated_at string, frozen_at string, target_at string,
n_numeric_points bigint, input_snapshot_sha256 string,
input_snapshot struct<post_url: string, source: string, metric: string, published_at: string,
  numeric_observations: array<struct<observed_at: string, source: string, views: bigint,
    impressions: bigint, observation_started_at: string, observation_completed_at: string,
    available_at: string>>>,
predictions map<string, struct<point_prediction: double>>,
observation_policy struct<early_tolerance_seconds: int, late_tolerance_seconds: int,
  accepted_observed_at_start: string, accepted_observed_at_end: string>,
outcome map<string, string>, future_verification string
"""
FORECAST_ACTUAL = """
forecast_id string, post_url string, version string, source string, metric string,
generated_at string, first_successful_numeric_read_at_or_after_target boolean,
observation_history_complete_since_target boolean,
observations array<struct<actual: bigint, observed_at: string, observation_started_at: string,
  observation_completed_at: string, available_at: string>>
"""

POST = """struct<platform: string, post_id: string, version: string, post_url: string,
  published_at: string, captured_at: string, content_group_id: string>"""
ORIGIN_RECORD = f"""
contract_version string, post {POST}, prediction_at string,
external_prediction struct<model_id: string, model_version: string, weights_sha256: string,
  generated_at: string, available_at: string,
  probabilities: struct<human_written: double, ai_generated: double, mixed: double>,
  input_features: array<struct<name: string, kind: string, version: string, captured_at: string,
    available_at: string, latest_event_at: string>>,
  provenance: struct<strategy: string, training_cutoff: string, trained_at: string,
    fold_id: string, training_groups: array<struct<platform: string, post_id: string,
      published_at: string, latest_input_available_at: string, label_available_at: string,
      content_group_id: string>>>>
"""
ORIGIN_RECORD_KEYS = ("contract_version", "post", "prediction_at", "external_prediction")
ORIGIN_RECORD_REQUIRED = ORIGIN_RECORD_KEYS[:3]
ORIGIN_LABEL = f"""
contract_version string, post {POST}, scope string, label_policy string, content_origin string,
label_available_at string,
evidence array<struct<method: string, reference: string, available_at: string>>
"""
ORIGIN_LABEL_KEYS = (
    "contract_version",
    "post",
    "scope",
    "label_policy",
    "content_origin",
    "label_available_at",
    "evidence",
)
ROLLING_COUNTER = """
metric string, window_days int, impression_target bigint, verified_follower_target bigint,
source string, observations array<struct<observed_at: string, source: string,
  replies_excluded: boolean, verified_home_impressions_90d: bigint, verified_followers: bigint,
  payout_qualified_impressions: bigint>>
"""
