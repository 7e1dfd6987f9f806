import hashlib
import json
import subprocess
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import links, numeric, times
from tallyscope.operators import progress
from tallyscope.plans import reports
from tallyscope.plans.experiments import ExperimentPlan
from tallyscope.sources import readers, writers

from .conftest import at, rows

COHORT = {"observed_arrivals": 3, "high": 1, "not_high": 1, "unknown": 1, "confirmed_new_followers": None, "window_started_at": "2026-01-01T00:00:00Z", "window_ended_at": "2026-01-02T00:00:00Z"}


def document(account="acct", **change):
    u = f"https://x.com/{account}/status/"
    return {
        "account": account, "launch_post": u + "1", "quality_rubric": "public-v1",
        "follower_observations": [{"observed_at": "2026-01-01T00:00:00Z", "total": 10, "following": 5}, {"observed_at": "2026-01-01T01:00:00+01:00", "total": 10}, {"observed_at": "2026-01-01T02:00:00Z", "total": 16}],
        "blue_observations": [{"observed_at": "2026-01-01T00:00:00Z", "count": 2}], "blue_cohort": COHORT,
        "posts": [{"url": u + "1", "kind": "k", "published_at": "2026-01-01T00:00:00.123Z"}],
        "post_observations": [{"url": u + "1", "observed_at": "2026-01-01T00:10:00Z", "views": 5}, {"url": u + "1", "observed_at": "2026-01-01T00:20:00Z", "views": 15}],
        "github": {"stars": 1, "forks": 2, "observed_at": "2026-01-01T00:00:00Z"},
    } | change


def test_metrics_documents_fan_out(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document()))
    (tmp_path / "b.json").write_text('{"account": "x", "account": "y"}')
    (tmp_path / "c.json").write_text('{"account": NaN}')
    tables, rejected = readers.metrics_documents(spark, str(tmp_path))
    assert rejected.count() == 2 and tables["analytics_observations"].isEmpty()
    out = reports.growth_report(tables)
    assert [r.net_rate_per_hour for r in out["follower_intervals"].orderBy("ended_at").collect()] == [None, 3.0]
    assert out["follower_disorder"].count() == 1  # The second capture is the same instant in another zone.
    assert out["cohort_quality"].first().upper_bound == 2 / 3
    assert out["post_view_intervals"].first().net_delta == 10
    got = out["following_ratios"].orderBy("index").collect()
    assert (got[0].following_to_total_ratio, got[1].reason) == (0.5, "missing_same_snapshot_counts")
    assert tables["posts"].first().published_at.microsecond == 123000


def test_document_rules(spark, tmp_path):
    from tallyscope.operators import validation

    (tmp_path / "a.json").write_text(json.dumps(document()))
    (tmp_path / "b.json").write_text(json.dumps(document("other", launch_post="https://x.com/acct/status/1")))
    (tmp_path / "c.json").write_text(json.dumps(document("third", blue_cohort=COHORT | {"high": 2})))
    docs = readers.metrics_documents(spark, str(tmp_path))[0]["documents"]
    _, bad = validation.split(docs, validation.metrics_document_rules())
    assert rows(bad.select("account", "rule"), "account") == [("other", "launch_post_owner"), ("third", "cohort_partition")]


def test_snapshot_files(spark, tmp_path):
    base = {"account": "a", "scope": "all_followers", "complete": True, "evidence": "e"}
    before = base | {"observed_at": "2026-01-01T00:00:00Z", "total_followers": 1, "followers": [{"id": "1", "handle": "A", "badge": "blue"}], "posts": {"https://x.com/a/status/3": {"views": 4}}}
    after = base | {"observed_at": "2026-01-02T00:00:00Z", "total_followers": 1, "followers": [{"id": "2", "handle": "B", "badge": "blue", "quality": {"status": "high"}}], "posts": {"https://twitter.com/i/web/status/3": {"views": 9}}}
    for n, d in (("b", before), ("f", after)):
        (tmp_path / f"{n}.json").write_text(json.dumps(d))
    docs, members, posts, rejected = readers.snapshots(spark, str(tmp_path))
    out = reports.compare_snapshots(docs, members, posts)
    g = out["growth"].first()
    assert (g.observed_blue_arrivals, g.observed_high_quality_arrivals, g.observed_blue_departures) == (1, 1, 1)
    assert out["post_feedback"].first().views_delta == 5 and rejected.isEmpty()


def test_question_answer_lines(spark, tmp_path):
    good = json.dumps({"question": "q", "human_answers": ["a", None], "chatgpt_answers": []})
    lines = [good, "", json.dumps({"question": "q", "human_answers": []}), json.dumps({"question": "q", "human_answers": "a", "chatgpt_answers": []}), json.dumps({"question": " ", "human_answers": [], "chatgpt_answers": []})]
    (tmp_path / "qa.jsonl").write_text("\n".join(lines))
    ok, bad = readers.question_answers(spark, str(tmp_path / "qa.jsonl"))
    assert ok.count() == 1 and bad.count() == 3


def test_record_fields_are_allow_listed(spark, tmp_path):
    base = {"contract_version": "c", "post": {"platform": "x", "post_id": "1", "version": "v"}, "prediction_at": "2026-01-01T00:00:00Z"}
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in (base, base | {"extra": 1}, {"post": base["post"]})))
    ok, bad = readers.origin_records(spark, str(tmp_path / "r.jsonl"))
    assert ok.count() == 1 and bad.count() == 2


def test_sealed_files_are_checked_against_pinned_digests(spark, tmp_path):
    snapshot = {"post_url": "https://x.com/a/status/1", "source": "public_views", "metric": "views", "published_at": "2026-01-01T00:00:00Z",
                "numeric_observations": [{"observed_at": "2026-01-01T00:30:00Z", "views": 10, "note": "é"}]}
    digest = hashlib.sha256(json.dumps(snapshot, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    t = "2026-01-01T{}Z".format
    doc = {"contract_version": "sealed-1", "forecast_id": "f", "status": "frozen_before_target", "post_url": snapshot["post_url"], "post_id": "1", "version": "v", "source": "public_views", "metric": "views",
           "published_at": t("00:00:00"), "origin_at": t("00:30:00"), "input_cutoff_at": t("00:30:00"), "generated_at": t("00:31:00"), "frozen_at": t("00:32:00"), "target_at": t("01:00:00"), "n_numeric_points": 1,
           "input_snapshot_sha256": digest, "input_snapshot": snapshot, "predictions": {"constant": {"point_prediction": 10}}, "outcome": {"actual": None},
           "observation_policy": {"early_tolerance_seconds": 0, "late_tolerance_seconds": 300, "accepted_observed_at_start": t("01:00:00"), "accepted_observed_at_end": t("01:05:00")}}
    texts = [json.dumps(doc), json.dumps(doc | {"forecast_id": "g", "input_snapshot_sha256": "0" * 64}), json.dumps(doc | {"forecast_id": "h"})]
    for i, x in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(x)
    pinned = spark.createDataFrame([(hashlib.sha256(x.encode()).hexdigest(),) for x in texts[:2]], "file_sha256 string")
    tables, rejected = readers.sealed_forecasts(spark, str(tmp_path), pinned, "sealed-1")
    assert [r.rule for r in rejected.orderBy("rule").collect()] == ["file_digest_not_pinned", "input_snapshot_digest"]
    captures = spark.createDataFrame([("f", doc["post_url"], "v", "public_views", "views", 12, at(3600), at(3600), at(3600), None)],
                                     "forecast_id string, post_url string, version string, source string, metric string, actual bigint, observed_at timestamp, observation_started_at timestamp, observation_completed_at timestamp, available_at timestamp")
    decl = spark.createDataFrame([("f", True, None)], "forecast_id string, first_read_declared boolean, history_complete_declared boolean")
    out = reports.evaluate_forecasts(tables["forecasts"], tables["inputs"], tables["predictions"], captures, decl)
    assert out["evaluations"].first().evaluation_status == "exact_target_observation" and out["models"].first().absolute_error == 2


def test_rolling_counter_files(spark, tmp_path):
    doc = {"metric": "m", "window_days": 90, "impression_target": 500, "verified_follower_target": 5, "source": "s",
           "observations": [{"observed_at": "2026-01-01T00:00:00Z", "source": "s", "replies_excluded": True, "verified_home_impressions_90d": 4, "verified_followers": 2}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    got, _ = readers.rolling_counters(spark, str(tmp_path))
    assert got.first().verified_home_impressions_90d == 4 and got.first().window_days == 90


def test_fingerprints_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    found = readers.file_fingerprints(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    pinned = spark.createDataFrame([("a.txt", hashlib.sha256(b"one").hexdigest()), ("b.txt", "x"), ("c.txt", "y")], "path string, sha256 string")
    diff = readers.manifest_diff(pinned, found)
    assert rows(diff.select("path", "status"), "path") == [("a.txt", "UNCHANGED"), ("b.txt", "CHANGED"), ("c.txt", "DELETED")]
    assert readers.diff_counts(diff).count() == 3


def test_large_files_are_streamed(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"x" * 10)
    (tmp_path / "with space.bin").write_bytes(b"y" * 100_000)
    with open(tmp_path / "sparse.bin", "wb") as out:
        out.seek((3 << 30) - 1)
        out.write(b"z")
    want = {p.name: (p.stat().st_size, subprocess.run(["sha256sum", p], capture_output=True, text=True).stdout[:64]) for p in tmp_path.iterdir()}
    got = {r.path.split("/")[-1]: (r.bytes, r.sha256) for r in readers.file_fingerprints(spark, str(tmp_path), 1000).collect()}
    assert got == want


def test_one_of_many_starters_wins(spark, tmp_path):
    module = tmp_path / "steps.py"
    module.write_text("RATE = 1\n")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, v string")
    make = lambda: ExperimentPlan(spark, str(tmp_path / "plan"), [module])
    make().freeze({"epochs": 3}, {"rows": df}, {})
    module.write_text("RATE = 2\n")
    with pytest.raises(ValueError, match="code"):
        make().start({"epochs": 3}, {"rows": df}, {})
    module.write_text("RATE = 1\n")
    with pytest.raises(ValueError, match="inputs"):
        make().start({"epochs": 3}, {"rows": df.distinct()}, {})

    def start(_):
        try:
            make().start({"epochs": 3}, {"rows": df}, {})
        except FileExistsError:
            return False
        return True

    with ThreadPoolExecutor(10) as pool:
        assert sum(pool.map(start, range(10))) == 1
    assert [p.name for p in (tmp_path / "plan").iterdir() if p.name.startswith(".")] == []


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(900, "m", 1.0), (3600, "m", 2.0)], "cutoff_seconds int, model string, prediction double")
    target = str(tmp_path / "out")
    writers.export_predictions(df, target)
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(Exception):
        writers.export_predictions(df, target)
    with pytest.raises(ValueError):
        writers.write_new(df, target, [target + "/"])
    writers.write_reports({"a": df}, str(tmp_path / "reports"))


def test_experiment_is_consumed_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, x double")
    plan = ExperimentPlan(spark, str(tmp_path / "plan"))
    plan.freeze({"epochs": 3}, {"rows": df}, {"n": 2})
    with pytest.raises(ValueError, match="inputs"):
        plan.start({"epochs": 3}, {"rows": df.filter("id = 1")}, {"n": 2})
    with pytest.raises(ValueError, match="config"):
        plan.start({"epochs": 4}, {"rows": df}, {"n": 2})
    plan.start({"epochs": 3}, {"rows": df.repartition(3)}, {"n": 2})
    with pytest.raises(Exception):
        plan.start({"epochs": 3}, {"rows": df}, {"n": 2})
    plan.freeze_models({"w": [1, 2]})
    with pytest.raises(ValueError):
        plan.open_test({"w": [1, 3]})
    plan.open_test({"w": [1, 2]})
    with pytest.raises(Exception):
        plan.open_test({"w": [1, 2]})


def test_times_and_counts(spark):
    texts = ["2026-01-01T00:00:00Z", "2026-01-01T05:30:00+05:30", "2025-12-31T01:00:00-23:00", "2026-01-01T00:00:00", "2026-01-01T00:00:00.1234567Z", "2026-01-01", "2026-13-01T00:00:00Z", "2026-01-01T00:00Z", "2026-01-01T00:00:00+24:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    strict = [r[0] for r in df.select(times.strict_instant(F.col("t"))).collect()]
    zoned = [r[0] for r in df.select(times.zoned_instant(F.col("t"))).collect()]
    loose = [r[0] for r in df.select(times.seconds_instant(F.col("t"))).collect()]
    assert [s is not None for s in strict] == [True, True, True, False, False, False, False, False, False]
    assert strict[0] == strict[1] == strict[2] and zoned[7] == strict[0] and loose[4] is not None
    raw = spark.createDataFrame([("5",), ("1.0",), ("true",), ("-1",), ("9007199254740992",), (None,)], "r string")
    assert [r[0] for r in raw.select(numeric.count_from_text(F.col("r"))).collect()] == [5, None, None, None, None, None]
    assert [r[0] for r in raw.select(numeric.count_is_bad(F.col("r"))).collect()] == [False, True, True, True, True, False]
    nums = spark.createDataFrame([("8.64e4",), ("NaN",), ("Infinity",), ("1e999",), ("true",)], "r string")
    assert [r[0] for r in nums.select(numeric.number_from_text(F.col("r"))).collect()] == [86400.0, None, None, None, None]
    urls = ["https://x.com/a/status/12", "https://twitter.com/i/web/status/12/", "https://x.com.evil/a/status/12", "http://x.com/a/status/12", "https://x.com/a/status/012"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(links.post_id(F.col("u"))).collect()] == ["12", "12", None, None, None]


def test_update_plan_and_record(spark):
    t = {
        "accounts": spark.createDataFrame([("a", "https://x.com/a/status/1", "public-v1", [])], "account string, launch_post string, quality_rubric string, changes array<string>"),
        "followers": spark.createDataFrame([("a", at(0), 10), ("a", at(60), 12)], "account string, observed_at timestamp, total bigint"),
        "blues": spark.createDataFrame([("a", at(30), 3)], "account string, observed_at timestamp, count bigint"),
        "cohorts": spark.createDataFrame([("a", 1, None, 1, 0, 0, at(50), None)], "account string, observed_arrivals bigint, confirmed_new_followers bigint, high bigint, not_high bigint, unknown bigint, window_ended_at timestamp, classified_at timestamp"),
    }
    state = progress.material_state(t["accounts"], t["followers"], t["blues"], t["cohorts"])
    none = state.filter("false").select("*", F.lit(at(0)).alias("verified_at"))
    first = progress.plan_updates(state, none, F.lit(at(100))).first()
    assert first.should_update and first.changed_fields == list(progress.REPORT_ORDER)
    same = progress.plan_updates(state, state.withColumn("verified_at", F.lit(at(90))), F.lit(at(100))).first()
    assert (same.should_update, same.reason) == (False, "no_material_change")
    older = state.withColumn("total_followers", F.lit(11).cast("bigint")).withColumn("verified_at", F.lit(at(90)))
    wait = progress.plan_updates(state, older, F.lit(at(100))).first()
    assert (wait.reason, wait.changed_fields, wait.not_before is not None) == ("operating_interval", ["total_followers"], True)
    due = progress.plan_updates(state, older, F.lit(at(4000)))
    assert due.first().reason == "material_change"
    plans = due.select("*", F.lit("https://x.com/a/status/1").alias("launch_post"), F.lit(at(4000)).alias("planned_at"))
    history = spark.createDataFrame([("a", "old", at(90))], "account string, fingerprint string, verified_at timestamp")
    seen = spark.createDataFrame([("a", True, "browser", "thread_reply", "https://x.com/a/status/2", "https://x.com/a/status/1", at(4100), "seen")],
                                 "account string, confirmed boolean, evidence_source string, method string, url string, parent string, verified_at timestamp, observation string")
    assert progress.record_publication(history, plans, seen).count() == 1
    assert progress.record_publication(history, plans, seen.withColumn("confirmed", F.lit(False))).isEmpty()
    assert progress.record_publication(history, plans, seen.withColumn("verified_at", F.lit(at(3999)))).isEmpty()
    base = progress.legacy_baseline(spark.createDataFrame([("a", at(59), at(59))], "account string, reported_at timestamp, verified_at timestamp"), t["followers"]).first()
    assert base.total_followers == 10
