import hashlib
import math
import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from tallyscope.functions import text
from tallyscope.operators import answers, components, leakage, splits, validation
from tallyscope.plans import fitting, reports

from .conftest import at, rows

QA = "question string, human_answers array<string>, chatgpt_answers array<string>"


def test_components_match_brute_force(spark):
    draw = random.Random(11)
    edges = [(f"q{draw.randint(0, 60):02d}", f"z{draw.randint(0, 70):02d}") for _ in range(70)] + [("q99", "zz")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a string, b string").repartition(6)
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_long_chain_and_star(spark):
    chain = [(f"q{i:03d}", f"q{i + 1:03d}") for i in range(120)] + [("q500", f"q{i}") for i in range(600, 700)]
    got = components.connected_components(spark.createDataFrame(chain, "a string, b string"), "a", "b")
    assert rows(got.groupBy("component").count(), "component") == [("q000", 121), ("q500", 101)]


def test_hubs_are_cut_into_parts(spark):
    draw = random.Random(4)
    hub = [(0, k) for k in range(1, 400)] + [(5000, k) for k in range(300, 700)]
    rest = [(draw.randint(1000, 1400), draw.randint(1000, 1400)) for _ in range(150)] + [(7, 7), (None, 3), (8, None), (0, 1)]
    df = spark.createDataFrame(hub + rest, "a bigint, b bigint").repartition(7)
    want = rows(components.connected_components(df, "a", "b"), "node")
    assert [c for n, c in want if n in (0, 399, 699, 5000)] == [0, 0, 0, 0]
    for limit in (3, 40):
        assert rows(components.connected_components(df, "a", "b", hub_edges=limit), "node") == want
    edges = df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    settled, larger, smaller = components.survey(edges, 40)
    assert not settled and larger == {0: 10} and smaller == {5000: 10}
    # Rows of a hub are spread over its parts.
    joined = components.beside_minimum(edges, smaller).filter("u = 5000")
    assert joined.count() == 400 and joined.select("m").distinct().count() == 1


def test_transitive_merge_survives_conflict_exclusion(spark):
    data = [("One", ["same  Answer"], []), ("two", ["x"], ["SAME answer", "y"]), ("three", ["y2"], ["y"]), ("four", ["solo", None, "  "], [])]
    out = reports.origin_dataset(spark.createDataFrame(data, QA), 5)
    groups = {r.group: r.group_id for r in out["groups"].collect()}
    assert len(groups) == 4 and len(set(groups.values())) == 2
    status = {r.status: r.n for r in out["answer_status"].groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert status == {"conflicting_labels": 1, "same_label_duplicates": 1, "single": 3}
    counts = {(r.label, r.state): r.n_occurrences for r in out["occurrences"].collect()}
    assert counts[0, "missing_answer"] == 1 and counts[0, "empty_answer"] == 1 and counts[0, "usable"] == 4


def test_split_is_invariant_to_order_and_groups_stay_whole(spark):
    ids = [f"g{i}" for i in range(101)]
    ordered = sorted(ids, key=lambda g: hashlib.sha256(f"7:{g}".encode()).hexdigest())
    want = {g: "train" if i < 70 else "validation" if i < 85 else "test" for i, g in enumerate(ordered)}
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(g,) for g in ids + ids], "g string").repartition(5)
    assert {r.g: r.split for r in splits.hash_split(df, "g", 7).collect()} == want
    assert splits.straddling_groups(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "g string, split string"), "g").count() == 1


def brute_features(answer):
    value = " ".join(unicodedata.normalize("NFKC", answer).casefold().split())
    sums = {}
    for n in (2, 3, 4):
        for i in range(len(value) - n + 1):
            h = int.from_bytes(hashlib.blake2b(value[i : i + n].encode(), digest_size=8, person=b"hc3char_v1").digest(), "little")
            sums[h % 16384] = sums.get(h % 16384, 0) + (-1 if h >= 2**63 else 1)
    norm = math.sqrt(sum(v * v for v in sums.values()))
    return {k: v / norm for k, v in sums.items() if v} if norm else {}


def test_normalisation_and_hashed_features(spark):
    samples = ["Ｆｕｌｌ  width ﬁne Straße", "中文字符测试" * 20, "a", "", "aaaa aaaa"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").withColumn("n", text.normalise("s"))
    got = df.withColumn("f", text.hashed_features("n")).orderBy("i").collect()
    assert got[0].n == "full width fine strasse"
    for r in got:
        want = brute_features(r.s)
        assert list(r.f["indices"]) == sorted(want) and np.allclose(r.f["values"], [want[k] for k in sorted(want)])
    groups = df.select(text.text_groups(F.col("n")).alias("g")).collect()
    assert set(groups[1].g) == {"contains_cjk", "predominantly_cjk_letters", "short_le280_codepoints"}
    assert set(groups[2].g) == {"no_cjk", "short_le280_codepoints"}


def test_logistic_matches_brute_force_and_gates(spark):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(60, 3)), draw.integers(0, 2, 60)
    part = ["train"] * 40 + ["validation"] * 20
    data = [([0, 1, 2], [float(v) for v in a], int(b), p) for a, b, p in zip(x, y, part)]
    df = spark.createDataFrame(data, "indices array<int>, values array<double>, label int, part string").repartition(5)
    model = fitting.fit_logistic(df, 3, epochs=4)
    theta, m, v, best = np.zeros(4), 0, 0, None
    xa = np.column_stack([x, np.ones(60)])
    for epoch in range(1, 5):
        g = xa[:40].T @ (1 / (1 + np.exp(-xa[:40] @ theta)) - y[:40]) / 40
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        z = xa[40:] @ theta
        for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 8.0):
            s = z / t
            loss = np.mean(np.maximum(s, 0) - y[40:] * s + np.log1p(np.exp(-np.abs(s))))
            key = (loss, epoch, abs(math.log(t)), t)
            if best is None or key < best[0]:
                best = (key, theta.copy())
    assert np.allclose(np.append(model.weights, model.bias), best[1]) and model.temperature == best[0][3]
    big = fitting.LogisticModel(np.zeros(text.BUCKETS), 2.0, 1.0, 1, 0.0)
    long_cjk = "测" * 300
    asks = spark.createDataFrame([(1, long_cjk, "qa", "binary"), (2, long_cjk, "x", "binary"), (3, "测", "qa", "binary"), (4, "a" * 300, "qa", "binary"), (5, long_cjk, "qa", "three")], "i int, answer string, domain string, task string")
    got = {r.i: (r.decision, r.reason) for r in reports.classify_answers(asks, big, "qa").collect()}
    assert got[1][0] == "ai_generated" and {got[i][0] for i in (2, 3, 4, 5)} == {"unknown"}
    assert got[3][1].startswith("short_text") and got[4][1].startswith("non_Chinese") and got[5][1].startswith("mixed")


def test_origin_benchmark_end_to_end(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    data = [(f"q{i}", [f"{words[i % 5]} human {i} text"], [f"{words[i % 5]} machine generated {i} answer text"]) for i in range(40)]
    out = reports.origin_dataset(spark.createDataFrame(data, QA), 3)
    result = reports.origin_benchmark(out["rows"], epochs=3)
    best = result["metrics"].filter("model = 'hashed_text' AND text_group = 'all'").first()
    assert best.accuracy > 0.9 and result["selected"].count() == 2


PRED = ("prediction_id string, platform string, post_id string, post_version string, post_url string, published_at timestamp, captured_at timestamp, prediction_at timestamp, generated_at timestamp, "
        "available_at timestamp, model_id string, weights_sha256 string, p_human_written double, p_ai_generated double, p_mixed double, downstream_at timestamp, content_group_id string, strategy string, "
        "fold_id string, training_cutoff timestamp, trained_at timestamp")


def prediction(name="p", **change):
    base = dict(prediction_id=name, platform="x", post_id="5", post_version="v", post_url="https://x.com/a/status/5", published_at=at(1000), captured_at=at(1001), prediction_at=at(2000), generated_at=at(1500),
                available_at=at(1600), model_id="m", weights_sha256=None, p_human_written=0.2, p_ai_generated=0.7, p_mixed=0.1, downstream_at=None, content_group_id="g", strategy="out_of_fold", fold_id="1",
                training_cutoff=at(900), trained_at=at(950)) | change
    return tuple(base.values())


def origin(spark, predictions, training=None, features=None):
    t = training if training is not None else [("p", "x", "1", at(1), at(2), at(3), "h")]
    f = features if features is not None else [("p", "t", "text", "v", at(1100), at(1200), None)]
    return reports.origin_features(
        spark.createDataFrame(predictions, PRED),
        spark.createDataFrame(f, "prediction_id string, name string, kind string, version string, captured_at timestamp, available_at timestamp, latest_event_at timestamp"),
        spark.createDataFrame(t, "prediction_id string, platform string, post_id string, published_at timestamp, latest_input_available_at timestamp, label_available_at timestamp, content_group_id string"),
    )


def test_soft_features_of_a_clean_record(spark):
    out = origin(spark, [prediction()])
    row = out["features"].first()
    assert row.authorship_p_ai_generated == 0.7 and not row.authorship_missing and 0 < row.authorship_entropy < 1
    assert out["audits"].first().strict_cross_post_eligible
    assert out["estimates"].first().estimated_content_origin == "ai_generated"


def test_leaks_are_refused(spark):
    def rule(**kw):
        return origin(spark, [prediction()], **kw)["audits"].first()

    assert not rule(training=[("p", "x", "5", at(1), at(2), at(3), "h")]).auxiliary_eligible
    assert not rule(training=[("p", "x", "1", at(1), at(2), at(3), "g")]).auxiliary_eligible
    assert rule(training=[("p", "x", "1", at(1), at(2), at(901), "h")]).rule == "future_training_material"
    assert rule(training=[("p", "x", "1", at(1), at(2), at(3), "h"), ("p", "x", "1", at(1), at(2), at(3), "h")]).rule == "training_groups_repeated"
    late = origin(spark, [prediction()], features=[("p", "t", "text", "v", at(1100), at(1501), None)])
    assert late["rejected_features"].first().rule == "late_capture_or_availability" and late["features"].isEmpty()
    named = origin(spark, [prediction()], features=[("p", "Label", "text", "v", at(1100), at(1200), None)])
    assert named["rejected_features"].first().rule == "feature_is_a_label"
    bad = origin(spark, [prediction("a", p_mixed=0.2), prediction("b", post_url="https://x.com/a/status/6"), prediction("c", available_at=at(2001)), prediction("d", published_at=at(2500))])
    assert rows(bad["rejected_predictions"].select("prediction_id", "rule"), "prediction_id") == [("a", "probabilities"), ("b", "native_identity"), ("c", "prediction_clock_order"), ("d", "published_after_prediction")]


def test_origin_scores(spark):
    preds = spark.createDataFrame([prediction(), prediction("q", post_id="6", post_url=None, p_human_written=0.0, p_ai_generated=0.9, p_mixed=0.1)], PRED)
    proof = "evidence array<struct<method:string,reference:string,available_at:timestamp>>"
    labels = spark.createDataFrame(
        [("x", "5", "v", "text.body", "p", "ai_generated", at(10), [("author_disclosure", "r", at(5))]), ("x", "6", "v", "text.body", "p", "human_written", at(10), [("author_disclosure", "r", at(5))]),
         ("x", "7", "v", "text.body", "p", "mixed", at(10), [("author_disclosure", "r", at(11))])],
        "platform string, post_id string, post_version string, scope string, label_policy string, content_origin string, label_available_at timestamp, " + proof)
    out = reports.origin_evaluate(preds, labels, F.lit(at(3000)))
    a, b = out["scores"].orderBy("prediction_id").collect()
    assert abs(a.brier - (0.04 + 0.09 + 0.01)) < 1e-12 and abs(a.log_loss + math.log(0.7)) < 1e-12
    assert b.log_loss is None and b.log_loss_reason == "infinite_for_zero_target_probability"
    assert out["rejected_labels"].first().rule == "evidence_after_label"
    assert reports.origin_evaluate(preds, labels, F.lit(at(1999)))["scores"].isEmpty()


def test_retained_answers_feed_the_summary(spark):
    data = [("q", 0, "a", "t", None), ("q", 0, "a", "t", None)]
    df = spark.createDataFrame(data, "group string, label int, answer_sha256 string, text string, excluded_reason string")
    assert answers.answer_status(df).first().status == "same_label_duplicates"


def test_quarantine_layout_and_strict_mode(spark):
    import pytest

    df = spark.createDataFrame([(1, 5), (2, -1)], "id int, n bigint")
    ok, bad = validation.split(df, [validation.count_rule("n")])
    assert ok.count() == 1
    row = validation.as_quarantine(bad, "t", ["id"]).first()
    assert (row.table, row.key, row.rule, row.detail) == ("t", "2", "n_not_a_count", '{"id":2,"n":-1}')
    with pytest.raises(ValueError, match="n_not_a_count"):
        validation.require(df, [validation.count_rule("n")])
    assert leakage.shared_training_leaks(spark.createDataFrame([("x", "1"), ("x", "2")], "platform string, post_id string"), spark.createDataFrame([("x", "2")], "platform string, post_id string")).count() == 1


def test_stable_texts_stay_out_of_python(spark):
    samples = ["Straße ÄÖÜ «Été» – “q”", "Привет МИР", "中文、テスト 한글", "plain  ASCII\ttext", "ﬁne", "é", "Σς", None, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    listed = text.normalise_all(F.array("s", F.lit("Ｘ y"), "s"))
    got = df.select("s", text.normalise("s").alias("n"), listed.alias("l"), text._unstable(F.col("s")).alias("other")).orderBy("i").collect()
    for r in got:
        want = text._normal_form(r.s)
        assert r.n == want and r.l == [want, "x y", want]
    assert [r.other for r in got] == [False] * 4 + [True] * 3 + [None, False]


def test_features_leave_in_pieces(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(text, "PIECE", 40)
    monkeypatch.setattr(text, "MEMO", 5)
    texts = ["some words here", "", "other words", None, "last ones of all", "x"]
    pieces = list(text.hashed_features.func(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert len(pieces) == 3 and max(map(len, pieces)) < len(texts)
    flat = [dict(zip(i, v)) for p in pieces for i, v in zip(p["indices"], p["values"])]
    for t, got in zip(texts, flat, strict=True):
        want = brute_features(t or "")
        assert sorted(got) == sorted(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_letters_and_chinese_are_counted(spark):
    df = spark.createDataFrame([("aé1 中文!𝒳",), ("",), ("12",)], "s string")
    got = [tuple(r) for r in df.select(text.letter_count(F.col("s")), text.cjk_count(F.col("s"))).collect()]
    assert got == [(5, 2), (0, 0), (0, 0)]


def test_only_shared_answers_link_groups(spark, monkeypatch):
    data = [("q1", "a"), ("q1", "b"), ("q2", "b"), ("q2", "b"), ("q2", "c"), ("q3", "c"), ("q4", "d"), ("q4", "e"), ("q5", "f"), ("q5", None), (None, "f")]
    seen = []
    real = answers.connected_components
    monkeypatch.setattr(answers, "connected_components", lambda edges, *names: seen.append(edges.count()) or real(edges, *names))
    got = answers.question_groups(spark.createDataFrame(data, "group string, answer_sha256 string"))
    assert rows(got, "group") == [("q1", "q1"), ("q2", "q1"), ("q3", "q1"), ("q4", "q4"), ("q5", "q5")]
    # An edge for each answer of the graph would be nine; those of one group link nothing.
    assert seen == [2]


def test_dataset_reads_occurrences_once(spark):
    data = [("q0", ["ﬁrst", None, " "], None), ("q1", [], ["Ｏther", "first"]), ("q2", None, ["third"])]
    qa = spark.createDataFrame(data, QA)
    out = reports.origin_dataset(qa, 3, with_text=False)
    counts = {(r.label, r.state): r.n_occurrences for r in out["occurrences"].collect()}
    assert counts == {(0, "usable"): 1, (0, "missing_answer"): 1, (0, "empty_answer"): 1, (1, "usable"): 3}
    assert "text" not in out["rows"].columns and "text" in reports.origin_dataset(qa, 3)["rows"].columns
    # The rows stand on written tables: no text is normalised again by what reads them.
    for name in ("rows", "summary", "coverage"):
        assert "ArrowEvalPython" not in out[name]._jdf.queryExecution().toString()
    assert sorted(r.label for r in out["rows"].collect()) == [1, 1]


def test_sparse_rows_are_packed_without_loss(monkeypatch):
    import pandas as pd

    draw = np.random.default_rng(4)
    monkeypatch.setattr(fitting, "BLOCK_NUMBERS", 50)
    sizes = [0, 7, 0, 30, 120, 1, 0]
    frame = pd.DataFrame({
        "indices": [draw.integers(0, 16384, n).astype(np.int32) for n in sizes], "values": [draw.integers(-3, 4, n) / 7.3 for n in sizes],
        "label": [0, 1, 1, 0, 1, 0, 1], "part": ["train", "validation", "train", "train", "validation", "train", "train"]})
    wild = frame.assign(indices=[np.arange(70_000)] * 7, values=[draw.normal(size=70_000) for _ in range(7)])
    for data in (frame, wild):
        blocks = pd.concat(fitting._row_blocks(iter([data, data.iloc[:0]])))
        assert len(blocks) >= 2
        parts = [fitting._unpacked(r) for r in blocks.itertuples(index=False)]
        assert np.array_equal(np.concatenate([p[1] for p in parts]), np.concatenate(data["indices"].to_list()))
        assert np.array_equal(np.concatenate([p[2] for p in parts]), np.concatenate(data["values"].to_list()))
        assert np.array_equal(np.concatenate([p[3] for p in parts]), data["label"]) and np.array_equal(np.concatenate([p[4] for p in parts]), data["part"] == "train")
        assert sum(len(p[3]) for p in parts) == 7 and all(len(p[0]) == len(p[1]) for p in parts)
    # Two bytes for each value of hashed features.
    assert sum(map(len, pd.concat(fitting._row_blocks(iter([frame])))["codes"])) == 2 * sum(sizes)


def test_texts_are_hashed_together(monkeypatch):
    draw = np.random.default_rng(6)
    letters = np.array(list("abc de\U0001d4b3中ß"))
    texts = [None, "", "a", "ab", "𝒳", *("".join(draw.choice(letters, n)) for n in draw.integers(0, 60, 40)), "", "x" * 333, "".join(draw.choice(letters, 500)), None]
    for stretch, table in ((7, 1 << 22), (100, 1 << 22), (100, 0), (10_000, 1 << 22)):
        monkeypatch.setattr(text, "STRETCH", stretch)
        monkeypatch.setattr(text, "TABLE", table)
        monkeypatch.setattr(text, "MEMO", 50)
        groups = list(text.hashed_sums(texts, {}))
        assert sum(len(sizes) for sizes, _, _ in groups) == len(texts)
        found = []
        for sizes, index, sums in groups:
            values = sums / np.repeat(text.lengths(sizes, sums), sizes)
            ends = np.cumsum(sizes)[:-1]
            found += list(zip(np.split(index, ends), np.split(values, ends)))
        for t, (index, values) in zip(texts, found, strict=True):
            want = text._hashed(t or "", {})
            assert np.array_equal(index, want[0]) and np.array_equal(values, want[1])
    assert not list(text.hashed_sums([], {}))


def test_blocks_of_texts_are_small_and_whole():
    import pandas as pd

    draw = np.random.default_rng(7)
    words = ["".join(draw.choice(list("abcdefghijklmnop"), draw.integers(2, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choice(words, n)) for n in draw.integers(0, 200, 300)] + [None, " ".join(draw.choice(words, 30_000))]
    frame = pd.DataFrame({"text": texts, "label": draw.integers(0, 2, 302), "part": draw.choice(["train", "validation"], 302)})
    blocks = pd.concat(fitting._squeezed(fitting._text_blocks)(iter([frame, frame.iloc[:0]])))
    parts = [fitting._unpacked(fitting._loosened(r)) for r in blocks.itertuples(index=False)]
    want = [text._hashed(t or "", {}) for t in texts]
    assert len(blocks) >= 3 and [n for p in parts for n in np.bincount(p[0], minlength=len(p[3]))] == [len(w[0]) for w in want]
    for at, name in ((1, "indices"), (2, "values")):
        assert np.array_equal(np.concatenate([p[at] for p in parts]), np.concatenate([w[at - 1] for w in want])), name
    assert np.array_equal(np.concatenate([p[3] for p in parts]), frame["label"]) and np.array_equal(np.concatenate([p[4] for p in parts]), frame["part"] == "train")
    # Six bytes a number before.
    assert blocks.map(len).to_numpy().sum() < 2 * sum(len(w[0]) for w in want)
    # Sparse rows of any values are kept as they are.
    sparse = pd.DataFrame({"indices": [np.array([9, 2, 70_000]), np.empty(0, int), np.array([1])], "values": [np.array([0.1, -2.5, 1e300]), np.empty(0), np.array([3.0])], "label": 1, "part": "train"})
    index, value = [fitting._unpacked(fitting._loosened(r)) for r in pd.concat(fitting._squeezed(fitting._row_blocks)(iter([sparse]))).itertuples(index=False)][0][1:3]
    assert index.tolist() == [9, 2, 70_000, 1] and value.tolist() == [0.1, -2.5, 1e300, 3.0]


def test_features_of_the_benchmark_stay_in_their_tasks(spark, monkeypatch):
    seen, kept = [], []
    real, frame = fitting._fit_blocks, type(spark.range(0))
    monkeypatch.setattr(fitting, "_fit_blocks", lambda rows, columns, *rest: seen.append((rows, columns)) or real(rows, columns, *rest))
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *level: kept.append((self.columns, level)) or persist(self, *level))
    data = [(f"q{i}", [f"alpha human {i} text"], [f"beta machine generated {i} answer"]) for i in range(30)]
    rows = reports.origin_dataset(spark.createDataFrame(data, QA), 3)["rows"]
    reports.origin_benchmark(rows, epochs=2)
    # Texts go to the fit, not their features, and blocks are kept on disk alone.
    assert [c for _, c in seen] == [["text"], ["indices", "values"]]
    assert "ArrowEvalPython" not in seen[0][0]._jdf.queryExecution().toString()
    assert [(l[0].useDisk, l[0].useMemory) for c, l in kept if "palette" in c] == [(True, False)] * 2
    plain = rows.withColumn("_f", text.hashed_features("text")).select("answer_sha256", "label", "text", F.col("split").alias("part"), "_f.indices", "_f.values")
    fit = plain.filter("part <> 'test'")
    one, two = fitting.fit_logistic(fit, text.BUCKETS, 2), fitting.fit_texts(fit, 2)
    assert np.allclose(one.weights, two.weights, rtol=0, atol=1e-12) and one.selected_epoch == two.selected_epoch
    both = plain.select(one.logit_udf()("indices", "values").alias("a"), one.text_logit_udf()("text").alias("b")).collect()
    assert len(both) == rows.count() and all(abs(r.a - r.b) < 1e-12 for r in both)


def test_texts_of_the_dataset_are_dealt_once(spark):
    data = [("q1", ["One  answer", "same", "", None], ["other"]), ("q2", ["same"], ["third", "clash"]), ("q3", ["clash"], [])]
    out = reports.origin_dataset(spark.createDataFrame(data, QA), 3)
    assert sorted(r.text for r in out["rows"].collect()) == ["one answer", "other", "same", "third"]
    # Grouping and splitting read rows without texts.
    for name in ("answer_status", "occurrences", "summary", "coverage"):
        assert "text" not in out[name].columns and "first(text" not in out[name]._jdf.queryExecution().toString()
    assert out["rows"]._jdf.queryExecution().optimizedPlan().toString().count("first(text") == 1


def test_epochs_of_small_fits_have_few_tasks(spark, monkeypatch):
    seen, real = [], fitting.reduce_vector
    monkeypatch.setattr(fitting, "reduce_vector", lambda rows, *rest: seen.append(rows.rdd.getNumPartitions()) or real(rows, *rest))
    data = spark.range(400).selectExpr("concat('text ', id % 7, ' of ', id) AS text", "cast(id % 2 AS int) AS label", "if(id % 5 = 0, 'validation', 'train') AS part")
    cores = spark.sparkContext.defaultParallelism
    few = fitting.fit_texts(data.repartition(40), 2)
    assert seen == [cores] * 3
    monkeypatch.setattr(fitting, "TASK_BLOCKS", 1)
    many = fitting.fit_texts(data.repartition(40), 2)
    assert seen[3:] == [40] * 3 and np.allclose(few.weights, many.weights, rtol=0, atol=1e-12)


def test_edges_of_answers_are_written_once(spark, monkeypatch):
    plans, real = [], answers.connected_components
    monkeypatch.setattr(answers, "connected_components", lambda edges, *names: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or real(edges, *names))
    answers.question_groups(spark.createDataFrame([("q1", "a"), ("q2", "a"), ("q3", "b")], "group string, answer_sha256 string")).collect()
    assert len(plans) == 1 and "Join" not in plans[0]
