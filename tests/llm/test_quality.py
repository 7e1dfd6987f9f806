import math
import random
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm import quality

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("stratum", T.StringType())]
)
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.StringType())])


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rnd = random.Random(1)
    out = [None, "", " \n\t", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "é #*😀 <b>&| \n x\n x\n x \n\n\n", "same\nsame\nsame", "\x0b\x0c\r q\x85r"]
    for _ in range(30):
        out.append(rnd.choice([" ", "\n"]).join(rnd.choice("ab#") + rnd.choice("ab") for _ in range(rnd.randint(1, 120))))
    return out + ["long words here " * 3000]


def test_counts_equal_brute_force(spark):
    rows = [(k, t, None if k % 3 else "en", "x") for k, t in enumerate(texts())] + [(None, "a", "en", "x"), (4, texts()[4], "en", "x")]
    labels = spark.createDataFrame([(1, 1, "z"), (None, 1, "z"), (2, None, "z")], LABELS)
    got = quality.judge(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute("a" if r.doc_id is None else texts()[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)


def exact_tail(k, n, p):
    q = Fraction(p)
    return float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (0, 2000), (3, 900), (7, 2500), (9, 3000), (5, 5)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.004)).collect():
        want = 1.0 if r.k >= r.n * 0.004 else exact_tail(r.k, r.n, 0.004)
        assert abs(r.p - want) <= 1e-9 * max(want, 1e-3)


def test_cutoffs_hold_the_bound_and_small_strata_keep_all(spark):
    rows, labels = [], []
    for k in range(2600):
        bad = k % 13 == 0
        words = [f"{'abcdefgh'[k % 8]}{j * (k + 7)}word"[:5] for j in range(30)]
        text = " ".join(f"{w}#" if bad else w for w in words)
        rows.append((k, text, "en", ""))
        labels.append((k, 0 if bad else 1, ""))
    rows += [(5000 + k, f"## {k} " * 30, "fr", "") for k in range(4)]
    rows += [(6000 + k, " ".join(f"##{j}x{k}" for j in range(30)), "fr", "") for k in range(4)]
    labels += [(6000, 1, ""), (6001, 1, "")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    good = [got[k] for k in range(2600) if k % 13]
    assert sum(not r.kept for r in good) <= quality.RISK * len(good)
    assert all(got[k].broken == ["symbol_share"] for k in range(0, 2600, 13))
    assert all(got[6000 + k].kept for k in range(4))


def test_empty_tables(spark):
    assert quality.judge(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
