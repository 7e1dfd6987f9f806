import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyscope.llm import periodic_runs
from tallyscope.llm.periodic_runs import digests, find_runs, repeated_tails, runs_of

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType())]
)


def brute(words):
    """All runs from the definition: maximal stretches for every period, then the smallest period of each."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and words[y] == words[y + q]:
                y += 1
            if y > x:
                length = y - x + q
                part = words[x : x + length]
                smaller = any(all(part[i] == part[i + d] for i in range(length - d)) for d in range(1, q))
                if length >= max(6, 4 * q) and not smaller:
                    found.append((x, length, q))
            x = max(y, x + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def spoiled(words, doc):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc, text):
    words = spoiled(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc) if doc is not None else (text or "").split()
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc,
        len(runs),
        *top,
        None if top[0] is None else 1000 * top[1] // top[2],
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def random_words(rnd):
    words = []
    for _ in range(rnd.randint(0, 8)):
        if rnd.random() < 0.6:
            base = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
            words += (base * 9)[: rnd.randint(1, len(base) * 8)]
        else:
            words += [rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 12))]
    return words


def test_runs_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        docs = [random_words(rnd) for _ in range(rnd.randint(1, 5))]
        numbers = [np.array([ord(w) + 1000 * k for w in d], np.int64) for k, d in enumerate(docs)]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        assert runs_of(np.concatenate(numbers), offsets) == [brute(d) for d in docs]


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc"])
def test_every_short_word_string(alphabet):
    rnd = random.Random(5)
    for n in [*range(30), 64, 127, 300]:
        words = [rnd.choice(alphabet) for _ in range(n)]
        assert runs_of(np.array([ord(w) for w in words], np.int64), np.array([0, n])) == [brute(words)]


def test_long_runs_at_all_levels():
    for q in (1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 64, 100):
        for power in (4, 4.5, 6):
            words = list(range(1000, 1017)) + (list(range(q)) * 7)[: int(q * power) + (q < 2) * 2] + [2000, 2001]
            assert runs_of(np.array(words), np.array([0, len(words)])) == [brute(words)]


def test_digests_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(random_words(rnd)), "z") for k in range(120)]
    rows += [(500, None, "z"), (501, "", "z"), (502, " \t\n\x0b\x0c\r", "z"), (503, "é b  x", None), (-7, "a a a a a a a", "z")]
    rows += [(None, "b b b b b b b", "z"), rows[3], rows[3], (504, "x " * 70_000 + "y", "z"), (505, "tick\ttock\n" * 40, "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in digests(find_runs(repeated_tails(df))).collect()), key=repr)
    assert got == sorted((expected(d, t) if (t or "")[:4] != "x x " else long_row(d, t) for d, t, _ in rows), key=repr)


def long_row(doc, text):
    words = text.split()
    assert zlib.crc32(str(doc).encode()) % 10
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, 1, 0, len(words) - 1, 1, 1000 * (len(words) - 1), digest(f"0,{len(words) - 1},1\n"), digest("x y"))


def test_operator_returns_runs_and_text(spark):
    df = spark.createDataFrame([(1, "go a b a b a b a b a end", "q")], SCHEMA)
    row = find_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(1, 9, 2)] and row.collapsed_text == "go a b end" and row.n_words == 11
    assert find_runs(df, length=20).first().runs == []
    with pytest.raises(ValueError):
        find_runs(df, power=3)


def test_empty_table(spark):
    assert digests(find_runs(repeated_tails(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_ordinary_text_ends_after_few_levels():
    rnd = random.Random(9)
    words = np.array([rnd.randint(0, 400) for _ in range(50_000)])
    factors = periodic_runs.Factors(words, np.full(len(words), len(words)), 4)
    levels = 1
    while factors.grow():
        levels += 1
    assert levels <= 5
