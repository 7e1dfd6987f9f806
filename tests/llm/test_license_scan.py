import random
import re

import pytest
from pyspark.sql import types as T

from tallyscope.llm.license_scan import BASE, EXPRESSION_STRENGTH, FAMILIES, NOTICES, TERMS, evaluated, labelled, postfix, scan_licenses, terms_of

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("places", T.StringType())]
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """Counts and labels by comparing word lists at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = [(i, label) for phrase, label in BASE.items() for i in at(phrase)]
    strength = {label: 0.5 for _, label in base}
    for phrase, label, s in NOTICES:
        if at(phrase):
            strength[label] = max(s, strength.get(label, 0))
    labels = set(strength)
    for line in re.findall(r"(?i)(?<![0-9a-z\x80-\U0010FFFF])(?:spdx-license-identifier|license-expression):([^\n\r]*)", text or ""):
        value = parsed(re.findall(r"[A-Za-z0-9.+:-]+|[()]", line))
        if value is None:
            labels.add("unparsed-expression")
            continue
        for name in value[0]:
            strength[name] = max(EXPRESSION_STRENGTH, strength.get(name, 0))
        labels |= value[0] | {"terms:" + TERMS[value[1]]}
    score = 1.0
    for label in sorted(strength):
        score *= 1 - strength[label]
    starts = [i for i, _ in base]
    join = lambda x: ",".join(sorted(set(x)))
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), join(x for _, x in base), join(labels), 1 - score)


def parsed(tokens):
    """Recursive descent, tried on every beginning of the tokens from the longest down."""
    for n in range(len(tokens), 0, -1):
        try:
            value, rest = either(tokens[:n])
            if not rest:
                return value
        except (IndexError, ValueError):
            pass
    return None


def either(tokens):
    left, rest = both(tokens)
    while rest and rest[0].lower() == "or":
        right, rest = both(rest[1:])
        left = (left[0] | right[0], min(left[1], right[1]))
    return left, rest


def both(tokens):
    left, rest = single(tokens)
    while rest and rest[0].lower() == "and":
        right, rest = single(rest[1:])
        left = (left[0] | right[0], max(left[1], right[1]))
    return left, rest


def single(tokens):
    if tokens[0] == "(":
        value, rest = either(tokens[1:])
        if rest[0] != ")":
            raise ValueError
        return value, rest[1:]
    name = tokens[0].lower()
    if name in ("and", "or", "with", ")"):
        raise ValueError
    level = terms_of(name)
    if len(tokens) > 1 and tokens[1].lower() == "with":
        exception = tokens[2].lower()
        if exception in ("and", "or", "with", "(", ")"):
            raise ValueError
        return ({name, exception}, level if level in (0, len(TERMS) - 1) else level - 1), tokens[3:]
    return ({name}, level), tokens[1:]


def test_shunting_yard_equals_recursive_descent():
    rnd = random.Random(2)
    pool = ["MIT", "GPL-2.0-only", "LGPL-2.1+", "CC0-1.0", "LicenseRef-x", "AND", "or", "OR", "with", "WITH", "(", ")", "Classpath-exception-2.0"]
    valid = 0
    for _ in range(12_000):
        tokens = [rnd.choice(pool) for _ in range(rnd.randint(1, 11))]
        want, steps = parsed(tokens), postfix(tokens)
        assert bool(steps) == (want is not None), tokens
        if steps:
            names, terms = evaluated(steps)
            assert (set(names), terms) == (want[0], TERMS[want[1]]), tokens
            valid += len(steps) > 2
    assert valid > 500


@pytest.mark.parametrize(
    "text,terms",
    [
        ("MIT OR GPL-3.0-only", "permissive"),
        ("MIT AND GPL-3.0-only", "copyleft"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "weak-copyleft"),
        ("(MIT OR CC-BY-NC-4.0) AND (LGPL-2.1-only OR GPL-2.0-only)", "weak-copyleft"),
        ("MIT OR CC0-1.0 AND AGPL-3.0-only", "permissive"),
        ("LicenseRef-own", "unknown"),
    ],
)
def test_terms(text, terms):
    assert evaluated(postfix(re.findall(r"[\w.+-]+|[()]", text)))[1] == terms


def test_families_have_terms():
    assert set(FAMILIES.values()) < set(range(len(TERMS)))
    assert terms_of("mitx") == terms_of("") == len(TERMS) - 1 and terms_of("mit") == 1


def corpus():
    rnd = random.Random(4)
    pool = "cc by nc all rights reserved general public license version 2 3 gnu mit apache 0 Lesser ALL Rights CC0 é x".split()
    signs = [" ", "-", "\n", ", ", "  ", ".", "/"]
    texts = ["".join(rnd.choice(pool) + rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += [
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\ncc by",
        "spdx-license-identifier:MIT\r\nLicense-Expression: BSD-3-Clause or or\nxSPDX-License-Identifier: GPL-3.0",
        "SPDX License Identifier: MIT",
        "éSPDX-License-Identifier: MIT ·SPDX-License-Identifier: ISC",
        "SPDX-License-Identifier:", "SPDX-License-Identifier: and", "SPDX-License-Identifier: (MIT", "İ SPDX-License-Identifier: MIT",
        "all rights reserved all rights reserved", "cc by cc by-nc", "ccby cc byé écc by cc\x00by cc_by",
        "", None, " \n\t", "word " * 60_000 + "All rights reserved.", "cc by " * 20_000,
    ]
    return texts


def test_scan_equals_brute_force(spark):
    rows = [(k, t, "z") for k, t in enumerate(corpus())] + [(None, "cc by", None), (3, "cc by", "z"), (3, "cc by", "z")]
    got = labelled(scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    want = [(d, *brute(t)) for d, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-12


def test_places_and_own_phrases(spark):
    df = spark.createDataFrame([(1, "Keep off the grass, please. Off the grass!", "q")], SCHEMA)
    row = scan_licenses(df, base={"off the grass": "lawn"}, notices=(), tags=()).first()
    assert [(p.word, p.label) for p in row.places] == [(1, "lawn"), (5, "lawn")]


def test_empty_table(spark):
    assert labelled(scan_licenses(spark.createDataFrame([], SCHEMA))).collect() == []
