"""Licences named in texts: phrases and tags by Aho-Corasick, expressions by a shunting-yard parser.

Texts are lower-cased (A-Z) and reduced to words of letters, digits and everything beyond ASCII, joined by one
space. One automaton over this form finds all phrases at once, overlapping ones too: the words of base phrases,
of notices, and of identifier tags. Where a tag's words stand, a second automaton finds the tag itself in
the text as written, and the rest of its line is read as an expression:

    expression := name | name WITH exception | expression AND expression | expression OR expression | ( expression )

with WITH binding closest and OR loosest, operators in any case. Shunting-yard turns the longest valid beginning
of the line into postfix, which is evaluated to the names it holds and to its terms: the taker may choose the lighter side
of an OR, has to meet both sides of an AND, and an exception lightens what it follows by one step.

The scan is row-local, shuffles nothing and its memory is a small multiple of the longest text. Phrases, notices and tags are
parameters: the automaton is built once a worker.

Labels are those of the base phrases and notices, the names and exceptions of expressions and ``terms:...`` of each. The score is
1 - product of (1 - strength) over a document's labels, from what finds them: an expression 0.95, a notice
its own strength, a base phrase 0.5, terms nothing.

Defined cases: null, empty and blank texts have no words and no places; a tag without a valid expression gives
the label ``unparsed-expression``; a null doc_id stays null; repeated rows are treated alike; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .importance import words_of
from .registry import query, table

# Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Phrase, label, strength.
NOTICES = (
    ("mit license", "mit", 0.7),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("apache license", "apache", 0.7),
    ("apache license version 2 0", "apache-2.0", 0.9),
    ("bsd license", "bsd", 0.7),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("isc license", "isc", 0.7),
    ("boost software license", "bsl", 0.7),
    ("general public license version 2", "gpl-2.0", 0.9),
    ("general public license version 3", "gpl-3.0", 0.9),
    ("affero general public license", "agpl", 0.8),
    ("lesser general public license", "lgpl", 0.8),
    ("mozilla public license", "mpl", 0.8),
    ("eclipse public license", "epl", 0.8),
    ("creative commons attribution", "cc-by", 0.7),
    ("cc by nc", "cc-by-nc", 0.8),
    ("cc by nd", "cc-by-nd", 0.8),
    ("cc by sa", "cc-by-sa", 0.8),
    ("cc0", "cc0", 0.7),
    ("dedicated to the public domain", "public-domain", 0.7),
    ("this is free and unencumbered software", "unlicense", 0.9),
)
TAGS = ("spdx-license-identifier:", "license-expression:")

BASE_STRENGTH, EXPRESSION_STRENGTH = 0.5, 0.95

# From free to unknown; a name takes the terms of the longest family it begins with.
TERMS = ("public-domain", "permissive", "weak-copyleft", "copyleft", "restricted", "unknown")
FAMILIES = {
    "0bsd": 0, "cc0": 0, "unlicense": 0, "public-domain": 0,
    "apache": 1, "bsd": 1, "bsl": 1, "cc-by": 1, "isc": 1, "mit": 1, "zlib": 1,
    "epl": 2, "lgpl": 2, "mpl": 2,
    "agpl": 3, "cc-by-sa": 3, "gpl": 3,
    "cc-by-nc": 4, "cc-by-nd": 4,
}

_TOKEN = re.compile(r"[A-Za-z0-9.+:-]+|[()]")
_BINDS = {"or": 1, "and": 2, "with": 3}


def terms_of(name: str) -> int:
    """Place of a licence name's terms in ``TERMS``."""
    fits = [f for f in FAMILIES if name == f or name.startswith(f) and name[len(f)] in "-+."]
    return FAMILIES[max(fits, key=len)] if fits else len(TERMS) - 1


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard over the longest beginning of ``tokens`` that is an expression; empty if none is."""
    best: list[str] = []
    out: list[str] = []
    stack: list[str] = []
    operand = True
    after_with = simple = False
    for token in tokens:
        word = token.lower()
        if token == "(":
            if not operand or after_with:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            simple = False
        elif word in _BINDS:
            # An exception follows a bare name, and only one.
            if operand or word == "with" and not simple:
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand, after_with = True, word == "with"
        else:
            if not operand:
                break
            out.append(word)
            operand, simple, after_with = False, not after_with, False
        if not operand and "(" not in stack:
            best = out + stack[::-1]
    return best


def evaluated(steps: list[str]) -> tuple[list[str], str]:
    """Sorted names and exceptions of a postfix expression, and its terms."""
    names: set[str] = set()
    stack: list[tuple[int, str]] = []
    for step in steps:
        if step not in _BINDS:
            names.add(step)
            stack.append((terms_of(step), step))
            continue
        right, left = stack.pop(), stack.pop()
        if step == "or":
            level = min(left[0], right[0])
        elif step == "and":
            level = max(left[0], right[0])
        else:
            level = left[0] if left[0] in (0, len(TERMS) - 1) else left[0] - 1
        stack.append((level, ""))
    return sorted(names), TERMS[stack[0][0]]


@lru_cache(maxsize=4)
def _automata(phrases: tuple, tags: tuple):
    import ahocorasick

    words, raw = ahocorasick.Automaton(), ahocorasick.Automaton()
    held: dict[str, list] = {}
    for phrase, label, kind, strength in phrases:
        held.setdefault(f" {phrase} ", []).append((phrase, label, kind, strength))
    for tag in tags:
        plain = b" ".join(words_of(tag.encode())).decode()
        held.setdefault(f" {plain} ", []).append((plain, "", "tag", 0.0))
        raw.add_word(tag, tag)
    for key, values in held.items():
        words.add_word(key, (len(key), values))
    words.make_automaton()
    raw.make_automaton()
    return words, raw


def expressions(text: str, raw) -> list[tuple[str, list[str], str]]:
    """(expression in postfix, names, terms) of every tag in the text."""
    lower = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    out = []
    for end, tag in raw.iter(lower):
        before = lower[end - len(tag)] if end >= len(tag) else " "
        if before.isascii() and not before.isalnum() or end < len(tag):
            line = re.split(r"[\n\r]", text[end + 1 : end + 1 + _line(text, end + 1)], maxsplit=1)[0]
            steps = postfix(_TOKEN.findall(line))
            names, terms = evaluated(steps) if steps else ([], "")
            out.append((" ".join(steps), names, terms))
    return out


def _line(text: str, start: int) -> int:
    stop = text.find("\n", start)
    return (len(text) if stop < 0 else stop) - start


def _scanner(phrases: tuple, tags: tuple):
    def scan(text: bytes | None):
        words_automaton, raw = _automata(phrases, tags)
        words = words_of(text)
        places, tagged = [], False
        joined = " " + b" ".join(words).decode("latin-1") + " "
        at = index = 0
        for end, (size, values) in words_automaton.iter(joined):
            start = end - size + 1
            # Ends ascend, starts need not: count the borders between this start and the last one.
            index += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            for phrase, label, kind, strength in values:
                if kind == "tag":
                    tagged = True
                else:
                    places.append({"word": index, "phrase": phrase, "label": label, "kind": kind, "strength": strength})
        found = expressions(text.decode("utf-8", "replace"), raw) if tagged else []
        return len(words), places, [{"expression": e, "names": n, "terms": t} for e, n, t in found]

    def run(frames):
        for frame in frames:
            rows = [scan(text) for text in frame["text"]]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            out = dict(zip(("n_words", "places", "expressions"), map(list, columns), strict=True))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), **out}).astype({"doc_id": "Int64"})

    return run


SCHEMA = (
    "doc_id long, n_words long, places array<struct<word: long, phrase: string, label: string, kind: string, strength: double>>, "
    "expressions array<struct<expression: string, names: array<string>, terms: string>>"
)


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices=NOTICES, tags=TAGS) -> DataFrame:
    """doc_id, n_words, places of phrases (word, phrase, label, kind) and expressions of tags, of every row."""
    phrases = tuple((p, label, "base", BASE_STRENGTH) for p, label in base.items()) + tuple((p, label, "notice", s) for p, label, s in notices)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(_scanner(phrases, tuple(tags)), SCHEMA)


def labelled(found: DataFrame) -> DataFrame:
    """Counts, labels and score of every document from its places and expressions."""
    base = F.filter("places", lambda p: p["kind"] == "base")
    starts = F.transform("_base", lambda p: p["word"])
    names = F.flatten(F.transform("expressions", lambda e: e["names"]))
    terms = F.transform(
        "expressions", lambda e: F.when(e["expression"] == "", "unparsed-expression").otherwise(F.concat(F.lit("terms:"), e["terms"]))
    )
    # Strongest evidence of each label, in the order of labels.
    proofs = F.array_union(
        F.transform("places", lambda p: F.struct(p["label"].alias("label"), p["strength"].alias("strength"))),
        F.transform(names, lambda n: F.struct(n.alias("label"), F.lit(EXPRESSION_STRENGTH).alias("strength"))),
    )
    out = found.withColumns({"_base": base, "_names": names, "_proofs": F.array_sort(proofs)})
    out = out.withColumn("_found", F.array_distinct(F.transform("_proofs", lambda p: p["label"])))
    strongest = F.transform("_found", lambda n: F.array_max(F.transform(F.filter("_proofs", lambda p: p["label"] == n), lambda p: p["strength"])))
    left = F.aggregate(strongest, F.lit(1.0), lambda acc, s: acc * (1 - s))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.transform("_base", lambda p: p["label"])).alias("base_labels"),
        listed(F.concat("_found", terms)).alias("labels"),
        (1 - left).alias("score"),
    )


@query("op11_license_scan")
def op11(spark, folder):
    return labelled(scan_licenses(table(spark, folder, "documents")))
