"""Text normalisation, fingerprints, hashed character features and text groups."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hashed feature space.
BUCKETS = 16384
NGRAM_LENGTHS = (2, 3, 4)
HASH_PERSON = b"hc3char_v1"
SHORT_TEXT = 280
# N-grams whose hash a task remembers, and numbers it returns at once.
MEMO = 200_000
PIECE = 500_000
# Characters whose n-grams are taken at once, and the largest range of numbers that are ranked by a table.
STRETCH = 1 << 17
TABLE = 1 << 22
CJK_CLASS = "[㐀-鿿]"
HASHED = T.StructType(
    [
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)
# Names of the text groups in report order.
TEXT_GROUPS = (
    "contains_cjk",
    "no_cjk",
    "predominantly_cjk_letters",
    "short_le280_codepoints",
    "long_gt280_codepoints",
    "inference_supported_long_cjk",
)


def _normal_form(text: str | None) -> str | None:
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def _normalise_other(texts: pd.Series) -> pd.Series:
    return texts.map(_normal_form, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normalise_others(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [_normal_form(t) for t in texts], na_action="ignore")


# Characters that are their own compatibility form, compose with none of the others, and whose folded case is their
# lower case, the sharp s apart: ASCII, Latin-1, dashes and quotes, basic Cyrillic, kana, Hangul and Chinese.
STABLE = (
    r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u0410-\u044F"
    r"\u2013\u2014\u2018-\u201E\u2022\u20AC\u3001\u3002\u3041-\u3096\u30A1-\u30FA\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7A3"
)


def _unstable(text: Column) -> Column:
    # Most characters are ASCII, which the look-ahead passes over much faster than the long class.
    return text.rlike(rf"(?=[^\x00-\x7F])[^{STABLE}]")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[\x09-\x0D\x1C-\x20]+", " "))


def normalise(text: Column | str) -> Column:
    """Compatibility form, case-folded, runs of whitespace collapsed to one space.

    Texts of ``STABLE`` characters stay with built-in functions; Python sees a null in their place.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_normalise_other(F.when(_unstable(text), text)), _plain(text))


def normalise_all(texts: Column) -> Column:
    """As ``normalise`` for every text of an array: one Python step for all of them."""
    others = F.when(F.exists(texts, _unstable), F.transform(texts, lambda t: F.when(_unstable(t), t)))
    # A shorter array, here null, is filled up with nulls.
    fixed = F.coalesce(_normalise_others(others), F.array().cast("array<string>"))
    return F.zip_with(texts, fixed, lambda t, done: F.coalesce(done, _plain(t)))


def fingerprint(normalised: Column) -> Column:
    return F.sha2(normalised, 256)


def _slot(gram: str, cache: dict[str, int]) -> int:
    """Signed bucket of one n-gram: the bucket plus one, negative for a negative sign."""
    found = cache.get(gram)
    if found is None:
        digest = hashlib.blake2b(gram.encode(), digest_size=8, person=HASH_PERSON).digest()
        number = int.from_bytes(digest, "little")
        found = number % BUCKETS + 1
        if number >> 63:
            found = -found
        cache[gram] = found
    return found


def _hashed(text: str, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    grams: Counter[str] = Counter()
    for n in NGRAM_LENGTHS:
        grams.update(map("".join, zip(*(text[k:] for k in range(n)))))
    if not grams:
        return np.empty(0, np.int32), np.empty(0)
    slots = np.fromiter((_slot(g, cache) for g in grams), np.int64, len(grams))
    counts = np.fromiter(grams.values(), np.float64, len(grams))
    index, back = np.unique(np.abs(slots) - 1, return_inverse=True)
    sums = np.bincount(back, weights=np.sign(slots) * counts)
    index, sums = index[sums != 0], sums[sums != 0]
    norm = np.sqrt(np.sum(sums * sums))
    return index.astype(np.int32), (sums / norm if norm else sums)


@F.pandas_udf(HASHED)
def hashed_features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Signed character 2- to 4-gram counts of a normalised text in 16,384 buckets, unit length.

    Distinct n-grams are hashed once; the memo is dropped when it grows beyond ``MEMO`` entries. A batch leaves in pieces
    of about ``PIECE`` numbers: the features of a text are many times its size.
    """
    cache: dict[str, int] = {}
    for texts in batches:
        pairs, held = [], 0
        for k, text in enumerate(texts):
            pairs.append(_hashed(text or "", cache))
            held += len(pairs[-1][0])
            if len(cache) > MEMO:
                cache.clear()
            if held >= PIECE or k == len(texts) - 1:
                yield pd.DataFrame({"indices": [p[0] for p in pairs], "values": [p[1] for p in pairs]})
                pairs, held = [], 0


def ranks(numbers: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, all from 0 to below ``top``, in order, and the place of each number among them."""
    if top > TABLE:
        return np.unique(numbers, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[numbers] = True
    distinct = np.flatnonzero(seen)
    place = np.empty(top, np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[numbers]


def _cells(part: str, owner: np.ndarray, left: np.ndarray, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Signed counts of the n-grams that begin at the first characters of ``part``, which have an owner and a number of
    characters left in their text, as owner * BUCKETS + bucket, in order, and sums.

    N-grams get numbers by those one shorter and their last character, so text is made of distinct ones only.
    """
    points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
    letters, char = ranks(points, 0x110000)
    letters = [chr(c) for c in letters]
    at, number, names, found = np.arange(len(owner)), char[: len(owner)].astype(np.int64), letters, []
    for n in range(2, max(NGRAM_LENGTHS) + 1):
        whole = left[at] >= n
        at = at[whole]
        codes, number = ranks(number[whole] * len(letters) + char[at + n - 1], len(names) * len(letters))
        heads, tails = np.divmod(codes, len(letters))
        names = [names[a] + letters[b] for a, b in zip(heads.tolist(), tails.tolist())]
        if n in NGRAM_LENGTHS:
            slots = np.array([cache.get(g) or _slot(g, cache) for g in names], owner.dtype)
            slots = 2 * (np.abs(slots) - 1) + (slots < 0)
            found.append(owner[at] * (2 * BUCKETS) + slots[number])
        if len(cache) > MEMO:
            cache.clear()
    both = np.sort(np.concatenate(found))
    cells = both >> 1
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[first], np.add.reduceat(1 - 2 * (both & 1), first) if len(first) else first


def _group_sums(texts: list[str], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined, ends = "".join(texts), np.cumsum([len(t) for t in texts])
    more, parts = max(NGRAM_LENGTHS) - 1, []
    # Half as wide numbers are sorted in a third of the time.
    owners = np.arange(len(texts), dtype=np.int32 if len(texts) * 2 * BUCKETS < 1 << 31 else np.int64)
    for a in range(0, len(joined), STRETCH):
        at = np.arange(a, min(a + STRETCH, len(joined)))
        owner = np.repeat(owners, np.diff(np.clip(ends, a, at[-1] + 1), prepend=a))
        parts.append(_cells(joined[a : a + STRETCH + more], owner, ends[owner] - at, cache))
    if len(parts) == 1:
        cells, sums = parts[0]
    else:
        cells, back = np.unique(np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)]), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([p[1] for p in parts] or [np.empty(0)])).astype(np.int64)
    cells, sums = cells[sums != 0], sums[sums != 0]
    return np.bincount(cells // BUCKETS, minlength=len(texts)), (cells % BUCKETS).astype(np.int32), sums


def hashed_sums(texts: Iterable[str | None], cache: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The numbers of ``hashed_features`` before they are brought to unit length, for many texts at once.

    Groups of consecutive texts of about ``STRETCH`` characters, or one longer text, which is taken in stretches. Of each
    group: how many numbers each text has, and the buckets and sums of all of them.
    """
    group, held = [], 0
    for text in texts:
        text = text or ""
        if group and held + len(text) > STRETCH:
            yield _group_sums(group, cache)
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield _group_sums(group, cache)


def lengths(sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Euclidean length of each text's sums."""
    return np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=sums * sums, minlength=len(sizes)))


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, CJK_CLASS.replace("[", "[^") + "+", ""))


def letter_count(text: Column) -> Column:
    # What is left is counted: a count of matches would build a string for each letter.
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def text_groups(text: Column) -> Column:
    """Array of the groups a normalised text belongs to."""
    cjk, letters, size = cjk_count(text), letter_count(text), F.length(text)
    names = F.array(
        F.when(cjk > 0, TEXT_GROUPS[0]).otherwise(TEXT_GROUPS[1]),
        F.when((letters > 0) & (cjk / F.when(letters > 0, letters) >= 0.5), TEXT_GROUPS[2]),
        F.when(size <= SHORT_TEXT, TEXT_GROUPS[3]).otherwise(TEXT_GROUPS[4]),
        F.when((cjk > 0) & (size > SHORT_TEXT), TEXT_GROUPS[5]),
    )
    return F.filter(names, lambda g: g.isNotNull())


def decision_gate(text: Column, domain: Column, task: Column, own_domain: str) -> Column:
    """Reason to refuse a decision, or null when the classifier may score the text."""
    return (
        F.when(task != "binary", "mixed_and_three_class_origin_not_trained")
        .when(domain != own_domain, "out_of_domain_or_unvalidated_content")
        .when(F.length(text) <= SHORT_TEXT, "short_text_not_validated_for_deployment")
        .when(cjk_count(text) == 0, "non_Chinese_content_not_validated_for_deployment")
    )


def _canonical(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except ValueError:
        return None
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The same JSON value with sorted keys and no spaces, for digests."""
    return texts.map(_canonical, na_action="ignore")
