"""Quality rules whose cutoffs are chosen on labelled rows, with a bound on false rejections.

Five scores of a text (higher is worse) are held against cutoffs. For every stratum (language) and
rule the cutoffs of a fixed grid are tested from the loosest on: H0 says that the cutoff rejects more
than ``RISK / rules`` of the good texts. With k of n labelled good texts rejected, the exact binomial
tail P(X <= k | n, RISK / rules) is the p-value, the test that the Clopper-Pearson bound inverts. Each
rule and stratum gets ``CONFIDENCE`` shared equally among all rules and strata (Bonferroni); within
one rule the order is fixed in advance and testing stops at the first cutoff that fails, so the grid
costs nothing (fixed-sequence testing). The strictest cutoff passed is used. Then, with probability
1 - ``CONFIDENCE``, no stratum loses more than ``RISK`` of its good texts to the rules. A stratum with
too few labels gets no cutoff and loses nothing. All of it is built-in functions.

Defined cases: null text has no words and fails the base rule (under 20 words); a null language and an
empty one share a stratum; labels that are null or neither 0 nor 1, or whose doc_id is null, are unused;
several labels of a document count as good only if all say so; repeated rows are repeated; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .shared import cut_lineage

RISK = 0.02
CONFIDENCE = 0.05
WINDOW = 8
SPACE = " \t\n\x0b\f\r"

# Cutoffs from loose to strict, fixed before any label is seen.
GRID = {
    "symbol_share": [2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "long_words": [12.0, 10.0, 9.0, 8.5, 8.0, 7.75, 7.5, 7.25, 7.0, 6.75, 6.5],
    "short_words": [-2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0],
    "repeated_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3],
    "repeated_words": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur at least twice in the text, the first occurrence included."""

    def covered(windows):
        keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows):
            same = lambda s, k: F.coalesce(F.get(rows, k)["h"] == s["h"], F.lit(False))
            twice = F.filter(rows, lambda s, k: same(s, k + 1) | F.when(k > 0, same(s, k - 1)).otherwise(False))
            return let(F.sort_array(F.transform(twice, lambda s: s["i"])), total)

        def total(at):
            size = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(keyed, places)).otherwise(F.lit(0).cast("long"))

    def hashed(hashes):
        count = F.size(hashes) - WINDOW
        windows = F.transform(F.sequence(F.lit(1), count + 1), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
        return F.when(count >= 1, let(windows, covered)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def features(docs: DataFrame) -> DataFrame:
    """Counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("stratum"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
        ).alias("_l"),
    ).select("doc_id", "stratum", "_w.*", "word_chars", "n_symbols", "_l.*")


def scores() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return {
        "symbol_share": per_word("n_symbols"),
        "long_words": per_word("word_chars"),
        "short_words": -per_word("word_chars"),
        "repeated_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated_words": per_word("n_repeat_words"),
    }


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by ten."""
    y = x + 10
    shift = F.log(x) + sum((F.log(x + i) for i in range(1, 10)), F.lit(0.0))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of Bin(n, p): the top term times the sum of falling ratios; 1 at or above the mean,
    where no test can pass. The ratios fall so fast that terms beyond the reach vanish in a double."""
    kd, nd = k.cast("double"), n.cast("double")
    top = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log1p(F.lit(-p))
    reach = F.least(k, (60 + 12 * F.sqrt(nd)).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc, i):
        j = kd - i + 1
        term = acc["term"] * j * (1 - p) / ((nd - j + 1) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.when(reach > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), reach), start, add)["sum"]).otherwise(1.0)
    return F.when(kd >= nd * p, 1.0).otherwise(F.exp(top) * total)


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, cut_<rule>): the strictest cutoff with a proven bound, null where there is none."""
    good = (
        labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .filter("quality = 1")
        .select("doc_id")
    )
    held = counted.filter("n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words").join(good, "doc_id")
    named = scores()
    rejected = [F.count_if(named[r] > c).alias(f"{r}_{i}") for r, grid in GRID.items() for i, c in enumerate(grid)]
    tested = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *rejected)
    strata = tested.agg(F.count(F.lit(1)).alias("strata"))
    level = F.lit(confidence / len(GRID)) / F.col("strata")
    picked = []
    for rule, grid in GRID.items():
        passed = F.array(*(binomial_tail(F.col(f"{rule}_{i}"), F.col("n"), risk / len(GRID)) <= level for i in range(len(grid))))
        first_failed = F.coalesce(F.nullif(F.array_position(passed, False), F.lit(0)) - 1, F.lit(len(grid)).cast("long"))
        picked.append(F.get(F.array(*map(F.lit, grid)), (first_failed - 1).cast("int")).alias(f"cut_{rule}"))
    return tested.join(strata, F.lit(True)).select("stratum", *picked)


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The counts of each document, base_failed, the rules it broke and kept."""
    counted = cut_lineage(features(docs.select("doc_id", "text", "lang")))
    cuts = cutoffs(counted, labels.select("doc_id", "quality"), risk, confidence)
    named = scores()
    broken = F.array_compact(F.array(*(F.when(named[r] > F.col(f"cut_{r}"), F.lit(r)) for r in GRID)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.join(cuts, "stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .drop(*(f"cut_{r}" for r in GRID))
    )


_WS = "[\\x20\\x09-\\x0D]+"
_CUTS = ", ".join(f"('{r}', {i}, {c!r})" for r, grid in GRID.items() for i, c in enumerate(grid))
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') AS l FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i)
), t AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS k FROM g) WHERE k > 1
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS j FROM t) GROUP BY 1
), f AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), r AS (
  SELECT doc_id, stratum, base_failed, unnest([
    struct_pack(rule := 'symbol_share', s := n_symbols / greatest(n_words, 1)), struct_pack(rule := 'long_words', s := word_chars / greatest(n_words, 1)),
    struct_pack(rule := 'short_words', s := -(word_chars / greatest(n_words, 1))), struct_pack(rule := 'repeated_lines', s := n_dup_lines / greatest(n_lines, 1)),
    struct_pack(rule := 'repeated_words', s := n_repeat_words / greatest(n_words, 1))]) AS x FROM b
), q AS (
  SELECT doc_id FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY 1 HAVING min(quality) = 1
), grid(rule, i, cut) AS (VALUES {_CUTS}
), k AS (
  SELECT stratum, grid.rule, i, cut::DOUBLE AS cut, count(*) AS n, count(*) FILTER (x.s > cut) AS k
  FROM r JOIN q USING (doc_id) JOIN grid ON grid.rule = x.rule WHERE NOT base_failed GROUP BY ALL
), z AS (
  SELECT *, CASE WHEN k >= n * {RISK / len(GRID)!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK / len(GRID)!r}) + (n - j) * ln(1 - {RISK / len(GRID)!r})))) END
    <= {CONFIDENCE / len(GRID)!r} / (SELECT count(DISTINCT stratum) FROM k) AS ok FROM k
), u AS (
  SELECT stratum, rule, min(cut) AS low FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY i) AS yes FROM z) WHERE yes GROUP BY ALL
), bad AS (
  SELECT DISTINCT doc_id FROM r JOIN u ON u.stratum = r.stratum AND u.rule = r.x.rule WHERE x.s > low
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""


@query("op8_quality_rules", SQL)
def op8(spark, folder):
    out = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
