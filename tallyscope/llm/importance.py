"""Importance resampling towards a target set, with bit-sliced sums of exact integer weights.

Features are hashed words; ``documents`` and the target give two tables of bucket counts, and each bucket
a gain: the floored log ratio of its smoothed shares. The counts of a document are cut into bit planes
of ``BUCKETS`` bits: plane k holds bit k of every bucket's count. The gains are sliced alike, by the bits of
their magnitudes and apart by sign. The weight of a document, the sum of count * gain over its buckets, is
then the sum over pairs of planes of 2^(k + j) * (popcount(count_k & plus_j) - popcount(count_k & minus_j)):
exact integers from ANDs and popcounts alone.

Both passes over the texts are row-local. What is shuffled are partial bucket counts (at most ``BUCKETS``
rows a task) and one small row per document for the ranks. The driver sees the gain table, ``BUCKETS`` rows.

A draw takes the rows with the largest score = weight + Gumbel noise of the doc_id. Ranks come from a range
partitioning by score: rows are numbered inside their range and the ranges' sizes, one row a range, are summed
up. Equal documents get different noise, so a hot group of copies spreads over the ranges.

Defined cases: null and empty texts have no features and weight 0; a null doc_id has no noise, so score and rank
are null and the row does not count among those that are drawn from, while its words count in the shares;
repeated rows are drawn one by one; an empty target or an empty table gives gains from the other side alone; a
text of any length is one row. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table
from .shared import cut_lineage

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
# Documents whose planes are in memory together; a plane is 1,256 bytes.
BLOCK = 64

# Every byte that isn't part of a word becomes a space, A-Z becomes lower case.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def buckets_of(text: bytes | None, buckets: int, width: int = 1) -> np.ndarray:
    """Bucket of every run of 1 to ``width`` words, repeats included."""
    words = words_of(text)
    out = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
    for n in range(2, width + 1):
        runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        out.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
    return np.concatenate(out) % buckets


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.col("text").cast("binary"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, width: int = 1) -> DataFrame:
    """(bucket, n) over all texts; each task sends one row a bucket at most."""

    def count(frames):
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            for text in frame["text"]:
                total += np.bincount(buckets_of(text, buckets, width), minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    parts = _bytes(texts.select("text")).mapInPandas(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets from both tables of counts."""
    spark = documents.sparkSession
    totals = documents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s"))
    totals = totals.crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(documents.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.fillna(0, ["s", "t"]).join(F.broadcast(totals), F.lit(True))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets)
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    short = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, short))), axis=1).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the gains' magnitudes, first of positive ones; and what a bit of each is worth."""
    planes, worth = [], []
    for sign in (1, -1):
        size = np.maximum(gain * sign, 0)
        for j in range(int(size.max(initial=0)).bit_length()):
            planes.append((size >> j) & 1 == 1)
            worth.append(sign << j)
    if not planes:
        planes, worth = [np.zeros(len(gain), bool)], [0]
    return _packed(np.array(planes)), np.array(worth, np.int64)


def sliced_weights(owners: np.ndarray, found: np.ndarray, docs: int, planes: np.ndarray, worth: np.ndarray, buckets: int) -> np.ndarray:
    """Weight of each of ``docs`` documents from the (owner, bucket) of all their features."""
    cells, counts = np.unique(owners * buckets + found, return_counts=True)
    rows, columns = cells // buckets, cells % buckets
    total = np.zeros(docs, np.int64)
    for k in range(int(counts.max(initial=0)).bit_length()):
        on = (counts >> k) & 1 == 1
        held, local = np.unique(rows[on], return_inverse=True)
        bits = np.zeros((len(held), buckets), bool)
        bits[local, columns[on]] = True
        both = _packed(bits)[:, None, :] & planes[None, :, :]
        total[held] += (np.bitwise_count(both).sum(2, dtype=np.int64) @ worth) << k
    return total


def _weigher(gain: np.ndarray, buckets: int, width: int):
    def run(frames):
        planes, worth = gain_planes(gain)
        for frame in frames:
            sizes, weights = [], []
            for lo in range(0, len(frame), BLOCK):
                part = [buckets_of(t, buckets, width) for t in frame["text"].iloc[lo : lo + BLOCK]]
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                owners = np.repeat(np.arange(len(part)), lengths)
                sizes.append(lengths)
                weights.append(sliced_weights(owners, np.concatenate(part), len(part), planes, worth, buckets))
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            out = {"doc_id": frame["doc_id"], "n_features": flat(sizes), "weight": flat(weights)}
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return run


def weights(docs: DataFrame, gain_table: DataFrame, buckets: int = BUCKETS, width: int = 1) -> DataFrame:
    """doc_id, n_features, weight of every row; ``gain_table`` has one row for each of ``buckets``."""
    gain = np.zeros(buckets, np.int64)
    for row in gain_table.select("bucket", "gain").collect():
        gain[row.bucket] = row.gain
    rows = _bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInPandas(_weigher(gain, buckets, width), "doc_id long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise in thousandths, from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int, least: int) -> DataFrame:
    """Adds rank: the place of the rows that are drawn, null for all others."""
    able = (F.col("n_features") >= least) & F.col("score").isNotNull()
    order = [F.col("score").desc(), F.col("doc_id")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = scored.filter(able).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: the window without a key holds as many rows as there are partitions.
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    drawn = sizes.agg(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) * percent / 100).alias("_draw"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    placed = ranges.join(F.broadcast(offsets), "_range").withColumn("rank", place).join(F.broadcast(drawn), F.lit(True))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= F.col("_draw"), F.col("rank")))
    columns = [*scored.columns, "rank"]
    others = scored.filter(~F.coalesce(able, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*columns).unionByName(others.select(*columns))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    width: int = 1,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; drawn rows have a rank."""
    table_of_gains = gains(bucket_counts(docs, buckets, width), bucket_counts(target, buckets, width), buckets)
    scored = weights(docs, table_of_gains, buckets, width).withColumn("score", F.col("weight") + noise(seed))
    return ranked(cut_lineage(scored), percent, least)


# The checksum is unrolled from its polynomial: the 256 remainders first, then a fold over the bytes of each word.
SQL = r"""
WITH remainders AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS r
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), m AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), dw AS (
  SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2
), x AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM m)
), b AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2),
    lambda i: (16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::UBIGINT)),
    lambda c, v: xor(c >> 8, r[(xor(c, v) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM x, remainders
), s AS (
  SELECT bucket, sum(c) AS s FROM dw JOIN b USING (w) GROUP BY 1
), t AS (
  SELECT bucket, count(*) AS t FROM m JOIN b USING (w) GROUP BY 1
), g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), wt AS (
  SELECT doc_id, sum(c * gain) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1
), sc AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(wt.weight, 0)::BIGINT AS weight, coalesce(wt.weight, 0)::BIGINT
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN wt USING (doc_id)
), rk AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM sc WHERE n_features >= 20
)
SELECT sc.doc_id, n_features, weight, score, k::BIGINT AS rank FROM sc LEFT JOIN rk ON rk.doc_id = sc.doc_id AND k <= 10 * n // 100
"""


@query("op12_importance_resampling", SQL)
def op12(spark, folder):
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
