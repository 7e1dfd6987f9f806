"""Near-duplicate vectors by p-stable hashing in several tables, confirmed by exact cosine.

A vector is normalised, so a cosine of c is a Euclidean distance of sqrt(2 - 2c): 0.374 at 0.93. One
hash is floor((a . v + b) / WIDTH) with a standard normal a; ``HASHES`` of them name a bucket of a
table and there are ``TABLES`` tables. A pair at the threshold agrees in one hash with probability
0.88 and meets in some table with probability 0.97; at 0.98 it is above 0.9999. Unrelated vectors meet
in about two pairs of a hundred.

Inside a bucket, cosines of all pairs are taken in double precision, block against block of at most
``BLOCK`` vectors a side, each pair of blocks a group of its own, so a bucket with a third of all rows
becomes many equal tasks and no pair is emitted. A pair counts in the first table in which it meets,
which every row can tell from the bucket names it carries: sums of counts need no distinct. For
components a block returns a spanning forest of its links.

Defined cases: null, empty, zero, non-finite and null-holding vectors, a null label and a null vec_id
link with nothing (a null vec_id is kept and has no component). Vectors of other lengths are compared
among their own length only. Rows that share a vec_id are one vector in the result, with the links of
the smallest of their vectors. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .shared import cut_lineage
from .stars import components

COSINE = 0.93
TABLES, HASHES, WIDTH = 16, 12, 2.5
BLOCK = 512
SEED = 41


def planes(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections and offsets for vectors of one length; any task derives the same from the seed."""
    rng = np.random.default_rng([SEED, size])
    return rng.standard_normal((size, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def _buckets(frames):
    mixer = np.random.default_rng(SEED).integers(1, 2**62, TABLES * HASHES, dtype=np.int64) * 2 + 1
    for frame in frames:
        sizes = frame["embedding"].map(len).to_numpy()
        for size in np.unique(sizes):
            part = frame[sizes == size]
            vectors = np.array([np.asarray(v, np.float64) for v in part["embedding"]])
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            a, b = planes(int(size))
            steps = np.floor((vectors / norms @ a + b) / WIDTH).astype(np.int64)
            names = (steps * mixer).reshape(len(part), TABLES, HASHES).sum(2) * 0x5851F42D4C957F2D
            names ^= names >> 29
            yield pd.DataFrame(
                {
                    "vec_id": part["vec_id"],
                    "label": part["label"],
                    "size": np.int32(size),
                    "names": [n.tobytes() for n in names],
                    "vector": [v.tobytes() for v in vectors],
                }
            )


def _counted(least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["own"].to_numpy()
        home, guest = np.flatnonzero(own == frame["i"].iloc[0]), np.flatnonzero(own == frame["j"].iloc[0])
        ids = frame["vec_id"].to_numpy()
        vectors = np.frombuffer(b"".join(frame["vector"]), np.float64).reshape(len(frame), -1)
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        names = np.frombuffer(b"".join(frame["names"]), np.int64).reshape(len(frame), -1)
        t = int(frame["t"].iloc[0])
        links = np.zeros(len(frame), np.int64)
        name = np.arange(len(frame))
        same_block = frame["i"].iloc[0] == frame["j"].iloc[0]
        for lo in range(0, len(home), 256):
            rows = home[lo : lo + 256]
            close = vectors[rows] @ vectors[guest].T >= least
            earlier = np.zeros(close.shape, bool)
            for k in range(t):
                earlier |= names[rows, k][:, None] == names[guest, k][None, :]
            if same_block:
                close &= rows[:, None] != guest[None, :]
            fresh = close & ~earlier
            links[rows] += fresh.sum(1)
            if not same_block:
                links[guest] += fresh.sum(0)
            for r, row in zip(rows, close, strict=True):
                near = name[guest[row]]
                if len(near) and (near != name[r]).any():
                    joined = np.unique(np.append(near, name[r]))
                    name[np.isin(name, joined)] = joined[0]
        return pd.DataFrame({"vec_id": ids, "links": links, "near": ids[name]})

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    all_ids = rows.select("vec_id").distinct()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    useful = rows.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )
    useful = useful.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("v")).select("vec_id", "v.embedding", "v.label")
    label_type = dict(useful.dtypes)["label"]
    hashed = cut_lineage(useful.mapInPandas(_buckets, f"vec_id long, label {label_type}, size int, names binary, vector binary"))
    keys = F.array(*(F.xxhash64(F.lit(t), "label", "size", F.expr(f"substring(names, {8 * t + 1}, 8)")) for t in range(TABLES)))
    tabled = hashed.select("vec_id", F.posexplode(keys).alias("t", "bucket"))
    crowded = tabled.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = (
        tabled.join(crowded, ["t", "bucket"])
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .withColumn("own", F.expr("pmod(xxhash64(vec_id), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("vec_id", "t", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    counted = cut_lineage(
        spread.join(hashed.select("vec_id", "names", "vector"), "vec_id")
        .groupBy("t", "bucket", "i", "j")
        .applyInPandas(_counted(cosine), "vec_id long, links long, near long")
        .filter("links > 0 OR near <> vec_id")
    )
    totals = counted.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    named = components(counted.filter("near <> vec_id").distinct(), "vec_id", "near").withColumnRenamed("node", "vec_id")
    out = all_ids.join(totals, "vec_id", "left").join(named, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS a FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), e AS (
  SELECT x.vec_id AS x, y.vec_id AS y FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.a) = len(y.a)
  WHERE list_cosine_similarity(x.a, y.a) >= 0.93
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.v WHERE reach.r < e.y
), n AS (
  SELECT x, count(*) AS n FROM e GROUP BY 1
)
SELECT v AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, min(r) AS component_id, v = min(r) AS kept
FROM reach LEFT JOIN n ON n.x = v GROUP BY v, n.n
"""


@query("op4_embedding_near_dedup", SQL)
def op4(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))
