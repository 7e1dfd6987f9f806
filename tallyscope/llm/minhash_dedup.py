"""Near-duplicate classes of texts: MinHash bands, signature verification, star components.

The set of a text is its distinct shingles of ``SHINGLE`` lower-cased words. ``BANDS * ROWS`` universal
hash minima form the signature; texts that agree in all rows of a band share a bucket. A pair at the
threshold shares no bucket with probability (1 - 0.75^4)^32, about 5e-6.

Copies with equal sets are one class from the start. Links are then found in three steps, none of
which lists the pairs of a bucket:

* every text of a bucket is held against the bucket's smallest text, first by signature, then on the
  full sets; components of these links are taken;
* where a bucket still holds several components, one byte of every minimum is compared inside tasks, in blocks
  of at most ``BLOCK`` texts a side. What comes out is a forest over the block's components; their own
  components are clusters, and no link leads out of one;
* the full sets of a cluster, each text being in one cluster only, meet in blocks. Products of incidence matrices
  give all intersections, and again a forest of the links comes out.

So every step returns fewer rows than it has texts in its blocks, whatever the links among them. Texts that are
already in one component need no further comparison, as classes are what is asked for.

Defined cases: null, empty and blank texts have an empty set, are their own class and are kept. A
null doc_id can't name a class: such a row has no component and is kept. Equal doc_ids name one node.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query, table
from .shared import cut_lineage, small_batches
from .stars import components
from .words import Words, chunks, encode, factors, grams, mix

SHINGLE = 5
BANDS, ROWS = 32, 4
# Signatures estimate similarity with a deviation of 0.04; five of them below the threshold.
MARGIN = 0.2
BLOCK = 512
BLOCK_BYTES = 8_000_000
# Texts that are held against one smallest text in one task.
PIVOT = 256
SEED = 29

_MULTIPLY = factors(BANDS * ROWS, SEED)
_ADD = factors(BANDS * ROWS, SEED + 1)


def _sets(texts: list[bytes]):
    """Sorted distinct shingle hashes of each text."""
    for lo, hi in chunks(texts):
        words = Words(texts[lo:hi], lower=True)
        runs = grams(words.hashes, SHINGLE, SEED)
        for k in range(hi - lo):
            w0, w1 = words.offsets[k], words.offsets[k + 1]
            if w1 - w0 >= SHINGLE:
                yield np.unique(runs[w0 : w1 - SHINGLE + 1])
            elif w1 > w0:
                yield grams(words.hashes[w0:w1], int(w1 - w0), SEED + 2 + int(w1 - w0))
            else:
                yield np.zeros(0, np.uint64)


def _signature(members: np.ndarray) -> np.ndarray:
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(members), 2048):
        best = np.minimum(best, (members[lo : lo + 2048, None] * _MULTIPLY + _ADD).min(0))
    return (best >> np.uint64(32)).astype(np.uint32)


def _bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash for the ``ROWS`` minima of each band."""
    return mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _MULTIPLY[:ROWS]).sum(1, dtype=np.uint64))


def _key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sign(frames):
    for frame in frames:
        rows = []
        for doc, members in zip(frame["doc_id"], _sets([encode(t) for t in frame["text"]]), strict=True):
            sig = _signature(members)
            # One byte of every minimum is enough to tell which texts come near the threshold.
            rows.append((doc, len(members), _key(members), _bands(sig).tobytes(), sig.astype(np.uint8).tobytes()))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        names = ("doc_id", "n_shingles", "words", "bands", "sketch")
        yield pd.DataFrame(dict(zip(names, map(list, columns), strict=True))).astype({"doc_id": "Int64"})


def _full(frames):
    for frame in frames:
        out = [(d, m.tobytes()) for d, w, m in zip(frame["rep"], frame["words"], _sets([encode(t) for t in frame["text"]]), strict=True) if _key(m) == bytes(w)]
        yield pd.DataFrame(out, columns=["rep", "members"])


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(percent: int, margin: float):
    least = (percent / 100 - margin) * BANDS * ROWS

    @F.pandas_udf(T.BooleanType())
    def check(x: pd.Series, y: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.Series:
        out = []
        for a, b, p, q in zip(x, y, sx, sy, strict=True):
            close = (np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)).sum() >= least
            out.append(bool(close and _alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)))
        return pd.Series(out, dtype=bool)

    return check


class Unions:
    """Disjoint sets over 0..n-1; ``join`` tells whether two were apart."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def root(self, k: int) -> int:
        while self.top[k] != k:
            self.top[k] = self.top[self.top[k]]
            k = self.top[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.top[max(a, b)] = min(a, b)
        return a != b


def _forest(names: np.ndarray, pairs) -> pd.DataFrame:
    """Of linked places, given as (a, b) index arrays, the links that join different names; fewer than names."""
    known, code = np.unique(names, return_inverse=True)
    sets, found = Unions(len(known)), []
    for a, b in pairs:
        both = np.unique(np.stack([code[a], code[b]]), axis=1)
        found += [(known[x], known[y]) for x, y in both.T.tolist() if sets.join(x, y)]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _resembling(percent: int, margin: float):
    """Forest of the components in one block pair of a bucket whose signatures come near the threshold."""
    least = (percent / 100 - margin) * BANDS * ROWS

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
        comp = frame["comp"].to_numpy()

        def near():
            for k in range(len(frame) - 1):
                other = k + 1 + np.flatnonzero(comp[k + 1 :] != comp[k])
                if len(other):
                    other = other[(sig[other] == sig[k]).sum(1) >= least]
                    yield np.full(len(other), k), other

        return _forest(comp, near())

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices over stretches of the shared shingles."""
    universe = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    total = np.zeros((len(left), len(right)))
    width = 4096
    sides = []
    for sets in (left, right):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        place = np.minimum(np.searchsorted(universe, flat), max(len(universe) - 1, 0))
        held = universe[place] == flat if len(universe) else np.zeros(len(flat), bool)
        order = np.argsort(place[held], kind="stable")
        sides.append((place[held][order], owner[held][order], len(sets)))
    for lo in range(0, len(universe), width):
        blocks = []
        for place, owner, count in sides:
            a, b = np.searchsorted(place, [lo, lo + width])
            block = np.zeros((count, width), np.float32)
            block[owner[a:b], place[a:b] - lo] = 1
            blocks.append(block)
        # At most ``width`` ones a product: exact in 32 bits; the sum is kept in 64.
        total += blocks[0] @ blocks[1].T
    return total


def _linking(percent: int):
    """Forest of the components in one block pair of a cluster that full sets link."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        comp, block = frame["comp"].to_numpy(), frame["block"].to_numpy()
        sets = [np.frombuffer(m, np.uint64) for m in frame["members"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        rows = np.flatnonzero(block == frame["i"].iloc[0])
        columns = np.flatnonzero(block == frame["j"].iloc[0])
        if not len(rows) or not len(columns):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        both = _common([sets[k] for k in rows], [sets[k] for k in columns])
        union = sizes[rows][:, None] + sizes[columns][None, :] - both
        a, b = np.nonzero((100 * both >= percent * union) & (comp[rows][:, None] != comp[columns][None, :]))
        return _forest(comp, [(rows[a], columns[b])])

    return run


def _block(column: str, count: str):
    return F.expr(f"pmod(xxhash64({column}), {count})")


def _clusters(members: DataFrame, comps: DataFrame, classes: DataFrame, percent: int, margin: float) -> DataFrame:
    """(component, cluster): components that may be linked, by signatures, directly or through others.

    Only buckets that hold several components are looked at, in blocks of at most ``BLOCK`` texts a side;
    a block pair gives a forest over its components, so less than one row for each of them.
    """
    named = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("comp")
    )
    mixed = (
        named.groupBy("bucket")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("lo <> hi")
        .select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    )
    spread = named.join(mixed, "bucket").withColumn("own", _block("rep", "blocks"))
    spread = spread.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = spread.select("bucket", "rep", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    near = (
        spread.join(classes.select("rep", "sketch"), "rep")
        .groupBy("bucket", "i", "j")
        .applyInPandas(_resembling(percent, margin), "a long, b long")
    )
    return components(near, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("cluster"))


def _residual_links(members: DataFrame, comps: DataFrame, classes: DataFrame, full: DataFrame, percent: int, margin: float) -> DataFrame:
    """Links between components, verified on the full sets of whole clusters.

    In a cluster the texts of the largest component stay at home; they meet all others, in blocks, but not each
    other. A block holds at most ``BLOCK`` texts and about ``BLOCK_BYTES`` of sets.
    """
    clusters = cut_lineage(_clusters(members, comps, classes, percent, margin))
    people = comps.select(F.col("node").alias("rep"), "component")
    alone = clusters.join(people, "component", "left_anti").select(F.col("component").alias("rep"), "component")
    people = people.unionByName(alone).join(clusters, "component").join(classes.select("rep", "n_shingles"), "rep")
    sized = people.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(8 * s / BLOCK_BYTES))
    n, s = F.sum("n"), F.sum("s")
    top = F.max(F.struct("n", "component", "s"))
    halves = sized.groupBy("cluster").agg(top.alias("top"), n.alias("n"), s.alias("s"))
    halves = halves.select(
        "cluster",
        F.col("top.component").alias("home"),
        blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("fringe"),
        blocks(F.col("top.n"), F.col("top.s")).alias("homes"),
    )
    # Fringe blocks are numbered from 0, those of the home component after them.
    placed = people.join(halves, "cluster").select(
        "cluster", "rep", F.col("component").alias("comp"), "fringe", "homes", (F.col("component") == F.col("home")).alias("at_home")
    )
    own = F.when(F.col("at_home"), F.col("fringe") + _block("rep", "homes")).otherwise(_block("rep", "fringe"))
    placed = placed.withColumn("block", own.cast("long"))
    meets = F.when(F.col("at_home"), F.expr("sequence(0L, fringe - 1)")).otherwise(F.expr("sequence(0L, fringe + homes - 1)"))
    placed = placed.withColumn("other", F.explode(meets))
    placed = placed.select("cluster", "rep", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = placed.join(full.select("rep", "members"), "rep").groupBy("cluster", "i", "j")
    return met.applyInPandas(_linking(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = cut_lineage(docs.mapInPandas(_sign, "doc_id long, n_shingles long, words binary, bands binary, sketch binary"))
    classes = cut_lineage(
        base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("words")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    )
    buckets = F.array(*(F.xxhash64(F.lit(k), F.expr(f"substring(bands, {k * 8 + 1}, 8)")) for k in range(BANDS)))
    banded = classes.select("rep", F.explode(buckets).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter("lo <> hi").select("bucket", "lo", F.ceil(F.col("n") / PIVOT).alias("parts"))
    members = cut_lineage(banded.join(shared, "bucket").select("bucket", "rep", "lo", "parts"))
    wanted = classes.join(members.select("rep").distinct(), "rep").select("rep", "words")
    full = cut_lineage(
        docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("rep", "words", "text").mapInPandas(_full, "rep long, members binary")
    )
    sketch = full.join(classes.select("rep", "sketch"), "rep")
    pairs = members.filter("rep <> lo").groupBy("lo", "rep").agg(F.max("parts").alias("parts"))
    pairs = pairs.withColumn("part", _block("rep", "parts"))
    # The smallest text of a large bucket goes to several tasks, each with a part of the others.
    right = sketch.select(F.col("rep").alias("lo"), F.col("members").alias("lo_members"), F.col("sketch").alias("lo_sketch"))
    right = pairs.select("lo", "parts").distinct().join(right, "lo").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    least, most = F.least(F.length("members"), F.length("lo_members")), F.greatest(F.length("members"), F.length("lo_members"))
    links = (
        pairs.join(sketch, "rep")
        .join(right, ["lo", "parts", "part"])
        .filter(100 * least >= percent * most)
        .filter(_verified(percent, margin)("members", "lo_members", "sketch", "lo_sketch"))
        .select("rep", "lo")
    )
    first = components(links, "rep", "lo")
    more = components(_residual_links(members, first, classes, full, percent, margin), "a", "b")
    joined = first.withColumnRenamed("component", "mid").join(more.select(F.col("node").alias("mid"), "component"), "mid", "left")
    # A text without links of the first step is its own first component and may have moved in the second.
    single = more.join(first.select("node"), "node", "left_anti")
    final = joined.select("node", F.coalesce("component", "mid").alias("component")).unionByName(single)
    named = classes.select("words", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("words", F.coalesce("component", "rep").alias("class"))
    own = F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id"))
    out = base.select("doc_id", "n_shingles", "words").join(named, "words", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(len(w[i:i + 4]) || ' ' || array_to_string(w[i:i + 4], ' ')) AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), b AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT b.y, reach.r FROM reach JOIN b ON b.x = reach.v WHERE reach.r < b.y
)
SELECT v AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id, v = min(r) AS kept
FROM reach LEFT JOIN n ON n.doc_id = v GROUP BY v, n.n
"""


@query("op3_minhash_near_dedup", SQL)
def op3(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
