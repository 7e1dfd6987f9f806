"""Connected components of an edge table by alternating star contraction.

Every step is a grouped minimum (combined on the map side) and an equi-join of the edges of a node with its
minimum. A hub, a node with more edges than one task should read, is cut into sub-hubs: its edges are dealt
by the hash of their other end to as many parts as its counted degree asks for, and its minimum is repeated
for each part. Both degrees a round needs are counted before it, in the pass that also tells whether the
edges are stars already. Each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A hub has this many edges at least, and a thousandth of all: so there are 1,000 hubs a side at most.
HUB_EDGES = 500
HUB_SHARE = 1_000
# Edges that one task reads from a round's checkpoint at least, where there are tasks for all cores.
TASK_EDGES = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def gathered(edges: DataFrame) -> DataFrame:
    """Checkpointed edges in as few tasks as their number asks for: each exchange has a file for every task that
    writes to it, and a round has many, so small tables would otherwise cost by their partitions."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    return edges.coalesce(max(cores, -(-edges.count() // TASK_EDGES)))


def survey(edges: DataFrame, hub_edges: int = HUB_EDGES) -> tuple[bool, dict, dict]:
    """Of distinct edges u > v: whether they are stars, and hubs with their parts by larger and by smaller neighbours.

    They are stars when every node has one neighbour, a smaller one, or only larger ones: two nodes of the first
    kind can't be neighbours, as each would have to be the smaller.
    """
    limit = max(hub_edges, -(-2 * edges.count() // HUB_SHARE))
    around = _both_ways(edges).groupBy("u").agg(
        F.min("v").alias("m"),
        F.count_if(F.col("v") > F.col("u")).alias("up"),
        F.count_if(F.col("v") < F.col("u")).alias("down"),
    )
    leaf_or_root = (F.col("down") == 0) | ((F.col("down") == 1) & (F.col("up") == 0))
    parts = lambda n: F.collect_list(F.when(F.col(n) > limit, F.struct("u", F.ceil(F.col(n) / limit).alias("parts"))))
    row = around.agg(F.count_if(~leaf_or_root).alias("loose"), parts("up").alias("up"), parts("down").alias("down")).first()
    return row.loose == 0, {r.u: r.parts for r in row.up}, {r.u: r.parts for r in row.down}


def beside_minimum(pairs: DataFrame, hubs: dict, among: DataFrame | None = None) -> DataFrame:
    """Every pair (u, v) with m, the smallest of u and its partners in ``among``; rows of hubs are dealt over their parts."""
    lowest = (pairs if among is None else among).groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    if not hubs:
        return pairs.join(lowest, "u")
    kind = pairs.schema["u"].dataType.simpleString()
    table = F.broadcast(pairs.sparkSession.createDataFrame(list(hubs.items()), f"u {kind}, _parts long"))
    one = F.coalesce("_parts", F.lit(1))
    dealt = pairs.join(table, "u", "left").withColumn("_part", F.expr("pmod(xxhash64(v), coalesce(_parts, 1L))"))
    repeated = lowest.join(table, "u", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)))
    return dealt.drop("_parts").join(repeated.drop("_parts"), ["u", "_part"]).drop("_part")


def large_star(edges: DataFrame, hubs: dict | None = None) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it."""
    both = _both_ways(edges)
    # The minimum is over all neighbours, the join over the larger ones alone: by these the hubs are counted.
    joined = beside_minimum(both.filter("v > u"), hubs or {}, both)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def small_star(edges: DataFrame, hubs: dict | None = None) -> DataFrame:
    """Connect every node and its smaller neighbours to the smallest of them; an edge may come repeated."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = beside_minimum(down, hubs or {})
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def stars(edges: DataFrame, max_rounds: int, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Edges (u, v), u > v, of the stars of all components; ``edges`` may hold loops, repeats and nulls."""
    current = gathered(
        cut_lineage(
            edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .filter("u <> v")
            .distinct()
        )
    )
    for _ in range(max_rounds):
        settled, larger, smaller = survey(current, hub_edges)
        if settled:
            return current
        current = gathered(cut_lineage(small_star(large_star(current, larger), smaller)))
    raise RuntimeError("connected components did not settle within the allowed rounds")


def connected_components(
    edges: DataFrame, left: str, right: str, max_rounds: int = 60, hub_edges: int = HUB_EDGES
) -> DataFrame:
    """(node, component) for every node; the component is named by its smallest node."""
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter(
        F.col("u").isNotNull() & F.col("v").isNotNull()
    )
    nodes = pairs.select("u").union(pairs.select("v")).distinct().toDF("node")
    # Settled edges form stars: every node points at the smallest node of its component.
    roots = stars(pairs, max_rounds, hub_edges).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
