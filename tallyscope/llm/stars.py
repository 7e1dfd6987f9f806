"""Connected components by alternating large-star and small-star, one checkpoint per round.

The two steps, and the parts that hubs are cut into, are those of ``operators.components``: a near-duplicate
class or a crowd of links around one document is such a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import HUB_EDGES, stars


def components(links: DataFrame, a: str, b: str, rounds: int = 80, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Null ends and loops are ignored. Rounds are logarithmic in the longest path.
    """
    found = stars(links.select(F.col(a).alias("u"), F.col(b).alias("v")), rounds, hub_edges)
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
