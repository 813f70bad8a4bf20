"""Connected components of a link table by alternating star contractions.

Every round is two grouped minima and two joins, so no adjacency list, component or link set is ever held by one
task; a hot centre is pre-aggregated by the map-side minimum and its join side can be split by the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, partitions

#: Links that a task writes at least, if there are so many: small tables in hundreds of files cost more than their rows.
LEAST_LINKS = 1024


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node that it sees, itself included."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return (
        both.where("dst > src").join(least, "src").where("dst <> low")
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them.  ``edges``: src > dst."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Roots of all nodes that have a link to another node.

    ``edges``: two columns ``src``, ``dst`` of any one orderable type.  Loops and nulls are dropped, repeated and
    reversed links count once.  Returns (node, root), root the smallest node of the component and itself left out
    (it has no row).  An empty table gives an empty result.
    """
    turned = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = materialise(turned.distinct(), "links")
    n, state = now.count(), None
    while True:
        tasks = min(partitions(edges.sparkSession), n // LEAST_LINKS + 1)
        now = materialise(_small_star(_large_star(now).distinct()).distinct().coalesce(tasks), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        state, n = tuple(seen), seen[0]
