"""Connected components of a link table by alternating large-star and small-star steps.

Nothing about single links or components reaches the driver: each step is a partial
aggregation and a join whose hot nodes (see common.attach) meet a bounded broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import attach, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _to_least(edges: DataFrame, total: int) -> DataFrame:
    """Each edge (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return attach(edges, least, "u", "n", total, "inner")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id of the links (u, v) the least id that links reach."""
    edges = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                        "edges")
    state = _state(edges)
    while state[0]:
        both = materialise(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
        large = _to_least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "edges")  # u > v holds: m <= u of the step < its larger neighbour
        near = _to_least(large, large.count())
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges, old = materialise(small, "edges"), state
        state = _state(edges)
        if state == old:
            break
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
