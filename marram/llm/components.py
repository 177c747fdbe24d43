"""Connected components of an edge table, by alternating large and small stars.

This is union-find spread over the edges: each round hangs every node under the smallest node it
sees, and the forest flattens in a logarithmic number of rounds. Nothing is gathered on the
driver but two numbers a round, which tell whether anything moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import cut, spread_join


#: Edges whose hubs are no burden for one task; beyond, hubs are broadcast.
FEW_EDGES = 2_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (columns a, b); component is its smallest reachable id.

    Edges with a null end and loops count for nothing. Rows of a hub, to which a third of all nodes
    may be tied, meet the hub's smallest neighbour by a broadcast where there are many edges.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        large = spread_join(both.where("v > u"), least, ["u"], "rows", 2 * state[0], FEW_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
        met = spread_join(large, least, ["u"], "rows", 2 * state[0], FEW_EDGES)
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct())
        was, state = state, _state(now)
        if state == was:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
