"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def anew(c: str):
    """The same number as a new expression: a join on it deals both sides anew, so that a hub's partition can be split."""
    return F.shiftright(c, 0).alias(c)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (id, component): the smallest id that a chain of links reaches, for every linked id.

    Each round writes its edges to the shared folder. A hub's edges are dealt by an aggregate with partial sums and
    a join that adaptive execution may split, so that no task needs a hub whole. Self-links and nulls are ignored; an
    empty table gives an empty result.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(anew("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(anew("u"), "m")
        small = large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u <> v").distinct(), "edges")
        row = after.agg(
            F.count("*").alias("n"),
            F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"),
            F.max("v").alias("x"),
        ).first()
        discard(edges, large)
        edges, before, state = after, state, tuple(row)
        if state == before or not state[0]:
            break
    else:
        raise RuntimeError("connected_components: more rounds than allowed")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
