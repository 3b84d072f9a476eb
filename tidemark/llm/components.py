"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, release, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v). Large: every node ties its larger neighbours to its least neighbour or itself. Small: every
    node ties its smaller neighbours and itself to the least of them.

    The minima are written first, so the join has an exchange on either side and a hub's rows can be split at run time.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(both.groupBy("u").agg(F.min("v").alias("w")), "star").select(F.col("u").alias("x"), "w")
    joined = both.join(least, F.col("u") == F.col("x"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "w").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("w").alias("v")), F.struct(F.col("u").alias("u"), F.col("w").alias("v")))).alias("e")).select("e.u", "e.v")
        out = out.where("u <> v")
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: comparable, never null) that isn't its component's least node.

    Self-links and repeated links do no harm. Every step is a table in the shared folder; neither links nor nodes reach
    the driver, only their number and a checksum, by which it sees that nothing changes any more.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if seen == mark or not seen["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        before, edges = edges, settle(lambda known=edges: _star(materialize(_star(known, True), "large"), False), "small")
        release(before)
