"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.session import materialise


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Hooks neighbours to the least node of a neighbourhood: the larger ones, or the smaller ones and itself."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = links.unionByName(turned) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(around.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")))
    hooked = around.join(least, "a")
    if larger:
        # links that repeat here go in the next half of the round
        return hooked.where("b > a and b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        hooked = hooked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return hooked.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component), the component being its least node.

    Large stars and small stars in turn until nothing changes: then every node
    hangs on the least of its component.  Rounds grow with the logarithm of the
    number of nodes; a table of the size of the links is written per step.
    Self links and repeated links are allowed; nulls and nodes without another
    are left out.
    """
    links = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a != b").distinct()
    )
    while True:
        hooked = materialise(_stars(materialise(_stars(links, larger=True)), larger=False))
        # done once no node has two neighbours below it and no neighbour below has one itself
        ends = hooked.select(F.explode(F.array(F.struct("a", F.lit(1).alias("up")), F.struct(F.col("b").alias("a"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.a").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
        if nodes.where("up > 1 or up = 1 and least = 0").isEmpty():
            break
        links = hooked
    return hooked.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        hooked.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
