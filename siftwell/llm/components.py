"""Connected components of a table of links, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.storage import staged


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Every node's neighbours move to the smallest of them: those above the node, or those below and the node itself."""
    if small:
        near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    lowest = near.groupBy("u").agg(F.min("v").alias("low"))
    lowest = lowest.select(F.col("u").alias("__u"), F.least("u", "low").alias("low"))
    # Hints keep a hot node's rows splittable and a table of nodes from being broadcast by mistake.
    moved = near.join(lowest.hint("merge"), F.col("u") == F.col("__u"))
    if small:
        moved = moved.select(F.col("v").alias("a"), F.col("low").alias("b")).union(lowest.select("__u", "low"))
    else:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node it is connected with, of every node that occurs in `links` (a, b).

    The links of each round are written to the shared folder and read again, so no round repeats the ones before it.
    Rounds grow with the logarithm of the longest path. Links of a node with itself or with null do not count.
    """
    links, seen = staged(links.where("a <> b").select("a", "b").distinct()), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = staged(_star(staged(_star(links, False)), True))
    # At the end every link leads from a node straight to the smallest of its component.
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select("b", "b").distinct())
