"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestone.llm import store


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``links(a, b)``; the label is the component's least node.

    Alternating star steps (Kiveris et al. 2014): each node links its greater
    neighbours, then its lesser ones, to the least of them.  The number of
    links never grows, and the rounds are about the logarithm of a component's
    width.  Each round is a table in the shared folder and three shuffles.
    Null ends are ignored; links may repeat or join a node to itself.
    """
    edges = store.written(links.select("a", "b").filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    least, seen = F.min("v").over(Window.partitionBy("u")), _mark(edges)
    while seen[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        nxt = store.written(large.withColumn("m", least).select(F.inline(ends)).filter("u <> v").distinct(), "links")
        mark = _mark(nxt)
        store.forget(edges)
        edges = nxt
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mark(edges: DataFrame) -> Row:
    """The number of links and a hash of them all."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
