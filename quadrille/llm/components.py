"""Connected components of links that no machine needs to hold as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in the links (a, b).

    Each round every id takes the smallest label among its own and its neighbours', passes it to the id that was its
    label, and then takes its label's label; chains shrink by half or more a round. Tables are written between rounds.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(both.distinct(), thin=True)
    labels = both.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l"))
    while True:
        labels = cut(labels, thin=True)
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        own = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        told = own.select(F.col("l").alias("u"), "m").unionByName(own.select("u", "m")).groupBy("u").agg(F.min("m").alias("m"))
        told = cut(labels.join(told, "u").select("u", "l", F.least("l", "m").alias("m")), thin=True)
        if told.where("l <> m").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("l").alias("component"))
        parent = told.select(F.col("u").alias("m"), F.col("m").alias("top"))
        labels = told.join(parent, "m").select("u", F.col("top").alias("l"))
