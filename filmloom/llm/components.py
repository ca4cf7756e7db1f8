"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filmloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id that occurs in the links a, b.

    Each round takes the least label among the neighbours and then the label of that label, so long chains shorten by
    half. Labels stay in tables of the shared folder; joins run on ids and labels, minima are added up before shuffles.
    Links of a row with itself and null ids are left out.
    """
    links = links.select("a", "b").filter(F.col("a") != F.col("b"))
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
                   .select("id", F.least("id", "b").alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
                .agg(F.min("component").alias("near")))
        stepped = saved(labels.join(near, "id").select("id", F.col("component").alias("before"),
                                                       F.least("component", "near").alias("label")), "steps")
        own = stepped.select(F.col("id").alias("label"), F.col("label").alias("further"))
        jumped = saved(stepped.join(own, "label", "left").select(
            "id", "before", F.coalesce("further", "label").alias("component")), "labels")
        labels = jumped.select("id", "component")
        if jumped.filter(F.col("before") != F.col("component")).isEmpty():
            return labels
