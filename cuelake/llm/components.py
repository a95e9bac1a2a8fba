"""Connected components of a link table, in rounds of joins with the labels kept between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.jobfolder import cut, together


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every end of ``links`` (a, b): nodes of one component have one label, a node of it.

    Each b first joins the least of its a's; only the a's, which are few where links point from hubs, take part in
    the rounds. There a node takes the least label among its neighbours, then that label's own label. Labels are
    read back from the shared folder, so a node with very many links is split like any skewed join side. No table
    here has more than about twice the links' rows, so their number says how many partitions are worth their tasks.
    """
    links = cut(links.select("a", "b").filter("a <> b").distinct())
    n = links.count()
    links = together(links, n)
    main = cut(together(links.groupBy("b").agg(F.min("a").alias("main")), n))
    hubs = cut(together(links.select(F.col("a").alias("node")).distinct(), n))
    tied = links.join(main, "b").filter("a <> main").select("main", "a")
    both = main.join(hubs.withColumnRenamed("node", "b"), "b").select("main", F.col("b").alias("a"))
    labels = _least_labels(hubs, tied.unionByName(both).distinct(), n)
    of_main = main.join(hubs.withColumnRenamed("node", "b"), "b", "left_anti").join(
        labels.withColumnRenamed("node", "main"), "main"
    )
    return cut(together(labels.unionByName(of_main.select(F.col("b").alias("node"), "label")), n))


def _least_labels(nodes: DataFrame, links: DataFrame, n: int) -> DataFrame:
    edges = links.select(F.col("main").alias("node"), F.col("a").alias("other")).unionByName(
        links.select(F.col("a").alias("node"), F.col("main").alias("other"))
    )
    edges = cut(together(edges.distinct(), n))
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(
            F.min("label").alias("near")
        )
        nearer = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        moved = cut(together(nearer.join(jump, "new").select("node", "label", F.least("new", "further").alias("new")), n))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter(F.col("new") < F.col("label")).isEmpty():
            return labels
