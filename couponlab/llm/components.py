"""Connected components of links, by spreading the smallest label and following labels.

Each round writes its labels as a table, so lineage does not grow with the rounds and
the next round's joins read both sides straight from tables, where adaptive execution
can split a node with very many links.  Labels travel to the neighbours and then along
themselves, so a chain of n links takes about log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponlab.llm.tables import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node it can reach, for the nodes of the links.

    Links with a null end are left out; repeated links and loops do no harm; no links give no rows.
    """
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    forth = F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    back = F.struct(F.col(b).alias("node"), F.col(a).alias("other"))
    ends = F.explode(F.array(forth, back))
    edges = written(whole.select(ends.alias("e")).select("e.*").distinct(), "edges")
    first = edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    labels = written(first.select("node", "label", F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        offers = (
            edges.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("offer"))
        )
        nearest = written(
            labels.join(offers, "node", "left").select(
                "node", F.col("label").alias("was"), F.least("label", F.coalesce("offer", "label")).alias("near")
            ),
            "labels",
        )
        onward = nearest.select(F.col("node").alias("near"), F.col("near").alias("label"))
        labels = written(
            nearest.join(onward, "near", "left").select("node", "label", (F.col("label") < F.col("was")).alias("moved")), "labels"
        )
    return labels.select("node", "label")
