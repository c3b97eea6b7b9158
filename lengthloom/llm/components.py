"""Connected components of an edge table, by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (id, root): root is the smallest id of its component; ids without an edge aren't listed.

    Each round, a node and its root take the smallest root among the neighbours, then every node jumps to its root's root.
    All steps are joins and minimum aggregates: a node of very many edges is pre-aggregated as an end and
    salted as a neighbour, and a root of very many nodes is salted. Every round is written to
    the shared folder; the driver sees only whether a node changed. Rounds go on until none does.
    """
    e = edges.select("a", "b").filter("a <> b").distinct()
    e = C.keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    p = C.keep(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("root")))
    while True:
        near = C.look_up(e, p.withColumnRenamed("id", "b"), "b", "a").groupBy("a").agg(F.min("root").alias("m")).withColumnRenamed("a", "id")
        both = p.join(near, "id")
        hooked = both.select("id", F.least("root", "m").alias("root")).unionByName(both.select(F.col("root").alias("id"), F.least("root", "m").alias("root")))
        hooked = hooked.groupBy("id").agg(F.min("root").alias("root"))
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = C.keep(C.look_up(hooked, up, "root", "id").select("id", F.coalesce("top", "root").alias("root")))
        changed = new.join(p.withColumnRenamed("root", "old"), "id").filter("root <> old").limit(1).count()
        p = new
        if not changed:
            return p
