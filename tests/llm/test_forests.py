"""Blocks of a large group give few different edges."""

from pyspark.sql import functions as F

from lengthloom.llm import jaccard
from lengthloom.llm.components import components
from lengthloom.session import ship


def test_edges_of_one_large_group(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    one = F.lit(bytes(jaccard.HASHES))
    d = spark.range(600).select(F.lit(7).cast("long").alias("key"), F.xxhash64("id").alias("node"), one.alias("sig"), F.lit(600).cast("long").alias("size"))
    e = jaccard.candidate_edges(d, jaccard.least_matches(0.8, 1e-8)).cache()
    assert components(e).agg(F.count("*"), F.countDistinct("root")).first() == (600, 1)
    assert e.count() <= 600 + 30 * 30  # blocks hold about 20 rows; rows times blocks is 18,000
