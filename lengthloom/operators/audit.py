"""Faults between saved decisions and the candidates that they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("include", "exclude_nested", "not_length", "ambiguous")


def problems(saved: DataFrame, hits: DataFrame) -> DataFrame:
    """sheet_no, id, problem; id is null where a whole sheet is missing on one side, and nothing else is said of that sheet.

    saved: sheet_no, id, value_mm, decision. hits: sheet_no, id, value_mm, parent_id, geometry_confidence, parent_value_mm. Both
    are reduced to a row a number before they meet.
    """
    on = ["sheet_no", "id"]
    s = saved.groupBy(*on).agg(F.count("*").alias("n_s"), F.min("value_mm").alias("lo"), F.max("value_mm").alias("hi"), F.bool_or(~F.coalesce("decision", F.lit("ambiguous")).isin(*KINDS)).alias("odd"))
    conf, p = F.col("geometry_confidence"), F.col("parent_id")
    h = hits.groupBy(*on).agg(
        F.count("*").alias("n_h"), F.max("value_mm").alias("mm"), F.bool_or(F.col("value_mm").isNull()).alias("no_mm"), F.bool_or(~conf.between(0.0, 1.0)).alias("off"),
        F.collect_set(F.when(p.isNotNull(), F.struct(p.alias("id"), F.col("parent_value_mm").alias("mm")))).alias("ups"),  # one, but for repeated rows
    )
    sheets = s.select("sheet_no", F.lit(1).alias("a")).distinct().join(h.select("sheet_no", F.lit(1).alias("b")).distinct(), "sheet_no", "full")
    lost = sheets.select("sheet_no", F.lit(None).cast(hits.schema["id"].dataType).alias("id"), F.when(F.col("a").isNull(), "no_saved").when(F.col("b").isNull(), "no_hits").alias("problem")).filter("problem is not null")
    parents = h.select("sheet_no", F.col("id").alias("pid"), F.col("mm").alias("pmm"))
    ups = h.select(*on, F.explode("ups").alias("up")).withColumn("pid", F.col("up.id")).join(parents.withColumn("found", F.lit(True)), ["sheet_no", "pid"], "left")
    ups = ups.groupBy(*on).agg(F.bool_or(F.col("found").isNull()).alias("no_parent"), F.bool_or(F.coalesce(F.col("found") & (F.col("pmm") != F.col("up.mm")), F.lit(False))).alias("other_value"))
    d = s.join(h.drop("ups"), on, "full").join(ups, on, "left").join(lost, "sheet_no", "left_anti")
    checks = {
        "duplicate_saved": F.col("n_s") > 1, "duplicate_hits": F.col("n_h") > 1, "missing": F.col("n_s").isNull(), "extra": F.col("n_h").isNull(), "parent": F.col("no_parent"),
        "confidence": F.col("off"), "parent_value": F.col("other_value"), "value": (F.col("lo") != F.col("mm")) | (F.col("hi") != F.col("mm")), "class": F.col("odd"), "no_value": F.col("no_mm"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return lost.unionByName(d.select(*on, F.explode(found).alias("problem")))


def counts(saved: DataFrame, hits: DataFrame, locked: DataFrame) -> DataFrame:
    """job, sheets, candidates, locked, and the number of saved decisions of each class, a row a job and a last one (null) for all.

    saved and hits as in problems, with job; locked: job, sheet_no of locked sheets, which count where the sheet has hits.
    """
    h = hits.groupBy("job", "sheet_no").agg(F.count("*").alias("candidates"))
    h = h.join(locked.select("job", "sheet_no", F.lit(1).alias("locked")).distinct(), ["job", "sheet_no"], "left")
    kind = F.coalesce("decision", F.lit("ambiguous"))
    k = saved.groupBy("job", "sheet_no").agg(*(F.count_if(kind == c).alias(c) for c in KINDS))
    d = k.join(h, ["job", "sheet_no"], "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return d.rollup("job").agg(F.count("*").alias("sheets"), total("candidates"), total("locked"), *map(total, KINDS))
