"""Evaluation of classes: confusion, scores, sheet errors, abstention; splits and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLASSES = ("include", "exclude_nested", "not_length")


def confusion(rows: DataFrame) -> DataFrame:
    """Counts by true and predicted class; all classes are there."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(a, b) for a in CLASSES for b in CLASSES], "y string, pred string")
    return every.join(rows.groupBy("y", "pred").count(), ["y", "pred"], "left").select("y", "pred", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support by class; 0 where a denominator is."""
    both = rows.select(F.explode(F.array(*map(F.lit, CLASSES))).alias("class"), "y", "pred").groupBy("class")
    t, p = F.col("y") == F.col("class"), F.col("pred") == F.col("class")
    g = both.agg(F.count_if(t & p).alias("tp"), F.count_if(p).alias("np"), F.count_if(t).alias("support"))
    g = g.withColumns({"precision": F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), "recall": F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return g.select("class", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(f1, 9).alias("f1"), "support")


def _f1(tp: str, np: str, support: str):
    return F.when(F.col(np) + F.col(support) > 0, 2 * F.col(tp) / (F.col(np) + F.col(support))).otherwise(0.0)


def overall_metrics(rows: DataFrame) -> DataFrame:
    """n, accuracy, macro_f1 and weighted_f1 over the fixed classes; a class that never occurs counts 0."""
    y, p = F.col("y"), F.col("pred")
    per = [F.struct(F.count_if((y == c) & (p == c)).alias("tp"), F.count_if(p == c).alias("np"), F.count_if(y == c).alias("support")) for c in CLASSES]
    g = rows.agg(F.count("*").alias("n"), (F.count_if(y == p) / F.count("*")).alias("acc"), F.array(*per).alias("per"))
    d = g.select("n", "acc", F.inline("per")).withColumn("f1", _f1("tp", "np", "support"))
    return d.groupBy("n").agg(F.round(F.first("acc"), 9).alias("accuracy"), F.round(F.avg("f1"), 9).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 9).alias("weighted_f1"))


def choose_threshold(rows: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9), least: float = 0.9, by: tuple[str, str] = ("f1", "coverage")) -> DataFrame:
    """The threshold that is best ``by`` two of f1, coverage, accuracy, then the least, among those accurate enough (all, if none is)."""
    y, p = F.col("y"), F.col("pred")
    d = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    on = F.col("conf") >= F.col("threshold")
    per = [F.struct(F.count_if(on & (y == c) & (p == c)).alias("tp"), F.count_if(on & (p == c)).alias("np"), F.count_if(y == c).alias("support")) for c in CLASSES]
    g = d.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(on).alias("k"), F.count_if(on & (y == p)).alias("right"), F.array(*per).alias("per"))
    g = g.select("threshold", (F.col("k") / F.col("n")).alias("coverage"), F.when(F.col("k") > 0, F.col("right") / F.col("k")).otherwise(0.0).alias("accuracy"), F.inline("per")).withColumn("f1", _f1("tp", "np", "support"))
    g = g.groupBy("threshold", "coverage", "accuracy").agg(F.avg("f1").alias("f1"))
    best = F.max(F.struct((F.col("accuracy") >= least).alias("ok"), *(F.round(c, 12).alias(f"by_{c}") for c in by), (-F.col("threshold")).alias("t"), "coverage", "accuracy", "f1")).alias("m")
    return g.agg(best).filter("m is not null").select((-F.col("m.t")).alias("threshold"), F.round("m.coverage", 9).alias("coverage"), F.round("m.accuracy", 9).alias("accuracy"), F.round("m.f1", 9).alias("macro_f1"))


def winner(p: Column) -> Column:
    """Struct of pred and p from an array of probabilities by class: the greatest, to nine digits; the first wins a tie."""
    best = F.array_max(F.array(*(F.struct(F.round(p[i], 9).alias("p"), F.lit(-i).alias("i")) for i in range(len(CLASSES)))))
    return F.struct(F.element_at(F.array(*map(F.lit, CLASSES)), 1 - best["i"]).alias("pred"), best["p"].alias("p"))


def soft_vote(votes: DataFrame, key: str) -> DataFrame:
    """key, pred, confidence from members' arrays of probabilities: the class with the greatest mean; the first wins a tie."""
    g = votes.groupBy(key).agg(F.array(*(F.avg(F.col("probabilities")[i]) for i in range(len(CLASSES)))).alias("p")).withColumn("b", winner(F.col("p")))
    return g.select(key, "b.pred", F.col("b.p").alias("confidence"))


def sheet_errors(rows: DataFrame) -> DataFrame:
    """Mean, median and greatest absolute difference of included sums by group."""
    s = lambda c: F.sum(F.when(F.col(c) == "include", F.col("value_mm")).otherwise(0))
    e = rows.groupBy("grp").agg(F.abs(s("pred") - s("y")).alias("e"))
    return e.agg(F.round(F.avg("e"), 6).alias("mae"), F.median("e").alias("median_ae"), F.max("e").cast("long").alias("max_ae"), F.count("*").alias("n_groups"))


def threshold_sweep(rows: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Coverage, and accuracy on what is accepted, for each confidence threshold."""
    d = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    on = F.col("conf") >= F.col("threshold")
    g = d.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(on).alias("k"), F.count_if(on & (F.col("y") == F.col("pred"))).alias("right"))
    return g.select("threshold", F.round(F.col("k") / F.col("n"), 9).alias("coverage"), F.round(F.when(F.col("k") > 0, F.col("right") / F.col("k")).otherwise(0.0), 9).alias("accuracy"))


def islands(d: DataFrame, gap: float = 14.0, span: float = 1440.0) -> DataFrame:
    """Intervals of a bucket joined over gaps: begin, end and size of each island.

    A bucket is cut into ranges of ``span`` by where intervals begin. Windows run inside a range; what reaches out of the ranges
    before, and how many islands have begun there, comes from a table with a row a range. So no task sorts a whole bucket.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("part", F.floor(F.col("t0") / span))
    inside, parts = Window.partitionBy("bucket", "part").orderBy("t0", "ord"), Window.partitionBy("bucket").orderBy("part")
    tops = d.groupBy("bucket", "part").agg(F.max("t1").alias("top")).withColumn("earlier", F.max("top").over(before(parts))).drop("top")
    d = d.withColumn("reach", F.max("t1").over(before(inside))).join(tops, ["bucket", "part"])
    d = d.withColumn("new", F.coalesce((F.col("t0") > F.greatest("reach", "earlier") + gap).cast("int"), F.lit(1)))
    d = d.withColumn("here", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    begun = d.groupBy("bucket", "part").agg(F.sum("new").alias("n")).withColumn("begun", F.coalesce(F.sum("n").over(before(parts)), F.lit(0))).drop("n")
    d = d.join(begun, ["bucket", "part"]).withColumn("island", F.col("begun") + F.col("here"))
    return d.groupBy("bucket", "island").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"), F.round(F.max("t1") - F.min("t0"), 3).alias("extent"))
