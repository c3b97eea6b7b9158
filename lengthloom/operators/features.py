"""What models see of a candidate, and how much a row weighs in training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The flags that features show; the reach of parents (points).
FLAGS = ("overall_mark", "overall_pair", "handwheel", "insulation", "support_repeat", "near_plant_coord", "near_endpoint", "nested_offset")
REACH = 190.0
#: A coordinate of the plant, with its number; numbers from this one on are meant.
PLANT_COORD, PLANT_LEAST = r"(?iU)\b([XYZ]\+?)\s*([0-9]{4,6})\b", 9000


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def near_plant_coord(nearby: str = "nearby", value: str = "value_mm") -> Column:
    """Whether a coordinate of the plant stands beside a value; a number equal to the value itself is none."""
    numbers = F.transform(F.regexp_extract_all(nearby, F.lit(PLANT_COORD), F.lit(2)), lambda n: n.cast("int"))
    return F.coalesce(F.exists(numbers, lambda n: (n >= PLANT_LEAST) & (n != F.col(value))), F.lit(False))


def features(c: DataFrame, parents: DataFrame) -> DataFrame:
    """The features of candidates whose parents (sheet_no, ord, parent_ord, score) are a table. Both joins are by sheet and number."""
    on = ["sheet_no", "ord"]
    above = c.select("sheet_no", F.col("ord").alias("parent_ord"), "value_mm", "x", "y").alias("p")
    up = parents.select(*on, "parent_ord", "score").join(above, ["sheet_no", "parent_ord"], "left").select(*on, F.struct("score", "p.value_mm", "p.x", "p.y").alias("up"))
    return shown(c.join(up, on, "left"))


def shown(c: DataFrame) -> DataFrame:
    """sheet_no, ord and the features of with_features."""
    return with_features(c).select("sheet_no", "ord", "features.*")


def with_features(c: DataFrame) -> DataFrame:
    """Candidates with features, a struct of 28 doubles.

    c: candidates with value_mm, x, y, nearby, flags (an array of names), dist_to_line, parallel_score and up, the parent's score,
    value_mm, x and y; nulls count as empty or zero.
    """
    d = c.withColumns({"_score": F.col("up.score"), "_pv": F.col("up.value_mm"), "_px": F.col("up.x"), "_py": F.col("up.y")})
    low, v = F.lower(F.coalesce("nearby", F.lit(""))), F.coalesce("value_mm", F.lit(0))
    larger = F.array_max(F.filter(F.transform(F.regexp_extract_all(low, F.lit("[0-9]+"), F.lit(0)), lambda n: n.try_cast("long")), lambda n: n > v))
    d = d.withColumns({"_low": low, "_v": v, "_larger": larger})
    dx, dy, near = F.col("x") - F.col("_px"), F.col("y") - F.col("_py"), F.col("_low")
    x = F.struct(
        F.col("_v").cast("double").alias("value"), F.round(F.log1p(F.greatest("_v", F.lit(0))), 9).alias("log_value"), F.coalesce(F.col("x"), F.lit(0.0)).alias("x"), F.coalesce(F.col("y"), F.lit(0.0)).alias("y"),
        _yes(F.col("_v") >= 8000).alias("big"), _yes(F.col("_v") <= 200).alias("small"), _yes(near.rlike(r"(?U)\bz\+?\b")).alias("has_z"),
        *(_yes(F.contains(near, F.lit(t))).alias(n) for n, t in (("has_sm", "см"), ("has_dn", "dn"), ("has_lt", "lt"))),
        F.when(F.trim(near) == "", 0.0).otherwise(F.size(F.split(near, "[|]")).cast("double")).alias("n_near"),
        _yes(F.col("_larger").isNotNull()).alias("has_larger_near"), F.coalesce(F.round(F.col("_v") / F.col("_larger"), 9), F.lit(0.0)).alias("nested_ratio"),
        _yes(near.rlike("[оo][0-9]")).alias("support_mark"), *(_yes(F.array_contains("flags", f)).alias(f"f_{f}") for f in FLAGS),
        _yes(F.col("_score") >= 0.75).alias("has_parent"), F.coalesce("_score", F.lit(0.0)).alias("geo_confidence"), F.when(F.col("_pv") > 0, F.round(F.col("_v") / F.col("_pv"), 9)).otherwise(0.0).alias("parent_ratio"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.sqrt(dx * dx + dy * dy) / REACH, F.lit(0.0))), 9).alias("parent_dist_norm"), *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in ("dist_to_line", "parallel_score")),
    )
    return d.withColumn("features", x).drop("_low", "_v", "_larger", "_score", "_pv", "_px", "_py")


def weight() -> Column:
    """How much a row with value_mm, nearby, flags, decision, locked and reviewed_by_human weighs: costly mistakes count more."""
    has = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    v = F.col("value_mm")
    alone = F.filter(F.split(F.coalesce("nearby", F.lit("")), r"[\s|]+"), lambda t: t.rlike("^[0-9]+$"))
    larger = F.array_max(F.filter(F.transform(alone, lambda t: t.try_cast("long")), lambda n: (n > v) & (v > 0)))
    factors = (
        (F.coalesce("locked", F.lit(False)) | F.coalesce("reviewed_by_human", F.lit(False)), 8.0), (has("overall_mark", "overall_pair"), 5.0), (has("nested_offset"), 2.0), (has("handwheel", "insulation"), 3.5), (has("support_repeat"), 2.5), ((v / larger).between(0.12, 0.55), 3.0),
        (F.col("decision") == "exclude_nested", 1.2), (F.col("decision") == "not_length", 1.6), (v >= 2000, 1.8), (v <= 25, 2.0),
    )
    product = F.lit(1.0)
    for when, k in factors:
        product = product * F.when(when, F.lit(k)).otherwise(F.lit(1.0))
    return product
