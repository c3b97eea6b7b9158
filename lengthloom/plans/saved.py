"""Queries on saved results, usage and trained classes, with the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..arrays import F
from ..operators import classes, features, guards, models, pairs, rules, splits
from ..session import kept
from ..sources import adapters as A
from . import runs
from .oracle import A1

def _c(spark, sf) -> DataFrame:
    return A.candidates(A.table(spark, sf, "lineitem"))


def valid_saves(spark, sf) -> DataFrame:
    """Whether a sheet's saved decisions still hold: every wanted id is there with the same value."""
    c = _c(spark, sf).select("sheet_no", "ord", "value_mm")
    saved = c.filter("ord <> 6 or sheet_no % 3 <> 0").selectExpr("sheet_no", "ord", "value_mm + case when ord = 5 and sheet_no % 4 = 0 then 1 else 0 end as saved_mm")
    g = c.join(saved, ["sheet_no", "ord"], "left").groupBy("sheet_no").agg(F.count("*").alias("n_wanted"), F.count_if(F.col("saved_mm").isNull() | (F.col("saved_mm") != F.col("value_mm"))).alias("n_stale"))
    return g.withColumn("valid", F.col("n_stale") == 0)


def usage(spark, sf) -> DataFrame:
    """Characters sent and got, calls and characters a turn of every conversation."""
    n = F.coalesce(F.length("text"), F.lit(0))
    of = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, n)), F.lit(0)).cast("long")
    g = A.table(spark, sf, "conversations").groupBy("conv_id").agg(of("user").alias("sent"), of("assistant").alias("got"), F.count_if(F.col("role") == "assistant").alias("calls"), F.countDistinct("turn").alias("n_turns"))
    return g.select("conv_id", "sent", "got", "calls", F.round((F.col("sent") + F.col("got")) / F.greatest("n_turns", F.lit(1)), 6).alias("per_turn"))


def merged_rows(spark, sf) -> DataFrame:
    """Rows of two jobs, once a key; the first job's row wins."""
    c = _c(spark, sf).select("sheet_no", "ord", "value_mm", "decision")
    first, second = c.filter("ord % 2 = 0"), c.filter("ord % 3 = 0").withColumn("decision", F.lit("ambiguous"))
    return first.unionByName(second.join(first, ["sheet_no", "ord"], "left_anti"))


#: What features and weights read of a candidate, as the rules find it.
SHOWN = "value_mm int, x double, y double, nearby string, f_overall_mark boolean, f_overall_pair boolean, f_handwheel boolean, f_insulation_thickness boolean, support_repeat boolean, f_near_plant_coord boolean, f_nested_offset boolean, up struct<score:double,ord:int,value_mm:int,x:double,y:double>"


def learned(c: DataFrame) -> DataFrame:
    """sheet_no, ord, held_out, the decision that the rules leave, and what features read of a candidate before them."""
    names = [f.split(" ")[0] for f in SHOWN.split(", ")]
    d = pairs.with_parent(rules.facts(runs.paired(c))).withColumn("seen", F.struct(*names))
    return guards.correct(d.drop("up")).select("sheet_no", "ord", "held_out", "decision", *(F.col(f"seen.{n}").alias(n) for n in names))


def _training(spark, sf) -> DataFrame:
    """Candidates with their 28 features, the decision that the rules leave as the label, the weight, and every fifth sheet held out."""
    held = splits.folds(A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet_no")).filter("sheet_no is not null"), "sheet_no", 5).select("sheet_no", (F.col("fold") == 0).alias("held_out"))
    c = runs.on_sheets(spark, sf, learned, f"sheet_no bigint, ord int, held_out boolean, decision string, {SHOWN}", lambda c: c.join(held, "sheet_no"))  # joined while a row is narrow and lies by sheet
    return kept(features.with_features(A.with_notes(c)).select("sheet_no", "ord", "features.*", "decision", features.weight().alias("weight"), "held_out"))


def _names(d: DataFrame) -> list[str]:
    return [n for n in d.columns if n not in ("sheet_no", "ord", "decision", "weight", "held_out")]


def cascade_classes(spark, sf) -> DataFrame:
    """Classes of all candidates by two models trained on four fifths of the sheets; training differs, so there is no SQL."""
    d = _training(spark, sf)
    model = classes.fit_cascade(d.filter(~F.col("held_out")), _names(d), "decision", "weight")
    return model.classify(d).select("sheet_no", "ord", "held_out", "decision", "linear", "forest", "confidence", "pred")


def forest_classes(spark, sf) -> DataFrame:
    """Classes of all candidates by the mean of five forests; training differs, so there is no SQL."""
    d = _training(spark, sf)
    model = models.fit_forests(d.filter(~F.col("held_out")), _names(d), "decision", "weight")
    return model.classify(d).select("sheet_no", "ord", "held_out", "decision", "pred", "confidence", "why")


ORACLE = {
    "valid_saves": f"""with {A1}, s as (select sheet_no, ord, value_mm + case when ord = 5 and sheet_no % 4 = 0 then 1 else 0 end as saved_mm from a1 where ord <> 6 or sheet_no % 3 <> 0)
    select a1.sheet_no, count(*) as n_wanted, count(*) filter (saved_mm is null or saved_mm <> value_mm) as n_stale, count(*) filter (saved_mm is null or saved_mm <> value_mm) = 0 as valid
    from a1 left join s on a1.sheet_no = s.sheet_no and a1.ord = s.ord group by a1.sheet_no""",
    "usage": """with g as (select conv_id, cast(coalesce(sum(length(text)) filter (role = 'user'), 0) as bigint) as sent, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as got,
      count(*) filter (role = 'assistant') as calls, count(distinct turn) as n_turns from conversations group by conv_id)
    select conv_id, sent, got, calls, round((sent + got) / greatest(n_turns, 1), 6) as per_turn from g""",
    "merged_rows": f"""with {A1} select sheet_no, ord, value_mm, decision from a1 where ord % 2 = 0
    union all select sheet_no, ord, value_mm, 'ambiguous' from a1 where ord % 3 = 0 and ord % 2 <> 0""",
}
QUERIES = {"valid_saves": valid_saves, "usage": usage, "merged_rows": merged_rows, "cascade_classes": cascade_classes, "forest_classes": forest_classes}
#: Queries that SQL can't express.
WITHOUT_SQL = {"cascade_classes", "forest_classes"}
