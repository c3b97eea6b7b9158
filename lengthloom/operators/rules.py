"""Correction rules on decisions alone: the short chain, locks, edits and sheet totals. guards.py has the whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..arrays import F, Window
INCLUDE, NESTED, OTHER, OPEN = "include", "exclude_nested", "not_length", "ambiguous"


def facts(c: DataFrame) -> DataFrame:
    """What the rules ask of a sheet: how often a value occurs, and whether it is a handwheel's."""
    if "n_same" in c.columns:
        return c
    w = Window.partitionBy("sheet_no", "value_mm")
    d = c.withColumns({"n_same": F.count("*").over(w), "wheel_value": F.max(F.col("f_handwheel").cast("int")).over(w) == 1})
    return d.withColumns({"support_repeat": (F.col("n_same") >= 3) & F.col("value_mm").between(50, 200), "small_repeat": (F.col("n_same") >= 3) & (F.col("value_mm") <= 25)})


def _set(d: DataFrame, when: Column, new: str | Column) -> DataFrame:
    return d.withColumn("decision", F.when(when, new).otherwise(F.col("decision")))


def _is(*kinds: str) -> Column:
    return F.col("decision").isin(*kinds)


def mark_overalls(d: DataFrame) -> DataFrame:
    """Overall marks are nested."""
    return _set(d, F.col("f_overall_mark") & _is(INCLUDE, NESTED), NESTED)


def row_rules(d: DataFrame) -> DataFrame:
    """Rules on one row: overall marks are nested; handwheels, insulation, repeats, coordinates and tiny values no lengths."""
    d = mark_overalls(d)
    d = _set(d, _is(INCLUDE, OPEN) & (F.col("f_handwheel") | (F.col("wheel_value") & ~F.col("f_pipe_opening"))), OTHER)
    d = _set(d, _is(INCLUDE, OPEN) & F.col("f_insulation_thickness"), OTHER)
    d = _set(d, _is(INCLUDE) & F.col("support_repeat"), OTHER)
    d = _set(d, _is(INCLUDE) & F.col("f_near_plant_coord") & (F.col("value_mm") >= 9000), OTHER)
    return _set(d, _is(INCLUDE, OPEN) & ((F.col("value_mm") <= 16) | F.col("small_repeat")), OTHER)


def nested_offsets(d: DataFrame) -> DataFrame:
    """A candidate with a sure parent (has_parent) is nested, unless it is an overall mark."""
    return _set(d, F.col("has_parent") & _is(INCLUDE, OPEN, NESTED) & ~F.col("f_overall_mark"), NESTED)


def restore_lengths(d: DataFrame) -> DataFrame:
    """What was called no length comes back, unless one of the reasons for it holds."""
    held = F.col("f_handwheel") | F.col("f_insulation_thickness") | F.col("support_repeat") | (F.col("wheel_value") & ~F.col("f_pipe_opening")) | (F.col("value_mm") <= 16) | F.col("small_repeat") | (F.col("f_near_plant_coord") & (F.col("value_mm") >= 9000))
    return _set(d, _is(OTHER) & ~held, INCLUDE)


def restore_twins(d: DataFrame) -> DataFrame:
    """A nested candidate without a parent comes back if it has a twin run (has_twin)."""
    return _set(d, _is(NESTED) & ~F.col("f_overall_mark") & ~F.col("has_parent") & F.col("has_twin"), INCLUDE)


def take_ambiguous(d: DataFrame) -> DataFrame:
    """What is still open counts, unless it is known to be no length."""
    held = F.col("f_handwheel") | F.col("f_insulation_thickness") | F.col("support_repeat") | (F.col("wheel_value") & ~F.col("f_pipe_opening")) | (F.col("value_mm") <= 16)
    return _set(d, _is(OPEN) & ~held, INCLUDE)


def unless_locked(d: DataFrame, rules) -> DataFrame:
    """rules on the rows that aren't locked; locked ones stay as they are."""
    return rules(d.withColumn("_was", F.col("decision"))).withColumn("decision", F.when(F.col("locked"), F.col("_was")).otherwise(F.col("decision"))).drop("_was")


def edit(d: DataFrame, edits: DataFrame) -> DataFrame:
    """An edit by hand moves a decision to the next class, the last to the first; edits name sheet_no and ord, each once."""
    kinds = F.array(*map(F.lit, (INCLUDE, NESTED, OTHER, OPEN)))
    following = F.element_at(kinds, (F.array_position(kinds, F.col("decision")) % 4 + 1).cast("int"))
    return _set(d.join(edits.select("sheet_no", "ord", F.lit(True).alias("_edited")), ["sheet_no", "ord"], "left").withColumn("_next", following), F.coalesce("_edited", F.lit(False)), F.col("_next")).drop("_edited", "_next")


def sheets(d: DataFrame) -> DataFrame:
    """A row a sheet: length, formula in order, status and counts."""
    on = F.col("decision") == INCLUDE
    parts = F.sort_array(F.collect_list(F.when(on, F.struct("ord", "value_mm"))))
    g = d.groupBy("sheet_no").agg(F.coalesce(F.sum(F.when(on, F.col("value_mm"))), F.lit(0)).cast("long").alias("length_mm"), parts.alias("p"), F.count_if(on).alias("n_included"), F.count_if(F.col("decision") == OPEN).alias("n_ambiguous"), F.count("*").alias("n_candidates"))
    text = F.when(F.col("n_included") > 0, F.concat(F.array_join(F.transform("p.value_mm", lambda v: v.cast("string")), " + "), F.lit(" = "), F.col("length_mm").cast("string"), F.lit(" мм"))).otherwise("")
    status = F.when(F.col("n_included") == 0, "error").when(F.col("n_ambiguous") > 0, "review").otherwise("ok")
    return g.select("sheet_no", "length_mm", text.alias("formula"), status.alias("status"), "n_included", "n_ambiguous", "n_candidates")
