"""What texts on a sheet say about candidates: marker texts, openings, marks to draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the parts table, of the title block, and of openings; what isn't an opening.
PARTS_TABLE = r"(?iU)Длина,\s*мм|Поз\.\s*№|ItemCode|Кол-во|ДЛИНЫ\s+ОТРЕЗКОВ|СПЕЦИФИКАЦИЯ\s+МАТЕРИАЛОВ"
TITLE = r"(?iU)°C|МПа|Гидр\.|Класс трубопровода|Рабоч(?:ая|ее)\s+температур|Давление испытаний"
OPENING = r"(?iU)ОТВЕРСТ|ВРЕЗК|СЪ[ЕЁ]МН\w{0,8}\s*УЧАСТ|HOLE|OPENING|\bSTUB\b"
NO_OPENING = "ЗАГЛУШКА|ЗКС-|ЗКС "
#: Reach of the markers in points.
REACH = {"overall": 90.0, "handwheel": 40.0, "insulation": 100.0, "opening": 140.0}
COLOURS = {"include": "green", "exclude_nested": "orange", "not_length": "grey", "ambiguous": "red"}


def _kind() -> Column:
    t = F.upper(F.trim("text"))
    short = F.regexp_replace(t, "^[ .,;:]+|[ .,;:]+$| ", "")
    return F.when(short.rlike(r"^[НH]\.?[ОO]\.?$"), "overall").when(t.contains("ШТУРВАЛ"), "handwheel").when(t.rlike("ИЗОЛЯЦ|ОБОГРЕВ"), "insulation").when(t.rlike(OPENING) & ~t.rlike(NO_OPENING), "opening")


def _around(c: DataFrame, markers: DataFrame, *kinds: str) -> DataFrame:
    """Markers of these kinds with the candidates of their sheet within the kind's reach."""
    reach = F.element_at(F.create_map(*(F.lit(v) for kv in REACH.items() for v in kv)), F.col("kind"))
    m = markers.withColumn("kind", _kind()).filter(F.col("kind").isin(*kinds)).select(F.col("sheet_no").alias("s"), "kind", "mark", F.col("x").alias("mx"), F.col("y").alias("my"), reach.alias("reach"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return c.join(m, (F.col("sheet_no") == F.col("s")) & (dx * dx + dy * dy <= F.col("reach") * F.col("reach")))


def marker_flags(c: DataFrame, markers: DataFrame) -> DataFrame:
    """sheet_no, ord, flag. An overall mark goes to the largest value around it (the first of equal ones), others to all.

    Insulation within 14 points of its text is a thickness too.
    """
    near = _around(c, markers, "overall", "handwheel", "insulation")
    largest = near.filter("kind = 'overall'").groupBy("sheet_no", "mark", "mx", "my").agg(F.max(F.struct("value_mm", (-F.col("ord")).alias("o"))).alias("m")).select("sheet_no", (-F.col("m.o")).alias("ord"), F.lit("overall_mark").alias("flag"))
    inside = (F.abs(F.col("x") - F.col("mx")) <= 14) & (F.abs(F.col("y") - F.col("my")) <= 14)
    flags = F.when(F.col("kind") == "handwheel", F.array(F.lit("handwheel"))).when(inside, F.array(F.lit("insulation"), F.lit("insulation_thickness"))).otherwise(F.array(F.lit("insulation")))
    return largest.unionByName(near.filter("kind <> 'overall'").select("sheet_no", "ord", F.explode(flags).alias("flag"))).distinct()


def opening_flags(c: DataFrame, markers: DataFrame) -> DataFrame:
    """sheet_no, ord of candidates with an opening's label within reach."""
    return _around(c, markers, "opening").select("sheet_no", "ord").distinct()


def markup(c: DataFrame) -> DataFrame:
    """A box of 12 points, a tag and the decision's colour for every candidate."""
    colour = F.element_at(F.create_map(*(F.lit(v) for kv in COLOURS.items() for v in kv)), F.col("decision"))
    return c.select("sheet_no", "ord", F.concat("cid", F.lit("="), F.col("value_mm").cast("string")).alias("tag"), *((F.col(a) + k).alias(f"{a}{i}") for i, k in enumerate((-6, 6)) for a in "xy"), colour.alias("colour"))
