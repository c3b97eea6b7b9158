"""A page's nested text as runs, why a run is no dimension, the candidates that are left, and what the page says of itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import marks as M

#: Radius and number of the texts beside a run; parts of the page that are list or stamp; patterns of runs.
NEAR, SHOWN = 55.0, 12
RIGHT, BOTTOM, CORNER, TABLE_LEFT, TABLE_END = 0.68, 0.86, (0.72, 0.32), 0.62, 0.92
COORDINATE, DIAMETER, SUPPORT, BALLOON = r"(?iU)^(X|Y|Z\+?)\s*[0-9]+$", r"(?iU)^DN[0-9]", r"(?iU)^[ОOФFПP][0-9]+[АAБB]?$", r"^<[0-9]+>$"
SHEET, LINE, SMALLEST = r"(?iU)Лист\s*([0-9]+)\s*из\s*([0-9]+)", r"(?i)^[A-Z]{1,8}[0-9]{0,3}_[0-9]{3,5}$", 16


def page():
    return Window.partitionBy("sheet_no")


def plain(text: str = "text") -> Column:
    """A run's text with common spaces."""
    return F.replace(text, F.lit(" "), F.lit(" "))


def spans(pages: DataFrame) -> DataFrame:
    """sheet_no, width, height, span (block, line, number), text, x, y (the box's middle), bbox, size, direction.

    pages: sheet_no, width, height, blocks of type, lines of dir, spans of text, bbox, size. Blocks that aren't text and empty runs
    give nothing; a missing direction is (1, 0), a missing size 0.
    """
    d = pages.select("sheet_no", "width", "height", F.posexplode("blocks").alias("block", "b")).filter("b.type = 0")
    d = d.select("sheet_no", "width", "height", "block", F.posexplode("b.lines").alias("line", "l"))
    way = F.coalesce("l.dir", F.array(F.lit(1.0), F.lit(0.0)))
    d = d.select("sheet_no", "width", "height", "block", "line", way.alias("direction"), F.posexplode("l.spans").alias("number", "s"))
    mid = lambda i: (F.col("s.bbox")[i] + F.col("s.bbox")[i + 2]) / 2
    d = d.withColumn("text", F.regexp_replace(F.coalesce("s.text", F.lit("")), r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    return d.select("sheet_no", "width", "height", F.struct("block", "line", "number").alias("span"), "text", mid(0).alias("x"), mid(1).alias("y"), "s.bbox", F.coalesce("s.size", F.lit(0.0)).alias("size"), "direction")


def with_nearby(s: DataFrame) -> DataFrame:
    """Runs with nearby: distinct texts within 55 points, in order, the first 12, joined by a bar. Only numbers ask.

    A row reads its page's runs off an array, so pages that lie together are not shuffled again.
    """
    d = s.withColumn("_page", F.collect_list(F.when(F.col("sheet_no").isNotNull(), F.struct(F.col("span").alias("o"), F.col("text").alias("t"), "x", "y"))).over(page()))

    def near(b):
        dx, dy = F.col("x") - b["x"], F.col("y") - b["y"]
        return (b["o"] != F.col("span")) & (dx * dx + dy * dy <= NEAR * NEAR)

    texts = F.transform(F.sort_array(F.filter("_page", near)), lambda b: b["t"])
    joined = F.array_join(F.slice(F.array_distinct(texts), 1, SHOWN), " | ")
    return d.withColumn("nearby", F.when(F.trim(plain()).rlike("^[0-9]+$"), joined).otherwise("")).drop("_page")


def reasons(s: DataFrame) -> DataFrame:
    """Runs (with nearby) with reason: why they are no candidate, ``candidate``, or null for other text.

    Coordinates, diameters, support tags and balloons go by their text. A number goes by its place (the table of cut lengths from its
    header down, the right column, the bottom, the upper corner), then by words beside it, then as an index up to 16.
    """
    up = F.upper(plain())
    headed = F.when(F.col("sheet_no").isNotNull() & up.contains("ДЛИНЫ") & up.contains("ОТРЕЗК"), F.col("span"))
    d = s.withColumn("h", F.min_by(F.struct("bbox", "x"), headed).over(page()))
    w, h, x, y, t = F.col("width"), F.col("height"), F.col("x"), F.col("y"), F.trim(plain())
    left = F.least(F.greatest(F.lit(0.0), F.least(F.col("h.bbox")[0], F.col("h.x")) - w * 0.02), w * TABLE_LEFT)
    top = F.greatest(F.lit(0.0), F.col("h.bbox")[1] - h * 0.01)
    table = F.col("h").isNotNull() & x.between(left, w) & y.between(top, h * TABLE_END)
    inside = x.between(0, w) & y.between(0, h)
    frame = (
        F.when(table, "cut_lengths_table").when(inside & (x >= w * RIGHT), "materials_spec").when(inside & (y >= h * BOTTOM), "title_block").when(inside & (x >= w * CORNER[0]) & (y <= h * CORNER[1]), "title_block")
        .when(F.col("nearby").rlike(M.PARTS_TABLE), "cut_lengths_table").when(F.col("nearby").rlike(M.TITLE), "title_block")
    )
    number = F.coalesce(frame, F.when(t.try_cast("decimal(38,0)") <= SMALLEST, "bom_or_weld_index"), F.lit("candidate"))
    reason = (
        F.when(t.rlike(COORDINATE), "coordinate_xyz").when(F.replace(t, F.lit(" ")).rlike(DIAMETER), "nominal_diameter").when(t.rlike(SUPPORT), "support_tag").when(t.rlike(BALLOON), "item_balloon").when(t.rlike("^[0-9]+$"), number)
    )
    return d.withColumn("reason", reason).drop("h")


def candidates(s: DataFrame) -> DataFrame:
    """sheet_no, ord, value_mm, x, y, nearby, hint of the runs that are left, numbered in the order of the page."""
    near = F.upper("nearby")
    hint = F.concat(
        F.when(near.contains("ШТУРВАЛ"), "near_valve_handwheel").otherwise("dimension_candidate"), F.when(F.col("nearby").contains("СМ.") | near.contains("ПОДКЛЮЧЕНИЕ"), "|near_endpoint").otherwise(""),
        F.when(near.rlike(M.OPENING) & ~near.rlike(M.NO_OPENING), "|pipe_opening").otherwise(""),
    )
    ord_ = F.row_number().over(Window.partitionBy("sheet_no").orderBy("span"))
    return s.filter("reason = 'candidate'").select("sheet_no", ord_.alias("ord"), F.trim(plain()).cast("long").alias("value_mm"), "x", "y", "nearby", hint.alias("hint"), "bbox", "direction")


def meta(s: DataFrame) -> DataFrame:
    """sheet_no, line_id, number, count, source_page: the last of a page's runs that names each; a page without a line is UNKNOWN_n."""
    t, compact = plain(), F.upper(F.replace(plain(), F.lit(" ")))
    last = lambda c, when: F.max_by(c, F.when(when, F.col("span")))
    said = t.rlike(SHEET)
    part = lambda i: F.regexp_extract(t, SHEET, i).try_cast("int")
    g = s.groupBy("sheet_no").agg(
        last(compact, compact.rlike(LINE)).alias("line"), last(part(1), said).alias("number"), last(part(2), said).alias("count"), last(t, t.contains("Страница") | t.contains("исходного")).alias("source_page")
    )
    return g.select("sheet_no", F.coalesce("line", F.concat(F.lit("UNKNOWN_"), F.col("sheet_no").cast("string"))).alias("line_id"), "number", "count", F.coalesce("source_page", F.lit("")).alias("source_page"))
