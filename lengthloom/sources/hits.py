"""Documents of a job's sheets: what was found on them (hits) and what was decided, kept by job and sheet, corrected and confirmed.

A document is a JSON row under job=.../sheet_no=...; only the sheets that change are written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import guards as Q
from ..operators import lines as L
from ..operators import marks as M
from ..operators import pairs as P
from . import files

HIT = (
    "struct<id:string,value_mm:int,x:double,y:double,nearby:string,local_hint:string,flags:array<string>,bbox:array<double>,direction:array<double>,dim_line_id:string,dist_to_line:double,parallel_score:double,"
    "dim_endpoints:array<array<double>>,dim_axis:array<double>,dim_offset:double,parent_id:string,relation_kind:string,geometry_confidence:double,parent_value_mm:int,parent_dist:double>"
)
HITS = f"job string, sheet_no long, line_id string, width double, height double, relations_version int, candidates array<{HIT}>"
DECISIONS = f"job string, sheet_no long, {files.DECISIONS}"
#: Size of a page (points) and of its image (pixels) where a document doesn't say; parts of the image that are stamp or list.
PAGE, IMAGE = (1191.0, 842.0), (2150.0, 1521.0)
RIGHT, BOTTOM, CORNER = 0.68, 0.86, (0.72, 0.32)
#: Digits that a document keeps of each number.
DIGITS = {"bbox": 2, "direction": 6, "dist_to_line": 3, "parallel_score": 4, "dim_endpoints": 2, "dim_axis": 6, "dim_offset": 3, "geometry_confidence": 3, "parent_dist": 2}
FLAGS = ("overall_mark", "overall_pair", "handwheel", "insulation_thickness", "near_plant_coord", "pipe_opening", "nested_offset")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of HITS or DECISIONS, a row a sheet."""
    return spark.read.schema(schema).json(path)


def save(docs: DataFrame, path: str) -> None:
    """Write documents; the other sheets' files stay as they are."""
    docs.write.partitionBy("job", "sheet_no").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).json(path)


def _scale(docs: DataFrame) -> DataFrame:
    """docs with the pixels a point, sx and sy; a size that is missing or zero is the usual one."""
    size = lambda c, i: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(IMAGE[i]))
    return docs.withColumns({"width": size("width", 0), "height": size("height", 1)}).withColumns({"sx": F.col("width") / PAGE[0], "sy": F.col("height") / PAGE[1]})


def _filled(c: Column, n: int) -> Column:
    """An array of n numbers, or null."""
    return F.when((F.size(c) == n) & ~F.exists(c, F.isnull), c)


def candidates(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """A row a candidate: places in points, defaults for what a document leaves out, flags as columns; sheet_no is job/sheet.

    Numbers that are missing are 0, texts empty, the direction and axis (1, 0), ends (0, 0), a box the place and 5 points around. With
    ``spans`` (sheet_no of that form, text, x, y, bbox, direction), a missing box or direction is that of the nearest span
    with the value as its text. A place in the stamp or the list, or their words beside it, sets f_stamp.
    """
    d = _scale(docs).select("job", F.col("sheet_no").alias("no"), "width", "height", "sx", "sy", F.posexplode("candidates").alias("pos", "h"))
    num = lambda n: F.coalesce(F.col(f"h.{n}"), F.lit(0).cast("int" if n == "value_mm" else "double"))
    text = lambda n: F.coalesce(F.col(f"h.{n}"), F.lit(""))
    flags = F.coalesce("h.flags", F.array().cast("array<string>"))
    stamp = (num("x") >= F.col("width") * RIGHT) | (num("y") >= F.col("height") * BOTTOM) | ((num("x") >= F.col("width") * CORNER[0]) & (num("y") <= F.col("height") * CORNER[1])) | text("nearby").rlike(M.PARTS_TABLE) | text("nearby").rlike(M.TITLE)
    ends = F.when((F.size("h.dim_endpoints") == 2) & (F.size(F.flatten("h.dim_endpoints")) == 4), F.flatten("h.dim_endpoints")).otherwise(F.array(*[F.lit(0.0)] * 4))
    d = d.select(
        F.concat_ws("/", "job", F.col("no").cast("string")).alias("sheet_no"), "job", "no", (F.col("pos") + 1).alias("ord"), text("id").alias("cid"), num("value_mm").alias("value_mm"), (num("x") / F.col("sx")).alias("x"), (num("y") / F.col("sy")).alias("y"),
        text("nearby").alias("nearby"), text("local_hint").alias("local_hint"), flags.alias("flags"), _filled(F.col("h.bbox"), 4).alias("bbox"), _filled(F.col("h.direction"), 2).alias("direction"), F.nullif(F.col("h.dim_line_id"), F.lit("")).alias("line"),
        *(num(n).alias(n) for n in ("dist_to_line", "parallel_score")), ends.alias("ends"), _filled(F.col("h.dim_axis"), 2).alias("axis"), num("dim_offset").alias("offset"), F.col("h.parent_id").alias("parent_id"), text("relation_kind").alias("relation_kind"),
        num("geometry_confidence").alias("geometry_confidence"), F.col("h.parent_value_mm").alias("parent_value_mm"), num("parent_dist").alias("parent_dist"), (stamp | F.array_contains(flags, "stamp_or_bom")).alias("f_stamp"), *(F.array_contains(flags, f).alias(f"f_{f}") for f in FLAGS),
    )
    if spans is not None:
        found = nearest_spans(d, spans).withColumnsRenamed({"bbox": "_bbox", "direction": "_direction"})
        d = d.join(found, ["sheet_no", "ord"], "left").withColumns({n: F.coalesce(n, f"_{n}") for n in ("bbox", "direction")}).drop("_bbox", "_direction")
    d = d.withColumn("direction", F.coalesce("direction", F.array(F.lit(1.0), F.lit(0.0)))).withColumns({"axis": F.coalesce("axis", "direction"), "bbox": F.coalesce("bbox", F.array(*(F.col(a) + k for k in (-5, 5) for a in "xy")))})
    d = d.withColumns({"dir_x": F.col("direction")[0], "dir_y": F.col("direction")[1], **{n: F.col("ends")[i] for i, n in enumerate(("x1", "y1", "x2", "y2"))}})
    return d.withColumns({"nums": F.regexp_extract_all("nearby", F.lit("[0-9]+"), F.lit(0)), "lt": P.beside_lt()})


def nearest_spans(c: DataFrame, spans: DataFrame) -> DataFrame:
    """sheet_no, ord, bbox, direction of the nearest span of each candidate's sheet whose text is its value."""
    s = spans.select("sheet_no", F.trim("text").alias("_text"), F.col("x").alias("_x"), F.col("y").alias("_y"), "bbox", "direction")
    j = c.select("sheet_no", "ord", F.col("value_mm").cast("string").alias("_text"), "x", "y").join(s, ["sheet_no", "_text"])
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    return j.groupBy("sheet_no", "ord").agg(F.min_by(F.struct("bbox", "direction"), F.struct((dx * dx + dy * dy).alias("d"), "bbox")).alias("m")).select("sheet_no", "ord", "m.*")


def rounded(name: str, c: Column) -> Column:
    """A number, or numbers in arrays, with the digits that a document keeps."""
    n = DIGITS[name]
    if name == "dim_endpoints":
        return F.transform(c, lambda p: F.transform(p, lambda v: F.round(v, n)))
    return F.transform(c, lambda v: F.round(v, n)) if name in ("bbox", "direction", "dim_axis") else F.round(c, n)


def documents(c: DataFrame, heads: DataFrame) -> DataFrame:
    """Hits documents from candidates, in order: places in pixels, numbers with the digits of DIGITS, flags sorted.

    heads: job, sheet_no, line_id, width, height; a sheet without candidates gets an empty list.
    """
    heads = heads.select("job", "sheet_no", "line_id", "width", "height")
    h = _scale(heads)
    d = c.join(h.select("job", F.col("sheet_no").alias("no"), "sx", "sy"), ["job", "no"])
    own = {
        "id": F.col("cid"), "x": F.round(F.col("x") * F.col("sx"), 1), "y": F.round(F.col("y") * F.col("sy"), 1), "flags": F.array_sort("flags"), "dim_line_id": F.coalesce(F.col("line").cast("string"), F.lit("")),
        "dim_endpoints": rounded("dim_endpoints", F.array(F.array("x1", "y1"), F.array("x2", "y2"))), "dim_axis": rounded("dim_axis", F.col("axis")), "dim_offset": rounded("dim_offset", F.col("offset")),
    }
    fields = [f.split(":")[0] for f in HIT.removeprefix("struct<").removesuffix(">").replace("array<array<double>>", "a").split(",")]
    hit = F.struct(*(own.get(n, rounded(n, F.col(n)) if n in DIGITS else F.col(n)).alias(n) for n in fields)).cast(HIT)
    g = d.groupBy("job", F.col("no").alias("sheet_no")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", hit.alias("h")))), lambda x: x["h"]).alias("candidates"))
    return heads.join(g, ["job", "sheet_no"], "left").select("job", "sheet_no", "line_id", "width", "height", F.lit(1).alias("relations_version"), F.coalesce("candidates", F.array().cast(f"array<{HIT}>")).alias("candidates"))


def with_relations(c: DataFrame, write) -> DataFrame:
    """Candidates with the parent that relations give them (none, if they give none); who has a sure one gets the flag and the hint nested_offset, which are never taken away."""
    r = L.sure_relations(c, write)
    up = c.select("sheet_no", F.col("ord").alias("parent_ord"), F.col("cid").alias("_cid"), F.col("value_mm").alias("_mm"))
    d = c.join(r.join(up, ["sheet_no", "parent_ord"]).drop("parent_ord"), ["sheet_no", "ord"], "left")
    sure = F.coalesce(F.col("score") >= L.SURE, F.lit(False))
    hint = F.when(sure & ~F.contains("local_hint", F.lit("nested_offset")), F.concat("local_hint", F.lit("|nested_offset"))).otherwise(F.col("local_hint"))
    return d.withColumns({
        "parent_id": F.col("_cid"), "parent_value_mm": F.col("_mm"), "relation_kind": F.when(F.col("_cid").isNull(), "").otherwise("nested_in"), "geometry_confidence": F.coalesce("score", F.lit(0.0)), "parent_dist": F.coalesce("dist", F.lit(0.0)),
        "flags": F.when(sure, F.array_union("flags", F.array(F.lit("nested_offset")))).otherwise(F.col("flags")), "local_hint": hint, "f_nested_offset": F.col("f_nested_offset") | sure,
    }).drop("_cid", "_mm", "score", "dist")


def refresh(hits: DataFrame, write, spans: DataFrame | None = None) -> DataFrame:
    """The hits documents whose relations, boxes or directions change, as they are then. What was decided doesn't matter; locked sheets are no exception."""
    old = write(hits)
    new = documents(write(with_relations(write(candidates(old, spans)), write)), old)
    was = old.select("job", "sheet_no", F.col("candidates").alias("_was"), F.col("relations_version").alias("_version"))
    d = new.join(was, ["job", "sheet_no"])
    return d.filter(~(F.col("candidates").eqNullSafe(F.col("_was")) & F.col("_version").eqNullSafe(F.col("relations_version")))).drop("_was", "_version")


def relabel(decisions: DataFrame, hits: DataFrame, write, spans: DataFrame | None = None, ignore_locked: bool = False) -> DataFrame:
    """The decision documents that the rules change, as they are then; others aren't returned.

    Locked documents and sheets without hits are left out (with ``ignore_locked``, locked ones are corrected too and stay locked).
    A document changes if an item differs, nulls alike, or if the rules have something to say, which is added to its notes. Items
    without a candidate stay as they are.
    """
    free = write(decisions if ignore_locked else decisions.filter(~F.coalesce("locked", F.lit(False))))
    key = ["job", "sheet_no"]
    items = free.select(*key, F.posexplode("items").alias("pos", "item")).select(*key, "pos", "item.*").withColumn("cid", F.coalesce("id", F.lit("")))
    c = candidates(hits.join(free.select(*key), key, "left_semi"), spans)
    first = items.dropDuplicates([*key, "cid"]).select(F.col("job"), F.col("sheet_no").alias("no"), "cid", "decision", "role", "reason")
    done = write(Q.correct(write(c.join(first, ["job", "no", "cid"], "left")), write).select("sheet_no", "job", "no", "ord", "cid", "decision", "role", "reason", "log"))
    new = done.filter("decision is not null").select("job", F.col("no").alias("sheet_no"), "cid", F.struct("decision", "role", "reason").alias("new")).withColumn("n", F.row_number().over(Window.partitionBy("job", "sheet_no", "cid").orderBy("new"))).filter("n = 1").drop("n")
    d = items.join(new, [*key, "cid"], "left").withColumn("new", F.coalesce("new", F.struct("decision", "role", "reason")))
    item = F.struct("pos", F.struct("id", "new.decision", "new.role", "new.reason", "value_mm").alias("item"))
    g = d.groupBy(*key).agg(F.bool_or(~F.col("new").eqNullSafe(F.struct("decision", "role", "reason"))).alias("changed"), F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("new_items"))
    said = Q.notes(done).join(done.select("sheet_no", F.col("job"), F.col("no")).distinct(), "sheet_no").select("job", F.col("no").alias("sheet_no"), "note")
    d = free.join(g, key).join(said, key, "left").filter(F.col("changed") | F.col("note").isNotNull())
    notes = F.when(F.col("note").isNull(), F.col("notes")).otherwise(F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array("note")))
    return d.withColumns({"items": F.col("new_items").cast(decisions.schema["items"].dataType), "notes": notes}).select(*decisions.columns)


def confirm(decisions: DataFrame, job: str, sheet_no: int, confirmed: bool = True) -> DataFrame:
    """A sheet's document, locked and marked as read by a person, or with neither mark. A sheet without a document is an error."""
    d = decisions.filter((F.col("job") == job) & (F.col("sheet_no") == sheet_no))
    if d.isEmpty():
        raise ValueError(f"no decisions of sheet {sheet_no} of {job}")
    mark = F.lit(True) if confirmed else F.lit(None).cast("boolean")
    return d.withColumns({"locked": mark, "reviewed_by_human": mark})
