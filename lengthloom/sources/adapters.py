"""Adapters: tables of an order system as drawing data, on the schemas that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..arrays import F, Window
from ..session import spread

#: The lengths (mm) that part numbers stand for, by remainder modulo 16.
VALUES = (12, 20, 34, 81, 159, 244, 300, 650, 840, 916, 1950, 3000, 6000, 10200, 22250, 24100)
DECISIONS = ("exclude_nested", "not_length", "ambiguous")


#: Texts beside parts, by remainder modulo 23 of their number; roles and reasons that decisions come with, by remainders modulo 4 and 7.
BESIDE = ("LT", "Гидр. 1,5 МПа", "ItemCode", "ВРЕЗКА", "HOLE")
ROLES = ("main", "other", "support_offset", None)
REASONS = ("внутри 300", "рядом Координата Z", "Полный размер Н.О.", None, "внутри D2=24100", "z+ узла", "сомнение")


def _pick(values: tuple, k) -> Column:
    """The value of that place, null beyond the last."""
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(lineitem: DataFrame) -> DataFrame:
    """A sheet per order, a dimension candidate per line; ord numbers the candidates of a sheet."""
    w = Window.partitionBy("sheet_no").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    raw = lineitem.select(F.col("l_orderkey").alias("sheet_no"), *("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))  # what is shuffled, by the key of all later steps
    raw = spread(lineitem, raw, "sheet_no")
    dc, tc, qm = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int"), F.col("l_quantity").cast("int") % 8
    even = F.col("l_linenumber") % 2 == 0
    return raw.withColumn("ord", F.row_number().over(w)).select(
        "sheet_no",
        "ord",
        F.element_at(F.array(*map(F.lit, VALUES)), (F.col("l_partkey") % 16 + 1).cast("int")).alias("value_mm"),
        (F.lit(100.0) + (F.col("l_partkey") % 7) * 20).alias("x"),
        (F.lit(100.0) + (F.col("l_suppkey") % 5) * 15).alias("y"),
        F.when(even, 1.0).otherwise(0.0).alias("dir_x"),
        F.when(even, 0.0).otherwise(1.0).alias("dir_y"),
        (dc == 10).alias("f_overall_mark"),
        (tc == 8).alias("f_handwheel"),
        (tc == 7).alias("f_insulation_thickness"),
        (dc == 9).alias("f_near_plant_coord"),
        (dc == 8).alias("f_pipe_opening"),
        (F.col("l_partkey") % 29 == 7).alias("f_stamp"),
        (tc <= 2).alias("has_support"),
        _pick(BESIDE, F.col("l_partkey") % 23).alias("note"),
        _pick(ROLES, F.col("l_suppkey") % 4).alias("role"),
        _pick(REASONS, F.col("l_partkey") % 7).alias("reason"),
        F.when(qm == 0, DECISIONS[0]).when(qm == 1, DECISIONS[1]).when(qm == 2, DECISIONS[2]).otherwise("include").alias("decision"),
    ).withColumn("cid", F.concat(F.lit("D"), F.col("ord").cast("string")))


def with_lines(c: DataFrame) -> DataFrame:
    """Candidates with a dimension line from their place along their direction; every seventh has none, some share one."""
    n = F.least(F.lit(300.0), F.lit(20.0) + F.col("value_mm") / F.lit(50.0))
    line = F.when(F.col("ord") % 7 != 0, F.col("ord") - (F.col("ord") % 4 == 3).cast("int"))
    return c.select("*", line.alias("line"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("dir_x") * n).alias("x2"), (F.col("y") + F.col("dir_y") * n).alias("y2"), (F.lit(6.0) * F.col("ord")).alias("offset"))


#: Texts beside candidates, by remainder modulo 7 of their number.
NOTES = ("z+ 37329", "DN50", "LT", "10 см", "Z 24100", "X 1234567", "Y8999")


def with_note(c: DataFrame) -> DataFrame:
    """Candidates with a further text beside them."""
    note = F.element_at(F.array(*map(F.lit, NOTES)), F.col("ord") % 7 + 1)
    return c.withColumn("nearby", F.when(F.col("nearby") == "", note).otherwise(F.concat("nearby", F.lit(" | "), note)))


def with_notes(c: DataFrame) -> DataFrame:
    """Candidates with a further text beside them, flags as an array, a mark of locked sheets and figures of the nearest line."""
    on = (("overall_mark", "f_overall_mark"), ("overall_pair", "f_overall_pair"), ("handwheel", "f_handwheel"), ("insulation", "f_insulation_thickness"), ("support_repeat", "support_repeat"), ("near_plant_coord", "f_near_plant_coord"), ("nested_offset", "f_nested_offset"))
    return with_note(c).withColumns({
        "flags": F.array_compact(F.array(*(F.when(F.col(k), F.lit(n)) for n, k in on))), "locked": F.col("sheet_no") % 9 == 0, "reviewed_by_human": F.col("sheet_no") % 11 == 0,
        "dist_to_line": F.when(F.col("ord") % 7 != 0, F.lit(6.0) * F.col("ord")), "parallel_score": F.when(F.col("ord") % 7 != 0, F.lit(1.0)),
    })


def saved_and_hits(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved decisions and the candidates that they are about, with faults of every kind."""
    saved = c.filter("ord % 11 <> 0 and sheet_no % 17 <> 0").selectExpr("sheet_no", "ord as id", "case when ord % 13 = 0 or value_mm = 81 then value_mm + 1 else value_mm end as value_mm", "case when ord % 5 = 0 and value_mm > 9000 then 'maybe' else decision end as decision")
    hits = c.filter("sheet_no % 19 <> 0 and (ord <> 2 or sheet_no % 5 <> 0)").selectExpr("sheet_no", "ord as id", "case when value_mm <> 12 then value_mm end as value_mm", "case when ord % 3 = 0 then ord + 1 end as parent_id", "cast(value_mm % 13 as double) / 10 as geometry_confidence", "3000 as parent_value_mm")
    return saved.unionByName(saved.filter("id % 7 = 0")), hits.unionByName(hits.filter("id % 6 = 0"))


def intervals(events: DataFrame) -> DataFrame:
    """Events as intervals on 50 lines, in minutes."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(6e7)
    return events.select((F.col("user_id") % 50).alias("bucket"), F.col("event_id").alias("ord"), t.alias("t0"), (t + F.col("value")).alias("t1"))


def segments(embeddings: DataFrame) -> DataFrame:
    """Vectors as strokes: two points and a width."""
    e = [F.col("embedding")[i].cast("double") for i in range(5)]
    d = embeddings.select(F.col("vec_id").alias("seg"), F.col("label").alias("sheet_no"), *(F.lit(1000.0) * e[i] for i in range(4)), F.lit(5.0) * F.abs(e[4])).toDF("seg", "sheet_no", "x1", "y1", "x2", "y2", "width")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return d.withColumn("length", F.sqrt(dx * dx + dy * dy))


#: Directions of strokes.
DIRECTIONS = ((1.0, 0.0), (0.0, 1.0), (0.7071067811865476, 0.7071067811865476), (0.8660254037844387, 0.5))


def drawings(embeddings: DataFrame) -> DataFrame:
    """Vectors of 64 numbers or more as drawings of a sheet: seven lines and a rectangle from eight numbers each, on a grid of 20 points."""
    e = F.col("embedding").cast("array<double>")

    def item(g: int):
        v = [e[8 * g + k] for k in range(6)]
        x, y, n = F.rint(v[0] * 32) * 20 + 300, F.rint(v[1] * 32) * 20 + 300, F.when(F.abs(v[4]) < 0.05, F.abs(v[4]) * 200 + 4).otherwise(F.abs(v[4]) * 400 + 28)
        way = F.element_at(F.array(*(F.array(*map(F.lit, w)) for w in DIRECTIONS)), (F.floor(F.abs(v[2]) * 64) % 4 + 1).cast("int"))
        n = F.when(v[3] < 0, -n).otherwise(n)
        return F.struct(F.lit("re" if g == 7 else "l").alias("kind"), x.alias("x0"), y.alias("y0"), (x + n * (1.0 if g == 7 else way[0])).alias("x1"), (y + n * (0.5 if g == 7 else way[1])).alias("y1"))

    whole = ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size(e) >= 64)
    return embeddings.filter(F.coalesce(whole, F.lit(False))).select(F.floor(F.col("vec_id") / 25).alias("sheet_no"), (F.col("vec_id") % 25).alias("seqno"), (F.abs(e[6]) * 4 + 0.1).alias("width"), F.array(*map(item, range(8))).alias("items"))


def evaluations(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents as rows with a true class, a predicted one, a confidence and a group."""
    m = F.col("n_chars") % 10
    return documents.join(labels, "doc_id").select(
        "doc_id", F.col("source").alias("grp"), F.col("n_chars").alias("value_mm"),
        F.when(F.col("toxic") == 1, "not_length").when(F.col("quality") == 1, "include").otherwise("exclude_nested").alias("y"),
        F.when(m == 0, "not_length").when(m <= 2, "exclude_nested").otherwise("include").alias("pred"),
        ((F.col("doc_id") % 100) / 100.0).alias("conf"),
    )


def _own_text() -> Column:
    """The text that a part stands for."""
    k = F.col("l_partkey")
    return (
        F.when(k % 9 == 0, F.concat(F.lit("X "), (k + 30000).cast("string"))).when(k % 9 == 1, "DN50").when(k % 9 == 2, F.concat(F.lit("О"), (k % 30).cast("string")))
        .when(k % 9 == 3, F.concat(F.lit("<"), (k % 9).cast("string"), F.lit(">"))).when(k % 9 == 4, (k % 17).cast("string")).when(k % 9 == 5, "ШТУРВАЛ UP")
        .when(k % 9 == 6, "z+37329").when(k % 9 == 7, "ф7а").otherwise((k + 50).cast("string"))
    )


def spans(lineitem: DataFrame) -> DataFrame:
    """Lines as text runs of a drawing."""
    return lineitem.filter("l_partkey is not null").select(F.col("l_orderkey").alias("sheet_no"), "l_partkey", _own_text().alias("text"))


#: Texts after parts' own, by remainder modulo 13 of their number; others have none.
AFTER = ("ДЛИНЫ\u00a0ОТРЕЗКОВ", "Гидр. 1,5", "ItemCode", "Лист 2 из 7", "AB12_0345", "Страница 4 исходного", "ШТУРВАЛ", " \t", "СМ. узел", "ВРЕЗКА")


def text_pages(lineitem: DataFrame) -> DataFrame:
    """A page per order with nested text: a block with a line of one or two runs for each of its lines, and a block that is no text."""
    k = F.col("l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    x, y = F.lit(20.0) + (k % 7) * 24, F.lit(10.0) + (F.col("l_suppkey") % 7) * 24
    run = lambda t, dx, dy: F.struct(t.alias("text"), F.array(x + dx - 8, y + dy - 4, x + dx + 8, y + dy + 4).alias("bbox"), F.lit(9.0).alias("size"))
    runs = F.array_compact(F.array(run(_own_text(), 0, 0), F.when(k % 13 < len(AFTER), run(_pick(AFTER, k % 13), 12, 6))))
    line = F.struct(F.when(k % 2 == 0, F.array(F.lit(0.0), F.lit(1.0))).alias("dir"), runs.alias("spans"))
    raw = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").withColumn("i", F.row_number().over(w))  # texts are made after the shuffle
    g = raw.select("l_orderkey", "i", line.alias("l")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("i", "l"))).alias("ls"))
    text = F.struct(F.lit(0).alias("type"), F.transform("ls", lambda v: v["l"]).alias("lines"))
    image = F.struct(F.lit(1).alias("type"), F.slice(text["lines"], 1, 1).alias("lines"))
    return g.select(F.col("l_orderkey").alias("sheet_no"), F.lit(240.0).alias("width"), F.lit(170.0).alias("height"), F.array(image, text).alias("blocks"))


def manifests(orders: DataFrame) -> DataFrame:
    """Jobs of a thousand orders as manifests: pages in all, and lists of those that tests keep."""
    k = F.col("o_orderkey")
    d = orders.select(F.floor(k / 1000).cast("string").alias("job"), (k % 1000 + 1).cast("int").alias("page"), (k % 10 == 7).alias("held"), (k % 3 + 1).cast("string").alias("test"))
    tests = d.groupBy("job", "test").agg(F.sort_array(F.collect_list(F.when(F.col("held"), F.col("page")))).alias("pages"))
    return tests.groupBy("job").agg(F.lit(1000).alias("total"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("test_"), "test"), "pages"))).alias("holdout_test_pages"))


def number_runs(lineitem: DataFrame) -> DataFrame:
    """The numbers of candidates as text runs near them; every fifth line has none, and some sheets repeat a number."""
    k = F.col("l_partkey")
    value = F.element_at(F.array(*map(F.lit, VALUES)), (k % 16 + 1).cast("int"))
    x, y = F.lit(90.0) + (k % 7) * 20 + (k % 3) * 10, F.lit(100.0) + (F.col("l_suppkey") % 5) * 15 + (F.col("l_suppkey") % 4) * 5
    n = F.length(value.cast("string")) * 2.75
    return lineitem.filter("l_linenumber % 5 <> 0").select(
        F.col("l_orderkey").alias("sheet_no"), F.concat(F.lit(" "), value.cast("string")).alias("text"), x.alias("x"), y.alias("y"),
        F.array(x - n, y - 5, x + n, y + 5).alias("bbox"), F.array((k % 2).cast("double"), (1 - k % 2).cast("double")).alias("direction"),
    )


#: Texts that parts stand for, by remainder modulo 11; others are no markers.
MARKERS = ("Н.О.", "ШТУРВАЛ", "ИЗОЛЯЦИЯ", "ВРЕЗКА", "ЗАГЛУШКА, ВРЕЗКА")


def markers(lineitem: DataFrame) -> DataFrame:
    """Lines as marker texts with a place."""
    k = F.col("l_partkey") % 11
    return lineitem.filter(k < len(MARKERS)).select(
        F.col("l_orderkey").alias("sheet_no"), F.col("l_partkey").alias("mark"), F.element_at(F.array(*map(F.lit, MARKERS)), (k + 1).cast("int")).alias("text"),
        (F.lit(100.0) + (F.col("l_suppkey") % 7) * 20).alias("x"), (F.lit(100.0) + (F.col("l_partkey") % 5) * 15).alias("y"),
    )


def line_id() -> Column:
    """A sheet's line, with signs that pages have to escape on every fifth."""
    no = F.col("sheet_no").cast("string")
    return F.when(F.col("sheet_no") % 5 == 0, F.concat(F.lit('<LC & "'), no, F.lit("'\">"))).otherwise(F.concat(F.lit("LC_"), no))


def job_heads(orders: DataFrame) -> DataFrame:
    """job, pdf, updated of jobs of 64 orders each, in time of the last; every tenth job has none."""
    job = F.floor(F.col("o_orderkey") / 64)
    d = orders.withColumn("job", job).filter("job % 10 <> 3").groupBy("job").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm").alias("updated"))
    return d.select("job", F.concat(F.lit("чертёж <"), F.col("job").cast("string"), F.lit(">.pdf")).alias("pdf"), "updated")
