"""Files of decisions, jobs and reports: JSON documents in, CSV and JSON lines out. Any path that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<id:string,decision:string,role:string,reason:string,value_mm:int>"
DECISIONS = f"line_id string, items array<{ITEM}>, notes array<string>, locked boolean, reviewed_by_human boolean"
JOB = "id string, pdf string, total_mm long, sheets array<struct<sheet_no:long,length_mm:long,status:string>>, _corrupt_record string"
#: The heading of the report of lengths.
HEADING = ("номер_листа", "обозначение_линии", "длина_мм", "длина_м", "формула", "статус", "замечания")


def embedded_json(text: Column) -> Column:
    """The JSON object in an answer: inside a code fence if there is one, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def decisions(docs: DataFrame) -> DataFrame:
    """A row an item of decision documents, in order; keys of the document stay in front."""
    keys = [c for c in docs.columns if c != "items"]
    return docs.select(*keys, F.posexplode("items").alias("pos", "item")).select(*keys, "pos", "item.*")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision documents, a file a sheet: job is the folder above the documents' own, sheet_no the number in the file's name."""
    file = F.col("_metadata.file_path")
    docs = spark.read.schema(DECISIONS).json(path, multiLine=True).withColumns({"job": F.element_at(F.split(file, "/"), -3), "sheet_no": F.regexp_extract(file, r"sheet_(\d+)[^/]*$", 1).try_cast("long")})
    return decisions(docs)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs from their records, newest file first; broken records are left out, missing totals and names filled."""
    d = spark.read.schema(JOB).json(path, multiLine=True, mode="PERMISSIVE").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("updated")).filter("_corrupt_record is null")
    has = lambda status: F.size(F.filter(F.coalesce("sheets", F.array()), lambda s: s["status"] == status))
    return d.select(
        F.coalesce("id", F.element_at(F.split("_file", "/"), -2)).alias("id"), F.coalesce("pdf", F.lit("")).alias("pdf"), "updated", F.size(F.coalesce("sheets", F.array())).alias("pages"),
        F.coalesce("total_mm", F.aggregate(F.coalesce(F.col("sheets.length_mm"), F.array()), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))).alias("total_mm"), has("ok").alias("ok"), has("review").alias("review"),
    ).orderBy(F.desc("updated"), "id")


def write_lengths(sheets: DataFrame, path: str) -> None:
    """The report of lengths as CSV: semicolons, metres with a decimal comma, sheets in order and a total row at the end.

    Every part file opens with the heading behind a byte order mark, so that spreadsheets take it for UTF-8.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in sheets.columns else F.lit("")
    metres = F.replace(F.format_string("%.3f", F.col("length_mm") / 1000), F.lit("."), F.lit(","))
    rows = sheets.select(F.lit(0).alias("_last"), F.col("sheet_no").alias("_no"), F.col("sheet_no").cast("string").alias("a"), text("line_id").alias("b"), "length_mm", metres.alias("m"), text("formula").alias("f"), text("status").alias("s"), text("remarks").alias("r"))
    total = sheets.agg(F.coalesce(F.sum("length_mm"), F.lit(0)).cast("long").alias("length_mm")).select(F.lit(1).alias("_last"), F.lit(None).cast("long").alias("_no"), F.lit("").alias("a"), F.lit("итого").alias("b"), "length_mm", metres.alias("m"), *(F.lit("").alias(c) for c in "fsr"))
    d = rows.unionByName(total).orderBy("_last", "_no").drop("_last", "_no").toDF("\ufeff" + HEADING[0], *HEADING[1:])
    d.write.csv(path, sep=";", header=True, emptyValue="", encoding="UTF-8")


def write_examples(rows: DataFrame, path: str) -> None:
    """Training rows as JSON lines and as CSV with semicolons, in two folders below path."""
    rows.write.json(f"{path}/jsonl", ignoreNullFields=False)
    flat = rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else c for c, t in rows.dtypes))
    flat.write.csv(f"{path}/csv", sep=";", header=True)


def upsert(index: DataFrame, job: DataFrame) -> DataFrame:
    """The index with job's rows in place of those with their ids; latest marks the new ones."""
    return job.withColumn("latest", F.lit(True)).unionByName(index.drop("latest").join(job.select("id"), "id", "left_anti").withColumn("latest", F.lit(False)), allowMissingColumns=True)


MANIFEST = "job string, total int, holdout_test_pages map<string,array<int>>, test_sets map<string,array<int>>"


def read_manifests(spark: SparkSession, path: str, total: int = 307) -> DataFrame:
    """job, total, holdout_test_pages of manifests, one a file; the older name of the lists is read too, a missing total is ``total``."""
    d = spark.read.schema(MANIFEST).json(path, multiLine=True)
    none = F.create_map().cast("map<string,array<int>>")
    return d.select("job", F.coalesce("total", F.lit(total)).alias("total"), F.coalesce("holdout_test_pages", "test_sets", none).alias("holdout_test_pages"))


def training_pages(manifests: DataFrame) -> DataFrame:
    """job, page: the pages from 1 to total that no list of the manifest keeps for tests, whatever it says itself."""
    held = F.flatten(F.map_values("holdout_test_pages"))
    pages = F.array_except(F.sequence(F.lit(1), F.greatest("total", F.lit(1))), F.coalesce(held, F.array().cast("array<int>")))
    return manifests.select("job", "total", F.explode(pages).alias("page")).filter("page <= total").select("job", "page")


def holdout_leaks(used: DataFrame, manifests: DataFrame) -> DataFrame:
    """job, test, page: pages that were used although a test keeps them."""
    held = manifests.select("job", F.explode("holdout_test_pages").alias("test", "pages")).select("job", "test", F.explode("pages").alias("page"))
    return held.join(used.select("job", "page").distinct(), ["job", "page"]).select("job", "test", "page")
