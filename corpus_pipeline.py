"""The corpus pipeline: language identification, near-copies, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lengthloom.llm import common as C
from lengthloom.llm import jaccard, language, mixing, packing, privacy
from lengthloom.session import ship

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None

#: The columns that stages read; others only pass through.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(f):
    """f, while which columns that it doesn't read have names of no meaning, so that none is taken for a result of an operator.

    An empty table gives an empty result with the same columns.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        plain = docs.toDF(*(c if c in COLUMNS else f"other_column_{i}" for i, c in enumerate(docs.columns)))
        out = f(plain)
        return out.toDF(*docs.columns) if out.columns == plain.columns else out

    return run


@_stage
def known_language(docs: DataFrame) -> DataFrame:
    """Documents in a language that the labels teach; texts without letters or unlike every language go."""
    model = language.train(docs, "text", "lang", F.lit(True))
    return language.identify(docs, "text", model, docs.columns).filter("accepted").select(*docs.columns)


@_stage
def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every group of near-copies. Rows without an id stay."""
    groups = jaccard.jaccard_join(docs, "doc_id", F.col("text"))
    gone = C.keep(groups.filter("doc_id <> class_id").select("doc_id").distinct())
    twice = C.keep(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti")
    return left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


@_stage
def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return privacy.pseudonymise(docs, privacy.session_key(docs.sparkSession)).select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


@_stage
def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them; the part of a copy that ends a source's share counts from a half on."""
    n = F.col("_words")
    d = mixing.pareto_mix(docs.withColumn("_words", C.n_words(F.col("text"))), F.col("source"), n, F.struct("doc_id", "text"), mixing.usefulness(n))
    times = (F.col("copies") + (2 * F.col("part") >= F.col("size")).cast("long") * (F.col("part") > 0).cast("long")).cast("int")
    return d.withColumn("_n", times).filter("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


@_stage
def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    d = packing.tokenize(docs, "text", packing.default_tokenizer(), ["doc_id"])
    d = C.keep(d.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens"))
    return packing.pack(d, ["doc_id", "start", "ids_crc32"])


STAGES = [
    ("language identification", known_language),
    ("n-gram jaccard join", one_of_each_group),
    ("personal data", without_personal_data),
    ("mixing to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents.

    Tables that a stage leaves in the shared folder go once its result is written, and that result once the next one is. What
    the last stage reads stays, as its result reads it; other runs and stages are not touched.
    """
    docs, before = C.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        path = f"{C.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with C.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        C.delete(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
