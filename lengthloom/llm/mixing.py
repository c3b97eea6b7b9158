"""Mixing sources to target weights: certain whole copies, then Pareto order sampling for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Sources up to this number are broadcast; beyond it the same table is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target: shares of all sizes by weight, none above ``most`` times the source's size.

    Weights repeat over the sources in code-point order, null last. The excess of a stopped source goes to the others by
    weight, again until none is above: in order of most * size / weight, the first source whose share stays below its stop
    fixes the level. The table has a row a source, so its windows run over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("_stop", F.col("source").asc_nulls_last())
    before, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    t = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumns({"_cap": F.col("source_size") * F.lit(float(most)), "_stop": F.col("source_size") * F.lit(float(most)) / F.col("_w")})
    t = t.withColumns({"_c": F.coalesce(F.sum("_cap").over(before), zero), "_wb": F.coalesce(F.sum("_w").over(before), zero), "_all": F.sum("source_size").over(everything), "_ws": F.sum("_w").over(everything)})
    t = t.withColumn("_level", (F.col("_all") - F.col("_c")) / (F.col("_ws") - F.col("_wb")))
    t = t.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", "source", "_level"))).over(everything)["_level"])
    return t.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level"), zero) * F.col("_w")).alias("target"))


def _ending(cells: DataFrame, bucket: str, ends: DataFrame) -> DataFrame:
    """The bucket of each source in which its remaining words end, with the words before it; counting starts at _from."""
    upto = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    d = cells.withColumn("_sum", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(ends, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_before", F.col("_from") + F.col("_sum"))
    return d.filter((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("n"))).select("source", bucket, "_rest", "_before")


def inclusion(sizes: DataFrame) -> DataFrame:
    """(source, class, n, weight, rest) -> with odds and sure: inclusion probabilities in proportion to weight, n words a class.

    The probabilities of a source are the least of 1 and level * weight, with the level at which the words to expect are rest:
    classes of the highest weights become sure first, the first class that stays below 1 fixes the level.
    """
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "class")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("_sure", F.coalesce(F.sum("n").over(before), F.lit(0)))
    t = t.withColumn("_mass", F.sum(F.col("n") * F.col("weight")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("_level", F.when(F.col("_mass") > 0, (F.col("rest") - F.col("_sure")) / F.col("_mass")))
    level = F.min(F.when(F.col("_level") * F.col("weight") < 1, F.struct(-F.col("weight"), "class", "_level"))).over(Window.partitionBy("source"))["_level"]
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.coalesce(level, F.lit(1e18)) * F.col("weight")))
    return t.withColumn("_p", p).select("source", "class", F.when(F.col("_p") < 1, F.col("_p") / (1 - F.col("_p"))).alias("odds"))


def pareto_mix(df: DataFrame, source: Column, size: Column, identity: Column, weight: Column | None = None, seed: int = 1, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, buckets: int = 16_384) -> DataFrame:
    """Add size, source_size, target, copies (whole), part (words of one more copy) and taken = copies * size + part.

    A source with target t and size s gives every document floor(t / s) certain copies. The remaining words are a fixed-size
    sample by Pareto order: documents rank by q = (u / (1 - u)) / (p / (1 - p)), u a hash of ``identity`` and the seed and p the
    document's inclusion probability, and are taken in that order until the words are reached; the last one gives a part. p
    is in proportion to ``weight`` (default: equal) within a source, at most 1 (then the document comes before all others), and
    such that the words to expect are those wanted. Weights count in steps of a quarter of a doubling between 2^-16 and
    2^16; a null weight or one that isn't positive counts as the least. So words by source and step give all probabilities,
    and words by source and rank bucket the bucket in which a source's words end; only that one is ranked row by row
    (about a document in ``buckets`` of a source), so a hot source is never sorted in one task.

    Null source: a source of its own, last. Null or zero size: nothing is taken. Repeated rows tie and may trade places.
    Reruns agree: nothing is random but the hash. Other columns pass through; one that is named like a result is replaced, and
    names that begin with an underscore are reserved. df is read twice. An empty table gives no rows.
    """
    u = C.uniform(F.xxhash64(identity, F.lit(seed)))
    step = F.lit(0) if weight is None else F.coalesce(F.when(weight > 0, F.greatest(F.lit(-64), F.least(F.lit(64), F.round(F.log2(weight) * 4)))), F.lit(-64))
    d = df.withColumns({"_source": source, "size": F.coalesce(size, F.lit(0)).cast("long"), "_u": u, "_w": step.cast("int")}).drop("source_size", "target", "copies", "part", "taken")
    narrow = C.keep(d.select(F.col("_source").alias("source"), F.col("_w").alias("class"), "_u", "size"))
    steps = C.keep(narrow.groupBy("source", "class").agg(F.sum("size").alias("n")))
    t = source_targets(steps.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    t = C.keep(t.withColumn("_whole", whole).withColumn("_rest", F.greatest(F.lit(0), F.least(F.col("source_size"), F.round("target").cast("long") - F.col("_whole") * F.col("source_size")))))
    n = t.count()
    near = F.broadcast if n <= BROADCAST_SOURCES else (lambda x: x)
    rest = t.select(F.col("source").alias("_s"), F.col("_rest").alias("rest"))
    odds = C.keep(inclusion(steps.join(near(rest), F.col("source").eqNullSafe(F.col("_s"))).withColumn("weight", F.pow(F.lit(2.0), F.col("class") / 4))))  # at most 129 rows a source

    def ranked(x: DataFrame, source: str, step: str) -> DataFrame:
        """x with its rank q in Pareto order and the bucket of that."""
        x = x.join(near(odds.select(F.col("source").alias("_os"), F.col("class").alias("_ow"), F.col("odds").alias("_odds"))), F.col(source).eqNullSafe(F.col("_os")) & (F.col(step) == F.col("_ow")))
        x = x.withColumn("_q", F.when(F.col("_odds").isNull(), F.col("_u") * 1e-15).otherwise(F.col("_u") / (1 - F.col("_u")) / F.col("_odds"))).drop("_u", "_os", "_ow", "_odds")
        return x.withColumn("_b", F.least(F.lit(buckets - 1), F.floor(F.col("_q") / (F.col("_q") + 1) * buckets)).cast("int"))

    cells = C.keep(ranked(narrow, "source", "class").groupBy("source", "_b").agg(F.sum("size").alias("n")))
    d = ranked(d, "_source", "_w").drop("_w")
    wide = 1 << (buckets.bit_length() // 2)  # first the coarse bucket in which a source's words end, then the fine one
    ends = t.select(F.col("source").alias("_s"), F.col("_rest"), F.lit(0).cast("long").alias("_from"))
    coarse = cells.groupBy("source", F.floor(F.col("_b") / wide).alias("_c")).agg(F.sum("n").alias("n"))
    at = _ending(coarse, "_c", near(ends))
    last = _ending(cells.withColumn("_c", F.floor(F.col("_b") / wide)).join(near(at.select(F.col("source").alias("_as"), F.col("_c").alias("_ac"))), F.col("source").eqNullSafe(F.col("_as")) & (F.col("_c") == F.col("_ac"))).select("source", "_b", "n"), "_b", near(at.select(F.col("source").alias("_s"), "_rest", F.col("_before").alias("_from"))))
    last = last.select(F.col("source").alias("_s"), F.col("_b").alias("_last"), "_before")
    plan = C.keep(t.join(near(last), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_plan").withColumn("_last", F.coalesce("_last", F.lit(-1))))
    d = d.join(near(plan), F.col("_source").eqNullSafe(F.col("_plan"))).drop("_plan")
    in_order = Window.partitionBy("_source").orderBy("_q", "size").rowsBetween(Window.unboundedPreceding, -1)
    clear = d.filter("_b <> _last").withColumn("part", F.when(F.col("_b") < F.col("_last"), F.col("size")).otherwise(0))
    edge = d.filter("_b = _last").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(in_order), F.lit(0)))))
    out = clear.unionByName(edge)
    full = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    out = out.withColumns({"copies": F.col("_whole") + full.cast("long"), "part": F.when(full, 0).otherwise(F.col("part")).cast("long")})
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part")).drop("_source", "_q", "_b", "_last", "_before", "_rest", "_whole")


def usefulness(size: Column) -> Column:
    """Relative inclusion weight of a document of so many words: those of 100 or more count double, scraps under 20 half."""
    return F.when(size >= 100, 2.0).when(size >= 20, 1.0).otherwise(0.5)


def query(spark, sf_dir: str) -> DataFrame:
    d, n = C.table(spark, sf_dir, "documents"), C.n_words(F.col("text"))
    out = pareto_mix(d.withColumn("_n", n), F.col("source"), F.col("_n"), F.struct("doc_id", "text"), usefulness(F.col("_n")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "part", "taken")
