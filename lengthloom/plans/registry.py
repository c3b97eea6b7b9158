"""All queries of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import pairs as P
from ..operators import rules as R
from ..operators.reports import PRICES
from ..sources import adapters as A
from . import audits, runs, saved, strokes, told
from .oracle import ORACLE

KINDS = ("include", "exclude_nested", "not_length", "ambiguous")


def _c(spark, sf) -> DataFrame:
    return A.candidates(A.table(spark, sf, "lineitem"))


def _n(spark, sf) -> DataFrame:
    return P.with_neighbours(_c(spark, sf))


def _o(spark, sf) -> DataFrame:
    """Candidates with neighbours and overlaps, as the operators on pairs that ask no lines read them."""
    return runs.candidates(spark, sf, lined=False)


def _sheets(spark, sf) -> DataFrame:
    return R.sheets(R.row_rules(R.facts(_c(spark, sf))))


def guard_chain(spark, sf) -> DataFrame:
    """The short chain of rules in order, on decisions alone and relations by neighbours, then a row a sheet; guard_full has them all."""
    d = P.with_edge(_o(spark, sf)).withColumns({"has_parent": F.col("edge").isNotNull(), "has_twin": P.exists(lambda b: P.twin(P.OWN, b))})
    d = R.nested_offsets(R.row_rules(R.facts(d.drop("_sheet", "nums", *P.SEEN, *P.PLACES))))
    return R.sheets(R.take_ambiguous(R.restore_twins(R.restore_lengths(d))))


def job_totals(spark, sf) -> DataFrame:
    """Totals by status with a grand-total row; metres with a decimal comma."""
    g = _sheets(spark, sf).rollup("status").agg(F.sum("length_mm").alias("length_mm"), F.count("*").alias("n_sheets"))
    return g.select(F.coalesce("status", F.lit("ИТОГО")).alias("status"), "length_mm", "n_sheets", F.replace(F.format_string("%.3f", F.col("length_mm") / 1000), F.lit("."), F.lit(",")).alias("length_m"))


def status_buckets(spark, sf) -> DataFrame:
    return _c(spark, sf).groupBy("decision").agg(F.count("*").alias("n"), F.sum("value_mm").cast("long").alias("total_mm"), F.countDistinct("sheet_no").alias("n_sheets"))


def repeat_values(spark, sf) -> DataFrame:
    d = _c(spark, sf).filter((F.col("value_mm") <= 25) | F.col("value_mm").between(50, 200)).groupBy("sheet_no", "value_mm").agg(F.count("*").alias("n")).filter("n >= 3")
    return d.withColumn("flag", F.when(F.col("value_mm") <= 25, "not_length").otherwise("support_repeat"))


def run_parent(spark, sf) -> DataFrame:
    """Candidates that aren't nested themselves and have a sure part, or name a smaller nested offset or are named by one."""
    return P.run_parents(P.with_edge(_o(spark, sf)))


def sequential_neighbor(spark, sf) -> DataFrame:
    return P.sequential(P.with_edge(P.with_continues(P.pair_table(_o(spark, sf)))))


def _noted(c: DataFrame) -> DataFrame:
    return A.with_notes(R.facts(c))


def features(spark, sf) -> DataFrame:
    """The 28 model features of a candidate from its value, its neighbours, its flags and its parent."""
    d = P.with_parent(_o(spark, sf)).drop("_sheet", *P.SEEN)
    return X.shown(_noted(d))


def sample_weights(spark, sf) -> DataFrame:
    return _noted(_o(spark, sf)).select("sheet_no", "ord", F.round(X.weight(), 6).alias("weight"))


def segment_kind(spark, sf) -> DataFrame:
    n, w = F.col("length"), F.col("width")
    kind = F.when(n.between(28, 900) & w.between(0.18, 1.2), "body").when(n.between(3.5, 16) & (w <= 1.2), "tick").otherwise("drop")
    return A.segments(A.table(spark, sf, "embeddings")).select("seg", "sheet_no", kind.alias("kind"))


def span_classes(spark, sf) -> DataFrame:
    """Text runs by the first pattern that fits."""
    t = F.col("text")
    reason = (
        F.when(t.rlike("(?iU)^(X|Y|Z[+]?) *[0-9]+$"), "coordinate_xyz").when(t.rlike("(?iU)^DN[0-9]"), "nominal_diameter").when(t.rlike("(?iU)^[ОOФFПP][0-9]+[АAБB]?$"), "support_tag")
        .when(t.rlike("^<[0-9]+>$"), "item_balloon").when(~t.rlike("^[0-9]+$"), "text").when(t.try_cast("long") <= 16, "bom_or_weld_index").otherwise("candidate")
    )
    return A.spans(A.table(spark, sf, "lineitem")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def plant_coord_flag(spark, sf) -> DataFrame:
    """Candidates beside a coordinate of the plant."""
    return A.with_note(_n(spark, sf)).filter(X.near_plant_coord()).select("sheet_no", "ord")


def page_meta(spark, sf) -> DataFrame:
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    return A.table(spark, sf, "pages").select("page_id", F.coalesce(title, F.concat(F.lit("UNKNOWN_"), F.col("page_id").cast("string"))).alias("line_id"), F.length("html").cast("long").alias("n_chars"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


def json_props(spark, sf) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return A.table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total_k"), F.count("*").alias("n"))


def _rows(spark, sf) -> DataFrame:
    return A.evaluations(A.table(spark, sf, "documents"), A.table(spark, sf, "labels"))


def _orders(spark, sf) -> DataFrame:
    return A.table(spark, sf, "orders")


def _lines(spark, sf) -> DataFrame:
    return A.table(spark, sf, "lineitem")


def train_sheets(spark, sf) -> DataFrame:
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("sheet_no"))
    return o.join(o.filter("sheet_no % 10 = 7"), "sheet_no", "left_anti")


def holdout_leak(spark, sf) -> DataFrame:
    held = _orders(spark, sf).filter("o_orderkey % 10 = 7").select(F.col("o_orderkey").alias("sheet_no"))
    return _lines(spark, sf).select(F.col("l_orderkey").alias("sheet_no")).join(held, "sheet_no", "left_semi").distinct()


def dup_ids(spark, sf) -> DataFrame:
    return _lines(spark, sf).groupBy(F.col("l_orderkey").alias("sheet_no"), F.col("l_linenumber").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def missing_extra(spark, sf) -> DataFrame:
    """Wanted sheets that nothing has, and sheets that nobody wanted."""
    o, n = _orders(spark, sf), _lines(spark, sf).select(F.col("l_orderkey").alias("sheet_no")).distinct()
    missing = o.select(F.col("o_orderkey").alias("sheet_no")).join(n, "sheet_no", "left_anti").withColumn("problem", F.lit("missing"))
    extra = n.join(o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("sheet_no")), "sheet_no", "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def decision_cycle(spark, sf) -> DataFrame:
    kinds = F.array(*map(F.lit, KINDS))
    return _c(spark, sf).groupBy("decision").agg(F.count("*").alias("n")).select("decision", F.element_at(kinds, (F.array_position(kinds, F.col("decision")) % 4 + 1).cast("int")).alias("following"), "n")


def upsert_sheet(spark, sf) -> DataFrame:
    """New rows of a sheet take the place of its old ones."""
    c = _c(spark, sf)
    old = c.groupBy("sheet_no").agg(F.sum("value_mm").cast("long").alias("length_mm")).withColumn("origin", F.lit("kept"))
    new = c.filter("sheet_no % 3 = 0").groupBy("sheet_no").agg(F.sum(F.when(F.col("decision") == "include", F.col("value_mm"))).cast("long").alias("length_mm")).withColumn("origin", F.lit("new"))
    return new.unionByName(old.join(new, "sheet_no", "left_anti"))


def unmatched_decisions(spark, sf) -> DataFrame:
    """Candidates without a decision are ambiguous."""
    c = _c(spark, sf).select("sheet_no", "ord", "decision")
    return c.drop("decision").join(c.filter("ord % 5 <> 0"), ["sheet_no", "ord"], "left").withColumn("decision", F.coalesce("decision", F.lit("ambiguous")))


def price_lookup(spark, sf) -> DataFrame:
    model = F.when(F.col("role") == "user", "gpt-4o-mini").when(F.col("role") == "assistant", "gemini-2.5-pro-exp").otherwise("other")
    u = A.table(spark, sf, "conversations").groupBy("role").agg(F.sum(F.length("text")).alias("n")).withColumn("model", model)
    prices = spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "rank int, name string, inp double, outp double")
    w = Window.partitionBy("role").orderBy("rank")
    m = u.join(F.broadcast(prices), F.contains("model", "name"), "left").withColumn("r", F.row_number().over(w)).filter("r = 1")
    usd = F.col("n") * F.coalesce("inp", F.lit(0.3)) / 1e6 + F.col("n") * F.coalesce("outp", F.lit(2.5)) / 1e6
    return m.select("role", "model", F.col("n").alias("tokens"), F.round(usd, 9).alias("usd"))


def audit_problems(spark, sf) -> DataFrame:
    """Faults between saved decisions and candidates, ten kinds, and sheets that one side lacks."""
    return audit.problems(*A.saved_and_hits(_c(spark, sf)))


def audit_counts(spark, sf) -> DataFrame:
    """Sheets, candidates, locked sheets and saved classes by job, and of all jobs."""
    c = _c(spark, sf).withColumn("job", F.col("sheet_no") % 4)
    locked = c.filter("sheet_no % 9 = 0").select("job", "sheet_no").distinct()
    return audit.counts(c.filter("ord % 11 <> 0 and sheet_no % 17 <> 0"), c.filter("sheet_no % 19 <> 0"), locked)


def group_split(spark, sf) -> DataFrame:
    """Sheets in train and validation, 0.18 of the hash space; a sheet is never in both."""
    g = _c(spark, sf).groupBy("sheet_no").agg(F.count("*").alias("n"))
    return g.withColumn("part", F.when(F.substring(F.md5(F.col("sheet_no").cast("string").cast("binary")), 1, 2) < "2e", "validation").otherwise("train")).groupBy("part").agg(F.count("*").alias("n_sheets"), F.sum("n").alias("n_rows"))


def queries() -> dict:
    return {
        "other_runs": lambda s, d: P.other_runs(_n(s, d)),
        "audit_problems": audit_problems,
        "audit_counts": audit_counts,
        "group_split": group_split,
        "sheet_length": _sheets,
        "guard_chain": guard_chain,
        "job_totals": job_totals,
        "status_buckets": status_buckets,
        "repeat_values": repeat_values,
        "neighbor_text": lambda s, d: P.neighbour_text(_c(s, d)),
        "overall_argmax": lambda s, d: P.overall_argmax(_c(s, d)),
        "overlap_pairs": lambda s, d: P.overlap_flags(_n(s, d)),
        "best_parent_text": lambda s, d: P.best_parents(_o(s, d)),
        "nest_drop_middle": lambda s, d: P.nesting(_o(s, d)),
        "sequential_neighbor": sequential_neighbor,
        "envelope_pairs": lambda s, d: P.envelopes(_n(s, d)),
        "twin_run": lambda s, d: P.twins(_n(s, d)),
        "run_parent": run_parent,
        "features": features,
        "sample_weights": sample_weights,
        "segment_kind": segment_kind,
        "line_clusters": lambda s, d: E.islands(A.intervals(A.table(s, d, "events"))),
        "span_classes": span_classes,
        "plant_coord_flag": plant_coord_flag,
        "page_meta": page_meta,
        "json_props": json_props,
        "confusion": lambda s, d: E.confusion(_rows(s, d)),
        "class_metrics": lambda s, d: E.class_metrics(_rows(s, d)),
        "sheet_error_stats": lambda s, d: E.sheet_errors(_rows(s, d)),
        "threshold_sweep": lambda s, d: E.threshold_sweep(_rows(s, d)),
        "train_sheets": train_sheets,
        "holdout_leak": holdout_leak,
        "dup_ids": dup_ids,
        "missing_extra": missing_extra,
        "decision_cycle": decision_cycle,
        "upsert_sheet": upsert_sheet,
        "unmatched_decisions": unmatched_decisions,
        "price_lookup": price_lookup,
        **runs.QUERIES,
        **strokes.QUERIES,
        **audits.QUERIES,
        **saved.QUERIES,
        **told.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return ORACLE | runs.ORACLE | strokes.ORACLE | audits.ORACLE | saved.ORACLE | told.ORACLE
