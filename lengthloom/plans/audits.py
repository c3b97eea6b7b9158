"""Queries on markers, drawing areas, model results, edits and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import marks as M
from ..operators import rules as R
from ..operators import sheets as T
from ..operators import splits as S
from ..sources import adapters as A
from ..sources import files
from ..sources import hits as H
from .oracle import A1, A5, RULES, sheets


def _c(spark, sf) -> DataFrame:
    return A.candidates(A.table(spark, sf, "lineitem"))


def _spans(spark, sf) -> DataFrame:
    return T.spans(A.text_pages(A.table(spark, sf, "lineitem")))


def text_spans(spark, sf) -> DataFrame:
    """Runs of the pages' nested text, with their place and direction."""
    return _spans(spark, sf).select("sheet_no", "span.line", "span.number", "text", "x", "y", "size", F.col("direction")[0].alias("dir_x"))


def frame_reason(spark, sf) -> DataFrame:
    """Why a run is no dimension: by its text, its place, the words beside it or its value; candidates too, other text has no row."""
    return T.reasons(T.with_nearby(_spans(spark, sf))).filter("reason is not null").select("sheet_no", "span.line", "span.number", "reason")


def page_candidates(spark, sf) -> DataFrame:
    """The candidates that a page's text leaves, with what stands beside them and the hint that it gives."""
    return T.candidates(T.reasons(T.with_nearby(_spans(spark, sf)))).select("sheet_no", "ord", "value_mm", "x", "y", "nearby", "hint")


def sheet_meta(spark, sf) -> DataFrame:
    """A page's line, number, count and source as its last texts name them."""
    return T.meta(_spans(spark, sf))


def marker_flags(spark, sf) -> DataFrame:
    """Flags that marker texts give to the candidates around them."""
    return M.marker_flags(_c(spark, sf), A.markers(A.table(spark, sf, "lineitem")))


def opening_flags(spark, sf) -> DataFrame:
    """Candidates with the label of an opening within 140 points."""
    return M.opening_flags(_c(spark, sf), A.markers(A.table(spark, sf, "lineitem")))


def doc_tokens(spark, sf) -> DataFrame:
    """Tokens of the documents by class."""
    t = A.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))).alias("t"))
    return t.groupBy(F.when(F.col("t").rlike("^[0-9]+$"), "number").when(F.col("t").rlike("^<[0-9]+>$"), "item_balloon").otherwise("text").alias("kind")).agg(F.count("*").alias("n"))


def _rows(spark, sf) -> DataFrame:
    return A.evaluations(A.table(spark, sf, "documents"), A.table(spark, sf, "labels"))


def overall_metrics(spark, sf) -> DataFrame:
    """Accuracy, mean F1 and F1 weighted by support."""
    return E.overall_metrics(_rows(spark, sf))


def threshold_choice(spark, sf) -> DataFrame:
    """The abstention threshold with the best mean F1 among those right in 0.9 of what they accept."""
    return E.choose_threshold(_rows(spark, sf))


def _votes(spark, sf) -> DataFrame:
    """Three members' probabilities a document, from its length."""
    n = F.col("n_chars") % 7
    p = [(n + i + 1) / (3 * n + 6 + 0.0) for i in range(3)]
    member = lambda k: F.array(*(p[(i + k) % 3] for i in range(3)))
    return A.table(spark, sf, "documents").select("doc_id", F.posexplode(F.array(*map(member, (0, 0, 1)))).alias("member", "probabilities"))


def ensemble_vote(spark, sf) -> DataFrame:
    """The class with the greatest mean probability over an ensemble's members; the first wins a tie."""
    return E.soft_vote(_votes(spark, sf), "doc_id")


def fold_scores(spark, sf) -> DataFrame:
    """Mean and spread over folds of the accuracy; a group is in one fold."""
    d = _rows(spark, sf)
    d = d.withColumn("grp", F.coalesce("grp", F.lit("")))
    g = d.join(S.folds(d, "grp", 5), "grp").groupBy("fold").agg((F.count_if(F.col("y") == F.col("pred")) / F.count("*")).alias("acc"))
    return g.agg(F.count("*").alias("n_folds"), F.round(F.avg("acc"), 9).alias("mean"), F.round(F.stddev_pop("acc"), 9).alias("spread"))


def split_parts(spark, sf) -> DataFrame:
    """Sheets and rows for training, validation and test; a sheet is in one part."""
    n = _c(spark, sf).groupBy("sheet_no").agg(F.count("*").alias("n"))
    return S.three_way(n, "sheet_no").join(n, "sheet_no").groupBy("part").agg(F.count("*").alias("n_sheets"), F.sum("n").alias("n_rows"))


def sheet_folds(spark, sf) -> DataFrame:
    """The fold of every sheet, of seven."""
    return S.folds(_c(spark, sf), "sheet_no", 7, seed=3)


def manifest_sheets(spark, sf) -> DataFrame:
    """The pages of every job that are for training: all but those that its manifest keeps for tests."""
    return files.training_pages(A.manifests(A.table(spark, sf, "orders")))


def locked_sheets(spark, sf) -> DataFrame:
    """The row rules on sheets that nobody has locked; locked ones keep their decisions."""
    d = R.facts(_c(spark, sf)).withColumn("locked", F.col("sheet_no") % 4 == 0)
    return R.sheets(R.unless_locked(d, R.row_rules))


def manual_edits(spark, sf) -> DataFrame:
    """Sheets after edits by hand: every third candidate of a sheet divisible by 5 moves on to the next class."""
    c = _c(spark, sf)
    edits = c.filter("sheet_no % 5 = 0 and ord % 3 = 0").select("sheet_no", "ord")
    return R.sheets(R.edit(c, edits))


def markup_boxes(spark, sf) -> DataFrame:
    """What a marked-up sheet shows: a box, a tag and a colour for every candidate."""
    return M.markup(_c(spark, sf))


def changed_totals(spark, sf) -> DataFrame:
    """Sheets before and after the row rules; empty text where nothing changed."""
    f = R.facts(_c(spark, sf))
    old, new = R.sheets(f).select("sheet_no", F.col("length_mm").alias("old_mm")), R.sheets(R.row_rules(f)).select("sheet_no", F.col("length_mm").alias("new_mm"))
    return old.join(new, "sheet_no").withColumn("change", F.when(F.col("old_mm") == F.col("new_mm"), "").otherwise(F.concat_ws(" → ", F.col("old_mm").cast("string"), F.col("new_mm").cast("string"))))


def value_spans(spark, sf) -> DataFrame:
    """The nearest text run of every candidate's sheet that shows its value; candidates without one have no row."""
    d = H.nearest_spans(_c(spark, sf), A.number_runs(A.table(spark, sf, "lineitem")))
    return d.select("sheet_no", "ord", *(F.round(F.col("bbox")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


SPANS = """k6 as (select l_orderkey as sheet_no, l_partkey as k, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as integer) as line, cast(20 + (l_partkey % 7) * 24 as double) as px, cast(10 + (l_suppkey % 7) * 24 as double) as py from lineitem
), s6 as (select sheet_no, line, 0 as number, case k % 9 when 0 then 'X ' || (k + 30000) when 1 then 'DN50' when 2 then 'О' || (k % 30) when 3 then '<' || (k % 9) || '>' when 4 then cast(k % 17 as varchar) when 5 then 'ШТУРВАЛ UP' when 6 then 'z+37329' when 7 then 'ф7а' else cast(k + 50 as varchar) end as text, px as x, py as y, cast(k % 2 <> 0 as integer)::double as dir_x from k6
  union all select sheet_no, line, 1, ['ДЛИНЫ' || chr(160) || 'ОТРЕЗКОВ', 'Гидр. 1,5', 'ItemCode', 'Лист 2 из 7', 'AB12_0345', 'Страница 4 исходного', 'ШТУРВАЛ', null, 'СМ. узел', 'ВРЕЗКА'][k % 13 + 1], px + 12, py + 6, cast(k % 2 <> 0 as integer)::double from k6 where k % 13 < 10 and k % 13 <> 7)"""
MARKERS = """mk as (select l_orderkey as sheet_no, l_partkey as mark, cast(100 as double) + (l_suppkey % 7) * 20 as x, cast(100 as double) + (l_partkey % 5) * 15 as y,
  case l_partkey % 11 when 0 then 'Н.О.' when 1 then 'ШТУРВАЛ' when 2 then 'ИЗОЛЯЦИЯ' when 3 then 'ВРЕЗКА' when 4 then 'ЗАГЛУШКА, ВРЕЗКА' end as text from lineitem where l_partkey % 11 <= 4)"""
FRAME = f"""{SPANS}, num as (select * from s6 where regexp_matches(text, '^[0-9]+$')
), nb as (select a.sheet_no, a.line, a.number, b.text, min(b.line * 2 + b.number) as pos from num a join s6 b on a.sheet_no = b.sheet_no and (a.line, a.number) <> (b.line, b.number) and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3025 group by 1, 2, 3, 4
), nr as (select *, row_number() over (partition by sheet_no, line, number order by pos) as r from nb), near as (select sheet_no, line, number, string_agg(text, ' | ' order by pos) as nearby from nr where r <= 12 group by 1, 2, 3
), hd as (select sheet_no, arg_min(x - 8, line * 2 + number) as hx, arg_min(y - 4, line * 2 + number) as hy from s6 where text = 'ДЛИНЫ' || chr(160) || 'ОТРЕЗКОВ' group by 1
), fr as (select s6.*, coalesce(nearby, '') as nearby, case when hx is not null and x >= least(greatest(0, hx - 4.8), 148.8) and x <= 240 and y >= greatest(0, hy - 1.7) and y <= 170 * 0.92 then 'cut_lengths_table' when x >= 240 * 0.68 then 'materials_spec' when y >= 170 * 0.86 then 'title_block'
    when regexp_matches(coalesce(nearby, ''), '(?i)Длина,[ ]*мм|Поз[.][ ]*№|ItemCode|Кол-во|ДЛИНЫ[ \u00a0]+ОТРЕЗКОВ|СПЕЦИФИКАЦИЯ[ ]+МАТЕРИАЛОВ') then 'cut_lengths_table' when regexp_matches(coalesce(nearby, ''), '(?i)°C|МПа|Гидр[.]|Класс трубопровода|Давление испытаний') then 'title_block' end as frame
  from s6 left join near using (sheet_no, line, number) left join hd using (sheet_no)
), rs as (select *, case when regexp_matches(text, '(?i)^(X|Y|Z[+]?)[ ]*[0-9]+$') then 'coordinate_xyz' when regexp_matches(text, '(?i)^DN[0-9]') then 'nominal_diameter' when regexp_matches(text, '(?i)^[ОOФFПP][0-9]+[АAБB]?$') then 'support_tag' when regexp_matches(text, '^<[0-9]+>$') then 'item_balloon'
    when regexp_matches(text, '^[0-9]+$') then coalesce(frame, case when cast(text as bigint) <= 16 then 'bom_or_weld_index' else 'candidate' end) end as reason from fr)"""

ORACLE = {
    "text_spans": f"with {SPANS} select sheet_no, line, number, text, x, y, 9.0::double as size, dir_x from s6",
    "frame_reason": f"with {FRAME} select sheet_no, line, number, reason from rs where reason is not null",
    "page_candidates": f"""with {FRAME} select sheet_no, cast(row_number() over (partition by sheet_no order by line, number) as integer) as ord, cast(text as bigint) as value_mm, x, y, nearby, case when contains(upper(nearby), 'ШТУРВАЛ') then 'near_valve_handwheel' else 'dimension_candidate' end
      || case when contains(nearby, 'СМ.') then '|near_endpoint' else '' end || case when contains(nearby, 'ВРЕЗКА') then '|pipe_opening' else '' end as hint from rs where reason = 'candidate'""",
    "sheet_meta": f"""with {SPANS}, m as (select sheet_no, line * 2 + number as o, text from s6), l as (select sheet_no, arg_max(text, o) filter (text = 'AB12_0345') as line_id, arg_max(2, o) filter (text like 'Лист%') as number, arg_max(7, o) filter (text like 'Лист%') as count, arg_max(text, o) filter (text like 'Страница%') as source_page from m group by 1)
      select sheet_no, coalesce(line_id, 'UNKNOWN_' || sheet_no) as line_id, cast(number as integer) as number, cast(count as integer) as count, coalesce(source_page, '') as source_page from l""",
    "value_spans": f"""with {A1}, t as (select l_orderkey as sheet_no, [12, 20, 34, 81, 159, 244, 300, 650, 840, 916, 1950, 3000, 6000, 10200, 22250, 24100][l_partkey % 16 + 1] as v, cast(90 + (l_partkey % 7) * 20 + (l_partkey % 3) * 10 as double) as tx, cast(100 + (l_suppkey % 5) * 15 + (l_suppkey % 4) * 5 as double) as ty
      from lineitem where l_linenumber % 5 <> 0), j as (select a1.sheet_no, ord, tx, ty, length(cast(v as varchar)) * 2.75::double as n, row_number() over (partition by a1.sheet_no, ord order by (x - tx) * (x - tx) + (y - ty) * (y - ty), tx - length(cast(v as varchar)) * 2.75, ty) as r from a1 join t on a1.sheet_no = t.sheet_no and a1.value_mm = v)
    select sheet_no, ord, tx - n as x0, ty - 5 as y0, tx + n as x1, ty + 5 as y1 from j where r = 1""",
    "marker_flags": f"""with {A1}, {MARKERS}, n as (select distinct a1.sheet_no, ord, value_mm, mk.text, mark, mk.x as mx, mk.y as my, (a1.x - mk.x) * (a1.x - mk.x) + (a1.y - mk.y) * (a1.y - mk.y) as d2, abs(a1.x - mk.x) <= 14 and abs(a1.y - mk.y) <= 14 as inside
      from a1 join mk on a1.sheet_no = mk.sheet_no)
    select sheet_no, ord, 'overall_mark' as flag from (select *, row_number() over (partition by sheet_no, mark, mx, my order by value_mm desc, ord) as r from n where text = 'Н.О.' and d2 <= 8100) where r = 1
    union select sheet_no, ord, 'handwheel' from n where text = 'ШТУРВАЛ' and d2 <= 1600 union select sheet_no, ord, 'insulation' from n where text = 'ИЗОЛЯЦИЯ' and d2 <= 10000
    union select sheet_no, ord, 'insulation_thickness' from n where text = 'ИЗОЛЯЦИЯ' and d2 <= 10000 and inside""",
    "opening_flags": f"with {A1}, {MARKERS} select distinct a1.sheet_no, ord from a1 join mk on a1.sheet_no = mk.sheet_no where text = 'ВРЕЗКА' and (a1.x - mk.x) * (a1.x - mk.x) + (a1.y - mk.y) * (a1.y - mk.y) <= 19600",
    "doc_tokens": r"with t as (select unnest(regexp_extract_all(text, '[^ \n\t]+')) as t from documents) select case when regexp_matches(t, '^[0-9]+$') then 'number' when regexp_matches(t, '^<[0-9]+>$') then 'item_balloon' else 'text' end as kind, count(*) as n from t group by 1",
    "overall_metrics": f"""with {A5}, g as (select class, count(*) filter (y = class and pred = class) as tp, count(*) filter (pred = class) as np, count(*) filter (y = class) as support from cl cross join a5 group by class
    ), m as (select *, case when np + support > 0 then 2 * tp / (np + support) else 0.0 end as f1 from g)
    select (select count(*) from a5) as n, round((select count(*) filter (y = pred) / count(*) from a5), 9) as accuracy, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from m""",
    "threshold_choice": f"""with {A5}, th as (select unnest([0.5, 0.6, 0.7, 0.8, 0.9]) as t), g as (select t, class, count(*) filter (y = class and pred = class and conf >= t) as tp, count(*) filter (pred = class and conf >= t) as np, count(*) filter (y = class) as support,
      count(*) filter (conf >= t) as k, count(*) filter (conf >= t and y = pred) as right_, count(*) as n from th cross join cl cross join a5 group by 1, 2
    ), m as (select t, any_value(k) / any_value(n) as coverage, coalesce(any_value(right_) / nullif(any_value(k), 0), 0) as accuracy, avg(case when np + support > 0 then 2 * tp / (np + support) else 0.0 end) as f1 from g group by t
    ), r as (select *, row_number() over (order by accuracy >= 0.9 desc, round(f1, 12) desc, coverage desc, t) as r from m)
    select cast(t as double) as threshold, round(coverage, 9) as coverage, round(accuracy, 9) as accuracy, round(f1, 9) as macro_f1 from r where r = 1""",
    "ensemble_vote": """with p as (select doc_id, [(n_chars % 7 + 1) / (3 * (n_chars % 7) + 6), (n_chars % 7 + 2) / (3 * (n_chars % 7) + 6), (n_chars % 7 + 3) / (3 * (n_chars % 7) + 6)] as q from documents
    ), m as (select doc_id, [(q[1] + q[1] + q[2]) / 3, (q[2] + q[2] + q[3]) / 3, (q[3] + q[3] + q[1]) / 3] as v from p)
    select doc_id, ['include', 'exclude_nested', 'not_length'][list_position(list_transform(v, lambda z: round(z, 9)), list_max(list_transform(v, lambda z: round(z, 9))))] as pred, round(list_max(v), 9) as confidence from m""",
    "fold_scores": f"""with {A5}, gs as (select distinct coalesce(grp, '') as grp from a5), rk as (select grp, row_number() over (order by md5('7:' || grp), grp) - 1 as r, count(*) over () as n from gs
    ), fo as (select grp, case when r < (n % 5) * (n // 5 + 1) then r // (n // 5 + 1) else n % 5 + (r - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) end as fold from rk
    ), g as (select fold, count(*) filter (y = pred) / count(*) as acc from a5 join fo on coalesce(a5.grp, '') = fo.grp group by 1) select count(*) as n_folds, round(avg(acc), 9) as mean, round(stddev_pop(acc), 9) as spread from g""",
    "split_parts": f"""with {A1}, g as (select sheet_no, count(*) as c from a1 group by 1), rk as (select *, row_number() over (order by md5('7:' || sheet_no), sheet_no) - 1 as r, count(*) over () as n from g
    ), pt as (select *, ceil(n * 0.15::double) as t from rk) select case when r < t then 'test' when r < t + ceil((n - t) * 0.1765::double) then 'validation' else 'train' end as part, count(*) as n_sheets, cast(sum(c) as bigint) as n_rows from pt group by 1""",
    "sheet_folds": f"""with {A1}, g as (select distinct sheet_no from a1), rk as (select sheet_no, row_number() over (order by md5('3:' || sheet_no), sheet_no) - 1 as r, count(*) over () as n from g)
    select sheet_no, cast(case when r < (n % 7) * (n // 7 + 1) then r // (n // 7 + 1) else n % 7 + (r - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) end as integer) as fold from rk""",
    "manifest_sheets": """with j as (select distinct o_orderkey // 1000 as job from orders) select cast(job as varchar) as job, cast(page as integer) as page from j, lateral (select unnest(range(1, 1001)) as page) u
    where (job, page) not in (select (o_orderkey // 1000, o_orderkey % 1000 + 1) from orders where o_orderkey % 10 = 7)""",
    "locked_sheets": f"with {A1}{RULES.format(base='a1')}, mix as (select * from r4 where sheet_no % 4 <> 0 union all select * from f2 where sheet_no % 4 = 0) " + sheets("mix"),
    "manual_edits": f"with {A1}, ed as (select * replace (case when sheet_no % 5 = 0 and ord % 3 = 0 then case decision when 'include' then 'exclude_nested' when 'exclude_nested' then 'not_length' when 'not_length' then 'ambiguous' else 'include' end else decision end as decision) from a1) " + sheets("ed"),
    "markup_boxes": f"with {A1} select sheet_no, ord, 'D' || ord || '=' || value_mm as tag, x - 6 as x0, y - 6 as y0, x + 6 as x1, y + 6 as y1, case decision when 'include' then 'green' when 'exclude_nested' then 'orange' when 'not_length' then 'grey' else 'red' end as colour from a1",
    "changed_totals": f"with {A1}{RULES.format(base='a1')}, o as ({sheets('f2')}), n as ({sheets('r4')}) select o.sheet_no, o.length_mm as old_mm, n.length_mm as new_mm, case when o.length_mm = n.length_mm then '' else o.length_mm || ' → ' || n.length_mm end as change from o join n on o.sheet_no = n.sheet_no",
}
QUERIES = {n: globals()[n] for n in ORACLE}
