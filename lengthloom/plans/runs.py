"""Queries on dimension lines and on all correction rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..arrays import F, over_sheets
from ..operators import guards as Q
from ..operators import lines as L
from ..operators import pairs as P
from ..operators import rules as R
from ..sources import adapters as A
from .oracle import PARENTS, RULES, SUP, sheets


#: Fixed value: from as many lines on, the rules of whole sheets run on arrays in Python workers; below, as columns, which an existing test looks at.
ON_ARRAYS = 20_000


def candidates(spark, sf, lined: bool = True) -> DataFrame:
    """Candidates with neighbours, overlaps and, if asked, lines: all of a sheet's rows lie together from the first step on, so nothing else is shuffled or written."""
    return paired(A.candidates(A.table(spark, sf, "lineitem")), lined)


def paired(c: DataFrame, lined: bool = True) -> DataFrame:
    """The same of given candidates."""
    c = P.with_overlaps(P.with_neighbours(c))
    return A.with_lines(c) if lined else c


def best_parent_lines(spark, sf) -> DataFrame:
    """The best parent of a candidate by lines and neighbours."""
    return L.best_parents(candidates(spark, sf)).drop("d2")


def along_run_assign(spark, sf) -> DataFrame:
    """The long run that a piece belongs to."""
    return L.along_runs(candidates(spark, sf)).drop("d2")


def relations(spark, sf) -> DataFrame:
    """The parent of a candidate after runs and chains."""
    return L.sure_relations(candidates(spark, sf)).withColumn("dist", F.round("dist", 6))


SAVED = ("decision", "role", "reason")


def decided(c: DataFrame) -> DataFrame:
    """Candidates after the whole chain, with what was saved before; sheets with a number divisible by 9 are locked."""
    d = Q.correct(paired(c).withColumn("was", F.struct(*SAVED)))
    locked = F.col("sheet_no") % 9 == 0
    old = {k: F.col(f"was.{k}") for k in SAVED} | {"log": F.array().cast(f"array<{Q.ENTRY}>")}
    return d.withColumns({k: F.when(locked, v).otherwise(F.col(k)) for k, v in old.items()})


def _decisions(c: DataFrame) -> DataFrame:
    return decided(c).select("sheet_no", "ord", *SAVED)


def _full(c: DataFrame) -> DataFrame:
    return R.sheets(decided(c))


def _notes(c: DataFrame) -> DataFrame:
    return Q.notes(decided(c))


def _relabeled(c: DataFrame) -> DataFrame:
    return decided(c).select("sheet_no", "ord", "was", *SAVED)


_KINDS = "decision string, role string, reason string"


def on_sheets(spark, sf, rules, schema: str, more=lambda c: c) -> DataFrame:
    """rules on the candidates of whole sheets, with what ``more`` adds to them: on arrays, or as columns where there are few."""
    lines = A.table(spark, sf, "lineitem")
    c = more(A.candidates(lines).filter("sheet_no is not null"))
    return over_sheets(c, rules, schema) if lines.count() >= ON_ARRAYS else rules(c)


def guard_decisions(spark, sf) -> DataFrame:
    """The decision of every candidate after all rules, with its role and reason."""
    return on_sheets(spark, sf, _decisions, f"sheet_no bigint, ord int, {_KINDS}")


def guard_full(spark, sf) -> DataFrame:
    """Length, formula and status of every sheet after all rules."""
    return on_sheets(spark, sf, _full, "sheet_no bigint, length_mm bigint, formula string, status string, n_included bigint, n_ambiguous bigint, n_candidates bigint")


def guard_notes(spark, sf) -> DataFrame:
    """What the rules did to a sheet, in their order."""
    return on_sheets(spark, sf, _notes, "sheet_no bigint, note string")


def relabeled_items(spark, sf) -> DataFrame:
    """Saved decisions that the rules change, with what they were; locked sheets keep theirs."""
    d = on_sheets(spark, sf, _relabeled, f"sheet_no bigint, ord int, was struct<decision:string,role:string,reason:string>, {_KINDS}")
    changed = F.when(~F.col("was").eqNullSafe(F.struct(*SAVED)), F.struct(F.col("was.decision").alias("was"), *SAVED))
    return P.having(d.withColumn("changed", changed), "changed")


def chain_cover(spark, sf) -> DataFrame:
    """Whether the pieces along an overall mark make it up."""
    return L.chain_cover(L.chain_parts(candidates(spark, sf)))


def larger_counted(spark, sf) -> DataFrame:
    """Larger values beside a candidate that candidates of its sheet have, and whether one of those counts."""
    n = P.with_neighbours(A.candidates(A.table(spark, sf, "lineitem")))
    named = n.select("sheet_no", "ord", F.col("value_mm").alias("own"), F.explode(F.array_distinct(F.transform("nums", lambda x: x.try_cast("int")))).alias("value_mm")).filter("value_mm > own")
    values = n.groupBy("sheet_no", "value_mm").agg(F.bool_or(F.col("decision") == R.INCLUDE).alias("counted"))
    return named.join(values, ["sheet_no", "value_mm"]).select("sheet_no", "ord", "value_mm", "counted")


LINES = PARENTS + f""", ln as (select *, case when ord % 7 <> 0 then ord - cast(ord % 4 = 3 as int) end as line, cast(6 as double) * ord as off, least(cast(300 as double), cast(20 as double) + value_mm / cast(50 as double)) as len from c
), l2 as (select *, x + dir_x * len as x2, y + dir_y * len as y2 from ln
), g0 as (select a.sheet_no, a.ord as ao, b.ord as bo, a.line as al, b.line as bl, abs(a.off - b.off) as apart, a.dir_x * b.dir_x + a.dir_y * b.dir_y as cs, a.hw or a.ins as aside, a.value_mm as av, b.value_mm as bv,
    (a.x - b.x) * b.dir_x + (a.y - b.y) * b.dir_y as t1, (a.x2 - b.x) * b.dir_x + (a.y2 - b.y) * b.dir_y as t2, (b.x2 - b.x) * b.dir_x + (b.y2 - b.y) * b.dir_y as n,
    case when a.line is not null then (a.x + a.x2) / 2 else a.x end as mx, case when a.line is not null then (a.y + a.y2) / 2 else a.y end as my, b.x as bx, b.y as b_y, b.dir_x as bdx, b.dir_y as bdy,
    least((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), (a.x - b.x2) * (a.x - b.x2) + (a.y - b.y2) * (a.y - b.y2),
      (a.x2 - b.x) * (a.x2 - b.x) + (a.y2 - b.y) * (a.y2 - b.y), (a.x2 - b.x2) * (a.x2 - b.x2) + (a.y2 - b.y2) * (a.y2 - b.y2)) <= 484 as touch
  from l2 a join l2 b on a.sheet_no = b.sheet_no and b.value_mm > a.value_mm
), g1 as (select g0.*, p.d2, p.one, p.two, p.an, p.bn, p.bom, p.bpo, p.blt, p.bhw or p.bins as no_parent, sc.score as txt, greatest(0, least(greatest(t1, t2), greatest(0, n)) - greatest(least(t1, t2), least(0, n))) / greatest(1, abs(t2 - t1)) as o
  from g0 join p using (sheet_no, ao, bo) join sc using (sheet_no, ao, bo)
), g2 as (select *, case when al is null or bl is null or bom or (sheet_no, bo) in (from op) or blt or bpo or al = bl or cs < 0.985 or apart not between 6 and 140 or o < 0.35 or d2 > 48400 or av / bv < 0.2 then 0.0
    when regexp_matches(an, {SUP}) and o >= 0.5 then case when touch and o >= 0.55 then 1.0 else 0.85 end
    when touch and not regexp_matches(bn, '<[0-9]+>') and (((one or two) and av / bv between 0.28 and 0.55) or (o >= 0.55 and av / bv <= 0.4)) then 0.85
    when touch and o >= 0.55 then 0.65 when o >= 0.7 and apart <= 90 then 0.6 else 0.5 end as geo,
    n >= 8 and (al is null or (abs(cs) >= 0.97 and o >= 0.45 and apart between 4 and 160))
      and abs((mx - bx) * bdy - (my - b_y) * bdx) <= 110 and (mx - bx) * bdx + (my - b_y) * bdy between -24 and n + 24 as proj, bv >= 8000 and bl is not null and av >= 250 and not aside and proj as along from g1
), lb as (select sheet_no, ao as ord, bo as parent_ord, cast(s as double) as score, d2 from (
    select *, row_number() over (partition by sheet_no, ao order by s desc, bo) as r from (select *, greatest(geo, txt) as s from g2 where not no_parent) where s > 0) where r = 1
), oq as (select p.sheet_no, p.ao, p.bo, p.av, p.bv, p.d2, a.nums, a.x, a.y from p join c a on a.sheet_no = p.sheet_no and a.ord = p.ao where bv >= 8000 and av >= 250 and av < bv
), oo as (select distinct oq.sheet_no, ao, bo from oq join c o on o.sheet_no = oq.sheet_no and o.ord <> oq.ao and o.ord <> oq.bo
    where (list_contains(list_transform(oq.nums, lambda z: cast(z as bigint)), o.value_mm) and o.value_mm <> av and o.value_mm <> bv and o.value_mm > bv * 0.45)
      or (o.value_mm >= 8000 and sqrt((oq.x - o.x) * (oq.x - o.x) + (oq.y - o.y) * (oq.y - o.y)) + 25 < sqrt(d2))
), kid as (select * from g2 where along and not exists (select 1 from oo where oo.sheet_no = g2.sheet_no and oo.ao = g2.ao and oo.bo = g2.bo)
), run as (select sheet_no, bo from kid group by 1, 2 having count(distinct al) + count(*) filter (al is null) >= 2 or bool_or(regexp_matches(an, {SUP}) or regexp_matches(upper(an), 'Н[.]О|H[.]O'))
), ar as (select sheet_no, ao as ord, bo as parent_ord, d2 from (select kid.*, row_number() over (partition by kid.sheet_no, ao order by d2, kid.bo) as r from kid join run on kid.sheet_no = run.sheet_no and kid.bo = run.bo) where r = 1
), rw as (select coalesce(lb.sheet_no, ar.sheet_no) as sheet_no, coalesce(lb.ord, ar.ord) as ord, ar.ord is not null as in_run,
    case when ar.ord is not null and coalesce(score, 0) < 0.82 then ar.parent_ord else lb.parent_ord end as parent_ord, cast(case when ar.ord is not null and coalesce(score, 0) < 0.82 then 0.82 else score end as double) as score,
    sqrt(case when ar.ord is not null and coalesce(score, 0) < 0.82 then ar.d2 else lb.d2 end) as dist
  from lb full join ar on lb.sheet_no = ar.sheet_no and lb.ord = ar.ord
), rel as (select sheet_no, ord, parent_ord, score, dist from rw where in_run or not exists (select 1 from rw z where z.score >= 0.75 and z.sheet_no = rw.sheet_no and z.parent_ord = rw.ord))"""

#: Pieces along overall marks.
CHAIN_PARTS = """, q as (select p.sheet_no, p.ao, p.bo, p.av, p.bv, p.d2, p.one, p.two, a.x as ax, a.y as ay, b.x as bx, b.y as by_, a.hw or a.ins or (p.sheet_no, p.ao) in (from op) as aside, bl is null or coalesce(proj, false) as lies
  from p join c a on a.sheet_no = p.sheet_no and a.ord = p.ao join c b on b.sheet_no = p.sheet_no and b.ord = p.bo join g2 on g2.sheet_no = p.sheet_no and g2.ao = p.ao and g2.bo = p.bo where p.bom and not p.aom and p.av >= 300 and p.av < p.bv
), seed as (select * from q where one or (two and d2 <= 25600)
), two_ as (select *, row_number() over (partition by sheet_no, bo order by d desc, i, j) as r from (
  select s.sheet_no, s.bo, s.ao as i, z.ao as j, z.ax - s.ax as ux, z.ay - s.ay as uy, (z.ax - s.ax) * (z.ax - s.ax) + (z.ay - s.ay) * (z.ay - s.ay) as d from seed s join seed z on s.sheet_no = z.sheet_no and s.bo = z.bo and s.ao < z.ao)
), way as (select sheet_no, bo, ux, uy from two_ where r = 1 union all select sheet_no, bo, min(ax - bx), min(ay - by_) from seed group by 1, 2 having count(*) = 1
), part as (select q.* from q join way on q.sheet_no = way.sheet_no and q.bo = way.bo where (ux <> 0 or uy <> 0) and lies and not aside and ((ax - bx) * uy - (ay - by_) * ux) * ((ax - bx) * uy - (ay - by_) * ux) <= 3600 * (ux * ux + uy * uy)
), cov as (select sheet_no, bo, count(*) as n_parts, cast(sum(av) as bigint) as sum_parts, sum(av) >= any_value(bv) * 0.97 or any_value(bv) - sum(av) <= 80 as covers from part group by 1, 2)"""


def _step(name: str, prev: str, place: tuple[int, int], *cases) -> str:
    """A table that corrects the one before: cases of condition, decision, role, reason (SQL), and what to log where; the first that holds wins."""
    log = " ".join(f"when {c} then {f'case when {h} then list_append(log, {{{chr(39)}p{chr(39)}: {place[0]}, {chr(39)}a{chr(39)}: ord, {chr(39)}s{chr(39)}: {place[1]}, {chr(39)}t{chr(39)}: {t}}}) else log end' if t else 'log'}" for c, _, _, _, t, h in cases)
    col = lambda k, n: f"case {' '.join(f'when {x[0]} then {x[k]}' for x in cases)} else {n} end as {n}"
    return f", {name} as (select * replace ({col(1, 'decision')}, {col(2, 'role')}, {col(3, 'reason')}, case {log} else log end as log) from {prev}\n)"


def _all() -> str:
    """The passes as SQL, on top of the facts k0."""
    inc, nes, oth, opn = "decision = 'include'", "decision = 'exclude_nested'", "decision = 'not_length'", "decision = 'ambiguous'"
    io, inn = "decision in ('include', 'ambiguous')", "decision in ('include', 'exclude_nested')"
    N, I, O, same, main, part = "'exclude_nested'", "'include'", "'not_length'", "'overall_same_run'", "'main'", "'support_offset'"
    own = lambda t: f"cid || ' {t}'"
    nolen = "(hw or ins or rep or stamp)"
    s = _step("k1", "k0", (1, 0), (f"om and {inn}", N, same, "'метка Н.О.'", own("габарит Н.О."), inc))
    s += f", k1w as (select *, op and is_parent and {inn} as whole from k1)"
    s += _step("k2", "k1w", (1, 1), (f"whole and not {inc}", I, main, "'полный участок, не габарит'", own("полный участок"), "true"))
    s += _step("k3", "k2", (1, 2), (f"not whole and op and {inn}", N, same, "'габарит поверх соседнего'", own("габарит пара"), inc))
    s += _step("k4", "k3", (1, 3), (f"not whole and lt and {inn}", N, same, "'габарит LT'", own("габарит LT"), inc))
    s += _step("k5", "k4", (1, 4), (f"not whole and wheeled and {io}", O, "'valve'", "'штурвал'", own("штурвал"), "true"))
    s += _step("k6", "k5", (1, 5), (f"not whole and ins and {io}", O, "'other'", "'толщина изоляции'", own("толщина изоляции"), "true"))
    s += _step("k7", "k6", (1, 6), (f"not whole and stamp and {io}", O, "'bom'", "'штамп/спецификация'", own("штамп"), "true"))
    s += _step("k8", "k7", (1, 7), (f"not whole and rep and {inc}", O, part, "'повтор опоры'", own("опора"), "true"))
    s += _step("k9", "k8", (1, 8), (f"not whole and npc and value_mm >= 9000 and {inc}", O, "'other'", "'координата узла'", own("координата"), "true"))
    s += _step("k10", "k9", (1, 9), (f"not whole and value_mm <= 16 and {io}", O, "'other'", "'номер позиции'", own("не длина"), "true"))
    s += _step("k11", "k10", (1, 10), (f"not whole and small and {io}", O, "'other'", "'повтор мелкого'", own("мелкий повтор"), "true"))
    s += _step("h2", "k11", (2, 0), (f"(has_parent or nf) and (not (om or op) or has_parent or is_parent) and decision <> 'not_length'", N, part, "case when has_parent then 'внутри D' || pord || '=' || pval else 'размер до опоры' end", "cid || ' внутри ' || coalesce('D' || pord, 'участка')", io))
    out = "om or op or lt or stamp or has_parent"
    s += _step("h3", "h2", (3, 0),
        (f"{nes} and op and is_parent", I, main, "'полный участок, не габарит'", own("вернул полный участок"), "true"),
        (f"{nes} and not ({out}) and edge_parent", I, main, "'полный участок над размером до опоры'", own("вернул полный участок"), "true"),
        (f"{nes} and not ({out}) and beside and is_parent", I, main, "'полный участок, не габарит'", own("вернул полный участок"), "true"),
        (f"{nes} and not ({out}) and beside and not goes_on", N, same, "'габарит рядом'", None, None),
        (f"{nes} and not ({out}) and not regexp_matches(lower(coalesce(reason, '')), 'н[.]о|цепочка|полный размер|lt')", I, main, "'участок, не вложенный'", own("вернул участок"), "true"))
    s += _step("h4", "h3", (4, 0), (f"{oth} and not ({nolen} or wheeled or value_mm <= 16 or small or (npc and value_mm >= 9000))", I, main, "'размер участка'", own("вернул длину"), "true"))
    s += _step("h5", "h4", (5, 0), (f"opening and not {inc} and not ({nolen} or om or op or lt or value_mm <= 16 or ({nes} and (nf or has_parent)))", I, "case when role = 'other' then 'branch' else coalesce(role, 'main') end", "'отверстие/врезка/съёмный'", own("отверстие в сумму"), "true"))
    s += f""", st as (select h.sheet_no, h.ord, h.value_mm, h.is_parent, h.target, t.value_mm as tv, t.{inc} and not t.om and t.value_mm < h.value_mm as may, row_number() over (partition by h.sheet_no order by h.ord) as k
  from h5 h join h5 t on t.sheet_no = h.sheet_no and t.ord = h.target where h.{inc} and not h.goes_on
), walk as (select distinct sheet_no, 0 as k, cast([] as struct(o integer, b integer, c integer, v integer, f boolean)[]) as hits from st
  union all select w.sheet_no, w.k + 1, case when list_contains(list_transform(w.hits, lambda z: z.o), st.ord) then w.hits when not st.is_parent then list_append(w.hits, {{'o': st.ord, 'b': st.ord, 'c': st.target, 'v': st.tv, 'f': false}})
    when st.may and not list_contains(list_transform(w.hits, lambda z: z.o), st.target) then list_append(w.hits, {{'o': st.target, 'b': st.ord, 'c': st.ord, 'v': st.value_mm, 'f': true}}) else w.hits end
  from walk w join st on st.sheet_no = w.sheet_no and st.k = w.k + 1
), fin as (select sheet_no, arg_max(hits, k) as hits from walk group by 1
), h5b as (select h5.*, list_filter(hits, lambda z: z.o = ord)[1] as hit from h5 left join fin using (sheet_no)
), h6 as (select * exclude (hit) replace (case when hit is null then decision else 'exclude_nested' end as decision, case when hit is null then role when hit.f then 'support_offset' else 'overall_same_run' end as role,
    case when hit is null then reason when hit.f then 'внутри D' || hit.c || '=' || hit.v else 'габарит рядом с D' || hit.c end as reason,
    case when hit is null then log else list_append(log, {{'p': 6, 'a': hit.b, 's': 0, 't': cid || case when hit.f then ' внутри D' else ' габарит рядом с D' end || hit.c}}) end as log) from h5b)"""
    s += _step("h7", "h6", (7, 0), (f"decision in ('not_length', 'exclude_nested') and not om and not op and value_mm < 8000 and npc and regexp_matches(coalesce(reason, ''), '(?i)z[+]|координата z|вертикальная координата')", I, "case when role in ('overall_same_run', 'other') then 'main' else role end", "'длина, рядом координата'", own("не координата"), "true"))
    s += _step("h8", "h7", (8, 0), (f"{nes} and not om and not op and not nf and not has_parent and twin_ord is not null", I, "case when role = 'overall_same_run' then 'main' else role end", "'два прогона с D' || twin_ord", "cid || ' два прогона с D' || twin_ord", "true"))
    s += f""", sv as (select sheet_no, value_mm, bool_or({inc}) as counted from h8 group by 1, 2
), orph as (select n.sheet_no, n.ord from (select sheet_no, ord, value_mm as own, cast(unnest(nums) as bigint) as v from h8) n join sv on sv.sheet_no = n.sheet_no and sv.value_mm = n.v where v > own group by 1, 2 having not bool_or(counted)
), h8b as (select *, list_transform(regexp_extract_all(coalesce(reason, ''), '[0-9]+'), lambda z: cast(z as bigint)) as cited, {nes} and not om and not op and not lt and not nf and coalesce(role, '') <> 'support_offset' as loose, (sheet_no, ord) in (select (sheet_no, ord) from orph) as orphan from h8)"""
    inside = "contains(lower(coalesce(reason, '')), 'внутри') and len(cited) > 0 and coalesce(list_max(cited) < value_mm, false)"
    s += _step("h9", "h8b", (9, 0), (f"loose and {inside}", I, "coalesce(role, 'main')", "'не вложен в меньшее'", own("вернул в сумму"), "true"), ("loose and orphan", I, "coalesce(role, 'main')", "'родитель не в сумме'", own("вернул в сумму"), "true"))
    s += """, mk as (select m.sheet_no, m.ord, coalesce(covers, false) as covered from h9 m left join cov on cov.sheet_no = m.sheet_no and cov.bo = m.ord where om and not has_parent
), inn as (select part.sheet_no, part.ao, min(mk.ord) as over_ from part join mk on mk.sheet_no = part.sheet_no and mk.ord = part.bo where not mk.covered group by 1, 2
), h9b as (select h9.*, mk.covered, over_ from h9 left join mk on mk.sheet_no = h9.sheet_no and mk.ord = h9.ord left join inn on inn.sheet_no = h9.sheet_no and inn.ao = h9.ord)"""
    s += _step("h10", "h9b", (10, -1), (f"covered and {inc}", N, same, "'цепочка закрывает участок'", own("габарит, цепочка полная"), "true"), (f"not covered and not {inc}", I, main, "'полный размер, цепочка не закрывает'", own("полный размер"), "true"))
    s += f""", h10b as (select * replace ('exclude_nested' as decision, 'support_offset' as role, 'опора, D' || over_ || ' не закрыт' as reason, list_append(log, {{'p': 10, 'a': over_, 's': ord, 't': cid || ' опора в D' || over_}}) as log) from h10 where over_ is not null and {inc}
  union all select * from h10 where not coalesce(over_ is not null and {inc}, false))"""
    s += _step("h11", "h10b", (11, 0), (f"{opn} and not ({nolen} or wheeled or value_mm <= 16)", I, main, "'принят как длина'", own("из сомнения в сумму"), "true"))
    locked = "select sheet_no, ord, value_mm, decision, role, reason, cast([] as struct(p integer, a integer, s integer, t varchar)[]) as log from c where sheet_no % 9 = 0"
    return s + f", done as (select sheet_no, ord, value_mm, decision, role, reason, log from h11 union all {locked})"


#: All rules, from the facts f2 on; the fold over surrounding candidates is a recursion by position.
FULL = """, e7 as (select * from rel where score >= 0.75
), env as (select sheet_no, ao as ord, bo, one from p where d2 <= 3025 and av >= 8000 and bv >= 800 and av / bv >= 2.2 and (d2 <= 784 or (av / bv >= 4 and bv >= 2000 and hold_ab))
), tg as (select sheet_no, ord, min(bo) as target from env where one group by 1, 2
), tw as (select sheet_no, ao as ord, min(bo) as twin_ord from p where one and greatest(av, bv) < 8000 and greatest(av, bv) / least(av, bv) <= 1.35 and d2 >= 1600 group by 1, 2
), up as (select e7.sheet_no, e7.ord, e7.parent_ord as pord, c.value_mm as pval from e7 join c on c.sheet_no = e7.sheet_no and c.ord = e7.parent_ord
), y0 as (select f2.*, 'D' || f2.ord as cid, (sheet_no, ord) in (from op) as op, pord is not null or (sheet_no, ord) in (select (sheet_no, ord) from fl where flag = 'nested_offset') as nf, pord, pval, pord is not null as has_parent, target, twin_ord,
    (sheet_no, ord) in (select (sheet_no, parent_ord) from e7) as edge_parent, (sheet_no, ord) in (select (sheet_no, ao) from p where av > bv and (one or two) and (sheet_no, bo) in (select (sheet_no, ord) from fl where flag = 'nested_offset' union all select (sheet_no, ord) from e7)) as has_part, (sheet_no, ord) in (select (sheet_no, ord) from env) as beside,
    (sheet_no, ord) in (select (sheet_no, ao) from p where d2 <= 2025 and least(av, bv) >= 500 and greatest(av, bv) / least(av, bv) between 1.5 and 2.8) as near_run,
    stamped or regexp_matches(nearby, '(?i)Длина,[ ]*мм|Поз[.][ ]*№|ItemCode|Кол-во|ДЛИНЫ[ ]+ОТРЕЗКОВ|СПЕЦИФИКАЦИЯ[ ]+МАТЕРИАЛОВ') or regexp_matches(nearby, '(?i)°C|МПа|Гидр[.]|Класс трубопровода|Рабоч(ая|ее)[ ]+температур|Давление испытаний') as stamp,
    po or regexp_matches(nearby, '(?i)ОТВЕРСТ|ВРЕЗК|СЪ[ЕЁ]МН[а-яё]{0,8}[ ]*УЧАСТ|HOLE|OPENING|\\bSTUB\\b') as opening
  from f2 left join up using (sheet_no, ord) left join tg using (sheet_no, ord) left join tw using (sheet_no, ord) where sheet_no % 9 <> 0
), k0 as (select *, (edge_parent or has_part) and not has_parent as is_parent, near_run and not has_parent as goes_on, hw or (wheel and not opening) as wheeled, cast([] as struct(p integer, a integer, s integer, t varchar)[]) as log from y0)"""

QUERIES = {f.__name__: f for f in (best_parent_lines, along_run_assign, relations, chain_cover, guard_decisions, guard_full, guard_notes, relabeled_items, larger_counted)}
_FULL = f"with recursive {LINES}{CHAIN_PARTS}{RULES.format(base='c')}{FULL}{_all()} "
ORACLE = {
    "best_parent_lines": f"with {LINES} select sheet_no, ord, parent_ord, score from lb",
    "along_run_assign": f"with {LINES} select sheet_no, ord, parent_ord from ar",
    "relations": f"with {LINES} select sheet_no, ord, parent_ord, score, round(dist, 6) as dist from rel",
    "guard_decisions": _FULL + "select sheet_no, ord, decision, role, reason from done",
    "guard_full": _FULL + sheets("done"),
    "guard_notes": _FULL + "select sheet_no, 'авто: ' || string_agg(e.t, ', ' order by e.p, e.a, e.s) as note from (select sheet_no, unnest(log) as e from done) group by sheet_no",
    "relabeled_items": _FULL + "select n.sheet_no, n.ord, c.decision as was, n.decision, n.role, n.reason from done n join c on c.sheet_no = n.sheet_no and c.ord = n.ord where (n.decision, n.role, n.reason) is distinct from (c.decision, c.role, c.reason)",
    "chain_cover": f"with {LINES}{CHAIN_PARTS} select sheet_no, bo as ord, n_parts, sum_parts, covers from cov",
    "larger_counted": f"""with {PARENTS}, n as (select distinct sheet_no, ord, value_mm as own, cast(unnest(nums) as integer) as value_mm from c), v as (select sheet_no, value_mm, bool_or(decision = 'include') as counted from c group by 1, 2)
    select n.sheet_no, n.ord, n.value_mm, counted from n join v on n.sheet_no = v.sheet_no and n.value_mm = v.value_mm where n.value_mm > own""",
}
