"""SQL that must give the rows of the queries, written for another engine on the same tables."""

from __future__ import annotations

A1 = """a1 as (
  select sheet_no, ord, value_mm, x, y, dir_x, dir_y, dc = 10 as om, tc = 8 as hw, tc = 7 as ins, dc = 9 as npc, dc = 8 as po, tc <= 2 as sup, stamped, note, role, reason,
    case qm when 0 then 'exclude_nested' when 1 then 'not_length' when 2 then 'ambiguous' else 'include' end as decision
  from (select l_orderkey as sheet_no,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as integer) as ord,
    [12, 20, 34, 81, 159, 244, 300, 650, 840, 916, 1950, 3000, 6000, 10200, 22250, 24100][l_partkey % 16 + 1] as value_mm,
    cast(100 as double) + (l_partkey % 7) * 20 as x, cast(100 as double) + (l_suppkey % 5) * 15 as y,
    case when l_linenumber % 2 = 0 then cast(1 as double) else cast(0 as double) end as dir_x,
    case when l_linenumber % 2 = 0 then cast(0 as double) else cast(1 as double) end as dir_y,
    cast(round(l_discount * 100) as int) as dc, cast(round(l_tax * 100) as int) as tc, cast(l_quantity as int) % 8 as qm, l_partkey % 29 = 7 as stamped,
    ['LT', 'Гидр. 1,5 МПа', 'ItemCode', 'ВРЕЗКА', 'HOLE'][l_partkey % 23 + 1] as note, ['main', 'other', 'support_offset'][l_suppkey % 4 + 1] as role,
    ['внутри 300', 'рядом Координата Z', 'Полный размер Н.О.', null, 'внутри D2=24100', 'z+ узла', 'сомнение'][l_partkey % 7 + 1] as reason from lineitem) q)"""

NEAR = A1 + """, tx as (
  select sheet_no, ord, x, y, 0 as k, cast(value_mm as varchar) as t from a1
  union all select sheet_no, ord, x, y, 1, 'О' || cast(ord as varchar) from a1 where sup
  union all select sheet_no, ord, x, y, 2, note from a1 where note is not null
), nb as (
  select a.sheet_no, a.ord, t.t, min(t.ord * 3 + t.k) as pos from a1 a join tx t on a.sheet_no = t.sheet_no and a.ord <> t.ord
    and (a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y) <= 3025 group by 1, 2, 3
), nr as (select *, row_number() over (partition by sheet_no, ord order by pos) as r from nb
), near as (select sheet_no, ord, string_agg(t, ' | ' order by pos) as nearby from nr where r <= 12 group by 1, 2
), c as (
  select a1.*, coalesce(nearby, '') as nearby, value_mm >= 2500 and regexp_matches(upper(coalesce(nearby, '')), '(^|[|])[ ]*LT[ ]*($|[|])') as lt, regexp_extract_all(coalesce(nearby, ''), '[0-9]+') as nums
  from a1 left join near using (sheet_no, ord)
), p as (
  select a.sheet_no, a.ord as ao, b.ord as bo, a.value_mm as av, b.value_mm as bv, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2,
    a.dir_x * b.dir_x + a.dir_y * b.dir_y >= 0.985 as along, a.nearby as an, b.nearby as bn, a.om as aom, b.om as bom, b.po as bpo, b.hw as bhw, b.ins as bins, b.lt as blt,
    list_contains(a.nums, cast(b.value_mm as varchar)) as one, list_contains(b.nums, cast(a.value_mm as varchar)) as two,
    contains(a.nearby, cast(b.value_mm as varchar)) as hold_ab, contains(b.nearby, cast(a.value_mm as varchar)) as hold_ba
  from c a join c b on a.sheet_no = b.sheet_no and a.ord <> b.ord
), ov as (select *, r between 1.08 and 1.55 as close, r between 2.0 and 3.5 as stacked, hv >= 8000 or hom as env, regexp_matches(ln, '(?i)(^|[|]) *[ОOФFПP][0-9]+[АAБB]? *($|[|])') as tag from (
  select sheet_no, case when av <= bv then ao else bo end as lo, case when av <= bv then bo else ao end as hi, greatest(av, bv) / least(av, bv) as r, greatest(av, bv) as hv,
    case when av <= bv then an else bn end as ln, case when av <= bv then bom else aom end as hom from p where ao < bo and d2 <= 784 and (hold_ab or hold_ba))
), fl as (select distinct sheet_no, lo as ord, 'nested_offset' as flag from ov where close or (stacked and tag and not env)
  union select distinct sheet_no, hi, 'overall_pair' from ov where not (close or (stacked and tag and not env)) and stacked and env
), op as (select sheet_no, ord from fl where flag = 'overall_pair')"""
NOTED = """, cn as (select * replace (case when nearby = '' then remark else nearby || ' | ' || remark end as nearby) from (select *, ['z+ 37329', 'DN50', 'LT', '10 см', 'Z 24100', 'X 1234567', 'Y8999'][ord % 7 + 1] as remark from c)
), fc as (select *, count(*) over (partition by sheet_no, value_mm) >= 3 and value_mm between 50 and 200 as rep, (sheet_no, ord) in (select (sheet_no, ord) from fl where flag = 'nested_offset') as noff,
  (sheet_no, ord) in (select (sheet_no, ord) from fl where flag = 'overall_pair') as opair, lower(nearby) as low from cn)"""

SUP = "'(?i)(^|[^\\p{L}\\p{N}_])[ОOФF][0-9]+'"
PARENTS = NEAR + f""", sc as (
  select sheet_no, ao, bo, case
    when aom or bom or (sheet_no, ao) in (from op) or (sheet_no, bo) in (from op) or blt or bpo or bhw or bins or not (av / bv between 0.15 and 0.9) or not along or d2 > 36100 then 0.0
    when one and two and av / bv >= 0.65 and d2 <= 5625 then 0.9
    when (one or two) and (regexp_matches(an, {SUP}) or regexp_matches(bn, {SUP})) then 0.85
    when regexp_matches(an, {SUP}) and d2 >= 1225 then 0.7 else 0.0 end as score
  from p where bv > av
), best as (
  select sheet_no, ao as ord, bo as parent_ord, cast(score as double) as score from (
    select *, row_number() over (partition by sheet_no, ao order by score desc, bo) as r from sc where score > 0) where r = 1
), sure as (select * from best where score >= 0.75
), edge as (select * from sure where (sheet_no, ord) not in (select (sheet_no, parent_ord) from sure))"""

RULES = """, f as (
  select c.*, count(*) over (partition by sheet_no, value_mm) as n_same, max(cast(hw as int)) over (partition by sheet_no, value_mm) = 1 as wheel from {base} c
), f2 as (select *, n_same >= 3 and value_mm between 50 and 200 as rep, n_same >= 3 and value_mm <= 25 as small from f
), r1 as (select * replace (case when om and decision in ('include', 'exclude_nested') then 'exclude_nested' else decision end as decision) from f2
), r2 as (select * replace (case when decision in ('include', 'ambiguous') and (hw or (wheel and not po) or ins) then 'not_length' else decision end as decision) from r1
), r3 as (select * replace (case when decision = 'include' and (rep or (npc and value_mm >= 9000)) then 'not_length' else decision end as decision) from r2
), r4 as (select * replace (case when decision in ('include', 'ambiguous') and (value_mm <= 16 or small) then 'not_length' else decision end as decision) from r3)"""

CHAIN = """, tw as (select sheet_no, ao as ord, min(bo) as twin_ord from p
    where one and greatest(av, bv) < 8000 and greatest(av, bv) / least(av, bv) <= 1.35 and d2 >= 1600 group by 1, 2
), g1 as (select r4.*, edge.ord is not null as has_parent, tw.ord is not null as has_twin from r4
    left join edge on r4.sheet_no = edge.sheet_no and r4.ord = edge.ord left join tw on r4.sheet_no = tw.sheet_no and r4.ord = tw.ord
), g2 as (select * replace (case when has_parent and decision in ('include', 'ambiguous', 'exclude_nested') and not om then 'exclude_nested' else decision end as decision) from g1
), g3 as (select * replace (case when decision = 'not_length' and not (hw or ins or rep or (wheel and not po) or value_mm <= 16 or small or (npc and value_mm >= 9000)) then 'include' else decision end as decision) from g2
), g4 as (select * replace (case when decision = 'exclude_nested' and not om and not has_parent and has_twin then 'include' else decision end as decision) from g3
), g5 as (select * replace (case when decision = 'ambiguous' and not (hw or ins or rep or (wheel and not po) or value_mm <= 16) then 'include' else decision end as decision) from g4)"""


def sheets(source: str) -> str:
    return f"""select sheet_no, length_mm, case when n_included > 0 then parts || ' = ' || cast(length_mm as varchar) || ' мм' else '' end as formula,
  case when n_included = 0 then 'error' when n_ambiguous > 0 then 'review' else 'ok' end as status, n_included, n_ambiguous, n_candidates
from (select sheet_no, cast(coalesce(sum(value_mm) filter (decision = 'include'), 0) as bigint) as length_mm,
    string_agg(cast(value_mm as varchar), ' + ' order by ord) filter (decision = 'include') as parts,
    count(*) filter (decision = 'include') as n_included, count(*) filter (decision = 'ambiguous') as n_ambiguous, count(*) as n_candidates
  from {source} group by sheet_no)"""


A5 = """a5 as (
  select doc_id, source as grp, n_chars as value_mm, case when toxic = 1 then 'not_length' when quality = 1 then 'include' else 'exclude_nested' end as y,
    case when n_chars % 10 = 0 then 'not_length' when n_chars % 10 <= 2 then 'exclude_nested' else 'include' end as pred, (doc_id % 100) / 100.0 as conf
  from documents join labels using (doc_id)), cl as (select unnest(['include', 'exclude_nested', 'not_length']) as class)"""
A3 = """a3 as (
  select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length from (select vec_id as seg, label as sheet_no,
    1000 * cast(embedding[1] as double) as x1, 1000 * cast(embedding[2] as double) as y1, 1000 * cast(embedding[3] as double) as x2, 1000 * cast(embedding[4] as double) as y2,
    5 * abs(cast(embedding[5] as double)) as width from embeddings))"""
A6 = """a6 as (select l_orderkey as sheet_no, l_partkey, case l_partkey % 9 when 0 then 'X ' || (l_partkey + 30000) when 1 then 'DN50' when 2 then 'О' || (l_partkey % 30)
  when 3 then '<' || (l_partkey % 9) || '>' when 4 then cast(l_partkey % 17 as varchar) when 5 then 'ШТУРВАЛ UP' when 6 then 'z+37329' when 7 then 'ф7а' else cast(l_partkey + 50 as varchar) end as text from lineitem)"""
PRICES = "(values (1, 'gpt-5-codex', 1.25, 10.0), (2, 'gpt-4o', 2.5, 10.0), (3, 'gpt-4o-mini', 0.15, 0.6), (4, 'gemini-2.5-flash', 0.3, 2.5), (5, 'gemini-2.5-pro', 1.25, 10.0)) as prices(rank, name, inp, outp)"

ORACLE = {
    "other_runs": f"""with {NEAR}, q as (select p.sheet_no, p.ao, p.bo, p.av, p.bv, p.d2, a.nums, a.x, a.y from p join c a on a.sheet_no = p.sheet_no and a.ord = p.ao where bv >= 8000 and av >= 250 and av < bv
    ), t as (select q.*, o.value_mm as ov, (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) as od from q join c o on o.sheet_no = q.sheet_no and o.ord <> q.ao and o.ord <> q.bo)
    select distinct sheet_no, ao as ord, bo as parent_ord, 'mentions' as problem from t where list_contains(list_transform(nums, lambda z: cast(z as bigint)), ov) and ov <> av and ov <> bv and ov > bv * 0.45
    union select distinct sheet_no, ao, bo, 'closer' from t where ov >= 8000 and sqrt(od) + 25 < sqrt(d2)""",
    "audit_problems": f"""with {A1}, s0 as (select sheet_no, ord as id, case when ord % 13 = 0 or value_mm = 81 then value_mm + 1 else value_mm end as mm, case when ord % 5 = 0 and value_mm > 9000 then 'maybe' else decision end as decision from a1 where ord % 11 <> 0 and sheet_no % 17 <> 0
    ), h0 as (select sheet_no, ord as id, nullif(value_mm, 12) as mm, case when ord % 3 = 0 then ord + 1 end as pid, (value_mm % 13) / 10.0 as conf from a1 where sheet_no % 19 <> 0 and (ord <> 2 or sheet_no % 5 <> 0)
    ), both_ as (select distinct sheet_no from s0 intersect select distinct sheet_no from h0
    ), s as (select * from (select * from s0 union all select * from s0 where id % 7 = 0) where sheet_no in (from both_)
    ), h as (select * from (select * from h0 union all select * from h0 where id % 6 = 0) where sheet_no in (from both_))
    select distinct sheet_no, cast(null as integer) as id, 'no_hits' as problem from s0 where sheet_no not in (from both_) union all select distinct sheet_no, null, 'no_saved' from h0 where sheet_no not in (from both_)
    union all select sheet_no, id, 'duplicate_saved' from s group by 1, 2 having count(*) > 1 union all select sheet_no, id, 'duplicate_hits' from h group by 1, 2 having count(*) > 1
    union all select distinct sheet_no, id, 'missing' from h where (sheet_no, id) not in (select (sheet_no, id) from s) union all select distinct sheet_no, id, 'extra' from s where (sheet_no, id) not in (select (sheet_no, id) from h)
    union all select distinct sheet_no, id, 'parent' from h where pid is not null and (sheet_no, pid) not in (select (sheet_no, id) from h) union all select distinct sheet_no, id, 'confidence' from h where conf < 0 or conf > 1
    union all select distinct h.sheet_no, h.id, 'parent_value' from h join h u on u.sheet_no = h.sheet_no and u.id = h.pid where u.mm <> 3000 union all select distinct s.sheet_no, s.id, 'value' from s join h on s.sheet_no = h.sheet_no and s.id = h.id where s.mm <> h.mm
    union all select distinct sheet_no, id, 'class' from s where decision not in ('include', 'exclude_nested', 'not_length', 'ambiguous') union all select distinct sheet_no, id, 'no_value' from h where mm is null""",
    "audit_counts": f"""with {A1}, s0 as (select sheet_no % 4 as job, sheet_no, decision from a1 where ord % 11 <> 0 and sheet_no % 17 <> 0
    ), s as (select job, sheet_no, count(*) filter (decision = 'include') as include, count(*) filter (decision = 'exclude_nested') as exclude_nested, count(*) filter (decision = 'not_length') as not_length, count(*) filter (decision = 'ambiguous') as ambiguous from s0 group by 1, 2
    ), h as (select sheet_no % 4 as job, sheet_no, count(*) as candidates, cast(sheet_no % 9 = 0 as integer) as locked from a1 where sheet_no % 19 <> 0 group by 1, 2
    ), j as (select coalesce(s.job, h.job) as job, * exclude (job, sheet_no) from s full join h on s.job = h.job and s.sheet_no = h.sheet_no)
    select job, count(*) as sheets, cast(coalesce(sum(candidates), 0) as bigint) as candidates, cast(coalesce(sum(locked), 0) as bigint) as locked, cast(coalesce(sum(include), 0) as bigint) as include, cast(coalesce(sum(exclude_nested), 0) as bigint) as exclude_nested, cast(coalesce(sum(not_length), 0) as bigint) as not_length, cast(coalesce(sum(ambiguous), 0) as bigint) as ambiguous from j group by rollup (job)""",
    "group_split": "select part, count(*) as n_sheets, cast(sum(n) as bigint) as n_rows from (select l_orderkey, count(*) as n, case when substring(md5(cast(l_orderkey as varchar)), 1, 2) < '2e' then 'validation' else 'train' end as part from lineitem group by 1) group by part",
    "sheet_length": f"with {A1}{RULES.format(base='a1')} " + sheets("r4"),
    "guard_chain": f"with {PARENTS}{RULES.format(base='c')}{CHAIN} " + sheets("g5"),
    "job_totals": f"with {A1}{RULES.format(base='a1')}, s as ({sheets('r4')}) select coalesce(status, 'ИТОГО') as status, cast(sum(length_mm) as bigint) as length_mm, count(*) as n_sheets, replace(printf('%.3f', sum(length_mm) / 1000.0), '.', ',') as length_m from s group by rollup (status)",
    "status_buckets": f"with {A1} select decision, count(*) as n, cast(sum(value_mm) as bigint) as total_mm, count(distinct sheet_no) as n_sheets from a1 group by decision",
    "repeat_values": f"with {A1} select sheet_no, value_mm, count(*) as n, case when value_mm <= 25 then 'not_length' else 'support_repeat' end as flag from a1 where value_mm <= 25 or value_mm between 50 and 200 group by 1, 2 having count(*) >= 3",
    "neighbor_text": f"with {NEAR} select sheet_no, ord, nearby from near",
    "overall_argmax": f"with {NEAR} select sheet_no, ao as ord, bo as target_ord, bv as target_value from (select *, row_number() over (partition by sheet_no, ao order by bv desc, bo) as r from p where aom and d2 <= 8100) where r = 1",
    "overlap_pairs": f"with {NEAR} select sheet_no, ord, flag from fl",
    "best_parent_text": f"with {PARENTS} select * from best",
    "nest_drop_middle": f"with {PARENTS} select * from edge",
    "sequential_neighbor": f"with {PARENTS} select distinct sheet_no, ao as ord from p where d2 <= 2025 and least(av, bv) >= 500 and greatest(av, bv) / least(av, bv) between 1.5 and 2.8 and (sheet_no, ao) not in (select (sheet_no, ord) from edge)",
    "envelope_pairs": f"""with {A1}, w as (select a.sheet_no, a.ord as large_ord, b.ord as small_ord, b.value_mm as bv, a.value_mm / b.value_mm as r, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2
      from a1 a join a1 b on a.sheet_no = b.sheet_no and a.ord <> b.ord where a.value_mm >= 8000 and b.value_mm >= 800 and a.value_mm / b.value_mm >= 2.2
    ), big as (select * from w where d2 <= 3025), t as (
      select b.sheet_no, b.large_ord, b.small_ord, b.bv, n.ord * 3 + k as pos, case k when 0 then cast(n.value_mm as varchar) when 1 then 'О' || cast(n.ord as varchar) else n.note end as t
      from big b join a1 o on o.sheet_no = b.sheet_no and o.ord = b.large_ord join a1 n on n.sheet_no = o.sheet_no and n.ord <> o.ord and (n.x - o.x) * (n.x - o.x) + (n.y - o.y) * (n.y - o.y) <= 3025
      cross join (values (0), (1), (2)) as kinds(k) where b.d2 > 784 and b.r >= 4 and b.bv >= 2000 and (k = 0 or (k = 1 and n.sup) or (k = 2 and n.note is not null))
    ), u as (select sheet_no, large_ord, small_ord, bv, t, row_number() over (partition by sheet_no, large_ord, small_ord order by min(pos)) as rn from t group by 1, 2, 3, 4, 5)
    select sheet_no, large_ord, small_ord from big where d2 <= 784 union select distinct sheet_no, large_ord, small_ord from u where rn <= 12 and contains(t, cast(bv as varchar))""",
    "twin_run": f"with {NEAR} select sheet_no, ao as ord, min(bo) as twin_ord from p where one and greatest(av, bv) < 8000 and greatest(av, bv) / least(av, bv) <= 1.35 and d2 >= 1600 group by 1, 2",
    "run_parent": f"""with {PARENTS}, ab as (select sheet_no, parent_ord as ord from edge union select sheet_no, ao from p where av > bv and (one or two) and (sheet_no, bo) in (select (sheet_no, ord) from fl where flag = 'nested_offset' union all select (sheet_no, ord) from edge))
      select distinct sheet_no, ord from ab where (sheet_no, ord) not in (select (sheet_no, ord) from edge)""",
    "features": f"""with {PARENTS}{NOTED}, n as (select *, list_max(list_filter(list_transform(regexp_extract_all(nearby, '[0-9]+'), lambda z: cast(z as bigint)), lambda z: z > value_mm)) as larger from fc)
      select n.sheet_no, n.ord, cast(n.value_mm as double) as value, round(ln(1 + n.value_mm), 9) as log_value, n.x, n.y, cast(n.value_mm >= 8000 as double) as big, cast(n.value_mm <= 200 as double) as small,
      cast(regexp_matches(low, '\\bz[+]?\\b') as double) as has_z, cast(contains(low, 'см') as double) as has_sm, cast(contains(low, 'dn') as double) as has_dn, cast(contains(low, 'lt') as double) as has_lt,
      cast(len(string_split(low, '|')) as double) as n_near, cast(larger is not null as double) as has_larger_near, coalesce(round(n.value_mm / larger, 9), 0.0) as nested_ratio, cast(regexp_matches(low, '[оo][0-9]') as double) as support_mark,
      cast(n.om as double) as f_overall_mark, cast(opair as double) as f_overall_pair, cast(n.hw as double) as f_handwheel, cast(n.ins as double) as f_insulation, cast(rep as double) as f_support_repeat, cast(n.npc as double) as f_near_plant_coord,
      cast(0 as double) as f_near_endpoint, cast(noff as double) as f_nested_offset, cast(coalesce(score, 0) >= 0.75 as double) as has_parent, coalesce(score, 0.0) as geo_confidence, coalesce(round(n.value_mm / u.value_mm, 9), 0.0) as parent_ratio,
      round(least(1.0, coalesce(sqrt((n.x - u.x) * (n.x - u.x) + (n.y - u.y) * (n.y - u.y)) / 190.0, 0.0)), 9) as parent_dist_norm, cast(case when n.ord % 7 <> 0 then 6 * n.ord else 0 end as double) as dist_to_line, cast(n.ord % 7 <> 0 as double) as parallel_score
      from n left join best on n.sheet_no = best.sheet_no and n.ord = best.ord left join c u on u.sheet_no = best.sheet_no and u.ord = best.parent_ord""",
    "sample_weights": f"""with {NEAR}{NOTED}, n as (select *, list_max(list_filter(list_transform(list_filter(regexp_split_to_array(nearby, '[ |]+'), lambda t: regexp_matches(t, '^[0-9]+$')), lambda t: cast(t as bigint)), lambda z: z > value_mm)) as larger from fc)
      select sheet_no, ord, round((case when sheet_no % 9 = 0 or sheet_no % 11 = 0 then 8.0 else 1.0 end)::double * (case when om or opair then 5.0 else 1.0 end) * (case when noff then 2.0 else 1.0 end) * (case when hw or ins then 3.5 else 1.0 end) * (case when rep then 2.5 else 1.0 end)
      * (case when value_mm / larger between 0.12 and 0.55 then 3.0 else 1.0 end) * (case decision when 'exclude_nested' then 1.2 when 'not_length' then 1.6 else 1.0 end) * (case when value_mm >= 2000 then 1.8 else 1.0 end) * (case when value_mm <= 25 then 2.0 else 1.0 end), 6)::double as weight from n""",
    "segment_kind": f"with {A3} select seg, sheet_no, case when length between 28 and 900 and width between 0.18 and 1.2 then 'body' when length between 3.5 and 16 and width <= 1.2 then 'tick' else 'drop' end as kind from a3",
    "line_clusters": """with e as (select user_id % 50 as bucket, event_id as ord, epoch_us(ts) / 6e7 as t0, epoch_us(ts) / 6e7 + value as t1 from events
    ), r as (select *, max(t1) over (partition by bucket order by t0, ord rows between unbounded preceding and 1 preceding) as reach from e
    ), i as (select *, sum(case when t0 > reach + 14 then 1 when reach is null then 1 else 0 end) over (partition by bucket order by t0, ord rows unbounded preceding) as island from r)
    select bucket, cast(island as bigint) as island, min(ord) as first_ord, count(*) as n, round(max(t1) - min(t0), 3) as extent from i group by 1, 2""",
    "span_classes": f"with {A6}, k as (select case when regexp_matches(text, '(?i)^(X|Y|Z[+]?)[ ]*[0-9]+$') then 'coordinate_xyz' when regexp_matches(text, '(?i)^DN[0-9]') then 'nominal_diameter' when regexp_matches(text, '(?i)^[ОOФFПP][0-9]+[АAБB]?$') then 'support_tag' when regexp_matches(text, '^<[0-9]+>$') then 'item_balloon' when not regexp_matches(text, '^[0-9]+$') then 'text' when cast(text as bigint) <= 16 then 'bom_or_weld_index' else 'candidate' end as reason from a6) select reason, count(*) as n from k group by reason",
    "plant_coord_flag": f"with {NEAR}{NOTED} select sheet_no, ord from cn where len(list_filter(regexp_extract_all(nearby, '(?i)\\b([XYZ][+]?)[ ]*([0-9]{{4,6}})\\b', 2), lambda z: cast(z as integer) >= 9000 and cast(z as integer) <> value_mm)) > 0",
    "page_meta": "select page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'UNKNOWN_' || page_id) as line_id, length(html) as n_chars, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages",
    "json_props": "select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total_k, count(*) as n from events group by event_type",
    "confusion": f"with {A5} select a.class as y, b.class as pred, count(a5.y) as n from cl a cross join cl b left join a5 on a5.y = a.class and a5.pred = b.class group by 1, 2",
    "class_metrics": f"""with {A5}, g as (select class, count(*) filter (y = class and pred = class) as tp, count(*) filter (pred = class) as np, count(*) filter (y = class) as support from cl cross join a5 group by class
    ), m as (select *, case when np > 0 then tp / np else 0.0 end as p, case when support > 0 then tp / support else 0.0 end as r from g)
    select class, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 9) as f1, support from m""",
    "sheet_error_stats": f"with {A5}, e as (select grp, abs(sum(case when pred = 'include' then value_mm else 0 end) - sum(case when y = 'include' then value_mm else 0 end)) as e from a5 group by grp) select round(avg(e), 6) as mae, cast(median(e) as double) as median_ae, cast(max(e) as bigint) as max_ae, count(*) as n_groups from e",
    "threshold_sweep": f"with {A5} select cast(t as double) as threshold, round(count(*) filter (conf >= t) / count(*), 9) as coverage, round(coalesce(count(*) filter (conf >= t and y = pred) / nullif(count(*) filter (conf >= t), 0), 0), 9) as accuracy from a5 cross join (select unnest([0.5, 0.6, 0.7, 0.8, 0.9]) as t) group by t",
    "train_sheets": "select o_orderkey as sheet_no from orders where o_orderkey not in (select o_orderkey from orders where o_orderkey % 10 = 7)",
    "holdout_leak": "select distinct l_orderkey as sheet_no from lineitem where l_orderkey in (select o_orderkey from orders where o_orderkey % 10 = 7)",
    "dup_ids": "select l_orderkey as sheet_no, l_linenumber as id, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "missing_extra": "select o_orderkey as sheet_no, 'missing' as problem from orders where o_orderkey not in (select l_orderkey from lineitem) union all select distinct l_orderkey, 'extra' from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')",
    "decision_cycle": f"with {A1} select decision, ['include', 'exclude_nested', 'not_length', 'ambiguous'][list_position(['include', 'exclude_nested', 'not_length', 'ambiguous'], decision) % 4 + 1] as following, count(*) as n from a1 group by 1, 2",
    "upsert_sheet": f"with {A1}, old as (select sheet_no, cast(sum(value_mm) as bigint) as length_mm, 'kept' as origin from a1 group by 1), new as (select sheet_no, cast(sum(value_mm) filter (decision = 'include') as bigint) as length_mm, 'new' as origin from a1 where sheet_no % 3 = 0 group by 1) select * from new union all select * from old where sheet_no not in (select sheet_no from new)",
    "unmatched_decisions": f"with {A1}, d as (select sheet_no, ord, decision from a1 where ord % 5 <> 0) select a1.sheet_no, a1.ord, coalesce(d.decision, 'ambiguous') as decision from a1 left join d on a1.sheet_no = d.sheet_no and a1.ord = d.ord",
    "price_lookup": f"""with u as (select role, case role when 'user' then 'gpt-4o-mini' when 'assistant' then 'gemini-2.5-pro-exp' else 'other' end as model, sum(length(text)) as n from conversations group by 1
    ), m as (select role, model, n, inp, outp, row_number() over (partition by role order by rank) as r from u left join {PRICES} on contains(model, name))
    select role, model, cast(n as bigint) as tokens, round(n * coalesce(inp, 0.3) / 1e6 + n * coalesce(outp, 2.5) / 1e6, 9) as usd from m where r = 1""",
}
