"""Conversation repair: the cheapest edits that give a legal order of roles, by recursive DuckDB queries over segments of conversations.

A repaired conversation's role initials match (s?(ua)+)?. Its grammar has four states: nothing yet, after s, after u, after a. A row is
one turn's text of one role; identical rows are one with a count, as all but the first are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Rows of a segment, rows of a batch that DuckDB takes at once, and rows of a range of conversations.
SEGMENT, BATCH, RANGE = 128, 16_384, 200_000
WHITE = " \t\n\x0b\x0c\r"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY = hashlib.sha256().hexdigest()
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State after a kept role in each state that allows it, and after an insert or a change of role, which must be the role that is due.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: What ends a conversation in each state.
CLOSE = {0: "", 1: "II", 2: "I", 3: ""}


def moves() -> list[tuple[str, int, int, int, str]]:
    """(kind, state, next state, cost, initials) of every way over a row: up to two inserts, then the row is kept, changed or
    deleted. kind: its role's initial and ``b`` where it must go (blank or duplicate), ``t`` if truncated, else ``-``."""
    best: dict[tuple, tuple[int, str]] = {}
    for ini, fault, start, inserts in product("suax", "bt-", range(4), range(3)):
        s = start
        for _ in range(inserts):
            s = DUE[s][0]
        ways = [(s, DELETE, "D")]
        if fault != "b":
            extra = TRUNCATED * (fault == "t")
            ways.append((DUE[s][0], REROLE + extra, "R"))
            if (s, ini) in KEEP:
                ways.append((KEEP[s, ini], extra, "K"))
        for end, cost, letter in ways:
            found = (cost + INSERT * inserts, "I" * inserts + letter)
            key = (ini + fault, start, end)
            best[key] = min(best.get(key, found), found)
    return [(*k, *v) for k, v in best.items()]


STEP = """
with recursive way as (
  select g, 0 as i, state as begin, state, 0::bigint as cost, '' as audit from starts
  union all
  select g, i, begin, next, least_.cost, least_.audit from (
    select w.g, w.i + 1 as i, w.begin, m.next,
      min({'cost': w.cost + m.cost + 4 * (r.n - 1), 'audit': w.audit || m.letters || repeat('D', r.n - 1)}) as least_
    from way w join turns r on r.g = w.g and r.i = w.i join moves m on m.kind = r.kind and m.state = w.state
    group by w.g, w.i, w.begin, m.next
  )
)
select w.g, w.begin, w.state, w.cost, w.audit from way w join sizes s on s.g = w.g and s.n = w.i order by w.g
"""

PATHS = "array<struct<begin:int,state:int,cost:long,audit:string>>"
SEGMENTS = f"c string, part int, seg int, first string, last string, illegal long, paths {PATHS}"


def _segments(ordered: DataFrame) -> DataFrame:
    """Rows (c, ini, fault, n), sorted in their partition -> a row for each segment: for every state before it and after it,
    the cheapest way and the least initials among those; each recursion takes one turn of all segments of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        C.tidy("repair")
        part = TaskContext.get().partitionId()
        db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        table = list(zip(*moves(), strict=True))
        db.register("moves", pa.table(dict(zip(("kind", "state", "next", "cost", "letters"), map(list, table), strict=True))))
        held: list[pa.RecordBatch] = []
        before: tuple[str | None, int] = (None, 0)  # conversation and rows of it that have gone
        lead = None  # the partition's first conversation, which may have begun before

        def solve(t: pa.Table, c: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            i = pos % SEGMENT
            begin = np.flatnonzero((i == 0) | np.append(True, c[1:] != c[:-1]))
            sizes = np.diff(np.append(begin, len(c)))
            g = np.repeat(np.arange(len(begin)), sizes)
            ini, n = np.array(t["ini"].to_pylist(), object), t["n"].to_numpy()
            kind = ini + np.array(t["fault"].to_pylist(), object)
            fixed = (pos[begin] == 0) & (c[begin] != lead)
            at = np.concatenate([np.flatnonzero(fixed), np.repeat(np.flatnonzero(~fixed), 4)])
            state = np.concatenate([np.zeros(fixed.sum(), np.int64), np.tile(np.arange(4), (~fixed).sum())])
            db.register("turns", pa.table({"g": g, "i": np.arange(len(c)) - begin[g], "kind": kind.tolist(), "n": n}))
            db.register("starts", pa.table({"g": at, "state": state}))
            db.register("sizes", pa.table({"g": np.arange(len(begin)), "n": sizes}))
            r = db.sql(STEP).to_arrow_table()
            pair = ini[:-1] + ini[1:]
            bad = np.append(0, ~np.isin(pair.astype(str), ["su", "ua", "au"])) if len(ini) > 1 else np.zeros(len(ini), np.int64)
            bad[begin] = 0
            ends = np.append(np.searchsorted(r["g"].to_numpy(), np.arange(len(begin))), r.num_rows)
            flat = r.select(["begin", "state", "cost", "audit"]).cast(pa.schema([("begin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])).combine_chunks()
            paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.to_struct_array().combine_chunks() if r.num_rows else pa.array([], pa.struct(flat.schema)))
            return pa.RecordBatch.from_arrays(
                [pa.array(c[begin].tolist(), pa.string()), pa.array(np.full(len(begin), part), pa.int32()), pa.array(pos[begin] // SEGMENT, pa.int32()), pa.array(ini[begin].tolist()), pa.array(ini[begin + sizes - 1].tolist()), pa.array(np.add.reduceat(bad + n - 1, begin).astype(np.int64)), paths],
                names=["c", "part", "seg", "first", "last", "illegal", "paths"],
            )

        def ready(final: bool):
            nonlocal held, before, lead
            t = pa.Table.from_batches(held)
            c = np.array(t["c"].to_pylist(), object)
            if lead is None:
                lead = c[0]
            new = np.append(c[0] != before[0], c[1:] != c[:-1])
            at = np.arange(len(c))
            last = np.maximum.accumulate(np.where(new, at, 0))
            pos = at - last + np.where((last == 0) & ~new[0], before[1], 0)
            cut = len(c) if final else int(np.flatnonzero(new | (pos % SEGMENT == 0))[-1])
            held = [] if final else t.slice(cut).to_batches()
            if cut:
                before = (c[cut - 1], int(pos[cut - 1]) + 1)
                yield solve(t.slice(0, cut), c[:cut], pos[:cut])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH:
                yield from ready(False)
        if held:
            yield from ready(True)
        db.close()

    return ordered.select("c", "ini", "fault", "n").mapInArrow(run, SEGMENTS)


def _joined(segments: DataFrame) -> DataFrame:
    """(c, illegal, paths) of whole conversations that lie in several segments, by products of neighbouring segments.

    A round joins segments 2j and 2j + 1 of all conversations by the state between them and keeps the cheapest way for each
    pair of outer states, so a conversation of n segments takes log2(n) rounds and no task holds all of it.
    """
    w = Window.partitionBy("c").orderBy("part", "seg")
    bad = ~F.concat(F.lag("last").over(w), F.col("first")).isin("su", "ua", "au")
    x = segments.select("c", "paths", (F.col("illegal") + F.coalesce(bad.cast("long"), F.lit(0))).alias("illegal"), (F.row_number().over(w) - 1).alias("at"))
    x = C.keep(x)
    illegal = x.groupBy("c").agg(F.sum("illegal").alias("illegal"), F.count("*").alias("size"))
    now = x.select("c", "at", F.explode("paths").alias("p")).select("c", "at", "p.*").filter("at > 0 or begin = 0")
    now, most = C.keep(now.join(illegal.select("c", "size"), "c")), illegal.agg(F.max("size")).first()[0] or 1
    while most > 1:
        half = F.floor(F.col("at") / 2).cast("int").alias("at")
        left = now.filter("at % 2 = 0 and at + 1 < size").select("c", half, "begin", F.col("state").alias("mid"), "cost", "audit", "size")
        right = now.filter("at % 2 = 1").select("c", half, F.col("begin").alias("mid"), "state", F.col("cost").alias("more"), F.col("audit").alias("rest"))
        both = left.join(right, ["c", "at", "mid"]).groupBy("c", "at", "begin", "state", "size").agg(F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), F.concat("audit", "rest").alias("audit"))).alias("b"))
        both = both.select("c", "at", "begin", "state", "b.cost", "b.audit", "size")
        both = both.unionByName(now.filter("at % 2 = 0 and at + 1 = size").select("c", half, "begin", "state", "cost", "audit", "size"))
        now, most = C.keep(both.withColumn("size", F.ceil(F.col("size") / 2).cast("long"))), -(-most // 2)
    return now.groupBy("c").agg(F.collect_list(F.struct("begin", "state", "cost", "audit")).alias("paths")).join(illegal.select("c", "illegal"), "c")  # four ways at most


def _hashes(texts: DataFrame, audits: DataFrame) -> DataFrame:
    """(c, repaired_sha256): the edits of each conversation applied to its rows in order, which pass by one after the other."""
    order = ["c", "kind", "turn", "role", "head", "digest"]
    head = audits.select("c", F.lit(0).alias("kind"), *(F.lit(None).cast(texts.schema[n].dataType).alias(n) for n in order[2:]), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    rows = head.unionByName(texts.withColumn("kind", F.lit(1)).select(head.columns)).repartition("c").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("repair")
        c = audit = sha = None
        at = state = 0
        done: list[tuple[str, str]] = []

        def write(role: str, text: str, new: int) -> None:
            nonlocal state
            sha.update(("" if empty[0] else "\n").encode() + f"{role}:{text}".encode())
            empty[0], state = False, new

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                write(DUE[state][1], "", DUE[state][0])
                at += 1

        def end() -> None:
            if c is not None:
                inserts()
                done.append((c, sha.hexdigest()))

        empty = [True]
        for whole in batches:
            for batch in C.slices(iter([whole]), 3):
                for key, kind, role, text, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if kind == 0:
                        end()
                        c, audit, sha, at, state, empty[0] = key, text, hashlib.sha256(), 0, 0, True
                        continue
                    for _ in range(n):
                        inserts()
                        edit = audit[at]
                        at += 1
                        if edit == "K":
                            write(role, text, KEEP[state, role[:1]])
                        elif edit == "R":
                            write(DUE[state][1], text, DUE[state][0])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["c", "repaired_sha256"])
            done.clear()
        end()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["c", "repaired_sha256"])

    return rows.select("c", "kind", "role", "text", "n").mapInArrow(run, "c string, repaired_sha256 string")


def repair(df: DataFrame, conv_id: str, turn: Column, role: Column, text: Column, times: Column | None = None, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows of a conversation stand in order of turn (nulls first), then of role and text; ``times``: how often each stands there.
    A row's first fault counts: blank (no character but white space), duplicate (its role and text occur before), truncated (its
    last such character isn't one of .!?). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (a blank or duplicate row
    must go), Insert of an empty user or assistant row 3; a truncated row that stays adds 3. audit: initials of the cheapest
    edits in order, the least in ASCII among equals.

    Rows are slim until the last step (a digest and 32 characters of the text stand for it). They are sorted by the hash of
    the conversation and their order and cut into ranges at sampled splitters, so a conversation of very many rows lies in
    several ranges. In each range a recursive DuckDB query advances one turn of all segments at once and keeps the
    minimum of cost and initials per state before the segment and after it; segments of long conversations are then
    joined in pairs. Identical rows are merged before a shuffle, and what is equal in role and text is found by
    aggregates, so neither a hot turn nor a hot text meets one task. Only repaired_sha256 passes a conversation's texts through
    one task, row by row, as SHA-256 has to be computed in order; nothing is held but the row and the audit.

    Null role or text: one space. A role without characters is never kept. Null conv_id: a conversation of its own. Null turns: first, and no part of gaps. Texts of equal
    turn, role and first 32 characters stand in order of their digest. ``every``: a table whose conv_id column names all
    conversations to report; those without rows get zeros, an empty audit and the hash of nothing. Other columns don't matter,
    whatever their names. An empty table gives no rows.
    """
    name = F.when(F.col(conv_id).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv_id).cast("string")))
    n = (F.lit(1) if times is None else times).cast("long")
    d = df.select(name.alias("c"), turn.alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), n.alias("n")).filter("n > 0")
    d = d.withColumns({"head": F.substring("text", 1, 32), "digest": F.unhex(F.md5(F.col("text").cast("binary")))})
    core = F.rtrim("text", F.lit(WHITE))
    fault = F.when(core == "", "b").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    order = ["turn", "role", "head", "digest"]
    slim = C.keep(d.groupBy("c", *order, fault.alias("fault")).agg(F.sum("n").alias("n")).withColumn("same", F.struct("c", "role", "digest")))
    first = slim.groupBy("same").agg(F.min(F.struct("turn"))["turn"].alias("first_turn"), F.count("*").alias("turns")).filter("turns > 1")
    ini = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    again = (F.col("turns") > 1) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    marked = C.keep(C.look_up(slim, first, "same", "turn").select("c", *order, ini.alias("ini"), F.when(F.col("fault") == "b", "b").when(again, "d").otherwise(F.col("fault")).alias("fault"), "n"))
    extra = F.when(F.col("fault") == "d", F.col("n")).when(F.col("fault") == "b", 0).otherwise(F.col("n") - 1)
    stats = marked.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("fault") == "b", F.col("n")).otherwise(0)).alias("blank"), F.sum(extra).alias("duplicate"), F.sum((F.col("fault") == "t").cast("long")).alias("truncated"))
    h = F.xxhash64("c")
    ranges = max(1, -(-marked.count() // RANGE))
    ordered = marked.withColumn("h", h).repartitionByRange(ranges, "h", "c", *order).sortWithinPartitions("h", "c", *order)
    ordered = ordered.withColumn("fault", F.when(F.col("fault") == "d", "b").otherwise(F.col("fault")))
    segments = C.keep(_segments(ordered))
    several = segments.groupBy("c").agg(F.count("*").alias("of")).filter("of > 1").select("c", F.lit(True).alias("several"))
    segments = C.keep(C.look_up(segments, several, "c", "seg"))
    ways = segments.filter("several is null").select("c", "illegal", "paths").unionByName(_joined(segments.filter("several")).select("c", "illegal", "paths"))
    best = F.array_min(F.transform(F.filter("paths", lambda p: p["begin"] == 0), _closed))
    solved = C.keep(ways.select("c", "illegal", best.alias("b")).select("c", "illegal", "b.cost", "b.audit"))
    hashes = _hashes(d, solved)
    ids = (df if every is None else every).select(F.col(conv_id)).distinct().withColumn("c", name)
    out = ids.join(stats, "c", "left").join(solved, "c", "left").join(hashes, "c", "left")
    fill = {x.split(" ")[0]: F.lit("") if "string" in x else F.lit(0).cast("long") for x in RESULT.split(", ")} | {"repaired_sha256": F.lit(EMPTY)}
    return out.select(conv_id, *(F.coalesce(F.col(k), v).alias(k) for k, v in fill.items()))


def _closed(p: Column) -> Column:
    """A way with the inserts that end its conversation."""
    close = F.element_at(F.array(*(F.lit(CLOSE[s]) for s in range(4))), p["state"] + 1)
    return F.struct((p["cost"] + INSERT * F.length(close)).alias("cost"), F.concat(p["audit"], close).alias("audit"))


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with the faults that the query repairs: c, turn, role, text and how often the row stands there."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    as_text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    changed = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return df.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), changed.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("times"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged by the hash of its turns and repaired."""
    table = C.table(spark, sf_dir, "conversations")
    return repair(damaged(table), "conv_id", F.col("turn"), F.col("role"), F.col("text"), F.col("times"), table)


ORACLE = r"""
with recursive crc_table as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), hashed as (
  select keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k)::bigint + 1), lambda i: ascii(substr(k, i, 1))::bigint)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 as h
  from keyed, crc_table
), damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when h = 0 then 0 when h = 3 then 2 else 1 end)) as copy from hashed
), rows_ as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core from damaged
), faults as (
  select *, case when core = '' then 'b' when seen then 'd' when right(core, 1) not in ('.', '!', '?') then 't' else '-' end as fault, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by i) as prev from rows_
), stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (prev is not null and prev || ini not in ('su', 'ua', 'au')) as illegal, max(i) as n from faults group by conv_id
), keeps(s, ini, s2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), due(s, s2, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), dp as (
  select conv_id, 1::bigint as i, 0 as j, 0 as s, 0::bigint as cost, '' as audit, '' as made from stats
  union all
  select conv_id, i, j, s, b.cost, b.audit, b.made from (
    select conv_id, i, j, s, min({'cost': cost, 'audit': audit, 'made': made}) as b from (
      select d.conv_id, d.i, d.j + 1 as j, u.s2 as s, d.cost + 3 as cost, d.audit || 'I' as audit, d.made || chr(10) || u.role || ':' as made from dp d join due u on u.s = d.s where d.j < 2
      union all
      select d.conv_id, d.i + 1, 0, d.s, d.cost + 4, d.audit || 'D', d.made from dp d join faults f on f.conv_id is not distinct from d.conv_id and f.i = d.i
      union all
      select d.conv_id, d.i + 1, 0, u.s2, d.cost + case when f.fault = 't' then 6 else 3 end, d.audit || 'R', d.made || chr(10) || u.role || ':' || f.text
      from dp d join faults f on f.conv_id is not distinct from d.conv_id and f.i = d.i and f.fault in ('t', '-') join due u on u.s = d.s
      union all
      select d.conv_id, d.i + 1, 0, k.s2, d.cost + case when f.fault = 't' then 3 else 0 end, d.audit || 'K', d.made || chr(10) || f.role || ':' || f.text
      from dp d join faults f on f.conv_id is not distinct from d.conv_id and f.i = d.i and f.fault in ('t', '-') join keeps k on k.s = d.s and k.ini = f.ini
    ) group by conv_id, i, j, s
  )
), best as (
  select d.conv_id, min({'cost': d.cost, 'audit': d.audit, 'made': d.made}) as b from dp d join stats s on s.conv_id is not distinct from d.conv_id and d.i = s.n + 1 and d.s in (0, 3) group by d.conv_id
)
select c.conv_id, coalesce(s.gaps, 0) as gaps, coalesce(s.blank, 0) as blank, coalesce(s.duplicate, 0) as duplicate, coalesce(s.truncated, 0) as truncated, coalesce(s.illegal, 0) as illegal,
  coalesce(b.b.cost, 0) as cost, coalesce(b.b.audit, '') as audit, sha256(substr(coalesce(b.b.made, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats s on s.conv_id is not distinct from c.conv_id left join best b on b.conv_id is not distinct from c.conv_id
"""
