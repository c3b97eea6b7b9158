"""What is told about a job: lists of a sheet, summaries, pages for a browser, prompts, costs; names that jobs may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prices in USD a million tokens, in, out; the first name that a model's name contains decides, else the last pair.
PRICES = (("gpt-5-codex", 1.25, 10.0), ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6), ("gemini-2.5-flash", 0.3, 2.5), ("gemini-2.5-pro", 1.25, 10.0))
OTHER_PRICE = (0.3, 2.5)
#: Providers that cost nothing, those that call nobody.
UNPAID = ("openrouter", "groq", "ollama")
SILENT = ("replay", "none")
#: What decisions are called.
LABELS = {"include": "в сумму", "ambiguous": "глянуть", "exclude_nested": "вложенный", "not_length": "не длина"}
#: How much of a formula is drawn, of a name kept, of neighbours quoted by a first and a second prompt.
FORMULA, NAME, FIRST, SECOND = 180, 80, 160, 120
#: Headings of a job's page.
COLUMNS = ("лист", "линия", "мм", "м", "статус", "формула", "лист")


def text_of(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def metres(mm: str | Column) -> Column:
    return F.format_string("%.3f", (F.col(mm) if isinstance(mm, str) else mm) / 1000)


def escaped(c: Column) -> Column:
    """Text for a page: the five signs that mark-up takes for itself are named; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def label(decision: Column) -> Column:
    """What a decision is called; an unknown one is called by itself."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in LABELS.items() for v in kv)), decision), decision)


def flags(text: Column) -> Column:
    """Sorted flags of a list written with commas or bars; empty ones and repeats are left out, null has none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "[,|]"), lambda p: p != "")
    return F.array_sort(F.array_distinct(parts))


def slug(file: Column) -> Column:
    """A job's name from its file's: no folder, no last suffix, no sign that file systems refuse, at most 80 characters."""
    name = F.element_at(F.split(F.coalesce(file, F.lit("")), "/"), -1)
    stem = F.trim(F.regexp_replace(name, r"(?s)^(.*[^.].*?)\.[^.]+$", "$1"))
    stem = F.when(stem == "", "pdf").otherwise(stem)
    clean = F.btrim(F.regexp_replace(stem, r'[<>:"/\\|?*]+', "_"), F.lit(" ."))
    return F.substring(F.when(clean == "", "pdf").otherwise(clean), 1, NAME)


def safe(name: Column) -> Column:
    """Whether a name stays in the folder of jobs; null and empty ones don't."""
    return F.coalesce((name != "") & ~name.rlike(r"\.\.|/|\\"), F.lit(False))


def stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm")


def cost(model: Column, provider: Column, sent: Column, got: Column) -> Column:
    """USD of the tokens sent and got; free models and unpaid providers cost nothing."""
    key = F.lower(F.coalesce(model, F.lit("")))
    usd = F.coalesce(*(F.when(key.contains(n), sent * i / 1e6 + got * o / 1e6) for n, i, o in PRICES), sent * OTHER_PRICE[0] / 1e6 + got * OTHER_PRICE[1] / 1e6)
    free = key.contains(":free") | F.coalesce(provider.isin(*UNPAID), F.lit(False))
    return F.when(free, 0.0).otherwise(usd)


def job_costs(usage: DataFrame) -> DataFrame:
    """job, model, calls, sent, got, usd, and calls and usd a page, of usage: job, model, provider, calls, sent, got, pages.

    A job that replays has no calls; one without pages counts as one page.
    """
    calls = F.when(F.coalesce(F.col("provider").isin(*SILENT), F.lit(False)), F.lit(0).cast("long")).otherwise(F.col("calls"))
    usd, pages = cost(F.col("model"), F.col("provider"), F.col("sent"), F.col("got")), F.greatest(F.col("pages"), F.lit(1))
    d = usage.select("job", "model", calls.alias("calls"), "sent", "got", usd.alias("usd"), pages.alias("pages"))
    return d.select("job", "model", "calls", "sent", "got", F.round("usd", 6).alias("usd"), F.round(F.col("calls") / F.col("pages"), 2).alias("calls_per_page"), F.round(F.col("usd") / F.col("pages"), 6).alias("usd_per_page"))


def status_lists(c: DataFrame) -> DataFrame:
    """sheet_no with three lists of cid, value_mm, role, reason in order: included, ambiguous, excluded. Unknown decisions are ambiguous."""
    every = F.sort_array(F.collect_list(F.struct("ord", "cid", "value_mm", "role", "reason", F.coalesce("decision", F.lit("ambiguous")).alias("decision"))))
    those = lambda when: F.transform(F.filter("every", lambda x: when(x["decision"])), lambda x: F.struct(x["cid"], x["value_mm"], x["role"], x["reason"]))
    g = c.groupBy("sheet_no").agg(every.alias("every"))
    out = lambda k: k.isin("exclude_nested", "not_length")
    return g.select("sheet_no", those(lambda k: k == "include").alias("included"), those(lambda k: (k != "include") & ~out(k)).alias("ambiguous"), those(out).alias("excluded"))


def captions(sheets: DataFrame) -> DataFrame:
    """sheet_no, title, formula as drawn on a marked sheet: length in both units with the status; a long formula is cut."""
    title = F.concat(text_of("length_mm"), F.lit(" мм = "), metres("length_mm"), F.lit(" м  ["), text_of("status"), F.lit("]"))
    return sheets.select("sheet_no", title.alias("title"), F.substring(text_of("formula"), 1, FORMULA).alias("formula"))


def _totals(sheets: DataFrame) -> list[Column]:
    return [F.count("*").alias("n"), F.coalesce(F.sum("length_mm"), F.lit(0)).cast("long").alias("mm"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "review").alias("review")]


def summaries(sheets: DataFrame, heads: DataFrame) -> DataFrame:
    """job, text: file, time, sheets, sum in both units, sheets by status, a line each.

    sheets: job, length_mm, status. heads: job, pdf, updated, once a job; a job that has no head is told without them.
    """
    d = sheets.groupBy("job").agg(*_totals(sheets)).join(heads.select("job", "pdf", "updated"), "job", "left")
    lines = (
        F.concat(F.lit("PDF: "), text_of("pdf")), F.concat(F.lit("Посчитано: "), text_of("updated")), F.concat(F.lit("Листов: "), text_of("n")),
        F.concat(F.lit("Сумма: "), text_of("mm"), F.lit(" мм = "), metres("mm"), F.lit(" м")), F.concat(F.lit("ok: "), text_of("ok"), F.lit(", review: "), text_of("review")),
    )
    return d.select("job", F.concat_ws("\n", *lines).alias("text"))


def pages(sheets: DataFrame, heads: DataFrame) -> DataFrame:
    """job, html: a page a job with a row a sheet, in order, and a total row. sheets: job, sheet_no, line_id, length_mm, status, formula.

    A page is as long as its job; all texts are escaped. Repeated sheets have repeated rows.
    """
    cells = lambda *c: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c), F.lit("</tr>"))
    none = F.lit("")
    row = cells(text_of("sheet_no"), escaped(F.col("line_id")), text_of("length_mm"), F.coalesce(metres("length_mm"), none), escaped(F.col("status")), escaped(F.col("formula")), none)
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", row.alias("row")))), lambda r: r["row"]), "\n")
    d = sheets.groupBy("job").agg(*_totals(sheets), rows.alias("rows")).join(heads.select("job", "pdf", "updated"), "job", "left")
    about = F.concat(
        F.lit("<p>PDF: "), escaped(F.col("pdf")), F.lit("<br>"), escaped(F.col("updated")), F.lit(" · листов "), text_of("n"), F.lit(" · сумма "), text_of("mm"), F.lit(" мм ("), metres("mm"),
        F.lit(" м) · ok "), text_of("ok"), F.lit(" · review "), text_of("review"), F.lit("</p>"),
    )
    title = F.when(text_of("pdf") == "", "длины").otherwise(escaped(F.col("pdf")))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="ru"><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>"))
    table = F.lit("<table><tr>" + "".join(f"<th>{c}</th>" for c in COLUMNS) + "</tr>")
    total = cells(none, F.lit("итого"), text_of("mm"), metres("mm"), none, none, none)
    return d.select("job", F.concat_ws("\n", head, about, table, F.col("rows"), total, F.lit("</table></body></html>")).alias("html"))


def write_pages(d: DataFrame, path: str, text: str = "html") -> None:
    """A folder job=... below path for each job, with its text in one file."""
    d.select("job", F.col(text).alias("value")).write.partitionBy("job").option("lineSep", "\n").text(path)


def _line(far: int) -> Column:
    return F.concat(F.lit("- D"), text_of("ord"), F.lit(": "), text_of("value_mm"), F.lit(" мм; "), text_of("hint"), F.lit("; рядом: "), F.substring(text_of("nearby"), 1, far))


def _said() -> Column:
    return F.concat(F.lit("- D"), text_of("ord"), F.lit(": "), text_of("decision"), F.lit(" / "), text_of("reason"))


def _in_order(d: DataFrame, **texts: Column) -> DataFrame:
    """sheet_no and, for each text of a row, those of a sheet's rows in order, a line each."""
    joined = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", x.alias("line")))), lambda r: r["line"]), "\n")
    return d.groupBy("sheet_no").agg(*(joined(x).alias(n) for n, x in texts.items()))


def _headed(d: DataFrame, meta: DataFrame, *texts: str) -> DataFrame:
    head = F.concat(F.lit("Лист "), text_of("sheet_no"), F.lit(", линия "), text_of("line_id"))
    return d.join(meta.select("sheet_no", "line_id"), "sheet_no", "left").select("sheet_no", F.concat_ws("\n", head, *texts).alias("text"))


def prompts(c: DataFrame, meta: DataFrame, draft: DataFrame | None = None) -> DataFrame:
    """sheet_no, text: what a classifier is asked of a sheet's candidates, in order; neighbours are quoted in part.

    c: sheet_no, ord, value_mm, hint, nearby. meta: sheet_no, line_id. draft (sheet_no, ord, decision, reason) makes it the second
    question, which tells the decisions so far and quotes less.
    """
    if draft is None:
        return _headed(_in_order(c, lines=_line(FIRST)), meta, "lines")
    return _headed(_in_order(c, lines=_line(SECOND)).join(_in_order(draft, said=_said()), "sheet_no", "left"), meta, "said", "lines")


def second_prompts(c: DataFrame, meta: DataFrame) -> DataFrame:
    """The second question for candidates that carry their draft as decision and reason: a sheet's rows are gathered once."""
    return _headed(_in_order(c, lines=_line(SECOND), said=_said()), meta, "said", "lines")


def first_files(files: DataFrame) -> DataFrame:
    """job, sheet_no, path of the first file, by its path, of those that a sheet has."""
    return files.groupBy("job", "sheet_no").agg(F.min("path").alias("path"))


def replayed(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """The saved documents of the wanted sheets (job, sheet_no); a sheet without one is an error that names it."""
    on = ["job", "sheet_no"]
    w = wanted.select(*on).distinct()
    lost = w.join(saved.select(*on), on, "left_anti").agg(F.count("*").alias("n"), F.min(F.struct(*on)).alias("first")).first()
    if lost.n:
        raise FileNotFoundError(f"{lost.n} sheets have no saved decisions, the first is {lost.first['sheet_no']} of {lost.first['job']}")
    return saved.join(w, on, "left_semi")
