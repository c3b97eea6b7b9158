"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays, with calibrated rejection."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

ORDER = 5
#: Distinct drawn texts that each half of a language needs; with fewer all its texts serve for both.
HALF = 8
#: Languages up to this number have their shares broadcast.
BROADCAST_LANGS = 10_000
#: Scored tokens that a worker remembers.
REMEMBERED = 100_000
START, END = 2, 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(token: str) -> list[str]:
    if token.isalpha():
        return [token]
    return "".join(c if c.isalpha() else " " for c in token).split()


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each after ORDER - 1 start symbols and before an end; and where each begins."""
    pad, end = chr(START) * (ORDER - 1), chr(END)
    codes = np.frombuffer("".join(pad + w + end for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    return codes, np.cumsum(sizes) - sizes


def _mix(x: np.ndarray, n: int) -> np.ndarray:
    x = (x + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _grams(codes: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to ORDER: hashes of the n-gram that ends at each place, and of its context."""
    out, total, power = [], np.zeros(len(at), np.uint64), np.uint64(1)
    for n in range(1, ORDER + 1):
        total = total + (codes[at - (n - 1)] + np.uint64(1)) * power
        out.append((_mix(total, n), _mix(total - codes[at], 64 + n)))
        with np.errstate(over="ignore"):
            power = power * _MULTIPLIER
    return out


@dataclass
class Model:
    """langs; for each order sorted n-gram hashes with their discounted share, sorted context hashes with their back-off."""

    langs: list[str]
    base: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    limits: list[tuple[float, float, float]] = field(default_factory=list)

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word and its end, by language."""
        codes, begin = _codes(words)
        first = np.zeros(len(codes), bool)
        sizes = np.diff(np.append(begin, len(codes)))
        first[np.repeat(begin, ORDER - 1) + np.tile(np.arange(ORDER - 1), len(words))] = True
        at = np.flatnonzero(~first)
        p = np.broadcast_to(self.base, (len(at), len(self.langs)))
        for (g, h), (keys, share), (ctx, back) in zip(_grams(codes, at), self.grams, self.contexts, strict=True):
            i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            j = np.minimum(np.searchsorted(ctx, h), len(ctx) - 1)
            p = np.where((keys[i] == g)[:, None], share[i], 0.0) + np.where((ctx[j] == h)[:, None], back[j], 1.0) * p
        ends = np.cumsum(sizes - (ORDER - 1))
        return np.add.reduceat(np.log(p), ends - (sizes - (ORDER - 1)), axis=0)


def fit_kneser_ney(counts: dict[str, list[tuple[str, int]]]) -> Model:
    """Models of all languages from word counts. Lower orders count distinct left neighbours; discounts are n1 / (n1 + 2 n2)."""
    langs = sorted(counts)
    parts: list[list] = [[] for _ in range(ORDER)]
    base = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        words, weight = [w for w, _ in counts[lang]], np.array([n for _, n in counts[lang]], np.float64)
        codes, begin = _codes(words)
        inside = np.ones(len(codes), bool)
        inside[np.repeat(begin, ORDER - 1) + np.tile(np.arange(ORDER - 1), len(words))] = False
        at = np.flatnonzero(inside)
        grams = _grams(codes, at)
        base[k] = 1.0 / (len(np.unique(codes)) + 2)
        mass = np.repeat(weight, np.diff(np.append(begin, len(codes))) - (ORDER - 1))
        seen = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            g, h = grams[n - 1]
            keys, first, inverse = np.unique(g[seen], return_index=True, return_inverse=True)
            c = np.bincount(inverse, mass[seen] if n == ORDER else None, len(keys)).astype(np.float64)
            seen = seen[first]
            ones, twos = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            ctx, of = np.unique(h[seen], return_inverse=True)
            total, kinds = np.bincount(of, c), np.bincount(of)
            parts[n - 1].append((k, keys, np.maximum(c - d, 0) / total[of], ctx, d * kinds / total))
    model = Model(langs, base)
    for order in parts:
        keys, ctx = np.unique(np.concatenate([x[1] for x in order])), np.unique(np.concatenate([x[3] for x in order]))
        share, back = np.zeros((len(keys), len(langs)), np.float32), np.ones((len(ctx), len(langs)), np.float32)
        for k, g, s, h, b in order:
            share[np.searchsorted(keys, g), k] = s
            back[np.searchsorted(ctx, h), k] = b
        model.grams.append((keys, share))
        model.contexts.append((ctx, back))
    return model


class Scorer:
    """Sums of the model's scores over whole texts. Tokens recur, so their scores are remembered, up to REMEMBERED."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.rows = np.zeros((1024, len(model.langs) + 1))

    def texts(self, texts: list[str]) -> np.ndarray:
        """A row a text: log probability by language, then the number of symbols."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        split = [t.lower().encode().split() for t in texts]
        ids, known = self.ids, len(self.ids)
        at = np.fromiter((ids.setdefault(w, len(ids)) for x in split for w in x), np.int64)
        if len(ids) > len(self.rows):
            self.rows = np.concatenate([self.rows[:known], np.zeros((2 * len(ids) - known, self.rows.shape[1]))])
        new = [w.decode() for w in list(ids)[known:]] if len(ids) > known else []
        for begin in range(0, len(new), 20_000):
            runs = [letter_runs(w) for w in new[begin : begin + 20_000]]
            flat = [r for x in runs for r in x]
            rows = np.zeros((len(runs), self.rows.shape[1]))
            if flat:
                of = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
                np.add.at(rows, of, np.column_stack([self.model.score(flat), np.fromiter((len(r) + 1 for r in flat), np.float64, len(flat))]))
            self.rows[known + begin : known + begin + len(runs)] = rows
        out, sizes = np.zeros((len(texts), self.rows.shape[1])), np.array([len(x) for x in split])
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            for c in range(out.shape[1]):
                out[full, c] = np.add.reduceat(self.rows[:, c][at], starts)
        return out


def verdicts(model: Model, sums: np.ndarray) -> list[tuple[str, float, float | None, bool]]:
    """(language, confidence, cross-entropy in bits a symbol, accepted) of each row of sums.

    The language has the lowest cross-entropy; equal ones go to the first name. Confidence is its posterior with the
    evidence counted as of at most 40 symbols. A text is rejected above the limit that calibration gave for its length.
    """
    if not model.langs:
        return [("und", 0.0, None, False)] * len(sums)
    n = sums[:, -1]
    bits = -sums[:, :-1] / np.maximum(n, 1)[:, None] / np.log(2)
    best = bits.argmin(axis=1)
    low = bits[np.arange(len(n)), best]
    sure = 1 / np.exp2(-(bits - low[:, None]) * np.minimum(n, 40)[:, None]).sum(axis=1)
    limit = np.array(model.limits)[best] if model.limits else np.full((len(n), 3), np.inf)
    fine = low <= limit[:, 0] + limit[:, 1] + limit[:, 2] / np.sqrt(np.maximum(n, 1))
    return [(model.langs[b], float(s), float(x), bool(f)) if k else ("und", 0.0, None, False) for b, s, x, f, k in zip(best, sure, low, fine, n, strict=True)]


_scorers: dict[str, Scorer] = C.caches.setdefault("language", {})


def _scorer(shared) -> Scorer:
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = Scorer(shared.value)
    return _scorers[shared.id]


class _Shared:
    """A broadcast model with a name by which a worker remembers its scorer."""

    def __init__(self, spark, model: Model):
        self.cast = spark.sparkContext.broadcast(model)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> Model:
        return self.cast.value


def _sums(df: DataFrame, text: str, keep: list[str], shared: _Shared, schema: str, finish) -> DataFrame:
    keep = [c for c in keep if c not in {x.split()[0] for x in schema.split(", ")}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("language")
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = 0
            while at < batch.num_rows:
                texts, first, held = [], at, 0
                while at < batch.num_rows and (not texts or held < 1_000_000):
                    texts.append(column[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                model = shared.value
                sums = _scorer(shared).texts(texts) if model.langs else np.zeros((len(texts), 1))
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, at - first) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *finish(model, sums, kept)], names=[*keep, *(x.split()[0] for x in schema.split(", "))])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{fields}, {schema}")


def _unseen(counts: list[tuple[str, int]]) -> tuple[float, float] | None:
    """Mean bits a symbol, and a symbol's spread, of words by a model of the others: each half of the words by the other half."""
    if len(counts) < 2:
        return None
    bits, size, n = [], [], []
    for i in range(2):
        other = counts[i::2]
        lengths = np.array([len(w) + 1 for w, _ in other])
        bits.append(-fit_kneser_ney({"": counts[1 - i :: 2]}).score([w for w, _ in other])[:, 0] / lengths / np.log(2))
        size.append(lengths)
        n.append([c for _, c in other] * lengths)
    x, lengths, weight = np.concatenate(bits), np.concatenate(size), np.concatenate(n)
    mean = float(np.average(x, weights=weight))
    return mean, float(np.sqrt(np.average((x - mean) ** 2 * lengths, weights=weight)))


def train(df: DataFrame, text: str, lang: str, allowed: Column, docs_per_lang: int = 800) -> Model:
    """Fit and calibrate on a bounded sample of labelled rows.

    About docs_per_lang documents of each language are drawn by a hash of the text, each whole, and at least one text; copies of
    a drawn text go on as one row with their number, which weighs it. Half of
    the distinct texts of each language give word counts; the other half
    gives the mean and spread of the cross-entropy, from which the rejection limits follow. A language with fewer than HALF
    texts a half takes all for both; its limits then allow for words that the model hasn't seen, as estimated on words left
    out in turn. Rows with a null text or label teach nothing.
    """
    spark = df.sparkSession
    d = df.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    drawn = C.uniform(F.xxhash64(F.lit("draw"), "text"))
    n = d.groupBy("lang").agg(F.count("*").alias("n"), F.min(drawn).alias("least"))
    shares = C.keep(n.select("lang", F.greatest(F.least(F.lit(1.0), F.lit(float(docs_per_lang)) / F.col("n")), "least").alias("share")))
    few_langs = shares.count() <= BROADCAST_LANGS  # else a join that deals a frequent language to many tasks; the rows are the same
    d = d.join(F.broadcast(shares), "lang") if few_langs else C.look_up(d, shares, "lang", "text")
    d = d.filter(drawn <= F.col("share")).groupBy("text", "lang").agg(F.count("*").alias("copies"))  # a drawn text of very many copies is one row
    d = C.keep(d.withColumn("half", F.xxhash64(F.lit("half"), "text")))
    by_lang = Window.partitionBy("lang")
    halves = d.select("lang", "half").distinct().withColumns({"r": F.row_number().over(by_lang.orderBy("half")), "texts": F.count("*").over(by_lang)})
    halves = C.keep(halves.select("lang", "half", F.when(F.col("texts") >= 2 * HALF, F.col("r") % 2 == 0).alias("fit")))
    few = {r["lang"] for r in halves.filter("fit is null").select("lang").distinct().collect()}
    d = d.join(halves, ["lang", "half"]).select("text", "lang", "copies", "fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for t, k, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for token, n in Counter(t.lower().split()).items():
                    for r in letter_runs(token):
                        found[k, r] += n * copies
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([r for _, r in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = d.filter("coalesce(fit, true)").select("text", "lang", "copies").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, list] = {}
    for r in words.collect():
        counts.setdefault(r["lang"], []).append((r["word"], r["n"]))
    if not counts:
        return Model([], np.zeros(0))
    model = fit_kneser_ney({k: sorted(v) for k, v in counts.items()})

    def own(model: Model, sums: np.ndarray, kept: list) -> list:
        n = np.maximum(sums[:, -1], 1)
        at = [model.langs.index(x) if x in model.langs else 0 for x in kept[0].to_pylist()]
        return [pa.array(-sums[np.arange(len(at)), at] / n / np.log(2)), pa.array(sums[:, -1])]

    seen = _sums(d.filter("not coalesce(fit, false)"), "text", ["lang", "copies"], _Shared(spark, model), "bits double, n double", own).filter("n > 0").collect()
    for k in model.langs:
        bits, n, copies = np.array([(r["bits"], r["n"], r["copies"]) for r in seen if r["lang"] == k] or [(8.0, 1.0, 1.0)]).T
        mean = float(np.average(bits, weights=n * copies))
        noise = float(np.sqrt(np.average((bits - mean) ** 2 * np.minimum(n, 200), weights=copies)))  # a symbol's spread, as text length allows
        spread = float(np.sqrt(np.average((bits - np.average(bits, weights=copies)) ** 2, weights=copies)))
        if k in few and (unseen := _unseen(sorted(counts[k]))):
            mean, noise = max(mean, unseen[0]), max(noise, unseen[1])
        model.limits.append((mean, 6 * spread + 1.0, 6 * noise + 2.0))
    return model


def identify(df: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with lang_pred, score, cross_entropy and accepted, from whole texts.

    Null texts and texts without a letter are ``und`` with score 0 and aren't accepted. Equal texts get equal verdicts.
    A ``keep`` column that is named like a result is left out. An empty table gives no rows; without labels all is ``und``.
    """

    def finish(model: Model, sums: np.ndarray, kept: list) -> list:
        rows = verdicts(model, sums)
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]

    return _sums(df, text, keep, _Shared(df.sparkSession, model), "lang_pred string, score double, cross_entropy double, accepted boolean", finish)


def query(spark, sf_dir: str) -> DataFrame:
    d = C.table(spark, sf_dir, "documents")
    held = C.doc_mod(F.col("doc_id"), 4) == 2
    d = d.withColumn("held_out", held)
    model = train(d, "text", "lang", ~held)
    return identify(d, "text", model, ["doc_id", "held_out"])
