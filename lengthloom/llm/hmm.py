"""LM scoring with a hidden Markov model: Baum-Welch counts summed over partitions, exact likelihoods by scaled forward."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

STATES = 8
#: Words with an emission of their own during Baum-Welch, ending classes for all others, and words that every worker holds.
SYMBOLS, CLASSES, KNOWN = 16_384, 512, 250_000
#: Longer texts are recursed in pieces of this size, which exact messages join; longest piece of a text for starting values.
SEGMENT, WINDOW = 2048, 4096
#: Weight of the corpus distribution in each state's emissions, and of its ending's states in those of a word.
PRIOR, OWN = 50.0, 8.0
BATCH = 500_000
#: Symbols whose moves are summed at once.
PORTION = 65_536


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def ending(word: bytes) -> int:
    return crc32(word[-3:]) % CLASSES


@dataclass
class Vocabulary:
    """ids of frequent words (0 .. KNOWN-1, commonest first), their symbols (0 is the end of a text) and log10 terms."""

    ids: dict[bytes, int]
    symbol: np.ndarray
    base: np.ndarray
    within: np.ndarray


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def _time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences in falling length: how many are live at each time, where each time begins, and each symbol's place."""
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    begin = np.cumsum(live) - live
    t = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return live, begin, begin[t] + np.repeat(np.arange(len(lengths)), lengths)


def _messages(model: Model, pieces: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of texts in order: the filtered states before each (zero for a text's first), the backward values after it.

    A piece of a long text acts as the product of its moves and emissions; products of all pieces are formed together, then
    handed on from piece to piece.
    """
    n, k = len(pieces), len(model.start)
    before, after = np.zeros((n, k)), np.ones((n, k))
    last = np.append(first[1:], True)
    cut = np.flatnonzero(~(first & last))
    if not len(cut):
        return before, after
    order = cut[np.argsort([-len(pieces[i]) for i in cut], kind="stable")]
    lengths = np.array([len(pieces[i]) for i in order])
    flat, begin = np.concatenate([pieces[i] for i in order]), np.cumsum(lengths) - lengths
    emit, move = (model.emit / model.emit.max(axis=1, keepdims=True)).astype(np.float32), model.move.astype(np.float32)  # only ratios count
    product = np.where(first[order][:, None, None], np.eye(k, dtype=np.float32), move) * emit.take(flat[begin], axis=0)[:, None, :]
    for t, m in enumerate(np.searchsorted(-lengths, -np.arange(2, lengths[0] + 1), "right").tolist(), 1):
        x = (product[:m].reshape(-1, k) @ move).reshape(m, k, k)
        x *= emit.take(flat[begin[:m] + t], axis=0)[:, None, :]
        if t % 4 == 0:
            x /= np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-30)
        product[:m] = x
    of = dict(zip(order.tolist(), product.astype(np.float64), strict=True))
    for i in cut.tolist():
        if not last[i]:
            v = (model.start if first[i] else before[i]) @ of[i]
            before[i + 1] = v / v.sum()
    for i in cut[::-1].tolist():
        if not first[i]:
            v = of[i] @ after[i]
            after[i - 1] = v / v.max()
    return before, after


def posteriors(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward over whole texts: expected starts, expected moves, and each symbol's states in the texts' order."""
    pieces = [x[i : i + SEGMENT] for x in texts for i in range(0, len(x), SEGMENT)]
    first = np.concatenate([np.arange(-(-len(x) // SEGMENT)) == 0 for x in texts])
    ahead_of, behind = _messages(model, pieces, first)
    order = np.argsort([-len(s) for s in pieces], kind="stable")
    lengths = np.array([len(pieces[i]) for i in order])
    live, begin, place = _time_major(lengths)
    n = int(lengths.sum())
    sym = np.empty(n, np.int64)
    sym[place] = np.concatenate([pieces[i] for i in order])
    e, move = model.emit.astype(np.float32).take(sym, axis=0), model.move.astype(np.float32)
    back_move, ones = np.ascontiguousarray(move.T), np.ones(len(move), np.float32)
    steps = list(zip(live.tolist(), begin.tolist(), strict=True))
    begins = np.where(first[:, None], model.start, ahead_of @ model.move)[order].astype(np.float32)
    alpha, scale = np.empty_like(e), np.empty(n, np.float32)
    before = None
    for k, b in steps:
        a, c = alpha[b : b + k], scale[b : b + k]
        np.multiply(begins if before is None else before[:k] @ move, e[b : b + k], out=a)
        np.maximum(a @ ones, 1e-30, out=c)
        a /= c[:, None]
        before = a
    # backward values at the end of each piece, then from there to its begin
    end = begin[lengths - 1] + np.arange(len(lengths))
    tail = behind[order].astype(np.float32)
    tail /= np.maximum((tail * alpha[end]).sum(axis=1), 1e-30)[:, None]
    back = np.ones_like(e)
    back[end] = tail
    e /= scale[:, None]
    ahead = e  # becomes emission times backward value over scale
    after = None
    for k, b in reversed(steps):
        if after is not None:
            np.matmul(after, back_move, out=back[b : b + len(after)])
        after = ahead[b : b + k]
        after *= back[b : b + k]
    moves = ahead_of[order].T @ ahead[: live[0]]  # from piece to piece
    if n > live[0]:
        before, summed = np.arange(live[0], n) - np.repeat(live[:-1], live[1:]), np.zeros(move.shape)
        for i in range(0, len(before), PORTION):
            summed += alpha.take(before[i : i + PORTION], axis=0).T @ ahead[live[0] + i : live[0] + i + PORTION]
        moves = moves + summed
    del e, ahead, after, a, c
    gamma = np.multiply(alpha, back, out=back)  # in place, as all tables here have a row a symbol
    del alpha, before, back
    starts = gamma[: live[0]][first[order]].sum(axis=0, dtype=np.float64)
    sizes = np.array([len(x) for x in pieces])
    begin_of = (np.cumsum(sizes) - sizes)[order]
    at = np.empty(n, np.int64)
    at[np.repeat(begin_of - (np.cumsum(lengths) - lengths), lengths) + np.arange(n)] = place
    return starts, moves.astype(np.float64) * model.move, gamma.take(at, axis=0)


def expected(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of a batch of whole texts: starts, moves (states x states), emissions (symbols x states)."""
    starts, moves, gamma = posteriors(model, texts)
    sym = np.concatenate(texts).astype(np.int64)
    return starts, moves, np.column_stack([np.bincount(sym, gamma[:, k], len(model.emit)) for k in range(gamma.shape[1])])


def likelihood(model: Model, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each whole text: the forward recursion, scaled at every step. emissions: symbols x states."""
    order = np.argsort(-sizes, kind="stable")
    lengths, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    total, alpha, ones = np.zeros(len(sizes)), None, np.ones(len(model.start))
    for t, k in enumerate(live.tolist()):
        alpha = (model.start if alpha is None else alpha[:k] @ model.move) * emissions.take(first[:k] + t, axis=0)
        c = alpha @ ones
        total[:k] += np.log10(c)
        alpha /= c[:, None]
    out = np.empty(len(sizes))
    out[order] = total
    return out


def maximised(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, prior: np.ndarray) -> Model:
    e = emissions + PRIOR * prior[:, None]
    return Model((starts + 0.5) / (starts + 0.5).sum(), (moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True), e / e.sum(axis=0))


def first_guess(sample: list[np.ndarray], prior: np.ndarray, rounds: int = 12) -> Model:
    """Starting values from a bounded sample of sequences: clusters of them by word use, then Baum-Welch on the sample."""
    rng, n = np.random.default_rng(7), len(prior)
    emit = np.tile(prior[:, None], (1, STATES))
    if sample:
        rows, cols = np.repeat(np.arange(len(sample)), [len(s) for s in sample]), np.concatenate(sample)
        log = np.log(np.maximum(prior, 1e-12))
        seed = [int(rng.integers(len(sample)))]
        gain = np.full(len(sample), np.inf)
        share = None
        for k in range(STATES):  # each state starts at a sequence that the states before explain badly
            p = 0.5 * np.bincount(sample[seed[k]], minlength=n) / len(sample[seed[k]]) + 0.5 * prior
            fit = np.bincount(rows, np.log(np.maximum(p, 1e-12))[cols] - log[cols], len(sample)) / np.array([len(s) for s in sample])
            gain = np.minimum(gain, -fit)
            share = fit[:, None] if share is None else np.column_stack([share, fit])
            seed.append(int(np.argmax(np.where([len(s) >= 128 for s in sample], gain, -np.inf))))
        for _ in range(rounds):
            hard = share.argmax(axis=1)
            counts = np.column_stack([np.bincount(cols, hard[rows] == k, n) for k in range(STATES)])
            emit = (counts + PRIOR * prior[:, None]) / (counts.sum(axis=0) + PRIOR)
            share = np.column_stack([np.bincount(rows, np.log(np.maximum(emit[:, k], 1e-12))[cols], len(sample)) for k in range(STATES)])
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    model = Model(np.full(STATES, 1 / STATES), move, emit)
    for _ in range(4 if sample else 0):
        model = maximised(*expected(model, sample), prior)
    return model


def _counts(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array([ending(w) for w in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "class", "n"])

        for batch in batches:
            for t in batch.column(0):
                found.update(tokens(t.as_py()))
            if len(found) > 400_000:
                yield rows()
                found.clear()
        yield rows()

    return df.mapInArrow(run, "word string, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("c"))


def _commonest(counts: DataFrame, most: int) -> pa.Table:
    """The ``most`` commonest words (all, if fewer) by falling count, then word.

    Two histograms of the counts find the least one that still gets in, so only about ``most`` rows leave the executors, and no
    task sorts the tops of all others. Of the words that tie there, those with the smallest hashes are taken.
    """
    d = counts.select("word", "class", "c", F.floor(F.log2("c") * 16).alias("bin"), C.uniform(F.xxhash64(F.lit("tie"), "word")).alias("u"))

    def reach(rows: list, left: int) -> tuple[int | None, int, int]:
        """The value at which ``left`` words are passed going down, how many are left for it, and how many it has."""
        for value, n in sorted(((r[0], r[1]) for r in rows), reverse=True):
            if n > left:
                return value, left, n
            left -= n
        return None, left, 0

    least, left, n = reach(d.groupBy("bin").count().collect(), most)
    if least is not None:
        tie, left, n = reach(d.filter(F.col("bin") == least).groupBy("c").count().collect(), left)
        d = d.filter((F.col("bin") >= least) & ((F.col("c") > tie) | (F.col("c") == tie) & (F.col("u") <= (left + 12 * left**0.5 + 100) / n)))
    t = d.select("word", "class", "c", "u").toArrow().sort_by([("c", "descending"), ("u", "ascending")])
    return t.slice(0, most).sort_by([("c", "descending"), ("word", "ascending")])


ENCODED = "n_tokens long, n_known long, base double, within double, ids binary, classes binary, rare array<struct<word:string,class:int,n:long>>"
STATE_NAMES = [f"s{k}" for k in range(STATES)]


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, lowest bytes first, which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _encode(df: DataFrame, keep: list[str], shared) -> DataFrame:
    """Texts as ids: 0 the end, then known words, then the text's own other words in order of appearance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        names = [x.split(" ")[0] for x in ENCODED.split(", ")]
        kind = pa.list_(pa.struct([("word", pa.string()), ("class", pa.int32()), ("n", pa.int64())]))
        for batch in batches:
            rows = []
            for t in batch.column(len(keep)):
                words = tokens(t.as_py())
                at = np.fromiter(map(v.ids.get, words, repeat(-1)), np.int64, len(words))
                ids = np.append(at + 1, 0)
                rare: dict[bytes, int] = {}
                new = np.flatnonzero(at < 0)
                own = np.fromiter((rare.setdefault(words[i], len(rare)) for i in new.tolist()), np.int64, len(new))
                ids[new] = len(v.symbol) + own
                classes = [ending(w) for w in rare]
                n = np.bincount(own, minlength=len(rare)).tolist()
                known = at[at >= 0]
                rows.append((len(words) + 1, len(known), float(v.base[known].sum()), float(v.within[known].sum()), _planes(ids), np.array(classes, "<u2").tobytes(), [{"word": w.decode(), "class": k, "n": m} for w, k, m in zip(rare, classes, n, strict=True)]))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([r[i] for r in rows], x) for i, x in enumerate(types))], names=[*keep, *names])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{fields}, {ENCODED}")


def _symbols(ids: np.ndarray, classes: bytes, symbol: np.ndarray, first_class: int) -> np.ndarray:
    """Baum-Welch symbols of a text: of the end and known words by ``symbol``, of others by their class."""
    out = symbol[np.minimum(ids, len(symbol) - 1)]
    own = np.flatnonzero(ids >= len(symbol))
    if len(own):
        out[own] = first_class + np.frombuffer(classes, "<u2").astype(np.int64)[ids[own] - len(symbol)]
    return out


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[np.ndarray, bytes, int]]]:
    """(ids, classes, row) of the texts of a partition, in lists of about ``most`` symbols; columns ids, classes, any third."""
    some, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            some.append((_from_planes(batch.column(0)[i].as_py()), batch.column(1)[i].as_py(), batch.column(2)[i]))
            held += len(some[-1][0])
            if held >= most:
                yield some
                some, held = [], 0
    if some:
        yield some


def _guesses(trained: DataFrame, sample: int, symbol: np.ndarray, first_class: int) -> list[np.ndarray]:
    """Symbols of ``sample`` distinct texts, those of the smallest hashes; of a long text a window at a hashed place."""
    shared = trained.sparkSession.sparkContext.broadcast(symbol)
    drawn = [r["_h"] for r in trained.select("_h").distinct().orderBy("_h").limit(sample).collect()]
    if not drawn:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, classes, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _symbols(_from_planes(ids), classes, shared.value, first_class)
                begin = h % max(1, len(x) - WINDOW + 1)
                out.append(x[begin : begin + WINDOW].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.binary())], names=["h", "x"])

    d = trained.filter(F.col("_h") <= max(drawn)).select("ids", "classes", "_h").mapInArrow(run, "h long, x binary").dropDuplicates(["h"])
    return [np.frombuffer(bytes(r["x"]), "<u2").astype(np.int64) for r in sorted(d.collect())]


def _pass(encoded: DataFrame, model: Model, prior: np.ndarray, symbol: np.ndarray) -> Model:
    """One Baum-Welch pass over all training texts: counts of each partition, summed by symbol; the driver gets the sums."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, symbol))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, symbol = shared.value
        total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(m.emit.shape)]
        for some in _batches(batches, BATCH):
            for x, y in zip(total, expected(m, [_symbols(ids, c, symbol, len(m.emit) - CLASSES) for ids, c, _ in some]), strict=True):
                x += y
        rows = np.concatenate([total[0][None], *total[1:]])
        at = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(rows[at, k]) for k in range(STATES))], names=["row", *STATE_NAMES])

    d = encoded.select("ids", "classes", F.lit(0).alias("none")).mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in STATE_NAMES))
    rows = np.zeros((1 + STATES + len(prior), STATES))
    for r in d.groupBy("row").agg(*(F.sum(n).alias(n) for n in STATE_NAMES)).collect():
        rows[r["row"]] = r[1:]
    shared.unpersist()
    return maximised(rows[0], rows[1 : 1 + STATES], rows[1 + STATES :], prior)


def _words_by_state(encoded: DataFrame, model: Model, symbol: np.ndarray) -> np.ndarray:
    """Over all training texts, how often each known word without a symbol is in each state; then the other words by class."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, symbol))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, symbol = shared.value
        first_class = len(m.emit) - CLASSES
        total, counted = np.zeros((len(symbol) + CLASSES, STATES)), np.where(symbol < first_class, -1, np.arange(len(symbol)))
        for some in _batches(batches, BATCH):
            _, _, gamma = posteriors(m, [_symbols(ids, c, symbol, first_class) for ids, c, _ in some])
            at = np.concatenate([_symbols(ids, c, counted, len(symbol)) for ids, c, _ in some])
            own = np.flatnonzero(at >= 0)
            for k in range(STATES):
                total[:, k] += np.bincount(at[own], gamma[own, k], len(total))
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, k], pa.float32()) for k in range(STATES))], names=["at", *STATE_NAMES])

    d = encoded.select("ids", "classes", F.lit(0).alias("none")).mapInArrow(run, "at int, " + ", ".join(f"{n} float" for n in STATE_NAMES))
    t = d.groupBy("at").agg(*(F.sum(n).cast("float").alias(n) for n in STATE_NAMES)).toArrow()
    out = np.zeros((len(symbol) + CLASSES, STATES))
    out[np.array(t["at"], np.int64)] = np.column_stack([np.array(t[n], np.float64) for n in STATE_NAMES])
    return out


def by_word(model: Model, states: np.ndarray, symbol: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Emissions of known words, then of other words by class, over their share of their ending's count.

    A word without a symbol has c + 0.1 of its ending's count, dealt to the states as its own c occurrences and OWN of its
    ending's are; the words of an ending that aren't known are dealt together.
    """
    first_class, n = len(model.emit) - CLASSES, len(symbol)
    out = model.emit[np.append(symbol, np.arange(first_class, len(model.emit)))]
    mid = np.flatnonzero(symbol >= first_class)
    kind = symbol[mid] - first_class
    usual = states[n:] + 1e-3
    np.add.at(usual, kind, states[mid])
    usual /= usual.sum(axis=1, keepdims=True)
    rest = (states[n:] + OWN * usual) / (states[n:].sum(axis=1) + OWN)[:, None]
    own = (states[mid] + OWN * usual[kind]) / (count[mid] + OWN)[:, None]
    mass = total - np.bincount(kind, count[mid] + 0.1, CLASSES)
    amount = mass[:, None] * rest
    np.add.at(amount, kind, (count[mid] + 0.1)[:, None] * own)
    ratio = total[:, None] / amount
    out[mid] *= own * ratio[kind]
    out[n:] *= rest * ratio
    return out.astype(np.float32)


def score(df: DataFrame, keep: list[str], text: str, training: Column, passes: int = 3, sample: int = 1500) -> DataFrame:
    """The ``keep`` columns with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of whole texts).

    Tokens are ASCII-lower-cased words and one end. ``passes`` Baum-Welch passes run over every training text, uncut; in these
    the commonest SYMBOLS training words are emitted by the states, any other word as one of CLASSES endings. The last model
    then gathers, over all training texts, how often each of the KNOWN commonest words is in each state: such a word has its
    smoothed count of its ending, dealt to the states as it was in them, smoothed by all words of the ending. Rarer words
    share the states of their ending and have their own counts, a table that grows with the corpus. So the model is proper
    over an open vocabulary. What the KNOWN words need travels to the workers, a bounded table; counts of rarer words are
    joined by a shuffle. Starting values come from ``sample`` distinct texts, of which a window of WINDOW symbols is read.

    Null text is empty: its only token is the end. Equal texts get equal scores. No training text: base_score is 0 by the
    formula, and the states stay uniform. A ``keep`` column that is named like a result is left out; other names don't matter.
    An empty table gives no rows.
    """
    spark = df.sparkSession
    keep = [c for c in dict.fromkeys(keep) if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    inner = [f"_keep{i}" for i in range(len(keep))]
    d = df.select(*(F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)), F.col(text).alias("_text"), training.alias("_train"))
    counts = C.keep(_counts(d.filter("_train").select("_text")))
    docs = d.filter("_train").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + docs, v + bool(docs)
    whole = n + 0.1 * (v + 1)
    common = _commonest(counts, KNOWN)
    amount, kind = (np.append(np.array(common[c], np.int64), 0) for c in ("c", "class"))
    names = [None, *common["word"].to_pylist()]
    at = np.arange(len(amount))
    own = min(SYMBOLS, len(amount) - 1)
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        mass[r["class"]], kinds[r["class"]] = r["c"], r["k"]
    mass -= np.bincount(kind[:own], amount[:own], CLASSES)
    kinds -= np.bincount(kind[:own], minlength=CLASSES)
    total = mass + 0.1 * (kinds + 1)
    within = np.where(at < own, 0.0, np.log10((amount + 0.1) / total[kind]))
    symbol = np.concatenate([[0], np.where(at < own, at + 1, own + 1 + kind)[:-1]])
    prior = np.concatenate([[docs + 0.1], amount[:own], total])
    prior /= prior.sum()

    shared = spark.sparkContext.broadcast(Vocabulary({w.encode(): i for i, w in enumerate(names[1:])}, symbol, np.log10((amount + 0.1) / whole), within))
    d = d.withColumn("_h", F.xxhash64(F.lit("guess"), "_text"))
    encoded = C.keep(_encode(d.select(*inner, "_train", "_h", "_text"), [*inner, "_train", "_h"], shared).withColumn("_row", F.monotonically_increasing_id()))
    trained = encoded.filter("_train")
    model = first_guess(_guesses(trained, sample, symbol, own + 1), prior)
    for _ in range(passes if docs else 0):
        model = _pass(trained, model, prior, symbol)

    table = by_word(model, _words_by_state(trained, model, symbol), symbol, np.append(0, amount[:-1]).astype(np.float64), total)
    sent = spark.sparkContext.broadcast((model, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = sent.value
        known = np.arange(len(table) - CLASSES)
        for batch in batches:
            columns, out, some, held = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}, [], [], 0
            for i in range(batch.num_rows):
                some.append(_symbols(_from_planes(columns["ids"][i].as_py()), columns["classes"][i].as_py(), known, len(known)))
                held += len(some[-1])
                if held >= 2 * BATCH or i + 1 == batch.num_rows:
                    out.append(likelihood(m, table[np.concatenate(some)], np.array([len(x) for x in some])))
                    some, held = [], 0
            scores = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in rest), scores], names=[*rest, "hmm"])

    rest = [*inner, "_row", "n_tokens", "n_known", "base", "within"]
    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest)
    scored = encoded.select("ids", "classes", *rest).mapInArrow(run, f"{fields}, hmm double")
    shares = F.array(*(F.lit(float(x)) for x in total))
    rare = encoded.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.class", "r.n").join(counts.select("word", "c"), "word", "left")
    rare = rare.withColumn("c", F.coalesce("c", F.lit(0))).withColumn("t", F.element_at(shares, F.col("class") + 1)).groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(whole))).alias("_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.col("t"))).alias("_within"),
    )
    zero, end = F.lit(0), float(np.log10((docs + 0.1) / whole))
    return scored.join(rare, "_row", "left").select(
        *(F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)), "n_tokens", (F.col("n_known") + F.coalesce("_known", zero) + int(docs > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero) + end).alias("base_score"), (F.col("hmm") + F.col("within") + F.coalesce("_within", zero)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    held = C.doc_mod(F.col("doc_id"), 10) == 0
    d = C.table(spark, sf_dir, "documents").withColumn("held_out", held)
    return score(d, ["doc_id", "held_out"], "text", ~held)
