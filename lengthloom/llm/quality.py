"""Quality rules on repetition inside a text, from the suffix array of its words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, longest_repeat long, covered_words long, repeats array<struct<start:long,end:long>>, kept boolean"
#: Words of a batch whose suffixes are sorted together.
BATCH_WORDS = 400_000


def suffix_order(words, doc):
    """(order, lcp) of the suffixes of many texts at once: sorted by text, then by words; a text's end sorts first.

    words, doc: int arrays, doc ascending. lcp[i]: words that suffixes order[i - 1] and order[i] share, inside one text.
    Ranks double in length; only suffixes that still tie are sorted again, and the ranks of each step give the lcp.
    """
    import numpy as np

    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a rank is the first place of its group
    last = np.ones(n, bool)
    last[:-1] = doc[1:] != doc[:-1]
    left = np.flatnonzero(last)[np.cumsum(last) - last] - np.arange(n) + 1  # words to the text's end
    levels, k = [rank.copy()], 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = order[at]
        nxt = np.where(left[pos] > k, rank[np.minimum(pos + k, n - 1)] + 1, 0)
        by = np.lexsort((nxt, rank[pos]))
        pos, nxt = pos[by], nxt[by]
        old = rank[pos]
        order[at] = pos
        first = np.ones(len(at), bool)
        first[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        new[at] = first
        rank[pos] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        k *= 2
        levels.append(rank.copy())
    # Equal ranks of two suffixes of a text mean that both go on for that many words, so no step leaves the text; a suffix
    # that ends is compared at the next text's first word, whose ranks are others, or at the end of all, which has -1.
    lcp = np.zeros(n, np.int64)
    i = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[i - 1], order[i]
    for j in range(len(levels) - 1, -1, -1):
        at_level = np.append(levels[j], -1)
        step = np.where(at_level[a] == at_level[b], 1 << j, 0)
        lcp[i] += step
        a, b = a + step, b + step
    return order, lcp


def covered(start, length, n):
    """Whether each of n words lies in a span [start, start + length)."""
    import numpy as np

    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:-1]) > 0


def repetition(texts: list[str], min_words: int):
    """For each text: words, words in repeated 3-word windows, words in repeats of min_words or more, longest, spans."""
    import numpy as np

    split = [t.encode().split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    n = int(sizes.sum())
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for x in split for w in x), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), sizes)
    order, lcp = suffix_order(words, doc)
    best = np.zeros(n, np.int64)  # the value of the deepest lcp interval around each suffix
    if n:
        best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    three = np.flatnonzero(best >= 3)
    again = covered(three, 3, n)
    long = np.flatnonzero(best >= min_words)
    span = covered(long, best[long], n)
    per = lambda x: np.bincount(doc, x, len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, np.where(best >= min_words, best, 0))
    edge = np.diff(np.concatenate([[0], span.astype(np.int8), [0]]))
    cut = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1 if n else np.zeros(0, np.int64)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: list[list[dict]] = [[] for _ in texts]
    base = np.cumsum(sizes) - sizes
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        while b < e:  # spans that touch across two texts are two
            stop = min(e, int(cut[np.searchsorted(cut, b, "right")]))
            i = int(doc[b])
            spans[i].append({"start": b - int(base[i]), "end": stop - int(base[i])})
            b = stop
    return sizes, per(again), per(span), longest, spans


def apply_rules(df: DataFrame, text: str, keep: list[str], min_words: int = 8, most_covered: float = 0.4, most_longest: int = 50) -> DataFrame:
    """Judge whole texts; gives the ``keep`` columns, the counts, the repeated spans (in words) and ``kept``.

    A text fails the base rules with under 50 words or more than half of its words in repeated 3-word windows. It fails the
    method if maximal repeated substrings of min_words words or more cover over most_covered of its words, or if one is
    longer than most_longest words. No interval is listed: the value of the deepest lcp interval around a suffix is the larger
    of its lcps with its two neighbours in the suffix array, which is the longest repeat that starts at its word; the union of these
    spans is what maximal repeats cover.
    Null and empty texts have no words and fail. Rows are judged one by one, so copies and ties get equal verdicts.
    A ``keep`` column that is named like a result is left out. An empty table gives no rows.
    """
    keep = [c for c in keep if c not in {x.split(" ")[0] for x in RESULT.replace("start:long,", "").split(", ")}]
    fields = [df.schema[c] for c in keep]
    white, symbols = " \t\n\r\x0b\x0c", "#*$%&|<>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = 0
            while at < batch.num_rows:
                texts, first, held = [], at, 0
                while at < batch.num_rows and (not texts or held < 6 * BATCH_WORDS):
                    texts.append(column[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                sizes, again, span, longest, spans = repetition(texts, min_words)
                rows = []
                for i, t in enumerate(texts):
                    n = int(sizes[i])
                    lines = [x for x in t.split("\n") if x.strip(white)]
                    bad = n < 50 or 100 * int(again[i]) > 50 * n
                    kept = not bad and int(span[i]) <= most_covered * n and int(longest[i]) <= most_longest
                    rows.append((n, len(t) - sum(map(t.count, white)), sum(map(t.count, symbols)), len(lines) - len(set(lines)), int(again[i]), bad, int(longest[i]), int(span[i]), spans[i], kept))
                kept_columns = [batch.column(batch.schema.get_field_index(c)).slice(first, at - first) for c in keep]
                types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
                names = [x.split(" ")[0] for x in RESULT.replace("start:long,", "").split(", ")]
                yield pa.RecordBatch.from_arrays([*kept_columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), RESULT])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(judge, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return apply_rules(C.table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "covered_words")
