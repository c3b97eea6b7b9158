"""Second versions of what operators learn, count and place."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lengthloom.llm import language, packing, quality
from lengthloom.session import ship

from .conftest import nasty_rows


def test_packing_leaves_the_callers_columns_alone(spark):
    ship(spark)
    names = ["_i", "_n", "_rank", "_p", "_split", "_splits", "_places", "_first", "__i"]
    d = spark.createDataFrame([(i, 1 + i % 700, *(f"{n}{i}" for n in names)) for i in range(300)], "doc_id long, length long, " + ", ".join(f"`{n}` string" for n in names))
    got = packing.pack(d, ["doc_id"]).collect()
    assert len(got) == 300 and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 2048 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) for v in used.values())


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def test_copies_of_a_drawn_text_are_one_row(spark, monkeypatch):
    """The driver gets a row a text, however many copies it has; the model is that of all copies."""
    ship(spark)
    rng = np.random.default_rng(1)
    taught = [(prose(rng, "aeioulmnrst", 40), "a") for _ in range(40)] + [(prose(rng, "αεηιλμνορστ", 40), "hot")] * 3000
    d, seen = spark.createDataFrame(taught, "text string, lang string"), []
    real = language._sums
    monkeypatch.setattr(language, "_sums", lambda *a: seen.append(a[0].count()) or real(*a))
    model = language.train(d, "text", "lang", F.lit(True))
    assert seen == [21] and model.langs == ["a", "hot"]
    assert language.identify(d.limit(1).unionByName(d.filter("lang = 'hot'").limit(1)), "text", model, ["lang"]).filter("lang = lang_pred and accepted").count() == 2


def test_very_many_languages_are_joined(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(prose(rng, "aeioulmnrst", 20), "a") for _ in range(30)] + [(prose(rng, "αεηιλμνορστ", 20), "b")] * 9, "text string, lang string")
    one = language.train(d, "text", "lang", F.lit(True), docs_per_lang=10)
    monkeypatch.setattr(language, "BROADCAST_LANGS", 1)
    other = language.train(d, "text", "lang", F.lit(True), docs_per_lang=10)
    assert one.langs == other.langs and one.limits == other.limits and all((a[1] == b[1]).all() for a, b in zip(one.grams, other.grams))


def test_a_language_that_was_not_taught_is_rejected(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    near, far = "aeioulmnrst", "qwzxkjvhybp"
    taught = [(prose(rng, near, 60), "near") for _ in range(60)] + [(prose(rng, "абвгдежзийк", 60), "other") for _ in range(60)]
    model = language.train(spark.createDataFrame(taught, "text string, lang string"), "text", "lang", F.lit(True))
    d = spark.createDataFrame([(k, prose(rng, x, 60)) for k, x in (("near", near), ("far", far)) for _ in range(40)], "lang string, text string")
    got = language.identify(d, "text", model, ["lang"]).collect()
    assert [r["accepted"] for r in got] == [r["lang"] == "near" for r in got]


def test_probabilities_of_all_words_sum_to_one():
    """Over an alphabet of two letters, the words of up to 16 letters take nearly all of the mass, and never more than all."""
    words = [""]
    level = [""]
    for _ in range(12):
        level = [w + c for w in level for c in "ab"]
        words += level
    m = language.fit_kneser_ney({"x": [("ab", 30), ("aab", 10), ("b", 20), ("ba", 7)], "y": [("bb", 20), ("a", 50)]})
    p = np.exp(m.score(words[1:]))
    assert (p.sum(axis=0) <= 1 + 1e-9).all() and (p.sum(axis=0) > 0.7).all()
    shorter = np.exp(m.score([w for w in words[1:] if len(w) <= 6])).sum(axis=0)
    assert (shorter < p.sum(axis=0)).all()


def repeats(words):
    """Per word, the longest string that starts there and starts elsewhere too, by comparing all pairs."""
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def test_quality_verdicts_equal_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    texts = [t for t in {r[1] for r in nasty_rows()} if t is None or len(t) < 5000]
    pool = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in (9, 12, 30, 55, 60)]
    for _ in range(60):
        part = [prose(rng, "abcdefghijk", int(rng.integers(5, 90))) for _ in range(4)]
        texts.append(" ".join([*part, *rng.choice(pool, 3)]) + rng.choice(["", " ", "\n"]))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = Counter()
    for r in quality.apply_rules(d, "text", ["doc_id"]).collect():
        w = (texts[r["doc_id"]] or "").encode().split()
        best = repeats(w)
        span = set().union(*(range(i, i + k) for i, k in enumerate(best) if k >= 8))
        three = set().union(*(range(i, i + 3) for i, k in enumerate(best) if k >= 3))
        bad = len(w) < 50 or 100 * len(three) > 50 * len(w)
        longest = max((k for k in best if k >= 8), default=0)
        assert (r["covered_words"], r["longest_repeat"], r["n_repeat_words"], r["base_failed"]) == (len(span), longest, len(three), bad)
        assert r["kept"] == (not bad and len(span) <= 0.4 * len(w) and longest <= 50)
        kept[r["kept"], bad] += 1
    assert len(kept) == 3 and min(kept.values()) > 2
