import random

import pytest
from pyspark.sql import types as T

from lengthloom.session import ship

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    ("size", T.StringType()), ("score", T.StringType()), ("shard", T.StringType()), ("target", T.StringType()), ("class_id", T.StringType()), ("node", T.StringType()), ("length", T.StringType()),
)])


def nasty_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near-copies and repeated rows."""
    rng = random.Random(5)
    words = ["der", "und", "the", "of", "le", "que", "größe", "straße", "été", "alpha", "beta", "gamma", "delta", "x1", "y2", "z3"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    base = [text(80) for _ in range(6)]
    texts = [None, "", " \n\t ", "a", "..!?", "word", *base, *base[:3], base[0] + " tail", base[1].replace("alpha", "omega", 1), text(30_000), "z" * 70_000]
    texts += ["call +1 (988) 555-2485 or 4041894974608795", base[2] + "\n" + base[2], "same line\n" * 40, text(400), text(3)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", "ä", None)[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base[3], "en", "s1", 1), (None, None, None, None, None)]
    return [(*r, "9", None, "x", "t", "c", "n", "l") for r in rows]


@pytest.fixture(scope="session")
def folders(spark, tmp_path_factory):
    """(folder of the nasty table, folder of the empty one)."""
    ship(spark)
    top = tmp_path_factory.mktemp("tables")
    vectors = [(i, [float(i % 7) / 9, -0.2, 0.3], 0) for i in range(50)] + [(60, None, 1), (None, [0.1, 0.2, 0.3], 1), (80, [float("nan"), 1.0, 1.0], 1), (100, [None, 1.0, 1.0], 1), (20, [0.5, -0.2, 0.3], 0), (120, [0.5, 0.5], 0), (121, [0.5, 0.25], 0)]
    for name, docs, vecs in (("nasty", nasty_rows(), vectors), ("empty", [], [])):
        spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{top}/{name}/documents.parquet")
        spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/{name}/embeddings.parquet")
        spark.createDataFrame([(1, 0, "user", "a.", "x"), (None, None, None, None, None)] if docs else [], "conv_id long, turn long, role string, text string, audit string").write.parquet(f"{top}/{name}/conversations.parquet")
    return f"{top}/nasty", f"{top}/empty"
