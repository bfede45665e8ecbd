"""Small documents with all the awkward cases: nulls, empties, copies, near copies, shared passages, repeats, a long text."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("did", T.StringType()), T.StructField("bucket", T.StringType())])


def words(rng, n, top=400):
    return " ".join(f"w{rng.randrange(top)}x" for _ in range(n))


def texts():
    rng = random.Random(4)
    out = [words(rng, rng.choice([3, 8, 30, 120, 300])) for _ in range(40)]
    base = words(rng, 150)
    for i in range(12):
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        out.append(" ".join(w))
    passage = words(rng, 90)
    out += [f"{words(rng, 20)} {passage} {words(rng, 15)}" for _ in range(6)]
    out += [passage, passage, f"{passage}\n{passage}", "Again " * 150, "a", "A", "...", "", None, " \t\n ", "é" * 500, "one two three"]
    out += [words(rng, 6000), "xü" + words(rng, 80), base.upper(), out[0], out[0]]
    return out


def rows(ids=None):
    out = []
    for i, t in enumerate(texts()):
        out.append((i if i != 17 else None, t, ["en", "de", None][i % 3], f"s{i % 2}" if i % 5 else None, len(t) if t is not None else None, "clash", "clash"))
    out += [out[3], (9, "another text under an id that is there already " * 9, "en", "s0", 1, None, None)]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
