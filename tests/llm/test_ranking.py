"""op13: scores and ranks against a plain version over all pairs, blocks and products of any size, edge cases."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from atlasmill.llm import ranking
from tests.llm.data import SCHEMA, frame, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("a.b", T.StringType())])


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, most=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, words = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        asked, found = Counter(terms(text)), []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // max(1, words)
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, k in asked.items() if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, n + 1, None if none else doc, -score) for n, (score, none, doc) in enumerate(sorted(found)[:most])]
    return sorted(map(repr, out))


def asked():
    texts = [r[1] for r in rows() if r[1]]
    out = [(n, t) for n, t in enumerate(texts[:12])] + [(20, "w1x W1X w1x é EÉ"), (21, "nothing here"), (22, None), (23, ""), (24, "..."), (None, texts[0][:40]), (3, "one two three"), (3, "one two three")]
    return [(i, t, "clash", "c") for i, t in out]


@pytest.mark.parametrize("size", [2 << 20, 500])
def test_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(ranking, "ITEM_BYTES", size)
    got = ranking.ranked(frame(spark), spark.createDataFrame(asked(), ITEMS)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain([r[:2] for r in rows()], [r[:2] for r in asked()])


def test_many_equal_documents(spark):
    """Ties at the cut go by doc_id, within a block and across blocks; copies of a text are all found."""
    some = [((7 * i) % 101, "same words", None, None, 0, None, None) for i in range(101)] + [(None, "same words", None, None, 0, None, None)]
    some += [(500, "another", None, None, 0, None, None)] * 3
    got = sorted(tuple(r) for r in ranking.ranked(spark.createDataFrame(some, SCHEMA).repartition(7), spark.createDataFrame([(1, "Words", "", "")], ITEMS), most=5).collect())
    assert [r[:3] for r in got] == [(1, n + 1, n) for n in range(5)] and len({r[3] for r in got}) == 1


def test_empty_tables(spark):
    items = spark.createDataFrame(asked(), ITEMS)
    none = spark.createDataFrame([], SCHEMA)
    assert ranking.ranked(none, items).collect() == [] and ranking.ranked(frame(spark), items.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, 0, None, None), (2, " .", None, None, 0, None, None)], SCHEMA)
    assert ranking.ranked(blank, items).collect() == []
