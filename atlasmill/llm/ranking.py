"""Ranked lexical search: a blocked sparse matrix product of items by terms and terms by documents.

Documents are cut to terms once; a block of them is written as the rows of a sparse matrix, a row a term, for the terms
that items ask for. Sums of the blocks give the statistics of the whole corpus, and with them each entry its integer
impact. A task then forms the product block by block after Gustavson: an item's row is the sum of the rows of its terms,
added up in one array over the block's documents. Of each block only what can be among an item's best is kept, and
the tasks' lists are reduced in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from atlasmill.llm.routing import Pack
from atlasmill.llm.tables import small_batches
from atlasmill.session import materialize

#: What separates terms: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 20
#: Bytes of item texts in one product: bounds the terms that the driver and the tasks hold. More items are more products.
ITEM_BYTES = 2 << 20
#: Parts that an item's lists are reduced in before they meet.
PARTS = 64
ENTRIES, DOCUMENTS = Pack(term="<i4", doc="<i4", tf="<i8"), Pack(doc_id="<i8", known="<u1", n="<i8")
DOCS, TERMS = -1, -2


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a column of texts and the row of each; only A to Z are lower-cased, null has none."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), SEPARATORS)
    flat, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(there), rows.filter(there).to_numpy().astype(np.int64)


class Items:
    """Items by terms: ids of the items, the terms asked for, and of each item its terms and their multiplicity."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        terms, rows = terms_of(texts)
        self.ids, self.vocabulary = ids, terms.unique()
        numbers = pc.index_in(terms, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
        keys, self.times = np.unique(rows * max(1, len(self.vocabulary)) + numbers, return_counts=True)
        self.term = keys % max(1, len(self.vocabulary))
        self.first = np.searchsorted(keys, np.arange(len(ids) + 1) * max(1, len(self.vocabulary)))


def _blocks(vocabulary: pa.Array):
    """Work of a task that writes each batch of documents as one block."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            terms, rows = terms_of(texts)
            number = pc.index_in(terms, value_set=vocabulary)
            asked = number.is_valid().to_numpy(zero_copy_only=False)
            keys, tf = np.unique(number.fill_null(0).to_numpy()[asked].astype(np.int64) * len(ids) + rows[asked], return_counts=True)
            entries = ENTRIES.dump({"term": keys // len(ids), "doc": keys % len(ids), "tf": tf})
            about = DOCUMENTS.dump({"doc_id": ids.fill_null(0).to_numpy(), "known": ids.is_valid().to_numpy(zero_copy_only=False), "n": np.bincount(rows, minlength=len(ids))})
            yield pa.RecordBatch.from_arrays([pa.array([entries], pa.binary()), pa.array([about], pa.binary())], names=["entries", "about"])

    return run


def _sums(size: int):
    """Work of a task that counts the documents of each term, all documents with a term and all terms."""

    def run(batches):
        df, docs, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for entries, about in zip(*(batch.column(i).to_pylist() for i in range(2))):
                df += np.bincount(ENTRIES.load([entries])["term"], minlength=size)
                n = DOCUMENTS.load([about])["n"]
                docs, words = docs + int(np.count_nonzero(n)), words + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [DOCS, TERMS])), pa.array(np.append(df[some], [docs, words]))], names=["term", "n"])

    return run


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    """A thousand times the logarithm of how rare each term is, rounded down."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)


def impacts(entries: dict[str, np.ndarray], n: np.ndarray, weight: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What each entry adds to the score of its document, by 64-bit integers."""
    length = np.array([75 + 25 * x * docs // max(1, words) for x in n.tolist()], dtype=np.int64)
    tf = entries["tf"]
    return weight[entries["term"]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[entries["doc"]]))


class Best:
    """The best documents of each item so far; of equal scores the smaller doc_id is better, null the worst."""

    def __init__(self, items: int, most: int):
        self.most = most
        self.lists = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, item: int, score: np.ndarray, doc_id: np.ndarray, known: np.ndarray) -> None:
        near = np.flatnonzero(score >= self.least[item])
        if len(near) > self.most:
            near = near[score[near] >= np.partition(score[near], -self.most)[-self.most]]
        if not len(near):
            return
        score, doc_id, known = (np.concatenate(pair) for pair in zip(self.lists[item], (score[near], doc_id[near], known[near])))
        order = np.lexsort((doc_id, ~known, -score))[: self.most]
        self.lists[item] = score[order], doc_id[order], known[order]
        if len(order) == self.most:
            self.least[item] = score[order[-1]]


def product(items: Items, entries: dict[str, np.ndarray], impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of all documents of the block) for each item with a term in it: rows of the term matrix merged after Gustavson."""
    edge = np.flatnonzero(np.diff(entries["term"], prepend=-1, append=-1))
    there = np.full(len(items.vocabulary), -1)
    there[entries["term"][edge[:-1]]] = np.arange(len(edge) - 1)
    doc = entries["doc"]
    for item in range(len(items.ids)):
        span = slice(items.first[item], items.first[item + 1])
        row = there[items.term[span]]
        times, row = items.times[span][row >= 0], row[row >= 0]
        if not len(row):
            continue
        score = np.zeros(n_docs, dtype=np.int64)
        for a, b, k in zip(edge[row].tolist(), edge[row + 1].tolist(), times.tolist()):
            score[doc[a:b]] += impact[a:b] * k  # a term's documents are distinct
        yield item, score


def _search(items: Items, weight: np.ndarray, docs: int, words: int, most: int):
    """Work of a task that gives the best documents of its blocks for each item."""

    def run(batches):
        best = Best(len(items.ids), most)
        for batch in batches:
            for entries, about in zip(*(batch.column(i).to_pylist() for i in range(2))):
                entries, about = ENTRIES.load([entries]), DOCUMENTS.load([about])
                impact = impacts(entries, about["n"], weight, docs, words)
                for item, score in product(items, entries, impact, len(about["n"])):
                    best.add(item, score, about["doc_id"], about["known"].astype(bool))
        size = np.array([len(x[0]) for x in best.lists], dtype=np.int64)
        if size.sum():
            score, doc_id, known = (np.concatenate(x) for x in zip(*best.lists))
            item = np.repeat(np.arange(len(size), dtype=np.int32), size)
            yield pa.RecordBatch.from_arrays([pa.array(item), items.ids.take(pa.array(item)), pa.array(doc_id, mask=~known), pa.array(score)], names=["item", "item_id", "doc_id", "score"])

    return run


def _found(docs: DataFrame, items: Items, kind: T.DataType, most: int) -> DataFrame | None:
    """The best documents of one block of items."""
    if not len(items.vocabulary):
        return None
    blocks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(items.vocabulary), "entries binary, about binary")
    blocks = materialize(blocks, "term-blocks")
    sums = blocks.mapInArrow(_sums(len(items.vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counted = dict(zip(sums["term"].tolist(), sums["n"].tolist()))
    n_docs, words = counted.pop(DOCS, 0), counted.pop(TERMS, 0)
    df = np.zeros(len(items.vocabulary), dtype=np.int64)
    df[list(counted)] = list(counted.values())
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = blocks.mapInArrow(_search(items, weights(df, n_docs), n_docs, words, most), schema)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for keys in (("item", F.pmod(F.spark_partition_id(), F.lit(PARTS))), ("item",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return found.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of each item with a score above 0.

    Equal rows of items count once, rows of one item_id with different texts are ranked apart. A repeated document is
    found as often as it is there; a null doc_id comes after all others of its score; null and wordless texts, of
    documents and of items, are never found and find nothing; empty tables give no rows; extra columns are ignored.
    Items are taken in as many products as their texts have ITEM_BYTES; each product is one pass over the documents.
    """
    small_batches(docs.sparkSession)
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", "text").where("text is not null").distinct()
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    out = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        block = Items(pa.array([r["item_id"] for r in rows], type=to_arrow_type(kind)), pa.array([r["text"] for r in rows], type=pa.string()))
        found = _found(docs, block, kind, most)
        out = out if found is None else found if part == 0 else out.union(found)
    return out
