"""Packed exchanges: arrays of numbers travel between tasks as one binary row per (sender, bucket).

A text operator has far more anchors than documents. Sending each as a row would cost more than computing it, so a
task sorts its anchors by bucket and sends each bucket's arrays in one row; the receiver joins the arrays of a bucket
and works on them with numpy. The number of buckets follows the bytes of the input, and spark.sql.shuffle.partitions at
least, so what a task holds of a bucket stays as small as its share of the data.

Up to PARTITIONS buckets, each is a partition. Beyond, the number of partitions grows with the square root of the input:
neighbouring buckets share one, and senders pack for the partition, so that a packed row stays worth its cost and the
driver's table of shuffle blocks stays small. The receiver cuts such rows to buckets, REFINE_BYTES of them at a time, and
sorts them within the partition, so that it still works on one bucket at a time.

input | buckets (of keys: twice as many) | partitions | buckets in a partition | input of a partition
30 GB | 895 | 895 | 1 | 34 MB
1 TB | 29,803 | 4,968 | 6 | 201 MB
100 TB | 2,980,233 | 55,190 | 54 | 1.8 GB
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.tables import parallelism

ROUTED = "bucket int, kind int, data binary"
#: Stands for a null id, so ids themselves are below it.
MISSING = (1 << 63) - 1
#: Bytes of input, as the optimizer estimates it, for one bucket.
BUCKET_BYTES = 32 << 20
#: Buckets that each have a partition of their own.
PARTITIONS = 1024
#: Bytes of rows packed for a partition that are held at once while they are cut to buckets.
REFINE_BYTES = 32 << 20
#: Kind of the rows that carry a document: after the packed rows of its bucket.
DOCUMENT = 1 << 20


class Buckets(int):
    """A number of buckets, of which `width` neighbours share a partition."""

    width = 1

    @classmethod
    def of(cls, n: int, width: int = 0) -> Buckets:
        out = cls(n)
        out.width = width or max(1, math.ceil(math.sqrt(n / PARTITIONS)))
        return out


class Pack:
    """Named arrays as bytes: the length, then each array."""

    def __init__(self, **fields: str):
        self.fields = {name: np.dtype(kind) for name, kind in fields.items()}

    def dump(self, columns: dict[str, np.ndarray]) -> bytes:
        n = len(next(iter(columns.values())))
        return b"".join([n.to_bytes(8, "little"), *(np.ascontiguousarray(columns[k], dtype=t).tobytes() for k, t in self.fields.items())])

    def load(self, blobs: list[bytes]) -> dict[str, np.ndarray]:
        parts: dict[str, list] = {k: [] for k in self.fields}
        for blob in blobs:
            n, at = int.from_bytes(blob[:8], "little"), 8
            for name, kind in self.fields.items():
                parts[name].append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
                at += n * kind.itemsize
        return {k: np.concatenate(v) if v else np.zeros(0, dtype=t) for (k, v), t in zip(parts.items(), self.fields.values())}

    def split(self, columns: dict[str, np.ndarray], bucket: np.ndarray, kind: int, width: int = 1) -> list[tuple[int, int, bytes]]:
        """One (bucket, kind, data) row for each bucket that has elements; for each partition where it has several buckets.

        A row for a partition has the number -1 - its first bucket, and says what it needs to be cut: the sizes of its
        fields, and each element's bucket within the partition.
        """
        if width > 1:
            inner = Pack(_bucket="<u2", **{k: t.str for k, t in self.fields.items()})
            rows = inner.split(columns | {"_bucket": bucket % width}, bucket // width, kind)
            sizes = np.array([len(self.fields), *(t.itemsize for t in self.fields.values())], dtype="<u2").tobytes()
            return [(-1 - b * width, k, sizes + data) for b, k, data in rows]
        order = np.argsort(bucket, kind="stable")
        sorted_bucket = bucket[order]
        edges = np.flatnonzero(np.concatenate(([True], sorted_bucket[1:] != sorted_bucket[:-1]))) if len(order) else []
        columns = {k: columns[k][order] for k in self.fields}
        stops = [*edges[1:], len(order)] if len(order) else []
        return [(int(sorted_bucket[a]), kind, self.dump({k: v[a:b] for k, v in columns.items()})) for a, b in zip(edges, stops)]


def batches_of(rows: Iterable[tuple[int, int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Routed rows as record batches of a few MB, sent as they fill."""

    def batch():
        bucket, kind, data = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(bucket, type=pa.int32()), pa.array(kind, type=pa.int32()), pa.array(data, type=pa.binary())], names=["bucket", "kind", "data"])

    held, size = [], 0
    for row in rows:
        if held and size + len(row[2]) > limit:
            yield batch()
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    if held:
        yield batch()


def refined(limit: int):
    """Work of a task that cuts rows for a partition to its buckets, some `limit` bytes at a time; other rows and columns pass."""

    def cut(held: dict[int, list[tuple[int, bytes]]]):
        for kind, rows in held.items():
            n_fields = int.from_bytes(rows[0][1][:2], "little")
            sizes = np.frombuffer(rows[0][1], dtype="<u2", count=n_fields + 1)[1:].tolist()
            outer = Pack(**{f"f{i}": f"V{n}" for i, n in enumerate(sizes)})
            inner = Pack(_bucket="<u2", **{k: t.str for k, t in outer.fields.items()})
            blobs = [data[2 * (n_fields + 1) :] for _, data in rows]
            columns = inner.load(blobs)
            first = np.repeat([-1 - b for b, _ in rows], [int.from_bytes(x[:8], "little") for x in blobs])
            yield from outer.split(columns, first + columns.pop("_bucket"), kind)

    def run(batches):
        held: dict[int, list[tuple[int, bytes]]] = {}
        size, schema = 0, None

        def flush():
            for batch in batches_of(cut(held)):
                none = [pa.nulls(batch.num_rows, f.type) for f in list(schema)[3:]]
                yield pa.RecordBatch.from_arrays([*batch.columns, *none], schema=schema)
            held.clear()

        for batch in batches:
            schema, whole = batch.schema, batch.column(0).to_numpy() < 0
            if not whole.any():
                yield batch
                continue
            yield batch.filter(pa.array(~whole))
            packed = batch.select([0, 1, 2]).filter(pa.array(whole))
            for bucket, kind, data in zip(*(packed.column(i).to_pylist() for i in range(3))):
                held.setdefault(kind, []).append((bucket, data))
                size += len(data)
                if size > limit:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def buckets(docs: DataFrame, times: int = 1) -> Buckets:
    """Few times the shuffle partitions, more for a larger input: a task's packed rows are as many as the buckets it writes to."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    # A source that does not know its size gives the largest number.
    size = sum(x for x in map(int, sizes) if x < 1 << 60)
    return Buckets.of(times * max(parallelism(docs.sparkSession), -(-size // BUCKET_BYTES)))


def document_bucket(did: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    """The bucket a document's row is in: the same sum as in keyed()."""
    return ((did % n + th % n) % n).astype(np.int32)


def text_hash() -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame, n: int, *more: str) -> DataFrame:
    """bucket, doc_id, did, th, text and more columns: did stands for a null id as the largest number; th tells rows of one id apart by text."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), did.alias("did"), text_hash().alias("th"), "text", *more)
    return rows.select(((F.pmod("did", F.lit(n)) + F.pmod("th", F.lit(n))) % n).cast("int").alias("bucket"), "doc_id", "did", "th", "text", *more)


def _dealt(rows: DataFrame, n: Buckets) -> DataFrame:
    """Rows of one bucket in one partition; adaptive execution joins small partitions."""
    least, key = parallelism(rows.sparkSession), "bucket"
    if n.width > 1:
        key = (F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")) / n.width).cast("int")
    parts = -(-n // n.width)
    dealt = rows.repartition(parts, key) if parts > least else rows.repartition(key)
    return dealt.mapInArrow(refined(REFINE_BYTES), rows.schema) if n.width > 1 else dealt


def by_bucket(routed: DataFrame, n: Buckets, work: Callable[[dict[int, list[bytes]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Bring the rows of each of n buckets together and run work on {kind: blobs} of one bucket at a time; it gives routed rows."""

    def run(batches):
        now, got = None, {}
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now:
                    if now is not None:
                        yield from batches_of(work(got))
                    now, got = bucket, {}
                got.setdefault(kind, []).append(data)
        if now is not None:
            yield from batches_of(work(got))

    return _dealt(routed, n).sortWithinPartitions("bucket").mapInArrow(run, ROUTED)


def with_documents(rows: DataFrame, routed: DataFrame, n: Buckets, prepare: Callable[[dict[int, list[bytes]]], object], work: Callable[[pa.RecordBatch, object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring keyed() documents and routed rows of each of n buckets together.

    prepare gets {kind: blobs} of a bucket, then work its documents with what prepare made, a batch at a time: a bucket's
    texts are never held at once.
    """
    names = [c for c in rows.columns if c != "bucket"]
    texts = rows.select("bucket", F.lit(DOCUMENT).alias("kind"), F.lit(None).cast("binary").alias("data"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("document"))
    notes = routed.select("bucket", "kind", "data", F.lit(None).cast(texts.schema["document"].dataType).alias("document"))

    def run(batches):
        now, got, ready = None, {}, None
        for batch in batches:
            bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
                if bucket[a] != now:
                    now, got, ready = bucket[a], {}, None
                first = a + int(np.searchsorted(kind[a:b], DOCUMENT))
                for k, data in zip(kind[a:first].tolist(), batch.column(2).slice(a, first - a).to_pylist()):
                    got.setdefault(k, []).append(data)
                if first == b:
                    continue
                if ready is None:
                    ready, got = (prepare(got),), {}
                yield from work(pa.RecordBatch.from_struct_array(batch.column(3).slice(first, b - first)), ready[0])

    return _dealt(notes.union(texts), n).sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def hot_keys(rows: DataFrame, contexts: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], hot: int, share: int, most: int = 1 << 17) -> np.ndarray:
    """Keys that probably have more than `hot` different contexts, `most` at most: those that often occur in one text of `share`.

    contexts gives (key, digest) arrays of a column of texts. The list steers which way keys are met; any list gives the
    same result. What it misses is found, and met the same way, where the contexts of a key come together.
    """

    def count(batches):
        for batch in batches:
            for key, digest in contexts(batch.column(0)):
                order = np.lexsort((digest, key))
                key, digest = key[order], digest[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
                value, n = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["key", "n"])

    some = rows.where((F.pmod("th", F.lit(share)) == 0) & F.col("text").isNotNull()).select("text")
    counted = some.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") > hot / share).orderBy(F.desc("n"), "key").limit(most).select("key")
    return np.sort(np.array([r["key"] for r in top.collect()], dtype=np.int64).view(np.uint64))


def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted list."""
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values if len(listed) else np.zeros(len(values), dtype=bool)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that start at first and have size numbers, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def by_document(did: np.ndarray, th: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Element numbers for each (did, th)."""
    order = np.lexsort((th, did))
    if not len(order):
        return {}
    a, b = did[order], th[order]
    edges = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return {(int(a[s]), int(b[s])): order[s:e] for s, e in zip(edges, [*edges[1:], len(order)])}
