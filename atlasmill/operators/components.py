"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.session import discard, materialize, scratch_path, stored

#: Edges up to which the rest of the work is done in one task instead of more rounds.
SMALL = 1 << 20


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest id the node knows.

    The minimum is an aggregate with map-side combine and the join key is unique on one side, so a hub with
    a third of all edges is split by adaptive execution instead of meeting in one task.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    out = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node itself, on the smallest of them. Edges are (larger, smaller)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _finish(edges: DataFrame, schema: str) -> DataFrame:
    """Components of at most SMALL edges, by union-find over them in one task."""

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        ends = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks])
        names = ends.unique().sort()
        u, v = (pc.index_in(table.column(i), names).to_pylist() for i in range(2))
        up = list(range(len(names)))
        for a, b in zip(u, v):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            up[max(a, b)] = min(a, b)
        for i, parent in enumerate(up):
            up[i] = up[parent]
        yield from pa.table({"node": names, "component": names.take(pa.array(up, type=pa.int64()))}).to_batches(max_chunksize=1 << 16)

    return edges.coalesce(1).mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Works for any orderable id type. Null ends and self loops are ignored (a node with only a self loop has no
    row; callers label such nodes themselves); repeated edges count once; an empty edge list gives no rows.
    Each round is one job whose result is written to the shared folder, so a lost executor costs one round.
    The number of rounds grows with the logarithm of the longest chain. As soon as no more than `small` edges are
    left, one task does the rest; with small = 0 only built-in functions are used.
    """
    spark = edges.sparkSession
    start = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    at = scratch_path(spark, "edges")
    now = stored(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), at)
    seen = _fingerprint(now)
    for _ in range(max_rounds if seen[0] else 1):
        if seen[0] <= small:
            if not seen[0]:
                break
            kind = now.schema["u"].dataType.simpleString()
            out = materialize(_finish(now, f"node {kind}, component {kind}"), "components")
            discard(spark, at)
            return out
        before, at = at, scratch_path(spark, "edges")
        now = stored(_small_star(_large_star(now)), at)
        discard(spark, before)
        then, seen = seen, _fingerprint(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
