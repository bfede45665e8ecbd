"""Mixing sources to target weights: how often a training mix takes each document.

A source's target is its share of all words by weight, and `most` times its own words at most. Every document has a hash
that is the same on every run. A source takes all its documents as often as its words fit the target whole, and those
with a hash up to a threshold once more. The threshold comes from histograms of words by source and hash bucket: the
bucket that the budget ends in is cut into finer buckets, until it holds one hash. Nothing is sorted, and thresholds
are nested: a source's smaller budget takes a part of what its larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.llm.tables import parallelism
from atlasmill.session import materialize

#: Bits of a document's hash, and those that one round of histograms looks at.
HASH_BITS, BITS = 60, 12
#: Rows of a table of sources up to which it is broadcast; beyond, documents meet it in a shuffled join of SALTS parts a source.
BROADCAST_SOURCES = 50_000
SALTS = 32
#: Partitions that sources are ranked in at most.
RANKED_IN = 64
KEY = ["absent", "name"]


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the source as absent and name (never null), size in words and hash h of each document, and more columns."""
    text = F.coalesce("text", F.lit(""))
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("absent"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.conv(F.left(F.md5(identity), F.lit(HASH_BITS // 4)), 16, 10).cast("long").alias("h"), *more,
    )


def _exact(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _ranked(light: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources with source_size and weight; weights repeat in the order of names, the null source last.

    Ranges of names are numbered apart, then moved by the counts of the ranges before: a number for each of RANKED_IN
    ranges reaches the driver.
    """
    total = light.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    spread = total.repartitionByRange(min(RANKED_IN, parallelism(light.sparkSession)), *KEY).sortWithinPartitions(*KEY)
    placed = materialize(spread.withColumn("place", F.monotonically_increasing_id()), "sources")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, starts = 0, {}
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts[row["part"]] = before
        before += row["count"]
    first = F.get(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts, default=0) + 1)]), part.cast("int"))
    kind = F.get(F.array(*[F.lit(w) for w in weights]), ((inside + first) % len(weights)).cast("int"))
    return materialize(placed.select(*KEY, "source_size", kind.cast("long").alias("weight")), "weights")


def _targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Add target: share of all words by weight, with what is above most times a source's words reshared until none is above.

    Each round is one row of sums over the sources. It is Newton's method on the words that a level per unit of weight
    hands out, which is concave in the level: the level only rises, and rounds end when it takes no further source.
    """
    size, weight = F.col("source_size").cast("decimal(18,0)"), F.col("weight").cast("decimal(18,0)")
    row = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    total, weights = round(share * row["t"]) if share != 1 else row["t"], row["w"]
    budget, rest, full = total, weights, -1
    while rest:
        above = size * F.lit(str(most * rest)).cast("decimal(19,0)") < weight * F.lit(str(budget)).cast("decimal(19,0)")
        row = sources.where(above).agg(F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
        if row["n"] == full:
            break
        full, budget, rest = row["n"], total - most * row["t"], weights - row["w"]
    limit = F.col("source_size") * float(most)
    by_weight = F.lit(float(budget)) * F.col("weight") / F.lit(float(rest)) if rest else limit
    return sources.withColumn("target", F.least(limit, by_weight))


def _meet(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Documents joined with a table that has one row a source: broadcast after a count, else each source in SALTS parts."""
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), KEY, how)
    parts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(parts, [*KEY, "salt"], how).drop("salt")


def _cuts(light: DataFrame, plan: DataFrame) -> DataFrame:
    """absent, name, cut: documents with a hash up to cut come nearest to the budget of their source.

    Each round holds a histogram of 2^BITS buckets a source, of documents in the bucket that the budget ended in only.
    """
    now, need, done = light, plan.select(*KEY, "budget"), None
    for used in range(BITS, HASH_BITS + 1, BITS):
        bucket = F.shiftright("h", HASH_BITS - used)
        histogram = now.groupBy(*KEY, bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        summed = histogram.withColumn("upto", F.sum("n").over(Window.partitionBy(*KEY).orderBy("bucket")))
        edge = summed.join(need, KEY).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
        edge = materialize(edge.select(*KEY, "bucket", "n", "low", "high", (F.col("budget") - (F.col("upto") - F.col("n"))).alias("budget")), "edges")
        nearer = F.col("n") - F.col("budget") < F.col("budget")
        cut = edge.where("low = high").select(*KEY, F.when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("cut"))
        done = cut if done is None else done.union(cut)
        wide = edge.where("low < high")
        if wide.isEmpty():
            break
        need = wide.select(*KEY, "budget")
        now = materialize(_meet(now, wide.select(*KEY, F.col("bucket").alias("at"))).where(bucket == F.col("at")).drop("at"), "boundary")
    return done


def mixing_plan(light: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """One row a source of sized() documents: absent, name, source_size, weight, target, whole, cut.

    A document is taken `whole` times, and once more where its h is at most cut (null: never). The words taken differ from
    the target by half the document that the budget ends in at most (half of all rows with its hash, where rows repeat).
    """
    plan = _targets(_ranked(light, weights), share, most)
    words = F.col("source_size") > 0
    plan = plan.withColumn("whole", F.when(words, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    return materialize(plan.join(_cuts(light, plan), KEY, "left").drop("budget"), "mixing-plan")


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and taken (words, repeats counted) to sized() documents."""
    more = F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)).cast("long")
    met = _meet(rows, plan)
    return met.withColumn("taken", F.col("size") * (F.col("whole") + more)).drop("absent", "name", "h", "weight", "whole", "cut")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Every document with size, source_size, target and taken, and all its columns, whatever their names, in the struct row.

    Null and wordless texts have size 0 and are never counted as taken; a null source is a source of its own, the last; of
    sources with equal weights none is preferred; rows equal in id and text are taken alike; an empty table gives no rows.
    """
    plan = mixing_plan(materialize(sized(docs), "sizes"), weights, share, most)
    return apply_plan(sized(docs, F.struct("*").alias("row")), plan)


def mix_digests(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, from one scan of the texts; else as mixed()."""
    light = materialize(sized(docs), "sizes")
    return apply_plan(light, mixing_plan(light, weights, share, most)).select("doc_id", "size", "source_size", "target", "taken")
