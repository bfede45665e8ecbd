"""How the operators read their tables and size their Python batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound what one Arrow batch of texts may hold in a Python worker; a caller's own setting stays.

    The plans that need the bound run after the operator has returned, so it holds for the rest of the session.
    """
    for key, value in ((BATCH_ROWS, str(rows)), (BATCH_BYTES, size)):
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as the struct rest, by position: whatever the names are, they meet no others."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    others = [v for k, v in names.items() if k != "text"]
    return plain.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"), F.struct(*others).alias("rest"))


def together(names: list[str], text: pa.Array, rest: pa.StructArray) -> dict[str, pa.Array]:
    """The columns that apart() took apart, in their order."""
    others = iter(rest.flatten())
    return {c: text if c == "text" else next(others) for c in names}


def bounded_sample(rows: DataFrame, group: str, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group of the column `group`, which has few values: those whose keys have the smallest hashes.

    Rows of equal keys count once. Hashes above a share that leaves some four times as many are dropped where they are
    read, and equal ones are combined there, so what meets in one task follows `most` and not the table.
    """
    rows = rows.withColumn("__h", F.xxhash64(*keys))
    kinds = F.greatest(F.approx_count_distinct("__h"), F.lit(1))
    share = rows.groupBy(group).agg((F.lit(4.0 * most) / kinds).alias("__share"))
    near = rows.join(F.broadcast(share), group).where(F.shiftrightunsigned("__h", 1) / F.lit(float(1 << 63)) <= F.col("__share"))
    others = [c for c in rows.columns if c not in (group, "__h")]
    once = near.groupBy(group, "__h").agg(*[F.first(c).alias(c) for c in others])
    order = Window.partitionBy(group).orderBy("__h")
    return once.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n", "__h")
