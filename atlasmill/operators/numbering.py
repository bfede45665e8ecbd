"""One number for each row in a given order, without bringing all rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.session import materialize


def numbered(df: DataFrame, keys: list, name: str, start: int = 0, what: str = "numbered") -> DataFrame:
    """df with the column `name`: start, start + 1, ... in the order of keys, which should tell rows apart.

    Ranges of the keys are sorted apart and written; their counts, one number a partition, then move each range's own
    numbers on. A hot range of keys is split by Spark's sample of them; rows equal in all keys are numbered in any order.
    """
    spark = df.sparkSession
    ranged = df.drop(name).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumn(name, F.monotonically_increasing_id()), what)
    part, inside = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    first, rows = start, []
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        rows.append((row["part"], first))
        first += row["count"]
    starts = spark.createDataFrame(rows, "_part long, _first long")
    moved = placed.join(F.broadcast(starts), part == F.col("_part"))
    return moved.withColumn(name, inside + F.col("_first")).select(*[F.col(f"`{c}`") for c in placed.columns])
