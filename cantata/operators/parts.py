"""How many parts a step has: by the work that there is, where bytes alone would tell too little."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one part, of tables whose rows are small.
ROWS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores at least: few bytes, in one file, may still be much work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def parts_for(df: DataFrame, rows: int = ROWS) -> int:
    """Parts of so many rows, and as many as Spark is told at least: what one holds doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
