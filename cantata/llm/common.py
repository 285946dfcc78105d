"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of every row; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A key of (doc_id, text) as id_and_text gives them: rows that repeat both are one document."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only on a local master, as in tests, a folder of this machine will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "cantata-checkpoints"))


#: Tells Spark to remove a query's shuffle files when it ends, not when the driver's collector finds that nobody refers to them.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Checkpoint files made since the last scratch began, innermost last.
_made: list[list[str]] = [[]]


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back from there; the shuffle files behind it go at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        out = df.select("*").checkpoint()  # a query of its own, which is planned with the setting
    finally:
        spark.conf.set(_CLEAN_UP, before)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _made[-1].append(file.get())
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is checkpointed inside is removed at its end, by when its results must have been written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def trained_on(id_col="doc_id"):
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 != 2


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; each worker opens it there, as it is installed on every node."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
