"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes that as Parquet in the cluster's
shared folder and the next stage reads it from there. A stage decides on each row by its id and text (see row_key), so
that rows that share an id alone, or have none, are not kept or dropped together. A document with a null text is dropped
by the first stage, as one without a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.llm import exact_dedup, langid, packing, simhash, toxicity
from cantata.llm.common import read, remove, row_key, scratch, shared_path, tokenizer_file

#: Toxicity scores from here on are rejected.
TOXIC_FROM = 0.3
#: The pipeline's near duplicates: shingles of five words, four fifths of them shared.
SHINGLE, SIMILAR = 5, 0.8


def _key(docs: DataFrame) -> str:
    """A name for the key of a row that no column of docs has."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each row."""
    return docs.withColumn(_key(docs), row_key())


def _without(docs: DataFrame, rejected: DataFrame, and_key: bool = False) -> DataFrame:
    """docs but for the rows whose keys (row) are rejected."""
    key = _key(docs)
    gone = rejected.select(F.col("row").alias(key))
    return _keyed(docs).join(gone, key, "left_anti").select(*docs.columns, *[key] * and_key)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those of which no language's filter has a quarter of the n-grams."""
    found = langid.identify(_keyed(docs), langid.fit_on_training_part(docs), id_col=_key(docs))
    return _without(docs, found.filter("lang_pred = 'und' OR coverage < 0.25").withColumnRenamed("doc_id", "row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score TOXIC_FROM or more; a null or empty text scores as one without any known word."""
    model = toxicity.fit_on_training_part(docs, read(spark, sf_dir, "labels"))
    found = toxicity.score(_keyed(docs), model, id_col=_key(docs))
    return _without(docs, found.filter(F.col("score") >= TOXIC_FROM).withColumnRenamed("doc_id", "row"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts equal but for white space one row stays: the longest, then that of the smallest id."""
    left = _without(docs, exact_dedup.exact_duplicates(docs, with_row=True).filter("NOT kept"), and_key=True)
    return left.dropDuplicates([_key(docs), "doc_id", "text"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays (of texts that share it, one)."""
    found = simhash.near_duplicates(docs, SHINGLE, min_similarity=SIMILAR)
    return _without(docs, found.filter("row <> component_row"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of what is left, in sequences of 2048; a row for each piece of a document."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2048, end_id=1)


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: Learned models and tokenisation are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written, and what it has checkpointed, is removed; the last one's table stays."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
