"""Exact deduplication that survives a group of copies of any size.

Equal means: the same code points once ASCII white space is deleted. Three stages, each grouping by the whole
content and not by its digest alone:

1. locally: the partial aggregate of stage 2 keeps one row for each content of a map task;
2. salted: the copies of a content meet in at most ``salts`` places, none of which sees more than its share;
3. globally: at most ``salts`` winners of each content meet.

Rows then find their class by (digest, salt), so the way back is spread out as well. Should two contents ever
share a SHA-256, the job stops instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import id_and_text, row_key

WHITE_SPACE = " \t\n\x0b\x0c\r"
SALTS = 64


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def _precedence() -> Column:
    """Greater is better: more code points in the original text, then the smaller id; a null id comes last."""
    return F.expr("CAST(n_chars AS DECIMAL(38,0)) * 18446744073709551616BD - CAST(coalesce(doc_id, 9223372036854775807) AS DECIMAL(38,0))")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, with_row: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty and blank texts are one group. Rows that repeat both id and text are the
    same document: each counts in group_size and they share ``kept``. An empty table gives an empty result.
    with_row adds row (see row_key), and of texts of equal precedence (one id, or none, and one length) keeps one only.
    """
    if not 1 <= salts <= 64:
        raise ValueError("salts must be within 1 and 64")
    rows = (
        id_and_text(docs, id_col, text_col)
        .select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
            normalised(F.col("text")).alias("content"),
            *([row_key().alias("row")] if with_row else []),
        )
        .withColumn("digest", F.sha2("content", 256))
        .withColumn("precedence", _precedence())
    )
    if with_row:  # below 2^95 before, so that 31 bits more fit
        rows = rows.withColumn("precedence", F.expr("CAST(precedence * 2147483648BD + (row & 2147483647L) AS DECIMAL(38,0))"))
    row = ["row"] if with_row else []
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.max_by("doc_id", "precedence").alias("keep_id"), F.max("precedence").alias("best"), F.count(F.lit(1)).alias("n")
    )
    contents = salted.groupBy("digest", "content").agg(
        F.max_by("keep_id", "best").alias("keep_id"),
        F.max("best").alias("best"),
        F.sum("n").alias("n"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    classes = contents.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"),
        F.max_by("keep_id", "best").alias("keep_id"),
        F.max("best").alias("best"),
        F.max("n").alias("group_size"),
        F.bit_or("salts").alias("salts"),
    )
    distinct_only = F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share a SHA-256")).cast("long"))
    places = classes.select(
        "digest",
        F.explode(F.expr(f"filter(sequence(0, {salts - 1}), i -> getbit(salts, i) = 1)")).alias("salt"),
        F.coalesce(distinct_only, "group_size").alias("group_size"),
        "keep_id",
        "best",
    )
    return (
        rows.select("doc_id", "digest", "salt", "precedence", *row)
        .join(places, ["digest", "salt"])
        .select(
            "doc_id", "keep_id", "group_size", (F.col("precedence") == F.col("best")).alias("kept"), F.col("digest").alias("text_sha256"), *row
        )
    )
