"""Token counts of whole documents without their token ids.

Each block of documents gives, for each pre-token, the documents that have it and how often. Those rows move once,
to the pre-token's place, where the pieces of each distinct pre-token are counted and joined to them; the products
are summed by document. The join has a map-side part: the pieces of the plain words of the tokenizer's vocabulary are
counted once in each worker (a table no larger than the vocabulary), joined to the frequencies where those are made, and
move with their document's row; all other pre-tokens go through the shuffled join. A pre-token that many documents of a
block have goes to one of several places by the block, and so do the documents' own sizes: as many places as keep
``BLOCKS_A_PLACE`` blocks each. A text with a special token's string in it is left to the library as a whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import id_and_text
from cantata.llm.pretokens import pretokenizer, small_slices

BLOCKS_A_PLACE = 64
HOT_DOCS = 64
BLOCK_ROWS = 10_000
_SCHEMA = "pretoken string NOT NULL, salt int NOT NULL, doc_ids array<long>, amounts array<int>, sizes array<int>"


class _Codes(dict):
    """Pre-token to its number in the block, or to minus its pieces if that is known."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known, self.words = known, []

    def __missing__(self, word: str) -> int:
        pieces = self.known.get(word)
        if pieces:
            self[word] = -pieces
        else:
            self[word] = len(self.words)
            self.words.append(word)
        return self[word]


def _block(ids: list, texts_of, pt, salts: int) -> pa.RecordBatch:
    """The rows of one block; that for no pre-token ('') has the pieces already counted, and the documents' bytes as sizes."""
    codes, keys, base, size = _Codes(pt.known), [], [], []
    for i, text in enumerate(texts_of):
        size.append(len(text.encode("utf-8")))
        words = pt.split(text)
        if words is None:
            base.append(len(pt.ids(text)))
            continue
        code = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
        base.append(-int(code[code < 0].sum()))
        keys.append((code[code >= 0] << 16) | i)
    keys, amounts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    code, doc = keys >> 16, keys & 0xFFFF
    begins = np.searchsorted(code, np.arange(len(codes.words) + 1))
    spread = 1 + zlib.crc32(str(ids[0]).encode()) % salts
    salt = np.where(np.diff(begins) > HOT_DOCS, spread, 0)
    n = len(ids)
    offsets = np.concatenate([[0], n + begins]).astype(np.int32)
    doc = np.concatenate([np.arange(n), doc])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["", *codes.words], pa.string()),
            pa.array(np.concatenate([[spread], salt]).astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64()).take(pa.array(doc))),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([base, amounts]).astype(np.int32))),
            pa.ListArray.from_arrays(np.concatenate([[0], np.full(len(codes.words) + 1, n)]).astype(np.int32), pa.array(np.array(size, np.int32))),
        ],
        names=["pretoken", "salt", "doc_ids", "amounts", "sizes"],
    )


def frequencies(docs: DataFrame, tokenizer_path: str, salts: int) -> DataFrame:
    """(doc_id, text) to pre-token frequencies: pretoken, salt, doc_ids, amounts, sizes."""

    def blocks(batches):
        pt = pretokenizer(tokenizer_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                texts = (t for _, ts in small_slices(part) for t in ts)
                yield _block(part.column(0).to_pylist(), texts, pt, salts)

    return docs.mapInArrow(blocks, _SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each id: what the library gives for the whole text, no special tokens added.

    A null or empty text has no tokens. Rows that share an id (null is an id) count as one document: their bytes
    and tokens add up. An empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def pieces(pretokens: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in pretokenizer(tokenizer_path).ids_of_each(pretokens.tolist())], dtype="int64")

    texts = id_and_text(docs, id_col, text_col)
    salts = max(BLOCKS_A_PLACE, -(-texts.count() // (BLOCK_ROWS * BLOCKS_A_PLACE)))
    placed = frequencies(texts, tokenizer_path, salts).repartition("pretoken", "salt")
    # both sides of the join read the one exchange: nothing may filter or prune just one of them
    distinct = placed.groupBy("pretoken", "salt").agg(F.max(F.size("doc_ids") + F.size("amounts") + F.size("sizes")).alias("n"))
    counts = distinct.filter("n > 0").select("pretoken", "salt", pieces("pretoken").alias("pieces"))
    # sizes, where there are none, are filled up with nulls
    each = F.inline(F.arrays_zip("doc_ids", "amounts", "sizes"))
    entries = placed.join(counts.hint("shuffle_hash"), ["pretoken", "salt"], "left").select(F.when(F.col("pretoken") == "", 1).otherwise(F.col("pieces")).alias("pieces"), each)
    return entries.groupBy(F.col("doc_ids").alias("doc_id")).agg(
        F.sum(F.coalesce(F.col("sizes").cast("long"), F.lit(0))).alias("n_bytes"), F.sum(F.col("amounts").cast("long") * F.col("pieces")).alias("n_tokens")
    )
