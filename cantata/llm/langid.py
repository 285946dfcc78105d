"""Language identification by Bloom filters whose slots are bit masks of languages.

Every language has a Bloom filter of its characteristic character n-grams. The filters are bit-sliced: slot s holds
a mask with bit l set where language l's filter has bit s set, so the AND of an n-gram's slots gives all languages
that contain it at once. A text's n-grams are counted per mask, and per language by its bit; counts are corrected
for the filter's false positives, and the largest decides.

Fitting reads a sample of the labelled documents, by hash, of about ``max_docs`` a language. An n-gram is
characteristic of a language if it is among its ``grams`` most frequent ones and at least a quarter as frequent there
as in the language where it is most frequent. The model is 2**SLOT_BITS masks, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import id_and_text, trained_on
from cantata.llm.pretokens import small_slices

ORDERS = (2, 3, 4)
SLOT_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HASHES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_CHUNK = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point: is it a letter? Made once in each Python worker."""
    if not hasattr(_letters, "table"):
        _letters.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters.table


def _characters(text: str) -> np.ndarray:
    """The lower-case text's letters, all else as spaces."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(_letters()[c], c, 32).astype(np.uint64)


def _grams(text: str):
    """Yield the 64-bit codes of all n-grams with a letter in them (one space is put at either end), a chunk at a time."""
    text, before = f" {text.lower()} ", max(ORDERS) - 1
    for begin in range(0, len(text), _CHUNK):
        first = max(0, begin - before)
        c = _characters(text[first : begin + _CHUNK])
        for n in ORDERS:
            part = c[max(0, begin - n + 1) - first :]
            if len(part) < n:
                continue
            code = part[: len(part) - n + 1].copy()
            blank = code == 32
            for k in range(1, n):
                nxt = part[k : len(part) - n + 1 + k]
                code *= _MIX
                code += nxt
                blank &= nxt == 32
            yield code[~blank] if blank.any() else code


def _slots(code: np.ndarray) -> list[np.ndarray]:
    return [((code ^ (code >> np.uint64(31))) * h) >> np.uint64(64 - SLOT_BITS) for h in _HASHES]


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # 2**SLOT_BITS masks of languages; a row for each 64 of these
    false_positive: np.ndarray  # for each language, the chance that an absent n-gram seems to be in

    def scores(self, text: str | None) -> np.ndarray:
        """For each language, the share of the text's n-grams that it contains, corrected for false positives."""
        n = 0
        hits = np.zeros(len(self.languages))
        for code in _grams(text or ""):
            a, b = _slots(code)
            n += len(a)
            for word, masks in enumerate(self.masks):
                found = masks[a] & masks[b]
                if found.dtype == np.uint8:
                    kinds, values = np.bincount(found, minlength=256), np.arange(256)
                else:
                    values, kinds = np.unique(found, return_counts=True)
                for i in range(64 * word, min(64 * (word + 1), len(hits))):
                    hits[i] += kinds[(values >> values.dtype.type(i % 64)) & values.dtype.type(1) == 1].sum()
        if not n:
            return hits
        return np.clip((hits - n * self.false_positive) / (n * (1 - self.false_positive)), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (its part of the languages' corrected shares), coverage (its own corrected share)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        s = self.scores(text)
        best, total = int(s.argmax()), float(s.sum())
        return (self.languages[best], float(s[best]) / total, float(s[best])) if total else (self.languages[best], 0.0, 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 2000, grams: int = 20_000) -> LanguageFilters:
    """Learn from docs with a language (those that the caller lets in). A language takes a bit of each mask, whatever their number."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r["lang"] for r in per_lang.select("lang").collect())  # a name for each language
    if not languages:
        return LanguageFilters([], np.zeros((0, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    # rows without an id, or with a common one, are told apart by their text
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.least(F.lit(1.0), max_docs / F.col("n")) * (1 << 20)
    sample = labelled.join(F.broadcast(per_lang), "lang").filter(drawn).select("lang", "text")

    def count(batches):
        for batch in batches:
            for langs, texts in small_slices(batch):
                for lang in set(langs):
                    codes = [g for x, t in zip(langs, texts, strict=True) if x == lang for g in _grams(t)]
                    code, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.uint64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    shared = shared.withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    top = shared.filter("share * 4 >= most").withColumn("rank", rank).filter(F.col("rank") <= grams).select("lang", "gram").toPandas()  # grams a language at most

    kind = np.uint8 if len(languages) <= 8 else np.uint64
    masks, false_positive = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), kind), np.zeros(len(languages))
    for i, lang in enumerate(languages):
        code, bit = top["gram"][top["lang"] == lang].to_numpy(dtype=np.int64).view(np.uint64), kind(i % 64)
        for slots in _slots(code):
            masks[i // 64][slots] |= kind(1) << bit
        false_positive[i] = ((masks[i // 64] >> bit) & kind(1)).mean() ** len(_HASHES)
    return LanguageFilters(languages, masks, false_positive)


def identify(docs: DataFrame, model: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, coverage (the last two within 0 and 1).

    A text that is null, empty or without a letter is 'und' with score 0; so is every text if there was nothing to
    learn from. Of languages with equal counts the first by name is taken. Each row, repeated and null ids included, is
    judged by its own text. An empty table gives an empty result. A long text is read a chunk of 2**20 characters at a
    time, beside its lower-case copy.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            for ids, texts in small_slices(batch):
                found = [shipped.value.predict(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score", "coverage"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, coverage double")


def fit_on_training_part(docs: DataFrame, **options) -> LanguageFilters:
    return fit(docs.filter(trained_on()), **options)
