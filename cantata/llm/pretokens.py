"""Pre-tokens of a tokenizer file of the ``tokenizers`` library, and the pieces of each.

A text is split as the library splits it. For files that normalise by NFC, collapsed white space and lower case
and split by ``WORDS``, texts of plain Latin characters (below U+0250, where NFC changes nothing and lower case is
character by character) take a shorter way to the same pre-tokens; the library's own normaliser and
pre-tokenizer split the others. A text with a special token's string in it is left to the library as a whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain, pairwise

import numpy as np

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ɏ]")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"  # those of lower-case plain Latin text
_PLAIN_WORDS = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class Pretokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = normal == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        self.plain = plain and steps[0]["pattern"] == {"Regex": WORDS}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens of text in normal form, in order; None if a special token's string is in it."""
        if any(s in text for s in self.specials):
            return None
        if self.plain and not _UNUSUAL.search(text):
            return _PLAIN_WORDS.findall(text.lower())
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids_of_each(self, pretokens: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]

    @functools.cached_property
    def known(self) -> dict[str, int]:
        """The number of pieces of every plain word of the vocabulary; no larger than the vocabulary is."""
        end = self.suffix
        words = [w[: len(w) - len(end)] for w in self.tokenizer.get_vocab() if w.endswith(end) and w.isascii()]
        words = [w for w in words if w and self.split(w) == [w]]
        return dict(zip(words, map(len, self.ids_of_each(words)), strict=True))


@functools.lru_cache(maxsize=2)
def pretokenizer(path: str) -> Pretokenizer:
    """One for each Python worker."""
    return Pretokenizer(path)


class PieceCache(dict):
    """Pre-token to its ids as little-endian 32-bit bytes; emptied when full, so that it never outgrows the worker."""

    def __init__(self, ids_of_each, limit: int = 1_000_000):
        super().__init__()
        self.ids_of_each, self.limit = ids_of_each, limit

    def fill(self, texts: list[list[str]]) -> None:
        """Make sure that all pre-tokens of texts are in."""
        distinct = set().union(*texts)
        missing = list(distinct.difference(self))
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = list(distinct)
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            all_ids = self.ids_of_each(part)
            ends = np.cumsum([0, *map(len, all_ids)]) * 4
            joined = np.fromiter(chain.from_iterable(all_ids), dtype="<u4", count=ends[-1] // 4).tobytes()
            self.update(zip(part, (joined[a:b] for a, b in pairwise(ends.tolist())), strict=True))


def small_slices(batch, chars: int = 2_000_000, rows: int = 1024, column: int = 1):
    """A record batch in slices of bounded text (or of one row), as lists of Python values."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    import pyarrow.compute as pc

    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > chars or i - begin >= rows):
            yield [c.to_pylist() for c in batch.slice(begin, i - begin).columns]
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield [c.to_pylist() for c in batch.slice(begin).columns]
