"""Sum-of-squares packing of token sequences.

A window holds ``capacity`` tokens. Documents come one by one; each goes on top of a partly filled window of the
level, or into a new window, for which the sum of the squares of the level counts is least afterwards. An array
holds the counts, so a document costs one pass over the levels. Documents longer than a window fill whole windows
first. Each task packs what it reads; the windows it has left open at its end are poured together, cut freely, so
that at most one window of a task is padded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cantata.llm.common import id_and_text
from cantata.llm.pretokens import PieceCache, pretokenizer, small_slices

_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class SumOfSquares:
    """Places items of 1 to capacity - 1 by the sum-of-squares rule; counts[h] windows are filled up to h."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)

    def level(self, size: int) -> int:
        """The level (0: a new window) to put an item of this size on; the counts take it in."""
        n, top = self.counts, self.capacity - size
        n[self.capacity] = 0
        # of the change in the sum of squares: a window leaves level h for level h + size; full windows don't count
        change = 2 * (n[size + 1 : self.capacity + 1] - n[1 : top + 1]) + 2
        change[-1] -= 1
        change[n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        level = best + 1 if change[best] <= 2 * n[size] + 1 else 0
        if level:
            n[level] -= 1
        if level + size < self.capacity:
            n[level + size] += 1
        return level


class Packer:
    """Packs pieces (doc_id, start, length, payload) into numbered windows."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.rule, self.open = SumOfSquares(capacity), defaultdict(list)  # windows by level: lists of pieces

    def _close(self, pieces: list) -> list:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next_id, at))
            at += p[2]
        self.next_id += 1
        return out

    def add(self, doc, n_tokens: int) -> list:
        """Pieces (doc, start, length, sequence_id, offset) of the windows that this document has filled."""
        done, whole = [], n_tokens - n_tokens % self.capacity
        for start in range(0, whole, self.capacity):
            done += self._close([(doc, start, self.capacity)])
        if size := n_tokens - whole:
            level = self.rule.level(size)
            window = [*(self.open[level].pop() if level else ()), (doc, whole, size)]
            if level + size == self.capacity:
                done += self._close(window)
            else:
                self.open[level + size].append(window)
        return done

    def finish(self) -> list:
        done, window, filled = [], [], 0
        for level in sorted(self.open, reverse=True):
            for doc, start, length in (p for w in self.open[level] for p in w):
                while length:
                    part = min(length, self.capacity - filled)
                    window.append((doc, start, part))
                    start, length, filled = start + part, length - part, filled + part
                    if filled == self.capacity:
                        done += self._close(window)
                        window, filled = [], 0
        self.open.clear()
        return done + (self._close(window) if window else [])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is the ids of its whole text, then ``end_id``; so a null or empty text is one token. Each row of
    docs is a document of its own, repeated and null ids included. Every id is in exactly one piece. Sequences are
    gapless from 0 and full but for the last of each task. An empty table gives an empty result.
    """

    def run(batches):
        from pyspark import TaskContext

        pt = pretokenizer(tokenizer_path)
        cache, end = PieceCache(pt.ids_of_each), np.asarray([end_id], dtype="<u4").tobytes()
        packer, waiting = Packer(capacity, TaskContext.get().partitionId() << 40), {}

        def rows(pieces):
            out = []
            for key, start, length, sequence, offset in pieces:
                doc, ids, first, left, total = waiting[key]
                part = ids[4 * (start - first) : 4 * (start - first + length)]
                out.append((doc, start, length, zlib.crc32(part), total, sequence, offset, part))
                waiting[key] = (doc, ids, first, left - length, total)
                if left == length:
                    del waiting[key]
            return _table(out, with_ids)

        def forget(keys):
            """Of documents that wait, only the rest that isn't placed yet is kept."""
            for key in keys:
                if key in waiting:
                    doc, ids, _, left, total = waiting[key]
                    waiting[key] = (doc, ids[len(ids) - 4 * left :], total - left, left, total)

        number = 0
        for batch in batches:
            for doc_ids, texts in small_slices(batch):
                words = [pt.split(t) for t in texts]
                cache.fill([w for w in words if w is not None])
                done = []
                for doc, text, split in zip(doc_ids, texts, words, strict=True):
                    ids = (np.asarray(pt.ids(text), dtype="<u4").tobytes() if split is None else b"".join(map(cache.__getitem__, split))) + end
                    n = len(ids) // 4
                    waiting[number] = (doc, ids, 0, n, n)
                    done += packer.add(number, n)
                    number += 1
                if done:
                    yield rows(done)
                    forget(range(number - len(texts), number))
        if done := packer.finish():
            yield rows(done)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema + ", ids array<long>" * with_ids)


def _table(rows: list, with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    if with_ids:
        arrays.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in columns[7]], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, names=[*_FIELDS, *["ids"] * with_ids])
