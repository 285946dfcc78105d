"""Collocations: phrases of two or three words, scored by their weakest cut, counted by minimal perfect hashes.

The texts are read three times. Words are counted, by language; those of ``least`` occurrences are frequent, and their slots in a
minimal perfect hash (in blocks of keys by hash, levels of bits: a key is at the first level where no other key shares its bit, its
slot is that bit's rank; beside every slot the second key it belongs to, so that other words are told apart) are their numbers. Then
phrases whose words are all frequent are counted by hash, in as many slots as keep collisions rare, as sorted sparse arrays; a phrase
in a slot of fewer than ``least`` can't be a candidate. What is left is candidates safe by Apriori: a third word only where both pairs
are safe too. In the last reading every task sums up its candidates, as numbers of words, and hands them on by block; a
task that has a block lays a minimal perfect hash over its phrases and counts slots with numpy's bincount. Cuts are read by the words'
numbers; texts are put back only for what may be among the first.

What is broadcast: bitmaps (of words of fixed size; of safe phrases by their number, 128 MB at most: a bitmap may let more through than need
be, never less) and the hash of the frequent words. However many phrases there are, the texts aren't read again for them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed

LEAST, CONTAINED, TOP = 10, 50, 2000
#: Phrases of a block, which are counted together.
ROUND_KEYS = 1 << 14
#: Keys of a block of the words' hash, and bits a key at each level.
BLOCK_KEYS, GAMMA = 8192, 2
#: Log2 of bits of a bitmap at least and at most, and its bits a key between; of bits of its pieces.
BITMAP, MOST_BITS, BITS_A_KEY, BITMAP_PIECE = 26, 30, 16, 20
#: Blocks of a language's words; entries of a part of the sparse counts; words and phrases that a task holds.
WORD_BLOCKS, PART_ENTRIES, HELD, HELD_PHRASES = 512, 2_000_000, 250_000, 1 << 20
#: Words of a step of numpy work, and bytes that a word is taken to have.
STEP, WORD_BYTES = 1 << 19, 6
UNKNOWN = "und"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """A language's words to their numbers; 0 ends a piece, -1 is none. The lists are shared by all languages of a task."""

    def __init__(self, lang: str, held: list[tuple[str, bytes]]):
        super().__init__({b"\n": 0, b"": -1})
        self.lang, self.held = lang, held

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.held)
        self.held.append((self.lang, word))
        return found


def _hash(held: list[tuple[str, bytes]], seed: int) -> np.ndarray:
    """A hash of each (language, word); 0 for the end of a piece, so that words never follow each other across it."""
    import xxhash

    found = np.fromiter((xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + w, seed) for lang, w in held), np.uint64, len(held))
    found[:1] = 0
    return found


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of what two hashes stand for, in this order."""
    z = (x ^ (x >> np.uint64(29))) * _A + y * _B
    z = (z ^ (z >> np.uint64(32))) * _C
    return z ^ (z >> np.uint64(29))


def _codes(texts: list[bytes], numbers: _Words) -> np.ndarray:
    """The words of texts of a language, in order, as numbers; a piece's end is one, too."""
    joined = (b"\n".join(texts) + b"\n").translate(_TABLE).replace(b"\n", b" \n ")
    each = pc.split_pattern(pa.array([joined], pa.large_binary()), " ").flatten().dictionary_encode()
    words = _spaced(each.dictionary, [0, len(each.dictionary)])[0].as_buffer().to_pybytes().split(b" ")
    found = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))[each.indices.to_numpy()]
    return found[found >= 0]


def _spaced(words: pa.Array, ends) -> pa.Array:
    """Words joined by spaces, those from each end to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.cast(pa.binary())), b" ")


def _coded(batches, held_limit: int = HELD):
    """(text, lang) batches to (held, codes), a step at a time: codes are numbers of words, in order, 0 between pieces.

    held grows from step to step; None after a step says that it begins anew.
    """
    held, by_lang, waiting, size = [("", b"")], {}, {}, 0

    def coded():
        return held, np.concatenate([_codes(texts, by_lang.setdefault(lang, _Words(lang, held))) for lang, texts in waiting.items()])

    for batch in batches:
        for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            text = text.as_buffer().to_pybytes()
            waiting.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= WORD_BYTES * STEP:
                yield coded()
                waiting, size = {}, 0
                if len(held) > held_limit:
                    yield None
                    held, by_lang = [("", b"")], {}
    if waiting:
        yield coded()
    yield None


def _packed(longs: np.ndarray) -> bytes:
    """Byte by byte: high ones are mostly zero, which compresses."""
    return np.ascontiguousarray(longs.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their n."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[begins], np.add.reduceat(n[order], begins) if len(begins) else n[:0]


def count_words(texts: DataFrame, least: int) -> DataFrame:
    """(text, lang) to lang, word, n of the words of least occurrences, and beside them rows without a word, whose n come to the language's words."""

    def run(batches):
        n = np.zeros(0, np.int64)
        for step in _coded(batches):
            if step is not None:
                held, codes = step
                n = np.pad(n, (0, len(held) - len(n))) + np.bincount(codes, minlength=len(held))
                continue
            if len(n) > 1:
                lang = pa.array([x for x, _ in held[1:]], pa.string()).dictionary_encode()
                block = np.fromiter((zlib.crc32(w) for _, w in held[1:]), np.int64, len(held) - 1) % WORD_BLOCKS
                group = lang.indices.to_numpy().astype(np.int64) * WORD_BLOCKS + block
                order = np.argsort(group)
                begins = np.flatnonzero(np.diff(group[order], prepend=-1))
                ends = np.append(begins, len(order))
                words, own, at = pa.array([held[i + 1][1] for i in order], pa.binary()), n[1:][order], group[order][begins]
                counts = pa.array([_packed(own[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(at // WORD_BLOCKS)), pa.array(at % WORD_BLOCKS), _spaced(words, ends), counts], names=["lang", "block", "words", "counts"])
            n = np.zeros(0, np.int64)

    def total(table: pa.Table) -> pa.Table:
        each = pc.split_pattern(table["words"].combine_chunks().cast(pa.large_binary()), " ").flatten().dictionary_encode()
        n = np.bincount(each.indices.to_numpy(), weights=np.concatenate([_unpacked(x.as_buffer()) for x in table["counts"]])).astype(np.int64)  # exact below 2 ** 53
        at = np.flatnonzero(n >= least)
        words = pa.concat_arrays([each.dictionary.take(pa.array(at)).cast(pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])
        lang = pa.array([table["lang"][0].as_py()] * len(words), pa.string())
        return pa.table({"lang": lang, "word": words, "n": np.append(n[at], n.sum() - n[at].sum())})

    each = texts.mapInArrow(run, "lang string, block long, words binary, counts binary")
    return each.groupBy("lang", "block").applyInArrow(total, "lang string, word string, n long")


def _bitmap(rows: DataFrame, bits: int = BITMAP) -> np.ndarray:
    """A bitmap of keys (longs, taken as unsigned) by their top bits, made in pieces by tasks."""
    piece = min(bits, BITMAP_PIECE)

    def one(table: pa.Table) -> pa.Table:
        at = (table["key"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)) & np.uint64((1 << piece) - 1)
        found = np.zeros(1 << piece, bool)
        found[at.astype(np.int64)] = True
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    of = F.expr(f"shiftrightunsigned(key, {64 - bits}) div {1 << piece}")
    got = rows.select("key", of.alias("piece")).groupBy("piece").applyInArrow(one, "piece long, bits binary").toArrow()
    out = np.zeros((1 << (bits - piece), 1 << (piece - 6)), np.uint64)
    for at, data in zip(got["piece"].to_pylist(), got["bits"], strict=True):
        out[at] = np.frombuffer(data.as_buffer(), "<u8")
    return out.ravel()


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - len(bitmap).bit_length() + 1 - 6)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _phrases(held: list, codes: np.ndarray, known: dict, frequent: np.ndarray):
    """The pairs and the triples all of whose words may be frequent: first places and keys of either.

    known keeps the words' hashes from step to step.
    """
    done = len(known.get("key", ()))
    if done < len(held):
        new = _hash([("", b""), *held[done:]], 0)[1:] if done else _hash(held, 0)
        known["key"] = np.concatenate([known["key"], new]) if done else new
        fine = _in(frequent, new)
        fine[: 0 if done else 1] = False
        known["fine"] = np.concatenate([known["fine"], fine]) if done else fine
    fine = known["fine"][codes]
    two = np.flatnonzero(fine[:-1] & fine[1:])
    h = known["key"][codes]
    pair = _mix(h[two], h[two + 1])
    three = np.flatnonzero(two[1:] == two[:-1] + 1) if len(two) else two
    return two, pair, three, _mix(pair[three], h[two[three] + 2])


def _sparse(texts: DataFrame, frequent, parts_log2: int, least: int) -> DataFrame:
    """Parts of sparse counts of phrases by hash: part, slots (a task's, sorted, as differences) and counts (least at most)."""

    def run(batches):
        known = {}
        for step in _coded(batches):
            if step is None:
                known = {}
                continue
            _, pair, _, triple = _phrases(*step, known, frequent.value)
            slots, n = np.unique(np.concatenate([pair, triple]) >> np.uint64(32 - parts_log2), return_counts=True)
            ends = np.searchsorted(slots, np.arange((1 << parts_log2) + 1, dtype=np.uint64) << np.uint64(32))
            n = np.minimum(n, least).astype(np.uint8)
            parts = np.flatnonzero(np.diff(ends))
            cells = ([], [])
            for part in parts:
                own = slots[ends[part] : ends[part + 1]]
                step_ = np.diff(own, prepend=np.uint64(part) << np.uint64(32)).astype("<u4")
                # byte by byte: the high ones are mostly zero
                cells[0].append(step_.view(np.uint8).reshape(-1, 4).T.tobytes())
                cells[1].append(n[ends[part] : ends[part + 1]].tobytes())
            # one batch a step, as each batch has its price
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *[pa.array(x, pa.binary()) for x in cells]], names=["part", "steps", "counts"])

    return texts.mapInArrow(run, "part int, steps binary, counts binary")


def _safe(sparse: DataFrame, parts_log2: int, least: int) -> DataFrame:
    """key (its top 32 + parts_log2 bits) of the slots whose counts come to least."""

    def total(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        slots = [np.cumsum(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint64) for x in table["steps"]]
        slots, n = np.concatenate(slots), np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["counts"]])
        slots, n = _summed(slots, n.astype(np.int64))
        enough = slots[n >= least]
        key = (enough | (np.uint64(part) << np.uint64(32))) << np.uint64(32 - parts_log2)
        return pa.table({"key": pa.array(key.view(np.int64))})

    return sparse.groupBy("part").applyInArrow(total, "key long")


@dataclass
class PerfectHash:
    """Slots for a set of keys: levels of bits in blocks, and the stored second key of every slot."""

    blocks: int
    begins: np.ndarray  # of each block, its first slot
    level_at: np.ndarray  # blocks x levels: first bit
    level_size: np.ndarray
    bits: np.ndarray  # bytes of 0 or 1, packed
    ranks: np.ndarray  # ones before each word of 64 bits
    stored: np.ndarray

    def slots(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where its stored second key isn't the one given."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.stored):
            return out
        left = np.arange(len(keys))
        block = _block(keys, self.blocks)
        for level in range(self.level_at.shape[1]):
            b = block[left]
            size = self.level_size[b, level]
            left, b, size = left[size > 0], b[size > 0], size[size > 0]
            if not len(left):
                break
            bit = self.level_at[b, level] + _spread(keys[left], checks[left], level, size)
            word = self.bits[bit >> 6]
            inside = (bit & 63).astype(np.uint64)
            hit = (word >> inside & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << inside[hit]) - np.uint64(1))
            slot = self.ranks[bit[hit] >> 6] + np.bitwise_count(below)
            same = self.stored[slot] == checks[left[hit]]
            out[left[hit][same]] = slot[same]
            left = left[~hit]
        return out


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def _spread(keys: np.ndarray, checks: np.ndarray, level: int, size) -> np.ndarray:
    """Places below size, another one at each level; keys that are alike part by their second keys from some level on."""
    of = keys if level < 16 else checks
    return ((_mix(of, np.full(len(of), level + 1, np.uint64)) >> np.uint64(32)) * np.asarray(size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _levels(keys: np.ndarray, checks: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of a block's levels, multiples of 64, and their bits one after another."""
    sizes, bits = [], []
    while len(keys):
        size = -(-GAMMA * len(keys) // 64) * 64
        at = _spread(keys, checks, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys, checks = keys[~alone[at]], checks[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def _own_hash(keys: np.ndarray, checks: np.ndarray) -> PerfectHash:
    """A hash of one block, without second keys."""
    sizes, bits = _levels(keys, checks)
    words = np.packbits(bits, bitorder="little").view("<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])
    return PerfectHash(1, np.zeros(1), np.array([np.cumsum([0, *sizes[:-1]])]), np.array([sizes]), words, ranks, np.arange(len(keys), dtype=np.uint64))


def _built(keys: DataFrame, blocks: int) -> DataFrame:
    """block, key, check to a row for each block: block, sizes, bits, stored; keys of a block are a few thousand."""

    def one(table: pa.Table) -> pa.Table:
        key, check = (table[c].to_numpy().view(np.uint64) for c in ("key", "check"))
        own = _own_hash(key, check)
        stored = np.zeros(len(key), np.uint64)
        stored[_first_slots(own, key, check)] = check
        cell = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"block": table["block"].slice(0, 1), "sizes": pa.array([own.level_size[0]], pa.list_(pa.int64())), "bits": cell(own.bits), "stored": cell(stored)})

    return keys.groupBy("block").applyInArrow(one, "block long, sizes array<long>, bits binary, stored binary")


def _first_slots(own: PerfectHash, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The slot of each key that is known to be in a hash of one block."""
    out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level in range(own.level_at.shape[1]):
        bit = own.level_at[0, level] + _spread(keys[left], checks[left], level, own.level_size[0, level])
        inside = (bit & 63).astype(np.uint64)
        hit = (own.bits[bit >> 6] >> inside & np.uint64(1)).astype(bool)
        out[left[hit]] = own.ranks[bit[hit] >> 6] + np.bitwise_count(own.bits[bit[hit] >> 6] & ((np.uint64(1) << inside[hit]) - np.uint64(1)))
        left = left[~hit]
    return out


def perfect_hash(keys: DataFrame, n: int) -> PerfectHash:
    """(key, check) of n keys: blocks are built in tasks, the driver lays them end to end."""
    blocks = max(1, n // BLOCK_KEYS)
    block = F.expr(f"shiftrightunsigned(shiftrightunsigned(key, 40) * {blocks}L, 24)")
    rows = _built(keys.withColumn("block", block), blocks).toArrow().sort_by("block").to_pylist()
    depth = max([1, *(len(r["sizes"]) for r in rows)])
    at, size, begins = np.zeros((blocks, depth), np.int64), np.zeros((blocks, depth), np.int64), np.zeros(blocks, np.int64)
    bits = slots = 0
    for r in rows:
        size[r["block"], : len(r["sizes"])] = r["sizes"]
        at[r["block"]] = bits + np.cumsum([0, *size[r["block"]][:-1]])
        begins[r["block"]] = slots
        bits, slots = bits + sum(r["sizes"]), slots + len(r["stored"]) // 8
    words = np.frombuffer(b"".join(r["bits"] for r in rows), "<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]) if len(words) else np.zeros(0, np.int64)
    return PerfectHash(blocks, begins, at, size, words, ranks, np.frombuffer(b"".join(r["stored"] for r in rows), "<u8"))


class _Phrases:
    """Counts of a task: of pairs, as numbers of two words in one, and of triples, a pair and its next word."""

    def __init__(self):
        self.pairs, self.triples = [], []

    def __len__(self) -> int:
        return sum(len(x[0]) for x in (*self.pairs, *self.triples))

    def add(self, pairs: np.ndarray, heads: np.ndarray, lasts: np.ndarray) -> None:
        """A step's occurrences; a triple's first pair is among the pairs."""
        code, n = np.unique(pairs, return_counts=True)
        self.pairs.append((code, n))
        both, n = np.unique(np.searchsorted(code, heads) << 32 | lasts, return_counts=True)
        self.triples.append((code[both >> 32], both & 0xFFFFFFFF, n))

    def merge(self) -> None:
        if len(self.pairs) > 1:
            code, n = _summed(*map(np.concatenate, zip(*self.pairs, strict=True)))
            heads, lasts, n3 = map(np.concatenate, zip(*self.triples, strict=True))
            both, n3 = _summed(np.searchsorted(code, heads) << 32 | lasts, n3)
            self.pairs, self.triples = [(code, n)], [(code[both >> 32], both & 0xFFFFFFFF, n3)]

    def rows(self, blocks: int):
        """A row for each block, a triple beside its first pair, in order and as differences; then it is empty."""
        self.merge()
        if self.pairs:
            (code, n), (heads, lasts, n3) = self.pairs[0], self.triples[0]
            code, last, n = np.concatenate([code, heads]), np.concatenate([np.full(len(code), -1), lasts]), np.concatenate([n, n3])
            block = _block(_mix(code.view(np.uint64), np.zeros(len(code), np.uint64)), blocks)
            order = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[order], np.arange(blocks + 1))
            filled = np.flatnonzero(np.diff(ends))
            own = [order[ends[at] : ends[at + 1]] for at in filled]
            cells = [pa.array([_packed(x) for x in column], pa.binary()) for column in ([np.diff(code[i], prepend=0) for i in own], [last[i] for i in own], [n[i] for i in own])]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), *cells], names=["block", "codes", "lasts", "counts"])
        self.pairs, self.triples = [], []


def _phrase_counts(texts: DataFrame, frequent, safe, numbers, blocks: int, least: int) -> DataFrame:
    """code, last, f and head of the phrases of least occurrences: numbers of two words, of a third or -1, and of a triple its first pair's count."""

    def run(batches):
        known, ids, counts = {}, np.zeros(0, np.int64), _Phrases()
        for step in _coded(batches):
            if step is None:
                known, ids = {}, np.zeros(0, np.int64)
                continue
            held, codes = step
            two, pair, three, triple = _phrases(held, codes, known, frequent.value)
            if len(ids) < len(held):
                checks = _hash([("", b""), *held[max(1, len(ids)) :]], 1)[1:]
                new = numbers.value.slots(known["key"][max(1, len(ids)) :], checks)
                ids = np.concatenate([ids if len(ids) else np.full(1, -1), new])
            of = ids[codes]
            fine = _in(safe.value, pair) & (of[two] >= 0) & (of[two + 1] >= 0)
            good = fine[three] & fine[three + 1]
            third = two[three[good]]
            third = third[_in(safe.value, triple[good])]
            first = two[fine]
            counts.add(of[first] << 32 | of[first + 1], of[third] << 32 | of[third + 1], of[third + 2])
            if len(counts) > HELD_PHRASES:
                counts.merge()
                if len(counts) > HELD_PHRASES // 2:
                    yield from counts.rows(blocks)
        yield from counts.rows(blocks)

    def total(table: pa.Table) -> pa.Table:
        code = np.concatenate([np.cumsum(_unpacked(x.as_buffer())) for x in table["codes"]])
        last, n = (np.concatenate([_unpacked(x.as_buffer()) for x in table[c]]) for c in ("lasts", "counts"))
        seed = 0
        while True:  # until no two phrases of the block have one key; that there are any is next to impossible
            key = _mix(code.view(np.uint64), (last + 2 + (seed << 32)).view(np.uint64))
            keys = np.sort(key)
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
            own = _own_hash(keys, keys)
            slot = _first_slots(own, key, key)
            codes, lasts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            codes[slot], lasts[slot] = code, last
            if (codes[slot] == code).all() and (lasts[slot] == last).all():
                break
            seed += 1
        f = np.bincount(slot, weights=n, minlength=len(keys)).astype(np.int64)  # exact below 2 ** 53
        enough = np.flatnonzero(f >= least)
        codes, lasts, f = codes[enough], lasts[enough], f[enough]
        pairs = np.flatnonzero(lasts < 0)
        pairs = pairs[np.argsort(codes[pairs])]
        triples = lasts >= 0
        head = np.where(triples, f[pairs[np.minimum(np.searchsorted(codes[pairs], codes), len(pairs) - 1)]], 0) if len(pairs) else f
        return pa.table({"code": codes, "last": lasts, "f": f, "head": head})

    each = texts.mapInArrow(run, "block long, codes binary, lasts binary, counts binary")
    return each.groupBy("block").applyInArrow(total, "code long, last long, f long, head long")


def _with_keys(words: DataFrame) -> DataFrame:
    """lang, word, n with key and check, two hashes."""

    def run(batches):
        for batch in batches:
            held = [("", b""), *((lang, w.encode()) for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(_hash(held, seed)[1:].view(np.int64)) for seed in (0, 1)]], names=["lang", "word", "n", "key", "check"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, word string, n long, key long, check long")


def _with_numbers(words: DataFrame, numbers) -> DataFrame:
    """lang, word and n of frequent words with id, their numbers."""

    def run(batches):
        for batch in batches:
            key, check = (batch.column(i).to_numpy().view(np.uint64) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers.value.slots(key, check))], names=["lang", "word", "n", "id"])

    return words.select("lang", "word", "n", "key", "check").mapInArrow(run, "lang string, word string, n long, id long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, contained: int = CONTAINED, top: int = TOP, round_keys: int = ROUND_KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the top phrases by score, then a, then text.

    A phrase is two or three words within a piece of a text, in ASCII lower case; a is how often it occurs, l and r its parts at
    the cut of the lowest score, n the language's words. A phrase within a longer one that has contained per cent of its
    occurrences or more is left out. A null text is empty, a null language is 'und'; every row counts, repeated ones too.
    An empty table gives an empty result. A task holds one text and the words and phrases of a few million others.
    round_keys: phrases of a block; more phrases are more blocks.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    ship = spark.sparkContext.broadcast
    words = checkpointed(count_words(texts, least))
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent_words = checkpointed(_with_keys(words.filter("word IS NOT NULL")))
    frequent = ship(_bitmap(frequent_words.select("key")))
    numbers = ship(perfect_hash(frequent_words.select("key", "check"), frequent_words.count()))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts_log2 = min(20, max(4, (2 * total // PART_ENTRIES).bit_length()))
    slots = checkpointed(_safe(_sparse(texts, frequent, parts_log2, least), parts_log2, least))
    n_safe = slots.count()
    safe = ship(_bitmap(slots, min(MOST_BITS, 32 + parts_log2, max(BITMAP, (BITS_A_KEY * n_safe).bit_length()))))
    found = checkpointed(_phrase_counts(texts, frequent, safe, numbers, max(1, -(-n_safe // round_keys)), least))

    # of a pair the counts of both words; of a triple those of its first and last word, its first pair and its last pair
    named = checkpointed(_with_numbers(frequent_words, numbers))
    low = F.lit(0xFFFFFFFF).cast("long")
    ids = found.select("code", "last", F.col("f").alias("a"), "head", F.shiftrightunsigned("code", 32).alias("i1"), F.col("code").bitwiseAND(low).alias("i2"))
    ids = ids.withColumn("end", F.when(F.col("last") < 0, F.col("i2")).otherwise(F.col("last")))
    ids = ids.withColumn("tail", F.when(F.col("last") >= 0, F.shiftleft("i2", 32).bitwiseOR(F.col("last"))))
    ids = ids.join(named.select(F.col("id").alias("i1"), "lang", F.col("n").alias("l1")), "i1").join(named.select(F.col("id").alias("end"), F.col("n").alias("n_end")), "end")
    pairs = found.filter("last < 0").select(F.col("code").alias("tail"), F.col("f").alias("n_tail"))
    three = F.col("last") >= 0
    triples = ids.filter(three).join(pairs, "tail").withColumns({"r1": F.col("n_tail"), "l2": F.col("head"), "r2": F.col("n_end")})
    two = ids.filter(~three).withColumns({"r1": F.col("n_end"), "l2": F.lit(None).cast("long"), "r2": F.lit(None).cast("long")})
    columns = ["lang", "code", "last", "tail", "i1", "i2", "a", "l1", "r1", "l2", "r2"]
    score = lambda l, r: F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST({l} AS DECIMAL(15,0)) * CAST({r} AS DECIMAL(15,0))) AS LONG)")  # noqa: E731, E741
    both = triples.select(*columns).unionByName(two.select(*columns)).withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    second = F.col("s2") < F.col("s1")  # a pair has no second cut: null
    pick = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    cut = checkpointed(both.select("lang", "code", "last", "tail", "i1", "i2", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score")))

    longer = cut.filter(three).select(F.explode(F.array("code", "tail")).alias("code"), F.col("a").alias("longer"))
    most = longer.groupBy("code").agg(F.max("longer").alias("longer"), F.lit(-1).cast("long").alias("last"))
    kept = cut.join(most, ["code", "last"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    # all that are as good as the last of the first ones get their texts, by which they are told apart
    foremost = kept.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("rank") <= top).drop("rank")
    text = lambda i, name: named.select(F.col("id").alias(i), F.col("word").alias(name))
    spelt = foremost.join(text("i1", "w1"), "i1").join(text("i2", "w2"), "i2").join(text("last", "w3"), "last", "left")
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
