"""SentencePiece encoding and decoding with a unigram model.

Encoding finds, for each text, the pieces with the greatest sum of log scores (Viterbi), over a double-array trie of
the pieces' UTF-8 bytes. A character that no piece covers costs UNKNOWN_PENALTY more than the worst piece and is given
as its bytes' pieces where the model has those, else as the unknown piece. White space is the marker U+2581, one put
before the text; decoding turns markers into spaces and drops that first one, joins byte pieces and reads them as
UTF-8 (a byte that isn't gives U+FFFD).

If no piece goes on with a marker after another character, a text falls apart at those places, and further between
any two characters that no piece has next to each other; its best path is that of its parts. Parts recur: each
distinct one is searched once (while the cache holds it), many side by side, a step for all of them at each byte.
"""

from __future__ import annotations

import codecs
import functools
import re
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cantata.llm.common import id_and_text
from cantata.llm.pretokens import small_slices

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
_SIDE_BY_SIDE = 48  # longer segments (in bytes) are searched alone
_NEVER = -1e300
_WORDS = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")

codecs.register_error("sentencepiece", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass
class PieceModel:
    """Pieces by id, their log scores, and the double array: state s goes by byte b to base[s] + b if check says s."""

    surfaces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray  # 0 piece, 1 byte, 2 unknown, 3 control or unused
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # the piece that ends in a state, or -1
    unknown_id: int
    byte_ids: np.ndarray  # of the 256 bytes, or -1
    longest: int
    pairs: set[tuple[str, str]]  # characters that stand next to each other in some piece
    inner: bool = False  # does a piece have a marker after another character?

    @functools.cached_property
    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character (0 for those in no pair), and the matrix of which go on with which; made once a worker."""
        chars = sorted({ord(c) for pair in self.pairs for c in pair})
        number, together = np.zeros(0x110000, np.int32), np.zeros((len(chars) + 1, len(chars) + 1), bool)
        number[chars] = np.arange(1, len(chars) + 1)
        for a, b in self.pairs:
            together[number[ord(a)], number[ord(b)]] = True
        return number, together

    @functools.cached_property
    def as_arrow(self) -> pa.Array:
        return pa.array(self.surfaces, pa.binary())


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (distinct, not empty) to base, check, value; value is a key's number."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for number, key in enumerate(keys):
        node = 0
        for byte in key:
            nxt = children[node].get(byte)
            if nxt is None:
                nxt = len(children)
                children.append({})
                ends.append(-1)
                children[node][byte] = nxt
            node = nxt
        ends[node] = number
    places, states, top = {0}, [0] * len(children), 0
    bases = [0] * len(children)
    free, several, stack = 1, 1, [0]
    while stack:
        node = stack.pop()
        if not (kids := children[node]):
            continue
        labels = sorted(kids)
        while free in places:
            free += 1
        # the first gap for one child; a few tries from there for several; else beyond all others
        tries = range(free - labels[0], free - labels[0] + (1 if len(labels) == 1 else 32))
        b = next((x for x in tries if not any(x + byte in places for byte in labels)), top + 1)
        bases[node] = b
        for byte in labels:
            states[kids[byte]] = b + byte
            places.add(b + byte)
            stack.append(kids[byte])
        top = max(top, b + labels[-1])
    size = top + 513  # a base may be below 0: what is looked up there is the empty end
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[states], value[states] = bases, ends
    for node, kids in enumerate(children):
        check[[states[c] for c in kids.values()]] = states[node]
    return base, check, value


def load(path: str, scores: list[float] | None = None) -> PieceModel:
    """A model file's pieces; its scores are the log scores unless others are given, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(len(sp))]
    kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_unknown(i) else 3 if sp.is_control(i) or sp.is_unused(i) else 0 for i in range(len(sp))])
    return build(pieces, np.array(scores if scores is not None else [sp.get_score(i) for i in range(len(sp))], dtype=np.float64), kinds)


def build(pieces: list[str], scores: np.ndarray, kinds: np.ndarray) -> PieceModel:
    normal = [i for i, p in enumerate(pieces) if kinds[i] == 0 and p]
    inner = any(MARKER in pieces[i].lstrip(MARKER) for i in normal)
    keys = [pieces[i].encode() for i in normal]
    base, check, value = double_array(keys)
    value = np.where(value >= 0, np.array(normal, dtype=np.int64)[value], -1) if normal else value
    byte_ids = np.full(256, -1, np.int64)
    for i in np.flatnonzero(kinds == 1):
        byte_ids[int(pieces[i][3:5], 16)] = i
    unknown = np.flatnonzero(kinds == 2)
    pairs = {pair for i in normal for pair in zip(pieces[i], pieces[i][1:], strict=False)}
    surfaces = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 3 else (" \N{DOUBLE QUESTION MARK} ".encode() if k == 2 else p.encode()) for p, k in zip(pieces, kinds, strict=True)]
    return PieceModel(surfaces, scores, kinds, base, check, value, int(unknown[0]) if len(unknown) else -1, byte_ids, max(map(len, keys), default=1), pairs, inner)


def viterbi(model: PieceModel, segments: list[str]) -> list[list[int]]:
    """The best pieces of each segment; of equal sums the path whose last piece is longest, and so on backwards."""
    return [np.frombuffer(ids, "<i4").tolist() for ids in best_ids(model, segments)]


def best_ids(model: PieceModel, segments: list[str]) -> list[bytes]:
    """What viterbi gives, each as little-endian 32-bit bytes."""
    out: list[bytes] = [b""] * len(segments)
    raw = [s.encode("utf-8") for s in segments]
    sizes = list(map(len, raw))
    order = sorted(range(len(raw)), key=sizes.__getitem__)
    begin = 0
    while begin < len(order):
        limit = min(max(1, sizes[order[begin]]) + 3, _SIDE_BY_SIDE)
        end = begin
        while end < len(order) and end - begin < 20_000 and sizes[order[end]] <= limit:
            end += 1
        end = max(end, begin + 1)
        part = order[begin:end]
        for i, ids in zip(part, _best_paths(model, [raw[i] for i in part]), strict=True):
            out[i] = ids
        begin = end
    return out


def _best_paths(model: PieceModel, raw: list[bytes]) -> list[bytes]:
    """Byte positions are rows and texts columns, so that a step of all texts is one stretch of memory."""
    n, length = len(raw), np.fromiter(map(len, raw), np.int64, len(raw))
    width = int(length.max())
    text = np.frombuffer(b"".join([b.ljust(width, b"\0") for b in raw]), np.uint8).reshape(n, width).T.astype(np.int32)
    best = np.full((width + 1, n), _NEVER)
    best[0] = 0
    piece, came = np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int32)
    used = model.scores[model.kinds == 0]
    unknown = (used.min() if len(used) else 0.0) - UNKNOWN_PENALTY
    for at in range(width):
        rows = ((best[at] > _NEVER) & (length > at)).nonzero()[0]
        if not len(rows):
            continue
        here, lead = best[at].take(rows), text[at].take(rows)
        step = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        covered = np.zeros(len(rows), bool)
        live, r, state = np.arange(len(rows)), rows, np.zeros(len(rows), np.int32)
        for depth in range(1, min(model.longest, width - at) + 1):
            nxt = model.base.take(state) + text[at + depth - 1].take(r)
            # what is beyond a text's end is no byte of it
            fits = ((model.check.take(nxt, mode="wrap") == state) & (length.take(r) >= at + depth)).nonzero()[0]
            if not len(fits):
                break
            live, r, state = live.take(fits), r.take(fits), nxt.take(fits)
            found = model.value.take(state)
            hit = (found >= 0).nonzero()[0]
            if len(hit):
                k, h, p = live.take(hit), r.take(hit), found.take(hit)
                covered[k] |= depth == step.take(k)
                total = here.take(k) + model.scores.take(p)
                better = (total > best[at + depth].take(h)).nonzero()[0]
                h = h.take(better)
                best[at + depth, h], piece[at + depth, h], came[at + depth, h] = total.take(better), p.take(better), at
        bare = (~covered).nonzero()[0]
        if len(bare):
            r, to = rows[bare], at + step[bare]
            total = here[bare] + unknown
            better = total > best[to, r]
            r, to = r[better], to[better]
            best[to, r], piece[to, r], came[to, r] = total[better], -1, at
    # back from the ends: ids lie where their bytes begin
    ids, given = np.zeros((n, width), "<i4"), np.zeros((n, width), bool)
    r = np.flatnonzero(length > 0)
    end = length[r]
    while len(r):
        start, p = came[end, r].astype(np.int64), piece[end, r]
        ids[r, start], given[r, start] = p, True
        for i in np.flatnonzero(p < 0):
            a, b = int(start[i]), int(end[i])
            own = model.byte_ids[text[a:b, r[i]]]
            if own.min() >= 0:
                ids[r[i], a:b], given[r[i], a:b] = own, True
            else:
                ids[r[i], a] = model.unknown_id
        more = start > 0
        r, end = r[more], start[more]
    joined, ends = ids[given].tobytes(), (np.cumsum(given.sum(axis=1)) * 4).tolist()
    return [joined[a:b] for a, b in pairwise([0, *ends])]


def segments(model: PieceModel, text: str) -> list[str]:
    """The words of a text with the markers before them; the whole of it if some piece goes on with a marker."""
    if not text:
        return []
    marked = MARKER + text.replace(" ", MARKER)
    return [marked] if model.inner else _WORDS.findall(marked)


def fragments(model: PieceModel, words: list[str]) -> tuple[list[str], list[int]]:
    """The words' parts between characters that no piece has next to each other, one word after another, and where each word's begin (and all end)."""
    joined = "".join(words)
    if not joined:
        return [], [0] * (len(words) + 1)
    number, together = model.beside
    cut = np.ones(len(joined) + 1, bool)
    for begin in range(0, len(joined), 1 << 20):  # so that a very long text takes little beside itself
        chars = number.take(np.frombuffer(joined[begin : begin + (1 << 20) + 1].encode("utf-32-le"), "<u4"))
        cut[begin + 1 : begin + len(chars)] = ~together[chars[:-1], chars[1:]]
    ends = np.cumsum([0, *map(len, words)])
    cut[ends] = True
    cuts = np.flatnonzero(cut)
    return [joined[a:b] for a, b in pairwise(cuts.tolist())], np.searchsorted(cuts, ends).tolist()


class WordIds(dict):
    """Word to its ids as little-endian 32-bit bytes; emptied when full, as is what it keeps of fragments."""

    def __init__(self, model: PieceModel, limit: int = 600_000, of_fragments: int = 300_000):
        super().__init__()
        self.model, self.limit, self.of_fragments = model, limit, of_fragments
        self.known: dict[str, bytes] = {}

    def fill(self, texts: list[list[str]]) -> None:
        """Make sure that all words of texts are in."""
        distinct = set().union(*texts)
        missing = list(distinct.difference(self))
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = list(distinct)
        parts, begins = fragments(self.model, missing)
        new = list(set(parts).difference(self.known))
        if len(self.known) + len(new) > self.of_fragments:
            self.known.clear()
            new = list(set(parts))
        self.known.update(zip(new, best_ids(self.model, new), strict=True))
        ids = list(map(self.known.__getitem__, parts))
        self.update(zip(missing, [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in pairwise(begins)], strict=True))


def encode(model: PieceModel, text: str) -> list[int]:
    return [i for ids in viterbi(model, fragments(model, segments(model, text))[0]) for i in ids]


def _as_text(surfaces: bytes) -> str:
    text = surfaces.decode("utf-8", "sentencepiece").replace(MARKER, " ")
    return text[1:] if text.startswith(" ") else text


def decode(model: PieceModel, ids) -> str:
    return _as_text(b"".join(map(model.surfaces.__getitem__, ids)))


def decode_lists(model: PieceModel, ends: np.ndarray, ids: np.ndarray) -> list[str]:
    """What decode gives for many texts' ids, those of a text from where the one before it ends."""
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), model.as_arrow.take(pa.array(ids, pa.int32())))
    return [_as_text(joined) for joined in pc.binary_join(lists, b"").to_pylist()]


def encode_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """doc_id, ids (array<int>), and with_decoded what the ids decode to, for each row of docs, repeated and null ids included.

    A null or empty text has no ids; an empty table gives an empty result. The model's own normaliser isn't applied: texts
    are encoded as they are, and but for that (and what it has no piece or byte for) decode to themselves. A text is a
    whole in its task: some 30 bytes for each of its characters.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches):
        m = shipped.value
        cache = WordIds(m)
        for batch in batches:
            for doc_ids, texts in small_slices(batch):
                parts = [segments(m, t) for t in texts]
                cache.fill(parts)
                rows = [b"".join(map(cache.__getitem__, p)) for p in parts]
                ends = np.cumsum([0, *map(len, rows)]) // 4
                values = np.frombuffer(b"".join(rows), dtype="<i4")
                columns = [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))]
                if with_decoded:
                    columns.append(pa.array(decode_lists(m, ends, values), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * with_decoded)


def decode_documents(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded for each row of stored ids; null ids decode to an empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [decode(shipped.value, ids or ()) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{ids_col}` AS ARRAY<INT>) AS ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
