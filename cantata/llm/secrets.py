"""Secrets in texts, told apart by how widely their values are owned across the corpus.

One pass finds, in every text, the spans of the base patterns (assignments, access keys, long hexadecimal runs) and
bare candidates: other long tokens of letters and digits. Each candidate's value is hashed; the hashes are aggregated
over the whole corpus by distinct repositories and owners. A value that ``COPIED_OWNERS`` owners or ``COPIED_REPOS``
repositories have is a widely copied example; one that fewer have and that looks alive (many distinct characters,
letters and digits, no placeholder's word) is a credential of its owner. A bare token counts as a secret, and is added to the spans,
only if it is such a credential; base spans always stay and are merely counted by class.

Only documents with a candidate take part in the shuffles, as narrow rows. A value is aggregated before it moves, and
the values of a thousandth of all occurrences or more (so a thousand at most) go back to the documents by broadcast.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed
from cantata.llm.pretokens import small_slices

# The base patterns, and the least length of what they must find.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "bare")

#: Bare candidates: tokens of this many characters, with a letter and a digit.
BARE_LENGTH = 20
#: As many owners, or repositories, make a value a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 5
#: What looks alive has this many distinct characters, and none of these words in it (whatever their case).
DISTINCT = 8
PLACEHOLDERS = ("example", "placeholder", "changeme", "dummy", "sample", "test", "your", "xxxx", "1234567890")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_HEADS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(f"[0-9a-f]{{{LEAST['hex']},}}")  # a maximal run of as many, which is what the pattern finds and keeps
_BARE = re.compile(f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{BARE_LENGTH},}}")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base patterns, by start and then kind as listed."""
    found, low = [], text.lower()
    if any(h in low for h in _HEADS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def bare_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with a letter and a digit that overlap no base span, by start; base is in order of starts."""
    found, at, reach = [], 0, 0
    for m in _BARE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and _LETTER.search(m[0]) and _DIGIT.search(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def looks_alive(value: str) -> bool:
    low = value.lower()
    return len(set(value)) >= DISTINCT and bool(_LETTER.search(value)) and bool(_DIGIT.search(value)) and not any(p in low for p in PLACEHOLDERS)


def _digest(value: str) -> bytes:
    return hashlib.md5(value.encode("utf-8"), usedforsecurity=False).digest()


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """A row for each row of docs: doc_id, owner, repository, and found, an array of kind, start, end, value's hash and alive."""
    found = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary()), ("alive", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for ids, texts, owners, repos in small_slices(batch):
                rows = []
                for text in texts:
                    base = base_spans(text)
                    spans = sorted([*base, *bare_spans(text, base)])
                    rows.append([{"kind": k, "start": a, "end": b, "hash": _digest(v), "alive": looks_alive(v)} for a, k, b, v in spans])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owners, pa.string()), pa.array(repos, pa.string()), pa.array(rows, found)], names=["doc_id", "owner", "repository", "found"])

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
    )
    return texts.mapInArrow(run, "doc_id long, owner string, repository string, found array<struct<kind: int, start: long, end: long, hash: binary, alive: boolean>>")


def ownership(occurrences: DataFrame) -> DataFrame:
    """(hash, owner, repository) to hash, n, owners, repositories: its occurrences and how many distinct ones have it."""
    each = occurrences.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owned = each.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return owned.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"))


def _judged(occurrences: DataFrame, owned: DataFrame) -> DataFrame:
    """Occurrences with copied (of their value). Values of a thousandth of the occurrences or more are broadcast: a thousand at most."""
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOS)
    owned = checkpointed(owned.select("hash", "n", copied.alias("copied")))
    total = owned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * 1000 >= total
    hot, rest = F.broadcast(owned.filter(is_hot).drop("n")), owned.filter(~is_hot).drop("n")
    return occurrences.join(hot, "hash").unionByName(occurrences.join(hot, "hash", "left_anti").join(rest, "hash"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """A row for each row of docs: doc_id and spans, an array of kind, start, end (code points, end exclusive), copied and alive.

    Spans are in order of start, then of kind (assign, access, hex, bare). All base spans are there; a bare one only if its
    value is not copied and alive. Owner and repository default to the columns source and (source, lang); null ones count as
    one owner, named ''. Repeated rows and rows that share an id or have none are judged each by its own text. A null text is
    empty and has no spans; an empty table gives an empty result.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = checkpointed(candidates(docs, id_col, text_col, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", "owner", "repository", F.inline("found"))
    judged = _judged(each.select("row", "kind", "start", "end", "hash", "alive"), ownership(each.select("hash", "owner", "repository")))
    kept = judged.filter("kind < 3 OR (alive AND NOT copied)")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("at"), "end", kind.alias("kind"), "copied", "alive")))
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["copied"].alias("copied"), s["alive"].alias("alive")))
    told = kept.groupBy("row").agg(spans.alias("spans"))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, copied: boolean, alive: boolean>>")
    some = found.filter(F.size("found") > 0).select("row", "doc_id").join(told, "row", "left")
    return found.filter(F.size("found") == 0).select("doc_id", none.alias("spans")).unionByName(some.select("doc_id", F.coalesce("spans", none).alias("spans")))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_copied and n_live (base spans and bare ones)."""
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    is_kind = lambda kind: lambda s: s["kind"] == kind
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id",
        *[count(is_kind(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "bare")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count(lambda s: s["copied"]).alias("n_copied"),
        count(lambda s: s["alive"] & ~s["copied"]).alias("n_live"),
    )
