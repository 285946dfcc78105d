"""I-Match fingerprints of documents.

Of a document's terms, those within a band of document frequency are kept (neither what most documents have nor
what hardly any has), sorted and made distinct. ``SUBSETS`` randomised lexicons each hold a part of the terms,
drawn by hash: for every rate of ``RATES``, seven. What a document has of a lexicon is hashed; the hashes are its
fingerprint. Lexicons of a high rate agree only for documents of the same terms, those of a low rate also where
documents share a part, so the share of agreeing hashes is a graded likeness. Lexicons that have no term of either
document say nothing and don't count.

The lexicon holds fewer than (terms of a mean document) / ``LOW`` terms, since each is in a LOW part of the documents
or more; if it is within ``BROADCAST_BYTES``, as for any usual corpus, it is broadcast, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed, id_and_text, row_key

LOW, HIGH = 0.0005, 0.1
RATES = (1 / 2, 1 / 8, 1 / 32, 1 / 64, 1 / 128, 1 / 256, 1 / 512, 1 / 1024)
DRAWS = 7
SUBSETS = DRAWS * len(RATES)
BROADCAST_BYTES = 64 << 20
EMPTY = 42  # xxhash64 of an empty array: its seed
#: Documents of a range of ids: GROUP_ROWS while there are MIN_GROUPS ranges or fewer, then up to GROUP_LIMIT.
GROUP_ROWS, MIN_GROUPS, GROUP_LIMIT = 256, 1024, 10_000
#: A range is looked up in two steps: first among this many.
BLOCKS = 256
_SEPARATORS = r"[\s\p{Punct}]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text in lower case; one at least, so explode_outer gives no row more than explode (which would split twice)."""
    return F.array_distinct(F.split(F.lower(text), _SEPARATORS))


def _membership(term: Column) -> Column:
    """A number whose bit j is set if the term is in the j-th randomised lexicon."""
    out = F.lit(0).cast("long")
    for j in range(SUBSETS):
        # draws of 16 bits each from two hashes of the term and the rate
        rate, draw = divmod(j, DRAWS)
        word = F.xxhash64(term, F.lit(2 * rate + draw // 4))
        part = F.call_function("shiftrightunsigned", word, F.lit(16 * (draw % 4))).bitwiseAND(F.lit(0xFFFF))
        out = out + F.when(part < int(65536 * RATES[rate]), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, text) to the terms in the band, with their membership: term, member."""
    n = docs.count()
    least, most = max(2, -int(-low * n // 1)), max(2.0, high * n)
    counts = docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("term") != "") & F.col("df").between(least, most))
    return checkpointed(band.select("term", _membership(F.col("term")).alias("member")))


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing hashes among those that either document has; 1 for two documents without any term."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), None).otherwise(F.when(x == y, 1).otherwise(0)))
    told = F.filter(pairs, lambda p: p.isNotNull())
    agree = F.aggregate(told, F.lit(0), lambda s, p: s + p)
    return F.when(F.size(told) == 0, F.lit(1.0)).otherwise(agree / F.size(told))


def fingerprint(texts: DataFrame, words: DataFrame) -> DataFrame:
    """texts (any keys, text) to their keys and ``fp``, an array of SUBSETS hashes; equal texts get equal ones.

    A text without a term in the band gets the hash of all its terms for each lexicon, so that unlike short texts
    don't agree; a text without any term is such a text too. Keys may not be named text, all, whole, term or member.
    If texts are partitioned by some of the keys, nothing is shuffled but a lexicon too large to broadcast.
    """
    keys = [c for c in texts.columns if c != "text"]
    split = texts.select(*keys, terms(F.col("text")).alias("all"))
    # the hash has a projection of its own: beside the explode it would be taken once for each term
    split = split.select(*keys, "all", F.xxhash64(F.sort_array("all")).alias("whole"))
    rows = split.select(*keys, "whole", F.posexplode_outer("all").alias("at", "term"))
    size = words.agg(F.coalesce(F.sum(F.octet_length("term") + F.lit(48)), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(words) if size <= BROADCAST_BYTES else words, "term", "left").filter("member IS NOT NULL OR at = 0")
    own = F.sort_array(F.collect_list(F.when(F.col("member").isNotNull(), F.struct("term", "member"))))
    kept = joined.groupBy(*keys, "whole").agg(own.alias("kept"))
    subset = lambda j: F.filter("kept", lambda t: F.getbit(t["member"], j) == 1)
    hashes = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: F.xxhash64(subset(j)))
    hashes = F.transform(hashes, lambda h: F.when(h == EMPTY, F.lit(0).cast("long")).otherwise(h))
    fallback = F.array_repeat(F.col("whole"), SUBSETS)
    return kept.select(*keys, F.when(F.size("kept") > 0, hashes).otherwise(fallback).alias("fp"))


def as_text(fp: Column) -> Column:
    return F.concat_ws("", F.transform(fp, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def in_neighbourhoods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (g, pos, doc_id, text, copy): within each g and by pos, each document's successor follows it.

    The documents are dealt into ranges of ids, of about as many documents each whatever the ids are; each range ends in
    a copy of the next one's first document, the last range in one of the first. Null ids come first; rows that share an
    id follow by a hash of their texts, and may be in several ranges. Only rows that repeat both stay together.
    """
    n = docs.count()
    groups = max(1, min(n // GROUP_ROWS, max(MIN_GROUPS, n // GROUP_LIMIT)))
    me = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("k"))
    keyed = docs.withColumn("k", row_key()).withColumn("me", me)
    ranges = keyed.select("me").repartitionByRange(groups, "me")
    # where a range begins is written: it must not change
    firsts = checkpointed(ranges.groupBy(F.spark_partition_id().alias("g")).agg(F.min("me").alias("first")))
    ranked = firsts.select("first", (F.row_number().over(Window.orderBy("first")) - 1).alias("at"))  # a row for each range
    found = firsts.count()
    per = max(1, -(-found // BLOCKS))
    leads = [r["first"] for r in ranked.filter(F.col("at") % per == 0).orderBy("at").collect()]  # BLOCKS at most
    literals = F.array(*[F.struct(F.lit(x["known"]).alias("known"), F.lit(x["id"]).cast("long").alias("id"), F.lit(x["k"]).cast("long").alias("k")) for x in leads])
    blocks = ranked.groupBy(F.floor(F.col("at") / per).cast("int").alias("block")).agg(F.sort_array(F.collect_list("first")).alias("bounds"))
    upto = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col("me"))) - 1
    placed = keyed.withColumn("block", upto(literals) if leads else F.lit(0)).join(F.broadcast(blocks), "block").withColumn("inside", upto(F.col("bounds")))
    placed = placed.select("doc_id", "text", "me", (F.col("block") * per + F.col("inside")).alias("g"), (F.col("me") == F.element_at("bounds", F.col("inside") + 1)).alias("is_first"))
    to = lambda g, copy: F.struct(g.alias("g"), F.lit(copy).alias("copy"))
    before = F.pmod(F.col("g") - 1, F.lit(max(1, found)))
    both = placed.select("doc_id", "text", "me", F.inline(F.when(F.col("is_first"), F.array(to(F.col("g"), False), to(before, True))).otherwise(F.array(to(F.col("g"), False)))))
    order = Window.partitionBy("g").orderBy("copy", "me")
    return both.select("g", "doc_id", "text", "copy", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next_text"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next
    document's (by ascending id; see in_neighbourhoods for null and repeated ids). A null text is empty. The only document
    is its own successor. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col)
    words = lexicon(rows)
    n, half = F.length("text"), F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    near = in_neighbourhoods(rows).select("g", "pos", "copy", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    near = near.select("g", "pos", "copy", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    kinds = F.when(F.col("copy"), F.array(F.struct(F.lit(0).alias("kind"), "text"))).otherwise(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    )
    texts = near.select("g", "pos", "copy", "doc_id", "n_chars", "edited_sha256", F.inline(kinds))
    order = Window.partitionBy("g").orderBy("pos", "kind")
    prints = fingerprint(texts, words)
    prints = prints.select("*", F.lead("fp", 1).over(order).alias("edited_fp"), F.lead("fp", 2).over(order).alias("next_fp")).filter("kind = 0 AND NOT copy")
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
