"""Catalogue pages: visibility, filters, grouped pages, counts, keyset paging, completeness, duplicates, search."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.checkpoints import checkpointed
from cantata.functions.text import lookup_text


def quality_class(depth: Column, label: Column) -> Column:
    """hires from 24 bits (or a label that starts so), cd at 16, lossy otherwise."""
    text = F.coalesce(label, F.lit(""))
    hires = (F.coalesce(depth, F.lit(0)) >= 24) | text.startswith("24")
    return F.when(hires, "hires").when((F.coalesce(depth, F.lit(0)) == 16) | text.startswith("16"), "cd").otherwise("lossy")


def is_missing(c: Column) -> Column:
    """Null, blank or (of a number) zero."""
    return c.isNull() | (F.trim(c.cast("string")).isin("", "0"))


def missing_any(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, map(is_missing, columns))


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def visible(rows: DataFrame, sources: DataFrame, source_col: str, source_id: str, active: Column) -> DataFrame:
    """Rows of sources that are enabled and available."""
    return rows.join(sources.filter(active).select(F.col(source_id).alias(source_col)), source_col, "left_semi")


def library_counts(tracks: DataFrame, album: str) -> DataFrame:
    """Tracks, albums (more than one track) and singles, over one grouping by album."""
    sizes = tracks.groupBy(album).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sizes.agg(total(F.col("n")).alias("tracks"), total((F.col("n") > 1).cast("long")).alias("albums"), total((F.col("n") == 1).cast("long")).alias("singles"))


def keyset_after(order: list[tuple[str, bool]], cursor: list) -> Column:
    """Rows after the cursor in an order of (column, ascending); the leading bound is stated for pushdown."""
    bounds = []
    for i, (name, up) in enumerate(order):
        same = all_of([F.col(n) == v for (n, _), v in zip(order[:i], cursor[:i], strict=True)])
        bounds.append(same & (F.col(name) > cursor[i] if up else F.col(name) < cursor[i]))
    name, up = order[0]
    lead = F.col(name) >= cursor[0] if up else F.col(name) <= cursor[0]
    return lead & reduce(lambda a, b: a | b, bounds)


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], size: int, cursor: list | None = None) -> DataFrame:
    """The next page; its last row's order columns are the next cursor. The last order column must be unique."""
    rest = df if cursor is None else df.filter(keyset_after(order, cursor))
    return rest.orderBy(*[F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in order]).limit(size)


def completeness(tracks: DataFrame, album: str, track: str, total: str, disc: str, discs: str, title: str, unavailable: str) -> DataFrame:
    """album, status (complete, incomplete, unknown), present, expected.

    A disc that has no number is the first. An album is unknown where its tracks contradict each other: two titles in a
    place, a number that is missing or beyond its disc's total, totals of one disc or disc counts that differ, a disc
    without any total or beyond the disc count, a numberless disc where there are several, an unavailable track. The
    number expected is the sum of the discs' totals, if there is one disc, or all are there and their totals differ;
    equal totals of several discs may be each disc's or the album's, so that only a track short of it tells anything.

    Rows that are partitioned by album already are not shuffled.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    wrong = (number(track) < 1) | (number(disc) < 0) | (number(total) < 0) | (number(discs) < 0) | ((number(disc) == 0) & (number(discs) > 1)) | (number(unavailable) != 0)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    name = lookup_text(F.col(title))
    places = tracks.groupBy(album, F.when(number(disc) == 0, 1).otherwise(F.col(disc)).alias("d"), F.col(track).alias("t")).agg(
        F.min(name).alias("name_lo"), F.max(name).alias("name_hi"), F.max(total).alias("most"), F.min(positive(total)).alias("least"),
        F.max(discs).alias("discs_hi"), F.min(positive(discs)).alias("discs_lo"), F.bool_or(wrong).alias("wrong"),
    )
    on_disc = places.groupBy(album, "d").agg(
        F.sum((number("t") > 0).cast("long")).alias("present"), F.max("most").alias("most"), F.min("least").alias("least"), F.max("t").alias("last"),
        F.max("discs_hi").alias("discs_hi"), F.min("discs_lo").alias("discs_lo"), F.bool_or(F.col("wrong") | (F.col("name_lo") != F.col("name_hi"))).alias("wrong"),
    )
    untold = (number("most") <= 0) | (F.col("least") != F.col("most")) | (F.col("last") > F.col("most"))
    albums = on_disc.groupBy(album).agg(
        F.sum("present").alias("present"), F.sum("most").alias("sum_of_totals"), F.min("most").alias("lo"), F.max("most").alias("hi"), F.count(F.lit(1)).alias("seen"),
        F.min("d").alias("first"), F.max("d").alias("last"), F.coalesce(F.max("discs_hi"), F.lit(0)).alias("discs"), F.min("discs_lo").alias("discs_lo"), F.bool_or(F.col("wrong") | F.coalesce(untold, F.lit(False))).alias("wrong"),
    )
    several = F.col("discs") > 0
    unknown = F.col("wrong") | (F.col("first") < 1) | (several & ((F.col("discs_lo") != F.col("discs")) | (F.col("last") > F.col("discs"))))
    single = (F.col("last") == 1) & (F.col("discs") <= 1)
    told = single | ((F.col("discs") == F.col("seen")) & (F.col("lo") != F.col("hi")))
    expected = F.when(told, F.col("sum_of_totals"))
    status = (
        F.when(unknown, "unknown")
        .when((F.col("discs") > F.col("seen")) | (F.col("present") < F.coalesce(expected, F.col("hi"))), "incomplete")
        .when(F.col("present") == expected, "complete")
        .otherwise("unknown")
    )
    return albums.select(album, status.alias("status"), F.col("present").cast("long").alias("present"), F.when(~unknown, expected).cast("long").alias("expected"))


def duplicates(df: DataFrame, key: Column, best_first: list[Column]) -> DataFrame:
    """Rows whose key others share, with ``copies`` and ``keep`` (the first in quality order); blank keys don't count.

    Rows are counted, and the one to keep is found, in each task before anything moves; a row a key comes back to the rows.
    """
    keyed = checkpointed(df.withColumn("dup_key", key).filter("dup_key IS NOT NULL AND dup_key <> ''").withColumn("__id", F.monotonically_increasing_id()))
    counted = keyed.groupBy("dup_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    place = F.row_number().over(Window.partitionBy("dup_key").orderBy(*best_first, "__id"))
    kept = keyed.withColumn("__place", place).filter("__place = 1").select("__id", F.lit(True).alias("keep"))
    told = keyed.join(counted, "dup_key").join(kept, "__id", "left")
    return told.select(*df.columns, "dup_key", "copies", F.coalesce("keep", F.lit(False)).alias("keep"))


def has_terms(query: str, *fields: Column) -> Column:
    """Every term of the query occurs in some field, in any order, whatever the case."""
    import re

    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    texts = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    return all_of([reduce(lambda a, b: a | b, [F.contains(t, F.lit(term)) for t in texts]) for term in terms])


def search_rank(query: str, name: Column) -> Column:
    """0 exact, 1 prefix, 2 contained, 3 otherwise."""
    text, q = lookup_text(name), query.strip().lower()
    return F.when(text == q, 0).when(text.startswith(q), 1).when(F.contains(text, F.lit(q)), 2).otherwise(3)


def trigram_index(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """(gram, id) of every distinct run of three characters in lower case; search_index keeps one on disk."""
    letters = F.split(F.lower(text), "")
    pairs = F.zip_with(letters, F.slice(letters, 2, 1 << 30), lambda a, b: F.concat(a, b))
    grams = F.zip_with(pairs, F.slice(letters, 3, 1 << 30), lambda a, b: F.concat(a, b))
    return docs.select(doc_id, F.explode(F.array_distinct(F.filter(grams, lambda g: F.length(g) == 3))).alias("gram"))


def trigram_search(index: DataFrame, docs: DataFrame, doc_id: str, text: Column, phrase: str) -> DataFrame:
    """Documents that contain the phrase: candidates have all its trigrams, then the phrase itself is verified."""
    p = phrase.lower()
    if len(p) < 3:
        return docs.filter(F.contains(F.lower(text), F.lit(p)))
    grams = sorted({p[i : i + 3] for i in range(len(p) - 2)})
    candidates = index.filter(F.col("gram").isin(grams)).groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    return docs.join(candidates.select(doc_id), doc_id, "left_semi").filter(F.contains(F.lower(text), F.lit(p)))


def ancestor_counts(files: DataFrame, path: Column) -> DataFrame:
    """Every folder with the number of files anywhere below it: folder, files."""
    folders = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", 1, k), "/"))
    parts = files.select(F.split(path, "/").alias("parts")).filter(F.size("parts") > 1)
    return parts.select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
