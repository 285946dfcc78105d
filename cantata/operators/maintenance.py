"""Ingestion and maintenance as new versions of tables: merges, deltas, reference counts, differences, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.functions.text import trimmed
from cantata.operators.joins import ancestors


def replace_source(table: DataFrame, stage: DataFrame, source_col: str, source: str, owned_elsewhere: DataFrame, key: str) -> DataFrame:
    """The table with one source's rows replaced by the staged ones that aren't owned elsewhere."""
    return table.filter(F.col(source_col) != source).unionByName(stage.join(owned_elsewhere.select(key), key, "left_anti"))


def merge_excluding(table: DataFrame, updates: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Upsert by key, but for updates whose key is excluded."""
    new = updates.join(excluded.select(key).distinct(), key, "left_anti")
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def last_wins(df: DataFrame, unique: list[str], order: list[Column]) -> DataFrame:
    """INSERT OR REPLACE: on each unique column in turn only the last row stays (nulls conflict with nothing)."""
    for c in unique:
        rn = F.row_number().over(Window.partitionBy(c).orderBy(*order))
        df = df.withColumn("__rn", F.when(F.col(c).isNull(), 1).otherwise(rn)).filter("__rn = 1").drop("__rn")
    return df


def apply_delta(table: DataFrame, deletes: DataFrame, upserts: DataFrame, key: str) -> DataFrame:
    gone = deletes.select(key).union(upserts.select(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(upserts)


def signed_counts(counts: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Reference counts after inserts (n = 1) and deletes (n = -1); keys that nothing refers to go."""
    return counts.unionByName(deltas).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 0")


def difference(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """key and change: added, removed or changed (unchanged rows are left out)."""
    a, b = old.select(key, F.col(version).alias("__old"), F.lit(1).alias("__o")), new.select(key, F.col(version).alias("__new"), F.lit(1).alias("__n"))
    both = a.join(b, key, "full")
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do two tables hold the same rows, repeats included?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: absent ones are null, others cast, further ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, foreign: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(key)
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")


def changes_since(feed: DataFrame, key: str, seq: str, since: int) -> DataFrame:
    """The latest row of each key after the cursor, tombstones included."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return feed.filter(F.col(seq) > since).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def unprotected(listed: DataFrame, seen: DataFrame, path: str, unreadable: DataFrame, prefix: str) -> DataFrame:
    """Listed paths that a scan has not seen and that lie below no unreadable folder: those may be deleted.

    Folders are found by equality with a path's ancestors, however many there are.
    """
    missing = listed.join(seen.select(path), path, "left_anti")
    folders = unreadable.select(F.regexp_replace(prefix, "/+$", "").alias("__up"))
    closed = missing.select(path, F.explode(ancestors(F.col(path))).alias("__up")).join(folders, "__up", "left_semi").select(path)
    return missing.join(closed, path, "left_anti")


def confirmed_gone(listed: DataFrame, row_id: str, path: str, now: DataFrame, existing: DataFrame, high_water: int) -> DataFrame:
    """Ids of listed rows up to the high-water mark whose file isn't there and whose row still has the same path.

    listed is what the check began with, now the table as it is: rows that came or moved since are left alone.
    """
    missing = listed.filter(F.col(row_id) <= high_water).join(existing.select(path), path, "left_anti")
    return missing.select(row_id, path).join(now.select(row_id, path), [row_id, path], "left_semi").select(row_id)


def relink(table: DataFrame, row_id: str, path: str, moves: DataFrame, new_id: Column) -> DataFrame:
    """The table after files moved (moves: old_path, new_path): a moved row takes its new path and the id that goes with it.

    Rows that claimed a new path, or its id, and didn't move are stale and go. Moves of paths that no row has do nothing.
    """
    found = moves.join(table.select(F.col(path).alias("old_path")), "old_path", "left_semi").withColumn("__id", new_id)
    moved = table.join(found.select(F.col("old_path").alias(path), "new_path", "__id"), path)
    stayed = table.join(found.select(F.col("old_path").alias(path)), path, "left_anti")
    stayed = stayed.join(found.select(F.col("new_path").alias(path)), path, "left_anti").join(found.select(F.col("__id").alias(row_id)), row_id, "left_anti")
    other = [c for c in table.columns if c not in (row_id, path)]
    return stayed.select(*table.columns).unionByName(moved.select(F.col("__id").alias(row_id), F.col("new_path").alias(path), *other))


def merge_by_any_key(table: DataFrame, updates: DataFrame, keys: list[Column], at: str, fallback: Column | None = None) -> DataFrame:
    """Upsert in which an update replaces every row that shares any of its keys, rows of the table and earlier updates alike.

    keys: columns of either table; null and blank ones tell nothing. fallback is one more key of a row, by which an update finds
    others only if it has none of the keys. at, unique, orders the updates: one that a later one replaces has still replaced what it found.
    A key is reduced to its last update before anything is joined.
    """
    told = lambda df: df.select("*", *[F.nullif(trimmed(key.cast("string")), F.lit("")).alias(f"__k{i}") for i, key in enumerate([*keys, *[fallback] * (fallback is not None)])])
    new, kept = told(updates), told(table)
    nothing = F.coalesce(*[F.col(f"__k{i}") for i in range(len(keys))]).isNull()
    last = new
    for i in range(len(keys) + (fallback is not None)):
        finds = new.filter(nothing) if i == len(keys) else new
        used = finds.filter(F.col(f"__k{i}").isNotNull()).groupBy(f"__k{i}").agg(F.max(at).alias(f"__last{i}"))
        kept = kept.join(used, f"__k{i}", "left_anti")
        last = last.join(used, f"__k{i}", "left").filter(F.col(f"__last{i}").isNull() | (F.col(at) >= F.col(f"__last{i}")))
    return kept.select(*table.columns).unionByName(last.select(*table.columns))


def raise_versions(table: DataFrame, row_id: str, version: str, scans: DataFrame, least: int = 0) -> DataFrame:
    """A version only rises: to that of the scan (row_id, scanned), and only for rows of at least a version already."""
    seen = scans.groupBy(row_id).agg(F.max("scanned").alias("__scanned"))
    own = F.coalesce(F.col(version), F.lit(0))
    told = table.join(seen, row_id, "left")
    return told.withColumn(version, F.when(own >= least, F.greatest(own, F.coalesce("__scanned", F.lit(0)))).otherwise(own)).select(*table.columns)


def put_state(state: DataFrame, **values) -> DataFrame:
    """A table of one row with some of its columns set; an empty one gets its row."""
    names = [c for c in state.columns]
    one = state.sparkSession.range(1).select(F.lit(1).alias("__one"))
    row = one.join(state.withColumn("__one", F.lit(1)), "__one", "left")
    return row.select(*[(F.lit(values[c]).cast(state.schema[c].dataType) if c in values else F.col(c)).alias(c) for c in names]).limit(1)


def publish_versioned(staged: DataFrame, folder: str, version: int) -> str:
    """Writes a restored table beside what is there and gives its path: readers go over to it only when it is whole."""
    path = f"{folder}/version={version}"
    staged.write.mode("errorifexists").parquet(path)
    return path


def first_rows_of(table: DataFrame, key: str, wanted: DataFrame, order: list[str]) -> DataFrame:
    """For each wanted value its first row, aggregated before it is shuffled: an IN list of any length."""
    rows = table.join(wanted.select(key).distinct(), key, "left_semi")
    others = [c for c in table.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row")).select(key, "__row.*")
