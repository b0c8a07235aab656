"""Writes as new snapshots: upserts, insert-ignore, immutable preflight, compare-and-set, cascading deletes, state machines.

Plain parquet has no transactions, so a write is a query from the old snapshot and a batch to the new one. publish() puts a
snapshot in a directory of its own and then moves a pointer, so readers see the old or the new one, whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of a batch's rows with equal keys the one of highest position: the last write."""
    w = Window.partitionBy(*keys).orderBy(F.desc(position))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, first_wins: tuple[str, ...] = (), largest: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows merged by key (unique in both): new values win, except nulls, columns where the first write stays, and those that keep the larger value."""
    values = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full")

    def pick(c: str):
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        return F.greatest(o, n) if c in largest else F.coalesce(o, n) if c in first_wins else F.coalesce(n, o)

    return both.select(*keys, *[pick(c).alias(c) for c in values]).select(old.columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new (unique by key) whose key it lacks."""
    return old.unionByName(new.join(old.select(keys), keys, "left_anti"))


def replayed_differently(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys of rows that are there already with other values: an immutable table must have none."""
    o, n = old.alias("o"), new.alias("n")
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return n.join(o, keys).where(differs).select(*keys).distinct()


def delete_cascade(rows: DataFrame, roots: DataFrame, key: str, *, separator: str = "::") -> DataFrame:
    """rows without those whose key is a root (column root) or begins with a root and the separator: an anti-join on the part before it."""
    root = F.substring_index(F.col(key), separator, 1)
    return rows.withColumn("_root", root).join(roots.select(F.col("root").alias("_root")).distinct(), "_root", "left_anti").drop("_root")


def compare_and_set(rows: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Updates (key, revision, other columns) of rows whose revision still is what the update saw; also the keys that conflict."""
    values = [c for c in updates.columns if c not in (key, "revision")]
    u = updates.select(key, F.col("revision").alias("_seen"), *[F.col(c).alias(f"_{c}") for c in values])
    both = rows.join(u, key, "left")
    ok = F.col("_seen").isNotNull() & (F.col("_seen") == F.col("revision"))
    after = both.select(*[(F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)) if c in values else F.col(c) + F.when(ok, 1).otherwise(0) if c == "revision" else F.col(c)).alias(c) for c in rows.columns])
    lost = u.join(rows.select(key, "revision"), key, "left").where(~F.col("revision").eqNullSafe(F.col("_seen"))).select(key)
    return after, lost


# What a review may become.
REVIEW_STEPS = (("draft", "in_review"), ("in_review", "approved"), ("in_review", "rejected"), ("in_review", "draft"), ("approved", "committed"))


def illegal_steps(events: DataFrame, steps: tuple[tuple[str, str], ...] = REVIEW_STEPS) -> DataFrame:
    """Events (id, position, status) whose status may not follow the one before; the first must be one that nothing leads to by name 'draft'."""
    before = F.lag("status").over(Window.partitionBy("id").orderBy("position"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in steps])
    e = events.withColumn("before", before)
    ok = F.when(F.col("before").isNull(), F.col("status") == "draft").otherwise(F.array_contains(allowed, F.concat_ws(">", "before", "status")))
    return e.where(~ok).select("id", "position", "before", "status")


def preflight(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """provision_id, outcome, reason of versions to write against stored ones (the same columns): created, idempotent, upgraded or conflict.

    A stored version may only be written again unchanged, or to fill a source checksum it lacks. A new id may not reuse a lineage's start
    date or number, nor lie inside another version's validity. Ids or (lineage, number) repeated in the batch conflict. Documents are
    written whole or not: a row of a document with any conflict is 'blocked'.
    """
    b = batch.withColumn("_ids", F.count("*").over(Window.partitionBy("provision_id"))).withColumn("_numbers", F.count("*").over(Window.partitionBy("lineage_id", "version_no")))
    s = stored.select("provision_id", *[F.col(c).alias(f"s_{c}") for c in ("lineage_id", "text_checksum", "effective_from", "version_no", "source_checksum")])
    # Per lineage its starts and numbers as sets: a lineage has few versions.
    line = stored.groupBy("lineage_id").agg(F.collect_set("effective_from").alias("starts"), F.collect_set("version_no").alias("numbers"))
    both = b.join(s, "provision_id", "left").join(line, "lineage_id", "left")
    known = F.col("s_lineage_id").isNotNull()
    reason = (
        F.when(F.col("_ids") > 1, "repeated_id")
        .when(F.col("_numbers") > 1, "repeated_version_no")
        .when(known & (F.col("s_lineage_id") != F.col("lineage_id")), "lineage_changed")
        .when(known & (F.col("s_text_checksum") != F.col("text_checksum")), "text_changed")
        .when(known & (F.col("s_effective_from") != F.col("effective_from")), "start_changed")
        .when(known & (F.col("s_version_no") != F.col("version_no")), "version_no_changed")
        .when(known & F.col("s_source_checksum").isNotNull() & ~F.col("s_source_checksum").eqNullSafe(F.col("source_checksum")), "source_changed")
        .when(~known & F.coalesce(F.array_contains("starts", F.col("effective_from")), F.lit(False)), "start_taken")
        .when(~known & F.coalesce(F.array_contains("numbers", F.col("version_no")), F.lit(False)), "version_no_taken")
    )
    out = both.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNotNull(), "conflict").when(~known, "created").when(F.col("s_source_checksum").isNull() & F.col("source_checksum").isNotNull(), "upgraded").otherwise("idempotent")
    out = out.withColumn("outcome", outcome)
    blocked = F.max((F.col("outcome") == "conflict").cast("int")).over(Window.partitionBy("logical_vb_id")) == 1
    return out.select("provision_id", "logical_vb_id", F.when(blocked & (F.col("outcome") != "conflict"), "blocked").otherwise(F.col("outcome")).alias("outcome"), "reason")


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes df as root/version and then points root/CURRENT at it: the pointer is written beside and renamed over the old one, so a
    reader sees the one or the other, whole."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(path)
    jvm = spark._jvm
    pointer, beside = (jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}") for name in ("CURRENT", f".CURRENT-{uuid.uuid4().hex}"))
    conf = spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.getFileSystem(conf).makeQualified(pointer).toUri(), conf)
    out = beside.getFileSystem(conf).create(beside, False)
    out.writeBytes(version)
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, pointer, over)
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published snapshot."""
    version = spark.read.text(f"{root.rstrip('/')}/CURRENT").first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/{version}")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of keys that occur more than once; rows with a null among them don't count, as in a unique index on what is not null."""
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    return rows.where(there).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
