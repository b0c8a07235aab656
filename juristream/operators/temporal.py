"""Immutable versions with half-open validity: as-of reads, timelines, dual-time joins and integrity.

A version is valid on [effective_from, effective_to); a null end is open. Every operator takes its column names, so it
works on provisions and on any other table of intervals. Joins are equi-joins on the lineage with the dates as a further
condition; nothing is ever joined on dates alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristream.functions import text as T


@dataclass(frozen=True)
class Versions:
    """The names of the columns that make a table one of versions."""

    lineage: str = "lineage_id"
    id: str = "provision_id"
    number: str = "version_no"
    start: str = "effective_from"
    end: str = "effective_to"
    parent: str = "parent_lineage_id"


PROVISIONS = Versions()


def in_force(start: Column, end: Column, as_of: Column) -> Column:
    """start <= as_of < end; a null end is open."""
    return (start <= as_of) & (end.isNull() | (as_of < end))


def visible_to(df: DataFrame, audience: str) -> DataFrame:
    """Citizens see what is public and approved (rows without these marks are hidden), admins everything."""
    if audience == "admin":
        return df
    if audience != "citizen":
        raise ValueError("audience must be admin or citizen")
    return df.where((F.col("visibility") == "public") & (F.col("review_status") == "approved"))


def as_of(versions: DataFrame, date: Column | str, names: Versions = PROVISIONS) -> DataFrame:
    """The versions in force on a date; the comparison reaches the parquet scan."""
    date = F.to_date(F.lit(date)) if isinstance(date, str) else date
    return versions.where(in_force(F.col(names.start), F.col(names.end), date))


def deepest(active: DataFrame, names: Versions = PROVISIONS) -> DataFrame:
    """Of versions in force, those that no other of them names as its parent."""
    parents = active.where(F.col(names.parent).isNotNull()).select(F.col(names.parent).alias("_parent")).distinct()
    return active.join(parents, active[names.lineage] == parents["_parent"], "left_anti")


def structural_leaves(versions: DataFrame, names: Versions = PROVISIONS) -> DataFrame:
    """Versions whose lineage no version, of whatever date, names as its parent."""
    return deepest(versions, names)


def law_as_of(provisions: DataFrame, date: str, *, audience: str = "citizen", document: str | None = None, leaves_only: bool = True) -> DataFrame:
    """What is in force on a date, in reading order: documents, articles, clauses and points sorted naturally."""
    active = as_of(visible_to(provisions, audience), date)
    if document is not None:
        active = active.where(F.col("logical_vb_id") == document)
    if leaves_only:
        active = deepest(active)
    blank = F.lit("")
    keys = [T.natural_key(F.coalesce(c, blank)) for c in (F.col("logical_vb_id"), F.col("article"), F.col("clause"), F.col("point"))]
    return active.orderBy(*keys, "effective_from", "version_no")


def ambiguous(active: DataFrame, names: Versions = PROVISIONS) -> DataFrame:
    """Lineages with more than one version in force: must be empty."""
    return active.groupBy(names.lineage).agg(F.count("*").alias("n")).where("n > 1")


def build_versions(rows: DataFrame, lineage: str, start: str) -> DataFrame:
    """lineage, start, end, version_no from one row per lineage and start: each version ends where the next begins."""
    order = Window.partitionBy(lineage).orderBy(start)
    return rows.withColumn("effective_to", F.lead(start).over(order)).withColumn("version_no", F.row_number().over(order))


def transitions(versions: DataFrame, names: Versions = PROVISIONS) -> DataFrame:
    """Neighbouring versions of a lineage: old and new id, dates, days the old one held, and whether they meet."""
    w = Window.partitionBy(names.lineage).orderBy(names.start, names.number)
    pairs = versions.select(
        F.col(names.lineage).alias("lineage"),
        F.col(names.id).alias("old_id"),
        F.lead(names.id).over(w).alias("new_id"),
        F.col(names.start).alias("old_from"),
        F.col(names.end).alias("old_to"),
        F.lead(names.start).over(w).alias("new_from"),
    )
    return pairs.where("new_id IS NOT NULL").withColumn("days", F.date_diff("new_from", "old_from")).withColumn("contiguous", F.coalesce(F.col("old_to") == F.col("new_from"), F.lit(False)))


def complete_chains(versions: DataFrame, edges: DataFrame | None = None, names: Versions = PROVISIONS) -> DataFrame:
    """lineage, n_transitions, complete: every pair meets and, if edges (old_id, new_id) are given, is linked."""
    pairs = transitions(versions, names)
    if edges is not None:
        known = edges.select("old_id", "new_id", F.lit(True).alias("linked")).distinct()
        pairs = pairs.join(known, ["old_id", "new_id"], "left").withColumn("contiguous", F.col("contiguous") & F.coalesce("linked", F.lit(False)))
    return pairs.groupBy("lineage").agg(F.count("*").alias("n_transitions"), F.bool_and("contiguous").alias("complete"))


def integrity(versions: DataFrame, names: Versions = PROVISIONS) -> DataFrame:
    """lineage, n_versions and counts of what is wrong: overlaps, gaps, numbers that don't rise, ends not after starts."""
    w = Window.partitionBy(names.lineage).orderBy(names.start, names.number)
    marked = versions.select(
        F.col(names.lineage).alias("lineage"),
        (F.lag(names.start).over(w).isNotNull() & (F.lag(names.end).over(w).isNull() | (F.lag(names.end).over(w) > F.col(names.start)))).alias("overlap"),
        (F.lag(names.end).over(w) < F.col(names.start)).alias("gap"),
        (F.lag(names.number).over(w) >= F.col(names.number)).alias("number"),
        (F.col(names.end) <= F.col(names.start)).alias("empty"),
    )
    return marked.groupBy("lineage").agg(F.count("*").alias("n_versions"), F.count_if("overlap").alias("n_overlaps"), F.count_if("gap").alias("n_gaps"), F.count_if("number").alias("n_not_rising"), F.count_if("empty").alias("n_empty"))


def at_time(rows: DataFrame, versions: DataFrame, lineage: str, when: Column, prefix: str, names: Versions = PROVISIONS) -> DataFrame:
    """Each row with the version of its lineage in force at `when`, its id and start as <prefix>_id and <prefix>_from; null if there is none."""
    v = versions.select(F.col(names.lineage).alias("_lineage"), F.col(names.id).alias(f"{prefix}_id"), F.col(names.start).alias(f"{prefix}_from"), F.col(names.end).alias("_end"))
    on = (F.col(lineage) == F.col("_lineage")) & in_force(F.col(f"{prefix}_from"), F.col("_end"), when)
    return rows.join(v, on, "left").drop("_lineage", "_end")


def dual_time(rows: DataFrame, versions: DataFrame, lineage: str, then: Column, now: Column, names: Versions = PROVISIONS) -> DataFrame:
    """Each row with the versions in force at two times (hist_id, curr_id) and how they compare: same, changed, ended, begun or none."""
    both = at_time(at_time(rows, versions, lineage, then, "hist", names), versions, lineage, now, "curr", names)
    h, c = F.col("hist_id"), F.col("curr_id")
    state = F.when(h.isNull() & c.isNull(), "none").when(h.isNull(), "begun").when(c.isNull(), "ended").when(h == c, "same").otherwise("changed")
    return both.withColumn("change", state)


def hydrate(candidates: DataFrame, versions: DataFrame, date: str, *, redirect: bool = True, names: Versions = PROVISIONS) -> DataFrame:
    """Ranked candidates (provision_id, position) as versions in force on a date, each lineage once, in order of first mention.

    With redirect a stale version leads to its lineage's current one; without, only ids in force themselves stay.
    """
    active = as_of(versions, date, names)
    if redirect:
        of = versions.select(F.col(names.id).alias("provision_id"), F.col(names.lineage).alias("_l")).distinct()
        found = candidates.select("provision_id", "position").join(of, "provision_id").groupBy("_l").agg(F.min("position").alias("position"))
        return active.join(found, active[names.lineage] == found["_l"]).drop("_l").orderBy("position")
    found = candidates.groupBy(F.col("provision_id").alias("_id")).agg(F.min("position").alias("position"))
    return active.join(found, active[names.id] == found["_id"]).drop("_id").orderBy("position")


def compare(old: DataFrame, new: DataFrame, names: Versions = PROVISIONS) -> DataFrame:
    """Two sets of versions by lineage: status unchanged, added, deleted or modified."""
    a = old.select(F.col(names.lineage).alias("lineage"), F.col(names.id).alias("old_id"), F.col("text").alias("old_text"))
    b = new.select(F.col(names.lineage).alias("lineage"), F.col(names.id).alias("new_id"), F.col("text").alias("new_text"))
    status = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "deleted").when(T.canonical(F.col("old_text")) == T.canonical(F.col("new_text")), "unchanged").otherwise("modified")
    return a.join(b, "lineage", "full").withColumn("status", status)


def not_replaced(clauses: DataFrame, replacements: DataFrame, date: str) -> DataFrame:
    """clauses (id, starts) that have begun and that no replacement (old_id, starts) in force by then replaces."""
    day = F.to_date(F.lit(date))
    gone = replacements.where(F.col("starts") <= day).select(F.col("old_id").alias("id")).distinct()
    return clauses.where(F.col("starts").isNull() | (F.col("starts") <= day)).join(gone, "id", "left_anti")


def coming_replacements(clauses: DataFrame, replacements: DataFrame, date: str) -> DataFrame:
    """Clauses with a replacement that takes effect after a date."""
    later = replacements.where(F.col("starts") > F.to_date(F.lit(date))).select(F.col("old_id").alias("id"), F.col("new_id"), F.col("starts").alias("replaced_from"))
    return clauses.join(later, "id").distinct()


def contract_violations(provisions: DataFrame) -> DataFrame:
    """provision_id and the ordered reasons why a version's own fields disagree; rows that agree are not in it."""
    parts = T.lineage_parts(F.col("lineage_id"))
    sha = T.checksum(F.col("text"))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("text_checksum").eqNullSafe(sha), F.lit("checksum")),
            F.when(~F.col("lineage_id").eqNullSafe(T.lineage_id(F.col("logical_vb_id"), F.col("article"), F.col("clause"), F.col("point"))), F.lit("lineage")),
            F.when(~F.col("parent_lineage_id").eqNullSafe(T.parent_lineage(F.col("lineage_id"))), F.lit("parent")),
            F.when(~F.col("level").eqNullSafe(T.level_of(F.col("lineage_id"))), F.lit("level")),
            F.when(~F.col("provision_id").eqNullSafe(T.version_id(F.col("lineage_id"), F.col("effective_from"), F.col("text_checksum"))), F.lit("version_id")),
            F.when(parts["document"].isNull(), F.lit("malformed")),
            F.when(F.col("effective_to") <= F.col("effective_from"), F.lit("interval")),
            F.when(F.col("version_no") < 1, F.lit("version_no")),
        )
    )
    return provisions.select("provision_id", reasons.alias("reasons")).where(F.size("reasons") > 0)
