"""The acceptance queries over provisions, version edges, claims and reviews, by their ids.

QUERIES: id -> function of a dict of tables and one of parameters. EMPTY are the ids whose result must have no rows.
Tables: provisions; contains (parent_lineage, child_lineage); supersedes (src, dst, review_key, commit_key); reviews (review_key, commit_key, change_type,
batch_id); occurrences (ykien_id, misconception_id, verdict, hist_id, hist_checksum, curr_id, curr_checksum, legal_anchor_id, nli_label, evidence_start,
evidence_end, content_hash, canonical_url), or in their place claims (base, and what occurrences say of a claim) and bases (base, BASES; a claim rests on all of its base); items (id, labels, status); batches, candidates, events of reviews.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristream.operators import frequent, graph, temporal
from juristream.operators.lineage import dealt

Tables = Mapping[str, DataFrame]
Parameters = Mapping[str, object]


def _active(t: Tables, p: Parameters) -> DataFrame:
    return temporal.as_of(t["provisions"], str(p["as_of"]))


def t01(t: Tables, p: Parameters) -> DataFrame:
    rows = t["contains"].where(F.col("parent_lineage") == p["clause"])
    return rows.agg(F.array_sort(F.collect_set("child_lineage")).alias("children"), F.countDistinct("child_lineage").alias("n"))


def t02(t: Tables, p: Parameters) -> DataFrame:
    active = _active(t, p)
    points = active.where(F.col("parent_lineage_id") == p["clause"]).select(F.col("parent_lineage_id").alias("lineage_id"), F.col("provision_id").alias("point"))
    clause = active.where(F.col("lineage_id") == p["clause"]).select("lineage_id", "provision_id")
    return clause.join(points, "lineage_id", "left").groupBy("provision_id").agg(F.array_sort(F.collect_list("point")).alias("points"))


def leaf(t: Tables, p: Parameters, level: str) -> DataFrame:
    return temporal.deepest(_active(t, p)).where((F.col("level") == level) & (F.col("lineage_id") == p["lineage"])).select("provision_id")


def t05(t: Tables, p: Parameters) -> DataFrame:
    v = t["provisions"]
    a = v.where(F.col("lineage_id") == p["point_a"]).agg(F.array_sort(F.collect_list("version_no")).alias("a_versions"))
    b = v.where(F.col("lineage_id") == p["point_b"]).agg(F.array_sort(F.collect_list("version_no")).alias("b_versions"), F.array_sort(F.collect_list("effective_to")).alias("b_ends"))
    return a.join(F.broadcast(b))  # one row each


def t06(t: Tables, p: Parameters) -> DataFrame:
    return graph.chains(t["supersedes"]).where(F.array_contains("path", p["provision_id"])).select("path", "hops")


def no_active(t: Tables, p: Parameters) -> DataFrame:
    return _active(t, p).where(F.col("lineage_id") == p["lineage"]).agg(F.collect_list("provision_id").alias("active"))


def t09(t: Tables, p: Parameters) -> DataFrame:
    return t["provisions"].groupBy("provision_id").agg(F.count("*").alias("n")).where("n > 1")


def t10(t: Tables, p: Parameters) -> DataFrame:
    missing = F.lit(False)
    for c in ("text", "text_checksum", "effective_from", "visibility", "review_status"):
        missing = missing | F.col(c).isNull()
    return t["provisions"].where(missing).select("provision_id")


def t11(t: Tables, p: Parameters) -> DataFrame:
    return t["provisions"].where(F.col("provision_id") == p["provision_id"]).select("provision_id", "text", "text_checksum", "effective_from", "effective_to")


def t12(t: Tables, p: Parameters) -> DataFrame:
    return t["provisions"].where(F.col("provision_id") == p["fabricated"]).agg(F.count("*").alias("n"))


def t13(t: Tables, p: Parameters) -> DataFrame:
    return temporal.visible_to(_active(t, p), "citizen").where(F.col("provision_id") == p["provision_id"]).select("provision_id")


def t14(t: Tables, p: Parameters) -> DataFrame:
    row = t["provisions"].where(F.col("provision_id") == p["provision_id"])
    return row.select(F.contains("text", F.lit(p["quote"])).alias("quote_exact"))


def t15(t: Tables, p: Parameters) -> DataFrame:
    return t["provisions"].where(F.col("provision_id") == p["provision_id"]).select(F.col("text").alias("premise"), F.lit(p["claim"]).alias("hypothesis"))


def t16(t: Tables, p: Parameters) -> DataFrame:
    v = t["provisions"]
    old = v.select(F.col("provision_id").alias("src"), F.col("effective_to").alias("closed"))
    new = v.select(F.col("provision_id").alias("dst"), F.col("effective_from").alias("begun"))
    edges = t["supersedes"].join(old, "src").join(new, "dst").join(t["reviews"], ["review_key", "commit_key"])
    return edges.where("closed = begun AND review_key IS NOT NULL AND commit_key IS NOT NULL").select("src", "dst", "closed")


def t17(t: Tables, p: Parameters) -> DataFrame:
    doubtful = t["reviews"].where(F.col("change_type").isin("SPLIT", "MERGED", "UNCERTAIN"))
    return t["supersedes"].join(doubtful, "review_key", "left_semi").select("src", "dst")


# What an occurrence says of the law it rests on.
BASES = ("hist_id", "hist_checksum", "curr_id", "curr_checksum", "legal_anchor_id")


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Claims and the bases they rest on, which meet in `base`. Very many claims may rest on a base, so what is asked of either is asked before they meet."""
    if "claims" in t:
        return t["claims"], t["bases"]
    whole = t["occurrences"].withColumn("base", F.struct(*BASES))
    return whole.drop(*BASES), whole.select("base", *BASES).distinct()


def _outdated(t: Tables, sound: bool) -> DataFrame:
    """Claims that were true once, with bases that are two versions of one lineage, or with the others."""
    claims, bases = _parts(t)
    if sound:
        bases = bases.where("hist_id <> curr_id")
    # Of all versions only those that a base may name are sent to meet the bases.
    named = bases.select(F.explode(F.array("hist_id", "curr_id")).alias("named"))
    v = frequent.maybe_among(t["provisions"].select("provision_id", "text_checksum", "lineage_id"), "provision_id", named, "named")
    for side in ("hist", "curr"):
        one = v.select(F.col("provision_id").alias(f"{side}_id"), F.col("text_checksum").alias(f"{side}_checksum"), F.col("lineage_id").alias(f"{side}_lineage"))
        bases = bases.join(one, [f"{side}_id", f"{side}_checksum"], "inner" if sound else "left")
    two = F.coalesce((F.col("hist_lineage") == F.col("curr_lineage")) & (F.col("hist_id") != F.col("curr_id")), F.lit(False))
    return claims.where("verdict = 'OUTDATED_BUT_PREVIOUSLY_TRUE'").join(bases.where(two if sound else ~two), "base")


def t18(t: Tables, p: Parameters) -> DataFrame:
    return _outdated(t, True).select("ykien_id", "hist_id", "curr_id")


def t19(t: Tables, p: Parameters) -> DataFrame:
    return _outdated(t, False).select("ykien_id")


def t20(t: Tables, p: Parameters) -> DataFrame:
    raw = F.array_contains("labels", "Alert") | F.array_contains("labels", "Draft")
    return t["items"].where(raw & F.array_contains("labels", "Brief") & (F.col("status") == "published")).select("id")


#: Copies of a value that are made from one row.
COPIES = 1 << 14


def repeated(rows: DataFrame, value: str, times: str, n: int) -> DataFrame:
    """The column `value` alone, each row as often as its `times` (1 or more) says, dealt over tasks by n.

    A row with many copies is dealt in parts, and compiled code keeps what it makes of one row until it is done with that, so a task holds COPIES at most."""
    parts = rows.select(value, F.col(times).alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    return dealt(parts, n, value, "_from").select(F.explode(F.array_repeat(value, F.least(F.lit(COPIES), F.col("_n") - F.col("_from")).cast("int"))).alias(value))


def n01(t: Tables, p: Parameters) -> DataFrame:
    claims, bases = _parts(t)
    whole = F.lit(True)
    for c in ("ykien_id", "content_hash", "canonical_url", "evidence_start", "evidence_end"):
        whole = whole & F.col(c).isNotNull()
    anchors = t["provisions"].select(F.col("lineage_id").alias("legal_anchor_id")).distinct()
    # A claim is told how many of its bases are known, and meets none of them.
    known = bases.join(anchors, "legal_anchor_id", "left_semi").groupBy("base").agg(F.count("*").alias("n"))
    found = claims.where(whole & (F.col("evidence_end") > F.col("evidence_start")) & (F.col("nli_label") == "mau_thuan")).join(known, "base")
    return repeated(found, "ykien_id", "n", claims.count())


def n02(t: Tables, p: Parameters) -> DataFrame:
    claims, bases = _parts(t)
    return claims.join(bases, "base", "left_semi").groupBy("ykien_id").agg(F.countDistinct("misconception_id").alias("n")).where("n > 1")


# The columns that reviews must have.
REQUIRED = {
    "batches": ("batch_id", "status", "revision", "reviewer_id", "reviewed_at", "commit_key", "committed_at", "auto_approved"),
    "candidates": ("candidate_id", "batch_id", "status", "auto_approved"),
    "events": ("event_id", "batch_id", "event_type", "created_at"),
}


def pg01(t: Tables, p: Parameters) -> DataFrame:
    spark = t["batches"].sparkSession
    missing = [(name, c) for name, columns in REQUIRED.items() for c in columns if c not in t[name].columns]
    return spark.createDataFrame(missing, "table_name string, column_name string")


def pg02(t: Tables, p: Parameters) -> DataFrame:
    one = t["batches"].where("auto_approved").select(F.lit("batch").alias("kind"), F.col("batch_id").alias("id"))
    return one.unionByName(t["candidates"].where("auto_approved").select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id")))


def pg03(t: Tables, p: Parameters) -> DataFrame:
    return t["batches"].where("status = 'committed' AND (commit_key IS NULL OR committed_at IS NULL)").select("batch_id")


def pg04(t: Tables, p: Parameters) -> DataFrame:
    return t["batches"].where("status IN ('approved', 'rejected', 'committed') AND (reviewer_id IS NULL OR reviewed_at IS NULL)").select("batch_id")


def pg05(t: Tables, p: Parameters) -> DataFrame:
    b = t["batches"].select("batch_id")
    n = {name: t[name].count() + b.count() for name in ("candidates", "events")}
    orphans = lambda name, key: dealt(t[name].select("batch_id", key), n[name], "batch_id").join(dealt(b, n[name], "batch_id"), "batch_id", "left_anti").select(F.lit(name).alias("kind"), F.col(key).alias("id"))
    return orphans("candidates", "candidate_id").unionByName(orphans("events", "event_id"))


def pg06(t: Tables, p: Parameters) -> DataFrame:
    return t["batches"].where("status <> 'draft'").join(t["events"].select("batch_id").distinct(), "batch_id", "left_anti").select("batch_id")


def pg07(t: Tables, p: Parameters) -> DataFrame:
    done = t["events"].where("event_type = 'committed'").select("batch_id").distinct()
    return t["batches"].where((F.col("batch_id") == p["batch_id"]) & (F.col("status") == "committed")).join(done, "batch_id", "left_semi").select("batch_id")


QUERIES: dict[str, Callable[[Tables, Parameters], DataFrame]] = {
    "T01": t01, "T02": t02, "T03": lambda t, p: leaf(t, p, "khoan"), "T04": lambda t, p: leaf(t, p, "dieu"), "T05": t05, "T06": t06, "T07": no_active, "T08": no_active, "T09": t09, "T10": t10, "T11": t11, "T12": t12, "T13": t13, "T14": t14, "T15": t15,
    "T16": t16, "T17": t17, "T18": t18, "T19": t19, "T20": t20, "N01": n01, "N02": n02, "PG01": pg01, "PG02": pg02, "PG03": pg03, "PG04": pg04, "PG05": pg05, "PG06": pg06, "PG07": pg07,
}
EMPTY = ("T09", "T10", "T17", "T19", "T20", "N02", "PG01", "PG02", "PG03", "PG04", "PG05", "PG06")


def assertion_failures(rows: list[dict], assertions: list[dict]) -> list[str]:
    """Which assertions (type, field, value) the rows of a small result break."""
    out = []
    for a in assertions:
        kind, name, value = a["type"], a.get("field"), a.get("value")
        field = [r.get(name) for r in rows] if name else []
        ok = {
            "empty": lambda: not rows,
            "nonempty": lambda: bool(rows),
            "row_count": lambda: len(rows) == value,
            "field_equals": lambda field=field, value=value: bool(field) and all(x == value for x in field),
            "field_nonempty": lambda field=field: bool(field) and all(field),
            "field_set_equals": lambda field=field, value=value: {tuple(x) if isinstance(x, list) else x for x in field} == set(value),
            "all": lambda a=a: not assertion_failures(rows, a["of"]),
        }[kind]()
        if not ok:
            out.append(f"{kind} {name or ''}".strip())
    return out
