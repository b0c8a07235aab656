"""Amendments: instructions in text, pairing of old and new versions, kinds of change, and commits that respect immutability."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristream.functions import arrow
from juristream.functions import text as T
from juristream.operators import graph
from juristream.operators.lineage import cut

# Words that mark legal matter, penalties, duties and permissions.
LEGAL_TERMS = ("cấm", "điều kiện", "hành vi", "miễn", "nghĩa vụ", "phạt", "phải", "quyền", "thời hạn", "xử phạt")
PENALTY = ("phạt", "xử phạt", "chế tài", "phạt tiền")
RESTRICTIVE = ("không được", "nghiêm cấm", "bị cấm", "phải", "nghĩa vụ")
PERMISSIVE = ("được miễn", "miễn", "không phải", "được phép")
# What each agreement of a pair weighs, and from which scores pairs count, are ambiguous, or need no review.
WEIGHTS = {"explicit": 0.35, "coordinate": 0.25, "level": 0.10, "lexical": 0.20, "numeric": 0.05, "terms": 0.05}
LEAST, AMBIGUOUS, REVIEW = 0.45, 0.72, 0.70


def change_type(old: Column, new: Column, similarity: Column, split: Column | None = None, merge: Column | None = None) -> Column:
    """struct(type, reason) of what a change does; anything without a safe direction is UNCERTAIN."""
    a, b = T.canonical(F.coalesce(old, F.lit(""))), T.canonical(F.coalesce(new, F.lit("")))
    x, y = T.amounts(a), T.amounts(b)
    penalty = T.contains_any(F.concat_ws(" ", a, b), PENALTY) & (F.size(x) > 0) & (F.size(y) > 0)
    hard_a, hard_b = T.contains_any(a, RESTRICTIVE), T.contains_any(b, RESTRICTIVE)
    soft_a, soft_b = T.contains_any(a, PERMISSIVE), T.contains_any(b, PERMISSIVE)
    one = F.lit(1)
    rules = [
        ((split if split is not None else one) > 1, "SPLIT", "one_old_matches_multiple_new"),
        ((merge if merge is not None else one) > 1, "MERGED", "multiple_old_match_one_new"),
        ((a == "") & (b != ""), "ADDED", "new_provision_without_old_pair"),
        ((a != "") & (b == ""), "REMOVED", "old_provision_without_new_pair"),
        (a == b, "UNCHANGED", "canonical_text_equal"),
        (penalty & (F.array_max(y) > F.array_max(x)), "TIGHTENED", "penalty_amount_increased"),
        (penalty & (F.array_max(y) < F.array_max(x)), "LOOSENED", "penalty_amount_decreased"),
        (hard_b & ~hard_a, "TIGHTENED", "restrictive_language_added"),
        (hard_a & ~hard_b, "LOOSENED", "restrictive_language_removed"),
        (soft_b & ~soft_a, "LOOSENED", "permission_or_exemption_added"),
        (soft_a & ~soft_b, "TIGHTENED", "permission_or_exemption_removed"),
        ((similarity >= 0.90) & (x == y), "REWORDED", "high_similarity_without_material_signal"),
        (x != y, "UNCERTAIN", "numeric_change_without_safe_legal_direction"),
    ]
    out = F.struct(F.lit("UNCERTAIN").alias("type"), F.lit("semantic_impact_requires_legal_review").alias("reason"))
    for condition, kind, reason in reversed(rules):
        out = F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def coordinate_score(a: str, b: str) -> Column:
    """1 for one lineage, .9 / .65 / .35 for equal article, clause and point / article and clause / article."""
    same = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return F.when(F.col(f"{a}.lineage_id") == F.col(f"{b}.lineage_id"), 1.0).when(same("article") & same("clause") & same("point"), 0.9).when(same("article") & same("clause"), 0.65).when(same("article"), 0.35).otherwise(0.0)


def term_set(text: Column) -> Column:
    body = F.lower(text)
    return F.filter(F.array(*map(F.lit, LEGAL_TERMS)), lambda t: F.contains(body, t))


#: What a score looks at, of a version.
SEEN = ("logical_vb_id", "article", "clause", "point", "lineage_id", "level", "text", "effective_from", "explicit")


def _kinds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions that agree in all that a score looks at are of one kind: the kinds (kind, SEEN, numbers, legal terms), and kind, provision_id."""
    kinds = cut(rows.select(*SEEN).distinct().withColumn("kind", F.monotonically_increasing_id()))
    same = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in SEEN])
    members = rows.alias("r").join(kinds.alias("k"), same).select("k.kind", "r.provision_id")
    return kinds.withColumn("numbers", T.number_set(F.col("text"))).withColumn("legal", term_set(F.col("text"))), members


def score_pairs(old: DataFrame, new: DataFrame, references: DataFrame | None = None, *, least: float = LEAST) -> DataFrame:
    """Pairs of old and new versions of one document with their scores, from `least` on.

    Without an explicit reference a pair only gets there if its articles are equal, so pairs are formed by document and article; versions
    that an instruction names also meet the rest of their document. Versions that look alike are scored once: kinds of versions meet, and their
    versions only join the pairs that count. The costly word comparison runs only on pairs that can still reach `least` with a perfect one.
    """
    if least <= 1 - WEIGHTS["explicit"] - WEIGHTS["coordinate"]:
        raise ValueError("below this score pairs of different articles would count too")
    if references is None:
        marked = old.withColumn("explicit", F.lit(0.0))
    else:
        ids = referenced(old, references).select("provision_id").distinct()
        marked = old.join(ids.withColumn("explicit", F.lit(1.0)), "provision_id", "left").na.fill(0.0, ["explicit"])
    (olds, of_old), (news, of_new) = _kinds(marked), _kinds(new.withColumn("explicit", F.lit(0.0)))
    o, n = olds.alias("o"), news.alias("n")
    document = F.col("o.logical_vb_id") == F.col("n.logical_vb_id")
    article = F.col("o.article") == F.col("n.article")
    both = [F.struct("o.*").alias("o"), F.struct("n.*").alias("n")]
    pairs = o.join(n, document & article).select(*both)
    if references is not None:
        pairs = pairs.union(olds.where("explicit = 1").alias("o").join(n, document & ~article).select(*both))
    pairs = pairs.select(
        *[F.col(f"{s}.{c}").alias(f"{t}_{c}") for s, t in (("o", "old"), ("n", "new")) for c in ("kind", "text", "effective_from", "level")],
        F.col("o.logical_vb_id").alias("document"),
        F.col("o.explicit").alias("explicit"),
        coordinate_score("o", "n").alias("coordinate"),
        (F.col("o.level") == F.col("n.level")).cast("double").alias("level"),
        T.jaccard(F.col("o.numbers"), F.col("n.numbers")).alias("numeric"),
        T.jaccard(F.col("o.legal"), F.col("n.legal")).alias("terms"),
    )
    bare = sum(F.col(k) * w for k, w in WEIGHTS.items() if k != "lexical")
    near = pairs.where(bare + WEIGHTS["lexical"] >= least - 1e-6).withColumn("lexical", arrow.token_ratio(F.col("old_text"), F.col("new_text")))
    total = sum(F.col(k) * w for k, w in WEIGHTS.items())
    scored = near.withColumn("score", F.least(F.lit(1.0), F.round(total, 6))).where(F.col("score") >= least)
    for side, members in (("old", of_old), ("new", of_new)):
        scored = scored.join(members.select(F.col("kind").alias(f"{side}_kind"), F.col("provision_id").alias(f"{side}_provision_id")), f"{side}_kind")
    sides = [f"{t}_{c}" for t in ("old", "new") for c in ("provision_id", "text", "effective_from", "level")]
    return scored.select(*sides, "document", "explicit", "coordinate", "level", "numeric", "terms", "lexical", "score")


def referenced(old: DataFrame, references: DataFrame) -> DataFrame:
    """Old versions that an instruction names, by lineage or by all coordinates: two equi-joins, not one on either."""
    by_lineage = references.where("target_lineage_id IS NOT NULL").select(F.col("target_lineage_id").alias("lineage_id"), "reference_id")
    whole = references.where("complete_coordinates").select("article", F.coalesce("clause", F.lit("")).alias("_k"), F.coalesce("point", F.lit("")).alias("_p"), "reference_id")
    one = old.join(by_lineage, "lineage_id").select("provision_id", "reference_id")
    keyed = old.select("provision_id", "article", F.coalesce("clause", F.lit("")).alias("_k"), F.coalesce("point", F.lit("")).alias("_p"))
    return one.union(keyed.join(whole, ["article", "_k", "_p"]).select("provision_id", "reference_id")).distinct()


def greedy_pairs(scored: DataFrame, *, left: str = "old_provision_id", right: str = "new_provision_id", group: str = "document", score: str = "score") -> DataFrame:
    """One-to-one pairs as walking all pairs by (falling score, left, right) and skipping what is used would choose them.

    A pair that is the first of both its sides is always chosen by that walk; taking all such pairs and repeating on the rest gives the
    same result, some windows a round, whatever the size of a group. Each round chooses at least each group's best pair, and is checkpointed.
    """
    order = [F.desc(score), F.col(left), F.col(right)]
    w = lambda side: Window.partitionBy(group, side).orderBy(*order)
    rest, rounds = cut(scored), []
    while True:
        marked = rest.withColumn("_l", F.row_number().over(w(left))).withColumn("_r", F.row_number().over(w(right)))
        best = cut(marked.where("_l = 1 AND _r = 1").drop("_l", "_r"))
        if best.isEmpty():
            break
        rounds.append(best)
        rest = cut(rest.join(best.select(group, left), [group, left], "left_anti").join(best.select(group, right), [group, right], "left_anti"))
    chosen = scored.limit(0)
    for one in rounds:
        chosen = chosen.unionByName(one)
    return chosen


def match(old: DataFrame, new: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Chosen pairs with kind of change, reasons and review route; a side with several strong partners is SPLIT or MERGED."""
    scored = score_pairs(old, new, references)
    strong = F.count_if(F.col("score") >= AMBIGUOUS)
    counted = scored.withColumn("split", strong.over(Window.partitionBy("old_provision_id"))).withColumn("merge", strong.over(Window.partitionBy("new_provision_id")))
    pairs = greedy_pairs(counted)
    kind = change_type(F.col("old_text"), F.col("new_text"), F.col("lexical"), F.greatest(F.lit(1), F.col("split")), F.greatest(F.lit(1), F.col("merge")))
    pairs = pairs.withColumn("change", kind)
    later = F.col("new_effective_from") <= F.col("old_effective_from")
    reasons = F.array_compact(
        F.array(
            F.col("change.reason"),
            F.when(F.col("explicit") == 0, F.lit("no_explicit_reference_for_selected_old")),
            F.when(F.col("level") == 0, F.lit("provision_level_changed")),
            F.when(later, F.lit("non_increasing_effective_date")),
        )
    )
    must = (F.col("score") < REVIEW) | F.col("change.type").isin("SPLIT", "MERGED", "UNCERTAIN") | later
    match_id = F.concat(F.lit("amendment_match_"), F.substring(F.sha2(F.concat("old_provision_id", F.lit("\0"), "new_provision_id"), 256), 1, 16))
    return pairs.select(
        match_id.alias("match_id"), "document", "old_provision_id", "new_provision_id", "score", *WEIGHTS, F.col("change.type").alias("change_type"), reasons.alias("reason_codes"), F.when(must, "mandatory_review").otherwise("standard_review").alias("review_route")
    )


def unmatched(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """provision_id, change_type: REMOVED old and ADDED new versions without a pair."""
    gone = old.join(pairs.select(F.col("old_provision_id").alias("provision_id")), "provision_id", "left_anti").select("provision_id", F.lit("REMOVED").alias("change_type"))
    come = new.join(pairs.select(F.col("new_provision_id").alias("provision_id")), "provision_id", "left_anti").select("provision_id", F.lit("ADDED").alias("change_type"))
    return gone.unionByName(come)


# How instructions are worded.
ACTION = re.compile(r"sửa\s*đổi\s*,?\s*bổ\s*sung|sửa\s*đổi|bổ\s*sung|thay\s*thế|bãi\s*bỏ", re.I)
ARTICLE = re.compile(r"\bđiều\s+([0-9]+[a-zđ]?)\b", re.I)
CLAUSE = re.compile(r"\bkhoản\s+([0-9]+[a-zđ]?)\b", re.I)
POINT = re.compile(r"\bđiểm\s+([a-zđ])\b", re.I)
PHRASE = re.compile(r"(?:thay\s*thế|thay)\s+(?:cụm\s+từ\s+)?[\"“](.+?)[\"”]\s+bằng\s+(?:cụm\s+từ\s+)?[\"“](.+?)[\"”]", re.I | re.S)
SEVERAL = re.compile(r"\b(?:điểm|khoản|điều)\s+[0-9a-zđ]+\s*(?:,|và)\s*[0-9a-zđ]+", re.I)
STOPS = re.compile(r"[\n;]|(?<=[.!?])\s+(?=[A-ZÀ-Ỹ0-9])")
TAIL = 600
KINDS = {"bổ sung": "ADD", "thay thế": "REPLACE", "bãi bỏ": "REPEAL"}

INSTRUCTION = "doc string, reference_id string, action string, raw_text string, start int, end int, article string, clause string, point string, target_lineage_id string, old_phrase string, new_phrase string, multiple_targets boolean, complete_coordinates boolean"


def instructions_of(doc: str | None, text: str, target: str | None) -> Iterator[tuple]:
    for n, found in enumerate(ACTION.finditer(text), 1):
        tail = text[found.start() : found.start() + TAIL]
        stop = STOPS.search(tail)
        raw = (tail[: stop.start()] if stop else tail).strip(" \t\r\n:")
        if not raw:
            continue
        last = lambda p, raw=raw: (p.findall(raw) or [None])[-1]
        article, clause, point = (x.casefold() if x else None for x in (last(ARTICLE), last(CLAUSE), last(POINT)))
        phrase = PHRASE.search(raw)
        lineage = f"{target}::D{article}" + (f".K{clause}" + (f".P{point}" if point else "") if clause else "") if target and article else None
        kind = KINDS.get(" ".join(found[0].casefold().replace(",", " ").split()), "AMEND")
        yield doc, f"ref_{n}", kind, raw, found.start(), found.start() + len(raw), article, clause, point, lineage, phrase and phrase[1].strip(), phrase and phrase[2].strip(), bool(SEVERAL.search(raw)), article is not None


def parse_instructions(texts: DataFrame) -> DataFrame:
    """Amendment instructions in texts (doc, text, target): what each does to which provision; nothing is guessed. Rows are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in INSTRUCTION.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for d, t, g in zip(b["doc"], b["text"], b["target"], strict=True) if t for r in instructions_of(d, t, g)], columns=names)

    return texts.select("doc", "text", "target").mapInPandas(run, INSTRUCTION)


def commit_conflicts(operations: DataFrame, versions: DataFrame, edges: DataFrame) -> DataFrame:
    """operation_id, reasons of operations (operation_id, kind, old_id, old_checksum, new_id, new_checksum, review_status) that can't be committed.

    Each named version must exist exactly once with that checksum; an old one must be open, or closed where the new one begins, and without successor, a new one without
    predecessor; no version may be named twice; no edge may close a cycle; only accepted operations count.
    """
    known = versions.groupBy(F.col("provision_id").alias("_id"), F.col("text_checksum").alias("_sum")).agg(F.count("*").alias("_n"), F.max("effective_to").alias("_to"), F.min("effective_from").alias("_from"))
    o = operations
    for side in ("old", "new"):
        mine = known.select(F.col("_id").alias(f"{side}_id"), F.col("_sum").alias(f"{side}_checksum"), F.col("_n").alias(f"{side}_n"), F.col("_to").alias(f"{side}_to"), F.col("_from").alias(f"{side}_from"))
        o = o.join(mine, [f"{side}_id", f"{side}_checksum"], "left")
    out = edges.select(F.col("src").alias("old_id"), F.col("dst").alias("_next")).groupBy("old_id").agg(F.collect_set("_next").alias("next"))
    into = edges.select(F.col("dst").alias("new_id"), F.col("src").alias("_last")).groupBy("new_id").agg(F.collect_set("_last").alias("last"))
    loops = graph.would_close_cycle(edges, operations.where("kind = 'PAIRED'").select(F.col("old_id").alias("src"), F.col("new_id").alias("dst"))).select(F.col("src").alias("old_id"), F.col("dst").alias("new_id"), F.lit(True).alias("loop"))
    o = o.join(out, "old_id", "left").join(into, "new_id", "left").join(loops, ["old_id", "new_id"], "left")
    for side in ("old", "new"):
        o = o.withColumn(f"{side}_uses", F.count(f"{side}_id").over(Window.partitionBy(f"{side}_id")))
    needs_old, needs_new = F.col("kind").isin("PAIRED", "REMOVED"), F.col("kind").isin("PAIRED", "ADDED")
    foreign = lambda c, own: F.size(F.array_except(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array(own))) > 0
    reasons = F.array_compact(
        F.array(
            F.when(F.col("review_status") != "accepted", F.lit("not_accepted")),
            F.when(~F.col("kind").isin("PAIRED", "ADDED", "REMOVED"), F.lit("ambiguous_kind")),
            F.when(needs_old & ~F.col("old_n").eqNullSafe(1), F.lit("old_not_exactly_one")),
            F.when(needs_new & ~F.col("new_n").eqNullSafe(1), F.lit("new_not_exactly_one")),
            F.when(needs_old & F.col("old_id").isNotNull() & (F.col("old_uses") > 1), F.lit("old_used_twice")),
            F.when(needs_new & F.col("new_id").isNotNull() & (F.col("new_uses") > 1), F.lit("new_used_twice")),
            F.when((F.col("kind") == "PAIRED") & foreign("next", F.col("new_id")), F.lit("old_has_other_successor")),
            F.when((F.col("kind") == "PAIRED") & foreign("last", F.col("old_id")), F.lit("new_has_other_predecessor")),
            F.when((F.col("kind") == "PAIRED") & (F.col("new_from") <= F.col("old_from")), F.lit("new_not_later")),
            F.when((F.col("kind") == "PAIRED") & (F.col("old_to") != F.col("new_from")), F.lit("old_closed_otherwise")),
            F.when(F.coalesce("loop", F.lit(False)), F.lit("cycle")),
        )
    )
    return o.select("operation_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def commit(operations: DataFrame, versions: DataFrame, edges: DataFrame, removal_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """versions and edges after a batch of operations. All or nothing: raises if any operation conflicts. Committing again changes nothing."""
    bad = commit_conflicts(operations, versions, edges).limit(5).collect()
    if bad:
        raise ValueError(f"conflicts: {[(r['operation_id'], r['reasons']) for r in bad]}")
    starts = versions.select(F.col("provision_id").alias("new_id"), F.col("effective_from").alias("_end"))
    closes = operations.where("kind = 'PAIRED'").join(starts, "new_id").select(F.col("old_id").alias("provision_id"), "_end")
    if removal_date:
        closes = closes.union(operations.where("kind = 'REMOVED'").select("old_id", F.to_date(F.lit(removal_date))))
    after = versions.join(closes, "provision_id", "left").withColumn("effective_to", F.coalesce("_end", "effective_to")).select(versions.columns)
    added = operations.where("kind = 'PAIRED'").select(F.col("old_id").alias("src"), F.col("new_id").alias("dst"))
    return after, edges.select("src", "dst").union(added).distinct()


def reconcile(evidence: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id, code of commit evidence in the graph (batch_id, n_edges, key) against batches (batch_id, status, commit_key, expected)."""
    both = evidence.join(batches, "batch_id", "full")
    code = (
        F.when(F.col("status").isNull(), "graph_without_batch")
        .when((F.col("status") == "committed") & F.col("n_edges").isNull(), "committed_without_graph")
        .when((F.col("status") != "committed") & F.col("n_edges").isNotNull(), "graph_before_commit")
        .when(F.col("n_edges").isNull(), "nothing_to_do")
        .when(~F.col("key").eqNullSafe(F.col("commit_key")), "key_mismatch")
        .when(F.col("n_edges") != F.col("expected"), "count_mismatch")
        .otherwise("consistent")
    )
    return both.select("batch_id", code.alias("code"))
