"""Checks of rows that belong together are dealt by their number, and links with null ids are no links."""

from juristream.operators import acceptance, contracts, lineage

ANSWER = "answer_id int, status string, as_of date, answer string, reason_code string"
CLAIM = "answer_id int, claim_id string, support_status string, citation_ids array<string>"
CITATION = "answer_id int, citation_id string, node_id string, lineage_id string, article string, clause string, point string, effective_from date, effective_to date, text_checksum string, source_checksum string, supports_claim_ids array<string>"


def test_parts_grow_with_rows_and_null_ids_are_unknown(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(contracts, "dealt", lambda df, rows, *keys: seen.append(rows) or lineage.dealt(df, rows, *keys, part=2))
    answers = spark.createDataFrame([(k, "answered", None, "text", None) for k in (1, 2, 3)], ANSWER)
    claims = spark.createDataFrame([(1, "c", "entailed", ["q", None]), (2, None, "entailed", ["q"]), (3, "c", "entailed", ["q", "q"]), (3, "c", "entailed", ["q"])], CLAIM)
    cited = lambda k, by: (k, "q", "n", "1/2020/X::D1", "1", None, None, None, None, "0" * 64, None, by)
    citations = spark.createDataFrame([cited(1, ["c"]), cited(2, [None]), cited(3, ["c"])], CITATION)
    got = {r["answer_id"]: set(r["reasons"]) - {"node_id_differs", "citation_not_in_force"} for r in contracts.citation_violations(answers, claims, citations).collect()}
    assert got == {1: {"unknown_citation"}, 2: {"unknown_claim", "claim_id_repeated"}, 3: {"citations_repeated", "claim_id_repeated"}}
    assert seen and set(seen) == {10}


def test_orphans_are_dealt_by_their_number(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(acceptance, "dealt", lambda df, rows, *keys: parts.append(-(-rows // 10)) or lineage.dealt(df, rows, *keys, part=10))
    rows = lambda n, name: spark.range(n).selectExpr(f"id AS {name}", "id % 4 AS batch_id")
    t = {"batches": spark.range(3).selectExpr("id AS batch_id"), "candidates": rows(40, "candidate_id"), "events": rows(8, "event_id")}
    got = sorted((r["kind"], r["id"]) for r in acceptance.QUERIES["PG05"](t, {}).collect())
    assert got == sorted([("candidates", i) for i in range(3, 40, 4)] + [("events", 3), ("events", 7)])
    assert set(parts) == {5, 2}
