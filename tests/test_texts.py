import hashlib
import hmac
import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from juristream.functions import arrow
from juristream.functions import text as T
from juristream.sources import files, legal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    cases = [
        (T.canonical(F.lit(" a  b\n\tc ")), "a b c"),
        (T.document_number(F.lit(" 15 /2020 /NĐ - CP ")), "15/2020/ND-CP"),
        (T.lineage_id(F.lit("X"), F.lit("5"), F.lit("2"), F.lit("A)")), "X::D5.K2.Pa"),
        (T.parent_lineage(F.lit("X/1::D5.K2.Pa")), "X/1::D5.K2"),
        (T.parent_lineage(F.lit("X/1::D5")), None),
        (T.plain_lower(F.lit("Điều Khoản ƯỜ")), "dieu khoan uo"),
        (T.document_numbers(F.lit("theo 15/2020/NĐ-CP và 15/2020/nđ-cp")), ["15/2020/NĐ-CP"]),
        (T.legal_identifiers(F.lit("xem 15/2020/ND-CP::D5.K2.Pa.")), ["15/2020/ND-CP::D5.K2.Pa"]),
        (T.contains_term(F.lit("thue gtgt"), F.lit("thu")), False),
        (T.contains_term(F.lit("nop thu phi"), F.lit("thu")), True),
        (T.numeric_consistency(F.lit("phạt 5 triệu"), F.lit("phạt 50 triệu")), "mismatch_soft"),
        (T.numeric_consistency(F.lit("phạt"), F.lit("phạt 50 triệu")), "contradiction"),
        (T.normalized_claim(F.lit("Phạt 1.000,5 Đồng_x!")), "phạt 1.000,5 đồng x"),
        (T.natural_key(F.lit("Điều 10")) > T.natural_key(F.lit("Điều 9")), True),
        (T.segments(F.lit("- Một câu dài đủ. Hai câu cũng đủ!\nn")), ["Một câu dài đủ.", "Hai câu cũng đủ!"]),
        (T.strip_html(F.lit("<p>a &amp; b</p><script>var x='</p>'</script><b>c</b>")), "a & b\nc"),
        (T.same_document_number(F.lit("15/NĐ-CP"), F.lit("15/2020/NĐ-CP")), True),
        (T.text_quality(F.lit("")), 0.0),
        (T.text_quality(F.lit(None).cast("string")), 0.0),
        (T.question_terms(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), ["a b c", "a b", "b c", "a", "b", "c"]),
        (T.word_ngrams(F.array(F.lit("a")), 2), []),
        (T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 1.0),
    ]
    for n, (column, want) in enumerate(cases):
        assert one(spark, column) == want, n


def test_amounts(spark):
    assert [str(x) for x in one(spark, T.amounts(F.lit("từ 1.500.000 đồng đến 2,5 triệu và 10 %, 3 ngày")))] == ["1500000.000000", "2500000.000000", "0.100000"]


def test_hashes(spark):
    assert one(spark, T.uuid5(F.lit("name:x"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "name:x"))
    assert one(spark, T.hmac_sha256("key", F.lit("tác giả"))) == hmac.new(b"key", "tác giả".encode(), hashlib.sha256).hexdigest()
    assert one(spark, T.checksum(F.lit("a  b"))) == hashlib.sha256(b"a b").hexdigest()


def test_event_times(spark):
    got = [str(one(spark, T.event_time(F.lit(x)))) for x in ("2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 +0000", "02/01/2024 10:04", "nonsense")]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:00", "None"]


def test_arrow(spark):
    assert one(spark, arrow.token_ratio(F.lit("a b c d"), F.lit("a b x d"))) == 0.75
    assert one(spark, arrow.claim_similarity(F.lit(""), F.lit("a"))) == 0.0
    assert [h["type"] for h in one(spark, arrow.token_diff(F.lit("a b"), F.lit("a c")))] == ["equal", "replace"]
    assert one(spark, arrow.repair_encoding(F.lit("Ä\x90iá»\x81u"))) == "Điều"
    assert one(spark, arrow.decode_bytes(F.lit(bytearray("Điều".encode("utf-16"))))) == "Điều"


def test_quality(spark):
    clean = "Điều 1. Phạm vi điều chỉnh. Nghị định này quy định về lệ phí hộ tịch."
    garbage = "N2lw5 w5Sie2 %^ S S Mã hàng 615.90.00 ÿÄ ÄÃỐ . ~ Í ÕỔ Ổ MM-¬GÌ"
    cases = [clean, garbage, "a" * 19, "a" * 20, "a" * 92 + "." * 8, "a" * 85 + "_" * 7 + "-" * 8, "a" * 90 + " . " * 10, "\ufffd" * 2 + "a" * 30, "\u00a0" + "đ" * 21 + " ", None, "x^" * 15]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", T.text_quality(F.col("t")).alias("q"), T.readable(F.col("t")).alias("r")).collect()
    got = {r["i"]: r["q"] for r in rows}
    assert got[0] > got[1]
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(arrow.quality(c or ""), abs=1e-12), i
    assert (got[2], got[3], got[4]) == (0.0, 1.0, pytest.approx(0.92 - 0.15))
    assert [r["r"] for r in sorted(rows)][:5] == [True, True, False, True, False]


def test_decoding(spark, sf_dir):
    assert arrow.decoded("Điều 40. Nội dung miễn lệ phí hộ tịch.".encode()) == "Điều 40. Nội dung miễn lệ phí hộ tịch."
    assert arrow.decoded("Nghị định số 168/2024/NĐ-CP".encode()) == "Nghị định số 168/2024/NĐ-CP"
    for encoding in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be"):
        assert arrow.decoded("<p>x</p> Điều".encode(encoding)) == "<p>x</p> Điều"
    assert arrow.decoded("Café déjà vu à la carte".encode("latin-1")) == "Café déjà vu à la carte"
    assert (arrow.decoded(b""), arrow.decoded(b"\x00")) == ("", "\x00")
    assert arrow.mended("Miễn".encode().decode("latin-1")) == "Miễn"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").union(spark.read.parquet(f"{sf_dir}/pages.parquet").select("html")).where("text IS NOT NULL")
    assert texts.where(arrow.decode_bytes(F.encode("text", "UTF-8")) != F.col("text")).count() == 0


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as package:
        package.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Điều 1')}{table}{p('hai')}</w:body></w:document>")
    rows = spark.createDataFrame([("x/y.docx", bytearray(raw.getvalue())), ("bad.docx", bytearray(b"PK")), ("z.pdf", bytearray(b"%PDF"))], "path string, content binary").withColumn("checksum", F.lit("c"))
    assert {r["path"]: r["text"] for r in files.extract_text(rows).collect()} == {"x/y.docx": "Điều 1\na | b\nhai", "bad.docx": None, "z.pdf": None}


def test_parser(spark):
    text = "Mở đầu\nĐiều 1. Phạm vi\n1. Khoản một\ntiếp theo\na) điểm a\nĐiều 2. Hiệu lực"
    rows = legal.parse_documents(spark.createDataFrame([("d", text), ("long", "x " * 300), ("none", None)], "doc string, text string")).collect()
    assert [(r["level"], r["article"], r["clause"], r["point"], r["text"]) for r in rows if r["doc"] == "d"] == [("dieu", "1", None, None, "Phạm vi"), ("khoan", "1", "1", None, "Khoản một tiếp theo"), ("diem", "1", "1", "a", "điểm a"), ("dieu", "2", None, None, "Hiệu lực")]
    assert [r["level"] for r in rows if r["doc"] == "long"] == ["dieu", "khoan"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/15_2020.txt").write_text("Số hiệu: 15/2020/NĐ-CP\nNgày ban hành: 03/02/2020\nThân bài\n=====\nhai", encoding="utf-8")
    (tmp_path / "a/p.html").write_text("<p>x</p>", encoding="utf-8")
    parts = files.split_files(spark, str(tmp_path / "a/15_2020.txt"))
    assert parts.count() == 2
    head = files.headed_texts(parts.where("part = 0")).first()
    assert (head["number_norm"], str(head["issued"]), head["body"]) == ("15/2020/ND-CP", "2020-02-03", "Thân bài")
    found = files.binary_files(spark, str(tmp_path / "a"))
    assert {r["kind"]: r["text"] for r in files.extract_text(found).collect()}["html"] == "x"
    sink = str(tmp_path / "sink")
    files.add_objects(found, sink)
    files.add_objects(found, sink)
    assert spark.read.parquet(sink).count() == 2
    (tmp_path / "f.xml").write_text("<rss><item><title>T</title><description>&lt;b&gt;D&lt;/b&gt;</description><link>u</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></rss>", encoding="utf-8")
    assert files.feed(spark, str(tmp_path / "f.xml")).select("title", "link").first() == ("T", "u")
    (tmp_path / "g.json").write_text('{"cases": [{"case_id": "1"}, {"case_id": "1"}]}', encoding="utf-8")
    with pytest.raises(ValueError):
        files.gold(spark, str(tmp_path / "g.json"), "case_id string")
