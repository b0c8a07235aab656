"""Small talk: each phrase that makes a question one, and a near miss of each."""

import pytest
from pyspark.sql import functions as F

from juristream.functions import dialogue as D
from juristream.functions import text as T

NEAR_MISSES = [
    "bạn là người nộp thuế", "bạn là trợ", "may là mẫu", "ai là người nộp", "model năm sản xuất", "what modelling", "who are they", "bạn tên của", "bạn gọi cho", "xin chaos", "helloworld", "hit", "heyday", "cảm ơn".replace("ơn", "động"), "mức phạt nồng độ cồn ai thank",
    "thank ai you", "byen", "tạm biết ơn".replace("biết", "biên"), "bạn có thể giúp tôi tính thuế thu nhập cá nhân", "bạn có thể làm hồ sơ hoàn thuế", "hướng dẫn sử", "hướng dẫn nộp thuế", "bạn biết luật thuế",
]


@pytest.mark.parametrize("accented", ["Bạn là ai?", "Xin chào", "cảm ơn nhé", "Tạm biệt!", "bạn là trợ lý à", "bạn có thể giúp gì", "Bạn có thể làm gì cho tôi", "hướng dẫn sử dụng", "bạn biết tiếng Anh không", "bạn tên là gì", "Thank you", "thanks", "BYE"])
def test_as_people_write_it(spark, accented):
    assert spark.range(1).select(D.small_talk(F.lit(accented))).first()[0]


def test_each_phrase_and_near_misses(spark):
    rows = [(f"thuế thu nhập {p} nghị định thuế", True) for p in D.TALK] + [(f"thuế thu nhập {p} nghị định thuế", False) for p in NEAR_MISSES]
    rows += [(f"{p} 15/2020/NĐ-CP", False) for p in D.TALK] + [("bạn có thể giúp tôi tính thuế thu nhập cá nhân", False)]
    got = spark.createDataFrame(rows, "q string, want boolean").withColumn("got", D.small_talk(F.col("q")))
    assert [r["q"] for r in got.where("got <> want OR got IS NULL").collect()] == []


def test_quality_of_odd_texts(spark):
    """Trimming, letters, odd characters, runs and dots, character by character."""
    import re

    space = T.JAVA_SPACE + T.MORE_SPACE
    letters, marks = re.compile(f"[{T.LETTERS}]"), re.compile(rf"[\w\s{T.LETTERS}{T.MARKS}]")

    def plain(text):
        t = (text or "").strip(space)
        n = max(1, len(t))
        if len(t) < 20:
            return 0.0
        odd = sum(not marks.match(c) and c not in space for c in t)
        value = sum(bool(letters.match(c)) for c in t) / n - 2 * odd / n - 0.05 * t.count("�") - 0.15 * any(8 * c in t for c in "._-") - (0.2 if t.count(".") / n > 0.08 else 0.0)
        return max(0.0, min(1.0, value))

    texts = [None, "", " " * 30, "　\x1c Nghị định này quy định chi tiết  ", "a.b.c.d.e.f.g.h.i.j.k.l.m.n.o", "chữ ........ và ________ rồi --------", "......a......b" * 3, "�� những chữ bị hỏng ở đây �", "☃☂ snow and umbrellas ☃☂ all over", "x" * 19, "x" * 20, "÷× câu này có dấu lạ ÷×"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.text_quality(F.col("t")).alias("q"), T.readable(F.col("t")).alias("r")).collect()
    assert {r["i"]: round(r["q"], 9) for r in got} == {i: round(plain(t), 9) for i, t in enumerate(texts)}
    assert [r["r"] for r in sorted(got)][:4] == [False, False, False, True] and not sorted(got)[5]["r"]
