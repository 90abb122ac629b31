"""Text functions on hand-made rows: Hangul, marks, blanks and nulls."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).first().x


def test_token_estimate(spark):
    assert one(spark, T.token_estimate, "한글 문서 abc def") == int(4 / 1.8 + 0.75 * 2)
    assert one(spark, T.token_estimate, "  ") == 0


def test_gate(spark):
    cases = {
        "": "empty", None: "empty", "=== [PAGE 3] ===": "page_marker", "a ..... 1 b ..... 2": "toc", "abc 1": "short",
        "abcdefghij" + "1" * 60: "few_letters", "ab" * 60: "monotone", "한글 문서의 내용은 길고 다양합니다": "ok"
    }
    for text, want in cases.items():
        assert one(spark, T.gate, text) == want, text


def test_filled_and_fallback(spark):
    for value, want in (("x", True), (" None ", False), ("없음", False), ("", False), (None, False), ("-", False)):
        assert one(spark, T.filled, value) == want
    rows = spark.createDataFrame([(None, " ", "c"), ("a", "b", None), (None, None, None)], "f string, o string, b string")
    got = [tuple(r) for r in rows.select(T.first_filled(F.col("f"), F.col("o"), F.col("b")), T.fallback_source(final=F.col("f"), ocr=F.col("o"), base=F.col("b"))).collect()]
    assert got == [("c", "base"), ("a", "final"), (None, "none")]


def test_highlight(spark):
    h = lambda c: T.highlight(c, "B")
    assert tuple(one(spark, h, "aab cc")) == (2, "aa«b» cc")
    assert tuple(one(spark, h, "none")) == (-1, "")


def test_uid_and_slug(spark):
    import hashlib

    assert one(spark, lambda c: T.document_uid(F.lit("s"), c), "p/q") == hashlib.sha1(b"s:p/q").hexdigest()
    assert one(spark, T.slug, "My Doc 1") == "my-doc-1-" + hashlib.md5(b"My Doc 1").hexdigest()[:8]


def test_quality_score_is_bounded(spark):
    score = lambda c: T.quality_score(c, F.lit(4), F.lit(1))
    assert one(spark, score, "한글" * 600) > one(spark, score, "(cid:12)" * 50)
    assert 0 <= one(spark, score, "") <= 1 and one(spark, score, "한글 " * 600) <= 1


def test_lines_and_keywords(spark):
    assert one(spark, audit.clean_lines, "1. One\n- One\n/abs/path\nx@y.z\nTwo\n=====") == "One\nTwo"
    assert one(spark, audit.keywords, "ab, cd, ab; e") == ["ab", "cd"]
    assert one(spark, audit.organisation_type, "어느 시") == "public" and one(spark, audit.organisation_type, "Acme GmbH") == "company"
