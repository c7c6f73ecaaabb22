import hashlib

from pyspark.sql import functions as F

from tracewell.functions import scores as S
from tracewell.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_rules(spark):
    lit = F.lit
    assert one(spark, T.normalize_text(lit("  A  B\tc "))) == "a b c"
    assert one(spark, T.normalize_text(lit(None).cast("string"))) == ""
    assert one(spark, T.keywords(lit("Hello, (World) abc a1b2 ÉCOLE"))) == ["hello", "world", "école"]
    assert one(spark, T.ref_codes(lit("see ABC-12, b1234567 and AB-1"))) == ["ABC-12", "B1234567"]
    assert one(spark, T.matched_codes(T.ref_codes(lit("abc-12")), lit("x-ABC-123.docx"), lit(""))) == ["ABC-12"]
    assert one(spark, T.page_count_estimate(lit(750))) == 2
    assert one(spark, T.page_count_estimate(lit(0))) == 1
    assert one(spark, T.file_size_label(lit(1536))) == "1.5 KB"
    assert one(spark, T.file_size_label(lit(0))) == "0 B"
    assert one(spark, T.classify_line(lit("ALL CAPS"))) == "heading"
    assert one(spark, T.classify_line(lit("1. item"))) == "list"
    assert one(spark, T.classify_block(lit("text"), lit(14), lit(False))) == "heading"
    assert one(spark, T.classify_styled(lit("x"), lit("Heading 1"))) == "heading"
    assert one(spark, T.classify_styled(lit(" "), lit(""))) == "blank"
    assert one(spark, T.merge_ocr(lit("ab"), lit("abc"))) == "abc"
    assert one(spark, T.is_scanned(lit("x" * 100), lit(1)))
    assert one(spark, T.canonical_path(lit("/a//b/./c/"))) == "/a/b/c"


def test_fingerprint(spark):
    empty = F.array().cast("array<string>")
    got = one(spark, T.fingerprint(F.lit("A  b"), F.array(F.lit("H")), empty, empty, empty, F.array().cast("array<struct<flat_text:string>>"), F.lit(1), F.lit(2)))
    assert got == hashlib.sha256(b"a b\nH:h\nP:\nL:\nHF:\nT:\nPAGES:1\nSECTIONS:2").hexdigest()


def test_scores(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    assert one(spark, S.count_ratio(F.lit(0), F.lit(0))) == 100
    assert one(spark, S.count_ratio(F.lit(1), F.lit(4))) == 25
    assert one(spark, S.jaccard(arr("a", "b"), arr("b", "c"))) == 100 / 3
    assert one(spark, S.header_footer_ratio(arr(), arr())) == 100
    assert one(spark, S.header_footer_ratio(arr("A "), arr("a"))) == 100
    assert one(spark, S.header_footer_ratio(arr(" "), arr("a"))) == 0
    assert one(spark, S.page_sequence_similarity(F.lit(1), F.lit(10))) == 60
    assert abs(one(spark, S.cosine(arr(1.0, 0.0), arr(1.0, 1.0))) - 70.7106781) < 1e-6
    assert one(spark, S.cosine(arr(0.0, 0.0), arr(1.0, 1.0))) == 0
