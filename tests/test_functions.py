import datetime
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from registra.functions import scalars as S


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_amounts(spark):
    cases = ["1.234.567,89", "1,234,567.89", "1200", "ALL 2.500,5", "EUR 1,000.10", "", None, "n/a", "-12,50", "1.000", "12.345", "1,5", "7.", "0.005"]
    want = ["1234567.89", "1234567.89", "1200", "2500.50", "1000.10", None, None, None, "-12.50", "1000", "12345", "1.50", "7", "5"]
    assert values(spark, cases, S.parse_amount) == [None if w is None else Decimal(w) for w in want]


def test_currencies(spark):
    cases = [("12", "EUR"), ("12", "Monedha Lek"), ("12 €", None), ("$ 3", ""), ("12", None), ("12", "CHF"), ("12 all", "CHF"), (None, "all"), ("1", "usd")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, c string")
    got = [r[0] for r in df.orderBy("i").select(S.detect_currency(F.col("a"), F.col("c"))).collect()]
    assert got == ["EUR", "ALL", "EUR", "USD", "ALL", None, "ALL", "ALL", "USD"]
    assert values(spark, ["all ", "eur", "CHF", None], S.storage_currency) == ["ALL", "EUR", None, None]


def test_dates(spark):
    d = datetime.date
    assert values(spark, ["2024-02-29", "2023-02-29", "2024-2-1", None, " 2024-01-02 "], S.strict_iso_date) == [d(2024, 2, 29), None, None, None, d(2024, 1, 2)]
    assert values(spark, ["31/12/2025", "1.2.2025", "31-02-2025", "2025-03-04", "x"], S.export_date) == [d(2025, 12, 31), d(2025, 2, 1), None, d(2025, 3, 4), None]
    assert values(spark, ["dt. 5.6.24", "dt. 5.6.31", "5.6.20245", "nr 3"], S.numeric_date) == [d(2024, 6, 5), d(1931, 6, 5), d(2024, 6, 5), None]
    assert values(spark, ["on 1.13.2024", "2024/5/6"], S.free_text_date) == ["2024-13-01", "2024-05-06"]
    assert values(spark, ["Jan 5, 2024", "5 Nëntor, 2023", "5 Foo 2023"], S.month_name_date) == [d(2024, 1, 5), d(2023, 11, 5), None]
    assert values(spark, ["https://x/2024/03/04/a", "https://x/20240506112233_a.pdf", "https://x/040320241200-050320241200.pdf", "https://x/"], S.url_date) == [d(2024, 3, 4), d(2024, 5, 6), d(2024, 3, 5), None]


def test_text(spark):
    assert values(spark, ["  Vendim Nr. 12 – Këshilli", "", None], S.normalize_title) == ["vendim nr 12 keshilli", "", ""]
    assert values(spark, ["Vau i Dejës", "  --Çorovodë--"], S.slugify) == ["vau-i-dejes", "corovode"]
    assert values(spark, ["Vau i Dejës"], S.legacy_key) == ["vauidejes"]
    assert values(spark, ["ab/12 cd", None], S.normalize_procedure_id) == ["AB-12-CD", ""]
    assert values(spark, ["Nr. 7", "", None], S.normalize_decision_number) == ["nr7", "n", "n"]
    assert values(spark, ["a" * 700, " a\x01 b "], S.clean_text) == ["a" * 599 + "...", "a b"]
    assert values(spark, ["konsultime-publike", '"Vendime"', "x"], S.canonical_category) == ["Konsultime publike", "Vendime", None]
    assert values(spark, ["03310000-5", "x"], S.cpv_group) == ["03", None]
    assert values(spark, ["Yes", "0", "maybe", None], S.flag) == [True, False, False, False]


def test_fold_agrees_with_nfkd(spark):
    text = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    assert text.where(S.fold(F.col("text")) != S.nfkd_fold(F.col("text"))).count() == 0
    assert len(S.FOLD_FROM) == len(S.FOLD_TO) and all(unicodedata.normalize("NFKD", c)[0] for c in S.FOLD_FROM)


def test_urls(spark):
    base = F.lit("https://a.al/x/y.html?q=1")
    hrefs = ["https://b.al/z", "//c.al/z", "/p", "q.pdf", "#top", "mailto:a@b", "?p=2", None]
    assert values(spark, hrefs, lambda c: S.absolute_url(base, c)) == ["https://b.al/z", "https://c.al/z", "https://a.al/p", "https://a.al/x/q.pdf", None, None, "https://a.al/x/y.html?p=2", None]
    assert values(spark, ["https://WWW.A.al./x", "bad url"], S.compare_host) == ["a.al", None]
    assert values(spark, ["https://a.al/x.PDF", "https://a.al/?download=1", "https://a.al/x.html"], S.is_document_url) == [True, True, False]
    assert values(spark, ["https://a.al/x.docx", "https://a.al/get?f=y.pdf", "https://a.al/x"], S.attachment_ext) == ["docx", "pdf", None]
    assert values(spark, ["https://a.al/a/b_c-d.pdf"], S.filename_title) == ["b c d"]


def test_attachment_types(spark):
    rows = [(b"%PDF-1.7", "pdf"), (b"%PDF-1.7", "docx"), (b"PK\x03\x04zz", "docx"), (b"PK\x03\x04zz", None), (b"hello", "pdf"), (bytes.fromhex("D0CF11E0A1B11AE1"), "doc")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b binary, d string")
    assert [r[0] for r in df.orderBy("i").select(S.detect_attachment_type(F.col("b"), F.col("d"))).collect()] == ["pdf", None, "docx", "zip", None, "doc"]


@pytest.mark.parametrize(("score", "want"), [(0, 0.0), (-3, 0.0), (1, 0.05), (110, 0.5), (500, 0.99)])
def test_confidence(spark, score, want):
    assert spark.range(1).select(S.confidence_from_score(F.lit(score))).first()[0] == want
