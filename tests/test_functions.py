"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as X


def run(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


CASES = [
    (lambda c: X.strip_brand(X.normalize(c)), "ВА47-29 1Р 16А IEK", "ВА47-29 1Р 16А"),
    (lambda c: X.strip_brand(X.normalize(c)), "ЩМП-3-0 IP31 IEK", "ЩМП-3-0 IP31"),
    (lambda c: X.strip_brand(X.normalize(c)), "ЩМП-3-0", ""),
    (X.strip_subitem, "1 / Корпус", "Корпус"),
    (X.strip_subitem, "2/ X", "X"),
    (X.normalize, " «abc» (x) – y  z ", "ABC X - Y Z"),
    (X.normalize, "кабель Ф1.2", "КАБЕЛЬ Ф1.2"),
    (X.normalize, "кабель №1.2", "КАБЕЛЬ №1.2"),
    (X.normalize, "lamp x w0.5", "LAMP X"),
    (X.normalize, "ABC -1.5", "ABC -1.5"),
    (X.normalize, "ABC #2.5", "ABC #2.5"),
    (X.normalize, None, ""),
    (X.strip_cyrillic, "АБ12-X", "12-X"),
    (X.strip_cyrillic, "АБ1", ""),
    (X.quantity, "0,29", 0.29),
    (X.quantity, "3500", 3500.0),
    (X.quantity, "1.5", 1.5),
    (X.quantity, "1 250 шт", 1250.0),
    (X.quantity, "", 1.0),
    (X.quantity, None, 1.0),
    (X.article_clean, "ТРОЙСТВО)", ""),
    (X.article_clean, "СПЛП", "СПЛП"),
    (X.article_clean, "пп–п", "ПП-П"),
    (X.pos_value, "12", "12"),
    (X.pos_value, "1.2", "1.2"),
    (X.pos_value, "ВРУ-1", "ВРУ-1"),
    (X.pos_value, "-", None),
    (X.pos_value, " ", None),
    (X.standard_ref, "ГОСТ 17", ""),
    (X.standard_ref, "ABC", "ABC"),
    (X.query_context, "- на вводе выключатель", "- на вводе выключатель"),
    (X.query_context, "на вводе выключатель", "выключатель"),
    (X.query_context, "Щит 24, в том числе:", "Щит 24"),
    (X.query_context, "на вводе", "на вводе"),
    (X.safe_float, "1 250,5", 1250.5),
    (X.safe_float, "-3", None),
    (X.safe_int, "10.9", 10),
    (X.safe_int, "x", None),
    (X.safe_str, " — ", None),
    (X.price_parse, "1 250,5 тг", 1250.5),
    (X.price_parse, "0", None),
    (X.pad_article, "77", "000077"),
    (X.pad_article, "A77", "A77"),
    (X.header_key, "Кол-\nво", "колво"),
    (X.method_label, "ai_vector", "ИИ"),
    (X.method_label, "other", "other"),
    (X.method_label, None, ""),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_golden(spark, k):
    fn, value, want = CASES[k]
    assert run(spark, fn, value) == want


def test_code_repair(spark):
    rows = [(["2 4 8", "шт"], "248"), (["Изм. лист", ""], ""), (["247-201", "-0108"], "247-201-0108"), (["247-201-0108", "247-202-0001"], "247-201-0108"), (["247", "шт"], "247"), ([], "")]
    got = spark.createDataFrame([(c,) for c, _ in rows], "cells array<string>").select(X.code_repair(F.col("cells"), 0).alias("r")).collect()
    assert [r.r for r in got] == [w for _, w in rows]


def test_vat_and_segments(spark):
    row = spark.range(1).select(X.vat_exclude(F.lit(112.0), F.lit(0.12), F.lit(True)).alias("a"), X.segments(F.lit("all")).alias("b"), X.segments(F.lit("os, xx")).alias("c"), X.segments(F.lit(None).cast("string")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (100.0, ["ss", "os", "sil"], ["os"], ["ss"])
