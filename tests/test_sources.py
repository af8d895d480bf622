"""Stored layouts, vendor files, profiles and writers on small tables."""

import hashlib
import json

import pytest

from matchloom.operators import vectors as V
from matchloom.sources import pricelists as P
from matchloom.sources import writers as W

ROWS = "file string, sheet string, row_no long, cells array<string>"
LAYOUT = "signature string, sheet string, data_start_row int, col_article int, col_name int, col_price_base int, col_multiplicity int, brand string, brand_column int, skip_row_if_empty_col int, category_col int, nds_included boolean, nds_rate double"


def test_stored_layout(spark):
    rows = spark.createDataFrame([
        ("a", "price", 1, ["Article", "Name", "Price"]),
        ("a", "Price", 1, ["Article", "Name", "Price"]),
        ("a", "Price", 2, [" A1 ", "x\ny", "1 120,0", "10.9", "Own", "cat"]),
        ("a", "Price", 3, ["A2", None, "0", "x", " ", ""]),
        ("a", "Price", 4, ["A3", "no skip cell"]),
        ("a", "Price", 5, [None, "no article", "5", "1", "b", "c"]),
        ("a", "Price", 6, ["A6", "n", "112", None, "B", "c"]),
        ("a", "price", 7, ["A7", "other sheet", "5", "1", "b", "c"]),
        ("b", "PRICE", 3, ["B1", "n", "10", "1", "b", "c"]),
        ("c", "Price", 3, ["no layout"]),
    ], ROWS)
    layouts = spark.createDataFrame([("a", "Price", 2, 1, 2, 3, 4, "Fixed", 5, 4, 6, True, None), ("b", "Price", 2, 1, 2, 3, None, "Fixed", None, None, None, None, 0.5)], LAYOUT)
    got = sorted(tuple(r) for r in P.parse_mapped(rows, layouts).select("file", "article", "name", "unit", "multiplicity", "brand", "price_base", "category").collect())
    assert got == [
        ("a", "A1", "x y", "шт", 10, "Own", 1000.0, "cat"),
        ("a", "A2", "", "шт", None, None, None, None),
        ("a", "A3", "no skip cell", "шт", None, None, None, None),
        ("b", "B1", "n", "шт", None, "Fixed", 10.0, None),
    ]
    assert P.parse_mapped(rows.limit(0), layouts).collect() == []
    assert P.parse_mapped(rows, layouts).columns == ["file", "row_no", *P.ITEM_COLUMNS]


def cells(width, **at):
    return [at.get(f"c{k}") for k in range(1, width + 1)]


def test_vendor_with_two_sheets(spark):
    row = lambda sheet, no, article, name="n", **more: ("f", sheet, no, cells(11, c1=article, c2=name, **more))
    rows = spark.createDataFrame([
        row("Новинки", 13, "E1", c7="112"), row("Новинки", 14, "E2", c7="224", c8="112", c9="56", c10="-", c11="3"),
        row("Продукция EKF", 12, "E9"), row("Продукция EKF", 20, "E1", c7="1,12"), row("Продукция EKF", 21, "E1", c7="5"), row("Продукция EKF", 22, "E3", " "),
    ], ROWS)
    got = sorted(tuple(r) for r in P.parse_vendor(rows, "ekf").select("article", "row_no", "price_base", "price_opt", "price_rrts", "price_partner", "multiplicity", "brand").collect())
    assert got == [("E1", 20, 1.0, None, None, None, None, "EKF"), ("E2", 14, 200.0, 100.0, 50.0, None, 3, "EKF")]


def test_discounts_are_those_of_the_file(spark):
    item = lambda file, no, article, group, price="1000": (file, "Тариф", no, cells(16, c2="77", c3=article, c4="n", c6=group, c16=price))
    disc = lambda file, no, group, value: (file, "Заказ", no, cells(5, c4=group, c5=value))
    rows = spark.createDataFrame([
        item("a", 5, None, "G1"), item("a", 6, "0000123", "G2"), item("a", 7, "X", "G3"), item("b", 5, "Y", "G1"), item("a", 8, "Z", "G1", "0"),
        disc("a", 1, "G1", "0.1"), disc("a", 3, "G1", "0.25"), disc("a", 2, "G2", "0"), disc("a", 11, "G3", "0.5"), disc("b", 1, "G9", "0.5"),
    ], ROWS)
    got = sorted(tuple(r) for r in P.parse_vendor(rows, "legrand").select("file", "article", "price_base", "price_partner", "category").collect())
    assert got == [("a", "000077", 1000.0, 750.0, "G1"), ("a", "000123", 1000.0, None, "G2"), ("a", "X", 1000.0, None, "G3"), ("a", "Z", None, None, "G1"), ("b", "Y", 1000.0, None, "G1")]


def test_profile_and_its_fingerprint(spark):
    rows = spark.createDataFrame([("f", f"s{k}", no, ["a", None, " "] if no < 3 else [" "]) for k in range(6) for no in range(1, 4)] + [("f", "s0", 16, ["late"])], ROWS)
    profile = P.snapshot(rows)
    assert sorted((r.sheet, r.rows_with_data, len(r.preview)) for r in profile.collect()) == [("s0", 3, 2), ("s1", 2, 2), ("s2", 2, 2), ("s3", 2, 2)]
    part = lambda name, n: {"sheet": name, "rows_with_data": n, "preview": [{"row": no, "cells": [{"col": 1, "text": "a"}]} for no in (1, 2)]}
    want = json.dumps([part("s0", 3), part("s1", 2)], separators=(",", ":"))
    assert P.signature(profile).first().signature == hashlib.md5(want.encode()).hexdigest()
    later = P.signature(P.snapshot(rows.where("sheet not in ('s4', 's5')")))
    assert later.first().signature == P.signature(profile).first().signature


def test_stored_layouts_are_saved_once_and_dropped_on_failure(spark):
    old = spark.createDataFrame([(1, "x", "2024-01-01"), (2, "x", "2024-02-01")], "id int, signature string, created_at string")
    new = spark.createDataFrame([(3, "x", "2024-03-01"), (4, "y", "2024-03-01")], old.schema)
    saved = P.save_mapping(old, new)
    assert sorted(r.id for r in saved.collect()) == [1, 2, 4]
    assert sorted(r.id for r in P.latest_mappings(saved).collect()) == [2, 4]
    assert [r.id for r in P.invalidate_mappings(saved, spark.createDataFrame([("x",)], "signature string")).collect()] == [4]


def test_writers(spark, tmp_path):
    catalog = spark.createDataFrame([(k, None if k % 3 == 0 else 0 if k % 3 == 1 else k, f"a{k}", None, 0.0, k != 2) for k in range(9000, 0, -1)], "id long, num long, article string, brand string, opt double, is_active boolean")
    W.write_catalog(catalog, f"{tmp_path}/catalog")
    got = {r.id: r.num for r in spark.read.parquet(f"{tmp_path}/catalog").collect()}
    order = sorted((r for r in catalog.collect() if r.is_active), key=lambda r: (r.num is None, r.num or 0, r.id))
    assert got == {r.id: r.num or place for place, r in enumerate(order, 1)}
    first = spark.read.parquet(f"{tmp_path}/catalog").first()
    assert first.brand == "" and first.opt is None


def test_a_batch_counts_once_and_only_when_committed(spark, tmp_path):
    from datetime import datetime

    from matchloom.sources import commits as C

    path = f"file://{tmp_path}/logs"
    rows = spark.createDataFrame([(1, "a.csv", "ok", 3, datetime(2024, 1, 1))], "id long, file string, status string, rows_added int, at timestamp")
    logs = W.log_rows(rows, "import", "file", "status", "at", "rows_added")
    assert W.read_logs(spark, path).collect() == []
    lost = C.prepare(logs, path, "2024-01-01")  # a job that died before its record
    assert W.read_logs(spark, path).collect() == []
    assert [W.append_logs(logs, path, "2024-01-01") for _ in range(3)] == [True, False, False]
    assert W.append_logs(logs.limit(0), path, "empty") and W.append_logs(logs, path, "next")
    assert not C.commit(spark, path, "2024-01-01", lost)  # and one that comes back late
    got = W.read_logs(spark, path).collect()
    assert [tuple(r)[:5] for r in got] == [("import", 1, "a.csv", "ok", 3)] * 2
    assert {r.batch for r in C.commits(spark, path).collect()} == {"2024-01-01", "empty", "next"}


def test_an_import_is_confirmed_once(spark, tmp_path):
    from matchloom.operators import changes as H

    cat = spark.createDataFrame([(1, "A", "n", "b", 100.0, None, None, "ss", True), (2, "B", "n", "b", 100.0, None, None, "ss", True)], "id long, article string, name string, brand string, rrts double, opt double, partner double, segment string, is_active boolean")
    inc = spark.createDataFrame([("A", "n", "b", None, 101.0, None, None), ("N", "x", None, 7.0, None, None, None)], "article string, name string, brand string, price_base double, price_rrts double, price_opt double, price_partner double")
    diff, path = H.price_diff(cat, inc, mark_missing=True), f"file://{tmp_path}/imports"
    assert H.confirmed_jobs(spark, path).collect() == []
    after = {r.article: (r.rrts, r.opt, r.is_active) for r in H.confirm_import(cat, diff, path, 1, "s").collect()}
    assert after == {"A": (101.0, None, True), "B": (100.0, None, False), "N": (None, 7.0, True)}
    with pytest.raises(ValueError):
        H.confirm_import(cat, diff, path, 1, "s")
    assert [tuple(r) for r in H.confirmed_jobs(spark, path).collect()] == [(1, "confirmed", 1, 1, 1, 1)]
    assert [(r.article, r.field, r.old_value, r.new_value) for r in H.confirmed_history(spark, path).collect()] == [("A", "rrts", 100.0, 101.0)]


def test_constants_sheet(spark):
    people = spark.createDataFrame([("Q", None, None, None, True), ("P", "x", "e", None, True), ("gone", None, None, None, False)], "full_name string, position string, email string, phone string, is_active boolean")
    brands = spark.createDataFrame([("b", 1.0, 1.0, 2.0, 1.0, 1.1, 0.8)], "brand string, margin double, logistics double, rate double, currency_rate double, nds double, gp double")
    currencies = spark.createDataFrame([("USD", 4.0), ("EUR", 5.0), ("KZT", 1.0)], "name string, rate double")
    got = [(r.row_no, r.full_name, r.position, r.brand, r.currency) for r in W.constants_sheet(people, brands, currencies).orderBy("row_no").collect()]
    assert got == [(2, "P", "x", "b", "EUR"), (3, "Q", "", None, "KZT"), (4, None, None, None, "USD")]


def test_hybrid_takes_the_chosen_product(spark):
    matches = spark.createDataFrame([(k, "exact" if k == 0 else "not_found", None, 7 if k == 0 else None, "") for k in range(7)], "item_id long, status string, match_method string, product_id long, kaznisa_code_raw string")
    catalog = spark.createDataFrame([(7, "ss", "247-201-0001"), (8, "os", "")], "id long, segment string, kaznisa_code string")
    decided = spark.createDataFrame([(1, "match", 8, None), (2, "ambiguous", None, 7), (3, "ambiguous", None, None), (4, "ambiguous", None, 99), (5, "match", 99, None)], "item_id long, decision string, id long, chosen_id long")
    none = spark.createDataFrame([], "item_id long, product_id long")
    got = {r.item_id: tuple(r)[1:] for r in V.hybrid(matches, none, catalog, decided).collect()}
    lost, unsure = ("not_found", None, None, False), ("not_found", None, None, True)
    assert got == {0: ("exact", None, 7, False), 1: ("ai_match", "ai_vector", 8, True), 2: ("ai_match", "ai_reranked", 7, True), 3: unsure, 4: lost, 5: lost, 6: lost}
