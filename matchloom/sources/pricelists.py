"""Supplier price lists: stored layouts, vendor presets, profiles and fingerprints.

Rows are cells as text, in the form (file, sheet, row_no, cells array<string>) with
columns counted from 1.  Spark has no workbook reader, so workbooks come converted.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X

MAPPING_SCHEMA = "supplier_code string, supplier_name string, sheet string, header_row int, data_start_row int, columns map<string,int>"
ITEM_COLUMNS = ("article", "name", "unit", "multiplicity", "brand", "price_base", "price_rrts", "price_opt", "price_partner", "ntin", "status", "category", "comment")
PRICES = ("price_base", "price_rrts", "price_opt", "price_partner")



class Discounts(NamedTuple):
    """Where a vendor's file has discounts by group: rows of a sheet, and two columns."""

    sheet: str
    first: int
    last: int
    group: int
    value: int
    positive: bool


class Layout(NamedTuple):
    """A vendor's sheets in order, first data row, VAT rate in prices or 0, brand, column numbers."""

    sheets: tuple[str, ...]
    start: int
    vat: float
    brand: str
    columns: dict[str, int]
    discounts: Discounts | None = None


# Vendor layouts.
VENDORS = {
    "himel": Layout(("Тариф",), 4, 0.0, "Himel", {"article": 1, "name": 2, "unit": 3, "multiplicity": 4, "price_base": 5, "comment": 6, "ntin": 7}),
    "ekf": Layout(("Продукция EKF", "Новинки"), 13, 0.12, "EKF", {"article": 1, "name": 2, "unit": 6, "price_base": 7, "price_opt": 8, "price_rrts": 9, "price_partner": 10, "multiplicity": 11}),
    "iek": Layout(("Прайс",), 9, 0.12, "IEK", {"article": 1, "name": 2, "category": 4, "unit": 8, "ntin": 9, "status": 10, "multiplicity": 13, "price_base": 15, "price_rrts": 16, "price_opt": 17, "price_partner": 20}),
    "dkc": Layout(("Прайс ДКС",), 17, 0.0, "DKC", {"article": 6, "name": 8, "unit": 9, "multiplicity": 10, "price_rrts": 11, "price_base": 12}),
    "legrand": Layout(("Тариф",), 5, 0.0, "Legrand", {"article": 3, "article_fallback": 2, "name": 4, "group": 6, "brand": 7, "unit": 15, "price_base": 16}, Discounts("Заказ", 1, 10, 4, 5, True)),
    "schneider": Layout(("Тариф 2026",), 8, 0.12, "Schneider Electric", {"article": 1, "name": 2, "price_base": 3, "price_partner": 4, "unit": 5, "group": 6}, Discounts("Тариф 2026", 2, 6, 1, 2, False)),
}


def cells_of(rows: DataFrame, width: int) -> DataFrame:
    """Wide rows c1..cn as a cells array."""
    return rows.select("file", "sheet", "row_no", F.array(*[F.col(f"c{k + 1}") for k in range(width)]).alias("cells"))


def _at(index: Column | int | None) -> Column:
    if index is None:
        return F.lit(None).cast("string")
    return F.try_element_at("cells", F.lit(index) if isinstance(index, int) else index)


def mapped_price(text: Column, divisor: Column) -> Column:
    value = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value != 0, F.round(value / divisor, 2))


def _sheets_wanted(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """The layouts with the sheet of each file that they mean: the name itself, else one that
    differs in case only (the first by name)."""
    sheets = rows.select("file", "sheet").distinct()
    both = sheets.join(mapping.withColumnRenamed("sheet", "want"), (F.col("file") == F.col("signature")) & (F.lower("sheet") == F.lower("want")))
    best = Window.partitionBy("file").orderBy((F.col("sheet") == F.col("want")).desc(), "sheet")
    return both.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "want", "signature")


def parse_mapped(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Price items (file, row_no and ITEM_COLUMNS) of rows by their stored layout, one a file.

    Columns of ``mapping``: signature (the file), sheet, data_start_row, col_<field>,
    category_col, brand (fixed), brand_column, skip_row_if_empty_col (null or absent: none),
    nds_included, nds_rate.  A brand column goes before a fixed brand.  A row whose skip
    column is there and blank goes, as does one without an article.  The layouts are a small
    dimension; Spark broadcasts them by size.
    """
    known = set(mapping.columns)
    layouts = _sheets_wanted(rows, mapping.select("signature", *[F.col(c).alias(c if c in ("sheet",) else f"m_{c}") for c in mapping.columns if c != "signature"]))
    joined = rows.join(layouts, ["file", "sheet"]).where(F.col("row_no") >= F.col("m_data_start_row"))
    stored = lambda c, kind: F.col(f"m_{c}") if c in known else F.lit(None).cast(kind)
    place = lambda c: F.nullif(stored(c, "int"), F.lit(0))
    text = lambda c: X.clean_str(_at(place(c)))
    some = lambda c: F.nullif(text(c), F.lit(""))
    divisor = F.when(stored("nds_included", "boolean"), 1 + F.coalesce(stored("nds_rate", "double"), F.lit(L.MAPPED_VAT))).otherwise(F.lit(1.0))
    skip = place("skip_row_if_empty_col")
    skipped = (skip <= F.size("cells")) & (X.strip(F.coalesce(_at(skip), F.lit(""))) == "")
    item = joined.where(~F.coalesce(skipped, F.lit(False))).select(
        "file", "row_no", text("col_article").alias("article"), text("col_name").alias("name"), F.coalesce(some("col_unit"), F.lit(L.PRICE_UNIT)).alias("unit"),
        X.safe_int(_at(place("col_multiplicity"))).alias("multiplicity"), F.when(place("brand_column").isNotNull(), some("brand_column")).otherwise(F.nullif(stored("brand", "string"), F.lit(""))).alias("brand"),
        *[mapped_price(_at(place(f"col_{p}")), divisor).alias(p) for p in PRICES], *[some(f"col_{f}").alias(f) for f in ("ntin", "status")], some("category_col").alias("category"), some("col_comment").alias("comment"),
    )
    return item.where("article <> ''")


def discounts_of(rows: DataFrame, where: Discounts) -> DataFrame:
    """(file, grp, discount) in the rows of each file; the last row of a group counts."""
    some = rows.where((F.col("sheet") == where.sheet) & F.col("row_no").between(where.first, where.last))
    read = some.select("file", "row_no", X.clean_str(_at(where.group)).alias("grp"), _at(where.value).try_cast("double").alias("discount"))
    stated = F.col("discount") > 0 if where.positive else F.col("discount").isNotNull()
    last = read.groupBy("file", "grp").agg(F.max(F.when(stated, F.struct("row_no", "discount"))).alias("last"))
    return last.where((F.col("grp") != "") & F.col("last").isNotNull()).select("file", "grp", "last.discount")


def parse_vendor(rows: DataFrame, vendor: str, layout: Layout | None = None) -> DataFrame:
    """Price items (file, row_no and ITEM_COLUMNS) by a preset layout.

    A vendor with discounts gets partner prices by them where there are none; of a vendor
    with several sheets the first row of an article counts, sheet by sheet.
    """
    layout = layout or VENDORS[vendor]
    cols, vat = layout.columns, layout.vat
    some = rows.where(F.col("sheet").isin(*layout.sheets) & (F.col("row_no") >= layout.start))
    if vendor == "dkc":
        some = category_fill(some, cols["article"])
    text = lambda f: X.clean_str(_at(cols.get(f)))
    price = lambda f: F.round(X.price_parse(_at(cols.get(f))) / (1 + vat), 2) if vat else X.price_parse(_at(cols.get(f)))
    article = X.clean_str(F.coalesce(_at(cols["article"]), _at(cols.get("article_fallback"))))
    if vendor == "legrand":
        article = X.pad_article(article)
    category = F.col("category") if vendor == "dkc" else F.nullif(text("category" if "category" in cols else "group"), F.lit(""))
    items = some.select(
        "file", "row_no", F.array_position(F.array(*[F.lit(s) for s in layout.sheets]), F.col("sheet")).alias("sheet_no"), article.alias("article"), text("name").alias("name"), F.coalesce(F.nullif(text("unit"), F.lit("")), F.lit(L.PRICE_UNIT)).alias("unit"), X.safe_int(_at(cols.get("multiplicity"))).alias("multiplicity"),
        F.coalesce(F.nullif(text("brand"), F.lit("")), F.lit(layout.brand)).alias("brand"), *[price(f).alias(f) for f in PRICES],
        *[F.nullif(text(f), F.lit("")).alias(f) for f in ("ntin", "status")], category.alias("category"), F.nullif(text("comment"), F.lit("")).alias("comment"),
    ).where("article <> ''")
    if vendor != "himel":
        items = items.where("name <> ''")
    if len(layout.sheets) > 1:
        items = first_wins(items, ("file", "article"))
    if layout.discounts:
        items = discount_matrix(items, discounts_of(rows, layout.discounts), "category")
    return items.select("file", "row_no", *ITEM_COLUMNS)


def category_fill(rows: DataFrame, article_column: int, leading: int = 5) -> DataFrame:
    """Item rows with the last category row above them: one without an article whose first
    text is in the leading columns."""
    first = F.coalesce(*[F.nullif(X.clean_str(_at(k + 1)), F.lit("")) for k in range(leading)])
    is_item = X.clean_str(_at(article_column)) != ""
    w = Window.partitionBy("file", "sheet").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("category", F.last(F.when(~is_item, first), ignorenulls=True).over(w)).where(is_item)


def discount_matrix(items: DataFrame, discounts: DataFrame, group: str) -> DataFrame:
    """The partner price, where there is none, as base less the group's discount; discounts
    with a file are those of that file."""
    keys = ["file"] if "file" in discounts.columns else []
    joined = items.join(discounts.select(*keys, F.col("grp").alias(group), "discount"), [*keys, group], "left")
    return joined.withColumn("price_partner", F.coalesce("price_partner", F.round(F.col("price_base") * (1 - F.col("discount")), 2))).drop("discount")


def first_wins(items: DataFrame, keys: Sequence[str] = ("article",), order: Sequence[str] = ("sheet_no", "row_no")) -> DataFrame:
    """The first occurrence of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def validate_mapping(mappings: DataFrame, column: str) -> DataFrame:
    """Adds ``valid`` and ``error`` for a layout in JSON: six keys, columns a map with article."""
    keys = F.json_object_keys(column)
    missing = F.array_except(F.array(*[F.lit(k) for k in L.MAPPING_KEYS]), keys)
    parsed = F.from_json(column, MAPPING_SCHEMA)
    error = (
        F.when(keys.isNull(), "not an object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), missing[0]))
        .when(parsed["columns"].isNull(), "columns is no object").when(F.coalesce(F.try_element_at(parsed["columns"], F.lit("article")), F.lit(0)) == 0, "no article column")
    )
    return mappings.withColumns({"error": error, "valid": error.isNull()})


def latest_mappings(mapping: DataFrame) -> DataFrame:
    """The newest layout of each signature."""
    w = Window.partitionBy("signature").orderBy(F.desc("created_at"), F.desc("id"))
    return mapping.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def save_mapping(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """With the layouts of signatures that have none yet."""
    return mapping.unionByName(new.join(mapping.select("signature"), "signature", "left_anti").select(*mapping.columns))


def invalidate_mappings(mapping: DataFrame, failed: DataFrame) -> DataFrame:
    """Without the layouts of signatures that failed to parse."""
    return mapping.join(failed.select("signature"), "signature", "left_anti")


def _texts(limit: int) -> Column:
    """(col, text) of the cells with text, cut to ``limit`` characters."""
    numbered = F.transform("cells", lambda c, i: F.struct((i + 1).alias("col"), F.substring(F.regexp_replace(F.replace(X.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")), "\r", ""), 1, limit).alias("text")))
    return F.filter(numbered, lambda c: c["text"] != "")


def snapshot(rows: DataFrame, preview: int = 15, cells: int = 20, chars: int = 60, sheets: int = 4) -> DataFrame:
    """(file, sheet, rows_with_data, preview): the profile of a file's first sheets, previews
    only of the first rows.  Sheets go by ``sheet_no`` where the rows have it, else by name."""
    order = "sheet_no" if "sheet_no" in rows.columns else "sheet"
    place = F.row_number().over(Window.partitionBy("file").orderBy(order))
    first = rows.select("file", "sheet", order).distinct().withColumn("_r", place).where(F.col("_r") <= sheets).select("file", "sheet")
    some = rows.join(first, ["file", "sheet"], "left_semi").withColumn("texts", _texts(chars)).where(F.size("texts") > 0)
    shown = F.when(F.col("row_no") <= preview, F.struct(F.col("row_no").alias("row"), F.slice("texts", 1, cells).alias("cells")))
    return some.groupBy("file", "sheet").agg(F.count("*").alias("rows_with_data"), F.sort_array(F.collect_list(shown)).alias("preview"))


def signature(profiles: DataFrame, sheets: int = 2) -> DataFrame:
    """(file, signature): MD5 of the first sheet profiles as JSON."""
    per = profiles.groupBy("file").agg(F.slice(F.sort_array(F.collect_list(F.struct("sheet", "rows_with_data", "preview"))), 1, sheets).alias("p"))
    return per.select("file", F.md5(F.to_json("p")).alias("signature"))


def text_signature(rows: DataFrame, last_row: int = 3, cells: int = 5, chars: int = 20) -> DataFrame:
    """(file, signature): the first cells of the first two non-empty rows, as plain text."""
    lines = rows.where(F.col("row_no") <= last_row).withColumn("texts", F.filter("cells", lambda c: c.isNotNull())).where(F.size("texts") > 0)
    line = F.array_join(F.slice(F.transform("texts", lambda c: F.substring(c, 1, chars)), 1, cells), "|")
    per = lines.groupBy("file", "sheet").agg(F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("row_no", line.alias("line")))), lambda x: x["line"]), 1, 2), ";").alias("lines"))
    return per.groupBy("file").agg(F.array_join(F.slice(F.sort_array(F.collect_list(F.concat("sheet", F.lit("::"), "lines"))), 1, 4), "##").alias("signature"))


def detect_suppliers(rows: DataFrame, rules: Sequence[tuple] = L.VENDOR_RULES, unique_sheets: Sequence[tuple] = L.VENDOR_SHEETS) -> DataFrame:
    """(file, supplier): by a sheet name that only one vendor has, else by the first rule
    (sheet, row, column, keyword, vendor) whose header cell has the keyword.  The rules
    are a fixed table of a few rows."""
    spark: SparkSession = rows.sparkSession
    table = spark.createDataFrame([(100 + k, *r) for k, r in enumerate(rules)] + [(k, s, None, None, None, v) for k, (s, v) in enumerate(unique_sheets)], "rule int, want string, at_row int, at_col int, keyword string, supplier string")
    named = F.lower("sheet") == F.lower("want")
    header = (F.col("row_no") == F.col("at_row")) & F.contains(F.lower(X.strip(F.coalesce(F.try_element_at("cells", F.col("at_col")), F.lit("")))), F.col("keyword"))
    hits = rows.join(F.broadcast(table), named & (F.col("keyword").isNull() | header))
    return hits.groupBy("file").agg(F.min_by("supplier", "rule").alias("supplier"))
