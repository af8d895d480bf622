"""Catalog and constants sheets in wide text form (row_no, c1..cn; the header row is left out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X

C = F.col


def read_cells(spark, path: str, **options) -> DataFrame:
    """A CSV file with every cell as text."""
    return spark.read.csv(path, header=False, inferSchema=False, **options)


def pick_sheet(sheets: DataFrame, names: Sequence[str] = L.SHEET_NAMES) -> DataFrame:
    """(file, sheet): the first accepted name that a file has; files without one are left out."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), C("sheet"))
    return sheets.where(C("sheet").isin(*names)).groupBy("file").agg(F.min_by("sheet", order).alias("sheet"))


def catalog_rows(rows: DataFrame, segment: str = L.DEFAULT_SEGMENT) -> DataFrame:
    """Typed catalog rows; rows without an article are left out."""
    typed = rows.select(
        "row_no", X.safe_int(C("c1")).alias("num"), X.safe_str(C("c2")).alias("article"), X.safe_str(C("c3")).alias("name"), F.coalesce(X.safe_str(C("c4")), F.lit(L.CATALOG_UNIT)).alias("unit"),
        *[X.safe_float(C(c)).alias(f) for f, c in zip(L.PRICE_FIELDS, ("c5", "c6", "c7", "c8", "c9"))], X.safe_str(C("c10")).alias("brand"), X.safe_int(C("c11")).alias("multiplicity"), X.safe_str(C("c12")).alias("kaznisa_code"),
        F.lit(segment).alias("segment"), F.lit(True).alias("is_active"),
    )
    return typed.where(C("article").isNotNull())


def people_rows(rows: DataFrame) -> DataFrame:
    """All rows of people of a constants sheet, with their row numbers."""
    some = rows.select("row_no", X.safe_str(C("c2")).alias("full_name"), X.safe_str(C("c3")).alias("position"), X.safe_str(C("c4")).alias("email"), X.safe_str(C("c5")).alias("phone"))
    return some.where(C("full_name").isNotNull() & ~C("full_name").isin(*L.PEOPLE_HEADERS))


def people(rows: DataFrame) -> DataFrame:
    """People of a constants sheet; the first row of a name counts."""
    some = people_rows(rows)
    first = some.groupBy("full_name").agg(F.min_by(F.struct("row_no", "position", "email", "phone"), "row_no").alias("r"))
    return first.select("full_name", "r.*")


def brand_rows(rows: DataFrame) -> DataFrame:
    """Brand constants of a sheet, a row each, in file order."""
    cols = zip(("margin", "logistics", "rate", "currency_rate", "nds", "gp"), ("c9", "c10", "c11", "c12", "c13", "c14"))
    some = rows.select("row_no", X.safe_str(C("c8")).alias("brand"), *[X.safe_float(C(c)).alias(n) for n, c in cols])
    return some.where(C("brand").isNotNull() & ~C("brand").isin(*L.BRAND_HEADERS))


def currency_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row_no", X.safe_str(C("c22")).alias("name"), X.safe_float(C("c23")).alias("rate")).where("name is not null and rate is not null")
