"""Writers: the catalog, quotes and log rows as files of a folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from matchloom.functions import lexicons as L
from matchloom.operators.pricing import quote_lines
from matchloom.operators.reports import ordered_places
from matchloom.sources.commits import append_batch, committed

CATALOG_FIELDS = ("article", "name", "unit", "kaznisa", "rrts", "mrc", "opt", "partner", "brand", "multiplicity", "kaznisa_code")


def catalog_sheet(catalog: DataFrame) -> DataFrame:
    """Active products in the order of ``num`` and id; a missing or zero ``num`` becomes the
    place in that order, zero prices become null and missing texts empty.  Places are
    counted by ranges, so no task sees the whole catalog."""
    rows = ordered_places(catalog.where("is_active"), "num", ["num", "id"])
    kinds = dict(rows.dtypes)
    value = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if kinds[c] == "string" else F.nullif(F.col(c), F.lit(0)).alias(c)
    num = F.coalesce(F.nullif(F.col("num").cast("long"), F.lit(0)), F.col("place").cast("long"))
    return rows.select("id", num.alias("num"), *[value(c) for c in CATALOG_FIELDS if c in kinds])


def write_catalog(catalog: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """The sheet of the active catalog, sorted over files by range."""
    catalog_sheet(catalog).orderBy("num", "id").write.format(kind).options(**options).mode("overwrite").save(path)


def write_quote(lines: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """The lines of all quotes, sorted by document and line over files by range."""
    quote_lines(lines).orderBy("doc_id", "item_id").write.format(kind).options(**options).mode("overwrite").save(path)


LOG = "kind string, id long, subject string, status string, rows_added long, created_at timestamp"


def constants_sheet(people: DataFrame, brands: DataFrame, currencies: DataFrame) -> DataFrame:
    """Rows of the constants table from 2 on: people, brands and currencies side by side, each by name.

    Missing texts of people become empty; the lists are of a company's people, brands and
    currencies, so each is numbered in one task."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    sides = (
        people.where("is_active").select(text("full_name"), text("position"), text("email"), text("phone")),
        brands.select("brand", *L.BRAND_DEFAULTS),
        currencies.select(F.col("name").alias("currency"), F.col("rate").alias("currency_value")),
    )
    out = None
    for side in sides:
        placed = side.withColumn("row_no", F.row_number().over(Window.orderBy(side.columns[0])) + 1)
        out = placed if out is None else out.join(placed, "row_no", "full_outer")
    return out


def write_template(catalog: DataFrame, people: DataFrame, brands: DataFrame, currencies: DataFrame, path: str, kind: str = "parquet") -> None:
    """All tables of the base template: ``path/catalog`` and ``path/constants``."""
    write_catalog(catalog, f"{path}/catalog", kind)
    constants_sheet(people, brands, currencies).write.format(kind).mode("overwrite").save(f"{path}/constants")


def log_rows(rows: DataFrame, kind: str, subject: str, status: str, created_at: str, rows_added: str | None = None) -> DataFrame:
    """Imports, uploads or corrections in the shape of the log."""
    added = F.col(rows_added) if rows_added else F.lit(None)
    return rows.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col(subject).cast("string").alias("subject"), F.col(status).cast("string").alias("status"), added.cast("long").alias("rows_added"), F.col(created_at).cast("timestamp").alias("created_at"))


def append_logs(logs: DataFrame, path: str, batch: str) -> bool:
    """Rows of ``log_rows`` as one batch of the log; false if the batch is in it already."""
    return append_batch(logs, path, batch)


def read_logs(spark, path: str) -> DataFrame:
    return committed(spark, path, _parse_datatype_string(LOG)).drop("batch")
