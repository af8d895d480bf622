"""Catalog frames: defaults, normalised keys, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X


def with_defaults(catalog: DataFrame) -> DataFrame:
    """Trimmed texts, nulls as empty, default unit and segment."""
    filled = {c: F.trim(F.coalesce(F.col(c), F.lit(d))) for c, d in (("article", ""), ("name", ""), ("unit", L.CATALOG_UNIT), ("brand", ""), ("segment", L.DEFAULT_SEGMENT), ("kaznisa_code", ""))}
    return catalog.withColumns(filled)


def active(catalog: DataFrame, segments: Sequence[str] = L.SEGMENTS) -> DataFrame:
    """Active rows of the segments; both predicates reach the scan."""
    return catalog.where(F.col("is_active") & F.col("segment").isin(*segments))


def keyed(catalog: DataFrame) -> DataFrame:
    """With the normalised keys that matching joins on."""
    k = catalog.withColumns({"norm_art": X.normalize(F.col("article")), "norm_name": X.normalize(F.col("name")), "norm_code": X.normalize(F.col("kaznisa_code"))})
    return k.withColumn("norm_nocyr", X.strip_cyrillic(F.col("norm_art")))


def duplicate_keys(catalog: DataFrame, key: str = "norm_art") -> DataFrame:
    """(key, ids, n): the rows that share a normalised key."""
    return keyed(catalog).where(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def cross_segment_duplicates(catalog: DataFrame) -> DataFrame:
    """Articles in more than one segment: (norm_art, n_segments)."""
    return keyed(catalog).where("norm_art <> ''").groupBy("norm_art").agg(F.count_distinct("segment").alias("n_segments")).where("n_segments > 1")
