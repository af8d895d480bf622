"""Listing and searching the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.operators.catalog import active


def _has(column: str, text: str):
    return F.contains(F.lower(column), F.lit(text.lower()))


def listed(catalog: DataFrame, brand: str = "", text: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the active rows, by id; the limit is the feature."""
    rows = catalog.where("is_active")
    if brand:
        rows = rows.where(F.col("brand") == brand)
    if text:
        rows = rows.where(_has("article", text) | _has("name", text))
    return rows.orderBy("id").offset(offset).limit(limit)


def ranked_search(catalog: DataFrame, text: str = "", article: str = "", name: str = "", code: str = "", segment: str = "", limit: int = 30) -> DataFrame:
    """Active rows with the text in article, name or code, the code filter on top; exact
    article first, then article prefix, exact code, id.  No text at all gives no rows."""
    text, article, name, code, segment = (x.strip() for x in (text, article, name, code, segment))
    if not (text or article or name or code):
        return catalog.limit(0)
    rows, order = active(catalog, (segment.lower(),) if segment.lower() in L.SEGMENTS else L.SEGMENTS), []
    lead = text or article
    if text:
        rows = rows.where(_has("article", text) | _has("name", text) | _has("kaznisa_code", text))
    elif article:
        rows = rows.where(_has("article", article))
    if not text and name:
        rows = rows.where(_has("name", name))
    if code:
        rows = rows.where(_has("kaznisa_code", code))
    if lead:
        order = [(F.lower("article") == lead.lower()).desc(), F.startswith(F.lower("article"), F.lit(lead.lower())).desc()]
    if text:
        order.append((F.lower("kaznisa_code") == text.lower()).desc())
    return rows.orderBy(*order, "id").limit(limit)


def prices_of(catalog: DataFrame, articles: str) -> DataFrame:
    """Price columns for a comma-separated list of articles."""
    wanted = sorted({a.strip() for a in articles.split(",")} - {""})
    return catalog.where(F.col("article").isin(*wanted)).select("article", "name", "brand", *L.PRICE_FIELDS)
