"""Page texts: which pages are specifications, scans, and titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X


def _any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(X.any_of(words))


def is_spec(text: Column, words: dict[str, Sequence[str]] = L.PAGE_LEXICON, latin_suffix: str = r"\.co") -> Column:
    """A title (but no index page without a position column), or three column words with a
    sheet suffix or a type column."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = {k: _any(t, v) for k, v in words.items()}
    three = has["position"] & has["name"] & has["quantity"]
    suffix = has["suffix"] | t.rlike(rf"(?U){latin_suffix}(?!\w)")
    return F.when(has["title"], ~(has["index"] & ~has["position"])).otherwise(three & (suffix | has["type"]))


def selected_pages(pages: DataFrame, words: dict[str, Sequence[str]] = L.PAGE_LEXICON) -> DataFrame:
    """The specification pages of each document, or all its pages if there is none."""
    marked = pages.withColumn("is_spec", is_spec(F.col("text"), words))
    any_spec = F.max("is_spec").over(Window.partitionBy("doc_id"))
    return marked.withColumn("_any", any_spec).where(F.col("is_spec") | ~F.col("_any")).drop("_any")


def title_pages(pages: DataFrame, words: dict[str, Sequence[str]] = L.PAGE_LEXICON, first: int = 10, most: int = 5) -> DataFrame:
    """The first five other pages among the first ten; without any, the first five."""
    marked = pages.where(F.col("page") < first).withColumn("other", ~is_spec(F.col("text"), words))
    w = Window.partitionBy("doc_id")
    ranked = marked.withColumns({"_any": F.max("other").over(w), "_r": F.row_number().over(w.orderBy(F.desc("other"), "page")), "_p": F.row_number().over(w.orderBy("page"))})
    return ranked.where((F.col("_any") & F.col("other") & (F.col("_r") <= most)) | (~F.col("_any") & (F.col("_p") <= most))).drop("_any", "_r", "_p", "other")


def title_score(text: Column, keywords: Sequence[str] = L.PROJECT_KEYWORDS) -> Column:
    """0 to 1: keyword and length speak for a title, article-like and non-Cyrillic texts against."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, r"[а-яёА-ЯЁ\s]", ""))
    score = F.when(_any(F.lower(t), keywords), 0.2).otherwise(0.0) + F.least(F.length(t) / 200.0, F.lit(0.3))
    score = score - F.when(t.rlike(r"[A-Z]{2,}-\d{2,}"), 0.4).otherwise(0.0) - F.when(other > F.length(t) * 0.6, 0.3).otherwise(0.0)
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


def project_titles(pages: DataFrame, keywords: Sequence[str] = L.PROJECT_KEYWORDS, minimum: float = 0.25) -> DataFrame:
    """(doc_id, title, score): the best line of 10 to 300 characters, the first of equals."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("title", X.strip(F.col("raw")))
    rows = rows.where(F.length("title").between(10, 300)).withColumn("score", title_score(F.col("title"), keywords))
    best = rows.groupBy("doc_id").agg(F.min_by(F.struct("title", "score"), F.struct((-F.col("score")).alias("s"), "page", "line")).alias("b"))
    return best.select("doc_id", "b.title", "b.score").where(F.col("score") >= minimum)


def title_or_file(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.trim(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")))


def scanned(pages: DataFrame, first: int = 5, chars: int = 30) -> DataFrame:
    """(doc_id, scanned): no page among the first has more than a few characters."""
    some = F.max(F.when(F.col("page") < first, F.length(X.strip(F.coalesce("text", F.lit(""))))))
    return pages.groupBy("doc_id").agg((F.coalesce(some, F.lit(0)) <= chars).alias("scanned"))
