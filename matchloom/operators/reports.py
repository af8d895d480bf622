"""Statistics, guards and latest-first lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L


def ordered_places(rows: DataFrame, leading: str, order: Sequence[str], block: int = 4096) -> DataFrame:
    """Gapless places from 1 in the order of ``order``, whose first column is the number
    ``leading``: blocks of it are numbered in parallel and start after the ones before.

    Rows without a number come last.  They, and those whose number is 0, may be many, so
    they are numbered in blocks of the second column, a whole number.
    """
    no, tie, keys = F.col(leading), F.col(order[1]), ["_late", "_block", "_some", "_tie"]
    plain = F.coalesce(no != 0, F.lit(False))
    blocked = rows.withColumns({"_late": no.isNull(), "_block": F.coalesce(F.floor(no / block), F.lit(0)), "_some": plain, "_tie": F.when(plain, 0).otherwise(F.floor(tie / block))})
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return blocked.withColumn("_rank", rank).join(starts, keys).withColumn("place", (F.col("_rank") + F.col("_start")).cast("int")).drop(*keys, "_rank", "_start")


def match_stats(matches: DataFrame) -> DataFrame:
    """Per document: total (headings included) and five statuses."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return matches.groupBy("doc_id").agg(F.count("*").alias("total"), *[of(s) for s in ("exact", "multiple", "fuzzy", "not_found", "ai_match")])


def preview_stats(lines: DataFrame) -> DataFrame:
    """Ten counters over a preview; the total leaves headings out."""
    from matchloom.functions.text import falsy

    status = F.col("status")
    flag = lambda c: F.count_if(F.col(c)) if c in lines.columns else F.count_if(F.lit(False))
    no_price = F.col("product_id").isNotNull() & (status != "not_found") & F.coalesce(*[falsy(F.col(c)) for c in L.PRICE_FIELDS]).isNull()
    return lines.agg(
        F.count_if(status != "heading").alias("total"), F.count_if(status == "exact").alias("exact"), F.count_if(status.isin("multiple", "fuzzy")).alias("warn"), F.count_if(status == "ai_match").alias("ai_match"),
        flag("ai_low_confidence").alias("low_confidence"), F.count_if(status == "not_found").alias("not_found"), flag("ai_downgraded").alias("downgraded"), F.count_if(status == "manager_match").alias("history"), flag("corrected").alias("corrected"), F.count_if(no_price).alias("no_price"),
    )


def import_guard(logs: DataFrame, as_of: str, weekdays: dict[str, int] = L.SEGMENT_WEEKDAYS) -> DataFrame:
    """(segment, n, allowed): successful imports in [as_of - 7 days, as_of - 1 day], both at
    midnight, and whether it is the segment's weekday and there is one."""
    day = F.to_timestamp(F.lit(as_of))
    seg = logs.sparkSession.createDataFrame(list(weekdays.items()), "segment string, day int")
    n = logs.where((F.col("status") == "success") & F.col("created_at").between(day - F.expr("INTERVAL 7 DAYS"), day - F.expr("INTERVAL 1 DAY"))).groupBy("segment").agg(F.count("*").alias("n"))
    return seg.join(n, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"), ((F.weekday(day) == F.col("day")) & (F.coalesce("n", F.lit(0)) > 0)).alias("allowed"))


def latest(rows: DataFrame, by: str, n: int, key: str = "id") -> DataFrame:
    """The latest ``n`` rows (ties: larger key); Spark keeps n a task."""
    return rows.orderBy(F.desc(by), F.desc(key)).limit(n)
