"""Sharding by longest-processing-time scheduling.

Equal texts form a group that stays together.  Groups, largest first, go to the
shard with the least bytes so far, through a heap.

The order only depends on group sizes, so scheduling works on a histogram of
sizes: sizes below 2**SIZE_BITS exactly, larger ones to SIZE_BITS significant bits
(0.05 % at 11).  That bounds the histogram (under 90,000 classes for groups up
to a petabyte), whatever the number of documents; a class then counts with its
mean size.  Which of a class's groups takes which of its places is settled by
their rank, computed in parallel over hashed buckets.  No step gathers documents
or groups in one task, and texts are never shuffled, only their digests.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize

SHARDS = 16
SIZE_BITS = 11
#: Hashed buckets in which ranks are counted in parallel.
BUCKETS = 256


def size_class(size):
    """Column: ``size`` with all but its top SIZE_BITS + 1 bits cleared."""
    extra = F.greatest(F.lit(0), F.length(F.bin(size)) - (SIZE_BITS + 1))
    return F.call_function("shiftleft", F.call_function("shiftright", size, extra), extra)


def _places(loads: list[float], size: float, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets under LPT.

    Shard s would take its k-th item at load loads[s] + k * size; the ``count``
    lowest of these values win (ties: lower shard).  All but a few are dealt in one
    go, those by the heap.
    """
    taken = [0] * len(loads)
    if count > 4 * len(loads):
        low, high = min(loads), max(loads) + size * (count + 1)
        for _ in range(100):
            mid = (low + high) / 2
            if sum(int((mid - x) // size) + 1 for x in loads if x <= mid) > count - 2 * len(loads):
                high = mid
            else:
                low = mid
        taken = [int((low - x) // size) + 1 if x <= low else 0 for x in loads]
    heap = [(x + size * n, s) for s, (x, n) in enumerate(zip(loads, taken))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, s = heap[0]
        taken[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return taken


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, shard, first, last) of ranks per class; classes are (class, groups, bytes)."""
    loads, plan = [0.0] * shards, []
    for c, count, total in sorted(classes, reverse=True):
        size, at = total / count, 0
        for s, n in enumerate(_places(loads, size, count)):
            if n:
                plan.append((c, s, at, at + n - 1))
                loads[s] += n * size
                at += n
    return plan


def _ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds gapless ranks from 0 within ``key``: by hashed bucket, then by ``order``."""
    bucketed = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(key, "_b").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = bucketed.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1)
    return within.join(offsets, [key, "_b"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per input row.

    A null text counts as an empty one (size 1, one group with empty texts).
    Repeated rows are copies in one group and get a slot each; a null id gets a
    place like any other.  Slots count from 0 within a shard without gaps.  A group
    larger than a shard's even share stays whole, on a shard of its own if need
    be.  An empty table gives no rows.  Texts of any length count whole; of equal
    groups that of the smaller digest goes first, of equal loads the smaller shard.  Further
    columns, whatever their names, are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes")))
    groups = materialize(groups, "shard-groups")
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    plan = schedule([(r["class"], r.n, r.bytes) for r in histogram.toLocalIterator()], shards)
    spark = docs.sparkSession
    spans = spark.createDataFrame(plan, "class long, shard int, first long, last long")
    placed = _ranked(groups, "class", ["digest"], "rank").join(spans, "class").where("rank between first and last").select("digest", "shard")
    return _ranked(rows.join(placed, "digest"), "shard", ["doc_id", "digest"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
