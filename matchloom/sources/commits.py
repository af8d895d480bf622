"""Batches that count once: data first, a commit record last, readers see committed data alone.

``path/data/batch=…/attempt=…`` has what a run wrote, ``path/commits/…`` one record a batch, created only
if there is none.  A job that dies before its record leaves nothing that is read; a batch that is sent
again is refused by the record, so a retry, as of ``foreachBatch``, appends nothing twice.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _name(batch: str) -> str:
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch has a name of letters, digits, points and dashes")
    return batch


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    store, where = _file(spark, f"{path}/commits/{_name(batch)}.json")
    return store.exists(where)


def prepare(rows: DataFrame, path: str, batch: str, kind: str = "parquet", attempt: str | None = None, **options) -> str:
    """Writes the data of one attempt, which nobody sees yet; the attempt's name."""
    attempt = attempt or uuid.uuid4().hex
    rows.write.format(kind).options(**options).save(f"{path}/data/batch={_name(batch)}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, batch: str, attempt: str, **more) -> bool:
    """Creates the batch's record with ``more`` fields; false if another attempt has its own already."""
    store, where = _file(spark, f"{path}/commits/{_name(batch)}.json")
    try:
        out = store.create(where, False)
    except Exception as e:
        if store.exists(where):
            return False
        raise e
    out.write((json.dumps({"batch": batch, "attempt": attempt} | more) + "\n").encode())
    out.close()
    return True


def append_batch(rows: DataFrame, path: str, batch: str, kind: str = "parquet", **more) -> bool:
    """Data and record of a batch; false, with nothing written, if the batch is committed."""
    spark = rows.sparkSession
    return not is_committed(spark, path, batch) and commit(spark, path, batch, prepare(rows, path, batch, kind), **more)


def commits(spark: SparkSession, path: str, fields: str = "") -> DataFrame:
    """(batch, attempt, fields...) of all committed batches."""
    schema = T._parse_datatype_string("batch string, attempt string" + (f", {fields}" if fields else ""))
    store, where = _file(spark, f"{path}/commits")
    return spark.read.schema(schema).json(f"{path}/commits") if store.exists(where) else spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", records: str | None = None) -> DataFrame:
    """The rows of committed attempts, with their ``batch``; ``records`` is the path of the records if another."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
    done = commits(spark, records or path)
    if done.isEmpty():
        return spark.createDataFrame([], whole).select(*schema.names, "batch")
    rows = spark.read.schema(whole).format(kind).load(f"{path}/data")
    return rows.join(F.broadcast(done) if done.count() < 10_000 else done, ["batch", "attempt"], "left_semi").select(*schema.names, "batch")
