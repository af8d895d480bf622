"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes of text that one numpy pass works on, so memory stays flat
#: whatever Spark puts into an Arrow batch.  One longer text is a slice alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where it is unset in a local session (as in tests) a temporary one is set; on a
    cluster that is an error, as a local folder there is not shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with marks added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts lineage and computes ``df`` once; a lost executor loses nothing.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut batches at row borders so that each holds about SLICE_BYTES of text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0.0
        for i, n in enumerate(sizes):
            if total and total + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0.0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over text slices.

    ``make`` runs once in each task and returns the function that turns a slice
    into columns (or a whole batch); so a task sets up its state once.
    """

    def run(batches):
        fn = make()
        for part in slices(batches, text):
            out = fn(part)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_pydict(out)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` whose lengths are ``counts`` (0 allowed)."""
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.result_type(values, np.int64)), np.cumsum(values, axis=0)])
    return total[ends] - total[ends - counts]
