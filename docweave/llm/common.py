"""What the training-data operators share: checkpoints, the label split, text batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised loop handles at a time.
STEP_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="docweave-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: the session's ``spark.checkpoint.dir``.

    A session that names none must be a local one: it has one machine, whose temporary folder serves.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("the session must name a folder that all executors share: spark.checkpoint.dir")
        context.setCheckpointDir(named or _local_folder(context.applicationId))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: Column) -> Column:
    """True for the rows that no model may learn labels from: crc32(key as text) mod 3 is 1.

    A null key counts as held out.
    """
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that each piece holds about ``step`` bytes of text, one row at least.

    Yields (piece, its texts with null as the empty text).
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > step:
                yield batch.slice(begin, i - begin), [t or "" for t in column.slice(begin, i - begin).to_pylist()]
                begin, total = i, 0
            total += size
        yield batch.slice(begin), [t or "" for t in column.slice(begin).to_pylist()]


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
