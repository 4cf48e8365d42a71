"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words in every contract here.
WORD_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``; a private one is set only in a
    local session that names none (tests): elsewhere executors could not see it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the same folder: for rows that hold texts."""
    where = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batches: Iterator[pa.RecordBatch], text: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``budget`` text bytes.

    A single longer text still travels whole, alone in its slice.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin, held = 0, 0
        for row, n in enumerate(size):
            if held and held + n > budget:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += n
        yield batch.slice(begin)


def give_back() -> None:
    """Return freed memory to the system: idle workers stay with their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text", end: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over slices of bounded bytes; ``fn`` returns columns.

    ``end`` is called after a partition, to give memory back to the next stage.
    """
    names = [f.name for f in _schema(df.sparkSession, schema)]
    types = _arrow(_schema(df.sparkSession, schema))

    def run(batches):
        for part in slices(batches, text):
            out = fn(part)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := out[n], pa.Array) else pa.array(c, t) for n, t in zip(names, types)], names
            )
        if end is not None:
            end()
        give_back()

    return df.mapInArrow(run, schema)


def _schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _arrow(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def text_column(df: DataFrame, text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))
