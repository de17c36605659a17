"""What the operators of this subpackage share: words, table access and batched text maps."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.shared import Scratch  # noqa: F401

#: A word as every contract of this package counts it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step works on; a single longer text is one step.
CHUNK_CHARS = 250_000
#: Bytes of an Arrow batch between the JVM and Python, at most, unless a single row is larger.
BATCH_BYTES = 4 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator works on, under private names; a null text is empty."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def same_ids(one: DataFrame, two: DataFrame, column: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Both tables, with ids as text where their types differ."""
    if one.schema[column].dataType == two.schema[column].dataType:
        return one, two
    return tuple(df.withColumn(column, F.col(column).cast("string")) for df in (one, two))


def small_batches(df: DataFrame) -> None:
    """Bounds the session's Arrow batches by bytes: a batch lies in the JVM and in Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(key) or "").lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives freed memory of this worker back to the system; workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text each, so that memory follows `most`
    bytes and the longest single text, not the batch."""
    sizes = pc.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + (size or 0) > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size or 0
    if begin < len(sizes):
        yield batch.slice(begin)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in slices(batch, column, most):
        yield part, part.column(column).to_pylist()


def map_texts(df: DataFrame, work: Callable[[list[str]], dict[str, list]], schema: str, text: str = "_text", carry: tuple[str, ...] = ("_id",)) -> DataFrame:
    """One output row per input row: the carried columns and those of `schema`, which
    `work` returns for a list of texts. Arrow batches; no shuffle."""
    own = T.StructType.fromDDL(schema)
    out = T.StructType([df.schema[c] for c in carry] + own.fields)
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text):
                got = work(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carry] + [pa.array(got[n], type=t) for n, t in arrow],
                    names=[*carry, *(n for n, _ in arrow)],
                )
        release()

    small_batches(df)
    return df.select(*carry, text).mapInArrow(run, out)


def filter_texts(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str) -> DataFrame:
    """The rows, all columns, whose text `keep` accepts (a null text counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text_col):
                yield part.filter(pa.array(keep([t or "" for t in texts]), type=pa.bool_()))
        release()

    small_batches(docs)
    return docs.mapInArrow(run, docs.schema)
