"""Helpers the document operators share: inputs, texts in Arrow batches, tables in the shared work folder."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.session import checkpoint_root

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the folder that all executors share (``spark.checkpoint.dir``).

    A lost executor costs only the tasks that read it: the table outlives its writers. Compressed columns, so it is
    smaller than a checkpoint of rows.
    """
    path = f"{checkpoint_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_process(key: tuple, build: Callable):
    """``build()``, kept for later tasks of a Python worker: vocabularies and the like, whose size is bounded.

    Workers live as long as their executor, so only the latest two are kept: one stage's do not add to the next one's.
    """
    held = vars(sys.modules.setdefault("airlens_llm_process", types.ModuleType("airlens_llm_process"))).setdefault("held", {})
    if key not in held:
        while len(held) > 1:
            del held[next(iter(held))]
        held[key] = build()
    return held[key]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS`` rows: what a function makes of a part bounds a worker's memory, not a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def small_batches(spark: SparkSession) -> None:
    """Texts cross to Python ``ROWS`` at a time: the usual 10,000 would hold tens of megabytes a task on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def give_back() -> None:
    """What a task freed goes back to the machine. Workers live on from stage to stage, and the C library keeps freed memory
    for later calls, so that one stage's needs would otherwise stand beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[..., dict], schema: str, *columns: str) -> DataFrame:
    """Rows of ``fn(lists of the columns) -> {name: list or array}`` over Arrow batches of ``columns``."""
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    names = [f.name for f in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in slices(batches):
            out = fn(*[batch.column(c).to_pylist() for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type, from_pandas=False) for n in names], names=names)
            del out
        give_back()

    return df.select(*columns).mapInArrow(run, target)


def select_rows(df: DataFrame, fn: Callable[[list], tuple]) -> DataFrame:
    """The rows of ``df`` that ``fn(texts) -> (keep, new texts or None)`` keeps, with their new texts and ``n_chars`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep, texts = fn(batch.column("text").to_pylist())
            columns = {n: batch.column(n) for n in batch.schema.names}
            if texts is not None:
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema).filter(pa.array(keep, pa.bool_()))
            del columns, texts
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as make it none of ``columns`` (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(data: bytes) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return data.split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * STEP
    h = (h ^ (h >> np.uint64(32))) * STEP
    return h ^ (h >> np.uint64(32))


def windows_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` values in a row; none if there are fewer."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out *= GOLDEN
        out += h[i : i + n]
    return mixed(out)


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus
