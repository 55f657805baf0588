"""Helpers shared by the operators: tables, the shared folder, word splitting."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.operators.prefilter import mark_listed
from liftlens.session import delete_path, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[list[str]] = []  # paths made inside each open ``scratch`` block


def shared_path(spark: SparkSession, name: str, stays: bool = False) -> str:
    """A fresh path under the shared folder that the cluster names; a ``scratch``
    block deletes it at its end unless it ``stays``."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES if not stays else ():
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are written inside the block when it ends. What is
    read afterwards must be materialized inside it with ``stays``."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            delete_path(spark, path)


# The Parquet writer looks at its buffers every 100 rows only, which is too late for rows of a megabyte.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def materialize(df: DataFrame, name: str, stays: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, with ``options`` of the writer, and
    read it back.

    Cuts the lineage: a lost executor re-reads the table and repeats none of
    the work (or side effects) behind it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name, stays)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table written by ``materialize`` that no result reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps. It does so when the
    driver's garbage is collected, which a driver with little to do puts off."""
    gc.collect()
    spark._jvm.System.gc()


def _give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving back the memory it freed when a task ends:
    Spark uses its Python workers again, and they would keep the peak of every stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """A row a batch, in Arrow and in the Parquet reader, for what Spark runs inside
    the block: for tables whose rows hold a megabyte or more each."""
    old = [(name, spark.conf.get(name)) for name in _BATCHES]
    try:
        for name in _BATCHES:
            spark.conf.set(name, "1")
        yield
    finally:
        for name, value in old:
            spark.conf.set(name, value)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows of a table of texts in an Arrow batch, and half as many
    in a batch of the Parquet reader, from now on: the JVM and its Python workers
    hold a batch several times over, and the reader keeps its largest."""
    for name, most in zip(_BATCHES, (rows, max(1, rows // 2))):
        now = int(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` whose id is not among ``ids`` (a written table of that column);
    null ids stay. A filter of fixed size clears most rows where they are, and
    only the others meet the ids in a join."""
    mark = "_listed"
    while mark.lower() in map(str.lower, rows.columns):
        mark = f"_{mark}"
    marked = mark_listed(rows, ids.select(id_col), [id_col], mark)
    met = marked.filter(mark).join(ids, id_col, "left_anti").select(*rows.columns)
    return marked.filter(~F.col(mark)).select(*rows.columns).union(met)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(col: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(col.cast("string").cast("binary"))


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def slices(batch: pa.RecordBatch, text: int, max_bytes: int = 4_000_000, max_rows: int = 1000):
    """Cut a batch into runs of rows whose text column holds about ``max_bytes``
    (at least one row each), so that a task's working set stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def index_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers for the words of several texts: (numbers of all words in order,
    start of each text and the end of the last, the distinct words by number)."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(bounds[-1]))
    return words, bounds, list(numbers)


def text_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text of ``bounds`` (0 for a text without words)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
