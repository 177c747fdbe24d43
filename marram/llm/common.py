"""Helpers that every corpus operator shares."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from ctypes import CDLL
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.session import shared_folder

#: White space of the corpus contracts: space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, _UPPER, _UPPER.lower())


#: Bytes of an Arrow batch: a task holds a few of them in the JVM and as many in Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are held to BATCH_BYTES, unless the user has set that bound.

    It bounds memory and leaves results as they are. Results are lazy, so the setting stays.
    """
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Batches) -> Batches:
    """``run`` for mapInArrow, whose worker gives the memory it no longer uses back when the task ends: workers outlive tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(CDLL(None), "malloc_trim", None)  # the GNU allocator has it
            if trim is not None:
                trim(0)

    return wrapped


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of stored tables, in the order of their making.
_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but columnar and compressed, so that later reads can prune columns.

    The files lie in the session's checkpoint folder until ``scratch`` or ``discard`` removes them.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Remove stored tables: those of ``paths``, or all that this process has made. What was read from them must be done with."""
    for path in list(_STORED if paths is None else paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STORED.remove(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner see what is done with: shuffle files stay on disk until the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside are removed at the end, but for folders that the body puts into the list."""
    before, keep = set(_STORED), []
    try:
        yield keep
    finally:
        discard(spark, [p for p in _STORED if p not in before and p not in keep])


def last_stored() -> str:
    """The folder of the table stored last."""
    return _STORED[-1]


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as it takes to be none of ``columns`` (letter case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Keys that may be hot: those with at least one row in so many; and rows that are no burden for one task, whatever their keys.
HOT_KEYS, FEW_ROWS = 1000, 20_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, few: int = FEW_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and, in ``weight``, how many of the ``total`` rows carry it.

    Keys with 1 / HOT_KEYS of the rows, of which there are HOT_KEYS at most, are broadcast, so their
    rows stay where they are; the others are joined by key. Rows of ``table`` must be small. Both
    sides are read twice and should be materialised. Up to ``few`` rows all are joined by key.
    ``weight`` is dropped; a null key meets nothing.
    """
    if total <= few:
        return rows.join(table.drop(weight), keys)
    share = F.col(weight) * HOT_KEYS
    hot, cold = table.where(share >= total).drop(weight), table.where(share < total).drop(weight)
    kept = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(kept.join(cold, keys))


def crc32_residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
